"""Language ID by multilingual mixture inference.

Training counts hashed byte trigrams per language over all labelled documents; the model is a table of languages x buckets, whose size does
not depend on the number of documents. Prediction fits, per document, the proportions of the languages by expectation-maximisation over the
trigrams' likelihoods, then grows the set of languages in order of proportion while the likelihood gains more than the penalty of another
language.

Defined results: ``und`` with score 0 if the text is null, empty or has no letter, or if nothing was learned; ties go to the language that
sorts first; repeated rows are learned and predicted row by row; a document without id is neither trained on nor held out; an empty table
gives an empty table; other columns are never read.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsetlab.llm.common import batch_of

BUCKETS = 1 << 15
SMOOTHING = 0.5
ITERATIONS = 30
TOLERANCE = 1e-3
PENALTY = 5.0            # times half the log of the number of trigrams, per further language
UNDETERMINED = "und"


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the lower-cased text with a space on either side."""
    data = np.frombuffer(f" {text.lower()} ".encode("utf-8", "replace"), np.uint8).astype(np.uint32)
    packed = data[:-2] | data[1:-1] << 8 | data[2:] << 16
    return (packed * np.uint32(2654435761)) >> np.uint32(17)


def trigram_counts(df: DataFrame, lang_col="lang", text_col="text") -> DataFrame:
    """(lang, bucket, n) over all documents with a language; every task adds up its own documents first."""
    schema = pa.schema([("lang", pa.string()), ("bucket", pa.int32()), ("n", pa.int64())])

    def run(batches):
        counts = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if lang not in counts:
                    counts[lang] = np.zeros(BUCKETS, np.int64)
                counts[lang] += np.bincount(trigrams(text), minlength=BUCKETS)
        for lang, n in counts.items():
            bucket = np.nonzero(n)[0]
            yield batch_of(schema, [[lang] * len(bucket), bucket.astype(np.int32), n[bucket]])

    known = df.filter(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return known.mapInArrow(run, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, lang_col="lang", text_col="text"):
    """(languages, likelihoods): sorted languages and P(bucket | language), one row of ``BUCKETS`` numbers per language, which bounds what is collected."""
    rows = (trigram_counts(df, lang_col, text_col).groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n")).orderBy("lang").collect())
    counts = np.zeros((len(rows), BUCKETS))
    for at, row in enumerate(rows):
        counts[at, row["bucket"]] = row["n"]
    counts += SMOOTHING
    return [row["lang"] for row in rows], counts / counts.sum(axis=1, keepdims=True)


def fit(likelihood, count, members):
    """(proportions, log likelihood) of a mixture of the member languages by expectation-maximisation."""
    part, total = likelihood[:, members], count.sum()
    share = np.full(len(members), 1 / len(members))
    for _ in range(ITERATIONS if len(members) > 1 else 0):
        joint = part * share
        new = (count / joint.sum(axis=1)) @ joint / total
        moved = np.abs(new - share).max()
        share = new
        if moved < TOLERANCE:
            break
    return share, float(count @ np.log(part @ share))


def infer(likelihood, hashed, penalty=PENALTY):
    """(selected languages, their proportions, proportions of all): indices by falling proportion."""
    count = np.bincount(hashed, minlength=BUCKETS)
    seen = np.nonzero(count)[0]
    count, likelihood = count[seen].astype(float), likelihood[:, seen].T
    share, _ = fit(likelihood, count, list(range(likelihood.shape[1])))
    order = np.argsort(-share, kind="stable").tolist()
    chosen = order[:1]
    kept, best = fit(likelihood, count, chosen)
    for more in order[1:]:
        grown, gain = fit(likelihood, count, chosen + [more])
        if gain - best <= penalty * 0.5 * np.log(count.sum()):
            break
        chosen, kept, best = chosen + [more], grown, gain
    return chosen, kept, share


def predict(df: DataFrame, model, id_col="doc_id", text_col="text", penalty=PENALTY, keep=()) -> DataFrame:
    """(id, lang_pred, score, langs, proportions) and, as they are, the columns named in ``keep``.

    ``lang_pred`` is the main language of the selected mixture, ``score`` its share among all languages.
    """
    languages, likelihood = model
    found = [("lang_pred", pa.string()), ("score", pa.float64()), ("langs", pa.list_(pa.string())), ("proportions", pa.list_(pa.float64()))]

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                if not text or not languages or not any(map(str.isalpha, text)):
                    rows.append((UNDETERMINED, 0.0, [], []))
                    continue
                chosen, kept, share = infer(likelihood, trigrams(text), penalty)
                first = int(np.argmax(kept))
                rows.append((languages[chosen[first]], float(min(1.0, share[chosen[first]])), [languages[k] for k in chosen], kept.tolist()))
            carried = [0, *range(2, batch.num_columns)]
            schema = pa.schema([pa.field(names[k], batch.schema.field(k).type) for k in carried] + found)
            yield batch_of(schema, [*map(batch.column, carried), *(zip(*rows) if rows else [[]] * len(found))])

    names = [id_col, text_col, *keep]
    inputs = df.select(F.col(id_col).cast("long"), F.col(text_col), *[F.col(c) for c in keep])
    schema = T.StructType([T.StructField(n, f.dataType) for k, (n, f) in enumerate(zip(names, inputs.schema)) if k != 1] +
                          [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("langs", T.ArrayType(T.StringType())), T.StructField("proportions", T.ArrayType(T.DoubleType()))])
    return inputs.toDF(*[f"c{k}" for k in range(len(names))]).mapInArrow(run, schema)


def fold(id_col="doc_id"):
    """Remainder that splits documents: 0 is held out."""
    return F.pmod(F.crc32(F.encode(F.col(id_col).cast("string"), "UTF-8")), F.lit(5))
