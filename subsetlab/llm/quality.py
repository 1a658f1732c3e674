"""Quality rules with risk-controlled thresholds.

Rules compare a number of a document with a cutoff. Cutoffs come in levels, from lenient to strict: at a level every rule's cutoff is the
quantile of good documents that it may reject. Labelled documents are split by a hash of the id: one half proposes cutoffs per stratum and
keeps the rules that hit bad documents more often than good ones, the other half is the holdout. On the holdout a level is accepted if an
exact binomial test rejects "more than ``max_rejected`` of the good documents are rejected"; levels are tested in fixed order and testing
stops at the first that fails, the error rate is divided by the number of strata. So with probability 1 - ``error``, in every stratum at once,
the chosen cutoffs reject no more than ``max_rejected`` of good documents. A stratum with too few labels has no cutoffs.

Defined results: a null or empty text has no words and fails the base rule; a null stratum is a stratum of its own; a document that is
labelled twice has its worst label; repeated rows are judged row by row; an empty table gives an empty table; other columns are ignored.
What is gathered are counts per stratum, level and rule; cutoffs are a table that Spark joins by its size.
"""
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsetlab.llm.common import batch_of
from subsetlab.session import cut_lineage

MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50
LEVELS = (0.0005, 0.001, 0.002, 0.005, 0.01, 0.02)   # share of good documents that each rule may reject
MAX_REJECTED = 0.02
ERROR = 0.05
LIFT = 2.0
ACCURACY = 10_000        # of the proposed quantiles; the holdout certifies whatever is proposed

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
RULES = {   # larger is worse
    "symbols": "n_symbols / greatest(word_chars, 1)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeats": "n_repeat_words / greatest(n_words, 1)",
    "long_words": "word_chars / greatest(n_words, 1)",
    "short_words": "- word_chars / greatest(n_words, 1)",
    "few_words": "- CAST(n_words AS DOUBLE)",
}
SYMBOLS = "#*$%&|<>"


def counts_of(text: str):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and lines with a word of one text."""
    words = text.encode("utf-8", "replace").split()   # of bytes: ASCII white space alone
    chars = sum(map(text.count, " \t\n\x0b\f\r"))
    lines = text.split("\n")
    filled = lines if len(words) and not any(map(str.isspace, lines)) and "" not in lines else [x for x in lines if x.strip(" \t\x0b\f\r")]
    n = len(words)
    repeated = 0
    if n >= 3:
        number = {}
        ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
        many = len(number)
        pairs = ids[:-1] * many + ids[1:]
        if many > 2_000_000:
            pairs = np.unique(pairs, return_inverse=True)[1]
        _, where, count = np.unique(pairs[:-1] * many + ids[2:], return_inverse=True, return_counts=True)
        twice = count[where] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k:n - 2 + k] |= twice
        repeated = int(hit.sum())
    return n, len(text) - chars, sum(map(text.count, SYMBOLS)), len(filled) - len(set(filled)), repeated, len(filled)


def features(df: DataFrame, stratum_col="lang", id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, stratum, the counts, n_lines) of every row."""
    names = [*COUNTS, "n_lines"]
    schema = pa.schema([("doc_id", pa.int64()), ("stratum", pa.string()), *((name, pa.int64()) for name in names)])

    def run(batches):
        for batch in batches:
            found = [counts_of(text) for text in batch.column(2).to_pylist()]
            yield batch_of(schema, [batch.column(0), batch.column(1), *(zip(*found) if found else [[]] * len(names))])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(stratum_col).cast("string"), F.lit("")).alias("stratum"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, "doc_id bigint, stratum string, " + ", ".join(f"{name} bigint" for name in names))


def base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))


def rule_values():
    return F.array(*[F.expr(f"CAST({rule} AS DOUBLE)") for rule in RULES.values()])


@F.pandas_udf(T.DoubleType())
def at_most(hits: pd.Series, trials: pd.Series, rate: pd.Series) -> pd.Series:
    """Exact probability of at most ``hits`` successes in ``trials`` at a success rate."""
    out = []
    for k, n, p in zip(hits, trials, rate):
        i = np.arange(int(k) + 1)
        steps = np.log((n - i[1:] + 1) / i[1:]) if k else np.empty(0)
        terms = np.concatenate([[0.0], np.cumsum(steps)]) + i * math.log(p) + (n - i) * math.log1p(-p)
        top = terms.max()
        out.append(min(1.0, math.exp(top) * float(np.exp(terms - top).sum())))
    return pd.Series(out)


def choose_cutoffs(rows: DataFrame, labels: DataFrame, levels=LEVELS, max_rejected=MAX_REJECTED, error=ERROR, lift=LIFT) -> DataFrame:
    """(stratum, cutoffs array<double>, level, tested, rejected, p_value): certified cutoffs in the order of ``RULES``; infinite where a rule is off."""
    labelled = labels.groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("quality"))
    known = cut_lineage(rows.filter(~base_failed()).join(labelled.filter("quality is not null"), F.col("doc_id") == F.col("label_id"))
                        .select("stratum", F.pmod(F.xxhash64("doc_id", F.lit("holdout")), F.lit(2)).alias("half"), (F.col("quality") > 0).alias("good"), rule_values().alias("v")))
    rule_numbers, shares = range(len(RULES)), [1 - x for x in levels]
    quantiles = [F.percentile_approx(F.get("v", F.lit(r)), shares, ACCURACY) for r in rule_numbers]
    proposed = known.filter("half = 0 and good").groupBy("stratum").agg(F.array(*quantiles).alias("q"))
    by_level = proposed.select("stratum", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(len(levels) - 1)), lambda at: F.transform("q", lambda of_rule: F.get(of_rule, at)))).alias("level", "cut"))
    above = F.zip_with("v", "cut", lambda v, c: v > c)
    hits = [F.sum((F.get("above", F.lit(r)) & which).cast("long")) for which in (F.col("good"), ~F.col("good")) for r in rule_numbers]
    n = len(RULES)
    rates = (known.filter("half = 0").join(by_level, "stratum").withColumn("above", above).groupBy("stratum", "level", "cut")
             .agg(F.array(*hits).alias("h"), F.sum(F.col("good").cast("long")).alias("n_good"), F.sum((~F.col("good")).cast("long")).alias("n_bad")))
    useful = [(F.get("h", F.lit(n + r)) > 0) & (F.get("h", F.lit(n + r)) * F.col("n_good") > lift * F.get("h", F.lit(r)) * F.col("n_bad")) for r in rule_numbers]
    active = rates.select("stratum", "level", F.array(*[F.when(useful[r], F.get("cut", F.lit(r))).otherwise(F.lit(float("inf"))) for r in rule_numbers]).alias("cut"))
    strata = proposed.agg(F.count(F.lit(1)).alias("strata"))   # one row
    rejected = F.exists(F.zip_with("v", "cut", lambda v, c: v > c), lambda x: x)
    tested = (known.filter("half = 1 and good").join(active, "stratum").groupBy("stratum", "level", "cut")
              .agg(F.count(F.lit(1)).alias("tested"), F.sum(rejected.cast("long")).alias("rejected")).join(F.broadcast(strata))
              .withColumn("p_value", at_most("rejected", "tested", F.lit(float(max_rejected)))).withColumn("passes", F.col("p_value") <= error / F.col("strata")))
    in_order = Window.partitionBy("stratum").orderBy("level").rowsBetween(Window.unboundedPreceding, 0)
    accepted = tested.withColumn("all_pass", F.min("passes").over(in_order)).filter("all_pass")
    best = accepted.groupBy("stratum").agg(F.max_by(F.struct("cut", "level", "tested", "rejected", "p_value"), "level").alias("best"))
    return best.select("stratum", F.col("best.cut").alias("cutoffs"), F.get(F.array(*map(F.lit, levels)), F.col("best.level")).alias("level"), "best.tested", "best.rejected", "best.p_value")


def judge(rows: DataFrame, cutoffs: DataFrame) -> DataFrame:
    """Rows with ``base_failed`` and ``kept``: false if the base rule fails or a rule's value is above its stratum's cutoff."""
    chosen = cutoffs.select("stratum", "cutoffs")
    over = F.exists(F.zip_with(rule_values(), "cutoffs", lambda v, c: v > c), lambda x: x)
    return rows.join(chosen, "stratum", "left").withColumn("base_failed", base_failed()).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(over, F.lit(False))).drop("cutoffs")
