"""Corpus pipeline: language ID, line dedup, near-dedup, sanitising and packing over the documents table.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next stage's documents. All stages but the last
return the columns of documents.
"""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import langid, lines, packing, pii, simhash
from subsetlab.llm.common import content_key, table, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: A document stays if its main language has this share of it; texts without a letter go.
MIN_LANGUAGE_SHARE = 0.5

#: Near-duplicates: five-word shingles at a similarity of 0.8, candidates by 512-bit fingerprints. At 0.8 these differ in 77.6 bits on average,
#: with a standard deviation of 8 (96 and 9 for the shortest texts, of five and four shingles); the radius leaves slack for both.
SHINGLE_WORDS, FINGERPRINT_WORDS, RADIUS = 5, 8, 120


def language_id(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Keep documents with a recognised main language, which becomes ``lang``."""
    model = langid.learn(docs)
    predicted = langid.predict(docs, model, keep=("text", "source", "n_chars"))
    kept = predicted.filter((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.select("doc_id", "text", F.col("lang_pred").alias("lang"), "source", "n_chars")


def line_dedup(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Drop lines that many documents hold; the text is what is left."""
    kept = lines.keep_lines(docs.select(*COLUMNS))
    return kept.select("doc_id", F.col("kept_text").alias("text"), "lang", "source", F.length("kept_text").cast("long").alias("n_chars"))


def near_dedup(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id, without an id the last; rows that repeat id and text become one.

    Rows that share an id, or have none, are told apart by a hash of the text.
    """
    groups = simhash.similar_documents(docs, SHINGLE_WORDS, RADIUS, FINGERPRINT_WORDS)
    first = groups.filter("kept").select(F.col("doc_id").alias("first_id"), F.col("content").alias("first_content")).distinct()
    keyed = docs.select(*COLUMNS, content_key(F.col("text")).alias("content"))
    kept = keyed.join(first.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("content") == F.col("first_content")), "left_semi")
    one = kept.groupBy("doc_id", "content").agg(F.min(F.struct("lang", "source", "n_chars", "text")).alias("row"))
    return one.select("doc_id", "row.text", "row.lang", "row.source", "row.n_chars")


def sanitise(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Replace personal data and terms that give it away."""
    clean = pii.sanitise(docs.select(*COLUMNS))
    return clean.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def best_fit_packing(spark, docs: DataFrame, sf_dir) -> DataFrame:
    """Training sequences of the documents that are left."""
    import public_tokenizers
    pieces = packing.document_pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return packing.pack(pieces)


STAGES = [("language_id", language_id), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("sanitise", sanitise), ("best_fit_packing", best_fit_packing)]

#: SQL cannot state the stages; tests hold each against a plain version of itself.
ORACLE_SQL = None


def run(spark, sf_dir) -> DataFrame:
    """The stages applied to the documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
