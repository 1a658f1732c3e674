"""op1, op3 and op7: near-duplicates, repeated passages and close vectors."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import passages, simhash, vectors
from subsetlab.llm.common import table


def op1_simhash_near_dedup(spark, sf_dir) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, radius=3)
    fingerprint = F.lower(F.array_join(F.transform(F.sequence(F.lit(8), F.lit(1), F.lit(-1)), lambda at: F.hex(F.substring("fp", at, 1))), ""))   # most significant byte first
    return groups.select("doc_id", fingerprint.alias("fingerprint"), "component_id")


def op3_suffix_array_dedup(spark, sf_dir) -> DataFrame:
    kept = passages.remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"])
    return kept.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_embedding_near_dedup(spark, sf_dir) -> DataFrame:
    near = vectors.near_vectors(table(spark, sf_dir, "embeddings"))
    return near.select("vec_id", "n_links", "component_id", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)).alias("kept"))


QUERIES = {"op1_simhash_near_dedup": op1_simhash_near_dedup, "op3_suffix_array_dedup": op3_suffix_array_dedup, "op7_embedding_near_dedup": op7_embedding_near_dedup}
ORACLE = {}
