"""op13: periodic runs of words in all documents."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm import periods
from subsetlab.llm.common import table

WORD_GAP = r"[\x20\x09-\x0D]+"


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by the hash of its id, repeats a stretch of its own words to its end; without an id none does."""
    words = F.filter(F.split("text", WORD_GAP), lambda w: w != "")
    seed = F.floor(F.col("h") / 10)
    hashed = docs.select("doc_id", "text", F.crc32(F.col("doc_id").cast("string").cast("binary")).alias("h"))
    split = hashed.select("doc_id", "text", "h", F.when(F.col("h") % 10 == 0, words).alias("words"))
    n = F.size("words")
    placed = split.select("doc_id", "text", "words", (seed % n).alias("a"), (seed % 8).alias("r"), n.alias("n"))
    placed = placed.select("doc_id", "text", "words", "n", "a", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("r")))).alias("p"))
    planted = F.transform("words", lambda w, i: F.when(i < F.col("a"), w).otherwise(F.get(F.col("words"), (F.col("a") + (i - F.col("a")) % F.col("p")).cast("int"))))
    return placed.select("doc_id", F.when(F.col("n") > 0, F.array_join(planted, " ")).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark, sf_dir) -> DataFrame:
    found = periods.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents").select("doc_id", "text")))

    def better(best, run):
        """The greater length per period, compared without division; ties stay with the earlier run."""
        return F.when(best.isNull() | (run["length"] * best["period"] > best["length"] * run["period"]), run).otherwise(best)

    first = F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>")
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return (found.withColumn("best", F.aggregate("runs", first, better))
            .select("doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
                    F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
                    F.sha2(F.encode(lines, "UTF-8"), 256).alias("runs_sha256"), F.sha2(F.encode(F.col("collapsed"), "UTF-8"), 256).alias("collapsed_sha256")))


QUERIES = {"op13_periodic_runs": op13_periodic_runs}
ORACLE = {}
