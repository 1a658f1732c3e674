"""Sinks, unions and audits of stored tables."""
from functools import reduce

from pyspark.sql import DataFrame, functions as F

DEFAULT_TRAJECTORIES = 500


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, missing values empty."""
    nan_free = df.select(*[F.when(F.isnan(c), None).otherwise(F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])
    nan_free.write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def write_records(steps: DataFrame, path: str, file_format: str = "parquet") -> None:
    """Unified records partitioned by dataset and run."""
    steps.write.partitionBy("dataset", "run").format(file_format).save(path)


def union_formats(parts) -> DataFrame:
    """Union of the per-format step tables; columns a format lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def union_blocks(blocks, keys) -> DataFrame:
    """Union of result blocks that must not overlap: a row that occurs twice stops the job when it is read."""
    table = reduce(lambda a, b: a.unionByName(b), blocks)
    repeated = table.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select(*keys)
    marked = table.join(repeated.withColumn("_twice", F.lit(True)), list(keys), "left")
    first = keys[0]
    return marked.withColumn(first, F.when(F.col("_twice").isNull(), F.col(first)).otherwise(F.raise_error(F.concat(F.lit("block overlap at "), F.col(first).cast("string"))))).drop("_twice")


def misaligned(tables: DataFrame, keys=("position", "split")) -> DataFrame:
    """Result families of a window that do not cover the same (position, split) pairs as the others: family, window, missing pairs."""
    pairs = tables.select("family", "window", *keys).distinct()
    families = pairs.select("family", "window").distinct()
    every = pairs.select("window", *keys).distinct()
    wanted = every.join(families, "window")
    return wanted.join(pairs, ["family", "window", *keys], "left_anti").groupBy("family", "window").agg(F.count(F.lit(1)).alias("missing"))


def md5_audit(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Stored files (name, content) against a manifest (name, md5): missing, differing or extra."""
    have = files.select("name", F.md5("content").alias("_have"))
    joined = manifest.select("name", F.col("md5").alias("_want")).join(have, "name", "full")
    state = F.when(F.col("_have").isNull(), "missing").when(F.col("_want").isNull(), "extra").when(F.col("_have") != F.col("_want"), "differs")
    return joined.select("name", state.alias("state")).where(F.col("state").isNotNull())


def completeness(trajectories: DataFrame, expected: DataFrame = None, default: int = DEFAULT_TRAJECTORIES) -> DataFrame:
    """Trajectories per run against the expected number (``expected``: run, wanted; other runs use the default)."""
    found = trajectories.groupBy("run").agg(F.count(F.lit(1)).alias("found"))
    joined = found.withColumn("wanted", F.lit(None).cast("long")) if expected is None else found.join(expected, "run", "full")
    return joined.select("run", F.coalesce("found", F.lit(0)).alias("found"), F.coalesce("wanted", F.lit(default)).alias("wanted")).withColumn("complete", F.col("found") == F.col("wanted"))


def run_dimension(spark, definitions: dict) -> DataFrame:
    """runs(dataset, run, ordinal, parser, rules) from a caller's definitions.

    A definition has ``runs`` (names in order) or ``run_groups`` (sizes, expanded to ``<N>_runs/run_<i>``), ``parser``, ``rules`` and
    optional per-run overrides ``run_parsers`` / ``run_rules``.
    """
    rows = []
    for dataset, d in definitions.items():
        rows.append((dataset, list(d.get("runs", ())), list(d.get("run_groups", ())), d["parser"], d["rules"], d.get("run_parsers", {}), d.get("run_rules", {})))
    table = spark.createDataFrame(rows, "dataset string, runs array<string>, groups array<int>, parser string, rules string, run_parsers map<string,string>, run_rules map<string,string>")
    grouped = F.flatten(F.transform("groups", lambda n: F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(n.cast("string"), F.lit("_runs/run_"), i.cast("string")))))
    exploded = table.withColumn("_all", F.concat("runs", grouped)).select("*", F.posexplode("_all").alias("ordinal", "run"))
    return exploded.select("dataset", "run", "ordinal", F.coalesce(F.try_element_at("run_parsers", F.col("run")), F.col("parser")).alias("parser"),
                           F.coalesce(F.try_element_at("run_rules", F.col("run")), F.col("rules")).alias("rules"))


def extract_methods(table: DataFrame, methods, columns=("rmse", "maxerr", "maxerr_mean", "p95")) -> DataFrame:
    """Per-population values of chosen methods by window (pruned by partition and column)."""
    return table.where(F.col("method").isin(*methods)).select("population", "window", "subset", "method", *columns)


def lookup(table: DataFrame, **equal) -> DataFrame:
    """Rows of a result table with the given window, subset, method ... values."""
    for column, value in equal.items():
        table = table.where(F.col(column) == value)
    return table
