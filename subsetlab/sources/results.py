"""Result tables in blocks: partitioned Parquet rows with a manifest, checks over the manifest, pruned scans.

A table lies in one folder: ``rows`` (partitioned by the table's own keys and the block) and ``manifest`` (one row per partition and
block). A block holds the rows of some populations and may be written again; it then replaces itself. Whether blocks fit together and
families cover the same populations is decided from the manifest, so a check reads as many rows as there are partitions.
"""
from pyspark.sql import DataFrame, Window, functions as F

from ..session import partitions

RESULT_KEYS = ("window", "family")
DRAW_KEYS = ("window", "baseline")
SAME = ("metadata", "methods", "subsets", "splits")   # what all blocks of a partition must have in common


def write_block(df: DataFrame, path: str, block: str, keys=RESULT_KEYS, position: str = "population", metadata: dict = None) -> None:
    """Write the rows of one block, and their manifest.

    Rows are cut into ranges of (keys, position): a large partition becomes several files, and files hold few positions, so that a filter
    on positions skips row groups. ``metadata`` are the settings the rows were made with (seeds, sizes, run names).
    """
    columns = [c for c in df.columns if c not in keys]
    rows = df.select(*columns, *keys, F.lit(block).alias("block")).repartitionByRange(partitions(df), *keys, position).sortWithinPartitions(*keys, position)
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys, "block").parquet(f"{path}/rows")
    written = _rows(df.sparkSession, path, df, keys).where(F.col("block") == block)
    described = _described(written, keys, position).withColumn("metadata", F.lit(str(sorted((metadata or {}).items()))))
    described.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("block").parquet(f"{path}/manifest")


def _rows(spark, path, like: DataFrame, keys) -> DataFrame:
    types = dict(like.dtypes)
    listed = [c for c in like.columns if c not in keys]
    schema = ", ".join(f"`{c}` {types[c]}" for c in [*listed, *keys])
    return spark.read.schema(f"{schema}, block string").parquet(f"{path}/rows")


def _described(rows: DataFrame, keys, position: str) -> DataFrame:
    """Manifest rows: positions, first and last, row count, and which methods, subsets and splits there are, as sorted lists of distinct values.

    ``pairs`` and ``pair_hash`` identify the set of (position, split) pairs: equal sets have equal values, whatever the order.
    """
    have = [c for c in ("method", "subset", "split") if c in rows.columns]
    listed = {c: F.array_sort(F.collect_set(F.col(c).cast("string"))) if c in have else F.array().cast("array<string>") for c in ("method", "subset", "split")}
    whole = rows.groupBy(*keys, "block").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct(position).alias("positions"), F.min(position).cast("long").alias("first"), F.max(position).cast("long").alias("last"),
        listed["method"].alias("methods"), listed["subset"].alias("subsets"), listed["split"].alias("splits"))
    at = [position, *[c for c in ("split",) if c in have]]
    pairs = rows.groupBy(*keys, "block", *at).agg(F.count(F.lit(1)).alias("_n"))
    spread = pairs.groupBy(*keys, "block").agg(F.count(F.lit(1)).alias("pairs"), F.sum(F.xxhash64(*at).cast("decimal(38,0)")).alias("pair_hash"))
    return whole.join(spread, [*keys, "block"])


def manifest(spark, path: str) -> DataFrame:
    """Manifest of a stored table."""
    return spark.read.parquet(f"{path}/manifest").withColumn("block", F.col("block").cast("string"))


def block_problems(listed: DataFrame, keys=RESULT_KEYS) -> DataFrame:
    """(keys, block, problem) of blocks that cannot be joined.

    Blocks of a partition are taken by their first position. Each must have the settings, methods, subsets and splits of the first one, and
    start behind the last position of all blocks before it. The windows run over blocks.
    """
    order = Window.partitionBy(*keys).orderBy("first", "block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    differing = {f"{c} differ from the first block": F.col(c) != F.first(c).over(order) for c in SAME}
    checks = {**differing, "positions overlap or are out of order": F.col("first") <= F.max("last").over(before)}
    found = F.array_compact(F.array(*[F.when(failed, F.lit(name)) for name, failed in checks.items()]))
    return listed.select(*keys, "block", found.alias("_found")).select(*keys, "block", F.explode("_found").alias("problem"))


def alignment_problems(listed: DataFrame, keys=RESULT_KEYS) -> DataFrame:
    """(window, family, positions, pairs) of families whose (position, split) pairs are not those of the window's first family.

    Pair sets are compared by count and sum of hashes over disjoint blocks; ``audits.misaligned`` lists the pairs themselves.
    """
    window, family = keys
    each = listed.groupBy(*keys).agg(F.sum("positions").alias("positions"), F.sum("pairs").alias("pairs"), F.sum("pair_hash").alias("_hash"))
    first = Window.partitionBy(window).orderBy(family)
    same = (F.col("pairs") == F.first("pairs").over(first)) & (F.col("_hash") == F.first("_hash").over(first))
    return each.withColumn("_same", same).where(~F.col("_same")).select(*keys, "positions", "pairs")


def scan_results(spark, path: str, columns=None, keys=RESULT_KEYS, aligned: bool = True, **wanted) -> DataFrame:
    """Rows of a stored table with the given key values (a value or several per key), after the checks of the wanted partitions.

    Key values become partition filters and ``columns`` the read schema. Blocks that do not fit together or families that cover different
    pairs stop the scan before any row is read; the driver sees one such partition.
    """
    listed, rows = manifest(spark, path), spark.read.parquet(f"{path}/rows")
    for key, values in wanted.items():
        values = values if isinstance(values, (list, tuple)) else [values]
        listed, rows = listed.where(F.col(key).isin(*values)), rows.where(F.col(key).isin(*values))
    problem = block_problems(listed, keys).first() or (alignment_problems(listed, keys).first() if aligned else None)
    if problem:
        raise ValueError(f"stored results do not fit together: {problem.asDict()}")
    return rows.drop("block") if columns is None else rows.select(*keys, *columns)
