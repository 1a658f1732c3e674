"""Exact ranks, running totals and quantiles that never need one whole group inside one task.

A plain ``row_number`` window sends every row of a group to one task. ``ordered`` cuts the rows into ranges of (group, order) by sampled
cuts instead, sorts every range, and takes a row's place in its range; counts per (group, range) give the offsets. Ranges are about
equally long whatever the values are, since ties are cut by the tie columns. Where a bucket that is monotone in the order is at hand, as for
hash keys, ``bucketed_rank`` ranks per bucket. The result is the exact rank in both cases.
"""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import partitions, settled

BUCKETS = 64


def hash_key(*parts) -> Column:
    """Reproducible uniform draw key: md5 over the given parts (literals or columns) joined by '|'.

    It depends on the values alone, so a draw does not change with the partitioning, and the same key is available in SQL.
    """
    columns = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.md5(F.concat_ws("|", *[c.cast("string") for c in columns]))


def hash_bucket(key: Column) -> Column:
    """Order-preserving bucket of an md5 key: its first two digits (256 buckets of about equal size)."""
    return F.substring(key, 1, 2)


def with_value_bucket(df: DataFrame, keys, value: str, buckets: int = BUCKETS) -> DataFrame:
    """Add ``_bucket``, a monotone equal-width bucket of a numeric column within each group (nulls first)."""
    bounds = df.groupBy(*keys).agg(F.min(value).cast("double").alias("_low"), F.max(value).cast("double").alias("_high"))
    joined = _attach(df, bounds, keys)
    width = F.col("_high") - F.col("_low")
    place = F.when(width > 0, F.floor((F.col(value).cast("double") - F.col("_low")) / width * buckets)).otherwise(F.lit(0))
    return (joined.withColumn("_bucket", F.coalesce(F.least(place, F.lit(buckets - 1)), F.lit(-1)).cast("int"))
            .drop("_low", "_high"))


def _attach(df: DataFrame, small: DataFrame, keys) -> DataFrame:
    """Join per-group values back; without keys the one-row side is attached through a constant key."""
    if keys:
        return df.join(small, list(keys))
    return (df.withColumn("_one", F.lit(1)).join(F.broadcast(small.withColumn("_one", F.lit(1))), "_one").drop("_one"))


def bucketed_rank(df: DataFrame, keys, bucket: str, order, name: str = "rank") -> DataFrame:
    """Exact 1-based rank within ``keys`` by (bucket, order); ``bucket`` must be monotone in the order."""
    keys = list(keys)
    counts = df.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_rows"))
    before = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*keys, bucket, F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"))
    local = Window.partitionBy(*keys, bucket).orderBy(*order)
    return (df.join(offsets, keys + [bucket])
            .withColumn(name, F.col("_offset") + F.row_number().over(local)).drop("_offset"))


def rank_by_hash(df: DataFrame, keys, key: str, tie: str, name: str = "rank") -> DataFrame:
    """Exact rank by an md5 key inside groups of any size."""
    bucketed = df.withColumn("_bucket", hash_bucket(F.col(key)))
    return bucketed_rank(bucketed, keys, "_bucket", [F.col(key), F.col(tie)], name).drop("_bucket")


def in_ranges(df: DataFrame, keys, order, ranges: int = None) -> DataFrame:
    """The rows, written once in ranges of (keys, order), with ``_range`` and ``_place``, which grows in that order."""
    cut = df.repartitionByRange(ranges or partitions(df), *keys, *order).sortWithinPartitions(*keys, *order)
    return settled(cut.withColumn("_range", F.spark_partition_id()).withColumn("_place", F.monotonically_increasing_id()))


def ordered(df: DataFrame, keys, order, rank: str = None, value: str = None, total: str = None, ranges: int = None) -> DataFrame:
    """Rows with their exact 1-based ``rank`` and the inclusive running ``total`` of ``value`` within ``keys``, in an order without ties.

    Only counts and sums per (keys, range) are joined back to the ranges.
    """
    keys = list(keys)
    placed = in_ranges(df, keys, order, ranges)
    counts = placed.groupBy(*keys, "_range").agg(F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first"), *([F.sum(value).alias("_sum")] if total else []))
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)   # at most a row per range and group
    upto = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    offsets = counts.select(*keys, "_range", "_first", upto("_rows").alias("_offset"), *[upto("_sum").alias("_before")] * bool(total))
    out = placed.join(offsets, [*keys, "_range"])
    if rank:
        out = out.withColumn(rank, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
    if total:
        local = Window.partitionBy(*keys, "_range").orderBy("_place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        out = out.withColumn(total, F.col("_before") + F.sum(value).over(local)).drop("_before")
    return out.drop("_range", "_place", "_first", "_offset")


def rank_by_value(df: DataFrame, keys, value: str, ties, descending=False, name: str = "rank") -> DataFrame:
    """Exact rank by a numeric column (ties in the given column order) inside groups of any size."""
    keyed = df.withColumn("_order", (-F.col(value) if descending else F.col(value)).cast("double"))
    return ordered(keyed, keys, [F.col("_order"), *[F.col(t) for t in ties]], rank=name).drop("_order")


def running_total(df: DataFrame, keys, order: str, ties, value: str, name: str) -> DataFrame:
    """Inclusive running sum of ``value`` in ascending ``order`` (ties in the given column order) inside groups of any size."""
    return ordered(df, keys, [F.col(order), *[F.col(t) for t in ties]], value=value, total=name)


def group_quantiles(df: DataFrame, keys, value: str, shares, prefix: str = "p") -> DataFrame:
    """Exact linearly interpolated quantiles per group, one column per share; equal values are counted before they meet."""
    keys = list(keys)
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    quantiles = counted.groupBy(*keys).agg(F.percentile(value, [float(s) for s in shares], F.col("_n")).alias("_q"))
    return quantiles.select(*keys, *[F.get("_q", F.lit(i)).alias(f"{prefix}{share * 100:g}".replace(".", "_")) for i, share in enumerate(shares)])
