"""Rows with a common key meet in units of bounded size: large keys are split, and every two parts meet in a unit of their own."""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.common import partitions
from subsetlab.session import cut_lineage

BUFFER_ROWS = 20_000     # rows of whole units that a task works on at once
BROADCAST_KEYS = 50_000  # large keys that are broadcast, under 2 MB


def deal(rows: DataFrame, *carried, shard: int) -> DataFrame:
    """Rows (key, node, carried..) dealt to units (key, i, j) and sorted by them; ``part`` is i or j.

    A key of at most ``shard`` rows is one unit. Sizes are counted with map-side sums; a larger key has a part per ``shard`` rows, to which a
    hash of the node deals them, so no unit has many more than twice ``shard`` rows. The table of large keys is broadcast if it is counted
    to be short, else joined by a shuffle of its own, which can be split at a large key. ``rows`` is read twice and should be cheap to redo.
    """
    large = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard)
    large = cut_lineage(large.select("key", F.ceil(F.col("n") / shard).cast("int").alias("parts")))
    n_large = large.count()
    if n_large:
        sized = rows.join(F.broadcast(large) if n_large <= BROADCAST_KEYS else large, "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    else:
        sized = rows.withColumn("parts", F.lit(1))
    parts = sized.withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda other: F.struct(F.least("part", other).alias("i"), F.greatest("part", other).alias("j")))
    units = parts.select("key", "node", "part", *carried, F.inline(F.array_distinct(meets)))
    return (units.repartition(partitions(rows.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j", "node")
            .select("key", "i", "j", "part", "node", *carried))


def whole_units(batches, rows=BUFFER_ROWS):
    """Tables of one or more whole units, of about ``rows`` rows, from record batches that are sorted by unit."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count >= rows:
            table = pa.Table.from_batches(held).combine_chunks()
            last = int(np.nonzero(starts_of(table))[0][-1])   # the last unit may go on
            if last:
                yield table.slice(0, last).combine_chunks()
            held, count = table.slice(last).to_batches(), table.num_rows - last
    if count:
        yield pa.Table.from_batches(held).combine_chunks()


def starts_of(table) -> np.ndarray:
    """True at the first row of each unit."""
    out = np.ones(table.num_rows, bool)
    columns = [table.column(name).to_numpy() for name in ("key", "i", "j")]
    out[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return out


def unit_numbers(table) -> np.ndarray:
    """Number of each row's unit, from 0."""
    return np.cumsum(starts_of(table)) - 1
