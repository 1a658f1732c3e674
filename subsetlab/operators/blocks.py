"""Distance work between all rows of a group without a pair table.

A group is cut into blocks of about ``BLOCK_ROWS`` rows, so a large group becomes many blocks. Blocks meet blocks in the cells of a grid
over (group, left blocks, right blocks): a cell is a join key of its own, so that the pairs of one large group are spread over as many tasks as
it has cells. A block is copied once per cell of its row or column; cells therefore grow with the group, so that the grid has at most ``GRID``
rows and columns until a cell's side holds ``CELL_VALUES`` numbers. A task sees two blocks at a time and hands back one partial value per row,
never a pair. Partial values are then added up with an ordinary grouped aggregate. Tables with a row per group are settled, so that the planner knows how
small they are and does not shuffle the vectors to join them.
"""
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from ..session import cut_lineage, partitions, settled

BLOCK_ROWS = 256
PAIRED = 4       # times as many rows in blocks that meet in pairs: each pair goes to Python as a row with both blocks
CELL_BLOCKS = 8  # at least, on each side of a cell
GRID = 8         # cells on each side of a group's grid, unless they would be larger than:
CELL_VALUES = 1 << 21
HELD = 1 << 20   # counts that a task holds before it hands them on
CELL_ROWS = 2048
ROW_GRID = 4     # as GRID, for the sweeps over rows
SWEPT_ROWS = 256 # left rows of a cell that are measured at a time
MAX_PIVOTS = 64  # per group
CLOSE = 1e-2     # squared distances below this share of the squared lengths are not taken from a product
MEASURED = 4096  # such pairs that are measured at a time
BIN_SHIFT = 36   # distances are binned by exponent and 16 mantissa bits


def to_blocks(rows: DataFrame, keys, extras=(), block_rows: int = None, split: str = None) -> DataFrame:
    """One row per block: ``ids``, ``flat`` (all vectors after each other) and one array per extra numeric column.

    With ``split``, rows with different values of that column never share a block, so that blocks of one kind can be picked out.
    """
    parts = [*keys, *([split] if split else [])]
    sizes = rows.groupBy(*parts).agg(F.ceil(F.count(F.lit(1)) / (block_rows or BLOCK_ROWS)).cast("int").alias("_blocks"))
    placed = rows.join(settled(sizes), parts).withColumn("block", F.pmod(F.xxhash64("instance"), F.col("_blocks")).cast("int"))
    return _gathered(placed, keys, parts, ["block"], extras).select(*keys, "block", "ids", "flat", *extras)


def _gathered(placed: DataFrame, keys, parts, place, extras) -> DataFrame:
    """One row per (parts, place) with the rows' ids, vectors and extra columns, in order of the ids."""
    entry = F.struct("instance", "vector", *[F.col(e).cast("double").alias(e) for e in extras])
    gathered = placed.groupBy(*parts, *place).agg(F.array_sort(F.collect_list(entry)).alias("_rows"))
    return gathered.select(*keys, *place, F.col("_rows.instance").alias("ids"), F.flatten("_rows.vector").alias("flat"),
                           *[F.col(f"_rows.{e}").alias(e) for e in extras])


def to_near_blocks(rows: DataFrame, keys, extras=(), block_rows: int = None) -> DataFrame:
    """Blocks of rows that lie together, with ``pivot`` (a vector) and ``reach`` (the largest distance of a row of the block to it).

    A group has a pivot per ``block_rows`` rows, at most ``MAX_PIVOTS``, taken by hash; a row goes to its nearest one. A pivot's rows are cut
    into blocks by hash.
    """
    size = block_rows or BLOCK_ROWS
    counted = rows.groupBy(*keys).agg(F.least(F.lit(MAX_PIVOTS), F.ceil(F.count(F.lit(1)) / size)).cast("int").alias("_pivots"))
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("instance"), "instance")
    first = rows.select(*keys, "instance", "vector").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= MAX_PIVOTS)
    pivots = (first.join(counted, list(keys)).where(F.col("_n") <= F.col("_pivots")).groupBy(*keys)
              .agg(F.array_sort(F.collect_list(F.struct("_n", "vector"))).alias("_p")).select(*keys, F.flatten("_p.vector").alias("_pivots")))
    joined = rows.join(pivots, list(keys))
    schema = StructType([*joined.drop("_pivots").schema.fields, StructField("pivot", ArrayType(DoubleType())), StructField("_far", DoubleType())])

    def nearest(batches):
        for batch in batches:
            pivot, far = [], []
            for vector, flat in zip(batch["vector"], batch["_pivots"]):
                flat = np.asarray(flat).reshape(-1, len(vector))
                d = distances(np.asarray(vector)[None, :], flat)[0]
                pivot.append(flat[d.argmin()]), far.append(d.min())
            yield batch.drop(columns="_pivots").assign(pivot=pivot, _far=far)[schema.fieldNames()]

    placed = cut_lineage(joined.mapInPandas(nearest, schema))
    sizes = placed.groupBy(*keys, "pivot").agg(F.ceil(F.count(F.lit(1)) / size).cast("int").alias("_blocks"))
    parts = placed.join(sizes, [*keys, "pivot"]).withColumn("_part", F.pmod(F.xxhash64("instance"), F.col("_blocks")).cast("int"))
    entry = F.struct("instance", "vector", *[F.col(e).cast("double").alias(e) for e in extras])
    gathered = parts.groupBy(*keys, "pivot", "_part").agg(F.array_sort(F.collect_list(entry)).alias("_rows"), F.max("_far").alias("reach"))
    return gathered.select(*keys, F.xxhash64("pivot", "_part").alias("block"), "pivot", "reach", F.col("_rows.instance").alias("ids"), F.flatten("_rows.vector").alias("flat"),
                           *[F.col(f"_rows.{e}").alias(e) for e in extras])


def matrix(flat, ids) -> np.ndarray:
    """Block vectors as a matrix."""
    return np.asarray(flat, dtype=np.float64).reshape(len(ids), -1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks, one row of ``a`` at a time to keep memory flat."""
    out = np.empty((len(a), len(b)))
    for i, row in enumerate(a):
        out[i] = np.sqrt(np.square(b - row).sum(axis=1))
    return out


def product_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two blocks from one product of matrices, for sums over many pairs.

    A product loses digits where vectors lie close together; pairs that are close against their lengths, or not finite, are measured directly,
    so copies have distance zero.
    """
    lengths = np.square(a).sum(axis=1)[:, None], np.square(b).sum(axis=1)[None, :]
    with np.errstate(invalid="ignore"):
        out = a @ b.T
        out *= -2.0
        out += lengths[0]
        out += lengths[1]
        i, j = np.nonzero(~(out >= CLOSE * (lengths[0] + lengths[1])))
        out[i, j] = 0.0
        np.sqrt(out, out=out)
        for at in range(0, len(i), MEASURED):
            near = slice(at, at + MEASURED)
            out[i[near], j[near]] = np.sqrt(np.square(b[j[near]] - a[i[near]]).sum(axis=1))
    return out


def swept(x: np.ndarray) -> list:
    """The rows of a matrix in parts, so that what is computed of them stays in the processor's cache."""
    return [x[at:at + SWEPT_ROWS] for at in range(0, len(x), SWEPT_ROWS)]


def pair_distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of the rows of two matrices one by one: the same numbers as in ``distances``, whichever side a row is on."""
    return np.concatenate([np.sqrt(np.square(b[at:at + MEASURED] - a[at:at + MEASURED]).sum(axis=1)) for at in range(0, max(len(a), 1), MEASURED)])


def _grid(left: DataFrame, right: DataFrame, keys, side: int = None) -> DataFrame:
    """(keys, _rows, _columns): how many cells the left and the right blocks of a group are dealt to."""
    size = F.lit(side) if side else F.greatest(F.lit(CELL_BLOCKS), F.least(F.ceil(F.col("_n") / GRID), F.floor(F.lit(CELL_VALUES) / F.greatest("_width", F.lit(1)))))
    cells = lambda df, name: (df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.size("flat")).alias("_width"))
                              .select(*keys, F.ceil(F.col("_n") / size).cast("int").alias(name)))
    return cells(left, "_rows").join(cells(right, "_columns"), keys)


def block_pairs(left: DataFrame, right: DataFrame, keys, side: int = None, mirrored: bool = False) -> DataFrame:
    """Every left block next to every right block of the same group; right columns get the prefix ``o_``.

    Blocks are dealt to the rows and columns of the group's grid by hash and copied to the cells of their row or column. Both frames are
    read twice and should be cheap to redo. With ``mirrored`` both frames are the same and only cells on one side of the diagonal are made:
    pairs with ``twice`` stand for their mirror images, too.
    """
    keys = list(keys)
    grid = settled(_grid(left, right, keys, side))
    dealt = lambda part: F.pmod(F.xxhash64(F.get("ids", F.lit(0))), F.col(part)).cast("int")
    every = lambda first, last: F.explode(F.sequence(first, last))
    zero = F.lit(0)
    a = left.join(grid, keys).withColumn("_i", dealt("_rows")).withColumn("_j", every(F.col("_i") if mirrored else zero, F.col("_columns") - 1)).drop("_rows", "_columns")
    b = right.join(grid, keys).withColumn("_j", dealt("_columns")).withColumn("_i", every(zero, F.col("_j") if mirrored else F.col("_rows") - 1)).drop("_rows", "_columns")
    renamed = b.select(*keys, "_i", "_j", *[F.col(c).alias(f"o_{c}") for c in right.columns if c not in keys])
    cell, n = [*keys, "_i", "_j"], partitions(left)   # dealt by number: the cells are small, but their work is not, so they must not be put together
    met = a.repartition(n, *cell).join(renamed.repartition(n, *cell), cell)
    return (met.withColumn("twice", F.col("_i") < F.col("_j")) if mirrored else met).drop("_i", "_j")


def sweep(pairs: DataFrame, keys, per_pair, value_type=None, id_type=None) -> DataFrame:
    """Run ``per_pair(row) -> (ids, values)`` on every block pair; result rows are (keys, instance, value).

    ``instance`` has the type of the blocks' ids unless ``id_type`` names another.
    """
    fields = [pairs.schema[k] for k in keys]
    schema = StructType(fields + [StructField("instance", id_type or pairs.schema["ids"].dataType.elementType), StructField("value", value_type or DoubleType())])
    names = [*keys, "instance", "value"]

    def run(batches):
        for batch in batches:
            for row in batch.itertuples(index=False):
                ids, values = per_pair(row)
                frame = pd.DataFrame({"instance": ids, "value": values})
                for key in keys:
                    frame[key] = getattr(row, key)
                yield frame[names]

    return pairs.mapInPandas(run, schema)


def counts(pairs: DataFrame, keys, name: str, kind, per_pair) -> DataFrame:
    """(keys, name, n): how often each value occurs that ``per_pair(row) -> values`` returns for the block pairs; ``twice`` counts double.

    A task adds up what its pairs return and hands the counts on when it is done or holds ``HELD`` of them.
    """
    schema = StructType([*[pairs.schema[k] for k in keys], StructField(name, kind), StructField("n", LongType())])

    def run(batches):
        held, waiting = {}, 0

        def frames():
            for group, parts in held.items():
                values, n = _added(parts)
                yield pd.DataFrame({**dict(zip(keys, group)), name: values, "n": n})[schema.fieldNames()]

        for batch in batches:
            for row in batch.itertuples(index=False):
                values, n = np.unique(per_pair(row), return_counts=True)
                held.setdefault(tuple(getattr(row, k) for k in keys), []).append((values, n * (1 + int(row.twice))))
                waiting += len(values)
                if waiting > HELD:
                    held = {group: [_added(parts)] for group, parts in held.items()}
                    waiting = sum(len(parts[0][0]) for parts in held.values())
                    if waiting > HELD // 2:
                        yield from frames()
                        held, waiting = {}, 0
        yield from frames()

    return pairs.mapInPandas(run, schema).groupBy(*keys, name).agg(F.sum("n").alias("n"))


def _added(parts):
    """(values, counts) of several such pairs together."""
    values, place = np.unique(np.concatenate([v for v, _ in parts]), return_inverse=True)
    return values, np.bincount(place, weights=np.concatenate([n for _, n in parts]), minlength=len(values)).astype(np.int64)


def cogrouped(left: DataFrame, right: DataFrame, keys, function, schema) -> DataFrame:
    """``function(key, left rows, right rows)`` on the groups of two frames, which may come from the same data; None stands for no rows.

    The keys that the schema names are added to the function's frame.
    """
    other = right.select(*[F.col(c).alias(f"r_{c}") for c in right.columns])

    def run(key, lefts, rights):
        out = function(key, lefts, rights.rename(columns=lambda c: c.removeprefix("r_")))
        if out is None:
            return pd.DataFrame(columns=schema.fieldNames())
        for name, value in zip(keys, key):
            if name in schema.fieldNames():
                out[name] = value
        return out[schema.fieldNames()]

    n, right_keys = partitions(left), [f"r_{k}" for k in keys]
    return left.repartition(n, *keys).groupBy(*keys).cogroup(other.repartition(n, *right_keys).groupBy(*right_keys)).applyInPandas(run, schema)


def row_sides(size, width):
    """Cells on each side of the grid of a group of ``size`` rows with vectors of ``width`` numbers."""
    rows = F.greatest(F.lit(CELL_ROWS), F.least(F.ceil(size / ROW_GRID), F.floor(F.lit(CELL_VALUES) / F.greatest(width, F.lit(1)))))
    return F.ceil(size / rows).cast("int")


def row_sweep(left: DataFrame, right: DataFrame, keys, per_cell, schema) -> DataFrame:
    """Run ``per_cell(left rows, right rows, left vectors, right vectors) -> frame`` on the cells of a grid over the rows of a group: one partial value per row and cell.

    Both frames have ``vector`` and ``size``, the rows of their group. A cell has at least about ``CELL_ROWS`` rows on each side and more in larger
    groups, since every row is copied once per cell of its side; ``per_cell`` sees at most ``SWEPT_ROWS`` of the left ones at a time.
    ``schema`` is that of the keys and the frame.
    """
    keys = list(keys)
    sides = row_sides(F.col("size"), F.size("vector"))
    dealt = F.pmod(F.xxhash64("instance"), sides).cast("int")
    every = F.explode(F.sequence(F.lit(0), sides - 1))
    a, b = left.withColumn("_i", dealt).withColumn("_j", every), right.withColumn("_j", dealt).withColumn("_i", every)

    def run(key, lefts, rights):
        if len(lefts) and len(rights):
            x, y = (np.stack(frame["vector"].to_list()).astype(float) for frame in (lefts, rights))
            return pd.concat([per_cell(lefts.iloc[at:at + SWEPT_ROWS], rights, x[at:at + SWEPT_ROWS], y) for at in range(0, len(lefts), SWEPT_ROWS)], ignore_index=True)

    return cogrouped(a, b, [*keys, "_i", "_j"], run, schema)


def total_distances(rows: DataFrame, candidates: DataFrame, keys) -> DataFrame:
    """Sum of the distances from every candidate to all rows of its group."""
    def per_pair(row):
        x, y = matrix(row.flat, row.ids), matrix(row.o_flat, row.o_ids)
        return row.ids, np.concatenate([product_distances(part, y).sum(axis=1) for part in swept(x)])

    left = settled(to_blocks(candidates, keys, block_rows=PAIRED * BLOCK_ROWS))
    right = left if rows is candidates else settled(to_blocks(rows, keys, block_rows=PAIRED * BLOCK_ROWS))
    partial = sweep(block_pairs(left, right, keys), keys, per_pair)
    return partial.groupBy(*keys, "instance").agg(F.sum("value").alias("total_distance"))


def median_positive_distance(rows: DataFrame, keys) -> DataFrame:
    """Exact median of the positive pairwise distances of every group (1.0 where there is none): the RBF bandwidth.

    First pass: counts per narrow bin of the distance. Second pass: the distinct distances of the one or two bins that hold the
    middle positions. No pass returns more than bins or in-bin values.
    """
    blocks = settled(to_blocks(rows, keys, block_rows=PAIRED * BLOCK_ROWS))
    pairs = block_pairs(blocks, blocks, keys, mirrored=True)

    def positive(row):
        y = matrix(row.o_flat, row.o_ids)   # both passes see the same blocks and therefore the same numbers
        d = np.round(np.concatenate([product_distances(part, y).ravel() for part in swept(matrix(row.flat, row.ids))]), 9)
        return d[d > 0]

    counted = counts(pairs, keys, "bin", LongType(), lambda row: positive(row).view(np.int64) >> BIN_SHIFT)
    running = Window.partitionBy(*keys).orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    upto = counted.withColumn("upto", F.sum("n").over(running)).withColumn("all", F.sum("n").over(Window.partitionBy(*keys)))
    low, high = F.floor((F.col("all") - 1) / 2), F.floor(F.col("all") / 2)
    holds = lambda place: (F.col("upto") - F.col("n") <= place) & (place < F.col("upto"))
    wanted = upto.where(holds(low) | holds(high)).groupBy(*keys).agg(
        F.min("bin").alias("low_bin"), F.max("bin").alias("high_bin"), F.min(F.col("upto") - F.col("n")).alias("before"), F.max("all").alias("all"))

    wanted = settled(wanted)

    def inside(row):
        d = positive(row)
        place = d.view(np.int64) >> BIN_SHIFT
        return d[(place == row.low_bin) | (place == row.high_bin)]

    values = counts(pairs.join(wanted, list(keys)), keys, "d", DoubleType(), inside)
    ordered = Window.partitionBy(*keys).orderBy("d").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = (values.join(wanted, list(keys)).withColumn("upto", F.col("before") + F.sum("n").over(ordered)))
    middle = placed.groupBy(*keys).agg(F.max(F.when(holds(low), F.col("d"))).alias("a"), F.max(F.when(holds(high), F.col("d"))).alias("b"))
    groups = rows.select(*keys).distinct()
    return groups.join(middle, list(keys), "left").select(*keys, F.coalesce((F.col("a") + F.col("b")) / 2, F.lit(1.0)).alias("bandwidth"))
