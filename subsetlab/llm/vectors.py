"""Embedding near-dedup by collision counting over one-dimensional projections.

Vectors are projected on random directions. Groups of directions cut their sorted projections at the origin, so that a table of cells with
``bits`` directions each brings close vectors together; the number of tables is the one at which a pair at the threshold shares a cell with
the wanted recall. Inside a cell a window of fixed half-width is centred on every query's projections, and the number of projections whose
window holds the other vector is counted per pair. Only pairs at or above a count calibrated to that recall are
verified, by the cosine in double precision.

Identical vectors are one vector with a number of copies. A pair is counted only in the first table in which it meets, so a task returns
numbers of links per vector and a spanning forest of links instead of pairs. Cells above ``SHARD`` vectors are split (see ``shards``).

Defined results: a vector that is null, empty or zero, or holds null or non-finite components, is linked with nothing, its component is its
own id; vectors of different length are never compared; identical vectors are linked; rows that repeat an id count as further vectors, each with
its own links; a row without id links like any other and gets the smallest id that it reaches, null if it reaches none; an empty table gives
an empty table; other columns are ignored.
"""
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsetlab.llm.common import batch_of
from subsetlab.llm.components import connected_components, united
from subsetlab.llm.shards import deal, unit_numbers, whole_units
from subsetlab.session import cut_lineage

COSINE = 0.9
RECALL = 0.98            # of pairs at the threshold, for the cells and again for the counts; closer pairs are found more often
CELL_VECTORS = 64        # expected number of unrelated vectors in a cell
COUNTED = 16             # projections with windows
SHARD = 2048
TILE, PAIRS = 256, 50_000


def calibration(n: int, cosine=COSINE, recall=RECALL):
    """(directions per table, tables, half-width of a window, least count) for n vectors."""
    together = 1 - math.acos(cosine) / math.pi              # both on one side of the origin
    bits = max(2, round(math.log2(max(n, 2) / CELL_VECTORS)))
    tables = math.ceil(math.log(1 - recall) / math.log(1 - together ** bits))
    spread = math.sqrt(2 - 2 * cosine)                       # of the difference of two projections at the threshold
    half_width = 1.5 * spread
    inside = math.erf(1.5 / math.sqrt(2))
    tail, least = 0.0, COUNTED + 1
    while tail < recall:                                     # largest count with P(collisions >= count) >= recall
        least -= 1
        tail += math.comb(COUNTED, least) * inside ** least * (1 - inside) ** (COUNTED - least)
    return bits, tables, half_width, least


def directions(seed: int, dims: int, count: int) -> np.ndarray:
    return np.random.default_rng([seed, dims]).standard_normal((dims, count))


def unit_vectors(raw, kind) -> np.ndarray:
    """Rows of packed numbers scaled to length one, in double precision."""
    x = np.frombuffer(b"".join(raw), kind).reshape(len(raw), -1).astype(float)
    x /= np.abs(x).max(axis=1, keepdims=True)                # squares of tiny or huge numbers would leave the range
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def packed_vectors(df: DataFrame, id_col, vector_col):
    """(id, packed binary) with null for vectors that link with nothing, and the packed numbers' type."""
    element = df.schema[vector_col].dataType.elementType
    kind = np.float32 if isinstance(element, T.FloatType) else np.float64
    schema = pa.schema([("vec_id", pa.int64()), ("packed", pa.binary())])

    def run(batches):
        for batch in batches:
            out = []
            for vector in batch.column(1):
                values = vector.values if vector.is_valid else None
                x = values.to_numpy(zero_copy_only=False).astype(kind) if values is not None and len(values) and not values.null_count else np.zeros(1)
                out.append((x + kind(0)).tobytes() if np.isfinite(x).all() and x.any() else None)   # + 0 turns -0 into 0
            yield batch_of(schema, [batch.column(0), out])

    width = "float" if kind is np.float32 else "double"
    return df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{width}>").alias("vector")).mapInArrow(run, "vec_id bigint, packed binary"), kind


def close_pairs(x, windows, rows_a, rows_b, half_width, least, cosine, keys=None, table=None):
    """Yields index pairs (a, b) with a cosine of at least ``cosine`` among pairs whose windows collide often enough and that no earlier table has."""
    same = rows_a is rows_b
    for begin in range(0, len(rows_a), TILE):
        queries = rows_a[begin:begin + TILE]
        for at in range(begin if same else 0, len(rows_b), 8 * TILE):   # every tile: the count alone decides, no projection must collide
            others = rows_b[at:at + 8 * TILE]
            count = np.zeros((len(queries), len(others)), np.int8)
            for k in range(windows.shape[1]):
                count += np.abs(windows[queries, k][:, None] - windows[others, k]) <= half_width
            a, b = np.nonzero(count >= least)
            if same:
                ordered = begin + a < at + b
                a, b = a[ordered], b[ordered]
            for some in range(0, len(a), PAIRS):
                pa_, pb = queries[a[some:some + PAIRS]], others[b[some:some + PAIRS]]
                if keys is not None and table:
                    new = ~(keys[pa_, :table] == keys[pb, :table]).any(axis=1)
                    pa_, pb = pa_[new], pb[new]
                near = np.einsum("ij,ij->i", x[pa_], x[pb]) >= cosine
                if near.any():
                    yield pa_[near], pb[near]


def near_vectors(df: DataFrame, id_col="vec_id", vector_col="embedding", cosine=COSINE, recall=RECALL, seed=7) -> DataFrame:
    """(vec_id, n_links, component_id) of every row."""
    packed, kind = packed_vectors(df, id_col, vector_col)
    packed = cut_lineage(packed)
    distinct = cut_lineage(packed.filter("packed is not null").groupBy("packed").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("copies"))
                           .withColumn("node", F.monotonically_increasing_id()))   # a node is a vector, whatever ids its rows have; fixed by the checkpoint
    bits, tables, half_width, least = calibration(distinct.count(), cosine, recall)
    key_schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("copies", pa.int64()), ("packed", pa.binary()), ("cells", pa.binary())])
    powers = 1 << np.arange(bits, dtype=np.int64)

    def celled(batches):
        for batch in batches:
            raw = batch.column(2).to_pylist()
            sizes = np.array([len(r) for r in raw])
            for size in np.unique(sizes):
                rows = np.nonzero(sizes == size)[0]
                x = unit_vectors([raw[k] for k in rows], kind)
                sides = (x @ directions(seed, x.shape[1], bits * tables) > 0).reshape(len(x), tables, bits)
                cells = (sides * powers).sum(axis=2)
                keys = (np.arange(tables) << bits | cells) + (int(x.shape[1]) << 40)
                take = pa.array(np.repeat(rows, tables))
                packed_cells = pa.array([c.tobytes() for c in cells.astype(np.int32)]).take(pa.array(np.repeat(np.arange(len(rows)), tables)))
                yield batch_of(key_schema, [keys.reshape(-1), batch.column(0).take(take), batch.column(1).take(take), batch.column(2).take(take), packed_cells])

    keyed = distinct.select("node", "copies", "packed").mapInArrow(celled, "key bigint, node bigint, copies bigint, packed binary, cells binary")
    dealt = deal(keyed, "copies", "packed", "cells", shard=SHARD)
    found_schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])

    def found(batches):
        for table in whole_units(batches):
            unit, part, i, j, node, copies = unit_numbers(table), *(table.column(name).to_numpy() for name in ("part", "i", "j", "node", "copies"))
            key = table.column("key").to_numpy()
            raw, cells = table.column("packed").to_pylist(), table.column("cells").to_pylist()
            parent, links = np.arange(len(unit)), np.zeros(len(unit), np.int64)
            begins = np.nonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))[0]
            for begin, end in zip(begins, [*begins[1:], len(unit)]):
                if end - begin < 2:
                    continue
                x = unit_vectors(raw[begin:end], kind)
                keys = np.frombuffer(b"".join(cells[begin:end]), np.int32).reshape(end - begin, -1)
                windows = x @ directions(seed + 1, x.shape[1], COUNTED)
                rows = np.arange(end - begin)
                rows_a, rows_b = (rows, rows) if i[begin] == j[begin] else (rows[part[begin:end] == i[begin]], rows[part[begin:end] == j[begin]])
                for a, b in close_pairs(x, windows, rows_a, rows_b, half_width, least, cosine, keys, (key[begin] & ((1 << 40) - 1)) >> bits):
                    a, b = a + begin, b + begin
                    links += (np.bincount(a, copies[b], len(links)) + np.bincount(b, copies[a], len(links))).astype(np.int64)
                    parent = united(parent, a, b)
            linked, moved = np.nonzero(links)[0], np.nonzero(parent != np.arange(len(parent)))[0]
            yield batch_of(found_schema, [node[linked], pa.nulls(len(linked), pa.int64()), links[linked]])
            yield batch_of(found_schema, [node[moved], node[parent[moved]], np.zeros(len(moved), np.int64)])

    results = cut_lineage(dealt.mapInArrow(found, "a bigint, b bigint, n bigint"))
    counts = results.filter("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    components = connected_components(results.filter("b is not null"))
    per_vector = distinct.join(counts, "node", "left").join(components, "node", "left")
    smallest = per_vector.select(F.col("packed").alias("same"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("group"), "vec_id")
    ids = cut_lineage(smallest.groupBy("group").agg(F.min("vec_id").alias("least_id")))
    smallest = smallest.drop("vec_id").join(ids, "group")
    return (packed.join(smallest, packed["packed"] == smallest["same"], "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.when(F.col("same").isNull(), F.col("vec_id")).otherwise(F.col("least_id")).alias("component_id")))
