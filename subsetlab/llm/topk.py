"""Exact top-k search by inner product over integer vectors: norm-bucketed retrieval.

Candidates are grouped by length. Queries stand in groups too, by the length that a candidate needs to reach the query's threshold, and every
pair of a query group and a bucket of lengths is a cell: its task holds the queries and streams the candidates, longest first, in blocks. A
query's threshold is the lowest of its best scores so far; it starts from a bounded number of seeds, which are candidates like any other, so
it never excludes a better one. From the threshold and a block's greatest length follows the cosine that a vector of the block must reach.
Where it is above one, the block is skipped; else either the coordinate in which the query is largest (a vector within that angle has its own
coordinate in an interval, found in the block's sorted list) or the length (a prefix of the block) is used, whichever leaves fewer
vectors, and those are verified by their exact products. The best of all cells are merged per query.

Of candidates with equal vectors only the ``k`` + 1 of smallest ids can be among a query's ``k`` best beside itself, so no more are searched;
queries with equal vectors are searched once.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do vectors of a length of 2^31 or more after
scaling, whose products could leave 64 bits; vectors of different numbers of components are never compared, empty ones have the product 0; ties
go to the smaller id, candidates without id come last; a row without id is no query of a rule on ids; rows that repeat an id are further
queries and candidates, and a query leaves out only its own row; an empty table gives an empty table; other columns are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from subsetlab.llm.common import batch_of, partitions
from subsetlab.session import cut_lineage

BLOCK = 2048                  # vectors of a bucket with one local threshold
CELL = 1 << 20                # candidates of a cell, streamed
LEAST_CELL = 1024             # candidates for which another cell is worth the copies of the queries
GROUP_COMPONENTS = 1 << 22    # of the queries of a cell
SEED_COMPONENTS = 1 << 18     # of the vectors that give the first thresholds
SEEDS = 4096
DENSE = 8                     # blocks of which a query would verify an eighth or more are verified whole
PRODUCTS = 1 << 21            # computed at once
LONGEST = 2.0 ** 31
SLACK = 1e-9                  # relative, for rounding in lengths and angles
NONE = np.iinfo(np.int64).min


def matrix(raw, kind=np.float64) -> np.ndarray:
    """Rows of packed 32-bit integers, all of one size."""
    return np.frombuffer(b"".join(raw) or bytearray(), np.int32).reshape(len(raw), len(raw[0]) // 4 if len(raw) else 0).astype(kind)


def packed_vectors(df: DataFrame, id_col, vector_col, scale) -> DataFrame:
    """(vec_id, packed 32-bit integers floor(scale * x), square of the length) of the vectors that take part."""
    schema = pa.schema([("vec_id", pa.int64()), ("packed", pa.binary()), ("square", pa.int64())])

    def run(batches):
        for batch in batches:
            packed, squares = [], []
            for vector in batch.column(1):
                values = vector.values if vector.is_valid else None
                if values is None or values.null_count:
                    packed.append(None), squares.append(None)
                    continue
                with np.errstate(over="ignore", invalid="ignore"):
                    x = np.floor(scale * values.to_numpy(zero_copy_only=False))
                    fits = np.isfinite(x).all() and np.sqrt(x @ x) < LONGEST * (1 - SLACK)
                packed.append(x.astype(np.int32).tobytes() if fits else None)
                squares.append(int((x.astype(np.int64) ** 2).sum()) if fits else None)
            yield batch_of(schema, [batch.column(0), packed, squares])

    vectors = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return vectors.mapInArrow(run, "vec_id bigint, packed binary, square bigint").filter("packed is not null")


class Queries:
    """Queries of one number of components with their best candidates so far."""

    def __init__(self, numbers, raw, thresholds, k):
        self.numbers, self.k, self.theta = np.asarray(numbers), k, np.array(thresholds, np.int64)
        self.vectors = matrix(raw)
        self.lengths = np.sqrt((self.vectors ** 2).sum(axis=1))
        units = self.vectors / np.maximum(self.lengths, 1e-300)[:, None]
        self.focus = np.abs(units).argmax(axis=1) if units.shape[1] else np.zeros(len(units), np.int64)
        self.angle = np.arccos(np.clip(units[np.arange(len(units)), self.focus], -1, 1)) if units.shape[1] else np.zeros(len(units))
        self.query, self.score = np.empty(0, np.int64), np.empty(0, np.int64)   # the best, flat, by query and rank
        self.vec_id, self.unnamed = np.empty(0, np.int64), np.empty(0, bool)
        self.work = {"products": 0, "pairs": 0}

    def needed(self):
        """Length that a candidate needs for a threshold above zero; every length is enough for others."""
        return np.where((self.theta > 0) & (self.lengths > 0), self.theta / np.maximum(self.lengths, 1e-300), 0.0) * (1 - SLACK)

    def scan(self, vec_id, unnamed, raw):
        """Take in a block of candidates that is sorted by descending length."""
        x = matrix(raw)
        lengths = np.sqrt((x ** 2).sum(axis=1))
        self.work["pairs"] += len(x) * len(self.theta)
        needed = self.needed()
        rows = np.nonzero(needed <= lengths[0])[0]
        if not len(rows):
            return
        by_length = np.searchsorted(-lengths, -needed[rows], "right")   # a prefix of the block
        begin, many, column = np.zeros(len(rows), np.int64), by_length.copy(), np.full(len(rows), -1)
        order = {}
        if x.shape[1]:
            cosine = np.where(needed[rows] > 0, np.minimum(needed[rows] / max(lengths[0], 1e-300), 1), -1)   # the local threshold
            units = x / np.maximum(lengths, 1e-300)[:, None]
            reach, angle = np.arccos(cosine), self.angle[rows]
            low, high = np.cos(np.minimum(angle + reach, np.pi)) - SLACK, np.cos(np.maximum(angle - reach, 0)) + SLACK
            for c in np.unique(self.focus[rows]):
                order[c] = np.argsort(units[:, c], kind="stable")
                listed, mine = units[order[c], c], np.nonzero(self.focus[rows] == c)[0]
                first, last = np.searchsorted(listed, low[mine]), np.searchsorted(listed, high[mine], "right")
                fewer = last - first < many[mine]
                begin[mine[fewer]], many[mine[fewer]], column[mine[fewer]] = first[fewer], (last - first)[fewer], c
        kind = np.float64 if self.lengths.max() * lengths[0] < 2.0 ** 52 else np.int64   # exact either way
        x, vectors = x.astype(kind), self.vectors.astype(kind)
        dense = many * DENSE >= len(x)
        hits = [*self.whole(rows[dense], x, vectors), *self.listed(rows[~dense], begin[~dense], many[~dense], column[~dense], order, x, vectors)]
        if hits:
            query, at, score = (np.concatenate(part) for part in zip(*hits))
            self.merge(query, score, vec_id[at], unnamed[at])

    def whole(self, rows, x, vectors):
        """Hits of queries against all vectors of the block."""
        step = max(1, PRODUCTS // len(x))
        for some in range(0, len(rows), step):
            query = rows[some:some + step]
            scores = (vectors[query] @ x.T).astype(np.int64)
            self.work["products"] += scores.size
            least = self.theta[query]
            if len(x) > self.k:
                least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
            a, b = np.nonzero(scores >= least[:, None])
            yield query[a], b, scores[a, b]

    def listed(self, rows, begin, many, column, order, x, vectors):
        """Hits of queries against the stretch of ``many`` vectors of a sorted list (-1: by length) from ``begin`` on."""
        step = max(1, PRODUCTS // max(1, x.shape[1]))
        for c in np.unique(column):
            mine = np.nonzero((column == c) & (many > 0))[0]
            ends = np.cumsum(many[mine])
            cuts = np.searchsorted(ends, np.arange(step, int(ends[-1]) if len(ends) else 0, step))
            for part in np.split(mine, np.unique(cuts)):
                if not len(part):
                    continue
                n = many[part]
                stop = np.cumsum(n)
                at = np.arange(stop[-1]) + np.repeat(begin[part] - stop + n, n)
                at, query = order[c][at] if c >= 0 else at, np.repeat(rows[part], n)
                scores = np.einsum("ij,ij->i", vectors[query], x[at]).astype(np.int64)
                self.work["products"] += len(scores)
                good = scores >= self.theta[query]
                yield query[good], at[good], scores[good]

    def merge(self, query, score, vec_id, unnamed):
        """Keep the ``k`` best per query of those held and the new ones, and raise the thresholds."""
        query, score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        vec_id, unnamed = np.concatenate([self.vec_id, vec_id]), np.concatenate([self.unnamed, unnamed])
        order = np.lexsort((vec_id, unnamed, -score, query))
        query = query[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        order, query, rank = order[rank < self.k], query[rank < self.k], rank[rank < self.k]
        self.query, self.score, self.vec_id, self.unnamed = query, score[order], vec_id[order], unnamed[order]
        full = rank == self.k - 1
        self.theta[query[full]] = np.maximum(self.theta[query[full]], self.score[full])


def nullable_ids(column):
    """(ids with 0 for null, whether null) of an Arrow column."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


class Cell:
    """The queries of one cell by size of their vectors, and the candidates that wait to fill a block."""

    def __init__(self, k):
        self.k, self.rows, self.groups, self.waiting = k, [], None, {}

    def add_queries(self, batch):
        self.rows += zip(batch["id"].to_pylist(), batch["packed"].to_pylist(), batch["theta"].to_pylist())

    def add_candidates(self, batch):
        if self.groups is None:
            by_size = {}
            for row in self.rows:
                by_size.setdefault(len(row[1]), []).append(row)
            self.groups = {size: Queries(*zip(*rows), self.k) for size, rows in by_size.items()}
        ids, unnamed = nullable_ids(batch["id"])
        raw = batch["packed"].to_pylist()
        sizes = np.array([len(r) for r in raw])
        for size in np.unique(sizes).tolist():
            if size in self.groups:
                held = self.waiting.setdefault(size, [])
                held += [(ids[i], unnamed[i], raw[i]) for i in np.nonzero(sizes == size)[0]]
                if len(held) >= BLOCK:
                    self.scan(size)

    def scan(self, size):
        held = self.waiting.pop(size)
        for begin in range(0, len(held), BLOCK):
            ids, unnamed, raw = zip(*held[begin:begin + BLOCK])
            self.groups[size].scan(np.array(ids, np.int64), np.array(unnamed, bool), list(raw))

    def best(self):
        """(query number, id, score) arrays of each group."""
        for size in list(self.waiting):
            self.scan(size)
        for q in (self.groups or {}).values():
            yield q.numbers[q.query], pa.array(q.vec_id, mask=q.unnamed), q.score


def cut_by(df: DataFrame, column, number, parts, name) -> DataFrame:
    """Parts from 0 by quantiles of a column; rows on equal quantiles are spread by the hash of ``number``."""
    bounds = df.approxQuantile(column, [k / parts for k in range(1, parts)], 0.2 / parts) if parts > 1 else []
    listed = F.array(*map(F.lit, bounds)) if bounds else F.array().cast("array<double>")
    low, high = F.size(F.filter(listed, lambda b: b < F.col(column))), F.size(F.filter(listed, lambda b: b <= F.col(column)))
    return df.withColumn("low", low).withColumn("high", high).withColumn(name, (F.col("low") + F.pmod(F.xxhash64(*number), F.col("high") - F.col("low") + 1)).cast("int")).drop("low", "high")


def seeded(queries: DataFrame, seeds, k) -> DataFrame:
    """(number, packed, theta, need): thresholds of the queries from a table of candidates."""
    schema = pa.schema([("number", pa.int64()), ("packed", pa.binary()), ("theta", pa.int64()), ("need", pa.float64())])
    ids, unnamed = nullable_ids(seeds["vec_id"].combine_chunks())
    raw, lengths = seeds["packed"].to_pylist(), seeds["square"].to_numpy()

    def run(batches):
        for batch in batches:
            cell, n = Cell(k), batch.num_rows
            cell.rows = [(i, r, NONE) for i, r in enumerate(batch.column(1).to_pylist())]
            order = np.argsort(-lengths, kind="stable")
            cell.add_candidates({"id": pa.array(ids, mask=unnamed).take(pa.array(order)), "packed": pa.array(raw, pa.binary()).take(pa.array(order))})
            list(cell.best())
            theta, need = np.full(n, NONE), np.zeros(n)
            for q in cell.groups.values():
                theta[q.numbers], need[q.numbers] = q.theta, q.needed()
            yield batch_of(schema, [batch.column(0), batch.column(1), theta, need])

    return queries.select("number", "packed").mapInArrow(run, "number bigint, packed binary, theta bigint, need double")


def top_products(df: DataFrame, is_query, k=5, scale=256, id_col="vec_id", vector_col="embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` best candidates of every row whose id fulfils ``is_query`` (a function of the id column).

    The driver holds the seeds, at most ``SEEDS`` vectors of ``SEED_COMPONENTS`` components in all, and one bound per cell's row and column.
    """
    spark = df.sparkSession
    rows = cut_lineage(packed_vectors(df, id_col, vector_col, scale))
    copy = F.row_number().over(Window.partitionBy("packed").orderBy(F.col("vec_id").asc_nulls_last()))
    candidates = cut_lineage(rows.withColumn("copy", copy).filter(F.col("copy") <= k + 1))   # limited before the shuffle, too
    asked = rows.filter(is_query(F.col("vec_id")))
    queries = cut_lineage(asked.groupBy("packed").agg(F.first("square").alias("square")).withColumn("number", F.monotonically_increasing_id()))
    n, widest = candidates.agg(F.count(F.lit(1)), F.coalesce(F.max(F.octet_length("packed")), F.lit(4))).first()
    dims = max(1, widest // 4)
    seeds = max(2, min(SEEDS, SEED_COMPONENTS // dims) // 2)
    some = candidates.orderBy(F.desc("square"), "packed", "copy").limit(seeds).unionByName(candidates.orderBy(F.xxhash64("packed", "copy"), "packed", "copy").limit(seeds))
    first = cut_lineage(seeded(queries, some.dropDuplicates(["packed", "copy"]).select("vec_id", "packed", "square").toArrow(), k + 1))

    n_groups = max(1, -(-first.count() // max(64, GROUP_COMPONENTS // dims)))
    n_cells = max(1, -(-n // CELL), min(partitions(spark), -(-n // LEAST_CELL)))
    grouped = cut_by(first, "need", ["number"], n_groups, "g")
    least = [F.struct(F.lit(r["g"]).alias("g"), F.lit(float(r["need"])).alias("need")) for r in grouped.groupBy("g").agg(F.min("need").alias("need")).collect()]
    needs = F.array(*least) if least else F.array().cast("array<struct<g: int, need: double>>")
    placed = cut_by(candidates, "square", ["packed", "copy"], n_cells, "h")
    long_enough = F.transform(F.filter(needs, lambda x: x["need"] <= F.sqrt("square")), lambda x: x["g"])
    sent = placed.select(F.explode(long_enough).alias("g"), "h", F.lit(1).alias("kind"), F.col("vec_id").alias("id"), "packed", "square", F.lit(NONE).alias("theta"))
    copied = grouped.select("g", F.explode(F.sequence(F.lit(0), F.lit(n_cells - 1))).alias("h"), F.lit(0).alias("kind"), F.col("number").alias("id"), "packed", F.lit(0).cast("long").alias("square"), "theta")
    cells = copied.unionByName(sent).repartition(max(partitions(spark), -(-n_groups * n_cells // 4)), "g", "h").sortWithinPartitions("g", "h", "kind", F.desc("square"))
    schema = pa.schema([("number", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def searched(batches):
        cell, current = Cell(k + 1), None
        for batch in batches:
            g, h, kind = (batch.column(name).to_numpy() for name in ("g", "h", "kind"))
            starts = np.nonzero((g[1:] != g[:-1]) | (h[1:] != h[:-1]) | (kind[1:] != kind[:-1]))[0] + 1
            for begin, end in zip([0, *starts], [*starts, len(g)]) if len(g) else ():
                if (g[begin], h[begin]) != current:
                    yield from (batch_of(schema, part) for part in cell.best())
                    cell, current = Cell(k + 1), (g[begin], h[begin])
                rows = batch.slice(begin, end - begin)
                cell.add_candidates(rows) if kind[begin] else cell.add_queries(rows)
        yield from (batch_of(schema, part) for part in cell.best())

    found = cells.mapInArrow(searched, "number bigint, vec_id bigint, score bigint")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.desc("score"), F.col("vec_id").asc_nulls_last()))
    best = found.withColumn("rank", rank).filter(F.col("rank") <= k + 1).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("hits"))
    answered = cut_lineage(queries.join(best, "number").select(F.col("packed").alias("same"), "hits"))
    own = F.array_position(F.transform("hits", lambda x: x["vec_id"].eqNullSafe(F.col("query_id")) & (x["score"] == F.col("square"))), True)
    rows = asked.select(F.col("vec_id").alias("query_id"), "packed", "square").join(answered, F.col("packed") == F.col("same")).withColumn("own", own)
    others = F.slice(F.filter("hits", lambda x, i: i + 1 != F.col("own")), 1, k)
    return rows.select("query_id", F.posexplode(others).alias("at", "hit")).select("query_id", (F.col("at") + 1).alias("rank"), "hit.vec_id", "hit.score")
