"""SimHash near-dedup with BK-trees.

Fingerprints are sums of shingle hashes, bit by bit. Distinct fingerprints are dealt to small shards by keys that any two linked ones
share, a BK-tree is built per shard, and every fingerprint is looked up only in the trees of its own shards, along edges within the
radius. With 64 bits and radius 3 the keys are exact: of four 16-bit blocks one is equal, and of four 12-bit blocks of the rest another,
which makes 16 keys of 28 bits. Wider fingerprints take their 16-bit bands as keys, or keys that the caller has for them. A shard above
``SHARD`` fingerprints is split, and each tree of a part meets each part's look-ups in a task of its own. A task returns the links of a
spanning forest, not all pairs.

Wide fingerprints only estimate the similarity of two sets of shingles (``similar_documents``): their links, found through min-hash keys and
a radius with slack, make groups of candidates, and inside a group the exact Jaccard similarity of all pairs decides.

Defined results: a text without words has fingerprint zero and is linked like any other; a null text is empty; repeated rows are exact
copies; a row without id links like any other and gets the smallest id that it reaches, null if it reaches none; an empty table gives an empty
table; columns other than the two named are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.common import batch_of, content_key
from subsetlab.llm.components import connected_components, united
from subsetlab.llm.shards import deal, unit_numbers, whole_units
from subsetlab.session import cut_lineage

SEED = 42
SHARD = 4096             # fingerprints per tree of a split shard
FRONTIER = 1_000_000     # (look-up, node) pairs that a task holds at once
GOLDEN = 0x9E3779B97F4A7C15
SIMILARITY = 0.8         # of the shingle sets of two texts that wide fingerprints propose
MIN_HASHES, SET_KEYS = 3, 12   # a pair at 0.8 shares one of 12 keys of 3 min-hashes with a probability of 1 - (1 - 0.8 ** 3) ** 12 = 0.9998
VERIFIED = 512           # texts per part of a split group of candidates
VERIFY_ROWS = 2000       # texts of whole groups that a task compares at once
COLUMNS_AT_ONCE = 4096   # shingles per product of two groups of texts


def shingle_hashes(text: bytes, size: int) -> np.ndarray:
    """XXH64 of the word shingles of UTF-8 bytes with A-Z lower-cased, repeats included; fewer words than ``size`` are one shingle."""
    import xxhash
    digest = xxhash.xxh64_intdigest
    words = text.lower().split()   # of bytes: ASCII letters and ASCII white space alone
    if len(words) < size:
        shingles = [b" ".join(words)] if words else []
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(size))))
    return np.array([digest(s, SEED) for s in shingles], np.uint64)


def mixed(values: np.ndarray) -> np.ndarray:
    """A further independent hash of 64-bit hashes."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def fingerprint(hashes: np.ndarray, width: int = 1) -> np.ndarray:
    """``width`` 64-bit words; a bit is 1 if set in over half the hashes. Words after the first use mixed hashes."""
    out = np.zeros(width, np.uint64)
    for t in range(width if len(hashes) else 0):
        h = mixed(hashes + np.uint64(GOLDEN * t % 2**64)) if t else hashes
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[t] = np.packbits(2 * ones > len(h), bitorder="little").view(np.uint64)[0]
    return out


def fingerprints(df: DataFrame, size: int, width: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp binary): little-endian words of the fingerprint of every row."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.binary())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            yield batch_of(schema, [batch.column(0), [fingerprint(shingle_hashes(t, size), width).tobytes() for t in texts]])

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text")).mapInArrow(run, "doc_id bigint, fp binary")


def shard_keys(fps: np.ndarray) -> np.ndarray:
    """Keys of fingerprints (rows of 64-bit words), one column per key; the key's number is in the bits above its value."""
    if fps.shape[1] == 1:
        keys = []
        for block in range(4):
            turned = fps[:, 0] if not block else fps[:, 0] << np.uint64(16 * block) | fps[:, 0] >> np.uint64(64 - 16 * block)
            for rest in range(4):
                value = (turned >> np.uint64(48)) << np.uint64(12) | (turned >> np.uint64(12 * rest)) & np.uint64(0xFFF)
                keys.append(value | np.uint64((4 * block + rest) << 28))
        return np.stack(keys, axis=1).astype(np.int64)
    bands = fps.view(np.uint16).reshape(len(fps), -1).astype(np.int64)
    return bands | np.arange(bands.shape[1], dtype=np.int64) << 16


def distances(a, b):
    return np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)


class Forest:
    """BK-trees of several shards side by side: children of a node are keyed by their distance to it."""

    def __init__(self, fps: np.ndarray, shard: np.ndarray):
        """``shard`` numbers the rows' trees from 0 in ascending order; the first row of a shard is its root."""
        self.fps, self.labels = fps, 64 * fps.shape[1] + 1
        self.root = np.unique(shard, return_index=True)[1]
        slots, children = np.empty(0, np.int64), np.empty(0, np.int64)
        left = np.setdiff1d(np.arange(len(fps)), self.root)
        at = self.root[shard[left]]
        levels = []
        while len(left):   # one level per pass: the first row for a free slot becomes the child, the others go on below it
            slot = at * self.labels + distances(fps[left], fps[at])
            taken, first, where = np.unique(slot, return_index=True, return_inverse=True)
            levels.append((taken, left[first]))
            stays = np.ones(len(left), bool)
            stays[first] = False
            at, left = left[first][where][stays], left[stays]
        if levels:
            slots, children = (np.concatenate(x) for x in zip(*levels))
        order = np.argsort(slots)
        self.slots, self.children = slots[order], children[order]

    def links(self, fps: np.ndarray, shard: np.ndarray, radius: int):
        """Yields (row of ``fps``, node) within the radius, following only edges that can lead there."""
        stack = [(np.arange(len(fps)), self.root[shard])]
        while stack:
            row, node = stack.pop()
            if len(row) > FRONTIER // 8:
                half = len(row) // 2
                stack += [(row[:half], node[:half]), (row[half:], node[half:])]
                continue
            far = distances(fps[row], self.fps[node])
            near = far <= radius
            if near.any():
                yield row[near], node[near]
            low = np.searchsorted(self.slots, node * self.labels + np.maximum(far - radius, 0))
            high = np.searchsorted(self.slots, node * self.labels + np.minimum(far + radius, self.labels - 1), "right")
            many = high - low
            if many.sum():
                ends = np.cumsum(many)
                edge = np.arange(ends[-1]) - np.repeat(ends - many, many) + np.repeat(low, many)
                stack.append((np.repeat(row, many), self.children[edge]))


def forest_links(unit, part, tree_part, fps, node, radius):
    """Spanning links (a, b) inside whole units: rows of the tree's part are the tree, rows of the other part look themselves up in it."""
    company = np.bincount(unit)[unit] > 1
    unit, part, tree_part, fps, node = unit[company], part[company], tree_part[company], fps[company], node[company]
    if not len(unit):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    _, unit = np.unique(unit, return_inverse=True)
    in_tree = part == tree_part
    looking = ~in_tree | (np.bincount(unit, ~in_tree)[unit] == 0)   # in a unit of one part the tree's rows look themselves up
    has_tree = np.bincount(unit, in_tree, minlength=unit.max() + 1) > 0
    looking &= has_tree[unit]
    tree_rows, rows = np.nonzero(in_tree)[0], np.nonzero(looking)[0]
    if not len(tree_rows) or not len(rows):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    numbers = np.cumsum(has_tree) - 1
    forest = Forest(fps[tree_rows], numbers[unit[tree_rows]])
    parent = np.arange(len(unit))
    for a, b in forest.links(fps[rows], numbers[unit[rows]], radius):
        parent = united(parent, rows[a], tree_rows[b])
    moved = np.nonzero(parent != np.arange(len(parent)))[0]
    return node[moved], node[parent[moved]]


def near_links(distinct: DataFrame, radius: int, width: int, keys_col=None) -> DataFrame:
    """(a, b) of nodes of distinct fingerprints (fp, node): enough links for the components of all pairs within the radius that share a key.

    Keys are those of ``shard_keys``, or the column ``keys_col`` of little-endian 64-bit keys.
    """
    key_schema = pa.schema([("key", pa.int64()), ("fp", pa.binary()), ("node", pa.int64())])

    def keyed(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            if keys_col:
                keys = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.int64).reshape(batch.num_rows, -1)
            else:
                keys = shard_keys(np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64).reshape(-1, width))
            take = pa.array(np.repeat(np.arange(batch.num_rows), keys.shape[1]))
            yield batch_of(key_schema, [keys.reshape(-1), batch.column(0).take(take), batch.column(1).take(take)])

    keys = distinct.select("fp", "node", *[keys_col] * bool(keys_col)).mapInArrow(keyed, "key bigint, fp binary, node bigint")
    dealt = deal(keys, "fp", shard=SHARD)
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches):
        for table in whole_units(batches):
            part, tree, node = (table.column(name).to_numpy() for name in ("part", "i", "node"))
            fps = np.frombuffer(b"".join(table.column("fp").to_pylist()), np.uint64).reshape(-1, width)
            yield batch_of(link_schema, forest_links(unit_numbers(table), part, tree, fps, node, radius))

    return dealt.mapInArrow(linked, "a bigint, b bigint")


def set_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of a set of shingle hashes: the number of the key and ``MIN_HASHES`` min-hashes, hashed; an empty set has keys of its own."""
    import xxhash
    least = [mixed(shingles ^ np.uint64(GOLDEN * (t + 101) % 2**64)).min() if len(shingles) else np.uint64(0) for t in range(MIN_HASHES * SET_KEYS)]
    digests = [xxhash.xxh64_intdigest(np.array(least[MIN_HASHES * k:MIN_HASHES * (k + 1)], np.uint64).tobytes(), k) for k in range(SET_KEYS)]
    return np.array(digests, np.uint64).view(np.int64)


def set_prints(df: DataFrame, size: int, width: int, id_col, text_col) -> DataFrame:
    """(doc_id, content, node, fp, keys) of every row, of the set of its text's shingles; equal sets have equal nodes."""
    schema = pa.schema([("doc_id", pa.int64()), ("content", pa.int64()), ("node", pa.int64()), ("fp", pa.binary()), ("keys", pa.binary())])

    def run(batches):
        import xxhash
        for batch in batches:
            sets = [np.unique(shingle_hashes(t, size)) for t in batch.column(2).to_pylist()]
            nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
            yield batch_of(schema, [batch.column(0), batch.column(1), nodes, [fingerprint(s, width).tobytes() for s in sets], [set_keys(s).tobytes() for s in sets]])

    return texts_of(df, id_col, text_col).mapInArrow(run, "doc_id bigint, content bigint, node bigint, fp binary, keys binary")


def texts_of(df: DataFrame, id_col, text_col) -> DataFrame:
    return df.select(F.col(id_col).cast("long").alias("doc_id"), content_key(F.col(text_col)).alias("content"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))


def similar_pairs(sets, part, i, j, similarity):
    """Index arrays (a, b) of the pairs of a unit whose sets have at least this Jaccard similarity: all pairs of one part, or of two parts."""
    rows_a, rows_b = (np.arange(len(sets)),) * 2 if i == j else (np.nonzero(part == i)[0], np.nonzero(part == j)[0])
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, column = owner[held[column] > 1], column[held[column] > 1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], np.unique(column[order], return_inverse=True)[1]
    common = np.zeros((len(rows_a), len(rows_b)))
    for begin in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS_AT_ONCE):
        low, high = np.searchsorted(column, [begin, begin + COLUMNS_AT_ONCE])
        holds = np.zeros((len(sets), COLUMNS_AT_ONCE), np.float32)
        holds[owner[low:high], column[low:high] - begin] = 1
        common += holds[rows_a] @ holds[rows_b].T
    union = sizes[rows_a][:, None] + sizes[rows_b][None, :] - common
    a, b = np.nonzero(common / np.maximum(union, 1) >= similarity)
    a, b = rows_a[a], rows_b[b]
    return a[a != b], b[a != b]


def verified_links(candidates: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of nodes (key, node, shingles) of one key: enough links for the components of all pairs with at least this Jaccard similarity."""
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def linked(batches):
        for table in whole_units(batches, VERIFY_ROWS):
            unit, part, i, j, node = unit_numbers(table), *(table.column(name).to_numpy() for name in ("part", "i", "j", "node"))
            shingles = table.column("shingles")
            parent = np.arange(len(unit))
            begins = np.nonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))[0]
            for begin, end in zip(begins, [*begins[1:], len(unit)]):
                if end - begin > 1:
                    sets = [np.frombuffer(s, np.uint64) for s in shingles.slice(begin, end - begin).to_pylist()]
                    a, b = similar_pairs(sets, part[begin:end], i[begin], j[begin], similarity)
                    parent = united(parent, a + begin, b + begin)
            moved = np.nonzero(parent != np.arange(len(parent)))[0]
            yield batch_of(link_schema, [node[moved], node[parent[moved]]])

    return deal(candidates, "shingles", shard=VERIFIED).mapInArrow(linked, "a bigint, b bigint")


def similar_documents(df: DataFrame, size: int, radius: int, width: int, id_col="doc_id", text_col="text", similarity=SIMILARITY) -> DataFrame:
    """(doc_id, content, fp, component_id, kept) of every row: components of texts whose sets of shingles have at least this Jaccard similarity.

    A row is known by its id and the hash of its text. ``kept`` holds for the rows of one such key per component, the smallest, rows without
    id last.
    """
    prints = cut_lineage(set_prints(df, size, width, id_col, text_col))
    row = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "content")
    distinct = cut_lineage(prints.groupBy("node").agg(F.min(row).alias("row"), F.first("fp").alias("fp"), F.first("keys").alias("keys")))
    groups = connected_components(near_links(distinct, radius, width, "keys"))
    # one text of each node that has candidates, and its set again
    asked = groups.join(distinct.select("node", "row"), "node").select(F.col("component").alias("key"), "node", F.col("row.doc_id").alias("asked_id"), F.col("row.content").alias("asked_content"))
    texts = texts_of(df, id_col, text_col)
    found = texts.join(asked.hint("shuffle_hash"), F.col("doc_id").eqNullSafe(F.col("asked_id")) & (F.col("content") == F.col("asked_content")))
    schema = pa.schema([("key", pa.int64()), ("node", pa.int64()), ("shingles", pa.binary())])

    def shingled(batches):
        seen = set()   # the join brings repeats of a row to one task
        for batch in batches:
            new = [k for k, node in enumerate(batch.column(1).to_pylist()) if not (node in seen or seen.add(node))]
            batch = batch.take(pa.array(new, pa.int64()))
            yield batch_of(schema, [batch.column(0), batch.column(1), [np.unique(shingle_hashes(t, size)).tobytes() for t in batch.column(2).to_pylist()]])

    candidates = cut_lineage(found.select("key", "node", "text").mapInArrow(shingled, "key bigint, node bigint, shingles binary"))
    components = connected_components(verified_links(candidates, similarity))
    labelled = cut_lineage(distinct.select("node", "row").join(components, "node", "left").withColumn("component", F.coalesce("component", "node")))
    first = cut_lineage(labelled.groupBy("component").agg(F.min("row").alias("first")))
    of_node = labelled.join(first, "component").select(F.col("node").alias("print"), "first")
    return (prints.join(of_node, prints["node"] == of_node["print"])
            .select("doc_id", "content", "fp", F.col("first.doc_id").alias("component_id"), (F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("content") == F.col("first.content"))).alias("kept")))


def near_duplicates(df: DataFrame, size: int, radius: int, width: int = 1, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, fp, component_id) of every row: the smallest id reachable over links of at most ``radius`` differing bits.

    Fingerprints of more than one word only propose links, see ``similar_documents``.
    """
    if width > 1:
        return similar_documents(df, size, radius, width, id_col, text_col).select("doc_id", "fp", "component_id")
    prints = cut_lineage(fingerprints(df, size, width, id_col, text_col))
    distinct = cut_lineage(prints.groupBy("fp").agg(F.min("doc_id").alias("least")).withColumn("node", F.monotonically_increasing_id()))   # fixed by the checkpoint
    components = connected_components(near_links(distinct.select("fp", "node"), radius, width))
    grouped = cut_lineage(distinct.join(components, "node", "left").select(F.col("fp").alias("print"), "least", F.coalesce("component", "node").alias("group")))
    ids = cut_lineage(grouped.groupBy("group").agg(F.min("least").alias("component_id")))
    return prints.join(grouped.join(ids, "group"), F.col("fp") == F.col("print")).select("doc_id", "fp", "component_id")
