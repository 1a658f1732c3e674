"""Byte-level BPE encoding and decoding with a segment tree over byte positions.

A leaf of the tree stands for a live part of the text and holds the rank of its pair with the next part; inner nodes hold the leftmost
minimum. The root names the next merge; a merge updates the leaves of the part itself, of the part it swallows and of the part before,
each in logarithmic time, so a match of any length costs n log n.

Defined results: a null text is empty and gives no ids; repeated rows and repeated ids are encoded row by row; an empty table gives an
empty table; columns other than the two named are ignored. Decoding gives the UTF-8 bytes of the text.
"""
import base64
import gc
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.common import batch_of
from subsetlab.llm.tokens import TextEncoder


def read_ranks(path):
    """Byte string → rank of a rank file: base64 and a number per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks) -> list:
    """Ids of one match: merges by rank, the leftmost of equal ranks first. A match that is a token itself is that token."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    shift = n.bit_length()
    size, mask, never = 1 << shift, (1 << shift) - 1, 1 << 62
    get = ranks.get
    tree = [never] * (2 * size)
    for i in range(n - 1):
        rank = get(piece[i:i + 2])
        if rank is not None:
            tree[size + i] = rank << shift | i
    for k in range(size - 1, 0, -1):
        left, right = tree[2 * k], tree[2 * k + 1]
        tree[k] = left if left < right else right
    end, before = list(range(1, n + 1)), list(range(-1, n - 1))   # of the part that starts at a position

    def put(i, stop):
        rank = get(piece[i:stop]) if stop else None
        k = size + i
        tree[k] = never if rank is None else rank << shift | i
        k >>= 1
        while k:
            left, right = tree[2 * k], tree[2 * k + 1]
            least = left if left < right else right
            if tree[k] == least:
                break
            tree[k] = least
            k >>= 1

    while tree[1] < never:
        i = tree[1] & mask
        swallowed = end[i]
        stop = end[i] = end[swallowed]
        put(swallowed, 0)
        if stop < n:
            before[stop] = i
            put(i, end[stop])
        else:
            put(i, 0)
        if before[i] >= 0:
            put(before[i], stop)
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i:end[i]]])
        i = end[i]
    return out


#: Longest match in bytes that is merged together with others; longer ones are merged one at a time.
TOGETHER = 64
WORDS_AT_ONCE = 20_000
NEVER = np.int64(1 << 62)


class Merger:
    """Merges many matches at once: one segment tree per match, the trees side by side in arrays, one merge per match and step.

    Parts are kept as ids, so a pair's rank is looked up by two ids: every split of a token into two tokens is in one hash index.
    """

    def __init__(self, ranks):
        import pandas as pd
        self.ranks = ranks
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left = ranks.get(token[:cut])
                right = ranks.get(token[cut:]) if left is not None else None
                if right is not None:
                    pairs[left << 32 | right] = rank
        self.index = pd.Index(np.fromiter(pairs, np.int64, len(pairs)))
        self.pair_rank = np.fromiter(pairs.values(), np.int64, len(pairs))
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)])

    def leaf(self, left, right, shift, at):
        """Leaf values of pairs of ids at positions."""
        found = self.index.get_indexer(left.astype(np.int64) << 32 | right)
        return np.where(found >= 0, self.pair_rank[found] << shift | at, NEVER)

    def merge_together(self, pieces, size):
        """Ids of pieces of 2 to ``size`` bytes, ``size`` a power of two: (flat ids, number per piece).

        Piece k's tree is at k * 2 * size, its leaves in the second half; its parts' ids, ends and predecessors are at k * size.
        """
        n, shift = len(pieces), size.bit_length() - 1
        length = np.array([len(p) for p in pieces])
        place = np.arange(size)
        inside = place < length[:, None]
        ids = np.zeros((n, size), np.int32)
        ids[inside] = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        trees = np.full((n, 2 * size), NEVER, np.int64)
        rows, at = np.nonzero(inside[:, 1:])
        trees[rows, size + at] = self.leaf(ids[rows, at], ids[rows, at + 1], shift, at)
        width = size // 2
        while width:
            np.minimum(trees[:, 2 * width:4 * width:2], trees[:, 2 * width + 1:4 * width:2], out=trees[:, width:2 * width])
            width //= 2
        tree, ids, inside = trees.reshape(-1), ids.reshape(-1), inside.reshape(-1)
        end, before = np.tile((place + 1).astype(np.int16), n), np.tile((place - 1).astype(np.int16), n)
        active = np.nonzero(trees[:, 1] < NEVER)[0]
        while len(active):
            top, base = active * (2 * size), active * size
            root = tree[top + 1]
            i = root & (size - 1)
            own = base + i
            swallowed = end[own].astype(np.int64)
            stop = end[base + swallowed].astype(np.int64)
            end[own], ids[own] = stop, root >> shift
            inside[base + swallowed] = False
            more = np.nonzero(stop < length[active])[0]
            after = base[more] + stop[more]
            before[after] = i[more]
            tree[top + size + swallowed] = NEVER
            tree[top + size + i] = NEVER
            tree[top[more] + size + i[more]] = self.leaf(ids[own[more]], ids[after], shift, i[more])
            first = before[own].astype(np.int64)
            has = np.nonzero(first >= 0)[0]
            tree[top[has] + size + first[has]] = self.leaf(ids[base[has] + first[has]], ids[own[has]], shift, first[has])
            first[first < 0] = i[first < 0]
            for k in (swallowed + size, i + size, first + size):   # the three leaves' ways to the root, the later ones over what the earlier left
                for _ in range(shift):
                    k >>= 1
                    child = top + 2 * k
                    tree[top + k] = np.minimum(tree[child], tree[child + 1])
            active = active[tree[top + 1] < NEVER]
        return ids[inside], inside.reshape(n, size).sum(axis=1)

    def __call__(self, matches):
        """Packed ids of each match."""
        pieces = [m.encode("utf-8", "replace") for m in matches]
        whole = [self.ranks.get(p) for p in pieces]
        out = [None if r is None else struct.pack("<I", r) for r in whole]
        groups = {}
        for k, p in enumerate(pieces):
            if out[k] is None:
                groups.setdefault(1 << (len(p) - 1).bit_length() if len(p) <= TOGETHER else 0, []).append(k)
        for size, members in groups.items():
            if not size:
                for k in members:
                    ids = merge(pieces[k], self.ranks)
                    out[k] = struct.pack(f"<{len(ids)}I", *ids)
                continue
            for begin in range(0, len(members), WORDS_AT_ONCE):
                some = members[begin:begin + WORDS_AT_ONCE]
                ids, counts = self.merge_together([pieces[k] for k in some], size)
                packed, ends = ids.astype(np.uint32).tobytes(), (4 * np.cumsum(counts)).tolist()
                for k, start, stop in zip(some, [0, *ends], ends):
                    out[k] = packed[start:stop]
        return out


def text_encoder(ranks_path, pattern) -> TextEncoder:
    """Encoder of whole texts: each match of the pattern is merged by itself."""
    import regex
    return TextEncoder(regex.compile(pattern).findall, Merger(read_ranks(ranks_path)))


def encode_documents(df: DataFrame, ranks_path: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, ids array<int>) of every row."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches):
        gc.disable()   # strings and bytes alone: nothing here is in a cycle, and the collector would walk the whole cache
        encoder = text_encoder(ranks_path, pattern)
        for batch in batches:
            packed = encoder.encode_batch(batch.column(1).to_pylist())
            offsets = np.concatenate([[0], np.cumsum([len(p) // 4 for p in packed])]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(packed), np.int32))
            yield batch_of(schema, [batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, f"`{id_col}` bigint, ids array<int>")


def decode_documents(df: DataFrame, ranks_path: str, id_col="doc_id", ids_col="ids") -> DataFrame:
    """(id, ids, decoded binary) of rows with arrays of ids."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])

    def run(batches):
        tokens = {rank: token for token, rank in read_ranks(ranks_path).items()}.__getitem__
        for batch in batches:
            ids = batch.column(1)
            decoded = [b"".join(map(tokens, row.tolist())) for row in (x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, int) for x in ids)]
            yield batch_of(schema, [batch.column(0), ids, decoded])

    return df.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` bigint, ids array<int>, decoded binary")
