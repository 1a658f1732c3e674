"""Bound-certified best-fit packing of token pieces into sequences of a fixed length.

Every part of the pieces is packed best-fit decreasing, and a lower bound from dual-feasible functions certifies its number of bins.
While the whole is above its bound, the open bins of all parts exchange their pieces, up to ``ROUNDS`` times; the gaps of single parts do
not steer this, and at large sizes some may stay. The pieces are dealt anew by another hash to parts of twice the size and packed again; the new bins are kept if they are fewer. Parts have a bounded expected number of pieces,
because a hash of document and piece deals them, so one frequent length or source fills no part more than another.

Defined results: a null or empty text is the closing id alone; repeated rows are packed once each; ties go to the smaller document and
piece; an empty table gives an empty table; other columns are ignored. Only (bins, bound) per round reach the driver, as sums.
"""
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.bpe import read_ranks
from subsetlab.llm.common import batch_of
from subsetlab.session import cut_lineage

CAPACITY = 2048
PIECES_PER_PART = 20_000
ROUNDS = 4
CLOSING_ID = b"\0\0\0\0"

#: Characters on which the JSON tokenizer and the rank file of the same vocabulary cannot differ: letters, digits and signs up to Latin Extended-A, plain white space.
PLAIN = r"[^\t\n\r -~¡-ſ]"


class VocabularyEncoder:
    """Packed little-endian 32-bit ids of whole texts: by the rank file where it must agree with the JSON tokenizer, else by the JSON tokenizer itself."""

    def __init__(self, json_path, ranks_path, pattern):
        import re

        import tiktoken
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(json_path)
        self.tokenizer.encode_special_tokens = True
        self.ranked = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(ranks_path), special_tokens={})
        self.unusual = re.compile(PLAIN).search

    def __call__(self, text):
        if self.unusual(text):
            ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        else:
            ids = self.ranked.encode_ordinary(text)
        return np.array(ids, np.uint32).tobytes()


def document_pieces(df: DataFrame, json_path, ranks_path, pattern, capacity=CAPACITY, id_col="doc_id", text_col="text", with_ids=False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): documents of at most ``capacity`` ids whole, longer ones in full pieces after a shorter first one."""
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids
    schema = pa.schema(fields)

    def run(batches):
        encode = VocabularyEncoder(json_path, ranks_path, pattern)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                packed = encode(text) + CLOSING_ID
                total = len(packed) // 4
                first = total % capacity or capacity
                for piece, start in enumerate([0, *range(first, total, capacity)]):
                    ids = packed[4 * start:4 * (start + capacity if start else first)]
                    rows.append((doc_id, piece, start, len(ids) // 4, zlib.crc32(ids), ids)[:len(fields)])
            yield batch_of(schema, zip(*rows) if rows else [[] for _ in fields])

    ddl = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, ddl)


def lower_bound(lengths, capacity=CAPACITY) -> int:
    """Bins that any packing needs: the largest bound of two families of dual-feasible functions."""
    lengths = np.asarray(lengths, np.int64)
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)
    return histogram_bound(count, capacity)


def histogram_bound(count, capacity=CAPACITY) -> int:
    """The same from the number of items of each length 0..capacity."""
    sizes = np.arange(capacity + 1)
    items, volume = np.concatenate([[0], np.cumsum(count)]), np.concatenate([[0], np.cumsum(count * sizes)])
    small = np.arange(0, capacity // 2 + 1)   # items below it count nothing, items above capacity - it count a bin
    threshold = (items[-1] - items[capacity - small + 1]) * capacity + volume[capacity - small + 1] - volume[small]
    best = -(-int(threshold.max()) // capacity)
    for k in range(1, 33):   # rounding to k-ths of a bin
        scaled = (k + 1) * sizes
        value = np.where(scaled % capacity == 0, sizes * k, scaled // capacity * capacity)
        best = max(best, -(-int((value * count).sum()) // (k * capacity)))
    return best


def best_fit_decreasing(lengths, capacity=CAPACITY):
    """(bin, offset) of each length, longest first, each into the fullest bin that it fits in."""
    order = np.argsort(-np.asarray(lengths), kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    open_bins = [[] for _ in range(capacity + 1)]
    rooms, used = 0, 0   # bit r of rooms: some open bin has room r
    for i, size in zip(order.tolist(), np.asarray(lengths)[order].tolist()):
        fitting = rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            at = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, at = capacity, used
            used += 1
        bins[i], offsets[i] = at, capacity - room
        left = room - size
        if left:
            open_bins[left].append(at)
            rooms |= 1 << left
    return bins, offsets


PLACED = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint, open boolean, part_gap bigint"


def pack_parts(pieces: DataFrame, parts: int, round_no: int, capacity: int) -> DataFrame:
    """Deal pieces to parts by a hash that differs per round and pack each part; ``open`` marks bins with room, ``part_gap`` is bins above the bound."""

    def run(key, pdf):
        pdf = pdf.sort_values(["doc_id", "piece"], kind="stable", ignore_index=True)
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), capacity)
        filled = np.bincount(bins, weights=pdf["length"])
        return pd.DataFrame({"doc_id": pdf["doc_id"], "piece": pdf["piece"], "start": pdf["start"], "length": pdf["length"], "ids_crc32": pdf["ids_crc32"],
                             "sequence_id": (round_no << 56) + (int(key[0]) << 24) + bins, "offset": offsets, "open": filled[bins] < capacity,
                             "part_gap": int(bins.max()) + 1 - lower_bound(pdf["length"], capacity)})

    dealt = F.pmod(F.xxhash64("doc_id", "piece", "start", F.lit(round_no)), F.lit(parts))
    return pieces.select("doc_id", "piece", "start", "length", "ids_crc32", dealt.alias("part")).groupBy("part").applyInPandas(run, PLACED)


def count_bins(placed: DataFrame) -> int:
    """Sequences in use: pieces at the start of one."""
    return placed.filter("offset = 0").count()


def pack(pieces: DataFrame, capacity=CAPACITY, pieces_per_part=PIECES_PER_PART, rounds=ROUNDS) -> DataFrame:
    """Pieces with sequence_id and offset; at most ``rounds`` exchanges, fewer when the bound is met.

    Parts double in size from round to round, up to ``pieces_per_part`` times 2 to the ``rounds``.
    """
    pieces = cut_lineage(pieces)
    histogram = np.zeros(capacity + 1, np.int64)
    for row in pieces.groupBy("length").count().collect():   # at most ``capacity`` rows
        histogram[row["length"]] = row["count"]
    bound = histogram_bound(histogram, capacity)
    parts = max(1, -(-int(histogram.sum()) // pieces_per_part))
    placed = cut_lineage(pack_parts(pieces, parts, 0, capacity))
    bins = count_bins(placed)
    for round_no in range(1, rounds + 1):
        if bins <= bound:
            break
        kept, moved = placed.filter("not open"), placed.filter("open")
        n_moved, before = moved.count(), count_bins(moved)
        again = cut_lineage(pack_parts(moved, max(1, -(-n_moved // (pieces_per_part << round_no))), round_no, capacity))
        after = count_bins(again)
        if after < before:
            placed, bins = kept.unionByName(again), bins - before + after
    return placed.drop("open", "part_gap")


def sequences(placed: DataFrame, pieces_with_ids: DataFrame) -> DataFrame:
    """The packed sequences: (sequence_id, ids binary of little-endian 32-bit ids, ends of the pieces); a sequence is bounded by the capacity."""
    joined = placed.join(pieces_with_ids.select("doc_id", "piece", "ids"), ["doc_id", "piece"])
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return (joined.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.expr("aggregate(parts, cast('' as binary), (a, p) -> concat(a, p.ids))").alias("ids"), F.transform("parts", lambda p: p["offset"] + p["length"]).alias("ends")))
