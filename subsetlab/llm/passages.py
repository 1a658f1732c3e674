"""Suffix-array dedup: repeated byte windows by a depth-limited most-significant-digit sort of sampled suffixes.

Whether a window of ``threshold`` bytes occurs twice is decided by sorting suffixes through that depth only. A window's first digit is its
anchor, the ``digit``-byte string inside it with the smallest hash (the leftmost of equal ones), which equal windows share; consecutive
windows with one anchor form a run.

Pass 1 groups runs by the anchor. A group of one run is finished. Runs that equal an earlier run of the group in all bytes repeat as a
whole. Pass 2 goes to full depth for the groups that still hold different runs: their windows are grouped by all their bytes, and all but
the first of each group repeat. Equal groups are exactly the repeated windows.

Both passes shuffle packed arrays per radix bucket instead of rows. Every task first settles what it can: of equal runs or windows only the
task's first goes on, so a passage that a third of all documents hold sends one entry per task; anchors with many different runs are dealt
by their bytes instead of the anchor. The number of buckets follows the input, so a bucket stays small.

Defined results: a null text is empty; rows are ordered by id, then text position; rows that repeat an id and a text are one document and
get the same result; a row without id comes before all others; an empty table gives an empty table; other columns are ignored.
"""
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.common import batch_of, content_key, partitions, written

THRESHOLD = 100
DIGIT = 32
SEGMENT = 1 << 18        # bytes hashed at once; longer texts are cut into overlapping segments
FLUSH = 1 << 18          # entries that a task settles at once
BUCKET_BYTES = 2 << 20   # input bytes per radix bucket
MANY_RUNS = 64           # different runs of one anchor in a task from which the anchor counts as hot

_RNG = np.random.default_rng(20240229)
BYTE_CODE = _RNG.integers(0, 2**64, (2, 256), dtype=np.uint64)
BASE = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
INVERSE = np.array([pow(int(b), -1, 2**64) for b in BASE], np.uint64)

ENTRY = np.dtype([("anchor", "<u8"), ("bytes", "<u8"), ("doc", "<i8"), ("content", "<u4"), ("start", "<u4"), ("windows", "<u2"), ("offset", "<u2"), ("flag", "u1")])
FIRST, REPEATS, HOT, WITNESS = 0, 1, 2, 3   # flags of entries
WHOLE, COMPARE, COMPARE_HOT = 1, 2, 3       # kinds of marks: all windows repeat; windows to compare by anchor, or by themselves
MARK_DDL = "doc bigint, content bigint, start bigint, windows int, kind int, anchor bigint, offset int"
MARK_SCHEMA = pa.schema([("doc", pa.int64()), ("content", pa.int64()), ("start", pa.int64()), ("windows", pa.int32()), ("kind", pa.int32()), ("anchor", pa.int64()), ("offset", pa.int32())])
BLOB_DDL = "bucket bigint, blob binary"
BLOB_SCHEMA = pa.schema([("bucket", pa.int64()), ("blob", pa.binary())])
NO_ID = -(1 << 63)


def mixed(values):
    """Finaliser of a 64-bit hash."""
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    values = (values ^ (values >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return values ^ (values >> np.uint64(33))


class Hashes:
    """Hashes of substrings of a byte array from prefix sums."""

    def __init__(self, data, which):
        powers = np.full(len(data) + 1, BASE[which])
        powers[0] = 1
        np.cumprod(powers, out=powers)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(BYTE_CODE[which][data] * powers[:-1], out=self.sums[1:])
        self.back = np.full(len(data) + 1, INVERSE[which])
        self.back[0] = 1
        np.cumprod(self.back, out=self.back)

    def of(self, start, stop):
        return mixed((self.sums[stop] - self.sums[start]) * self.back[start])


def sliding_min(values, width):
    """Minimum of every ``width`` neighbours."""
    out, have = values, 1
    while 2 * have <= width:
        out = np.minimum(out[:len(out) - have], out[have:])
        have *= 2
    return np.minimum(out[:len(out) - (width - have)], out[width - have:]) if width > have else out


def segments(texts, threshold):
    """Groups of pieces (row, start of the piece in its text, bytes) of about ``SEGMENT`` bytes; pieces of one text overlap by less than a window."""
    group, size = [], 0
    for row, text in enumerate(texts):
        for start in range(0, max(1, len(text) - threshold + 1), SEGMENT):
            piece = text[start:start + SEGMENT + threshold - 1]
            if len(piece) < threshold:
                continue
            group.append((row, start, piece))
            size += len(piece)
            if size >= SEGMENT:
                yield group
                group, size = [], 0
    if group:
        yield group


def runs_of(group, threshold, digit):
    """Entries per run of windows with one anchor; ``doc`` is still the row number."""
    lengths = np.array([len(p) for _, _, p in group])
    data = np.frombuffer(b"".join(p for _, _, p in group), np.uint8)
    begins = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    owner = np.repeat(np.arange(len(group)), lengths)
    digits, wholes = Hashes(data, 0), Hashes(data, 1)
    at = np.arange(len(data) - digit + 1)
    gram = digits.of(at, at + digit)
    low = np.uint64((1 << 24) - 1)
    anchor_of = (sliding_min(gram & ~low | at.astype(np.uint64), threshold - digit + 1) & low).astype(np.int64)
    window = np.nonzero(owner[:len(data) - threshold + 1] == owner[threshold - 1:])[0]   # windows inside one piece
    anchor = anchor_of[window]
    first = np.nonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)]))[0]
    many = np.diff(np.concatenate([first, [len(window)]]))
    start, anchor = window[first], anchor[first]
    piece = owner[start]
    rows, offsets = (np.array([g[k] for g in group]) for k in (0, 1))
    whole = mixed(wholes.of(start, start + many + threshold - 1) ^ mixed((anchor - start + 256 * many).astype(np.uint64)))
    out = np.zeros(len(start), ENTRY)
    out["anchor"], out["bytes"], out["doc"], out["start"] = gram[anchor], whole, rows[piece], start - begins[piece] + offsets[piece]
    out["windows"], out["offset"] = many, anchor - start
    return out


def in_order(entries, *keys):
    """Entries sorted by keys, then document and position."""
    return entries[np.lexsort([entries["start"], entries["content"], entries["doc"], *(entries[k] for k in reversed(keys))])]


def changes(entries, *keys):
    """True where one of the keys differs from the entry before."""
    out = np.ones(len(entries), bool)
    if len(entries):
        out[1:] = np.logical_or.reduce([entries[k][1:] != entries[k][:-1] for k in keys])
    return out


def distinct_in_order(entries):
    """Entries by anchor, bytes, document and position; those of repeated rows once."""
    entries = in_order(entries, "anchor", "bytes")
    return entries[changes(entries, "anchor", "bytes", "doc", "content", "start")]


def settled(entries):
    """A task's runs with flags: only the first of equal runs stays open, runs of hot anchors are marked and get one witness."""
    entries = distinct_in_order(entries)
    new = changes(entries, "anchor", "bytes")
    entries["flag"] = np.where(new, FIRST, REPEATS)
    if not len(entries):
        return entries
    group = np.cumsum(changes(entries, "anchor")) - 1
    hot = (np.bincount(group, new) >= MANY_RUNS)[group]
    witness = entries[hot & changes(entries, "anchor")]
    witness["flag"] = WITNESS
    entries["flag"][hot & new] = HOT
    return np.concatenate([entries, witness])


def packed(entries, tail=b""):
    """Columns one after another, which compress better than rows; ``tail`` holds bytes of the entries."""
    return b"".join([len(entries).to_bytes(4, "little"), *(np.ascontiguousarray(entries[name]).tobytes() for name in ENTRY.names), tail])


def unpacked(blob):
    """(entries, tail) of a packed array."""
    n, at = int.from_bytes(blob[:4], "little"), 4
    out = np.empty(n, ENTRY)
    for name in ENTRY.names:
        kind = ENTRY[name]
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out, blob[at:]


def radix_blobs(entries, buckets, by_bytes=False, tails=None):
    """Record batch of one packed array per bucket: by the anchor, or by all bytes for hot anchors; what is settled is spread evenly."""
    spread = mixed(entries["start"].astype(np.uint64) ^ mixed(entries["doc"].view(np.uint64)))
    by = np.select([entries["flag"] == REPEATS, (entries["flag"] == HOT) | by_bytes], [spread, entries["bytes"]], entries["anchor"])
    bucket = ((by >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    entries, bucket = entries[order], bucket[order]
    cuts = np.nonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))[0] if len(bucket) else np.empty(0, np.int64)
    ends = np.concatenate([cuts[1:], [len(bucket)]]).astype(np.int64)
    blobs = [packed(entries[a:b], b"".join([tails[k] for k in order[a:b]]) if tails is not None else b"") for a, b in zip(cuts, ends)]
    return batch_of(BLOB_SCHEMA, [bucket[cuts], blobs])


def grouped(batches):
    """(entries, tails) of one bucket after another, from rows sorted by bucket."""
    held, current = [], None

    def whole():
        parts = [unpacked(blob) for blob in held]
        return np.concatenate([p[0] for p in parts]), b"".join(p[1] for p in parts)

    for batch in batches:
        for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != current and held:
                yield whole()
                held = []
            current = bucket
            held.append(blob)
    if held:
        yield whole()


def marks_of(entries, kind):
    return batch_of(MARK_SCHEMA, [entries["doc"], entries["content"].astype(np.int64), entries["start"].astype(np.int64), entries["windows"].astype(np.int32), kind.astype(np.int32),
                                  entries["anchor"].view(np.int64), entries["offset"].astype(np.int32)])


def judged_runs(entries):
    """Marks of one bucket of pass 1."""
    done, known_hot = entries[entries["flag"] == REPEATS], np.unique(entries["anchor"][entries["flag"] == WITNESS])
    entries = distinct_in_order(entries[(entries["flag"] == FIRST) | (entries["flag"] == HOT)])
    new = changes(entries, "anchor", "bytes")
    group = np.cumsum(changes(entries, "anchor")) - 1 if len(entries) else np.empty(0, np.int64)
    different = np.bincount(group, new)[group] > 1 if len(entries) else new
    hot = (entries["flag"] == HOT) | np.isin(entries["anchor"], known_hot)
    kind = np.select([~new, hot, different], [WHOLE, COMPARE_HOT, COMPARE], 0)
    keep = kind > 0
    return marks_of(np.concatenate([done, entries[keep]]), np.concatenate([np.full(len(done), WHOLE), kind[keep]]))


def windows_of(entries, tails, threshold):
    """An entry per window of runs whose bytes stand in ``tails`` one after another; ``bytes`` becomes the window's hash and its place round the anchor."""
    many = entries["windows"].astype(np.int64)
    data = np.frombuffer(tails, np.uint8)
    begins = np.concatenate([[0], np.cumsum(many + threshold - 1)[:-1]]) if len(many) else many
    step = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    at = np.repeat(begins, many) + step
    out = np.repeat(entries, many)
    place = out["offset"].astype(np.int64) - step
    out["start"] += step.astype(np.uint32)
    out["windows"] = 1
    out["bytes"] = mixed(Hashes(data, 1).of(at, at + threshold) ^ mixed(place.astype(np.uint64)))
    return out


def repeated_windows(entries):
    """Marks of windows that are not the first of their group, neighbours joined."""
    done, entries = entries[entries["flag"] == REPEATS], distinct_in_order(entries[entries["flag"] != REPEATS])
    entries = in_order(np.concatenate([done, entries[~changes(entries, "anchor", "bytes")]]))
    if len(entries):
        goes_on = (entries["doc"][1:] == entries["doc"][:-1]) & (entries["content"][1:] == entries["content"][:-1]) & (entries["start"][1:] == entries["start"][:-1] + 1)
        first = np.nonzero(np.concatenate([[True], ~goes_on]))[0]
        many = np.diff(np.concatenate([first, [len(entries)]]))
        # a mark counts at most 65,535 windows; longer stretches do not occur inside one bucket, whose runs are shorter than a window
        entries = entries[first]
        entries["windows"] = many
    return marks_of(entries, np.full(len(entries), WHOLE))


def first_windows(entries):
    """A task's windows of hot anchors: the first of equal ones stays open, the others repeat."""
    entries = distinct_in_order(entries)
    entries["flag"] = np.where(changes(entries, "anchor", "bytes"), FIRST, REPEATS)
    return entries


def documents_of(df: DataFrame, id_col, text_col) -> DataFrame:
    """(doc, content, data): content tells rows apart that share an id and is 0 while no id repeats."""
    ids = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    repeated = not df.groupBy(ids.alias("doc")).count().filter("count > 1").isEmpty()
    content = F.abs(content_key(F.col(text_col)) % (1 << 31)) if repeated else F.lit(0).cast("long")
    return df.select(ids.alias("doc"), content.alias("content"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("data"))


def repeated_marks(docs: DataFrame, threshold: int, digit: int) -> DataFrame:
    """(doc, content, start, windows) of repeated windows that are not the first of their kind."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    buckets, n = max(256, 1 << (size // BUCKET_BYTES).bit_length()), partitions(spark)

    def runs(batches):
        held, count = [], 0
        for batch in batches:
            doc, content, texts = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_pylist()
            for group in segments(texts, threshold):
                found = runs_of(group, threshold, digit)
                row = found["doc"].copy()
                found["doc"], found["content"] = doc[row], content[row]
                held.append(found)
                count += len(found)
                if count >= FLUSH:
                    yield radix_blobs(settled(np.concatenate(held)), buckets)
                    held, count = [], 0
        if held:
            yield radix_blobs(settled(np.concatenate(held)), buckets)

    def judge(batches):
        for entries, _ in grouped(batches):
            yield judged_runs(entries)

    marks = written(docs.mapInArrow(runs, BLOB_DDL).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(judge, MARK_DDL), "marks")
    compare = marks.filter(F.col("kind") != WHOLE).groupBy("doc", "content").agg(F.collect_list(F.struct("start", "windows", "kind", "anchor", "offset")).alias("runs"))
    asked = docs.join(compare.hint("shuffle_hash"), ["doc", "content"])

    def cut_out(batch):
        """Entries of a batch of documents with runs to compare, and the bytes of each run."""
        flat, tails = [], []
        for doc, content, data, runs_ in zip(*(batch.column(k).to_pylist() for k in range(4))):
            for run in runs_:
                flat.append((run["anchor"] & (2**64 - 1), 0, doc, content, run["start"], run["windows"], run["offset"], run["kind"]))
                tails.append(data[run["start"]:run["start"] + run["windows"] + threshold - 1])
        return np.array(flat, ENTRY), tails

    def digits(batches):
        for batch in batches:
            entries, tails = cut_out(batch)
            cold = np.nonzero(entries["flag"] == COMPARE)[0]
            hot = np.nonzero(entries["flag"] == COMPARE_HOT)[0]
            entries["flag"] = FIRST
            yield tagged(radix_blobs(entries[cold], buckets, tails=[tails[k] for k in cold]), False)
            for begin in range(0, len(hot), FLUSH // 64):
                some = hot[begin:begin + FLUSH // 64]
                yield tagged(radix_blobs(first_windows(windows_of(entries[some], b"".join(tails[k] for k in some), threshold)), buckets, by_bytes=True), True)

    def tagged(batch, hashed):
        """Buckets of runs and of hashed windows stay apart: even and odd numbers."""
        return batch_of(BLOB_SCHEMA, [(batch.column(0).to_numpy() * 2 + hashed), batch.column(1)])

    def compare_windows(batches):
        for entries, tails in grouped(batches):
            yield repeated_windows(windows_of(entries, tails, threshold) if tails else entries)

    deep = asked.select("doc", "content", "data", "runs").mapInArrow(digits, BLOB_DDL).repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(compare_windows, MARK_DDL)
    columns = ("doc", "content", "start", "windows")
    return marks.filter(F.col("kind") == WHOLE).select(*columns).unionByName(deep.select(*columns))


def remove_repeats(df: DataFrame, threshold=THRESHOLD, digit=DIGIT, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, n_bytes, spans array<struct<start, end>>, kept binary) of every row: byte spans covered by windows that start earlier too, and what is left."""
    docs = documents_of(df, id_col, text_col)
    covered = repeated_marks(docs, threshold, digit).groupBy("doc", "content").agg(F.collect_list(F.struct("start", "windows")).alias("marks"))
    joined = docs.join(covered.hint("shuffle_hash"), ["doc", "content"], "left")
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([(id_col, pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(span)), ("kept", pa.binary())])

    def apply(batches):
        for batch in batches:
            rows = []
            for doc, data, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                doc = None if doc == NO_ID else doc
                if not marks.is_valid:
                    rows.append((doc, len(data), [], data))
                    continue
                flat = marks.values
                start = flat.field("start").to_numpy()
                order = np.argsort(start)
                start, end = start[order], (start + flat.field("windows").to_numpy() + threshold - 1)[order]
                reach = np.maximum.accumulate(end)
                first = np.nonzero(np.concatenate([[True], start[1:] > reach[:-1]]))[0]
                begins, ends = start[first].tolist(), reach[np.concatenate([first[1:] - 1, [len(start) - 1]])].tolist()
                kept = b"".join([data[a:b] for a, b in zip([0, *ends], [*begins, len(data)])])
                rows.append((doc, len(data), [{"start": a, "end": b} for a, b in zip(begins, ends)], kept))
            yield batch_of(schema, zip(*rows) if rows else [[] for _ in schema])

    return joined.select("doc", "data", "marks").mapInArrow(apply, f"`{id_col}` bigint, n_bytes bigint, spans array<struct<start:bigint,end:bigint>>, kept binary")
