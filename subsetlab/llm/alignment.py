"""Alignment of two tokenizers' tokens over the same bytes, and corpus-wide counts of linked id pairs.

Tokenizer A is a byte-level BPE in a JSON file, B a piece model with byte fallback. Byte offsets at which tokens of both end cut a text into
groups; tokens whose byte ranges overlap are linked. An identity map holds, for every id of A, the id of B with the same bytes. Groups of one
token on each side that follow the map are counted in vectors of the vocabulary's length; only the pairs of the other, irregular groups enter
a shuffle, summed per task first. The most frequent of those pairs, at most ``FREQUENT``, go back to the tasks as a lookup table; the rest
meet their documents' pairs in a join, in which none of them is frequent. The two ways give the same result.

No token of either side runs over the start of a run of spaces behind another character, nor over a lone line feed; so a text is encoded in
chunks between such places, and the chunks' tokens, groups and links are remembered per task in a bounded cache.

A document is a row, also if rows share an id and a text. Defined results: a null or empty text has no tokens, and neither has a text that the
tokens of A or B do not spell byte by byte (one with U+2581, which B takes for a space): zeros and an empty string of groups; their strings
for special tokens are plain text; a row without id is counted and returned like any other; ties for an id's highest count are all best; an
empty table gives an empty table; other columns are ignored, whatever their names. A text has to fit in a task.
"""
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subsetlab.llm.common import batch_of, written
from subsetlab.session import cut_lineage

FREQUENT = 1 << 18          # pairs of the lookup table that tasks get, 4 MB
CACHE_CHUNKS = 400_000      # emptied when full, which changes no result
CACHE_CHARACTERS = 16_000_000
CHARACTERS_AT_ONCE = 1_000_000   # of whole texts whose new chunks are encoded together
PAIRS_AT_ONCE = 1_000_000   # distinct pairs that a task sums before it sends them on
B_BITS = 32                 # an id pair is one number: A's id above these bits, B's below
B_MASK = (1 << B_BITS) - 1

CHUNK_STARTS = re.compile(r"(?<=\S)(?= )")


def printable_bytes() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable Latin-1 characters stand for themselves, the other bytes follow from 256 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


class TokenizerPair:
    """The two tokenizers, the bytes of their ids and the identity map."""

    def __init__(self, json_path, model_path):
        import sentencepiece
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a, self.b = Tokenizer.from_file(json_path), sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.a.encode_special_tokens = True
        of_char = printable_bytes()
        self.bytes_a = [b""] * self.a.get_vocab_size()
        for entry, number in self.a.get_vocab().items():
            self.bytes_a[number] = b"".join(bytes([of_char[c]]) if c in of_char else c.encode() for c in entry)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        if any("▁" in p.lstrip("▁") or "\n" in p and not self.b.is_byte(i) for i, p in enumerate(pieces)):
            raise ValueError("a piece runs over a space or a line feed: chunks would not be independent")
        of_bytes = {self.bytes_b[i]: i for i in sorted(range(len(pieces)), key=lambda i: not self.b.is_byte(i)) if not self.b.is_control(i)}   # byte pieces give way
        self.length_a, self.length_b = (np.array([len(x) for x in of], np.int64) for of in (self.bytes_a, self.bytes_b))
        signs = [np.array([f"{i}{sign}" for i in range(len(of))], object) for of, sign in ((self.bytes_a, ","), (self.bytes_a, "|"), (self.bytes_b, ","), (self.bytes_b, ";"))]
        self.text_a, self.last_a, self.text_b, self.last_b = signs   # an id inside a group, and as its side's last one
        self.same = np.array([of_bytes.get(x, -1) for x in self.bytes_a], np.int64)
        self.feed = self.b.encode("\n")   # in front of a chunk, so that no space is added to it

    def ids(self, chunks):
        """Ids of A and of B for each chunk."""
        a = [e.ids for e in self.a.encode_batch(chunks, add_special_tokens=False)]
        b = self.b.encode(["\n" + c for c in chunks], num_threads=1)
        if any(ids[:len(self.feed)] != self.feed for ids in b):
            raise ValueError("a line feed is not a piece of its own: chunks would not be independent")
        return a, [ids[len(self.feed):] for ids in b]


def chunks_of(text: str) -> list[str]:
    """The chunks of a space and the text, in order."""
    if text.split() == text.replace("\n", " ").split(" ") and "\0" not in text:   # lone spaces and line feeds, no other white space
        return (" " + text).replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")[1:]
    return CHUNK_STARTS.split(" " + text)


def flat_ids(lists):
    """(all ids, how many each list has)."""
    sizes = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter(chain.from_iterable(lists), np.int64, int(sizes.sum())), sizes


class Aligner:
    """Aligned texts, from chunks that are remembered."""

    def __init__(self, pair: TokenizerPair):
        self.pair = pair
        self.forget()

    def forget(self):
        self.number, self.groups, self.characters = {}, [], 0
        self.counts, self.codes, self.begins = np.empty((0, 4), np.int64), np.empty(0, np.int64), np.zeros(1, np.int64)
        self.spelled = np.empty(0, bool)

    def learn(self, missing):
        """Append the chunks' groups, (n_a, n_b, n_groups, n_links), pair codes and whether both sides spell the chunk.

        The chunks stand one after the other on one line of bytes: between two neighbouring ends of tokens, of either side, one token of A and one
        of B overlap, and an end of both is the end of a group.
        """
        pair, raw = self.pair, [c.encode() for c in missing]
        (a, n_a), (b, n_b) = map(flat_ids, pair.ids(missing))
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        bytes_a, bytes_b = ([of[t] for t in ids.tolist()] for of, ids in ((pair.bytes_a, a), (pair.bytes_b, b)))
        length_a, length_b = pair.length_a[a], pair.length_b[b]
        chunk_a, chunk_b = (np.repeat(np.arange(len(raw)), n) for n in (n_a, n_b))
        even = (np.bincount(chunk_a, length_a, len(raw)) == sizes) & (np.bincount(chunk_b, length_b, len(raw)) == sizes)
        good, line = even, b"".join(raw)
        if not even.all() or b"".join(bytes_a) != line or b"".join(bytes_b) != line:   # some chunk is not spelled: look at each
            cut_a, cut_b = (np.concatenate([[0], np.cumsum(n)]) for n in (n_a, n_b))
            good = np.array([e and b"".join(bytes_a[cut_a[k]:cut_a[k + 1]]) == r == b"".join(bytes_b[cut_b[k]:cut_b[k + 1]]) for k, (e, r) in enumerate(zip(even.tolist(), raw))], bool)
            keep_a, keep_b = good[chunk_a], good[chunk_b]
            a, chunk_a, length_a, b, chunk_b, length_b = a[keep_a], chunk_a[keep_a], length_a[keep_a], b[keep_b], chunk_b[keep_b], length_b[keep_b]
        end_a, end_b = np.cumsum(length_a), np.cumsum(length_b)
        ends = np.union1d(end_a, end_b)
        at_a, at_b = np.searchsorted(end_a, ends), np.searchsorted(end_b, ends)
        link_chunk = chunk_a[at_a]
        closes_a, closes_b = np.isin(end_a, end_b, assume_unique=True), np.isin(end_b, end_a, assume_unique=True)
        group_a, group_b = np.cumsum(closes_a) - closes_a, np.cumsum(closes_b) - closes_b
        signs = np.concatenate([np.where(closes_a, pair.last_a[a], pair.text_a[a]), np.where(closes_b, pair.last_b[b], pair.text_b[b])])
        signs = signs[np.argsort(np.concatenate([group_a, group_b]), kind="stable")].tolist()
        counts = np.stack([np.bincount(x, minlength=len(raw)) for x in (chunk_a, chunk_b, chunk_a[closes_a], link_chunk)], axis=1)
        cuts = np.concatenate([[0], np.cumsum(counts[:, 0] + counts[:, 1])]).tolist()
        self.number.update(zip(missing, range(len(self.groups), len(self.groups) + len(missing))))
        self.groups += ["".join(signs[i:j]) for i, j in zip(cuts, cuts[1:])]
        self.characters += sum(map(len, missing))
        self.counts, self.codes = np.concatenate([self.counts, counts]), np.concatenate([self.codes, a[at_a] << B_BITS | b[at_b]])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(counts[:, 3])])
        self.spelled = np.concatenate([self.spelled, good])

    def aligned(self, texts):
        """(n_a, n_b, n_groups, n_links, groups, distinct pair codes, how often each is linked) of each text, None for one without tokens."""
        lists = [chunks_of(t) if t else [] for t in texts]
        wanted = set().union(*lists)
        missing = wanted.difference(self.number)
        if len(self.number) + len(missing) > CACHE_CHUNKS or self.characters > CACHE_CHARACTERS:
            self.forget()
            missing = wanted
        if missing:
            self.learn(list(missing))
        for chunks in lists:
            at = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
            if not len(at) or not self.spelled[at].all():
                yield None
                continue
            begins, sizes = self.begins[at], self.begins[at + 1] - self.begins[at]
            ends = np.cumsum(sizes)
            codes = self.codes[np.arange(ends[-1]) + np.repeat(begins - ends + sizes, sizes)]
            yield (*self.counts[at].sum(axis=0).tolist(), "".join([self.groups[k] for k in at.tolist()])[:-1], *np.unique(codes, return_counts=True))


def text_groups(texts):
    """Slices of whole texts of about ``CHARACTERS_AT_ONCE`` characters."""
    begin = held = 0
    for k, text in enumerate(texts):
        held += len(text or "")
        if held >= CHARACTERS_AT_ONCE:
            yield texts[begin:k + 1]
            begin, held = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


COUNTS = ("n_a", "n_b", "n_groups", "n_links")


def align_documents(df: DataFrame, json_path, model_path, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, same, same_n, pairs, pair_n) of every row.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids by group. ``same`` packs the distinct 32-bit ids of A that are linked to the id of the identity
    map, ``pairs`` the other distinct pairs as 64-bit numbers; ``same_n`` and ``pair_n`` pack how often each is linked, in 64 bits.
    """
    binary = ("same", "same_n", "pairs", "pair_n")
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("groups", pa.string()), *((c, pa.binary()) for c in binary)])
    without = (0, 0, 0, 0, "", b"", b"", b"", b"")

    def run(batches):
        pair = TokenizerPair(json_path, model_path)
        aligner = Aligner(pair)
        for batch in batches:
            rows = []
            for texts in text_groups(batch.column(1).to_pylist()):
                for done in aligner.aligned(texts):
                    if done is None:
                        rows.append(without)
                        continue
                    *head, codes, n = done
                    ids = codes >> B_BITS
                    follows = pair.same[ids] == codes & B_MASK
                    rows.append((*head, ids[follows].astype(np.int32).tobytes(), n[follows].tobytes(), codes[~follows].tobytes(), n[~follows].tobytes()))
            yield batch_of(schema, [batch.column(0), *(zip(*rows) if rows else [[] for _ in schema][1:])])

    ddl = "doc_id bigint, " + ", ".join(f"{c} bigint" for c in COUNTS) + ", groups string, " + ", ".join(f"{c} binary" for c in binary)
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, ddl)


def numbers(column, kind):
    """(all packed numbers of a binary column, how many each row has)."""
    raw = column.to_pylist()
    return np.frombuffer(b"".join(raw), kind), np.array([len(r) for r in raw], np.int64) // np.dtype(kind).itemsize


def summed(rows: DataFrame, column, kind, vocabulary) -> DataFrame:
    """(code, n): in how many rows each packed number is. Ids up to ``vocabulary`` are counted in vectors, other numbers (None) in bounded tables."""
    schema = pa.schema([("code", pa.int64()), ("n", pa.int64())])

    def in_vectors(batches):
        total = np.zeros(vocabulary, np.int64)
        for batch in batches:
            total += np.bincount(numbers(batch.column(0), kind)[0], minlength=vocabulary)
        held = np.nonzero(total)[0]
        yield batch_of(schema, [held, total[held]])

    def in_tables(batches):
        codes, n = np.empty(0, np.int64), np.empty(0, np.int64)
        for batch in batches:
            codes, at = np.unique(np.concatenate([codes, numbers(batch.column(0), kind)[0]]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, np.ones(len(at) - len(n), np.int64)]), len(codes)).astype(np.int64)
            if len(codes) > PAIRS_AT_ONCE:
                yield batch_of(schema, [codes, n])
                codes, n = codes[:0], n[:0]
        yield batch_of(schema, [codes, n])

    counted = rows.select(column).mapInArrow(in_vectors if vocabulary else in_tables, "code bigint, n bigint")
    return counted.groupBy("code").agg(F.sum("n").alias("n"))


def least_frequent(pairs: DataFrame, most: int) -> int:
    """Power of two such that at most ``most`` pairs have that count or more; 1 if all pairs are that few."""
    sizes = dict(map(tuple, pairs.groupBy(F.floor(F.log2("n")).alias("power")).count().collect()))   # at most 63 rows
    total, power = 0, max(sizes, default=0) + 1
    while power and total + sizes.get(power - 1, 0) <= most:
        power -= 1
        total += sizes.get(power, 0)
    return 1 << power


def with_link_counts(aligned: DataFrame, vocabulary: int, frequent=None) -> DataFrame:
    """The rows of ``align_documents`` with n_best and count_sum in place of the packed columns.

    A pair's count is the number of rows in which it is linked; ``n_best`` links have the highest count of their id of A (smaller than
    ``vocabulary``), ``count_sum`` adds the counts of all links. The driver and the tasks hold vectors of the vocabulary's length and at most
    ``frequent`` (by default ``FREQUENT``) pairs.
    """
    frequent = FREQUENT if frequent is None else frequent
    packed = ("same", "same_n", "pairs", "pair_n")
    kept = [c for c in aligned.columns if c not in packed]
    rows = written(aligned.withColumn("row_number", F.monotonically_increasing_id()), "aligned")   # numbers stay as they are written
    pairs = cut_lineage(summed(rows, "pairs", np.int64, None))
    same_count, best = np.zeros(vocabulary, np.int64), np.zeros(vocabulary, np.int64)
    known = summed(rows, "same", np.int32, vocabulary).toArrow()
    same_count[known["code"].to_numpy()] = known["n"].to_numpy()
    highest = pairs.groupBy(F.shiftright("code", B_BITS).alias("a")).agg(F.max("n").alias("n")).toArrow()   # at most a row per id of A
    best[highest["a"].to_numpy()] = highest["n"].to_numpy()
    best = np.maximum(best, same_count)
    least = least_frequent(pairs, frequent)
    table = pairs.filter(F.col("n") >= least).toArrow()
    order = np.argsort(table["code"].to_numpy())
    shared = rows.sparkSession.sparkContext.broadcast((same_count, best, table["code"].to_numpy()[order], table["n"].to_numpy()[order]))
    head = rows.select("row_number", *kept)
    added = [("n_best", pa.int64()), ("count_sum", pa.int64()), ("codes", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]

    def scored(batches):
        same_count, best, codes, counts = shared.value
        for batch in batches:
            n_best, count_sum = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)

            def add(row, a, n, links):
                np.add.at(n_best, row, np.where(n == best[a], links, 0))
                np.add.at(count_sum, row, n * links)

            first = batch.num_columns - len(packed)
            ids, sizes = numbers(batch.column(first), np.int32)
            add(np.repeat(np.arange(batch.num_rows), sizes), ids, same_count[ids], numbers(batch.column(first + 1), np.int64)[0])
            asked, sizes = numbers(batch.column(first + 2), np.int64)
            links, row = numbers(batch.column(first + 3), np.int64)[0], np.repeat(np.arange(batch.num_rows), sizes)
            at = np.minimum(np.searchsorted(codes, asked), max(len(codes) - 1, 0))
            hit = codes[at] == asked if len(codes) else np.zeros(len(asked), bool)
            add(row[hit], asked[hit] >> B_BITS, counts[at[hit]], links[hit])
            offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[~hit], minlength=batch.num_rows))]), pa.int32())
            left = [pa.ListArray.from_arrays(offsets, pa.array(x[~hit])) for x in (asked, links)]
            schema = pa.schema([*list(batch.schema)[:first], *added])
            yield batch_of(schema, [*batch.columns[:first], n_best, count_sum, *left])

    ddl = T.StructType([*head.schema.fields, *T.StructType.fromDDL("n_best bigint, count_sum bigint, codes array<bigint>, links array<bigint>").fields])
    whole = rows.select("row_number", *kept, *packed).mapInArrow(scored, ddl)
    if least == 1:   # the table holds every pair
        return whole.select(*kept, "n_best", "count_sum")
    whole = cut_lineage(whole)
    of_a = rows.sparkSession.createDataFrame(pa.table({"a": np.arange(vocabulary), "best": best}))
    rare = pairs.filter(F.col("n") < least).withColumn("a", F.shiftright("code", B_BITS)).join(F.broadcast(of_a), "a").select("code", "n", (F.col("n") == F.col("best")).alias("is_best"))
    asked = whole.select("row_number", F.inline(F.arrays_zip("codes", "links"))).withColumnRenamed("codes", "code")
    rest = (asked.join(rare, "code").groupBy("row_number")
            .agg(F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("n") * F.col("links")).alias("more_sum")))
    return (whole.join(rest, "row_number", "left")
            .select(*kept, (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum")))


def vocabulary_size(json_path) -> int:
    from tokenizers import Tokenizer
    return Tokenizer.from_file(json_path).get_vocab_size()
