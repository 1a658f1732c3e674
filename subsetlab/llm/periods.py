"""Periodic runs of words by a dictionary of basic factors.

Basic factors are the stretches of 1, 2, 4, .. words of a text; equal ones get equal names, and the names of one length are made from pairs of
names of half the length. For each length every occurrence looks at its successors, the next occurrences of the same factor, within twice
the length. Where two of them follow at equal distances, they form an arithmetic progression and propose their distance as a period; neighbouring
proposals are one stretch, which is extended word by word to both sides, and the same run found at several lengths is kept once. Factors that
occur once in a text are in no progression of a longer length either, so only repeated ones go on to the next length.

A run is a stretch of words with smallest period q and at least max(``LEAST_WORDS``, ``LEAST_PERIODS`` * q) words that no neighbour extends.
With factors of m words, q <= m < 2q, a run of 4q words holds a factor and its next two occurrences, at distance q exactly: every run is proposed.

Texts are independent rows; a text has to fit in a task. Defined results: a null, empty or blank text has no words, no runs and an empty
collapsed text; repeated rows give repeated rows; a row without id is treated like any other; an empty table gives an empty table; other
columns are ignored, whatever their names.
"""
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subsetlab.llm.common import batch_of

LEAST_WORDS, LEAST_PERIODS = 6, 4
WORDS_AT_ONCE = 500_000   # words of whole texts whose factors are named together


def dense(names: np.ndarray):
    """(names from 0, how often each occurs)."""
    _, inverse, counts = np.unique(names, return_inverse=True, return_counts=True)
    return inverse, counts


def proposals(at: np.ndarray, names: np.ndarray, length: int, n: int):
    """(start, end, period) of stretches proposed by the successors of the factors of ``length`` words at the ascending places ``at``."""
    order = np.argsort(names, kind="stable")
    place, name = at[order], names[order]
    follows = np.nonzero(name[1:] == name[:-1])[0]
    gap = np.zeros(n, np.int64)                              # to the next occurrence
    gap[place[follows]] = place[follows + 1] - place[follows]
    near = at[(gap[at] > 0) & (gap[at] <= length)]           # then the one after it is within twice the length
    near = near[gap[near + gap[near]] == gap[near]]
    period = gap[near]
    order = np.lexsort((near, period))
    near, period = near[order], period[order]
    begins = np.ones(len(near), bool)
    begins[1:] = (period[1:] != period[:-1]) | (near[1:] != near[:-1] + 1)
    ends = np.append(begins[1:], True)[:len(near)]
    return near[begins], near[ends] + 2 * period[begins] + length, period[begins]


def extended(words: np.ndarray, start, end, period):
    """The stretches with every neighbour that keeps the period."""
    n = len(words)
    while True:
        left = np.nonzero((start > 0) & (words[np.maximum(start - 1, 0)] == words[np.maximum(start - 1, 0) + period]))[0]
        right = np.nonzero((end < n) & (words[np.minimum(end, n - 1)] == words[np.minimum(end, n - 1) - period]))[0]
        if not len(left) and not len(right):
            return start, end, period
        start[left] -= 1
        end[right] += 1


def runs_of(words: np.ndarray):
    """(start, length, period) of all runs, by start and period. ``words`` numbers the words of one or more texts; texts share no number."""
    n = len(words)
    names, counts = dense(words)
    at = np.nonzero(counts[names] > 1)[0]
    names, length, found = names[at], 1, []
    while len(at):
        found.append(proposals(at, names, length, n))
        name_at = np.full(n + length, -1, np.int64)
        name_at[at] = names
        second = name_at[at + length]
        joined = names * n + second
        at, joined = at[second >= 0], joined[second >= 0]
        names, counts = dense(joined)
        again = counts[names] > 1
        at, names, length = at[again], names[again], 2 * length
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, end, period = extended(words, *(np.concatenate(x) for x in zip(*found)))
    enough = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * period)
    runs = np.unique(np.stack([start[enough], period[enough], end[enough]], axis=1), axis=0)
    return runs[:, 0], runs[:, 2] - runs[:, 0], runs[:, 1]


def kept_words(n: int, start, length, period) -> np.ndarray:
    """False for the words that some run contains after its first period."""
    cover = np.bincount(start + period, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(cover)[:n] == 0


def collapse(texts):
    """(number of words, (start, length, period), collapsed text) of each text, as UTF-8 bytes."""
    number = {}
    fresh = count()
    numbered, joined = [], []
    for text in texts:
        words = text.split()   # of bytes: ASCII white space alone
        numbered.append(np.fromiter((number[w] if w in number else number.setdefault(w, next(fresh)) for w in words), np.int64, len(words)))
        joined.append(b" ".join(words))
    sizes = np.array([len(w) for w in numbered], np.int64)
    ends = np.cumsum(sizes)
    text_of = np.repeat(np.arange(len(texts)), sizes)
    start, length, period = runs_of(np.concatenate([*numbered, np.empty(0, np.int64)]) + text_of * max(1, len(number)))
    cut = np.searchsorted(start, np.concatenate([[0], ends]))
    out = []
    for k, (text, n) in enumerate(zip(joined, sizes.tolist())):
        mine = slice(cut[k], cut[k + 1])
        runs = start[mine] - (ends[k] - n), length[mine], period[mine]
        if len(runs[0]):
            kept = kept_words(n, *runs)
            text = b" ".join([w for w, keep in zip(text.split(b" "), kept.tolist()) if keep])
        out.append((n, runs, text))
    return out


def groups_of(texts, sizes):
    """Slices of whole texts of about ``WORDS_AT_ONCE`` words (at most as many as bytes, halved)."""
    begin = held = 0
    for k, size in enumerate(sizes):
        held += size // 2
        if held >= WORDS_AT_ONCE:
            yield texts[begin:k + 1]
            begin, held = k + 1, 0
    if begin < len(texts):
        yield texts[begin:]


def periodic_runs(df: DataFrame, id_col="doc_id", text_col="text") -> DataFrame:
    """(doc_id, n_words, runs array of (start, length, period) by start and period, collapsed text) of every row."""
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(run_type)), ("collapsed", pa.string())])

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            done = [row for some in groups_of(texts, [len(t) for t in texts]) for row in collapse(some)]
            offsets = np.cumsum([0] + [len(runs[0]) for _, runs, _ in done])
            fields = [pa.array(np.concatenate([runs[f] for _, runs, _ in done] + [np.empty(0, np.int64)])) for f in range(3)]
            runs = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(run_type)))
            yield batch_of(schema, [batch.column(0), [n for n, _, _ in done], runs, pa.array([t for _, _, t in done], pa.binary()).cast(pa.string())])

    return (df.select(F.col(id_col).cast("long").alias("doc_id"), F.encode(F.coalesce(F.col(text_col), F.lit("")), "UTF-8").alias("text"))
            .mapInArrow(run, "doc_id bigint, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"))
