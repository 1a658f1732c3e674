"""Periodic runs against a plain search of every period, and the query against a plain version of its contract."""
import random
import zlib
from fractions import Fraction

from subsetlab.llm import periods, queries_periods
from tests.conftest import FOLDER
from tests.llm import edge


def plain_runs(words):
    """(start, length, period) of every run, period by period."""
    n, out = len(words), []
    for q in range(1, n // periods.LEAST_PERIODS + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            smaller = any(all(words[x] == words[x + r] for x in range(start, start + length - r)) for r in range(1, q))
            if length >= max(6, 4 * q) and not smaller:
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plain_kept(words, runs):
    dropped = {x for start, length, q in runs for x in range(start + q, start + length)}
    return " ".join(w for x, w in enumerate(words) if x not in dropped)


def test_runs_of_many_small_texts():
    pick = random.Random(4)
    texts = []
    for _ in range(500):
        words = []
        while len(words) < pick.randint(0, 80):
            unit = [pick.choice("abc") for _ in range(pick.randint(1, 6))]
            words += unit * pick.randint(1, 6) + unit[:pick.randint(0, len(unit))] if pick.random() < 0.6 else [pick.choice("abcd")]
        texts.append(words)
    total = 0
    for words, (n, runs, kept) in zip(texts, periods.collapse([" ".join(w).encode() for w in texts])):
        want = plain_runs(words)
        total += len(want)
        assert n == len(words) and list(zip(*(x.tolist() for x in runs))) == want and kept.decode() == plain_kept(words, want)
    assert total > 300


def test_runs_inside_runs_and_texts_of_equal_words():
    inner = "a a a a a a b".split() * 5
    texts = [inner, ["x"] * 40, ["x"] * 40, ["x"] * 5, "a b".split() * 3, "a b".split() * 4]
    for words, (_, runs, _) in zip(texts, periods.collapse([" ".join(w).encode() for w in texts])):
        assert list(zip(*(x.tolist() for x in runs))) == plain_runs(words)


def test_awkward_rows(spark):
    rows = [*edge.awkward_rows(), (90, "a b " * 50_000), (91, " ".join(f"w{k}" for k in range(60_000))), (92, "é é " * 9), (None, "k " * 9)]
    got = periods.periodic_runs(edge.frame(spark, rows)).collect()
    want = []
    for d, t in rows:
        words = edge.ASCII_WORD.findall(t or "")
        runs = [(0, 100_000, 2)] if d == 90 else [] if d == 91 else plain_runs(words)
        want.append((d, len(words), runs, plain_kept(words, runs)))
    key = repr
    assert sorted(((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got), key=key) == sorted(want, key=key)
    assert periods.periodic_runs(edge.empty(spark)).count() == 0


def plain_query(doc_id, text):
    words = edge.ASCII_WORD.findall(text or "")
    n, h = len(words), 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    runs = plain_runs(words)
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    return (doc_id, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, edge.sha(lines), edge.sha(plain_kept(words, runs)))


def test_query_on_whole_documents_and_on_awkward_rows(spark, tmp_path):
    edge.frame(spark, [*edge.awkward_rows(), *((k, "p q r s t u v w " * 4) for k in range(100, 160))]).write.parquet(f"{tmp_path}/documents.parquet")
    for folder in (str(tmp_path), "/root/testdata/sf0.001"):
        docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
        docs = [(d, t) for d, t in docs if t is None or len(t) < 12_000]
        got = {repr(tuple(r)) for r in queries_periods.op13_periodic_runs(spark, folder).collect()}
        want = [plain_query(d, t) for d, t in docs]
        assert {repr(w) for w in want} <= got
        assert sum(w[1] > 0 for w in want) > 5
    assert queries_periods.op13_periodic_runs(spark, FOLDER).count() == 1000
