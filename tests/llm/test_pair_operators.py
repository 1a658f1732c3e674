"""SimHash, components and vectors against brute force."""
import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from subsetlab.llm import components, simhash, vectors
from tests.llm import edge


def plain_fingerprint(text, size=3):
    words = edge.ASCII_WORD.findall(edge.lower(text))
    shingles = [" ".join(words[k:k + size]) for k in range(len(words) - size + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_near_duplicates_on_awkward_rows(spark):
    pick = random.Random(2)
    base = [f"w{pick.randint(0, 500)}" for _ in range(150)]
    rows = edge.awkward_rows()
    for k in range(40):
        words = list(base)
        for _ in range(k % 4):
            words[pick.randrange(150)] = f"v{pick.randint(0, 9)}"
        rows.append((1000 + k, " ".join(words)))
    prints = [plain_fingerprint(t or "") for _, t in rows]
    groups = edge.Groups()
    for i, a in enumerate(prints):
        for j in range(i + 1):
            if (a ^ prints[j]).bit_count() <= 3:
                groups.join(i, j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[groups.find(i)] = min(d, least.get(groups.find(i), d))
    want = [(d, prints[i].to_bytes(8, "little"), least.get(groups.find(i))) for i, (d, _) in enumerate(rows)]
    got = [(r.doc_id, bytes(r.fp), r.component_id) for r in simhash.near_duplicates(edge.frame(spark, rows), 3, 3).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert simhash.near_duplicates(edge.empty(spark), 3, 3).count() == 0


@pytest.mark.parametrize("width,radius,shard", [(1, 3, 4096), (1, 3, 7), (8, 84, 4096)])
def test_links_give_the_components_of_all_pairs(spark, monkeypatch, width, radius, shard):
    monkeypatch.setattr(simhash, "SHARD", shard)
    pick = np.random.default_rng(5)
    centres = pick.integers(0, 2 ** 63, (6, width), dtype=np.uint64)
    prints = centres[pick.integers(0, 6, 300)].copy()
    for _ in range(5 if width == 1 else 60):
        bit = pick.integers(0, 64 * width, 300)
        flip = pick.random(300) < 0.7
        prints[np.arange(300), bit // 64] ^= np.where(flip, np.uint64(1) << (bit % 64).astype(np.uint64), np.uint64(0))
    prints = np.unique(prints, axis=0)
    keys = simhash.shard_keys(prints)
    groups = edge.Groups()
    for i in range(len(prints)):
        groups.find(i)
        for j in range(i):
            near = np.bitwise_count(prints[i] ^ prints[j]).sum() <= radius
            assert width > 1 or not near or (keys[i] == keys[j]).any()
            if near and (keys[i] == keys[j]).any():
                groups.join(i, j)
    df = spark.createDataFrame([(p.tobytes(), k) for k, p in enumerate(prints)], "fp binary, node bigint").repartition(3)
    found = {r.node: r.component for r in components.connected_components(simhash.near_links(df, radius, width)).collect()}
    assert len(found) > 50 and all(found.get(k, k) == groups.find(k) for k in range(len(prints)))


def test_components_of_a_long_chain_a_star_and_no_links(spark):
    chain = [(k, k + 1) for k in range(300)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5)]
    found = {r.node: r.component for r in components.connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert {found[k] for k in range(301)} == {0} and {found[k] for k in range(1000, 1200)} == {1000}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_component_rounds_do_not_grow_the_planners_sizes(spark):
    links = spark.range(500).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    found = components.connected_components(links)
    assert found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes() < 2 ** 128   # a checkpoint's estimate triples its digits per round
    assert found.filter("component = 0").count() == 501


@pytest.mark.parametrize("shard", [2048, 25])
def test_vectors_against_all_pairs(spark, monkeypatch, shard):
    monkeypatch.setattr(vectors, "SHARD", shard)
    pick = np.random.default_rng(8)
    centres = pick.standard_normal((30, 48))
    rows = [(k, (centres[k % 30] + 0.25 * pick.standard_normal(48)).tolist()) for k in range(600)]
    rows += [(700, rows[0][1]), (701, rows[0][1]), (702, [2 * v for v in rows[1][1]]), (703, None), (704, []), (705, [0.0] * 48), (706, [float("nan")] * 48), (707, [None] + [1.0] * 47), (708, [1.0, 2.0]), (709, [1.0, 2.0]), (703, None)]
    df = spark.createDataFrame([(d, v, "label") for d, v in rows], "vec_id bigint, embedding array<double>, node string")
    usable = [(d, np.array(v)) for d, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    n, groups = {d: 0 for d, _ in rows}, edge.Groups()
    total = 0
    for i, (a, x) in enumerate(usable):
        for b, y in usable[:i]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                n[a], n[b], total = n[a] + 1, n[b] + 1, total + 1
                groups.join(a, b)
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    assert all(r.n_links <= n[r.vec_id] and r.component_id >= groups.find(r.vec_id) for r in got)
    assert sum(r.n_links for r in got) / 2 >= 0.95 * total > 1000
    assert vectors.near_vectors(df.limit(0)).count() == 0


def test_calibration_reaches_the_recall():
    for n in (100, 10_000, 10 ** 8):
        bits, tables, width, least = vectors.calibration(n)
        assert 1 - (1 - (1 - np.arccos(0.9) / np.pi) ** bits) ** tables >= vectors.RECALL and least >= 1 and width > 0


@pytest.mark.parametrize("split", [False, True])
def test_the_count_alone_decides_in_a_large_cell(split):
    pick = np.random.default_rng(3)
    x = pick.standard_normal((4000, 64))
    x[1::2] = x[::2] + 0.45 * pick.standard_normal((2000, 64))   # pairs at a cosine about the threshold
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    windows = x @ vectors.directions(8, 64, vectors.COUNTED)
    _, _, half_width, least = vectors.calibration(4000)
    rows = np.arange(4000)
    rows_a, rows_b = (rows[::2], rows[1::2]) if split else (rows, rows)
    got = {tuple(sorted(p)) for a, b in vectors.close_pairs(x, windows, rows_a, rows_b, half_width, least, 0.9) for p in zip(a.tolist(), b.tolist())}
    close = (x[::2] * x[1::2]).sum(axis=1) >= 0.9
    counted = (np.abs(windows[::2] - windows[1::2]) <= half_width).sum(axis=1) >= least
    assert got == {(2 * k, 2 * k + 1) for k in np.nonzero(close & counted)[0]}
    assert len(got) >= 0.98 * close.sum() > 500


def test_links_run_over_fingerprints_of_rows_without_id(spark, monkeypatch):
    """1 and 2 are apart but both near a row without id; another such row is near nothing."""
    chain = {"a": 0, "b": 0b111, "c": 0b111111, "d": 2 ** 60 - 1}
    rows = [(1, "a"), (None, "b"), (2, "c"), (None, "d"), (7, None)]
    monkeypatch.setattr(simhash, "fingerprint", lambda hashes, width: np.array([0 if not len(hashes) else int(hashes[0])], np.uint64))
    monkeypatch.setattr(simhash, "shingle_hashes", lambda text, size: np.array([chain[text.decode()]] if text else [], np.uint64))
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 3)
    assert sorted(map(repr, map(tuple, got.select("doc_id", "component_id").collect()))) == sorted(map(repr, [(1, 1), (None, 1), (2, 1), (None, None), (7, 1)]))


def test_one_id_on_two_vectors(spark):
    """Rows 5 (e1), 5 (e2), 6 (e1), 7 (near e1), 8 (near e2), and a row without id near e2."""
    rows = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (6, [1.0, 0.0, 0.0]), (7, [1.0, 0.0, 0.1]), (8, [0.0, 1.0, 0.1]), (None, [0.0, 1.0, 0.2]), (None, [0.0, 0.0, 1.0])]
    got = vectors.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, [(5, 2, 5), (5, 2, 5), (6, 2, 5), (7, 2, 5), (8, 2, 5), (None, 2, 5), (None, 0, None)]))
