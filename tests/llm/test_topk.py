"""Exact top-k search against all products."""
import numpy as np
import pytest

from subsetlab.llm import topk

SCHEMA = "vec_id bigint, embedding array<double>, packed string, score bigint, number int"


def plain(rows, k, every, scale=256):
    """Sorted (query_id, rank, vec_id, score) of all rows against all others."""
    usable = [(d, [int(np.floor(scale * x)) for x in v]) for d, v in rows if v is not None and None not in v and np.isfinite(v).all()]
    out = []
    for i, (q, x) in enumerate(usable):
        if q is None or q % every:
            continue
        scores = [(-sum(a * b for a, b in zip(x, y)), c is None, c) for j, (c, y) in enumerate(usable) if j != i and len(x) == len(y)]
        out += [(q, rank + 1, c, -s) for rank, (s, _, c) in enumerate(sorted(scores, key=lambda t: (t[0], t[1], t[2] or 0))[:k])]
    return sorted(out, key=repr)


def found(spark, rows, k=5, every=5):
    df = spark.createDataFrame([(d, v, "p", 1, 2) for d, v in rows], SCHEMA).repartition(3)
    return sorted(map(tuple, topk.top_products(df, lambda vec_id: vec_id % every == 0, k).collect()), key=repr)


def varied(pick, n, dims):
    """Vectors of very different lengths around few directions."""
    centres = pick.standard_normal((12, dims))
    x = centres[pick.integers(0, 12, n)] + 0.4 * pick.standard_normal((n, dims))
    return x / np.linalg.norm(x, axis=1, keepdims=True) * pick.lognormal(0, 1, (n, 1))


@pytest.mark.parametrize("block,cell,group", [(2048, 1 << 20, 1 << 22), (16, 100, 200)])
def test_against_all_products(spark, monkeypatch, block, cell, group):
    for name, value in (("BLOCK", block), ("CELL", cell), ("GROUP_COMPONENTS", group), ("LEAST_CELL", 50), ("SEED_COMPONENTS", 300)):
        monkeypatch.setattr(topk, name, value)
    rows = [(k, v.tolist()) for k, v in enumerate(varied(np.random.default_rng(1), 700, 12))]
    assert found(spark, rows) == plain(rows, 5, 5)


def test_ties_copies_repeated_rows_and_awkward_vectors(spark):
    base = varied(np.random.default_rng(2), 40, 8)
    rows = [(k, v.tolist()) for k, v in enumerate(base)]
    rows += [(100 + k, base[3].tolist()) for k in range(60)]                       # a large group of copies, some of them queries
    rows += [(5, base[5].tolist()), (5, base[6].tolist()), (10, base[10].tolist())]   # repeated rows, one id on two vectors
    rows += [(None, base[7].tolist()), (None, base[7].tolist()), (None, None), (200, None), (205, [1.0, None] + [0.0] * 6), (210, [float("inf")] + [0.0] * 7), (215, [float("nan")] * 8)]
    rows += [(220, []), (221, []), (225, [0.0] * 8), (230, [-5.0] * 8), (235, [1.0]), (240, [3.0, 4.0])]
    got = found(spark, rows)
    assert got == plain(rows, 5, 5)
    assert (220, 1, 221, 0) in got and not any(r[0] in (200, 205, 210, 215, 235, 240) for r in got)


def test_large_components_stay_exact(spark):
    pick = np.random.default_rng(3)
    rows = [(k, (pick.standard_normal(6) * 1e6).round(3).tolist()) for k in range(60)] + [(70, [1e300] * 6), (75, [9e6] * 6)]
    assert found(spark, rows) == plain([r for r in rows if r[0] != 70 and r[0] != 75], 5, 5)   # both are too long for 64-bit products


def test_few_rows_no_queries_and_an_empty_table(spark):
    assert found(spark, [(5, [1.0, 0.0]), (6, [0.5, 0.5]), (7, [0.0, -1.0])]) == [(5, 1, 6, 256 * 128), (5, 2, 7, 0)]
    assert found(spark, [(5, [1.0, 0.0])]) == [] == found(spark, [(6, [1.0]), (7, [1.0])])
    assert found(spark, []) == []


def test_buckets_and_coordinates_prune():
    pick = np.random.default_rng(4)
    x = varied(pick, 6000, 16)
    x = np.floor(256 * x[np.argsort(-np.linalg.norm(x, axis=1))]).astype(np.int32)
    queries = topk.Queries(range(50), [v.tobytes() for v in x[::120]], [topk.NONE] * 50, 5)
    for begin in range(0, 6000, topk.BLOCK):
        block = x[begin:begin + topk.BLOCK]
        queries.scan(np.arange(begin, begin + len(block)), np.zeros(len(block), bool), [v.tobytes() for v in block])
    all_scores = x[::120].astype(np.int64) @ x.T.astype(np.int64)
    assert np.array_equal(queries.score.reshape(50, 5), -np.sort(-all_scores, axis=1)[:, :5])
    assert queries.work["products"] < 0.6 * queries.work["pairs"]
