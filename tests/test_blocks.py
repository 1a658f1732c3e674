"""Distances of blocks taken from a product of matrices."""
import time

import numpy as np

from subsetlab.operators import blocks


def test_product_distances_are_the_measured_ones():
    rng = np.random.default_rng(3)
    a, b = rng.normal(size=(70, 16)), rng.normal(size=(90, 16))
    b[:20] = a[:20]                                    # copies
    b[20:40] = a[20:40] + 1e-9 * rng.normal(size=(20, 16))   # far below what a product can tell apart
    b[40:60] = 1e6 + b[40:60]
    a[40:60] = 1e6 + a[40:60]                          # near each other, far from the origin
    got, want = blocks.product_distances(a, b), blocks.distances(a, b)
    np.testing.assert_allclose(got, want, rtol=1e-12, atol=1e-15)
    assert (got[np.arange(20), np.arange(20)] == 0).all()


def test_zero_and_not_finite_vectors_are_measured_directly():
    a, b = np.array([[0.0, 0.0], [np.inf, 1.0], [np.nan, 1.0], [3.0, 4.0]]), np.array([[0.0, 0.0], [np.inf, 0.0], [1.0, 1.0]])
    with np.errstate(invalid="ignore"):
        np.testing.assert_array_equal(blocks.product_distances(a, b), blocks.distances(a, b))


def test_product_distances_take_a_fraction_of_the_time():
    a = np.random.default_rng(4).normal(size=(512, 64))

    def seconds(function):
        times = []
        for _ in range(5):
            started = time.perf_counter()
            function(a, a + 3.0)
            times.append(time.perf_counter() - started)
        return min(times)

    assert 2 * seconds(blocks.product_distances) < seconds(blocks.distances)


def test_pairs_meet_in_larger_blocks_with_the_same_sums(spark, monkeypatch):
    """300 rows in blocks of about 64 make at most 36 pairs (before: blocks of 16, over 300 pairs); sums and median are the plain ones."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    x = np.random.default_rng(4).standard_normal((300, 5))
    table = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, instance long, vector array<double>")
    met, plain = [], blocks.block_pairs
    monkeypatch.setattr(blocks, "block_pairs", lambda *a, **b: (met.append(plain(*a, **b).count()), plain(*a, **b))[1])
    d = np.sqrt(np.square(x[:, None, :] - x[None, :, :]).sum(axis=2))
    found = {r["instance"]: r["total_distance"] for r in blocks.total_distances(table, table, ["g"]).collect()}
    assert np.allclose([found[i] for i in range(len(x))], d.sum(axis=1), rtol=1e-12)
    assert abs(blocks.median_positive_distance(table, ["g"]).first()["bandwidth"] - np.median(d[d > 0])) < 2e-9
    assert met and max(met) <= 36
