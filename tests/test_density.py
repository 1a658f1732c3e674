"""Hierarchical density clusters against a plain version that splits the tree from the top."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab.operators import blocks, density

SCHEMA = "g int, instance {}, vector array<double>"


def plain_tree(x, near):
    """(core distances, edges (weight, a, b) of the spanning tree) by Prim's rule."""
    d = np.round(np.array([np.sqrt(np.square(x - row).sum(axis=1)) for row in x]), 9)
    core = np.sort(d, axis=1)[:, near]
    w = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    inside, best, source, edges = {0}, w[0].copy(), np.zeros(len(x), int), []
    while len(inside) < len(x):
        best[list(inside)] = np.inf
        b = int(best.argmin())
        edges.append((best[b], int(source[b]), b))
        inside.add(b)
        source = np.where(w[b] < best, b, source)
        best = np.minimum(best, w[b])
    return core, edges


def pieces(nodes, edges):
    up = {v: v for v in nodes}

    def root(v):
        while up[v] != v:
            up[v] = up[up[v]]
            v = up[v]
        return v

    for _, a, b in edges:
        up[root(a)] = root(b)
    out = {}
    for v in nodes:
        out.setdefault(root(v), set()).add(v)
    return list(out.values())


def plain_clusters(x, least, near):
    """Sets of points of the chosen clusters, from the whole down: heaviest edges go first."""
    _, edges = plain_tree(x, near)
    clusters = []

    def grow(nodes, edges, birth, parent):
        number, total, born = len(clusters), 0.0, len(nodes)
        clusters.append(None)
        members, children, here, rest = set(nodes), [], nodes, edges
        while True:
            heaviest = max(w for w, _, _ in rest)
            rest = [e for e in rest if e[0] < heaviest]
            parts = pieces(here, rest)
            large = [p for p in parts if len(p) >= least]
            inverse = 1 / max(heaviest, density.LEAST_WEIGHT)
            if len(large) == 1:
                total += (len(here) - len(large[0])) * inverse
                here = large[0]
                rest = [e for e in rest if e[1] in here]
                continue
            total += len(here) * inverse
            children = [grow(p, [e for e in rest if e[1] in p], inverse, number) for p in large]
            break
        clusters[number] = {"members": members, "value": total - born * birth, "children": children, "root": parent is None}
        return number

    grow(set(range(len(x))), edges, 0.0, None)
    picked = {}

    def choose(c):
        below = sum(choose(k) for k in clusters[c]["children"])
        own = clusters[c]["value"]
        if not clusters[c]["root"] and (not clusters[c]["children"] or own >= below):
            picked[c] = True
            return own
        return below

    choose(0)
    out, stack = [], [0]
    while stack:
        c = stack.pop()
        if picked.get(c):
            out.append(clusters[c]["members"])
        else:
            stack += clusters[c]["children"]
    return out


def plain_labels(x):
    least = max(5, len(x) // 20)
    found = sorted(plain_clusters(x, least, max(2, least // 2)), key=min)
    labels = np.full(len(x), -1)
    for k, members in enumerate(found):
        labels[list(members)] = k
    if not found:
        return np.zeros(len(x), int)
    centres = np.array([x[labels == k].mean(axis=0) for k in range(len(found))])
    for i in np.nonzero(labels < 0)[0]:
        labels[i] = np.round(np.sqrt(np.square(centres - x[i]).sum(axis=1)), 9).argmin()
    return labels


def shapes(seed, n, dims=2):
    """Blobs of different density, a ring and noise."""
    pick = np.random.default_rng(seed)
    parts = [pick.normal(c, s, (n // 6, dims)) for c, s in ((0, 0.2), (4, 0.5), (-5, 1.0), (9, 0.1))]
    angle = pick.uniform(0, 6.3, n // 6)
    ring = np.zeros((n // 6, dims))
    ring[:, 0], ring[:, 1] = 20 + 3 * np.cos(angle), 3 * np.sin(angle)
    parts += [ring + pick.normal(0, 0.1, ring.shape)]
    return np.vstack([*parts, pick.uniform(-10, 25, (n - 5 * (n // 6), dims))])


@pytest.mark.parametrize("band,rows", [(100_000, 2048), (60, 70)])
def test_labels_equal_the_plain_version_in_every_group(spark, monkeypatch, band, rows):
    monkeypatch.setattr(density, "BAND", band)
    monkeypatch.setattr(blocks, "CELL_ROWS", rows)
    groups = {0: shapes(1, 240), 1: shapes(2, 90, 3), 2: np.random.default_rng(3).normal(size=(60, 4)), 3: np.repeat(shapes(4, 30), 2, axis=0), 4: np.zeros((25, 2))}
    data = [(g, f"p{i:03d}", row.tolist()) for g, x in groups.items() for i, row in enumerate(x)] + [(9, f"q{i}", [0.0, 1.0]) for i in range(19)]
    got = density.density_labels(spark.createDataFrame(data, SCHEMA.format("string")), ["g"]).collect()
    found = {}
    for r in got:
        found.setdefault(r["g"], {})[r["instance"]] = r["cluster"]
    assert set(found) == set(groups)
    for g, x in groups.items():
        want = plain_labels(x)
        assert [found[g][f"p{i:03d}"] for i in range(len(x))] == want.tolist(), g
    assert len(set(found[0].values())) >= 4


def test_two_thousand_points(spark):
    x = shapes(7, 2000, 3)
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], SCHEMA.format("long"))
    labels = {r["instance"]: r["cluster"] for r in density.density_labels(rows, ["g"]).collect()}
    assert [labels[i] for i in range(2000)] == plain_labels(x).tolist()


def test_core_distances_and_tree_weight(spark, monkeypatch):
    monkeypatch.setattr(density, "CUTS", 16)
    monkeypatch.setattr(density, "COLLECTED", 2)
    x = np.vstack([shapes(5, 120), np.repeat(shapes(6, 6), 5, axis=0)])
    rows = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], SCHEMA.format("long")).withColumn("near", F.lit(4)).withColumn("size", F.lit(len(x)))
    core = density.core_distances(rows, ["g"])
    want, edges = plain_tree(x, 4)
    got = {r["instance"]: r["core"] for r in core.collect()}
    assert np.allclose([got[i] for i in range(len(x))], want, atol=1e-12)
    tree = density.spanning_tree(rows.join(core, ["g", "instance"]), ["g"]).collect()
    assert len(tree) == len(x) - 1
    assert np.allclose(sorted(r["weight"] for r in tree), sorted(w for w, _, _ in edges))


def test_grid_of_rows_grows_with_the_cells(spark):
    """60,000 rows of 64 numbers meet in 4 x 4 cells (before: 30 x 30); wide vectors and very large groups keep the cells bounded."""
    sides = lambda size, width: spark.range(1).select(blocks.row_sides(F.lit(size), F.lit(width))).first()[0]
    assert [sides(n, 64) for n in (1, 2048, 2049, 10_000, 60_000, 600_000)] == [1, 1, 2, 4, 4, 19]
    assert sides(60_000, 4096) == 30


def test_lightest_edges_of_both_sides_have_the_same_exact_weight():
    """Far from the origin, where a product loses digits, and with copies: both sides of a cut see the plain weight, ends included."""
    pick = np.random.default_rng(9)
    x, y = (np.vstack([v, v[:5]]) + 300 for v in (pick.standard_normal((60, 8)), pick.standard_normal((80, 8))))
    core, cores = pick.uniform(0, 2, len(x)), pick.uniform(0, 2, len(y))
    a, b = np.arange(len(x)), np.arange(len(y)) + 1000
    d = np.array([np.sqrt(np.square(y - row).sum(axis=1)) for row in x])
    plain = np.round(np.maximum(np.maximum(d, core[:, None]), cores[None, :]), 9)
    one = density.lightest_edges(np.zeros(len(x), int), np.ones(len(y), int), core, cores, a, b, x, y)
    back = density.lightest_edges(np.ones(len(y), int), np.zeros(len(x), int), cores, core, b, a, y, x)
    i, j = min(zip(*np.nonzero(plain == plain.min())))
    for found in (one, back):
        assert found[["weight", "a", "b"]].values.tolist() == [[plain.min(), i, j + 1000]]
    each = density.lightest_edges(a, b, core, cores, a, b, x, y)
    assert (each["weight"].to_numpy() == plain.min(axis=1)).all()
