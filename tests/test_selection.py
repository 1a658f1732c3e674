"""Quotas, selections, calibration, clusters and overlap against brute force."""
import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from subsetlab.functions.ranking import hash_key
from subsetlab.operators import blocks, calibration, clusters, families, populations, rounds, selection, splits, strata
from subsetlab.session import settled


def quotas_of(spark, sizes, slots):
    rows = [(0, key, members, slots) for key, members in sizes.items()]
    table = strata.proportional_quotas(spark.createDataFrame(rows, "p int, stratum string, members long, slots int"), ["p"])
    return {r["stratum"]: r["quota"] for r in table.collect()}


def test_quotas_follow_string_order_on_equal_remainders(spark):
    assert quotas_of(spark, {"2": 5, "10": 5, "1": 10}, 2) == {"1": 1, "10": 1, "2": 0}
    assert quotas_of(spark, {"a": 1, "b": 1}, 5) == {"a": 1, "b": 1}
    assert sum(quotas_of(spark, {"x": 7, "y": 11, "z": 13}, 9).values()) == 9


def test_splits_match_combinations(spark):
    for runs, window in ((5, 2), (6, 3), (7, 1), (10, 4)):
        got = [tuple(r["train"]) for r in splits.temporal_splits(spark, runs, (window,)).orderBy("split").collect()]
        assert got == [c for c in itertools.combinations(range(runs), window) if c[-1] < runs - 1]
    with pytest.raises(ValueError):
        splits.training_sets(5, 5)


def test_large_strata_give_the_same_draws(spark, monkeypatch):
    members = spark.range(400).select(F.lit(0).alias("population"), F.lit(1).alias("window"), F.lit(0).alias("split"), F.lit("m").alias("method"),
                                      F.col("id").alias("instance"), F.when(F.col("id") < 300, "a").otherwise("b").alias("stratum"))
    keys = ["population", "window", "split", "method"]
    quotas = strata.stratum_quotas(members, keys, (0.1,))
    plain = {tuple(r) for r in selection.stratified_draws(members, quotas, 3).select("draw", "instance").collect()}
    monkeypatch.setattr(selection, "LARGE_STRATUM", 150)
    assert {tuple(r) for r in selection.stratified_draws(members, quotas, 3).select("draw", "instance").collect()} == plain
    assert len(plain) == 3 * 40


def test_shortfall_is_filled_from_the_rest(spark):
    members = spark.range(10).select(F.lit(0).alias("p"), F.col("id").alias("instance"))
    selected = members.where("instance < 3")
    slots = spark.createDataFrame([(0, 5)], "p int, slots int")
    filled = selection.fill_shortfall(selected, members, slots, ["p"], ["instance"])
    assert sorted(r["instance"] for r in filled.collect()) == [0, 1, 2, 3, 4]


def points(seed=3, n=40, d=5):
    data = np.round(np.random.default_rng(seed).normal(size=(n, d)), 3)
    data[7] = data[6]   # duplicate points
    return data


def distance_matrix(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


def brute(method, x, candidates, k):
    d, picked = distance_matrix(x), []
    best = lambda score: min((i for i in candidates if i not in picked), key=lambda i: (-round(score(i), 9), i))
    if method == "fl":
        positive = np.round(d, 9)
        width = np.median(positive[positive > 0])
        sim = np.exp(-d ** 2 / (2 * width ** 2))
    for number in range(k):
        if method == "ks":
            score = (lambda i: -d[i, candidates].sum()) if number == 0 else (lambda i: d[i, picked].min())
        elif method == "medoid":
            score = (lambda i: -d[:, i].sum()) if number == 0 else (lambda i: np.maximum(d[:, picked].min(axis=1) - d[:, i], 0).sum())
        else:
            score = (lambda i: 0.0) if number == 0 else (lambda i: np.maximum(sim[:, i] - sim[:, picked].max(axis=1), 0).sum())
        picked.append(best(score))
    return picked


@pytest.mark.parametrize("method", ["ks", "medoid", "fl"])
def test_greedy_rounds_equal_brute_force(spark, monkeypatch, method):
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 16)
    x = points()
    inside = list(range(0, 40, 2))
    rows = [(0, i, [float(v) for v in x[i]], i in inside, 6) for i in range(len(x))]
    members = spark.createDataFrame(rows, "g int, instance long, vector array<double>, in_group boolean, quota int")
    if method == "fl":
        members = members.join(blocks.median_positive_distance(members, ["g"]), "g")
    if method == "ks":
        members = members.where("in_group")
    picks = rounds.geometric_selection(members, ["g"], method).orderBy("pick").collect()
    assert [r["instance"] for r in picks] == brute(method, x, inside, 6)


def test_groups_without_enough_vectors_are_completed(spark):
    rows = [(0, i, [float(i)] if i in (4, 6) else None, True, 4) for i in range(8)]
    members = spark.createDataFrame(rows, "g int, instance long, vector array<double>, in_group boolean, quota int")
    picks = [r["instance"] for r in rounds.geometric_selection(members, ["g"], "centroid").orderBy("pick").collect()]
    assert picks == [4, 6, 0, 1]


def test_core_edge_takes_nine_tenths_from_the_core(spark):
    x = points(11, 60, 3)
    members = spark.createDataFrame([(0, i, [float(v) for v in x[i]], True, 20) for i in range(60)], "g int, instance long, vector array<double>, in_group boolean, quota int")
    chosen = {r["instance"] for r in rounds.geometric_selection(members, ["g"], "core_edge").collect()}
    order = np.lexsort((np.arange(60), np.round(np.linalg.norm(x - x.mean(axis=0), axis=1), 9)))
    core, rest = set(order[:18].tolist()), order[18:].tolist()
    d = distance_matrix(x)
    first = max(rest, key=lambda i: (round(np.linalg.norm(x[i] - x.mean(axis=0)), 9), -i))
    second = max((i for i in rest if i != first), key=lambda i: (round(d[i, first], 9), -i))
    assert chosen == core | {first, second}


def test_swap_plan_reaches_the_target_or_gives_up():
    leave, enter = calibration.swap_plan(2, {0: [1, 2], 1: [3]}, {1: [4], 2: [5]})
    assert (leave, enter) == ([1], [5])
    assert calibration.swap_plan(0, {0: [1]}, {1: [2]}) == ([], [])
    assert calibration.swap_plan(3, {2: [1]}, {1: [2]}) == ([], [])


def test_calibration_does_not_move_away_from_the_target(spark):
    members = spark.range(40).select(F.lit(0).alias("p"), F.col("id").alias("instance"), F.pmod(F.col("id") * 7, F.lit(4)).alias("passes"))
    picked = members.where("passes = 0").limit(8).withColumn("pick", F.col("instance").cast("int")).select("p", "instance", "pick")
    after = calibration.calibrate(picked, members, ["p"]).join(members, ["p", "instance"])
    assert after.count() == 8
    assert after.agg(F.sum("passes")).first()[0] == round(members.agg(F.sum("passes")).first()[0] * 8 / 40)


def test_kmeans_and_density_find_separated_groups(spark):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.normal(size=(30, 3)) * 0.1 + c for c in ([0, 0, 0], [8, 0, 0], [0, 8, 0])])
    table = spark.createDataFrame([(0, i, [float(v) for v in row], True) for i, row in enumerate(x)], "g int, instance long, vector array<double>, usable boolean")
    dense = clusters.density_labels(table, ["g"]).groupBy("cluster").agg(F.collect_set((F.col("instance") / 30).cast("int")).alias("s"), F.count("*").alias("n")).collect()
    assert {len(r["s"]) for r in dense} == {1} and len(dense) >= 3 and sum(r["n"] for r in dense) == 90
    labels = clusters.kmeans_labels(table, ["g"])
    assert labels.count() == 90 and labels.agg(F.max("silhouette")).first()[0] > 0.5
    small = clusters.cluster_strata(table.where("instance < 12"), ["g"], "kmeans")
    assert {r["stratum"] for r in small.collect()} == {"0"}


def test_greedy_independent_equals_brute_force(spark):
    rng = np.random.default_rng(9)
    sets = [set(rng.choice(60, size=20, replace=False).tolist()) for _ in range(25)]
    rows = [(p, 10, i) for p, s in enumerate(sets) for i in s]
    got = {r[0] for r in populations.greedy_independent(spark.createDataFrame(rows, "population int, level int, instance long")).collect()}
    kept = []
    for p, s in enumerate(sets):
        if all(len(s & sets[k]) / len(s | sets[k]) < 0.30 for k in kept):
            kept.append(p)
    assert got == set(kept)


def test_method_catalogue(spark):
    table = families.catalogue(spark)
    assert {r["family"]: r["n"] for r in table.groupBy("family").agg(F.count("*").alias("n")).collect()} == {
        "baselines": 7, "embedding_strata": 10, "pure_embedding": 20, "clustering": 16, "shortlist": 24}
    asked = spark.createDataFrame([("embedding_strata:fl_pooled",), ("random",), ("nonsense",)], "name string")
    chosen = families.chosen_methods(table, asked, 1).groupBy("family").agg(F.count("*").alias("n")).collect()
    assert {r["family"]: r["n"] for r in chosen} == {"baselines": 1, "embedding_strata": 1, "pure_embedding": 20, "clustering": 16, "shortlist": 24}
    assert [r["name"] for r in families.unknown_methods(table, asked).collect()] == ["nonsense"]
    assert math.isclose(sum(families.RATIOS.values()), 3.5)


def test_families_inside_strata_cover_the_whole_population(spark):
    x = points(21, 30, 4)
    rows = [(0, 1, 0, i, [float(v) for v in x[i]], str(i % 2), [i % 2, (i // 2) % 2], [1]) for i in range(30)]
    members = spark.createDataFrame(rows, "population int, window int, split int, instance long, vector array<double>, stratum string, outcomes array<int>, test array<int>")
    keys = ["population", "window", "split"]
    quotas = strata.stratum_quotas(members, keys, (0.2,)).select(*keys, "stratum", "subset", "quota")
    picks = rounds.geometric_selection(families.covering_rows(members, keys, quotas, True), [*keys, "stratum", "subset"], "fl").collect()
    for key in ("0", "1"):
        inside = [i for i in range(30) if i % 2 == int(key)]
        got = [r["instance"] for r in sorted((r for r in picks if r["stratum"] == key), key=lambda r: r["pick"])]
        assert got == brute("fl", x, inside, 3)
    rates = spark.createDataFrame([(0, [0.5, 0.5])], "population int, population_rates array<double>")
    errors = families.evaluate_within_strata(members, keys, "medoid", (0.2,), rates, 2).collect()
    assert len(errors) == 1 and 0.0 <= errors[0]["rmse"] <= 0.5


def clustered(seed, n, dims=6):
    pick = np.random.default_rng(seed)
    return pick.standard_normal((12, dims))[pick.integers(0, 12, n)] * 20 + pick.standard_normal((n, dims))


def test_farthest_first_skips_blocks_and_takes_several_picks_per_batch(spark, monkeypatch):
    """Text ids; many picks, far fewer batches, and most distances between picks and whole blocks are never computed."""
    x = clustered(31, 800)
    names = [f"p{i:04d}" for i in range(len(x))]
    rows = spark.createDataFrame([(0, names[i], v.tolist(), 40) for i, v in enumerate(x)], "g int, instance string, vector array<double>, quota int")
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 64)
    picks, visits = rounds.farthest_first_work(rows, ["g"])
    assert [r["instance"] for r in picks.orderBy("pick").collect()] == [names[i] for i in brute("ks", x, list(range(len(x))), 40)]
    seen = [v.first() for v in visits]
    assert len(seen) <= 20 and sum(v["skipped"] for v in seen) > 0.3 * sum(v["picks"] for v in seen)


@pytest.mark.parametrize("method", ["fl", "medoid"])
def test_lazy_greedy_takes_several_picks_per_batch(spark, method):
    x = clustered(32, 600)
    names = [f"p{i:04d}" for i in range(len(x))]
    rows = spark.createDataFrame([(0, names[i], v.tolist(), i % 3 > 0, 20) for i, v in enumerate(x)], "g int, instance string, vector array<double>, candidate boolean, quota int")
    d = distance_matrix(x)
    width = float(np.median(np.round(d, 9)[np.round(d, 9) > 0]))
    picks, batches = rounds.lazy_greedy_work(rows.withColumn("bandwidth", F.lit(width)), ["g"], method)
    assert [r["instance"] for r in picks.orderBy("pick").collect()] == [names[i] for i in brute(method, x, [i for i in range(len(x)) if i % 3], 20)]
    assert batches < 19   # picks after the first; these gains overlap strongly


def test_picks_without_proof_are_left_to_the_next_batch():
    """Gains 5, 4, 3 and 3.5 outside: the second candidate overlaps with the first, so only the first pick is sure."""
    gains = np.array([5.0, 4.0, 3.0])
    pairs = np.array([[5.0, 6.0, 8.0], [6.0, 4.0, 7.0], [8.0, 7.0, 3.0]])
    chosen, upper = rounds.certified_picks([1, 2, 3], gains, pairs, gains, 3.5, 3)
    assert chosen == [0] and upper.tolist() == [0.0, 1.0, 3.0]
    assert rounds.certified_picks([1, 2, 3], gains, pairs, gains, -np.inf, 3)[0] == [0, 2, 1]
    chosen, upper = rounds.certified_picks([1, 2, 3], gains, pairs[:2, :2], gains, -np.inf, 3)   # no pairs with the third: its gain of 3 is a bound
    assert chosen == [0] and upper.tolist() == [0.0, 1.0, 3.0]
    assert rounds.certified_picks([1, 2, 3], gains, pairs, gains + 1, 5.0, 3)[0] == []      # an equal bound outside, and no proof of a lower id
    assert rounds.certified_picks([1, 2, 3], gains, pairs, gains, 5.0, 3)[0] == [0]


def plain_kmeans(x, start):
    """Lloyd rounds until nothing moves; centres without points are dropped."""
    centres = np.array(start)
    while True:
        found = np.round(((x[:, None, :] - centres[None, :, :]) ** 2).sum(axis=2), 12).argmin(axis=1)
        new = np.stack([x[found == c].mean(axis=0) for c in np.unique(found)])
        if len(new) == len(centres) and (np.round(new, 6) == np.round(centres, 6)).all():
            return np.round(((x[:, None, :] - new[None, :, :]) ** 2).sum(axis=2), 12).argmin(axis=1)
        centres = new


def plain_silhouette(x, labels):
    """Mean silhouette over squared distances."""
    d, out = distance_matrix(x) ** 2, []
    for i, own in enumerate(labels):
        mine = labels == own
        others = [d[i, labels == c].mean() for c in np.unique(labels) if c != own]
        a, b = d[i, mine].sum() / max(mine.sum() - 1, 1), min(others, default=0.0)
        out.append((b - a) / max(a, b) if mine.sum() > 1 and others and max(a, b) > 0 else 0.0)
    return round(float(np.mean(out)), 9)


def test_kmeans_equals_plain_lloyd_rounds_and_sends_sums_only(spark, monkeypatch):
    """Two groups, one with equal points; blocks of 16 points. A round's map side sends a sum per cluster, not a row per point and K."""
    monkeypatch.setattr(clusters, "POINTS_OF_A_BLOCK", 16)
    sent, plain_sums = [], clusters._cluster_sums
    monkeypatch.setattr(clusters, "_cluster_sums", lambda *a: (sent.append(plain_sums(*a).count()), plain_sums(*a))[1])
    data = {"a": clustered(41, 150, 4), "b": np.repeat(clustered(42, 40, 4), 2, axis=0)}
    rows = [(g, f"p{i:03d}", v.tolist()) for g, x in data.items() for i, v in enumerate(x)]
    table = spark.createDataFrame(rows, "g string, instance string, vector array<double>")
    got = clusters.kmeans_labels(table, ["g"]).collect()
    hashed = table.withColumn("_h", hash_key("42", F.col("g"), F.col("instance"))).orderBy("g", "_h", "instance").collect()
    for g, x in data.items():
        start = [r["vector"] for r in hashed if r["g"] == g][:15]
        labels = {k: plain_kmeans(x, start[:k]) for k in range(2, min(int(np.sqrt(len(x) / 2)), 15) + 1)}
        scores = {k: plain_silhouette(x, v) for k, v in labels.items()}
        best = max(scores, key=lambda k: (scores[k], -k))
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["instance"])
        assert {r["k"] for r in mine} == {best} and math.isclose(mine[0]["silhouette"], scores[best], abs_tol=2e-9)
        pairs = {(r["cluster"], int(v)) for r, v in zip(mine, labels[best])}
        assert len(mine) == len(x) and len(pairs) == len({p for p, _ in pairs}) == len({v for _, v in pairs})
    assert max(sent) <= 4 * 2 * sum(range(2, 9))   # 4 tasks; before, 7 or 5 rows per point


@pytest.mark.parametrize("task_values, rounds_over_blocks", [(clusters.TASK_VALUES, 0), (600, 1)])
def test_kmeans_groups_of_bounded_size_rest_in_one_task(spark, monkeypatch, task_values, rounds_over_blocks):
    """Both ways give the plain labels; groups within the bound need no round over the blocks, in the second case one group is above it."""
    monkeypatch.setattr(clusters, "POINTS_OF_A_BLOCK", 16)
    monkeypatch.setattr(clusters, "TASK_VALUES", task_values)
    made, plain_moved = [], clusters._moved
    monkeypatch.setattr(clusters, "_moved", lambda *a: (made.append(1), plain_moved(*a))[1])
    data = {"a": clustered(43, 200, 5), "b": np.repeat(clustered(44, 30, 5), 4, axis=0)}
    table = spark.createDataFrame([(g, i, v.tolist()) for g, x in data.items() for i, v in enumerate(x)], "g string, instance long, vector array<double>")
    got = clusters.kmeans_labels(table, ["g"]).collect()
    assert bool(made) == bool(rounds_over_blocks)
    hashed = table.withColumn("_h", hash_key("42", F.col("g"), F.col("instance"))).orderBy("g", "_h", "instance").collect()
    for g, x in data.items():
        mine = sorted((r for r in got if r["g"] == g), key=lambda r: r["instance"])
        labels = plain_kmeans(x, [r["vector"] for r in hashed if r["g"] == g][:mine[0]["k"]])
        pairs = {(r["cluster"], int(v)) for r, v in zip(mine, labels)}
        assert len(mine) == len(x) and len(pairs) == len({p for p, _ in pairs}) == len({v for _, v in pairs})


def test_lloyd_passes_over_points_without_changing_the_labels():
    pick = np.random.default_rng(45)
    for x in (pick.standard_normal((3000, 8)), np.repeat(np.round(pick.standard_normal((40, 3))), 20, axis=0), clustered(46, 900, 4)):
        for k in (1, 2, 9, 15):
            centres, left = clusters.lloyd(x, x[:k])
            assert len(centres) == len(left) and (clusters.nearest_centres(x, centres) == plain_kmeans(x, x[:k])).all()


def test_grid_grows_with_the_cells_and_mirrored_pairs_count_twice(spark, monkeypatch):
    """About 128 blocks meet in 8 x 8 cells, so a block is copied 8 times (before: 16); the median over half the cells is that of all pairs."""
    monkeypatch.setattr(blocks, "BLOCK_ROWS", 4)
    x = np.round(clustered(51, 512, 3), 1)
    table = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(x)], "g int, instance long, vector array<double>")
    made = settled(blocks.to_blocks(table, ["g"]))
    grid = blocks._grid(made, made, ["g"]).first()
    n = made.count()
    assert n > 100 and max(grid["_rows"], grid["_columns"]) <= 8
    pairs = blocks.block_pairs(made, made, ["g"], mirrored=True)
    assert pairs.agg(F.sum(F.when(F.col("twice"), 2).otherwise(1))).first()[0] == n * n
    d = np.round(distance_matrix(x), 9)
    monkeypatch.setattr(blocks, "HELD", 100)   # tasks hand their counts on early
    assert math.isclose(blocks.median_positive_distance(table, ["g"]).first()["bandwidth"], np.median(d[d > 0]), abs_tol=2e-9)
