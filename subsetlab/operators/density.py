"""Hierarchical density clusters of all groups of a table: core distances, a minimum spanning tree over mutual reachability, a condensed tree.

* The core distance of a point is the distance to its k-th neighbour, found by counting: per pass every point has a bracket cut into
  ``CUTS`` intervals, the cells of a grid over the rows return counts, and the interval with the k-th distance is the next bracket.
* The tree grows in rounds: every component takes its lightest edge to another one, weights being max(core, core, distance), so their number at
  least halves. A cell returns one edge per component that it holds.
* The condensed tree is built from the lightest edge on, in bands of at most about ``BAND`` edges; between bands only the components that a
  band touches travel. Components below the minimum size are no clusters; what joins a cluster later falls out of it at that weight. Of all
  clusters but the root those with the greatest stability are chosen. Edges of equal weight act together, so ties do not matter.

Points outside the chosen clusters go to the nearest cluster centre.
"""
import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.vector_udfs import euclidean
from ..session import settled
from .blocks import cogrouped, pair_distances, product_distances, row_sweep

MIN_TO_CLUSTER = 20
CUTS = 64
COLLECTED = 64          # distances per point that the last pass returns at most, besides equal ones
DIGITS = 9              # distances are compared rounded
BAND = 100_000
JUMPS = 3               # doublings of the way to a root per job
BAND_IDS = 1_000_000    # cluster numbers of one band
LEAST_WEIGHT = 1e-9     # of an edge, so that its inverse is finite
MARGIN, SHARE = 4e-9, 1e-11   # distances from products of matrices are nearer than this, and this share of them, to the rounded ones


def _keyed(df: DataFrame, keys, *fields) -> StructType:
    return StructType([*[df.schema[k] for k in keys], *[StructField(name, kind()) for name, kind in fields]])


def _slack(d):
    return MARGIN + SHARE * np.abs(d)


def core_distances(rows: DataFrame, keys) -> DataFrame:
    """(keys, instance, core): distance to the neighbour number ``near`` of the row's group of ``size`` rows, exact to nine digits. ``instance`` is a number."""
    keys = list(keys)
    rows = rows.select(*keys, "instance", "vector", "size", F.col("near").cast("double").alias("near"))
    centre = rows.groupBy(*keys).agg(Summarizer.mean(array_to_vector("vector")).alias("_c")).withColumn("_c", vector_to_array("_c"))
    far = rows.join(centre, keys).groupBy(*keys).agg((2 * F.max(euclidean(F.col("vector"), F.col("_c"))) + 1).alias("high"))
    right = rows.select(*keys, "instance", "vector", "size")
    state = settled(rows.join(far, keys).withColumn("low", F.lit(0.0)))
    edges = [f"c{j}" for j in range(CUTS + 1)]
    counts = _keyed(rows, keys, ("instance", LongType), *[(e, LongType) for e in edges])
    cuts = CUTS

    def count(lefts, rights, x, y):
        low, high = lefts["low"].to_numpy(), lefts["high"].to_numpy()
        at = low[:, None] + (high - low)[:, None] * np.arange(cuts + 1) / cuts
        below = np.array([np.searchsorted(d, c) for d, c in zip(np.sort(product_distances(x, y), axis=1), at)])
        return pd.DataFrame(below, columns=edges).assign(instance=lefts["instance"].to_numpy())

    while True:
        found = row_sweep(state, right, keys, count, counts).groupBy(*keys, "instance").agg(*[F.sum(e).alias(e) for e in edges])
        listed = state.join(found, [*keys, "instance"]).withColumn("_c", F.array(*edges)).drop(*edges)
        listed = listed.withColumn("_at", F.size(F.filter("_c", lambda c: c <= F.col("near"))) - 1)   # the last cut with at most ``near`` distances below it
        step = (F.col("high") - F.col("low")) / CUTS
        state = settled(listed.select(*keys, "instance", "vector", "size", "near", (F.col("low") + step * F.col("_at")).alias("low"), (F.col("low") + step * (F.col("_at") + 1)).alias("high"),
                                          F.get("_c", F.col("_at")).alias("before"), (F.get("_c", F.col("_at") + 1) - F.get("_c", F.col("_at"))).alias("inside")))
        if state.where((F.col("inside") > COLLECTED) & (F.col("high") - F.col("low") > 10.0 ** -DIGITS)).isEmpty():
            break
    values = _keyed(rows, keys, ("instance", LongType), ("value", DoubleType), ("n", LongType))

    def collect(lefts, rights, x, y):
        """Distances inside the bracket, widened by the margin and measured pair by pair, and, with the value below it, how many there are before."""
        d, low, high = product_distances(x, y), lefts["low"].to_numpy()[:, None], lefts["high"].to_numpy()[:, None]
        before = d < low - _slack(low)
        i, j = np.nonzero((d < high + _slack(high)) & ~before)
        found = pd.DataFrame({"instance": lefts["instance"].to_numpy()[i], "value": np.round(pair_distances(x[i], y[j]), DIGITS)})
        found = found.groupby(["instance", "value"], sort=False).size().rename("n").reset_index()
        return pd.concat([found, pd.DataFrame({"instance": lefts["instance"].to_numpy(), "value": -1.0, "n": before.sum(axis=1)})], ignore_index=True)

    inside = row_sweep(state, right, keys, collect, values).groupBy(*keys, "instance", "value").agg(F.sum("n").alias("n"))
    running = Window.partitionBy(*keys, "instance").orderBy("value")   # the value -1 stands for all below the bracket
    placed = inside.join(state.select(*keys, "instance", "near"), [*keys, "instance"]).withColumn("_upto", F.sum("n").over(running))
    return placed.where((F.col("_upto") > F.col("near")) & (F.col("value") >= 0)).groupBy(*keys, "instance").agg(F.min("value").alias("core"))


def lightest_edges(own, other, core, cores, a, b, x, y):
    """Per component of ``own`` the lightest edge to another one: frame (component, to, weight, a, b); ties by the smaller, then the larger end.

    A product of matrices leaves the edges that can be the lightest; of these, distances that decide are measured pair by pair, so that both
    ends of an edge see the same weight.
    """
    near = product_distances(x, y)
    weights = np.maximum(near, np.maximum(core[:, None], cores[None, :]))
    weights[own[:, None] == other[None, :]] = np.inf
    row_least = weights.min(axis=1)
    groups, of = np.unique(own, return_inverse=True)
    least = np.full(len(groups), np.inf)
    np.minimum.at(least, of, row_least)
    most = (least + _slack(least))[of]
    rows = np.flatnonzero(np.isfinite(row_least) & (row_least <= most))
    i, j = np.nonzero(weights[rows] <= most[rows][:, None])
    i = rows[i]
    exact = np.maximum(core[i], cores[j])
    unsure = np.flatnonzero(near[i, j] > exact - _slack(exact))
    exact[unsure] = np.maximum(exact[unsure], pair_distances(x[i[unsure]], y[j[unsure]]))
    exact = np.round(exact, DIGITS)
    low, high = np.minimum(a[i], b[j]), np.maximum(a[i], b[j])
    order = np.lexsort((high, low, exact, own[i]))
    i, j, low, high, exact = i[order], j[order], low[order], high[order], exact[order]
    first = np.append(True, own[i][1:] != own[i][:-1])[:len(i)]
    return pd.DataFrame({"component": own[i][first], "to": other[j][first], "weight": exact[first], "a": low[first], "b": high[first]})


def spanning_tree(rows: DataFrame, keys) -> DataFrame:
    """(keys, a, b, weight): the edges of every group's minimum spanning tree over max(core, core, distance).

    ``rows`` has keys, instance (a number), vector, core and ``size`` of the group.
    """
    keys = list(keys)
    rows = settled(rows.select(*keys, "instance", "vector", "core", "size"))
    labels = rows.select(*keys, "instance", F.col("instance").alias("component"))
    schema = _keyed(rows, keys, ("component", LongType), ("to", LongType), ("weight", DoubleType), ("a", LongType), ("b", LongType))
    rounds = []

    def lightest(lefts, rights, x, y):
        columns = [frame[name].to_numpy() for name in ("component", "core", "instance") for frame in (lefts, rights)]
        return lightest_edges(*columns, x, y)

    while True:
        here = rows.join(labels, [*keys, "instance"])
        best = row_sweep(here, here, keys, lightest, schema).groupBy(*keys, "component").agg(F.min(F.struct("weight", "a", "b", "to")).alias("e"))
        best = settled(best.select(*keys, "component", "e.*"))
        if rounds and best.isEmpty():
            break
        rounds.append(best.select(*keys, "a", "b", "weight").distinct())   # two components that chose each other give one edge
        back = best.select(*keys, F.col("component").alias("to"), F.col("to").alias("component"), F.lit(True).alias("mutual"))
        up = best.select(*keys, "component", "to").join(back, [*keys, "component", "to"], "left")   # of those two the smaller one is a root
        up = up.select(*keys, "component", F.when(F.col("mutual") & (F.col("component") < F.col("to")), F.col("component")).otherwise(F.col("to")).alias("to"))
        moving = True
        while moving:
            for jump in range(JUMPS):
                twice = up.join(up.select(*keys, F.col("component").alias("to"), F.col("to").alias("_root")), [*keys, "to"])
                up = twice.select(*keys, "component", F.col("_root").alias("to"), (F.col("_root") != F.col("to")).alias("_moved"))
            up = settled(up)
            moving = not up.where("_moved").isEmpty()
            up = up.drop("_moved")
        labels = settled(labels.join(up, [*keys, "component"], "left").select(*keys, "instance", F.coalesce("to", "component").alias("component")))
    tree = rounds[0]
    for more in rounds[1:]:
        tree = tree.unionByName(more)
    return settled(tree)


def condense(a, b, weight, size, cluster, min_size, first_id):
    """One band of a condensed tree. ``size`` and ``cluster`` (None: too small) are of the components; a, b, weight of edges between them.

    Returns (component -> its new component, new component -> (size, cluster), small component -> cluster that it joins, events); an event is
    (cluster, sum of 1 / weight over the points that fall out, parent, 1 / weight at the birth, points at the birth), parts of it None.
    """
    up = {c: c for c in size}
    size, cluster, waiting, joined, events = dict(size), dict(cluster), {c: [c] for c in size if cluster[c] is None}, {}, []

    def root(c):
        while up[c] != c:
            up[c] = up[up[c]]
            c = up[c]
        return c

    order = np.argsort(weight, kind="stable")
    cuts = np.nonzero(np.diff(np.asarray(weight)[order]))[0] + 1
    for same in np.split(order, cuts) if len(order) else ():
        inverse, parts = 1.0 / max(float(weight[same[0]]), LEAST_WEIGHT), {}
        for e in same:
            x, y = root(a[e]), root(b[e])
            if x != y:
                parts[x] = parts.pop(x, [x]) + parts.pop(y, [y])
                up[y] = x
        for top, members in parts.items():
            large, small = [m for m in members if cluster[m] is not None], [m for m in members if cluster[m] is None]
            total, loose = sum(size[m] for m in members), sum(size[m] for m in small)
            if len(large) == 1:
                own = cluster[large[0]]
                events.append((own, loose * inverse, None, None, None))
            elif large or total >= min_size:
                own, first_id = first_id, first_id + 1
                events.append((own, total * inverse, None, None, None))
                events += [(cluster[m], 0.0, own, inverse, size[m]) for m in large]
            else:
                own = None
            held = [c for m in small for c in waiting.pop(m)]
            if own is None:
                waiting[top] = held
            else:
                joined.update(dict.fromkeys(held, own))
            size[top], cluster[top] = total, own
    moved = {c: root(c) for c in up}
    return moved, {c: (size[c], cluster[c]) for c in set(moved.values())}, joined, events


def select_stable(clusters: pd.DataFrame) -> dict:
    """cluster -> the chosen cluster that holds it (None: none does). Columns: cluster, total, parent, birth, points; the root is never chosen."""
    rows = {int(r.cluster): r for r in clusters.itertuples(index=False)}
    parent = {c: None if pd.isna(r.parent) else int(r.parent) for c, r in rows.items()}
    children = {}
    for c, p in parent.items():
        children.setdefault(p, []).append(c)
    depth_first, stack = [], [c for c, p in parent.items() if p is None]
    while stack:
        c = stack.pop()
        depth_first.append(c)
        stack += children.get(c, [])
    value, chosen = {}, set()
    for c in reversed(depth_first):
        below = sum(value[d] for d in children.get(c, []))
        own = -np.inf if parent[c] is None else rows[c].total - rows[c].points * rows[c].birth
        if parent[c] is not None and (c not in children or not below > own):
            value[c] = own
            chosen.add(c)
        else:
            value[c] = below
    holder = {}
    for c in depth_first:   # the topmost chosen cluster counts
        over = holder.get(parent[c]) if parent[c] is not None else None
        holder[c] = over if over is not None else c if c in chosen else None
    return holder


def condensed_clusters(nodes: DataFrame, tree: DataFrame, keys) -> DataFrame:
    """(keys, instance, cluster): the points of the chosen clusters. ``nodes`` has keys, instance (a number), ``size`` of the group and ``least`` cluster size."""
    keys = list(keys)
    most = nodes.agg(F.max("size")).first()[0] or 1
    parts = -(-most // BAND)
    if parts > 1:
        shares = F.array(*[F.lit(k / parts) for k in range(1, parts)])
        cuts = tree.groupBy(*keys).agg(F.percentile_approx("weight", shares, F.lit(20 * parts)).alias("_q"), F.count(F.lit(1)).alias("_n"))
        tree = settled(tree.join(cuts, keys).withColumn("band", F.when(F.col("_n") < BAND, 0).otherwise(F.size(F.filter("_q", lambda q: q < F.col("weight"))))).drop("_q", "_n"))
    else:
        tree = tree.withColumn("band", F.lit(0))
    group = nodes.groupBy(*keys).agg(F.max("least").alias("least"))
    where = nodes.select(*keys, "instance", F.col("instance").alias("component"))
    parts_of = nodes.select(*keys, F.col("instance").alias("component"), F.lit(1).cast("long").alias("size"), F.lit(None).cast("long").alias("cluster"))
    out = _keyed(nodes, keys, ("kind", LongType), ("x", LongType), ("y", LongType), ("z", LongType), ("value", DoubleType), ("birth", DoubleType))
    joined, events = [], []
    for band in range(parts):
        end = lambda name: where.select(*keys, F.col("instance").alias(name), F.col("component").alias(f"c_{name}"))
        edges = settled(tree.where(F.col("band") == band).join(end("a"), [*keys, "a"]).join(end("b"), [*keys, "b"]).join(group, keys).select(*keys, "c_a", "c_b", "weight", "least"))
        touched = edges.select(*keys, F.explode(F.array("c_a", "c_b")).alias("component")).distinct().join(parts_of, [*keys, "component"])

        def run(key, e, t, first_id=band * BAND_IDS):
            if not len(e):
                return None
            number = lambda v: None if pd.isna(v) else int(v)
            moved, states, small, told = condense(e["c_a"].tolist(), e["c_b"].tolist(), e["weight"].to_numpy(), dict(zip(t["component"].tolist(), t["size"].tolist())),
                                                  {c: number(v) for c, v in zip(t["component"].tolist(), t["cluster"])}, int(e["least"].iloc[0]), first_id)
            lines = [(0, c, to, None, None, None) for c, to in moved.items()] + [(1, c, n, own, None, None) for c, (n, own) in states.items()]
            lines += [(2, c, own, None, None, None) for c, own in small.items()] + [(3, own, parent, points, total, birth) for own, total, parent, birth, points in told]
            return pd.DataFrame(lines, columns=["kind", "x", "y", "z", "value", "birth"]).astype({"kind": "int64", "x": "int64", "y": "Int64", "z": "Int64", "value": "float64", "birth": "float64"})

        done = settled(cogrouped(edges, touched, keys, run, out))
        small = done.where("kind = 2").select(*keys, F.col("x").alias("component"), F.col("y").alias("cluster"))
        joined.append(settled(where.join(small, [*keys, "component"]).select(*keys, "instance", "cluster")))
        events.append(done.where("kind = 3").select(*keys, F.col("x").alias("cluster"), F.col("value").alias("total"), F.col("y").alias("parent"), F.col("z").alias("points"), "birth"))
        if band + 1 < parts:
            moved = done.where("kind = 0").select(*keys, F.col("x").alias("component"), F.col("y").alias("_to"))
            where = settled(where.join(moved, [*keys, "component"], "left").select(*keys, "instance", F.coalesce("_to", "component").alias("component")))
            states = done.where("kind = 1").select(*keys, F.col("x").alias("component"), F.col("y").alias("size"), F.col("z").alias("cluster"))
            parts_of = settled(parts_of.join(moved.select(*keys, "component"), [*keys, "component"], "left_anti").unionByName(states))
    union = lambda frames: frames[0] if len(frames) == 1 else frames[0].unionByName(union(frames[1:]))
    clusters = union(events).groupBy(*keys, "cluster").agg(F.sum("total").alias("total"), F.max("parent").alias("parent"), F.max("points").alias("points"), F.max("birth").alias("birth"))
    schema = _keyed(nodes, keys, ("cluster", LongType), ("chosen", LongType))

    def select(key, frame):   # at most forty clusters, since each leaf holds a twentieth of the group
        held = [(c, h) for c, h in select_stable(frame).items() if h is not None]
        found = pd.DataFrame(held, columns=["cluster", "chosen"]).astype("int64")
        for name, value in zip(keys, key):
            found[name] = value
        return found[schema.fieldNames()]

    chosen = clusters.groupBy(*keys).applyInPandas(select, schema)
    return union(joined).join(chosen, [*keys, "cluster"]).select(*keys, "instance", F.col("chosen").alias("cluster"))


def density_labels(points: DataFrame, keys) -> DataFrame:
    """(keys, instance, cluster) of the groups with at least ``MIN_TO_CLUSTER`` points: clusters are numbered from 0 by their lowest point.

    The least cluster has a twentieth of the group, at least 5 points; the core distance is taken at half of that, at least 2. A group without
    chosen clusters is one cluster. Vectors are used as they are given.
    """
    keys = list(keys)
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= MIN_TO_CLUSTER)
    least = F.greatest(F.lit(5), F.floor(F.col("size") / 20)).cast("long")
    rows = points.select(*keys, F.col("instance").alias("name"), "vector").join(sizes.withColumn("least", least), keys)
    rows = settled(rows.withColumn("instance", F.monotonically_increasing_id()).withColumn("near", F.greatest(F.lit(2), F.floor(F.col("least") / 2))))
    core = settled(core_distances(rows, keys))
    tree = spanning_tree(rows.join(core, [*keys, "instance"]), keys)
    names = rows.select(*keys, F.col("name").alias("instance"))
    labelled = settled(condensed_clusters(rows, tree, keys).join(rows.select(*keys, "instance", "name", "vector"), [*keys, "instance"]))
    centres = (labelled.groupBy(*keys, "cluster").agg(Summarizer.mean(array_to_vector("vector")).alias("_m"), F.min("name").alias("_least"))
               .withColumn("number", F.row_number().over(Window.partitionBy(*keys).orderBy("_least")) - 1).select(*keys, "cluster", F.col("number").cast("long").alias("number"), vector_to_array("_m").alias("centre")))
    centres = settled(centres)
    loose = rows.select(*keys, "instance", "name", "vector").join(labelled.select(*keys, "instance"), [*keys, "instance"], "left_anti")
    placed = (loose.join(centres, keys).withColumn("_d", F.round(euclidean(F.col("vector"), F.col("centre")), DIGITS))   # at most twenty centres
              .groupBy(*keys, "name").agg(F.min_by("number", F.struct("_d", "number")).alias("number")))
    found = labelled.join(centres.select(*keys, "cluster", "number"), [*keys, "cluster"]).select(*keys, "name", "number").unionByName(placed)
    return names.join(found.withColumnRenamed("name", "instance"), [*keys, "instance"], "left").select(*keys, "instance", F.coalesce("number", F.lit(0).cast("long")).alias("cluster"))
