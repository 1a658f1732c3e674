"""Queries on step vectors, instance vectors and geometric selection."""
from pyspark.sql import Window, functions as F

from ..functions import arrays
from ..functions.arrays import clean
from ..operators import blocks, errors, rounds, selection, splits, strata, vectors
from ..session import dealt, settled
from . import inputs
from .inputs import COMPLETE, LABELLED, N_RUNS, OUTCOMES, splits_sql, sql
from .queries_core import KEYS, RATES, WINDOWS, labelled, metrics_sql, quotas_sql, whole_population

QUERIES, ORACLE = {}, {}
STEPS_PER_TRAJECTORY = 5
SLOTS_BY_LABEL = 30
SQL_ROUNDS = 6


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def step_vectors(spark, folder):
    """step_vectors(trajectory, step, vector): five consecutive vectors form a trajectory; every last vector of a label block stands alone.

    Trajectories -1 - label hold one step each (the vector with the smallest id of the label), so that one-step trajectories occur.
    """
    table = inputs.table(spark, folder, "embeddings").withColumn("vector", F.col("embedding").cast("array<double>"))
    long = table.select(F.floor(F.col("vec_id") / STEPS_PER_TRAJECTORY).alias("trajectory"), F.pmod("vec_id", F.lit(STEPS_PER_TRAJECTORY)).alias("step"), "vector")
    single = table.groupBy("label").agg(F.min_by("vector", "vec_id").alias("vector")).select((-1 - F.col("label")).cast("long").alias("trajectory"), F.lit(0).cast("long").alias("step"), "vector")
    return long.unionByName(single)


STEPS = f"""steps AS (
  SELECT vec_id // {STEPS_PER_TRAJECTORY} AS trajectory, vec_id % {STEPS_PER_TRAJECTORY} AS step, embedding::DOUBLE[] AS v FROM embeddings
  UNION ALL SELECT CAST(-1 - label AS BIGINT), 0, arg_min(embedding, vec_id)::DOUBLE[] FROM embeddings GROUP BY label)"""


def run_vectors(spark, folder):
    """run_vectors(instance, run, vector): vector number (5 * instance + run) modulo the number of vectors."""
    table = inputs.table(spark, folder, "embeddings")
    total = table.agg(F.count(F.lit(1)).alias("_total")).withColumn("_one", F.lit(1))
    wanted = (whole_population(spark, folder).select("instance", F.explode(F.sequence(F.lit(0), F.lit(N_RUNS - 1))).alias("run"), F.lit(1).alias("_one"))
              .join(F.broadcast(total), "_one").withColumn("vec_id", F.pmod(F.col("instance") * N_RUNS + F.col("run"), F.col("_total"))))
    return wanted.join(table, "vec_id").select("instance", "run", F.col("embedding").cast("array<double>").alias("vector"))


RUN_VECTORS = f"""run_vectors AS (
  SELECT c.instance, r.run, e.embedding::DOUBLE[] AS v
  FROM complete c, (SELECT unnest(range({N_RUNS})) AS run) r JOIN embeddings e ON e.vec_id = (c.instance * {N_RUNS} + r.run) % (SELECT count(*) FROM embeddings))"""


@register("pooled_vectors", sql(STEPS, query="""
SELECT trajectory, steps, d, round(value, 6) AS value FROM (
  SELECT trajectory, len(l) AS steps, unnest(range(len(l[1]) * 5)) AS d,
    unnest(list_concat(list_concat(list_concat(list_concat(l[1], l[len(l) // 2 + 1]), l[len(l)]),
      list_transform(range(len(l[1])), lambda i: list_avg(list_transform(l, lambda v: v[i + 1])))),
      list_transform(range(len(l[1])), lambda i: list_stddev_pop(list_transform(l, lambda v: v[i + 1]))))) AS value
  FROM (SELECT trajectory, list(v ORDER BY step) AS l FROM steps GROUP BY trajectory))"""))
def pooled_vectors(spark, folder):
    """Pooled trajectory vectors, one row per dimension."""
    pooled = vectors.pooled_vectors(step_vectors(spark, folder))
    return (pooled.select("trajectory", "steps", F.posexplode("vector").alias("d", "value"))
            .select("trajectory", "steps", F.col("d").cast("long").alias("d"), clean(F.col("value")).alias("value")))


@register("resampled_vectors", sql(STEPS, query="""
SELECT trajectory, t * len(l[1]) + i AS d, round((1 - w) * l[lo + 1][i + 1] + w * l[least(lo + 1, n - 1) + 1][i + 1], 6) + 0.0 AS value FROM (
  SELECT *, unnest(range(len(l[1]))) AS i FROM (
    SELECT *, CAST(floor(place) AS BIGINT) AS lo, place - floor(place) AS w FROM (
      SELECT trajectory, l, n, t, t * (n - 1) / 7.0::DOUBLE AS place FROM (
        SELECT trajectory, list(v ORDER BY step) AS l, count(*) AS n, unnest(range(8)) AS t FROM steps GROUP BY trajectory))))"""))
def resampled_vectors(spark, folder):
    """E5: trajectories resampled to eight steps, one row per dimension."""
    series = vectors.resampled_vectors(step_vectors(spark, folder))
    return (series.select("trajectory", F.posexplode("vector").alias("d", "value"))
            .select("trajectory", F.col("d").cast("long").alias("d"), clean(F.col("value")).alias("value")))


def instance_vectors(spark, folder, windows=WINDOWS):
    """Labelled instances with the mean vector of their training runs."""
    by_run = vectors.run_vector_arrays(run_vectors(spark, folder), N_RUNS)
    rows = settled(dealt(whole_population(spark, folder).join(by_run, "instance")))   # read several times, once per split each time
    split_rows = strata.label_instances(splits.explode_splits(rows, N_RUNS, windows))
    return (split_rows.withColumn("vector", vectors.instance_vector(F.col("vectors"), F.col("train")))
            .withColumn("stratum", strata.outcome_stratum(F.col("passes"), F.col("window"))).drop("vectors"))


INSTANCE_VECTORS = """by_run AS (SELECT instance, list(v ORDER BY run) AS vs FROM run_vectors GROUP BY instance),
vectors AS (
  SELECT l.*, CASE WHEN "window" = 1 THEN CAST(CASE WHEN passes >= ceil("window" / 2.0) THEN 1 ELSE 0 END AS VARCHAR)
                   ELSE CAST(CAST(passes AS BIGINT) AS VARCHAR) END AS stratum,
         list_transform(range(len(b.vs[1])), lambda i: list_avg(list_transform(l.train, lambda r: b.vs[r + 1][i + 1]))) AS v
  FROM labelled l JOIN by_run b USING (instance))"""


@register("instance_vectors", sql(OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, RUN_VECTORS, INSTANCE_VECTORS, query="""
SELECT "window", split, instance, stratum, round(sqrt(list_sum(list_transform(v, lambda x: x * x))), 6) AS norm, round(list_avg(v), 6) + 0.0 AS mean, round(v[1], 6) + 0.0 AS first
FROM vectors"""))
def instance_vector_norms(spark, folder):
    """Instance vectors averaged over training runs, described by norm, mean and first value."""
    v = F.col("vector")
    return instance_vectors(spark, folder).select("window", "split", "instance", "stratum", clean(arrays.norm(v)).alias("norm"),
                                                  clean(arrays.mean(v)).alias("mean"), clean(F.get(v, F.lit(0))).alias("first"))


CENTROID = """centres AS (
  SELECT "window", split, stratum, list(m ORDER BY i) AS centre FROM (
    SELECT "window", split, stratum, i, avg(x) AS m FROM (SELECT "window", split, stratum, unnest(v) AS x, unnest(range(len(v))) AS i FROM vectors) GROUP BY ALL)
  GROUP BY ALL),
ranked AS (
  SELECT v.*, q.subset, q.quota, q.members, row_number() OVER (PARTITION BY v."window", v.split, v.stratum, q.subset
           ORDER BY round(list_distance(v.v, c.centre), 9), v.instance) AS pick
  FROM vectors v JOIN quotas q USING ("window", split, stratum) JOIN centres c USING ("window", split, stratum)),
chosen AS (
  SELECT r.* FROM ranked r WHERE pick <= quota)"""

CENTROID_BASE = (OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, RUN_VECTORS, INSTANCE_VECTORS,
                 quotas_sql((0.10, 0.30), "vectors", ('"window"', "split")), CENTROID)
SPLIT = ["population", "window", "split"]


def centroid_selection(spark, folder, fractions=(0.10, 0.30), windows=WINDOWS):
    """Centroid inside outcome strata for every split and subset size."""
    rows = instance_vectors(spark, folder, windows)
    quotas = strata.stratum_quotas(rows, SPLIT, fractions)
    return selection.nearest_to_centre(rows, quotas, SPLIT)


@register("centroid_selection", sql(*CENTROID_BASE, query="""SELECT "window", split, subset, stratum, instance FROM chosen"""))
def centroid_members(spark, folder):
    """M4, M9: the chosen instances."""
    return centroid_selection(spark, folder).select("window", "split", "subset", "stratum", "instance")


@register("centroid_errors", sql(*CENTROID_BASE, RATES, metrics_sql("chosen", ('"window"', "split", "subset")), query="""
SELECT "window", split, subset, round(rmse, 6) AS rmse, round(maxerr, 6) AS maxerr, round(p95, 6) AS p95 FROM metrics"""))
def centroid_errors(spark, folder):
    """Errors of the centroid method inside strata."""
    rates = errors.population_rates(whole_population(spark, folder), N_RUNS)
    m = errors.split_metrics(errors.run_errors(centroid_selection(spark, folder), rates, SPLIT + ["subset"], N_RUNS))
    return m.select("window", "split", "subset", *[clean(F.col(c)).alias(c) for c in ("rmse", "maxerr", "p95")])


def labelled_points(spark, folder):
    """Vectors as members of the strata given by their label, with largest-remainder quotas of ``SLOTS_BY_LABEL`` slots."""
    points = inputs.table(spark, folder, "embeddings").select(F.lit(0).alias("population"), F.col("vec_id").alias("instance"), F.col("label").cast("string").alias("stratum"),
                                                             F.col("embedding").cast("array<double>").alias("vector"))
    sizes = points.groupBy("population", "stratum").agg(F.count(F.lit(1)).alias("members")).withColumn("slots", F.lit(SLOTS_BY_LABEL))
    quotas = strata.proportional_quotas(sizes, ["population"]).select("population", "stratum", "quota")
    return points, quotas


POINTS = f"""points AS (SELECT vec_id AS id, CAST(label AS VARCHAR) AS g, embedding::DOUBLE[] AS v FROM embeddings),
sizes AS (SELECT g, count(*) AS m, CAST(sum(count(*)) OVER () AS BIGINT) AS n FROM points GROUP BY g),
based AS (SELECT *, {SLOTS_BY_LABEL} * m / n::DOUBLE AS share, floor({SLOTS_BY_LABEL} * m / n::DOUBLE) AS base FROM sizes),
quota AS (SELECT g, CAST(base AS BIGINT) + CASE WHEN row_number() OVER (ORDER BY share - base DESC, g) <= {SLOTS_BY_LABEL} - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM based)"""


def _inside(spark, folder):
    points, quotas = labelled_points(spark, folder)
    return points.join(quotas, ["population", "stratum"]).withColumn("in_group", F.lit(True))


def _covering(spark, folder, bandwidth):
    """Every stratum next to the whole population: other strata's points only have to be covered.

    A point is repeated once per stratum (their number is fixed by the labels), through an explode of the gathered quotas.
    """
    points, quotas = labelled_points(spark, folder)
    groups = settled(quotas.groupBy("population").agg(F.collect_list(F.struct(F.col("stratum").alias("group"), "quota")).alias("_groups")))
    rows = (points.join(groups, "population").withColumn("_g", F.explode("_groups"))
            .select("population", F.col("_g.group").alias("group"), F.col("_g.quota").alias("quota"), "instance", "vector",
                    (F.col("stratum") == F.col("_g.group")).alias("in_group")))
    if bandwidth:
        rows = rows.join(settled(blocks.median_positive_distance(points, ["population"])), "population")
    return rows.withColumnRenamed("group", "stratum")


def _picks(df):
    return df.select("stratum", "instance", F.col("pick").cast("long").alias("pick"))


def greedy_sql(method) -> str:
    """Unrolled greedy rounds on the labelled points; ties go to the lowest id."""
    ctes = [POINTS]
    if method == "ks":
        ctes.append("pairs AS (SELECT a.g, a.id, b.id AS o, round(list_distance(a.v, b.v), 9) AS d FROM points a JOIN points b USING (g))")
        first = "SELECT g, id, round(-sum(list_distance_), 9) AS score FROM (SELECT g, id, d AS list_distance_ FROM pairs) GROUP BY g, id"
    elif method == "medoid":
        ctes.append("pairs AS (SELECT a.g, a.id, b.id AS o, list_distance(a.v, b.v) AS d FROM points a, points b)")
        first = "SELECT g, id, round(-sum(d), 9) AS score FROM pairs GROUP BY g, id"
    else:
        ctes.append("""raw AS (SELECT a.g, a.id, b.id AS o, list_distance(a.v, b.v) AS d FROM points a, points b),
bw AS (SELECT median(round(d, 9)) AS b FROM raw WHERE round(d, 9) > 0),
pairs AS (SELECT g, id, o, exp(-d * d / (2 * b * b)) AS d FROM raw, bw)""")
        first = "SELECT g, id, 0 AS score FROM points"
    choose = lambda body, number, before: f"""p{number} AS (
  SELECT g, id, {number} AS pick FROM (SELECT s.*, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS place FROM ({body}) s{before})
  JOIN quota USING (g) WHERE place = 1 AND k >= {number})"""   # noqa: E731
    ctes.append(choose(first, 1, ""))
    for number in range(2, SQL_ROUNDS + 1):
        done = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, number))
        if method == "ks":
            body = f"SELECT x.g, x.id, round(min(x.d), 9) AS score FROM pairs x JOIN ({done}) c ON c.g = x.g AND c.id = x.o GROUP BY x.g, x.id"
        else:
            agg, value = ("min", "greatest(n.best - x.d, 0)") if method == "medoid" else ("max", "greatest(x.d - n.best, 0)")
            near = f"SELECT c.g, x.o, {agg}(x.d) AS best FROM pairs x JOIN ({done}) c ON c.g = x.g AND c.id = x.id GROUP BY c.g, x.o"
            body = f"SELECT x.g, x.id, round(sum({value}), 9) AS score FROM pairs x JOIN ({near}) n ON n.g = x.g AND n.o = x.o GROUP BY x.g, x.id"
        ctes.append(choose(body, number, f" ANTI JOIN ({done}) t ON t.g = s.g AND t.id = s.id"))
    every = " UNION ALL ".join(f"SELECT * FROM p{i}" for i in range(1, SQL_ROUNDS + 1))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT g AS stratum, id AS instance, CAST(pick AS BIGINT) AS pick FROM ({every})"


@register("kennard_stone_by_label", greedy_sql("ks"))
def kennard_stone_by_label(spark, folder):
    """M7: farthest-first picks inside every label stratum."""
    return _picks(rounds.geometric_selection(_inside(spark, folder), ["population", "stratum"], "ks"))


@register("medoid_by_label", greedy_sql("medoid"))
def medoid_by_label(spark, folder):
    """M6: medoid build, scored against the whole population."""
    return _picks(rounds.geometric_selection(_covering(spark, folder, False), ["population", "stratum"], "medoid"))


@register("facility_location_by_label", greedy_sql("fl"))
def facility_location_by_label(spark, folder):
    """Facility location over RBF similarities with the median-distance bandwidth."""
    return _picks(rounds.geometric_selection(_covering(spark, folder, True), ["population", "stratum"], "fl"))


CORE_EDGE = POINTS + """,
centres AS (SELECT g, list(m ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS m FROM (SELECT g, unnest(v) AS x, unnest(range(len(v))) AS i FROM points) GROUP BY g, i) GROUP BY g),
placed AS (SELECT p.*, k, greatest(1, CAST(floor(k * 0.9::DOUBLE) AS BIGINT)) AS core, round(list_distance(v, c), 9) AS far,
           row_number() OVER (PARTITION BY p.g ORDER BY round(list_distance(v, c), 9), id) AS pick FROM points p JOIN centres USING (g) JOIN quota USING (g))"""


@register("core_edge_by_label", "WITH " + CORE_EDGE + """
SELECT g AS stratum, id AS instance, CAST(pick AS BIGINT) AS pick FROM placed WHERE pick <= core
UNION ALL
SELECT g, id, core + place FROM (SELECT *, row_number() OVER (PARTITION BY g ORDER BY far DESC, id) AS place FROM placed WHERE pick > core) WHERE place <= k - core AND place = 1""")
def core_edge_by_label(spark, folder):
    """M8: core/edge; with at most one edge slot per stratum the edge is the member farthest from the centre."""
    return _picks(rounds.geometric_selection(_inside(spark, folder), ["population", "stratum"], "core_edge"))


EDGE_SLOTS = SLOTS_BY_LABEL - int(SLOTS_BY_LABEL * rounds.CORE_SHARE)


def edge_sql() -> str:
    """Unrolled farthest-first picks among the points outside the core, the first one farthest from the centre."""
    ctes = [POINTS, f"""centre AS (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM points) GROUP BY i)),
placed AS (SELECT id, v, round(list_distance(v, c), 9) AS far, row_number() OVER (ORDER BY round(list_distance(v, c), 9), id) AS pick FROM points, centre),
n0 AS (SELECT id, v, far AS near FROM placed WHERE pick > {SLOTS_BY_LABEL - EDGE_SLOTS})"""]
    for k in range(1, EDGE_SLOTS + 1):
        ctes.append(f"e{k} AS (SELECT id, v FROM n{k - 1} ORDER BY near DESC, id LIMIT 1)")
        near = f"round(list_distance(n.v, e{k}.v), 9)"
        ctes.append(f"n{k} AS (SELECT n.id, n.v, {near if k == 1 else f'least(near, {near})'} AS near FROM n{k - 1} n, e{k} WHERE n.id <> e{k}.id)")
    edges = " ".join(f"UNION ALL SELECT id, {SLOTS_BY_LABEL - EDGE_SLOTS + k} FROM e{k}" for k in range(1, EDGE_SLOTS + 1))
    return "WITH " + ",\n".join(ctes) + f"\nSELECT id AS instance, CAST(pick AS BIGINT) AS pick FROM placed WHERE pick <= {SLOTS_BY_LABEL - EDGE_SLOTS} {edges}"


@register("core_edge_whole_population", edge_sql())
def core_edge_whole_population(spark, folder):
    """core/edge without strata; several edge slots, taken farthest-first."""
    points, _ = labelled_points(spark, folder)
    rows = points.drop("stratum").withColumn("quota", F.lit(SLOTS_BY_LABEL)).withColumn("in_group", F.lit(True))
    return rounds.geometric_selection(rows, ["population"], "core_edge").select("instance", F.col("pick").cast("long").alias("pick"))


@register("centroid_whole_population", sql(POINTS, query=f"""
SELECT id AS instance, CAST(pick AS BIGINT) AS pick FROM (
  SELECT id, row_number() OVER (ORDER BY round(list_distance(v, c), 9), id) AS pick
  FROM points, (SELECT list(m ORDER BY i) AS c FROM (SELECT i, avg(x) AS m FROM (SELECT unnest(v) AS x, unnest(range(len(v))) AS i FROM points) GROUP BY i)))
WHERE pick <= {SLOTS_BY_LABEL}"""))
def centroid_whole_population(spark, folder):
    """The same without strata."""
    points, _ = labelled_points(spark, folder)
    rows = points.drop("stratum").withColumn("quota", F.lit(SLOTS_BY_LABEL)).withColumn("in_group", F.lit(True))
    return rounds.geometric_selection(rows, ["population"], "centroid").select("instance", F.col("pick").cast("long").alias("pick"))


@register("total_distances", sql(POINTS, query="""
SELECT a.g AS stratum, a.id AS instance, round(sum(list_distance(a.v, b.v)), 6) AS total_distance FROM points a JOIN points b USING (g) GROUP BY ALL"""))
def total_distances(spark, folder):
    """Sum of distances inside the stratum, block by block."""
    points, _ = labelled_points(spark, folder)
    return blocks.total_distances(points, points, ["stratum"]).select("stratum", "instance", clean(F.col("total_distance")).alias("total_distance"))


@register("rbf_bandwidth", sql(POINTS, query="""
SELECT a.g AS stratum, round(median(round(list_distance(a.v, b.v), 9)), 6) AS bandwidth FROM points a JOIN points b USING (g) WHERE round(list_distance(a.v, b.v), 9) > 0 GROUP BY a.g"""))
def rbf_bandwidth(spark, folder):
    """Exact median of the positive distances per stratum."""
    points, _ = labelled_points(spark, folder)
    return blocks.median_positive_distance(points, ["stratum"]).select("stratum", clean(F.col("bandwidth")).alias("bandwidth"))


@register("shortlist_draws", sql(POINTS, f"""pool AS (SELECT n, least(n, greatest({SLOTS_BY_LABEL} + 1, CAST(floor({SLOTS_BY_LABEL} * 2.0::DOUBLE) AS BIGINT))) AS slots FROM (SELECT sum(m) AS n FROM sizes)),
pool_share AS (SELECT g, m, slots, slots * m / pool.n::DOUBLE AS share, floor(slots * m / pool.n::DOUBLE) AS base FROM sizes, pool),
pool_quota AS (SELECT g, CAST(base AS BIGINT) + CASE WHEN base < m AND row_number() OVER (ORDER BY base < m DESC, share - base DESC, g) <= slots - sum(base) OVER () THEN 1 ELSE 0 END AS k FROM pool_share),
near AS (SELECT p.g, p.id, k, row_number() OVER (PARTITION BY p.g ORDER BY round(list_distance(v, c), 9), id) AS place FROM points p JOIN pool_quota USING (g)
  JOIN (SELECT g, list(a ORDER BY i) AS c FROM (SELECT g, i, avg(x) AS a FROM (SELECT g, unnest(v) AS x, unnest(range(len(v))) AS i FROM points) GROUP BY g, i) GROUP BY g) USING (g))""", query=f"""
SELECT g AS stratum, draw, id AS instance FROM (
  SELECT g, draw, id, row_number() OVER (PARTITION BY draw ORDER BY md5('shortlist|0|' || draw || '|' || id), id) AS place FROM near, (SELECT unnest(range(20)) AS draw) WHERE place <= k)
WHERE place <= {SLOTS_BY_LABEL}"""))
def shortlist_draws(spark, folder):
    """One centroid shortlist of twice the size, spread over the strata by largest remainders, then seeded draws of the size from the united pool."""
    points, _ = labelled_points(spark, folder)
    sizes = points.groupBy("population", "stratum").agg(F.count(F.lit(1)).alias("members"))
    whole = F.sum("members").over(Window.partitionBy("population"))
    slots = sizes.withColumn("slots", selection.shortlist_size(whole, F.lit(SLOTS_BY_LABEL), 2.0))
    quotas = strata.proportional_quotas(slots, ["population"]).select("population", "stratum", "quota")
    rows = points.join(quotas, ["population", "stratum"]).withColumn("in_group", F.lit(True))
    pool = rounds.geometric_selection(rows, ["population", "stratum"], "centroid").withColumn("size", F.lit(SLOTS_BY_LABEL))
    return (selection.draw_from_pool(pool.drop("pick"), "size", 20, ["population"])
            .select("stratum", F.col("draw").cast("long").alias("draw"), "instance"))


@register("vector_set_comparison", sql(STEPS, query="""
SELECT trajectory, CAST(count(*) AS BIGINT) AS steps_first, CAST(sum(CASE WHEN v[1] > 0 THEN 1 ELSE 0 END) AS BIGINT) AS steps_second,
       bool_and(v[1] > 0) AS same_shape, round(max(CASE WHEN v[1] > 0 THEN list_max(list_transform(v, lambda x: abs(round(x, 3) - x))) END), 6) AS max_abs_difference,
       round(min(CASE WHEN v[1] > 0 THEN list_cosine_similarity(v, list_transform(v, lambda x: round(x, 3))) END), 6) AS min_cosine,
       round(avg(CASE WHEN v[1] > 0 THEN list_cosine_similarity(v, list_transform(v, lambda x: round(x, 3))) END), 6) AS mean_cosine
FROM steps WHERE trajectory >= 0 GROUP BY trajectory"""))
def vector_set_comparison(spark, folder):
    """Step vectors against a copy rounded to three digits that lacks some rows."""
    steps = step_vectors(spark, folder).where(F.col("trajectory") >= 0).withColumn("run", F.lit(0))
    copy = steps.where(F.get("vector", F.lit(0)) > 0).withColumn("vector", F.transform("vector", lambda x: F.round(x, 3)))
    summary = vectors.comparison_summary(vectors.compare_vectors(steps, copy))
    return summary.select("trajectory", "steps_first", "steps_second", "same_shape", clean(F.col("max_abs_difference")).alias("max_abs_difference"),
                          clean(F.col("min_cosine")).alias("min_cosine"), clean(F.col("mean_cosine")).alias("mean_cosine"))
