"""Queries on report tables, run groups, calibration, clusters and family evaluation."""
from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..operators import calibration, clusters, comparisons, cost, density, errors, families, rankings, reports, rounds, runs, selection, strata
from ..session import cut_lineage
from ..sources import audits
from . import inputs, queries_cost, queries_sources
from .inputs import COMPLETE, LABELLED, N_RUNS, OUTCOMES, splits_sql, sql
from .queries_core import BASE, DRAW_METRICS, KEYS, RATES, STOCHASTIC, STRATA, WINDOWS, draw_metrics, metrics_sql, quotas_sql, whole_population
from .queries_cost import COSTS, PROFILE, SHARES
from .queries_sources import RERUNS
from .queries_stats import holm_sql, p_two, rounded, signed_rank_sql
from .queries_vectors import CENTROID_BASE, POINTS, centroid_selection, instance_vectors, labelled_points
from .study import draw_stage, population_stage, split_stage, stage
from .study_sql import DRAWS_TABLE, POPULATION_TABLE, SPLIT_TABLE, WITH_OVERALL

QUERIES, ORACLE = {}, {}
SPLIT = ["population", "window", "split"]


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


# Report tables

@register("baseline_error_table", sql(*POPULATION_TABLE, query="""
SELECT subset, method, round(median(rmse) FILTER ("window" = 1), 6) AS "1_median", round(quantile_cont(rmse, 0.95) FILTER ("window" = 1), 6) AS "1_p95", round(median(rmse) FILTER ("window" = 2), 6) AS "2_median", round(quantile_cont(rmse, 0.95) FILTER ("window" = 2), 6) AS "2_p95"
FROM population_table WHERE method LIKE 'baselines:%' GROUP BY subset, method"""))
def baseline_error_table(spark, folder):
    """Median and P95 RMSE of the baselines, one pair of columns per window."""
    t = population_stage(spark, folder).where(rankings.family_of(F.col("method")) == "baselines")
    return rounded(reports.error_table(t, "window", (1, 2)), ["subset", "method"], ["1_median", "1_p95", "2_median", "2_p95"])


@register("baseline_maxerr_table", sql(*POPULATION_TABLE, query="""
SELECT subset, method, round(median(maxerr) FILTER ("window" = 1), 6) AS "1_median", round(quantile_cont(maxerr, 0.95) FILTER ("window" = 1), 6) AS "1_p95", round(median(maxerr) FILTER ("window" = 2), 6) AS "2_median", round(quantile_cont(maxerr, 0.95) FILTER ("window" = 2), 6) AS "2_p95"
FROM population_table WHERE method LIKE 'baselines:%' GROUP BY subset, method"""))
def baseline_maxerr_table(spark, folder):
    """Median and P95 MaxErr of the baselines, one pair of columns per window."""
    t = population_stage(spark, folder).where(rankings.family_of(F.col("method")) == "baselines")
    return rounded(reports.error_table(t, "window", (1, 2), value="maxerr"), ["subset", "method"], ["1_median", "1_p95", "2_median", "2_p95"])


PAIR_COLUMNS = ["first_mean", "second_mean", "first_median", "second_median", "delta", "p_value", "holm_p", "change_pct"]
PAIR_KEYS = ["first", "second", "units", "wins", "ties", "losses", "effect"]


def paired_sql(first, second, unit, keys=("subset",)):
    """CTEs of a paired table from two relations (keys, unit, method, value)."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in (*keys, unit))
    return (f"""pair_rows AS (SELECT {", ".join("a." + c for c in keys)}, a.method AS first, b.method AS second, a.value AS av, b.value AS bv, round(b.value - a.value, 12) AS d FROM ({first}) a JOIN ({second}) b ON {on} WHERE a.method <> b.method)""",
            f"""pair_cells AS (SELECT {k}, first, second, count(*) AS units, avg(av) AS first_mean, avg(bv) AS second_mean, median(av) AS first_median, median(bv) AS second_median, count(*) FILTER (d > 0) AS wins, count(*) FILTER (d = 0) AS ties, count(*) FILTER (d < 0) AS losses, avg(sign(d)) AS delta FROM pair_rows GROUP BY {k}, first, second)""",
            signed_rank_sql("pair_rows", (*keys, "first", "second"), "d", "pair_tests"),
            f"pair_joined AS (SELECT c.*, t.p_value FROM pair_cells c JOIN pair_tests t USING ({k}, first, second))")


EFFECT = "CASE WHEN abs(delta) < 0.147 THEN 'N' WHEN abs(delta) < 0.33 THEN 'S' WHEN abs(delta) < 0.474 THEN 'M' ELSE 'L' END AS effect"


def paired_query(keys=("subset",)):
    """Final SELECT of a paired table."""
    return f"""SELECT {", ".join(keys)}, first, second, units, wins, ties, losses, {EFFECT}, round(first_mean, 6) AS first_mean, round(second_mean, 6) AS second_mean, round(first_median, 6) AS first_median, round(second_median, 6) AS second_median,
       round(delta, 6) + 0.0 AS delta, round(p_value, 6) + 0.0 AS p_value, round(holm_p, 6) + 0.0 AS holm_p, round((first_mean - second_mean) / second_mean * 100, 6) + 0.0 AS change_pct FROM pair_held"""


OVERALL_VALUES = "SELECT subset, population, method, rmse AS value FROM with_overall WHERE \"window\" = 0"


def overall_values(spark, folder):
    """(subset, population, method, value) over all windows."""
    return rankings.window_average(population_stage(spark, folder)).select("subset", "population", "method", F.col("rmse").alias("value"))


@register("strongest_vs_baselines", sql(*POPULATION_TABLE, WITH_OVERALL, *paired_sql(OVERALL_VALUES + " AND method = 'baselines:consistency_stratified'", OVERALL_VALUES + " AND method LIKE 'baselines:%'", "population"),
                                        holm_sql("pair_joined", ("subset",), "second", "pair_held"), query=paired_query()))
def strongest_vs_baselines(spark, folder):
    """Y2: strongest baseline against every other baseline."""
    v = overall_values(spark, folder)
    first = v.where(F.col("method") == rankings.CONSISTENCY)
    second = v.where(rankings.family_of(F.col("method")) == "baselines")
    return rounded(reports.paired_table(first, second, ["subset"], "population", "second"), ["subset", *PAIR_KEYS], PAIR_COLUMNS)


@register("methods_vs_reference", sql(*POPULATION_TABLE, WITH_OVERALL, *paired_sql(OVERALL_VALUES + " AND method NOT LIKE 'baselines:%'", OVERALL_VALUES + " AND method = 'baselines:consistency_stratified'", "population"),
                                      holm_sql("pair_joined", ("subset",), "first", "pair_held"), query=paired_query()))
def methods_vs_reference(spark, folder):
    """Embedding methods against the strongest baseline."""
    v = overall_values(spark, folder)
    first = v.where(rankings.family_of(F.col("method")) != "baselines")
    return rounded(reports.paired_table(first, v.where(F.col("method") == rankings.CONSISTENCY), ["subset"], "population", "first"), ["subset", *PAIR_KEYS], PAIR_COLUMNS)


OVERALL_MAXERR = OVERALL_VALUES.replace("rmse AS value", "maxerr AS value")


@register("maxerr_vs_reference", sql(*POPULATION_TABLE, WITH_OVERALL, *paired_sql(OVERALL_MAXERR + " AND method NOT LIKE 'baselines:%'", OVERALL_MAXERR + " AND method = 'baselines:consistency_stratified'", "population"),
                                     holm_sql("pair_joined", ("subset",), "first", "pair_held"), query=paired_query()))
def maxerr_vs_reference(spark, folder):
    """The MaxErr of embedding methods against the strongest baseline's."""
    v = rankings.window_average(population_stage(spark, folder)).select("subset", "population", "method", F.col("maxerr").alias("value"))
    first = v.where(rankings.family_of(F.col("method")) != "baselines")
    return rounded(reports.paired_table(first, v.where(F.col("method") == rankings.CONSISTENCY), ["subset"], "population", "first"), ["subset", *PAIR_KEYS], PAIR_COLUMNS)


@register("window_comparison", sql(*POPULATION_TABLE, *paired_sql("SELECT \"window\", subset, population, method, rmse AS value FROM population_table WHERE method = 'embedding_strata:centroid_pooled'",
                                                                 "SELECT \"window\", subset, population, method, rmse AS value FROM population_table WHERE method = CASE WHEN \"window\" = 1 THEN 'baselines:difficulty_stratified' ELSE 'baselines:consistency_stratified' END",
                                                                 "population", ('"window"', "subset")), holm_sql("pair_joined", ('"window"', "subset"), "second", "pair_held"), query=paired_query(('"window"', "subset"))))
def window_comparison(spark, folder):
    """The centroid method against the strongest baseline of each window."""
    v = population_stage(spark, folder).select("window", "subset", "population", "method", F.col("rmse").alias("value"))
    first = v.where(F.col("method") == "embedding_strata:centroid_pooled")
    second = v.where(F.col("method") == rankings.strongest_baseline(F.col("window")))
    return rounded(reports.paired_table(first, second, ["window", "subset"], "population", "second"), ["window", "subset", *PAIR_KEYS], PAIR_COLUMNS)


@register("variant_comparison", sql(*POPULATION_TABLE, WITH_OVERALL, """sides AS (
  SELECT subset, avg(rmse) FILTER (method LIKE 'embedding%') AS a, avg(rmse) FILTER (method LIKE 'pure%') AS b, median(rmse) FILTER (method LIKE 'embedding%') AS c, median(rmse) FILTER (method LIKE 'pure%') AS d FROM with_overall WHERE "window" = 0 GROUP BY subset)""", query="""
SELECT subset, round(a, 6) AS first_mean, round(b, 6) AS second_mean, round(c, 6) AS first_median, round(d, 6) AS second_median, CASE WHEN round(a, 4) = round(b, 4) THEN 'tie' WHEN a < b THEN 'first' ELSE 'second' END AS lower FROM sides"""))
def variant_comparison(spark, folder):
    """Two variants of an algorithm with four-decimal ties (inside strata and on the whole population)."""
    t = rankings.window_average(population_stage(spark, folder)).withColumn("method", F.expr(
        "CASE method WHEN 'embedding_strata:centroid_pooled' THEN 'centroid_strata' WHEN 'pure_embedding:centroid_pooled' THEN 'centroid_whole' ELSE method END"))
    v = reports.variant_table(t, "_strata", "_whole")
    return rounded(v, ["subset", "lower"], ["first_mean", "second_mean", "first_median", "second_median"])


@register("ablation", sql(*POPULATION_TABLE, WITH_OVERALL, *paired_sql(OVERALL_VALUES + " AND method = 'embedding_strata:centroid_pooled'", OVERALL_VALUES + " AND method LIKE 'pure%'", "population"),
                          holm_sql("pair_joined", ("subset",), "second", "pair_held"), query=paired_query()))
def ablation(spark, folder):
    """Full method against the best configuration of the other families."""
    t = rankings.window_average(population_stage(spark, folder))
    return rounded(reports.ablation_table(t, "embedding_strata:centroid_pooled"), ["subset", *PAIR_KEYS], PAIR_COLUMNS)


@register("configuration_counts", sql(*POPULATION_TABLE, query="""
SELECT CASE WHEN method = 'baselines:random' THEN 'uniform random' WHEN method = 'baselines:stability_stratified' THEN 'control' WHEN method LIKE 'baselines:%' THEN 'stratified sampling' ELSE split_part(method, ':', 1) END AS "group", count(DISTINCT method) AS configurations
FROM population_table GROUP BY 1"""))
def configuration_counts(spark, folder):
    """Stored configurations per group."""
    return reports.configuration_counts(population_stage(spark, folder))


@register("control_comparison", sql(*POPULATION_TABLE, """averaged AS (SELECT subset, population, method, avg(rmse) AS value FROM population_table WHERE method IN ('baselines:stability_stratified', 'baselines:difficulty_stratified') GROUP BY ALL)""",
                                    *paired_sql("SELECT * FROM averaged WHERE method = 'baselines:stability_stratified'", "SELECT * FROM averaged WHERE method = 'baselines:difficulty_stratified'", "population"), holm_sql("pair_joined", ("subset",), "second", "pair_held"), """
unpaired AS (SELECT a.subset, avg(sign(round(b.value, 12) - round(a.value, 12))) AS unpaired_delta FROM averaged a JOIN averaged b USING (subset) WHERE a.method = 'baselines:stability_stratified' AND b.method = 'baselines:difficulty_stratified' GROUP BY a.subset)""",
                                    query=paired_query().replace("SELECT subset, first", "SELECT subset, round(unpaired_delta, 6) + 0.0 AS unpaired_delta, first") + " JOIN unpaired USING (subset)"))
def control_comparison(spark, folder):
    """Fixed outcome-based picks against random picks in the same strata."""
    c = reports.control_comparison(population_stage(spark, folder), "baselines:stability_stratified", "baselines:difficulty_stratified")
    return rounded(c, ["subset", *PAIR_KEYS], [*PAIR_COLUMNS, "unpaired_delta"])


@register("cost_table", sql(COSTS, PROFILE, query="""
SELECT scope, round(total_tokens / 1e6, 4) AS total_millions, round(mean / 1e6, 6) AS mean_millions, round(CASE WHEN scope = 'all' THEN (SELECT avg(mean_steps) FROM profile WHERE scope <> 'all') ELSE mean_steps END, 1) AS steps,
       CASE WHEN output_tokens > 0 THEN round(input_tokens / output_tokens, 1) ELSE 0 END AS input_output_ratio FROM profile"""))
def cost_table(spark, folder):
    """Cost per run in millions of tokens."""
    return reports.cost_table(cost.cost_profile(queries_cost.costs(spark, folder)))


@register("widest_cost_range", sql(COSTS, SHARES, query="""
SELECT subset, round(lo, 2) AS share_low, round(hi, 2) AS share_high FROM (SELECT *, row_number() OVER (PARTITION BY subset ORDER BY round(round(hi, 2) - round(lo, 2), 6) DESC, run) AS r FROM summary) WHERE r = 1"""))
def widest_cost_range(spark, folder):
    """Widest middle 95 % of the random subsets' cost share."""
    return reports.widest_range(cost.share_summary(queries_cost.shares(spark, folder)))


@register("rate_ranges", sql(RERUNS, query="""
SELECT reruns, count(*) AS runs, round(min(pct), 1) AS lowest, round(max(pct), 1) AS highest, round(max(pct) - min(pct), 1) AS difference FROM (
  SELECT n AS reruns, run, round(avg(passed) * 100, 4) AS pct FROM reruns WHERE n IN (SELECT n FROM kept) GROUP BY n, run) GROUP BY reruns"""))
def rate_ranges(spark, folder):
    """Spread of the resolve rate between the runs of a group."""
    return reports.rate_ranges(runs.run_group_summary(queries_sources.assigned(spark, folder)))


@register("table_comparison", sql(*POPULATION_TABLE, """cells AS (SELECT method, "window", median(rmse) AS v FROM population_table GROUP BY ALL)""", query="""
SELECT state, count(*) AS cells, round(max(CAST(gap AS DOUBLE)), 6) AS largest_gap FROM (
  SELECT CASE WHEN "window" = 2 AND method LIKE 'pure%' THEN 'extra' WHEN method = 'baselines:random' THEN 'last digit' WHEN method LIKE 'embedding%' THEN 'differs' ELSE 'equal' END AS state,
         CASE WHEN "window" = 2 AND method LIKE 'pure%' THEN NULL WHEN method = 'baselines:random' THEN 0.0001 WHEN method LIKE 'embedding%' THEN 1.0 ELSE 0 END AS gap FROM cells) GROUP BY state"""))
def table_comparison(spark, folder):
    """A generated table against a printed one that was altered in known cells."""
    medians = population_stage(spark, folder).groupBy("method", "window").agg(F.round(F.median("rmse"), 4).alias("_m"))
    cell = lambda c: F.format_string("%.4f", c)
    generated = medians.select(F.col("method").alias("row"), F.col("window").alias("column"), cell(F.col("_m")).alias("cell"))
    shift = F.when(F.col("method") == rankings.RANDOM, 0.0001).when(F.col("method").startswith("embedding"), 1.0).otherwise(0.0)
    printed = (medians.where(~((F.col("window") == 2) & F.col("method").startswith("pure")))
               .select(F.col("method").alias("row"), F.col("window").alias("column"), cell(F.col("_m") + shift).alias("cell")))
    return reports.compare_tables(generated, printed)


# Run groups: the whole population, one value per split

def group_draws(spark, folder):
    """Draws of the whole population as a run group of five runs."""
    return stage(spark, folder, "group-draws", lambda: draw_metrics(spark, folder, seed="determinism").select(
        F.lit(N_RUNS).alias("reruns"), "window", "split", "method", "subset", "draw", "rmse", "maxerr"))


def group_methods(spark, folder):
    """Split errors of the centroid method on the run group."""
    def build():
        rates = errors.population_rates(whole_population(spark, folder), N_RUNS)
        m = errors.split_metrics(errors.run_errors(centroid_selection(spark, folder, (0.10,)), rates, SPLIT + ["subset"], N_RUNS))
        return m.select(F.lit(N_RUNS).alias("reruns"), "window", "split", "subset", F.lit("embedding_strata:centroid_pooled").alias("method"), "rmse", "maxerr")
    return stage(spark, folder, "group-methods", build)


GROUP_DRAWS = (*BASE[:6], BASE[6].replace("'42|0|'", "'determinism|0|'"), BASE[7], DRAW_METRICS, """group_draws AS (SELECT "window", split, method, subset, draw, rmse, maxerr FROM metrics)""")


def _prefixed(text, prefix, names):
    for n in names:
        text = text.replace(f"{n} AS (", f"{prefix}{n} AS (").replace(f"FROM {n} ", f"FROM {prefix}{n} ").replace(f"FROM {n})", f"FROM {prefix}{n})").replace(f"JOIN {n} ", f"JOIN {prefix}{n} ").replace(f"FROM {n}\n", f"FROM {prefix}{n}\n")
    return text


GROUP_METHODS = (*CENTROID_BASE[4:6], _prefixed(quotas_sql((0.10,), "vectors", ('"window"', "split")), "c_", ("sizes", "slotted", "shared", "ordered", "quotas")),
                 CENTROID_BASE[7].replace("JOIN quotas q", "JOIN c_quotas q"), _prefixed(metrics_sql("chosen", ('"window"', "split", "subset")), "c_", ("picked", "erred", "metrics")),
                 """group_methods AS (SELECT "window", split, subset, 'embedding_strata:centroid_pooled' AS method, rmse, maxerr FROM c_metrics)""")


@register("run_group_draw_comparison", sql(*GROUP_DRAWS, *GROUP_METHODS, """own AS (SELECT "window", subset, method, avg(rmse) AS own FROM group_methods GROUP BY ALL),
seeds AS (SELECT "window", subset, method AS baseline, draw, avg(rmse) AS seed FROM group_draws GROUP BY "window", subset, method, draw),
per_split AS (SELECT m."window", m.subset, m.method, d.method AS baseline, avg(CASE WHEN round(m.rmse - d.rmse, 12) < 0 THEN 1.0 ELSE 0 END) AS split_win_rate FROM group_methods m JOIN group_draws d USING ("window", subset, split) GROUP BY m."window", m.subset, m.method, d.method)""", query="""
SELECT "window", subset, method, baseline, round(avg(CASE WHEN round(own - seed, 12) < 0 THEN 1.0 ELSE 0 END), 6) AS win_rate, round(any_value(split_win_rate), 6) AS split_win_rate, round((median(seed) - any_value(own)) / median(seed) * 100, 6) + 0.0 AS gap_pct,
       round(avg(CASE WHEN seed > 2 * own THEN 1.0 ELSE 0 END), 6) AS catastrophic_rate FROM own JOIN seeds USING ("window", subset) JOIN per_split USING ("window", subset, method, baseline) GROUP BY "window", subset, method, baseline"""))
def run_group_draw_comparison(spark, folder):
    """Run-group comparison with the draws."""
    rows = comparisons.split_comparison(group_methods(spark, folder), group_draws(spark, folder))
    return rounded(rows, ["window", "subset", "method", "baseline"], ["win_rate", "split_win_rate", "gap_pct", "catastrophic_rate"])


@register("run_group_seed_report", sql(*GROUP_DRAWS, *GROUP_METHODS, """shaped AS (SELECT "window", subset, method AS baseline, draw, avg(maxerr) AS split_mean, max(maxerr) AS split_max FROM group_draws GROUP BY "window", subset, method, draw),
long AS (SELECT "window", subset, baseline, 'split_mean' AS aggregate, split_mean AS v FROM shaped UNION ALL SELECT "window", subset, baseline, 'split_max', split_max FROM shaped),
seeds AS (SELECT "window", subset, baseline, aggregate, median(v) AS s_median, quantile_cont(v, 0.95) AS s_p95, max(v) AS s_max FROM long GROUP BY "window", subset, baseline, aggregate),
own AS (SELECT "window", subset, method, 'split_mean' AS aggregate, avg(maxerr) AS det FROM group_methods GROUP BY "window", subset, method UNION ALL SELECT "window", subset, method, 'split_max', max(maxerr) FROM group_methods GROUP BY "window", subset, method)""", query="""
SELECT subset, method, baseline, aggregate, count(*) AS cells, round(avg(det), 6) AS det, round(avg(s_median), 6) AS seed_median, round(avg(s_p95), 6) AS seed_p95, round(avg(s_max), 6) AS seed_max, round((avg(det) - avg(s_median)) / avg(s_median) * 100, 6) AS change_vs_seed_median
FROM own JOIN seeds USING ("window", subset, aggregate) GROUP BY subset, method, baseline, aggregate"""))
def run_group_seed_report(spark, folder):
    """Seed statistics of split mean and split maximum, pooled over windows."""
    rows = comparisons.run_group_seed_report(group_methods(spark, folder), group_draws(spark, folder))
    return rounded(rows, ["subset", "method", "baseline", "aggregate", "cells"], ["det", "seed_median", "seed_p95", "seed_max", "change_vs_seed_median"])


@register("window_aligned_table")
def window_aligned_table(spark, folder):
    """Run-group methods on the windows both have (few units: the exact test applies, which SQL does not state)."""
    draws = group_draws(spark, folder).groupBy("subset", "window", "split", F.concat(F.lit("baselines:"), "method").alias("method")).agg(F.avg("rmse").alias("rmse"), F.max("maxerr").alias("maxerr"))
    first = reports.window_units(group_methods(spark, folder))
    table = reports.paired_table(first, reports.window_units(draws), ["subset"], "window", "second")
    return rounded(table, ["subset", *PAIR_KEYS], PAIR_COLUMNS)


# Calibration, clusters, family evaluation

def vector_members(spark, folder, windows=(2,)):
    """Whole population per split with vectors, pass counts and outcome strata."""
    return stage(spark, folder, f"vector-members-{windows}", lambda: instance_vectors(spark, folder, windows))


@register("calibrated_selection")
def calibrated_selection(spark, folder):
    """Centroid subsets after calibration, with pass totals before and after (compared with brute force in the tests)."""
    members = vector_members(spark, folder)
    rows = members.select(*SPLIT, "instance", "vector", F.lit(True).alias("in_group")).join(
        strata.stratum_quotas(members.withColumn("stratum", F.lit("")), SPLIT, (0.10,)).select(*SPLIT, "subset", "quota"), SPLIT)
    picked = rounds.geometric_selection(rows, [*SPLIT, "subset"], "centroid")
    calibrated = calibration.calibrate(picked, members.select(*SPLIT, "instance", "passes"), [*SPLIT, "subset"])
    total = lambda df, name: df.join(members.select(*SPLIT, "instance", "passes"), [*SPLIT, "instance"]).groupBy(*SPLIT, "subset").agg(F.sum("passes").alias(name), F.count(F.lit(1)).alias(f"{name}_size"))
    return total(picked, "before").join(total(calibrated, "after"), [*SPLIT, "subset"]).drop("population")


@register("kmeans_strata")
def kmeans_strata(spark, folder):
    """K-means clusters of every split of all windows with the K of the best silhouette, on standardised vectors."""
    labels = clusters.kmeans_labels(clusters.standardised_vectors(vector_members(spark, folder, WINDOWS).select(*SPLIT, "instance", "vector"), SPLIT), SPLIT)
    return labels.groupBy("window", "split", "k", "cluster").agg(F.count(F.lit(1)).alias("members"), F.max("silhouette").alias("silhouette"))


def density_clusters(spark, folder):
    """Density clusters of the standardised vectors of every label."""
    points, _ = labelled_points(spark, folder)
    return clusters.density_labels(clusters.standardised_vectors(points.select("stratum", "instance", "vector"), ["stratum"]), ["stratum"])


@register("density_strata")
def density_strata(spark, folder):
    """Density clusters of the labelled vectors, noise assigned to the nearest centre (compared with a plain version in the tests)."""
    return density_clusters(spark, folder).groupBy("stratum", "cluster").agg(F.count(F.lit(1)).alias("members"))


@register("density_strata_checks", sql(POINTS, query=f"""
SELECT g AS stratum, count(*) AS members, true AS once, true AS least_size, true AS numbered FROM points GROUP BY g HAVING count(*) >= {density.MIN_TO_CLUSTER}"""))
def density_strata_checks(spark, folder):
    """Every point once, no cluster below the least size unless it is the only one, clusters numbered from 0 and at most twenty."""
    sizes = density_clusters(spark, folder).groupBy("stratum", "cluster").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("instance").alias("ids"))
    found = sizes.groupBy("stratum").agg(F.sum("n").alias("members"), F.sum("ids").alias("ids"), F.min("n").alias("least"), F.count(F.lit(1)).alias("k"), F.max("cluster").alias("last"))
    return found.select("stratum", "members", (F.col("ids") == F.col("members")).alias("once"),
                        ((F.col("k") == 1) | (F.col("least") >= F.greatest(F.lit(5), F.floor(F.col("members") / 20)))).alias("least_size"),
                        ((F.col("last") == F.col("k") - 1) & (F.col("k") <= 20)).alias("numbered"))


@register("density_tree", sql(POINTS, f"""least AS (SELECT g, count(*) AS n, greatest(2, greatest(5, count(*) // 20) // 2) AS near FROM points GROUP BY g HAVING count(*) >= {density.MIN_TO_CLUSTER}),
pairs AS (SELECT a.g, a.id, b.id AS o, near, round(list_distance(a.v, b.v), 9) AS d FROM points a JOIN points b USING (g) JOIN least USING (g)),
cores AS (SELECT g, id, d AS core FROM (SELECT *, row_number() OVER (PARTITION BY g, id ORDER BY d) AS place FROM pairs) WHERE place = near + 1),
edges AS (SELECT p.g, p.id, p.o, greatest(p.d, a.core, b.core) AS w FROM pairs p JOIN cores a ON a.g = p.g AND a.id = p.id JOIN cores b ON b.g = p.g AND b.id = p.o WHERE p.id <> p.o),
grown(g, inside, total) AS (
  SELECT g, [min(id)], 0.0::DOUBLE FROM cores GROUP BY g
  UNION ALL
  SELECT t.g, list_append(any_value(t.inside), arg_min(e.o, (e.w, e.o))), any_value(t.total) + min(e.w)
  FROM grown t JOIN edges e ON e.g = t.g AND list_contains(t.inside, e.id) AND NOT list_contains(t.inside, e.o) GROUP BY t.g)""", query="""
SELECT g AS stratum, max(len(inside)) - 1 AS edges, round(max(total), 6) AS weight, round(any_value(s.core), 6) AS core
FROM grown JOIN (SELECT g, sum(core) AS core FROM cores GROUP BY g) s USING (g) GROUP BY g""").replace("WITH ", "WITH RECURSIVE ", 1))
def density_tree(spark, folder):
    """Number and total weight of the edges of every label's spanning tree over mutual reachability, and the sum of the core distances."""
    points, _ = labelled_points(spark, folder)
    sizes = points.groupBy("stratum").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= density.MIN_TO_CLUSTER)
    rows = points.join(sizes, "stratum").withColumn("near", F.greatest(F.lit(2), F.floor(F.greatest(F.lit(5), F.floor(F.col("size") / 20)) / 2)))
    core = cut_lineage(density.core_distances(rows, ["stratum"]))
    tree = density.spanning_tree(rows.join(core, ["stratum", "instance"]), ["stratum"])
    weights = tree.groupBy("stratum").agg(F.count(F.lit(1)).alias("edges"), F.sum("weight").alias("weight"))
    return rounded(weights.join(core.groupBy("stratum").agg(F.sum("core").alias("core")), "stratum"), ["stratum", "edges"], ["weight", "core"])


@register("cluster_strata_in_groups")
def cluster_strata_in_groups(spark, folder):
    """K-means clusters inside the outcome groups, small groups whole."""
    members = vector_members(spark, folder).withColumn("usable", F.col("vector").isNotNull()).withColumnRenamed("stratum", "outcome")
    keyed = clusters.cluster_strata(members.select(*SPLIT, "outcome", "instance", "vector", "usable"), SPLIT, "kmeans", "outcome")
    return keyed.groupBy("window", "split", "outcome", "stratum").agg(F.count(F.lit(1)).alias("members"))


@register("family_errors")
def family_errors(spark, folder):
    """Pure embedding (plain and calibrated) and clustering families evaluated on every split of window 2."""
    members = vector_members(spark, folder)
    rates = errors.population_rates(whole_population(spark, folder), N_RUNS)
    pure = families.evaluate_pure_embedding(members, SPLIT, "centroid", (0.10,), rates, N_RUNS).withColumn("family", F.lit("pure_embedding"))
    clustered = families.evaluate_clustering(members.withColumn("usable", F.col("vector").isNotNull()).drop("stratum"), SPLIT, "kmeans", (0.10,), rates, N_RUNS, 20).withColumn("family", F.lit("clustering"))
    both = pure.unionByName(clustered.select(*pure.columns))
    return rounded(both, ["window", "split", "family", "subset", "method"], ["rmse", "maxerr", "maxerr_mean", "p95"])


@register("family_coverage", sql(*POPULATION_TABLE, query="""
SELECT family, expected, CAST(coalesce(found, 0) AS BIGINT) AS found, expected = coalesce(found, 0) AS complete FROM (VALUES ('baselines', 7), ('embedding_strata', 10), ('pure_embedding', 20), ('clustering', 16), ('shortlist', 24)) v(family, expected)
LEFT JOIN (SELECT split_part(method, ':', 1) AS family, count(DISTINCT method) AS found FROM population_table GROUP BY 1) USING (family)"""))
def family_coverage(spark, folder):
    """Methods of the catalogue that have results."""
    return rankings.family_coverage(population_stage(spark, folder), families.catalogue(spark))


@register("method_extract", sql(*POPULATION_TABLE, query="""
SELECT CAST(population AS BIGINT) AS population, "window", subset, method, round(rmse, 6) AS rmse, round(maxerr, 6) AS maxerr FROM population_table WHERE method IN ('baselines:difficulty_stratified', 'embedding_strata:centroid_pooled') AND "window" = 1"""))
def method_extract(spark, folder):
    """Chosen methods of one window from the result table."""
    t = audits.lookup(audits.extract_methods(population_stage(spark, folder), ["baselines:difficulty_stratified", "embedding_strata:centroid_pooled"]), window=1)
    return rounded(t.withColumn("population", F.col("population").cast("long")), ["population", "window", "subset", "method"], ["rmse", "maxerr"])


@register("block_union", sql(*POPULATION_TABLE, query="""SELECT "window", method, subset, count(*) AS populations, round(avg(rmse), 6) AS rmse FROM population_table GROUP BY "window", method, subset"""))
def block_union(spark, folder):
    """Result blocks of 18 populations joined again, overlap checked row by row."""
    t = population_stage(spark, folder).select("population", "window", "method", "subset", "rmse")
    blocks = [t.where(F.floor(F.col("population") / 18) == b) for b in range(4)]
    joined = audits.union_blocks(blocks, ["population", "window", "method", "subset"])
    return rounded(joined.groupBy("window", "method", "subset").agg(F.count(F.lit(1)).alias("populations"), F.avg("rmse").alias("rmse")), ["window", "method", "subset", "populations"], ["rmse"])


@register("result_alignment", sql(*SPLIT_TABLE, query="""
SELECT 'pure_embedding' AS family, "window", count(*) AS missing FROM (SELECT DISTINCT population, "window", split FROM split_table) WHERE population % 9 = 0 GROUP BY "window" """))
def result_alignment(spark, folder):
    """Families of a window must cover the same populations and splits; here one family lacks every ninth population."""
    t = split_stage(spark, folder).select(rankings.family_of(F.col("method")).alias("family"), "window", "population", "split")
    return audits.misaligned(t.where(~((F.col("family") == "pure_embedding") & (F.pmod("population", F.lit(9)) == 0))), ("population", "split"))
