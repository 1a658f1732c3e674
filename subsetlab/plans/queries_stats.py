"""Queries on the study's error tables: statistics, rankings and comparisons with seeded draws."""
from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..operators import comparisons, rankings, stats
from . import inputs
from .inputs import N_RUNS, sql
from .study import draw_stage, population_stage, split_stage
from .study_sql import DRAWS_TABLE, POPULATION_TABLE, SPLIT_TABLE, WITH_OVERALL

QUERIES, ORACLE = {}, {}


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def rounded(df, keys, values, digits=6):
    """Keys as they are, values rounded."""
    return df.select(*keys, *[clean(F.col(v), digits).alias(v) for v in values])


def r_(columns, digits=6):
    """SQL select list of rounded columns."""
    return ", ".join(f"round({c}, {digits}) + 0.0 AS {c}" for c in columns)


def p_two(z):
    """SQL: two-sided normal p of a z score, by the series of the error function."""
    return (f"(1 - 2 * exp(-{z} * {z} / 2) / sqrt(2 * pi()) * coalesce(list_sum(list_transform(range(300), lambda k: "
            f"exp((2 * k + 1) * ln(greatest(abs({z}), 1e-300)) - (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))), 0))")


def signed_rank_sql(source, keys, d, name="tests"):
    """CTEs of a two-sided signed-rank test (normal form; p is 1 when nothing differs)."""
    k = ", ".join(keys)
    return f"""{name}_d AS (SELECT {k}, round({d}, 12) AS d FROM {source} WHERE {d} IS NOT NULL),
{name}_r AS (
  SELECT *, rank() OVER (PARTITION BY {k} ORDER BY abs(d)) + (count(*) OVER (PARTITION BY {k}, abs(d)) - 1) / 2.0 AS r, count(*) OVER (PARTITION BY {k}, abs(d)) AS t FROM {name}_d WHERE d <> 0),
{name}_s AS (
  SELECT {k}, count(*) AS nonzero, sum(CASE WHEN d > 0 THEN r ELSE 0 END) AS w_plus, sum(CASE WHEN d < 0 THEN r ELSE 0 END) AS w_minus, sum(t * t - 1)::DOUBLE AS tie_term FROM {name}_r GROUP BY {k}),
{name}_z AS (
  SELECT {k}, c.n, coalesce(nonzero, 0) AS nonzero, coalesce(w_plus, 0) AS w_plus, coalesce(w_minus, 0) AS w_minus,
         (w_plus - nonzero * (nonzero + 1) / 4.0) / sqrt(nonzero * (nonzero + 1.0) * (2 * nonzero + 1) / 24 - tie_term / 48) AS z
  FROM (SELECT {k}, count(*) AS n FROM {name}_d GROUP BY {k}) c LEFT JOIN {name}_s USING ({k})),
{name} AS (SELECT *, coalesce({p_two("z")}, 1.0) AS p_value FROM {name}_z)"""


def holm_sql(source, keys, tie, name):
    """CTEs of a Holm adjustment."""
    k = ", ".join(keys)
    return f"""{name} AS (
  SELECT *, least(1.0, max(step) OVER (PARTITION BY {k} ORDER BY p_value, {tie} ROWS UNBOUNDED PRECEDING)) AS holm_p FROM (
    SELECT *, p_value * (count(*) OVER (PARTITION BY {k}) - row_number() OVER (PARTITION BY {k} ORDER BY p_value, {tie}) + 1) AS step FROM {source}))"""


CELL = ('"window"', "subset", "method")
REFERENCE = """CASE WHEN "window" = 1 THEN 'baselines:difficulty_stratified' ELSE 'baselines:consistency_stratified' END"""
DESCRIBED = ("mean", "median", "std", "iqr", "p5", "p25", "p75", "p95", "min", "max")
DESCRIBE_SQL = """avg({v}) AS mean, median({v}) AS median, CASE WHEN count(*) > 1 THEN stddev_samp({v}) ELSE 0 END AS std, quantile_cont({v}, 0.75) - quantile_cont({v}, 0.25) AS iqr, quantile_cont({v}, 0.05) AS p5,
  quantile_cont({v}, 0.25) AS p25, quantile_cont({v}, 0.75) AS p75, quantile_cont({v}, 0.95) AS p95, min({v}) AS min, max({v}) AS max, count(*) AS n"""


@register("study_split_metrics", sql(*SPLIT_TABLE, query=f"""
SELECT CAST(population AS BIGINT) AS population, "window", split, method, subset, {r_(("rmse", "maxerr", "maxerr_mean", "p95"))} FROM split_table"""))
def study_split_metrics(spark, folder):
    """Split metrics of all study methods on all populations."""
    return rounded(split_stage(spark, folder).withColumn("population", F.col("population").cast("long")), ["population", "window", "split", "method", "subset"], ["rmse", "maxerr", "maxerr_mean", "p95"])


@register("study_population_metrics", sql(*POPULATION_TABLE, query=f"""
SELECT CAST(population AS BIGINT) AS population, "window", method, subset, {r_(("rmse", "maxerr", "maxerr_mean", "p95"))} FROM population_table"""))
def study_population_metrics(spark, folder):
    """Metrics per population."""
    return rounded(population_stage(spark, folder).withColumn("population", F.col("population").cast("long")), ["population", "window", "method", "subset"], ["rmse", "maxerr", "maxerr_mean", "p95"])


@register("per_seed_draws", sql(*SPLIT_TABLE, *DRAWS_TABLE, query=f"""SELECT CAST(population AS BIGINT) AS population, "window", subset, method, draw, {r_(("rmse", "maxerr"))} FROM draws"""))
def per_seed_draws(spark, folder):
    """Per-seed values of an independent draw stream."""
    d = draw_stage(spark, folder).withColumn("population", F.col("population").cast("long")).withColumn("draw", F.col("draw").cast("long"))
    return rounded(d, ["population", "window", "subset", "method", "draw"], ["rmse", "maxerr"])


@register("describe_errors", sql(*POPULATION_TABLE, f'described AS (SELECT "window", subset, method, {DESCRIBE_SQL.format(v="rmse")} FROM population_table GROUP BY "window", subset, method)', query=f"""
SELECT "window", subset, method, n, {r_(DESCRIBED)} FROM described"""))
def describe_errors(spark, folder):
    """A1: description of the RMSE of every method."""
    return rounded(stats.describe(population_stage(spark, folder), ["window", "subset", "method"], "rmse"), ["window", "subset", "method", "n"], DESCRIBED)


PAIRED = f"""paired AS (
  SELECT t."window", t.subset, t.method, t.population, t.rmse, t.maxerr, r.rmse AS ref, r.maxerr AS ref_max, r.method AS reference, r.rmse - t.rmse AS d
  FROM (SELECT *, {REFERENCE} AS wanted FROM with_overall) t JOIN with_overall r ON r.population = t.population AND r."window" = t."window" AND r.subset = t.subset AND r.method = t.wanted WHERE t.method <> t.wanted)"""


@register("signed_rank_tests", sql(*POPULATION_TABLE, WITH_OVERALL, PAIRED, signed_rank_sql("paired", CELL, "d"), query="""
SELECT "window", subset, method, n, nonzero, round(w_plus, 4) AS w_plus, round(w_minus, 4) AS w_minus, round(z, 6) AS z, round(p_value, 6) + 0.0 AS p_value FROM tests"""))
def signed_rank_tests(spark, folder):
    """A2: signed-rank test of every method against the strongest baseline."""
    table = rankings.with_overall(population_stage(spark, folder))
    marked = table.withColumn("_ref", rankings.strongest_baseline(F.col("window")))
    base = marked.where(F.col("method") == F.col("_ref")).select("window", "subset", "population", F.col("rmse").alias("_r"))
    paired = marked.where(F.col("method") != F.col("_ref")).join(base, ["window", "subset", "population"]).withColumn("_d", F.col("_r") - F.col("rmse"))
    tests = stats.signed_rank(paired, ["window", "subset", "method"], "_d")
    return tests.select("window", "subset", "method", "n", "nonzero", clean(F.col("w_plus"), 4).alias("w_plus"), clean(F.col("w_minus"), 4).alias("w_minus"), clean(F.col("z")).alias("z"), clean(F.col("p_value")).alias("p_value"))


MAGNITUDE = "CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END"
COMPARED = """compared AS (
  SELECT "window", subset, method, any_value(reference) AS reference, median(rmse) AS median, avg(rmse) AS mean, avg(sign(round(ref - rmse, 12))) AS delta, (avg(ref) - avg(rmse)) / avg(ref) * 100 AS imp_rmse,
         (avg(ref_max) - avg(maxerr)) / avg(ref_max) * 100 AS imp_maxerr, count(*) FILTER (rmse < ref - 0.01 * ref) AS wins, count(*) FILTER (rmse > ref + 0.01 * ref) AS losses, count(*) AS n
  FROM paired GROUP BY "window", subset, method)"""


@register("reference_comparison", sql(*POPULATION_TABLE, WITH_OVERALL, PAIRED, signed_rank_sql("paired", CELL, "d"), COMPARED,
                                      'joined AS (SELECT c.*, t.p_value FROM compared c JOIN tests t USING ("window", subset, method))', holm_sql("joined", ('"window"', "subset"), "method", "held"), query=f"""
SELECT "window", subset, method, reference, wins, n - wins - losses AS ties, losses, {MAGNITUDE} AS magnitude, {r_(("median", "mean", "delta", "imp_rmse", "imp_maxerr", "p_value", "holm_p"))} FROM held"""))
def reference_comparison(spark, folder):
    """Every method against the strongest baseline, with Holm adjustment."""
    table = rankings.with_overall(population_stage(spark, folder))
    rows = rankings.comparison_rows(table, rankings.strongest_baseline(F.col("window")))
    return rounded(rows, ["window", "subset", "method", "reference", "wins", "ties", "losses", "magnitude"], ["median", "mean", "delta", "imp_rmse", "imp_maxerr", "p_value", "holm_p"])


@register("window_averages", sql(*POPULATION_TABLE, WITH_OVERALL, query=f"""SELECT CAST(population AS BIGINT) AS population, method, subset, {r_(("rmse", "maxerr", "p95"), 8)} FROM with_overall WHERE "window" = 0"""))
def window_averages(spark, folder):
    """Equal-weight mean over the windows a method exists in."""
    w = rankings.window_average(population_stage(spark, folder)).withColumn("population", F.col("population").cast("long"))
    return rounded(w, ["population", "method", "subset"], ["rmse", "maxerr", "p95"], 8)


@register("unpaired_delta", sql(*POPULATION_TABLE, query="""
SELECT a."window", a.subset, a.method, round((sum(CASE WHEN round(b.rmse, 12) > round(a.rmse, 12) THEN 1 ELSE 0 END) - sum(CASE WHEN round(b.rmse, 12) < round(a.rmse, 12) THEN 1 ELSE 0 END)) / count(*), 6) + 0.0 AS delta
FROM population_table a JOIN population_table b ON b."window" = a."window" AND b.subset = a.subset AND b.method = 'baselines:random' WHERE a.method <> 'baselines:random' GROUP BY ALL"""))
def unpaired_delta(spark, folder):
    """A4: Cliff's delta over all pairs against random, in rank-sum form."""
    table = population_stage(spark, folder)
    others = table.where(F.col("method") != rankings.RANDOM).select("window", "subset", "method", "rmse", F.lit(1).alias("sample"))
    names = others.select("window", "subset", "method").distinct()
    base = table.where(F.col("method") == rankings.RANDOM).select("window", "subset", "rmse", F.lit(2).alias("sample")).join(names, ["window", "subset"])
    return rounded(stats.unpaired_delta(others.unionByName(base), ["window", "subset", "method"], "sample", "rmse"), ["window", "subset", "method"], ["delta"])


PS = "CASE WHEN abs(ps - 0.5) < 0.06 THEN 'negligible' WHEN abs(ps - 0.5) < 0.14 THEN 'small' WHEN abs(ps - 0.5) < 0.21 THEN 'medium' ELSE 'large' END"


@register("superiority", sql(*POPULATION_TABLE, WITH_OVERALL, f"""scored AS (
  SELECT t."window", t.subset, t.method, avg(CASE WHEN round(t.rmse - r.rmse, 12) < 0 THEN 1.0 WHEN round(t.rmse - r.rmse, 12) = 0 THEN 0.5 ELSE 0 END) AS ps
  FROM (SELECT *, {REFERENCE} AS wanted FROM with_overall) t JOIN with_overall r ON r.population = t.population AND r."window" = t."window" AND r.subset = t.subset AND r.method = t.wanted GROUP BY ALL)""", query=f"""
SELECT "window", subset, method, round(ps, 6) AS ps, {PS} AS magnitude FROM scored"""))
def superiority(spark, folder):
    """Probability of superiority over the strongest baseline."""
    rows = rankings.superiority_rows(rankings.with_overall(population_stage(spark, folder)), rankings.strongest_baseline(F.col("window")))
    return rounded(rows, ["window", "subset", "method", "magnitude"], ["ps"])


@register("range_violations", sql(*POPULATION_TABLE, query="""
SELECT method, count(*) FILTER (maxerr > 15) AS outside, round(min(maxerr), 6) AS min, round(max(maxerr), 6) AS max FROM population_table GROUP BY method HAVING count(*) FILTER (maxerr > 15) > 0"""))
def range_violations(spark, folder):
    """Methods with MaxErr values above a limit; the full 0-100 range is enforced in the job itself."""
    table = stats.checked_range(population_stage(spark, folder), "maxerr", 0.0, 100.0)
    return rounded(stats.range_violations(table, ["method"], "maxerr", 0.0, 15.0), ["method", "outside"], ["min", "max"])


@register("fisher_combination", sql(*POPULATION_TABLE, WITH_OVERALL, PAIRED, signed_rank_sql("paired", CELL, "d"), query="""
SELECT subset, method, combined, round(statistic, 4) AS statistic, round(CASE WHEN combined >= 2 THEN exp(-statistic / 2) * list_sum(list_transform(range(combined), lambda i: exp(i * ln(greatest(statistic / 2, 1e-300)) - lgamma(i + 1)))) ELSE single END, 6) AS combined_p
FROM (SELECT subset, method, count(*) AS combined, -2 * sum(ln(greatest(p_value, 1e-7))) AS statistic, any_value(p_value) AS single FROM tests WHERE "window" > 0 GROUP BY subset, method)"""))
def fisher_combination(spark, folder):
    """P-values combined over windows."""
    table = population_stage(spark, folder)
    rows = rankings.comparison_rows(table, rankings.strongest_baseline(F.col("window"))).withColumn("p_value", F.greatest("p_value", F.lit(1e-7)))
    f = stats.fisher(rows, ["subset", "method"])
    return f.select("subset", "method", "combined", clean(F.col("statistic"), 4).alias("statistic"), clean(F.col("combined_p")).alias("combined_p"))


@register("top_methods", sql(*POPULATION_TABLE, WITH_OVERALL, f"""means AS (SELECT "window", subset, method, avg(rmse) AS mean_rmse, avg(maxerr) AS mean_maxerr, {REFERENCE} AS reference FROM with_overall GROUP BY "window", subset, method),
placed AS (SELECT *, row_number() OVER (PARTITION BY "window", subset ORDER BY round(mean_rmse, 12), round(mean_maxerr, 12), method) AS place FROM means)""", query="""
SELECT "window", subset, method, place, place > 3 AS reference_only, round(mean_rmse, 6) AS mean_rmse FROM placed WHERE place <= 3 OR method = reference OR method = 'baselines:random'"""))
def top_methods(spark, folder):
    """A10: three best methods per window plus marked references."""
    t = rankings.top_methods(rankings.with_overall(population_stage(spark, folder)), 3)
    return t.select("window", "subset", "method", F.col("place").cast("long").alias("place"), "reference_only", clean(F.col("mean_rmse")).alias("mean_rmse"))


@register("compared_methods", sql(*POPULATION_TABLE, WITH_OVERALL, """placed AS (
  SELECT "window", subset, method, row_number() OVER (PARTITION BY "window", subset ORDER BY round(avg(rmse), 12), round(avg(maxerr), 12), method) AS place FROM with_overall GROUP BY "window", subset, method)""", query="""
SELECT "window", subset, method FROM placed WHERE place <= 2 OR method IN ('baselines:random', 'baselines:difficulty_stratified', 'baselines:consistency_stratified')"""))
def compared_methods(spark, folder):
    """References and top methods."""
    return rankings.compared_methods(rankings.with_overall(population_stage(spark, folder)), 2)


@register("dominance_ranks", sql(*POPULATION_TABLE, """method_pairs AS (
  SELECT a."window", a.subset, a.method AS first, b.method AS second, b.rmse - a.rmse AS d FROM population_table a JOIN population_table b ON a.population = b.population AND a."window" = b."window" AND a.subset = b.subset AND a.method < b.method)""",
                                 signed_rank_sql("method_pairs", ('"window"', "subset", "first", "second"), "d"), holm_sql("tests", ('"window"', "subset"), "first || '|' || second", "held"), """
medians AS (SELECT "window", subset, method, round(median(rmse), 12) AS m FROM population_table GROUP BY ALL)""", query="""
SELECT m."window", m.subset, m.method, count(h.first) AS beaten_by FROM medians m LEFT JOIN (
  SELECT h."window", h.subset, h.first, CASE WHEN a.m < b.m THEN h.second ELSE h.first END AS loser FROM held h JOIN medians a ON a."window" = h."window" AND a.subset = h.subset AND a.method = h.first
  JOIN medians b ON b."window" = h."window" AND b.subset = h.subset AND b.method = h.second WHERE h.holm_p < 0.05 AND a.m <> b.m) h ON h."window" = m."window" AND h.subset = m.subset AND h.loser = m.method GROUP BY ALL"""))
def dominance_ranks(spark, folder):
    """Number of methods that beat each method significantly."""
    return rankings.dominance_ranks(population_stage(spark, folder))


@register("error_distributions", sql(*POPULATION_TABLE, *DRAWS_TABLE, f"""pooled AS (
  SELECT "window", subset, 'baselines:' || method AS method, rmse FROM draws
  UNION ALL SELECT "window", subset, method, rmse FROM population_table WHERE method NOT IN (SELECT 'baselines:' || method FROM draws)),
described AS (SELECT "window", subset, method, {DESCRIBE_SQL.format(v="rmse")} FROM pooled GROUP BY "window", subset, method)""", query=f"""SELECT "window", subset, method, n, {r_(DESCRIBED)} FROM described"""))
def error_distributions(spark, folder):
    """Baselines described over all their draws, other methods over populations."""
    return rounded(rankings.error_distributions(population_stage(spark, folder), draw_stage(spark, folder)), ["window", "subset", "method", "n"], DESCRIBED)


@register("tail_exceedance", sql(*POPULATION_TABLE, f"""marked AS (SELECT *, {REFERENCE} AS wanted FROM population_table),
limits AS (SELECT "window", subset, quantile_cont(rmse, 0.75) AS a, quantile_cont(rmse, 0.9) AS b, quantile_cont(rmse, 0.95) AS c FROM marked WHERE method = wanted GROUP BY ALL)""", query="""
SELECT "window", subset, method, round(avg(CASE WHEN round(rmse - a, 12) > 0 THEN 1.0 ELSE 0 END), 6) AS above_p75, round(avg(CASE WHEN round(rmse - b, 12) > 0 THEN 1.0 ELSE 0 END), 6) AS above_p90, round(avg(CASE WHEN round(rmse - c, 12) > 0 THEN 1.0 ELSE 0 END), 6) AS above_p95
FROM marked JOIN limits USING ("window", subset) GROUP BY "window", subset, method"""))
def tail_exceedance(spark, folder):
    """Share of values above the reference's upper percentiles."""
    rows = rankings.tail_exceedance(population_stage(spark, folder), rankings.strongest_baseline(F.col("window")))
    return rounded(rows, ["window", "subset", "method"], ["above_p75", "above_p90", "above_p95"])


DRAW_PAIRS = """draw_pairs AS (
  SELECT t."window", t.subset, t.method, d.method AS baseline, t.population, t.level, d.draw, t.rmse AS own, t.maxerr AS own_max, d.rmse AS drawn, d.maxerr AS drawn_max
  FROM population_table t JOIN draws d USING (population, "window", subset) WHERE t.method NOT LIKE 'baselines:%')"""


@register("draw_record", sql(*POPULATION_TABLE, *DRAWS_TABLE, DRAW_PAIRS, query="""
SELECT "window", subset, method, baseline, count(*) FILTER (own < drawn - 0.01 * drawn) AS win, count(*) FILTER (own BETWEEN drawn - 0.01 * drawn AND drawn + 0.01 * drawn) AS tie,
       count(*) FILTER (own > drawn + 0.01 * drawn) AS loss, count(*) AS n, round(count(*) FILTER (own < drawn - 0.01 * drawn) / count(*), 6) AS win_fraction FROM draw_pairs GROUP BY ALL"""))
def draw_record(spark, folder):
    """Win / tie / loss against every draw."""
    rows = rankings.draw_record(population_stage(spark, folder), draw_stage(spark, folder))
    return rows.select("window", "subset", "method", "baseline", "win", "tie", "loss", "n", clean(F.col("win_fraction")).alias("win_fraction"))


@register("prediction_horizon", sql(*SPLIT_TABLE, """horizons AS (
  SELECT t."window", t.subset, t.method, len(s.test) AS horizon, median(t.rmse) AS median FROM split_table t JOIN splits s USING ("window", split) GROUP BY ALL),
hranked AS (SELECT *, rank() OVER (PARTITION BY "window", subset, method ORDER BY horizon) AS rh, rank() OVER (PARTITION BY "window", subset, method ORDER BY round(median, 12)) + (count(*) OVER (PARTITION BY "window", subset, method, round(median, 12)) - 1) / 2.0 AS rm FROM horizons)""", query="""
SELECT "window", subset, method, horizon, round(median, 6) AS median, round(CASE WHEN count(*) OVER (PARTITION BY "window", subset, method) >= 3 THEN corr(rh, rm) OVER (PARTITION BY "window", subset, method) END, 6) + 0.0 AS rho FROM hranked"""))
def prediction_horizon(spark, folder):
    """Median split error by number of test runs."""
    from ..operators import splits
    sizes = splits.temporal_splits(spark, N_RUNS, (1, 2)).select("window", "split", F.size("test").cast("long").alias("horizon"))
    rows = rankings.horizon(split_stage(spark, folder).join(sizes, ["window", "split"]))
    return rounded(rows, ["window", "subset", "method", "horizon"], ["median", "rho"])


BEST = """cells AS (SELECT "window", level, subset, method, round(avg(rmse), 12) AS value FROM population_table GROUP BY ALL),
best AS (SELECT *, row_number() OVER w AS place, lead(method) OVER w AS runner_up, lead(value) OVER w AS runner_up_value FROM cells WINDOW w AS (PARTITION BY "window", level, subset ORDER BY value, method))"""


@register("best_methods", sql(*POPULATION_TABLE, BEST, query="""
SELECT "window", CAST(level AS BIGINT) AS level, subset, method AS best, round(value, 6) AS best_value, runner_up, round(runner_up_value, 6) AS runner_up_value FROM best WHERE place = 1"""))
def best_methods(spark, folder):
    """Best method and runner-up per window and level."""
    b = rankings.best_methods(population_stage(spark, folder)).withColumn("level", F.col("level").cast("long"))
    return rounded(b, ["window", "level", "subset", "best", "runner_up"], ["best_value", "runner_up_value"])


@register("win_frequency", sql(*POPULATION_TABLE, BEST, query="SELECT method, count(*) AS cells FROM best WHERE place = 1 GROUP BY method"))
def win_frequency(spark, folder):
    """How often each method is best."""
    return rankings.win_frequency(rankings.best_methods(population_stage(spark, folder)))


@register("all_methods", sql(*POPULATION_TABLE, WITH_OVERALL, """named AS (SELECT *, CASE method WHEN 'embedding_strata:centroid_pooled' THEN 'Centroid Pooled [ES]' WHEN 'pure_embedding:centroid_pooled' THEN 'Centroid Pooled [PE]' WHEN 'baselines:random' THEN 'Random'
  WHEN 'baselines:difficulty_stratified' THEN 'Diff-Strat' WHEN 'baselines:consistency_stratified' THEN 'Consist-Strat' WHEN 'baselines:repo_stratified' THEN 'Repo-Strat' WHEN 'baselines:repo_difficulty_stratified' THEN 'Repo×Diff'
  WHEN 'baselines:repo_consistency_stratified' THEN 'Repo×Consist' ELSE 'Stability Stratified' END AS label FROM with_overall)""", query="""
SELECT "window", subset, method, any_value(label) AS label, split_part(method, ':', 1) AS family, round(avg(rmse), 6) AS rmse_mean, round(quantile_cont(rmse, 0.95), 6) AS rmse_p95, round(median(maxerr), 6) AS maxerr_median, count(*) AS n FROM named GROUP BY "window", subset, method"""))
def all_methods(spark, folder):
    """Statistics, family and label of every method."""
    a = rankings.all_methods(rankings.with_overall(population_stage(spark, folder)))
    return a.select("window", "subset", "method", "label", "family", clean(F.col("rmse.mean")).alias("rmse_mean"), clean(F.col("rmse.p95")).alias("rmse_p95"), clean(F.col("maxerr.median")).alias("maxerr_median"), F.col("rmse.n").alias("n"))


UNITS = """units AS (
  SELECT "window", subset, method, baseline, population, any_value(level) AS level, any_value(own) AS own, avg(CASE WHEN round(own - drawn, 12) < 0 THEN 1.0 ELSE 0 END) AS win_share, avg(CASE WHEN round(own - drawn, 12) = 0 THEN 1.0 ELSE 0 END) AS tie_share,
         median(drawn) AS median_draw, count(*) FILTER (drawn > 2 * own) AS catastrophic, count(*) AS draws FROM draw_pairs GROUP BY "window", subset, method, baseline, population),
gaps AS (SELECT *, CASE WHEN median_draw > 0 THEN (median_draw - own) / median_draw * 100 ELSE 0 END AS gap_pct FROM units)"""
UNIT_KEYS = ["window", "subset", "method", "baseline"]


def _units(spark, folder):
    table = population_stage(spark, folder).where(rankings.family_of(F.col("method")) != "baselines")
    return comparisons.unit_comparison(table, draw_stage(spark, folder))


@register("draw_comparison", sql(*POPULATION_TABLE, *DRAWS_TABLE, DRAW_PAIRS, UNITS, query="""
SELECT "window", subset, method, baseline, count(*) FILTER (own < median_draw - 0.01 * median_draw) AS win, count(*) FILTER (own BETWEEN median_draw - 0.01 * median_draw AND median_draw + 0.01 * median_draw) AS tie,
       count(*) FILTER (own > median_draw + 0.01 * median_draw) AS loss, count(*) AS n, round(avg(win_share) * 100, 6) AS win_rate, round(avg(win_share + 0.5 * tie_share) * 100, 6) AS percentile, round(avg(own), 6) AS method_rmse,
       round(avg(gap_pct), 6) AS gap_pct, round(median(gap_pct), 6) + 0.0 AS gap_median_pct, round(sum(catastrophic) / sum(draws) * 100, 6) AS catastrophic_rate FROM gaps GROUP BY "window", subset, method, baseline"""))
def draw_comparison(spark, folder):
    """Methods against the draws of every baseline."""
    return rounded(comparisons.draw_comparison(_units(spark, folder)), UNIT_KEYS + ["win", "tie", "loss", "n"], ["win_rate", "percentile", "method_rmse", "gap_pct", "gap_median_pct", "catastrophic_rate"])


@register("draw_comparison_intervals")
def draw_comparison_intervals(spark, folder):
    """The same with exact and Student intervals (interval functions are unit-tested)."""
    rows = comparisons.with_intervals(comparisons.draw_comparison(_units(spark, folder)))
    return rounded(rows, UNIT_KEYS + ["win", "n"], ["gap_pct", "gap_low", "gap_high", "win_low", "win_high"])


@register("win_statistics", sql(*POPULATION_TABLE, *DRAWS_TABLE, DRAW_PAIRS, UNITS, query="""
SELECT "window", subset, method, baseline, count(*) AS n, round(avg(win_share), 6) AS mean, round(median(win_share), 6) AS median, round(stddev_samp(win_share), 6) AS std, round(quantile_cont(win_share, 0.25), 6) AS p25, round(quantile_cont(win_share, 0.75), 6) AS p75,
       round(avg(CASE WHEN win_share > 0.5 THEN 1.0 ELSE 0 END), 6) AS majority, round(avg(CASE WHEN win_share > 0.8 THEN 1.0 ELSE 0 END), 6) AS supermajority, round(avg(CASE WHEN win_share < 0.5 THEN 1.0 ELSE 0 END), 6) AS minority
FROM units GROUP BY "window", subset, method, baseline"""))
def win_statistics(spark, folder):
    """Distribution of the per-population win shares."""
    return rounded(comparisons.win_statistics(_units(spark, folder)), UNIT_KEYS + ["n"], ["mean", "median", "std", "p25", "p75", "majority", "supermajority", "minority"])


@register("level_win_statistics", sql(*POPULATION_TABLE, *DRAWS_TABLE, DRAW_PAIRS, UNITS, query="""
SELECT "window", subset, method, baseline, CAST(level AS BIGINT) AS level, count(*) AS n, round(avg(win_share), 6) AS mean, round(median(win_share), 6) AS median, round(stddev_samp(win_share), 6) AS std, round(avg(CASE WHEN win_share > 0.5 THEN 1.0 ELSE 0 END), 6) AS majority
FROM units GROUP BY "window", subset, method, baseline, level HAVING count(*) >= 2"""))
def level_win_statistics(spark, folder):
    """C4: win shares per difficulty level."""
    rows = comparisons.level_statistics(_units(spark, folder)).withColumn("level", F.col("level").cast("long"))
    return rounded(rows, UNIT_KEYS + ["level", "n"], ["mean", "median", "std", "majority"])


@register("band_placement", sql(*POPULATION_TABLE, *DRAWS_TABLE, """own AS (SELECT population, subset, method, avg(rmse) AS v FROM population_table WHERE method NOT LIKE 'baselines:%' GROUP BY ALL),
averaged AS (SELECT population, subset, method AS baseline, draw, avg(rmse) AS d FROM draws WHERE method = 'difficulty_stratified' GROUP BY population, subset, method, draw),
band AS (SELECT population, subset, baseline, quantile_cont(d, 0.025) AS lo, quantile_cont(d, 0.975) AS hi FROM averaged GROUP BY ALL)""", query="""
SELECT subset, method, baseline, count(*) AS n, round(100 * avg(CASE WHEN round(v - lo, 12) < 0 THEN 1.0 ELSE 0 END), 1) AS below, round(100 * avg(CASE WHEN round(v - lo, 12) >= 0 AND round(v - hi, 12) <= 0 THEN 1.0 ELSE 0 END), 1) AS inside,
       round(100 * avg(CASE WHEN round(v - hi, 12) > 0 THEN 1.0 ELSE 0 END), 1) AS above, round(median(v), 6) AS median, round(median(lo), 6) AS band_low_median, round(median(hi), 6) AS band_high_median, round(min(lo), 6) AS band_low_min, round(max(v), 6) AS method_max, round(min(lo - v), 6) AS margin_min
FROM own JOIN band USING (population, subset) GROUP BY subset, method, baseline"""))
def band_placement(spark, folder):
    """Placement in the central 95 % of the draws."""
    methods = population_stage(spark, folder).where(rankings.family_of(F.col("method")) != "baselines")
    draws = draw_stage(spark, folder).where(F.col("method") == "difficulty_stratified")
    rows = comparisons.band_placement(methods, draws, "rmse")
    return rounded(rows, ["subset", "method", "baseline", "n"], ["below", "inside", "above", "median", "band_low_median", "band_high_median", "band_low_min", "method_max", "margin_min"])


SEED_REPORT = ["det_mean", "det_median", "seed_median_mean", "seed_p95_mean", "seed_max_mean", "seed_mean_mean", "seed_median_median", "seed_p95_median", "seed_max_median",
               "stored_max_mean", "stored_mean_mean", "change_vs_median", "change_vs_p95", "change_vs_max", "change_vs_stored", "median_change_vs_median", "median_change_vs_p95",
               "below_seed_median", "below_seed_p95"]


@register("per_seed_report", sql(*POPULATION_TABLE, *DRAWS_TABLE, DRAW_PAIRS, """seed_cells AS (
  SELECT "window", subset, method, baseline, population, any_value(own_max) AS det, median(drawn_max) AS s_median, quantile_cont(drawn_max, 0.95) AS s_p95, max(drawn_max) AS s_max, avg(drawn_max) AS s_mean FROM draw_pairs GROUP BY "window", subset, method, baseline, population),
stored AS (SELECT population, "window", subset, replace(method, 'baselines:', '') AS baseline, maxerr, maxerr_mean FROM population_table WHERE method LIKE 'baselines:%'),
seed_units AS (
  SELECT c.subset, c.method, c.baseline, population, avg(det) AS det, avg(s_median) AS s_median, avg(s_p95) AS s_p95, avg(s_max) AS s_max, avg(s_mean) AS s_mean, avg(maxerr) AS stored_max, avg(maxerr_mean) AS stored_mean
  FROM seed_cells c JOIN stored USING (population, "window", subset, baseline) GROUP BY c.subset, c.method, c.baseline, population),
seed_report AS (
  SELECT subset, method, baseline, count(*) AS units, avg(det) AS det_mean, median(det) AS det_median, avg(s_median) AS seed_median_mean, avg(s_p95) AS seed_p95_mean, avg(s_max) AS seed_max_mean, avg(s_mean) AS seed_mean_mean,
         median(s_median) AS seed_median_median, median(s_p95) AS seed_p95_median, median(s_max) AS seed_max_median, avg(stored_max) AS stored_max_mean, avg(stored_mean) AS stored_mean_mean,
         avg(CASE WHEN round(det - s_median, 12) < 0 THEN 1.0 ELSE 0 END) AS below_seed_median, avg(CASE WHEN round(det - s_p95, 12) < 0 THEN 1.0 ELSE 0 END) AS below_seed_p95
  FROM seed_units GROUP BY subset, method, baseline),
seed_changes AS (
  SELECT *, (det_mean - seed_median_mean) / seed_median_mean * 100 AS change_vs_median, (det_mean - seed_p95_mean) / seed_p95_mean * 100 AS change_vs_p95, (det_mean - seed_max_mean) / seed_max_mean * 100 AS change_vs_max,
         (det_mean - stored_max_mean) / stored_max_mean * 100 AS change_vs_stored, (det_median - seed_median_median) / seed_median_median * 100 AS median_change_vs_median,
         (det_median - seed_p95_median) / seed_p95_median * 100 AS median_change_vs_p95 FROM seed_report)""",
                                query="SELECT subset, method, baseline, units, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in SEED_REPORT) + " FROM seed_changes"))
def per_seed_report(spark, folder):
    """Deterministic MaxErr next to the seeds' statistics and the stored baselines."""
    stored = population_stage(spark, folder)
    baselines = stored.where(rankings.family_of(F.col("method")) == "baselines").withColumn("baseline", rankings.local_name(F.col("method")))
    rows = comparisons.per_seed_report(stored.where(rankings.family_of(F.col("method")) != "baselines"), draw_stage(spark, folder), baselines)
    return rounded(rows, ["subset", "method", "baseline", "units"], SEED_REPORT)


@register("stream_check", sql(*POPULATION_TABLE, *DRAWS_TABLE, """other AS (SELECT population, "window", subset, method, max(maxerr) AS m FROM b_metrics GROUP BY ALL),
ours AS (SELECT population, "window", subset, method, max(maxerr) AS m FROM draws GROUP BY ALL)""", query="""
SELECT "window", subset, method, round(avg(a.m), 6) AS first_max, round(avg(b.m), 6) AS second_max, round(abs(avg(a.m) - avg(b.m)) / greatest(avg(b.m), 1e-9) * 100, 6) AS rel_diff_pct FROM ours a JOIN other b USING (population, "window", subset, method) GROUP BY "window", subset, method"""))
def stream_check(spark, folder):
    """Two independent draw streams compared."""
    rows = comparisons.stream_check(draw_stage(spark, folder), draw_stage(spark, folder, seed="42"))
    return rounded(rows, ["window", "subset", "method"], ["first_max", "second_max", "rel_diff_pct"])
