"""Queries on outcomes, splits, strata, random selection and errors, each with the SQL that states the same result."""
from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..operators import errors, runs, selection, splits, strata
from ..session import dealt
from . import inputs
from .inputs import COMPLETE, LABELLED, N_RUNS, OUTCOMES, splits_sql, sql

WINDOWS = (1, 2, 3, 4)
FRACTIONS = (0.05, 0.10, 0.20, 0.30)
DRAWS = 20
QUERIES, ORACLE = {}, {}


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def whole_population(spark, folder):
    """All complete instances as one population (number 0) with their outcome arrays and repositories."""
    vectors = runs.outcome_vectors(inputs.outcomes(spark, folder), N_RUNS)
    return (vectors.join(inputs.instances(spark, folder), "instance")
            .select(F.lit(0).alias("population"), "instance", "repository", "outcomes"))


def labelled(spark, folder, windows=WINDOWS):
    """Instances of the whole population once per split, with pass count, difficulty and variance; dealt while they are few."""
    return strata.label_instances(splits.explode_splits(dealt(whole_population(spark, folder)), N_RUNS, windows))


def baseline_members(spark, folder, windows=WINDOWS, baselines=strata.ONE_RUN_BASELINES + strata.TWO_RUN_BASELINES):
    """One row per (instance, split, baseline) with its stratum."""
    return strata.baseline_strata(labelled(spark, folder, windows), baselines)


KEYS = ["population", "window", "split", "method"]

STRATA = """strata AS (
  SELECT l.*, b.method, CASE b.method
      WHEN 'random' THEN '' WHEN 'repo_stratified' THEN repository
      WHEN 'difficulty_stratified' THEN CAST(difficulty AS VARCHAR) WHEN 'stability_stratified' THEN CAST(difficulty AS VARCHAR)
      WHEN 'repo_difficulty_stratified' THEN repository || '_' || CAST(difficulty AS VARCHAR)
      WHEN 'consistency_stratified' THEN CAST(CAST(passes AS BIGINT) AS VARCHAR)
      ELSE repository || '_' || CAST(CAST(passes AS BIGINT) AS VARCHAR) END AS stratum
  FROM (SELECT *, CASE WHEN passes >= ceil("window" / 2.0) THEN 1 ELSE 0 END AS difficulty FROM labelled) l,
       (VALUES ('random'), ('repo_stratified'), ('difficulty_stratified'), ('repo_difficulty_stratified'),
               ('consistency_stratified'), ('repo_consistency_stratified'), ('stability_stratified')) b(method)
  WHERE "window" >= 2 OR b.method NOT IN ('consistency_stratified', 'repo_consistency_stratified'))"""


def quotas_sql(fractions, source="strata", keys=('"window"', "split", "method")) -> str:
    """Largest-remainder quotas as CTEs (sizes, quotas)."""
    k = ", ".join(keys)
    values = ", ".join(f"('{int(f * 100)}pct', {f}::DOUBLE)" for f in fractions)
    return f"""sizes AS (
  SELECT {k}, stratum, count(*) AS members, CAST(sum(count(*)) OVER (PARTITION BY {k}) AS BIGINT) AS total FROM {source} GROUP BY {k}, stratum),
slotted AS (
  SELECT s.*, f.subset, greatest(1, CAST(floor(total * f.fraction) AS BIGINT)) AS slots FROM sizes s, (VALUES {values}) f(subset, fraction)),
shared AS (
  SELECT *, CAST(slots * members AS DOUBLE) / total AS share,
         least(CAST(floor(CAST(slots * members AS DOUBLE) / total) AS BIGINT), members) AS base FROM slotted),
ordered AS (
  SELECT *, slots - sum(base) OVER (PARTITION BY {k}, subset) AS leftover, CASE WHEN members > base THEN 1 ELSE 0 END AS open,
         row_number() OVER (PARTITION BY {k}, subset ORDER BY CASE WHEN members > base THEN 1 ELSE 0 END DESC, share - floor(share) DESC, stratum) AS place
  FROM shared),
quotas AS (
  SELECT {k}, stratum, subset, members, slots, base + CASE WHEN open = 1 AND place <= leftover THEN 1 ELSE 0 END AS quota FROM ordered)"""


RATES = f"""rates AS (
  SELECT [{", ".join(f"avg(outcomes[{r + 1}])" for r in range(N_RUNS))}] AS population_rates FROM complete)"""


def metrics_sql(selected, keys, carry="") -> str:
    """CTEs picked and metrics: errors and their summary for the selections in ``selected``."""
    k = ", ".join(keys)
    averages = ", ".join(f"avg(outcomes[{r + 1}])" for r in range(N_RUNS))
    return f"""picked AS (
  SELECT {k}, [{averages}] AS subset_rates, any_value(test) AS test{carry} FROM {selected} GROUP BY {k}),
erred AS (
  SELECT p.*, list_transform(p.test, lambda r: p.subset_rates[r + 1] - q.population_rates[r + 1]) AS errors FROM picked p, rates q),
metrics AS (
  SELECT {k}, sqrt(list_avg(list_transform(errors, lambda e: e * e))) AS rmse,
         list_max(list_transform(errors, lambda e: abs(e) * 100)) AS maxerr,
         list_aggregate(list_transform(errors, lambda e: abs(e) * 100), 'quantile_cont', 0.95) AS p95
  FROM erred)"""


DRAWN = f"""drawn AS (
  SELECT * FROM (
    SELECT s.*, q.subset, q.quota, d.draw,
           row_number() OVER (PARTITION BY s."window", s.split, s.method, s.stratum, q.subset, d.draw
             ORDER BY md5('42|0|' || s."window" || '|' || s.split || '|' || q.subset || '|' || s.method || '|' || d.draw || '|' || s.instance), s.instance) AS pick
    FROM strata s JOIN quotas q USING ("window", split, method, stratum), (SELECT unnest(range({DRAWS})) AS draw) d
    WHERE s.method <> 'stability_stratified')
  WHERE pick <= quota)"""


@register("outcome_matrix", sql(OUTCOMES, COMPLETE, query="""
SELECT instance, CAST(outcomes[1] AS INTEGER) AS run_0, CAST(outcomes[2] AS INTEGER) AS run_1, CAST(outcomes[3] AS INTEGER) AS run_2,
       CAST(outcomes[4] AS INTEGER) AS run_3, CAST(outcomes[5] AS INTEGER) AS run_4 FROM complete"""))
def outcome_matrix(spark, folder):
    """Complete instances, pivoted to one column per run."""
    whole = whole_population(spark, folder)
    return whole.select("instance", *[F.get("outcomes", F.lit(r)).alias(f"run_{r}") for r in range(N_RUNS)])


@register("complete_instances", sql(OUTCOMES, query="""
SELECT o.instance, o.run, o.passed FROM outcomes o
WHERE o.instance IN (SELECT instance FROM outcomes GROUP BY 1 HAVING count(*) = (SELECT count(DISTINCT run) FROM outcomes))"""))
def complete_instances(spark, folder):
    """D1 in long form: a semi join keeps the instances seen in every run."""
    return runs.complete_outcomes(inputs.outcomes(spark, folder)).select("instance", "run", "passed")


@register("temporal_splits", sql(splits_sql(WINDOWS), OUTCOMES, query="""
SELECT s."window", s.split, array_to_string(s.train, ',') AS train, array_to_string(s.test, ',') AS test, count(*) AS train_outcomes, CAST(sum(o.passed) AS BIGINT) AS train_passed
FROM splits s JOIN outcomes o ON list_contains(s.train, o.run) GROUP BY ALL"""))
def temporal_splits(spark, folder):
    """D3: all splits with the outcomes that fall into their training runs."""
    per_run = inputs.outcomes(spark, folder).groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("passed"))
    table = splits.temporal_splits(spark, N_RUNS, WINDOWS).withColumn("run", F.explode("train"))
    return (table.join(per_run, "run")
            .groupBy("window", "split", F.array_join("train", ",").alias("train"), F.array_join("test", ",").alias("test"))
            .agg(F.sum("n").alias("train_outcomes"), F.sum("passed").alias("train_passed")))


@register("pass_counts", sql(OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, STRATA, query="""
SELECT "window", split, instance, CAST(passes AS INTEGER) AS passes, difficulty,
       round((passes / "window") * (1 - passes / "window"), 6) AS variance,
       CASE WHEN "window" = 1 THEN CAST(difficulty AS VARCHAR) ELSE CAST(CAST(passes AS BIGINT) AS VARCHAR) END AS outcome_stratum
FROM strata WHERE method = 'random'"""))
def pass_counts(spark, folder):
    """Q1-Q3: pass count, difficulty, outcome variance and outcome stratum of every instance in every split."""
    rows = labelled(spark, folder)
    return rows.select("window", "split", "instance", "passes", "difficulty", clean(F.col("variance")).alias("variance"),
                       strata.outcome_stratum(F.col("passes"), F.col("window")).alias("outcome_stratum"))


@register("strata_sizes", sql(OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, STRATA, query="""
SELECT "window", split, method, stratum, count(*) AS members FROM strata WHERE method <> 'stability_stratified' GROUP BY ALL"""))
def strata_sizes(spark, folder):
    """Q4: all strata of all baselines with their sizes."""
    return baseline_members(spark, folder).groupBy("window", "split", "method", "stratum").agg(F.count(F.lit(1)).alias("members"))


@register("run_group_strata", sql(OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, STRATA, query="""
SELECT "window", split, method, CASE method WHEN 'repo_difficulty_stratified' THEN repository || '_d' || difficulty
         WHEN 'repo_consistency_stratified' THEN repository || '_c' || CAST(passes AS BIGINT) ELSE stratum END AS stratum, count(*) AS members
FROM strata WHERE method LIKE 'repo%' GROUP BY ALL"""))
def run_group_strata(spark, folder):
    """Q4, run-group spelling of the crossed keys."""
    names = ("repo_stratified", "repo_difficulty_stratified", "repo_consistency_stratified")
    rows = strata.baseline_strata(labelled(spark, folder), names, tags=("d", "c"))
    return rows.groupBy("window", "split", "method", "stratum").agg(F.count(F.lit(1)).alias("members"))


@register("stratum_quotas", sql(OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, STRATA, quotas_sql(FRACTIONS), query="""
SELECT "window", split, method, stratum, subset, members, CAST(slots AS INTEGER) AS slots, CAST(quota AS INTEGER) AS quota
FROM quotas WHERE method <> 'stability_stratified'"""))
def stratum_quotas(spark, folder):
    """Largest-remainder quotas of all strata at all subset sizes."""
    quotas = strata.stratum_quotas(baseline_members(spark, folder), KEYS, FRACTIONS)
    return quotas.select("window", "split", "method", "stratum", "subset", "members", "slots", "quota")


def _draws(spark, folder, totals, windows=WINDOWS, fractions=(0.10,), n_draws=DRAWS, seed="42"):
    """Totals over the draws of all random baselines."""
    members = baseline_members(spark, folder, windows)
    return selection.drawn_totals(members, strata.stratum_quotas(members, KEYS, fractions), n_draws, totals, seed, carried=("test",))


def draw_metrics(spark, folder, windows=WINDOWS, fractions=(0.10,), n_draws=DRAWS, seed="42"):
    """Split metrics of every draw."""
    drawn = _draws(spark, folder, errors.run_totals(N_RUNS), windows, fractions, n_draws, seed)
    rates = errors.population_rates(whole_population(spark, folder), N_RUNS)
    return errors.split_metrics(errors.drawn_errors(drawn, rates, N_RUNS))


BASE = (OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, STRATA, quotas_sql((0.10,)), DRAWN, RATES)
DRAW_METRICS = metrics_sql("drawn", ('"window"', "split", "method", "subset", "draw"))


@register("random_draws", sql(*BASE[:7], query="""
SELECT "window", split, method, subset, draw, count(*) AS picked, CAST(sum(instance) AS BIGINT) AS instance_sum, CAST(min(instance) AS BIGINT) AS first_instance
FROM drawn GROUP BY ALL"""))
def random_draws(spark, folder):
    """M1, M2: seeded uniform and stratified subsets, fingerprinted per draw."""
    totals = {"instance_sum": (F.sum, F.sum, F.col("instance")), "first_instance": (F.min, F.min, F.col("instance"))}
    return _draws(spark, folder, totals).select("window", "split", "method", "subset", F.col("draw").cast("long").alias("draw"), "picked", *totals)


@register("baseline_draw_errors", sql(*BASE, DRAW_METRICS, query="""
SELECT "window", split, method, subset, draw, round(rmse, 6) AS rmse, round(maxerr, 6) AS maxerr, round(p95, 6) AS p95 FROM metrics"""))
def baseline_draw_errors(spark, folder):
    """Errors of every draw of every random baseline."""
    m = draw_metrics(spark, folder)
    return m.select("window", "split", "method", "subset", F.col("draw").cast("long").alias("draw"),
                    clean(F.col("rmse")).alias("rmse"), clean(F.col("maxerr")).alias("maxerr"), clean(F.col("p95")).alias("p95"))


STOCHASTIC = """meaned AS (
  SELECT *, avg(rmse) OVER (PARTITION BY "window", split, method, subset) AS mean_rmse FROM metrics),
stochastic AS (
  SELECT "window", split, method, subset, avg(rmse) AS rmse, max(maxerr) AS maxerr, avg(maxerr) AS maxerr_mean, avg(p95) AS p95,
         arg_min(draw, struct_pack(gap := round(abs(rmse - mean_rmse), 9), draw := draw)) AS typical_draw
  FROM meaned GROUP BY "window", split, method, subset)"""


@register("baseline_split_metrics", sql(*BASE, DRAW_METRICS, STOCHASTIC, query="""
SELECT "window", split, method, subset, round(rmse, 6) AS rmse, round(maxerr, 6) AS maxerr, round(maxerr_mean, 6) AS maxerr_mean,
       round(p95, 6) AS p95, typical_draw FROM stochastic"""))
def baseline_split_metrics(spark, folder):
    """Summary of the draws per split, with the typical draw."""
    s = errors.stochastic_metrics(draw_metrics(spark, folder), KEYS + ["subset"])
    return s.select("window", "split", "method", "subset", clean(F.col("rmse")).alias("rmse"), clean(F.col("maxerr")).alias("maxerr"),
                    clean(F.col("maxerr_mean")).alias("maxerr_mean"), clean(F.col("p95")).alias("p95"), F.col("typical_draw").cast("long").alias("typical_draw"))


@register("baseline_metrics", sql(*BASE, DRAW_METRICS, STOCHASTIC, query="""
SELECT "window", method, subset, round(avg(rmse), 6) AS rmse, round(max(maxerr), 6) AS maxerr, round(max(maxerr_mean), 6) AS maxerr_mean,
       round(avg(p95), 6) AS p95, count(*) AS splits FROM stochastic GROUP BY "window", method, subset"""))
def baseline_metrics(spark, folder):
    """Metrics of the random baselines over all splits of a window."""
    s = errors.stochastic_metrics(draw_metrics(spark, folder), KEYS + ["subset"])
    m = errors.population_metrics(s, ["population", "window", "method", "subset"])
    return m.select("window", "method", "subset", *[clean(F.col(c)).alias(c) for c in ("rmse", "maxerr", "maxerr_mean", "p95")], "splits")


@register("stability_control", sql(OUTCOMES, COMPLETE, splits_sql(WINDOWS), LABELLED, STRATA, quotas_sql(FRACTIONS), RATES, """control AS (
  SELECT * FROM (
    SELECT s.*, q.subset, q.quota, row_number() OVER (PARTITION BY s."window", s.split, s.stratum, q.subset
             ORDER BY round((passes / s."window") * (1 - passes / s."window"), 9), s.instance) AS pick
    FROM strata s JOIN quotas q USING ("window", split, method, stratum) WHERE s.method = 'stability_stratified')
  WHERE pick <= quota)""", metrics_sql("control", ('"window"', "split", "method", "subset"), ", count(*) AS picked"), query="""
SELECT m."window", m.split, m.method, m.subset, p.picked, round(rmse, 6) AS rmse, round(maxerr, 6) AS maxerr, round(p95, 6) AS p95
FROM metrics m JOIN picked p USING ("window", split, method, subset)"""))
def stability_control(spark, folder):
    """M3: deterministic control and its errors."""
    members = baseline_members(spark, folder, baselines=(strata.CONTROL,))
    chosen = selection.stability_control(members, strata.stratum_quotas(members, KEYS, FRACTIONS))
    rates = errors.population_rates(whole_population(spark, folder), N_RUNS)
    m = errors.split_metrics(errors.run_errors(chosen, rates, KEYS + ["subset"], N_RUNS))
    return m.select("window", "split", "method", "subset", "picked", *[clean(F.col(c)).alias(c) for c in ("rmse", "maxerr", "p95")])
