"""Queries on the token cost of conversations and subsets."""
from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..operators import cost, selection, strata
from . import inputs
from .inputs import N_RUNS, sql
from .study import STUDY_BASE, centroid_selections, drawn_populations

QUERIES, ORACLE = {}, {}
COST_RUNS = 5
SHARE_DRAWS = 200


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def messages(spark, folder):
    """messages(run, instance, pos, role, text): conversation number 5 * instance + run."""
    return inputs.table(spark, folder, "conversations").select(
        F.pmod("conv_id", F.lit(COST_RUNS)).cast("int").alias("run"), F.floor(F.col("conv_id") / COST_RUNS).alias("instance"),
        F.col("turn").alias("pos"), "role", "text")


COSTS = f"""tokens AS (
  SELECT CAST(conv_id % {COST_RUNS} AS INTEGER) AS run, conv_id // {COST_RUNS} AS instance, turn AS pos, role,
         CAST(CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, round_even(length(text) / 4, 0)) END AS BIGINT) AS tokens FROM conversations),
contexts AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY run, instance ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS context FROM tokens),
costs AS (
  SELECT run, instance, count(*) FILTER (role = 'assistant') AS num_steps, CAST(sum(tokens) AS BIGINT) AS flat_tokens,
         CAST(sum(CASE WHEN role = 'assistant' THEN context ELSE 0 END) AS BIGINT) AS input_tokens, CAST(sum(CASE WHEN role = 'assistant' THEN tokens ELSE 0 END) AS BIGINT) AS output_tokens,
         CAST(sum(CASE WHEN role = 'assistant' THEN context + tokens ELSE 0 END) AS BIGINT) AS total_tokens
  FROM contexts GROUP BY run, instance)"""


def costs(spark, folder):
    """Cost per conversation."""
    return cost.trajectory_costs(messages(spark, folder))


@register("trajectory_costs", sql(COSTS, query="SELECT * FROM costs"))
def trajectory_costs(spark, folder):
    """K1, K2: flat and triangular cost per conversation."""
    return costs(spark, folder)


@register("cost_summary", sql(COSTS, query="""
SELECT run, count(*) AS trajectories, CAST(sum(flat_tokens) AS BIGINT) AS flat_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
       CAST(sum(total_tokens) AS BIGINT) AS total_tokens, round(avg(flat_tokens), 1) AS mean_flat, round(avg(total_tokens), 1) AS mean_total, min(total_tokens) AS min_total, max(total_tokens) AS max_total
FROM costs GROUP BY ROLLUP (run)"""))
def cost_summary(spark, folder):
    """K3: totals per run and overall."""
    return cost.cost_summary(costs(spark, folder))


PROFILE = """profile AS (
  SELECT coalesce(CAST(run AS VARCHAR), 'all') AS scope, count(*) AS instances, CAST(sum(total_tokens) AS BIGINT) AS total_tokens, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
         CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(flat_tokens) AS BIGINT) AS flat_tokens, avg(total_tokens) AS mean, stddev_pop(total_tokens) AS std,
         min(total_tokens) AS min, max(total_tokens) AS max, avg(num_steps) AS mean_steps, quantile_cont(total_tokens, 0.05) AS p5, quantile_cont(total_tokens, 0.25) AS p25,
         quantile_cont(total_tokens, 0.5) AS p50, quantile_cont(total_tokens, 0.75) AS p75, quantile_cont(total_tokens, 0.95) AS p95
  FROM costs GROUP BY ROLLUP (run))"""


@register("cost_profile", sql(COSTS, PROFILE, query="""
SELECT scope, instances, total_tokens, input_tokens, output_tokens, flat_tokens, round(mean, 4) AS mean, round(std, 4) AS std, min, max, round(mean_steps, 4) AS mean_steps,
       round(p5, 4) AS p5, round(p25, 4) AS p25, round(p50, 4) AS p50, round(p75, 4) AS p75, round(p95, 4) AS p95,
       CASE WHEN output_tokens > 0 THEN round(input_tokens / output_tokens, 1) ELSE 0 END AS input_output_ratio,
       CASE WHEN total_tokens > 0 THEN round(input_tokens / total_tokens * 100, 1) END AS input_share_pct, CASE WHEN min > 0 THEN round(max / min, 1) END AS max_to_min FROM profile"""))
def cost_profile(spark, folder):
    """K4: cost profile per run and overall, with exact quantiles."""
    p = cost.cost_profile(costs(spark, folder))
    rounded = [clean(F.col(c), 4).alias(c) for c in ("mean", "std", "mean_steps", "p5", "p25", "p50", "p75", "p95")]
    return p.select("scope", "instances", "total_tokens", "input_tokens", "output_tokens", "flat_tokens", "min", "max", "input_output_ratio", "input_share_pct", "max_to_min", *rounded)


def shares(spark, folder):
    """Cost shares of random subsets per run and size."""
    table = costs(spark, folder).withColumn("population", F.col("run")).withColumn("stratum", F.lit(""))
    for name in ("window", "split"):
        table = table.withColumn(name, F.lit(0))
    table = table.withColumn("method", F.lit("cost"))
    keys = ["population", "window", "split", "method"]
    quotas = strata.stratum_quotas(table, keys, tuple(p / 100 for p in cost.SUBSET_PERCENTAGES))
    drawn = selection.stratified_draws(table, quotas, SHARE_DRAWS, "cost")
    totals = costs(spark, folder).groupBy("run").agg(F.sum("total_tokens").alias("total_tokens"))
    return cost.draw_shares(drawn, totals)


SHARES = f"""sized AS (
  SELECT run, n, total, f.subset, greatest(1, CAST(floor(n * f.fraction) AS BIGINT)) AS k
  FROM (SELECT run, count(*) AS n, sum(total_tokens) AS total FROM costs GROUP BY run), (VALUES ('5pct', 0.05::DOUBLE), ('10pct', 0.1::DOUBLE), ('20pct', 0.2::DOUBLE), ('30pct', 0.3::DOUBLE)) f(subset, fraction)),
shares AS (
  SELECT run, subset, draw, count(*) AS size, any_value(total) AS total, CASE WHEN any_value(total) > 0 THEN sum(total_tokens) / any_value(total) * 100 ELSE 0 END AS share FROM (
    SELECT c.run, c.total_tokens, s.subset, s.k, s.total, d.draw, row_number() OVER (PARTITION BY c.run, s.subset, d.draw
             ORDER BY md5('cost|' || c.run || '|0|0|' || s.subset || '|cost|' || d.draw || '|' || c.instance), c.instance) AS pick
    FROM costs c JOIN sized s USING (run), (SELECT unnest(range({SHARE_DRAWS})) AS draw) d) WHERE pick <= k GROUP BY run, subset, draw),
summary AS (
  SELECT run, subset, max(size) AS subset_size, CAST(any_value(total) AS BIGINT) AS run_tokens, avg(share) AS m, stddev_pop(share) AS s, quantile_cont(share, 0.025) AS lo, quantile_cont(share, 0.975) AS hi
  FROM shares GROUP BY run, subset)"""


@register("random_cost_shares", sql(COSTS, SHARES, query="""
SELECT run, subset, subset_size, run_tokens, round(m, 2) AS mean_share, round(s, 2) AS std_share, round(lo, 2) AS share_low, round(hi, 2) AS share_high,
       round(100 - m, 2) AS mean_saving, round(100 - hi, 2) AS saving_low, round(100 - lo, 2) AS saving_high, round(run_tokens * (100 - m) / 100) AS mean_saved_tokens FROM summary"""))
def random_cost_shares(spark, folder):
    """K5: Monte Carlo cost share of random subsets."""
    return cost.share_summary(shares(spark, folder))


@register("weighted_cost_shares", sql(COSTS, SHARES, query="""
SELECT subset, round(w, 2) AS weighted_share, round(v, 2) AS weighted_saving, f AS full_tokens, round(f * w / 100) AS subset_tokens, round(f * v / 100) AS saved_tokens FROM (
  SELECT subset, CAST(sum(run_tokens) AS BIGINT) AS f, sum(run_tokens * round(m, 2)) / sum(run_tokens) AS w, sum(run_tokens * round(100 - m, 2)) / sum(run_tokens) AS v FROM summary GROUP BY subset)"""))
def weighted_cost_shares(spark, folder):
    """K6: cost-weighted aggregate over runs."""
    return cost.weighted_shares(cost.share_summary(shares(spark, folder)))


SAVINGS_BASE = STUDY_BASE


def savings(spark, folder):
    """Saving records of the centroid subsets: instances of the populations meet the conversation costs of the same number."""
    members = drawn_populations(spark, folder)
    return cost.saving_records(centroid_selections(spark, folder), members, costs(spark, folder))


def _savings_sql():
    from .queries_vectors import RUN_VECTORS
    from .study import STUDY_LABELLED, STUDY_WINDOWS
    from .inputs import splits_sql
    from .study_sql import STUDY_CENTROID
    return (*STUDY_BASE, splits_sql(STUDY_WINDOWS), STUDY_LABELLED, RUN_VECTORS, *STUDY_CENTROID, COSTS, """records AS (
  SELECT *, full_cost - subset_cost AS saved, CASE WHEN full_cost > 0 THEN round((full_cost - subset_cost) / full_cost * 100, 2) ELSE 0 END AS saved_pct FROM (
    SELECT c.population, any_value(p.level) AS level, c."window", c.split, c.run, any_value(p.size) AS population_size, coalesce(any_value(f.cost), 0) AS full_cost,
           any_value(p.size) - coalesce(any_value(f.found), 0) AS missing_full, coalesce(sum(k.total_tokens), 0) AS subset_cost, count(*) AS subset_size, count(*) - count(k.total_tokens) AS missing_subset
    FROM (SELECT *, unnest(test) AS run FROM centroid_chosen) c LEFT JOIN costs k ON k.run = c.run AND k.instance = c.instance
    JOIN (SELECT population, any_value(level) AS level, count(*) AS size FROM members GROUP BY 1) p ON p.population = c.population
    LEFT JOIN (SELECT m.population, o.run, sum(o.total_tokens) AS cost, count(*) AS found FROM members m JOIN costs o USING (instance) GROUP BY 1, 2) f ON f.population = c.population AND f.run = c.run
    WHERE c.run IN (SELECT run FROM costs) GROUP BY c.population, c."window", c.split, c.run))""")


@register("saving_records", sql(*_savings_sql(), query="""
SELECT CAST(population AS BIGINT) AS population, "window", split, run, population_size, CAST(full_cost AS BIGINT) AS full_cost, missing_full, CAST(subset_cost AS BIGINT) AS subset_cost, subset_size, missing_subset,
       CAST(saved AS BIGINT) AS saved, saved_pct FROM records"""))
def saving_records(spark, folder):
    """K7: saving per population, split and test run."""
    return savings(spark, folder).select(F.col("population").cast("long").alias("population"), "window", "split", "run", "population_size", "full_cost", "missing_full", "subset_cost", "subset_size",
                                         "missing_subset", "saved", "saved_pct")


@register("saving_summary", sql(*_savings_sql(), query="""
SELECT "window", count(*) AS records, round(avg(saved_pct), 2) AS mean_saved_pct, min(saved_pct) AS min_saved_pct, max(saved_pct) AS max_saved_pct, round(stddev_pop(saved_pct), 2) AS std_saved_pct,
       CAST(sum(full_cost) AS BIGINT) AS full_tokens, CAST(sum(subset_cost) AS BIGINT) AS subset_tokens, CAST(sum(saved) AS BIGINT) AS saved_tokens,
       CASE WHEN sum(full_cost) > 0 THEN round(sum(saved) / sum(full_cost) * 100, 2) ELSE 0 END AS aggregate_saved_pct, round(median(saved_pct), 2) AS median_saved_pct
FROM records GROUP BY "window" """))
def saving_summary(spark, folder):
    """K8: saving statistics per window."""
    return cost.saving_summary(savings(spark, folder), ["window"])


@register("saving_means", sql(*_savings_sql(), query="""
SELECT 'overall' AS by, '' AS value, round(avg(saved_pct), 2) AS mean_saved_pct, count(*) AS records FROM records
UNION ALL SELECT 'run', CAST(run AS VARCHAR), round(avg(saved_pct), 2), count(*) FROM records GROUP BY run
UNION ALL SELECT 'level', CAST(level AS VARCHAR), round(avg(saved_pct), 2), count(*) FROM records GROUP BY level"""))
def saving_means(spark, folder):
    """K8: mean saving overall, per run and per level."""
    return cost.saving_means(savings(spark, folder))


@register("population_fingerprints", sql(*STUDY_BASE, query="""
SELECT CAST(population AS BIGINT) AS population, count(*) AS members, CAST(sum(CAST('0x' || substr(md5(CAST(instance AS VARCHAR)), 1, 8) AS BIGINT)) AS BIGINT) AS code_sum,
       bit_xor(CAST('0x' || substr(md5(CAST(instance AS VARCHAR)), 1, 8) AS BIGINT)) AS code_xor FROM members GROUP BY population"""))
def population_fingerprints(spark, folder):
    """K9: order-free fingerprints of the populations a selection was made on."""
    return cost.content_fingerprint(drawn_populations(spark, folder)).withColumn("population", F.col("population").cast("long"))


@register("changed_populations", sql(*STUDY_BASE, query="""
SELECT CAST(population AS BIGINT) AS population, CASE WHEN bool_and(instance % 11 = 0) THEN 'removed' ELSE 'changed' END AS difference FROM members
GROUP BY population HAVING bool_or(instance % 11 = 0)"""))
def changed_populations(spark, folder):
    """K9: populations that differ after the instances divisible by eleven were taken out."""
    recorded = drawn_populations(spark, folder)
    return cost.changed_populations(recorded, recorded.where(F.pmod("instance", F.lit(11)) != 0)).withColumn("population", F.col("population").cast("long"))
