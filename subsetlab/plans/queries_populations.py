"""Queries on populations: drawing, validity on other runs, churn and overlap."""
from pyspark.sql import functions as F

from ..functions.arrays import clean
from ..functions.tails import binomial_two_sided_half
from ..operators import populations, runs
from . import inputs
from .inputs import N_RUNS, OUTCOMES, sql
from .study import STUDY_BASE, drawn_populations

QUERIES, ORACLE = {}, {}


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


@register("population_members", sql(*STUDY_BASE, query="""
SELECT CAST(population AS BIGINT) AS population, CAST(level AS BIGINT) AS level, name, instance, member_pos FROM members"""))
def population_members(spark, folder):
    """Populations at nine difficulty levels."""
    return drawn_populations(spark, folder).select(F.col("population").cast("long").alias("population"), F.col("level").cast("long").alias("level"), "name", "instance",
                                                   F.col("member_pos").cast("long").alias("member_pos"))


@register("population_rates", sql(*STUDY_BASE, query="""
SELECT CAST(population AS BIGINT) AS population, name, count(*) AS members, round(avg(outcomes[1]), 4) AS resolve_rate FROM members GROUP BY population, name"""))
def population_rates(spark, folder):
    """Obtained size and resolve rate."""
    rates = populations.population_rates(drawn_populations(spark, folder))
    return rates.select(F.col("population").cast("long").alias("population"), "name", "members", "resolve_rate")


STORED = """stored AS (
  SELECT name, population AS file_pos, list(instance ORDER BY member_pos) AS instances FROM members GROUP BY name, population
  UNION ALL SELECT 'pool_' || c_mktsegment, 500 + min(c_custkey), list(c_custkey ORDER BY c_custkey) FROM customer GROUP BY c_mktsegment
  UNION ALL SELECT 'rate_' || p_size || '_run_part', 1000 + p_size, list(p_partkey ORDER BY p_partkey) FROM part GROUP BY p_size)"""


def stored_populations(spark, folder):
    """Stored population lists: the drawn ones, lists without a level in their name, and lists that hold some unknown members."""
    drawn = drawn_populations(spark, folder).groupBy("name", F.col("population").cast("long").alias("file_pos")).agg(
        F.array_sort(F.collect_list(F.struct("member_pos", "instance"))).alias("_m")).select("name", "file_pos", F.col("_m.instance").alias("instances"))
    segments = inputs.table(spark, folder, "customer").groupBy(F.concat(F.lit("pool_"), "c_mktsegment").alias("name")).agg(
        (F.min("c_custkey") + 500).alias("file_pos"), F.array_sort(F.collect_list("c_custkey")).alias("instances"))
    sizes = inputs.table(spark, folder, "part").groupBy("p_size").agg(F.array_sort(F.collect_list("p_partkey")).alias("instances")).select(
        F.concat(F.lit("rate_"), F.col("p_size").cast("string"), F.lit("_run_part")).alias("name"), (1000 + F.col("p_size")).cast("long").alias("file_pos"), "instances")
    return drawn.unionByName(segments).unionByName(sizes)


@register("scanned_populations", sql(*STUDY_BASE, STORED, query="""
SELECT name, CAST(row_number() OVER (ORDER BY file_pos, name) - 1 AS BIGINT) AS population, CAST(regexp_extract(name, 'rate_(\\d+)_run', 1) AS BIGINT) AS level, known
FROM (SELECT name, file_pos, count(*) AS known FROM (SELECT name, file_pos, unnest(instances) AS instance FROM stored) JOIN complete USING (instance)
      WHERE regexp_matches(name, 'rate_\\d+_run') GROUP BY name, file_pos)
WHERE known >= 20"""))
def scanned_populations(spark, folder):
    """Stored lists → numbered populations, only those with a level and enough known members."""
    known = runs.complete_outcomes(inputs.outcomes(spark, folder)).select("instance").distinct()
    members = populations.scan_populations(stored_populations(spark, folder), known, min_members=20)
    return members.groupBy("name", F.col("population").cast("long").alias("population"), F.col("level").cast("long").alias("level")).agg(F.count(F.lit(1)).alias("known"))


@register("cross_run_rates", sql(*STUDY_BASE, query="""
SELECT CAST(m.population AS BIGINT) AS population, r.run, round(avg(o.passed), 6) AS rate, count(o.passed) AS matched, count(*) AS total, round(count(o.passed) / count(*), 6) AS coverage
FROM members m CROSS JOIN (SELECT DISTINCT run FROM outcomes) r LEFT JOIN outcomes o ON o.instance = m.instance AND o.run = r.run GROUP BY m.population, r.run"""))
def cross_run_rates(spark, folder):
    """O1: resolve rate of every population on every run."""
    rates = populations.cross_run_rates(drawn_populations(spark, folder), inputs.outcomes(spark, folder))
    return rates.select(F.col("population").cast("long").alias("population"), "run", clean(F.col("rate")).alias("rate"), "matched", "total", clean(F.col("coverage")).alias("coverage"))


@register("validity_pivot", sql(*STUDY_BASE, query="""
SELECT CAST(population AS BIGINT) AS population, CAST(any_value(level) AS BIGINT) AS level, round(avg(outcomes[1]), 6) AS "0", round(avg(outcomes[2]), 6) AS "1", round(avg(outcomes[3]), 6) AS "2",
       round(avg(outcomes[4]), 6) AS "3", round(avg(outcomes[5]), 6) AS "4" FROM members GROUP BY population"""))
def validity_pivot(spark, folder):
    """O1, wide: one column per run."""
    rates = populations.cross_run_rates(drawn_populations(spark, folder), inputs.outcomes(spark, folder))
    return rates.groupBy(F.col("population").cast("long").alias("population"), F.col("level").cast("long").alias("level")).pivot("run", list(range(N_RUNS))).agg(clean(F.max("rate")))


@register("pool_statistics", sql(OUTCOMES, query="""
SELECT run, count(*) AS total, CAST(sum(passed) AS BIGINT) AS resolved, round(avg(passed), 6) AS rate FROM outcomes GROUP BY run"""))
def pool_statistics(spark, folder):
    """O2: pool statistics per run."""
    return populations.pool_statistics(inputs.outcomes(spark, folder)).withColumn("rate", clean(F.col("rate")))


CHURN = """churn AS (
  SELECT m.population, any_value(m.level) AS level, a.run AS first, b.run AS second, count(*) AS n, avg(CASE WHEN a.passed = 1 AND b.passed = 0 THEN 1.0 ELSE 0 END) AS pass_to_fail,
         avg(CASE WHEN a.passed = 0 AND b.passed = 1 THEN 1.0 ELSE 0 END) AS fail_to_pass, abs(avg(a.passed) - avg(b.passed)) AS net
  FROM members m JOIN outcomes a ON a.instance = m.instance JOIN outcomes b ON b.instance = m.instance AND a.run < b.run GROUP BY m.population, a.run, b.run)"""


@register("instance_churn", sql(*STUDY_BASE, CHURN, query="""
SELECT CAST(population AS BIGINT) AS population, first, second, n, round(pass_to_fail, 6) AS pass_to_fail, round(fail_to_pass, 6) AS fail_to_pass,
       round(pass_to_fail + fail_to_pass, 6) AS gross, round(net, 6) AS net, round(pass_to_fail + fail_to_pass - net, 6) + 0.0 AS cancelled FROM churn"""))
def instance_churn(spark, folder):
    """O3: outcome changes between every pair of runs."""
    c = populations.churn(drawn_populations(spark, folder), inputs.outcomes(spark, folder), N_RUNS)
    return c.select(F.col("population").cast("long").alias("population"), "first", "second", "n", *[clean(F.col(x)).alias(x) for x in ("pass_to_fail", "fail_to_pass", "gross", "net", "cancelled")])


JACCARD = """jaccard AS (
  SELECT a.population AS first, b.population AS second, any_value(a.level) AS first_level, any_value(b.level) AS second_level, count(*) AS shared,
         count(*) / (any_value(sa.n) + any_value(sb.n) - count(*)) AS jaccard
  FROM members a JOIN members b ON a.instance = b.instance AND a.population < b.population
  JOIN (SELECT population, count(*) AS n FROM members GROUP BY 1) sa ON sa.population = a.population
  JOIN (SELECT population, count(*) AS n FROM members GROUP BY 1) sb ON sb.population = b.population GROUP BY 1, 2)"""


@register("pairwise_jaccard", sql(*STUDY_BASE, JACCARD, query="""
SELECT CAST(first AS BIGINT) AS first, CAST(second AS BIGINT) AS second, shared, round(jaccard, 6) AS jaccard FROM jaccard"""))
def pairwise_jaccard(spark, folder):
    """Similarity of every pair of populations."""
    pairs = populations.pairwise_jaccard(drawn_populations(spark, folder))
    return pairs.select(F.col("first").cast("long").alias("first"), F.col("second").cast("long").alias("second"), "shared", clean(F.col("jaccard")).alias("jaccard"))


@register("mean_jaccard", sql(*STUDY_BASE, JACCARD, query="""
SELECT CAST(NULL AS BIGINT) AS level, CAST(p * (p - 1) / 2 AS BIGINT) AS pairs, round((SELECT sum(jaccard) FROM jaccard) / (p * (p - 1) / 2), 6) AS mean_jaccard
FROM (SELECT count(DISTINCT population) AS p FROM members)
UNION ALL
SELECT CAST(l.level AS BIGINT), CAST(p * (p - 1) / 2 AS BIGINT), CASE WHEN p > 1 THEN round(coalesce(s, 0) / (p * (p - 1) / 2), 6) END
FROM (SELECT level, count(DISTINCT population) AS p FROM members GROUP BY level) l
LEFT JOIN (SELECT first_level AS level, sum(jaccard) AS s FROM jaccard WHERE first_level = second_level GROUP BY 1) j USING (level)"""))
def mean_jaccard(spark, folder):
    """Mean similarity over all pairs and within levels."""
    m = populations.mean_jaccard(drawn_populations(spark, folder))
    return m.select(F.col("level").cast("long").alias("level"), "pairs", clean(F.col("mean_jaccard")).alias("mean_jaccard"))


@register("independent_populations", sql(*STUDY_BASE, JACCARD, """walked AS (
  SELECT population, row_number() OVER (ORDER BY population) AS place, coalesce(earlier, []) AS earlier FROM (SELECT DISTINCT population FROM members)
  LEFT JOIN (SELECT second AS population, list(first) AS earlier FROM jaccard WHERE jaccard >= 0.30 GROUP BY second) USING (population)),
walk(place, taken) AS (
  SELECT CAST(0 AS BIGINT), list_filter([0], lambda x: x > 0)
  UNION ALL SELECT w.place, CASE WHEN list_has_any(k.taken, w.earlier) THEN k.taken ELSE list_append(k.taken, w.population) END FROM walk k JOIN walked w ON w.place = k.place + 1)""",
                                         query="SELECT CAST(unnest(taken) AS BIGINT) AS population FROM (SELECT taken FROM walk ORDER BY place DESC LIMIT 1)").replace("WITH", "WITH RECURSIVE", 1))
def independent_populations(spark, folder):
    """Greedy set of populations with similarity below 0.30, in stored order."""
    return populations.greedy_independent(drawn_populations(spark, folder)).select(F.col("population").cast("long").alias("population"))


VALIDITY = """rated AS (SELECT m.population, m.level, o.run, avg(o.passed) AS rate FROM members m JOIN outcomes o USING (instance) GROUP BY ALL),
ranked AS (SELECT *, rank() OVER (PARTITION BY run ORDER BY level) + (count(*) OVER (PARTITION BY run, level) - 1) / 2.0 AS rl,
                  rank() OVER (PARTITION BY run ORDER BY rate) + (count(*) OVER (PARTITION BY run, rate) - 1) / 2.0 AS rr FROM rated),
by_level AS (SELECT run, level, avg(rate) AS mean, stddev_pop(rate) AS spread FROM rated GROUP BY ALL),
gaps AS (SELECT *, round(mean - lag(mean) OVER (PARTITION BY run ORDER BY level), 9) AS gap FROM by_level)"""


@register("level_validity", sql(*STUDY_BASE, VALIDITY, query="""
SELECT run, round(any_value(c), 6) AS spearman, CAST(sum(CASE WHEN gap <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS inversions, round(avg(gap) * 100, 6) AS mean_gap, round(min(gap) * 100, 6) AS min_gap,
       round(max(gap) * 100, 6) AS max_gap, round(min(spread) * 100, 6) + 0.0 AS min_spread, round(max(spread) * 100, 6) + 0.0 AS max_spread
FROM gaps JOIN (SELECT run, corr(rl, rr) AS c FROM ranked GROUP BY run) USING (run) GROUP BY run"""))
def level_validity(spark, folder):
    """Does the level still order the populations on other runs?"""
    v = populations.level_validity(populations.cross_run_rates(drawn_populations(spark, folder), inputs.outcomes(spark, folder)))
    return v.select("run", clean(F.col("spearman")).alias("spearman"), F.col("inversions").cast("long").alias("inversions"),
                    *[clean(F.col(c)).alias(c) for c in ("mean_gap", "min_gap", "max_gap", "min_spread", "max_spread")])


@register("level_sign_test", sql(*STUDY_BASE, CHURN, query="""
SELECT first, second, n AS levels, CAST(s AS BIGINT) AS favourable, round(least(1.0, 2 * list_sum(list_transform(range(CAST(greatest(s, n - s) AS BIGINT), n + 1),
         lambda k: exp(lgamma(n + 1) - lgamma(k + 1) - lgamma(n - k + 1) - n * ln(2))))), 6) AS p_value
FROM (SELECT first, second, count(*) AS n, sum(f) AS s FROM (
  SELECT first, second, level, CASE WHEN round(median(fail_to_pass - pass_to_fail), 9) > 0 THEN 1 ELSE 0 END AS f FROM churn GROUP BY ALL) GROUP BY first, second)"""))
def level_sign_test(spark, folder):
    """Number of levels whose median change favours the later run, with the exact sign test."""
    c = populations.churn(drawn_populations(spark, folder), inputs.outcomes(spark, folder), N_RUNS)
    per_level = c.groupBy("first", "second", "level").agg(F.median(F.col("fail_to_pass") - F.col("pass_to_fail")).alias("_m"))
    counted = per_level.groupBy("first", "second").agg(F.count(F.lit(1)).alias("levels"), F.sum((F.round("_m", 9) > 0).cast("long")).alias("favourable"))
    return counted.withColumn("p_value", clean(binomial_two_sided_half(F.col("favourable"), F.col("levels"))))


@register("population_inventory", sql(*STUDY_BASE, query="""
SELECT CAST(level AS BIGINT) AS level, count(*) AS populations, min(n) AS smallest, max(n) AS largest, count(DISTINCT n) AS distinct_sizes
FROM (SELECT population, level, count(*) AS n FROM members GROUP BY ALL) GROUP BY level"""))
def population_inventory(spark, folder):
    """Populations per level and their sizes."""
    i = populations.inventory(drawn_populations(spark, folder))
    return i.withColumn("level", F.col("level").cast("long"))
