"""Queries on stored result tables: blocks written with a manifest, checked and scanned by partition."""
from pyspark.sql import functions as F

from ..operators import rankings
from ..sources import results
from .inputs import sql
from .queries_sources import scratch
from .queries_stats import rounded
from .study import STUDY_WINDOWS, draw_stage, split_stage
from .study_sql import COMMON, DRAWS_TABLE, SPLIT_TABLE

QUERIES, ORACLE = {}, {}
BLOCK_POSITIONS = 18


def register(name, oracle=None):
    """Decorator: add a query, and its SQL when there is one."""
    def add(function):
        QUERIES[name] = function
        if oracle is not None:
            ORACLE[name] = oracle
        return function
    return add


def with_family(spark, folder):
    """Split-level results with their method family and block."""
    return (split_stage(spark, folder).withColumn("family", rankings.family_of(F.col("method")))
            .withColumn("_block", F.floor(F.col("population") / BLOCK_POSITIONS)))


def stored(spark, table, keys, metadata=None) -> str:
    """A table written block by block; the folder."""
    path = scratch(spark)
    for block in sorted(r[0] for r in table.select("_block").distinct().collect()):   # as many as the study has blocks
        results.write_block(table.where(F.col("_block") == block).drop("_block"), path, str(block), keys, metadata=(metadata or {}).get(block, {"seed": 42}))
    return path


BLOCKED = """blocked AS (SELECT *, split_part(method, ':', 1) AS family, CAST(population // 18 AS VARCHAR) AS block FROM split_table)"""


@register("stored_results", sql(*SPLIT_TABLE, BLOCKED, query="""
SELECT CAST("window" AS INTEGER) AS "window", family, method, subset, count(*) AS rows, round(avg(rmse), 6) AS rmse FROM blocked
WHERE "window" = 2 AND family IN ('baselines', 'embedding_strata') GROUP BY ALL"""))
def stored_results(spark, folder):
    """Results of two families and one window from the stored table, after the checks of their partitions."""
    path = stored(spark, with_family(spark, folder), results.RESULT_KEYS)
    t = results.scan_results(spark, path, ["method", "subset", "rmse"], window=STUDY_WINDOWS[-1], family=["baselines", "embedding_strata"])
    grouped = t.groupBy("window", "family", "method", "subset").agg(F.count(F.lit(1)).alias("rows"), F.avg("rmse").alias("rmse"))
    return rounded(grouped, ["window", "family", "method", "subset", "rows"], ["rmse"])


@register("stored_draws", sql(*COMMON, *DRAWS_TABLE, query="""
SELECT CAST("window" AS INTEGER) AS "window", method AS baseline, subset, draw, count(*) AS populations, round(avg(rmse), 6) AS rmse, round(max(maxerr), 6) AS maxerr FROM draws
WHERE "window" = 1 AND method IN ('random', 'difficulty_stratified') GROUP BY ALL"""))
def stored_draws(spark, folder):
    """Draws of two baselines and one window from the stored draw table."""
    draws = (draw_stage(spark, folder).withColumnRenamed("method", "baseline").withColumn("draw", F.col("draw").cast("long"))
             .withColumn("_block", F.floor(F.col("population") / BLOCK_POSITIONS)))
    path = stored(spark, draws, results.DRAW_KEYS)
    t = results.scan_results(spark, path, ["subset", "draw", "rmse", "maxerr"], results.DRAW_KEYS, window=1, baseline=["random", "difficulty_stratified"])
    grouped = t.groupBy("window", "baseline", "subset", "draw").agg(F.count(F.lit(1)).alias("populations"), F.avg("rmse").alias("rmse"), F.max("maxerr").alias("maxerr"))
    return rounded(grouped, ["window", "baseline", "subset", "draw", "populations"], ["rmse", "maxerr"])


@register("result_manifest", sql(*SPLIT_TABLE, BLOCKED, query="""
SELECT CAST("window" AS INTEGER) AS "window", family, block, count(*) AS rows, count(DISTINCT population) AS positions, CAST(min(population) AS BIGINT) AS first, CAST(max(population) AS BIGINT) AS last,
       array_to_string(list_sort(list(DISTINCT method)), ',') AS methods, count(DISTINCT (population, split)) AS pairs FROM blocked GROUP BY "window", family, block"""))
def result_manifest(spark, folder):
    """The manifest of the stored result table."""
    listed = results.manifest(spark, stored(spark, with_family(spark, folder), results.RESULT_KEYS))
    return listed.select("window", "family", "block", "rows", "positions", "first", "last", F.array_join("methods", ",").alias("methods"), "pairs")


@register("block_checks", sql(*SPLIT_TABLE, BLOCKED, """faulty AS (
  SELECT "window", family, block, population, method FROM blocked WHERE NOT (block = '3' AND method = 'baselines:random')
  UNION ALL SELECT "window", family, '1', population, method FROM blocked WHERE population = 36),
listed AS (
  SELECT "window", family, block, min(population) AS first, max(population) AS last, list_sort(list(DISTINCT method)) AS methods, CASE block WHEN '2' THEN 7 ELSE 42 END AS seed FROM faulty GROUP BY ALL),
placed AS (
  SELECT *, first_value(methods) OVER o AS methods_0, first_value(seed) OVER o AS seed_0, max(last) OVER (PARTITION BY "window", family ORDER BY first, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reached
  FROM listed WINDOW o AS (PARTITION BY "window", family ORDER BY first, block))""", query="""
SELECT CAST("window" AS INTEGER) AS "window", family, block, 'metadata differ from the first block' AS problem FROM placed WHERE seed <> seed_0
UNION ALL SELECT CAST("window" AS INTEGER), family, block, 'methods differ from the first block' FROM placed WHERE methods <> methods_0
UNION ALL SELECT CAST("window" AS INTEGER), family, block, 'positions overlap or are out of order' FROM placed WHERE first <= reached"""))
def block_checks(spark, folder):
    """Blocks with another seed, a missing method and a repeated position, found from the manifest."""
    t = with_family(spark, folder)
    twice = t.where(F.col("population") == 2 * BLOCK_POSITIONS).withColumn("_block", F.lit(1).cast("long"))
    faulty = t.where(~((F.col("_block") == 3) & (F.col("method") == "baselines:random"))).unionByName(twice)
    path = stored(spark, faulty, results.RESULT_KEYS, {2: {"seed": 7}})
    return results.block_problems(results.manifest(spark, path))
