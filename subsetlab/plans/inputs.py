"""The study's input tables derived from the driver's tables; the SQL text next to each view states the same thing."""
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

N_RUNS = 5
RUN_DAYS = 6
FIRST_DAY = "2024-01-01"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One driver table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def outcomes(spark, folder) -> DataFrame:
    """outcomes(instance, run, passed): users are instances, runs are blocks of six days, passed = more purchases than errors."""
    day = F.datediff(F.to_date("ts"), F.lit(FIRST_DAY).cast("date"))
    run = F.least(F.floor(day / RUN_DAYS).cast("int"), F.lit(N_RUNS - 1))
    balance = F.sum(F.when(F.col("event_type") == "purchase", 1).when(F.col("event_type") == "error", -1).otherwise(0))
    return (table(spark, folder, "events").groupBy(F.col("user_id").alias("instance"), run.alias("run"))
            .agg((balance > 0).cast("int").alias("passed")))


OUTCOMES = f"""outcomes AS (
  SELECT user_id AS instance, CAST(least(date_diff('day', DATE '{FIRST_DAY}', CAST(ts AS DATE)) // {RUN_DAYS}, {N_RUNS - 1}) AS INTEGER) AS run,
         CASE WHEN sum(CASE event_type WHEN 'purchase' THEN 1 WHEN 'error' THEN -1 ELSE 0 END) > 0 THEN 1 ELSE 0 END AS passed
  FROM events GROUP BY 1, 2)"""


def instances(spark, folder) -> DataFrame:
    """instances(instance, repository): the customer of the same key gives the repository."""
    return table(spark, folder, "customer").select(F.col("c_custkey").alias("instance"), F.col("c_mktsegment").alias("repository"))


COMPLETE = f"""complete AS (
  SELECT o.instance, any_value(c.c_mktsegment) AS repository, list(o.passed ORDER BY o.run) AS outcomes
  FROM outcomes o JOIN customer c ON c.c_custkey = o.instance
  GROUP BY o.instance HAVING count(*) = {N_RUNS})"""


def splits_sql(windows) -> str:
    """All temporal splits as a VALUES table."""
    from itertools import combinations
    rows = []
    for window in windows:
        for split, train in enumerate(combinations(range(N_RUNS - 1), window)):
            test = list(range(train[-1] + 1, N_RUNS))
            rows.append(f"({window}, {split}, {list(train)}, {test})")
    return f'splits("window", split, train, test) AS (VALUES {", ".join(rows)})'


LABELLED = """labelled AS (
  SELECT i.instance, i.repository, i.outcomes, s."window", s.split, s.train, s.test,
         list_sum(list_transform(s.train, lambda r: i.outcomes[r + 1])) AS passes
  FROM complete i, splits s)"""


def sql(*ctes, query) -> str:
    """WITH statement from CTE texts."""
    return ("WITH " + ",\n".join(ctes) if ctes else "") + "\n" + query


def union_all(frames) -> DataFrame:
    """Union of frames by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)
