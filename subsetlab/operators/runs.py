"""Run grouping, run identity and outcome matrices."""
from pyspark.sql import Column, DataFrame, Window, functions as F

MIN_INSTANCES_PER_GROUP = 50


def resolved_flag(value: Column) -> Column:
    """1 when a raw outcome says "solved": the integer 1 or one of the strings 1 / true / success, 0 otherwise."""
    return F.when(F.lower(value.cast("string")).isin("1", "true", "success"), 1).otherwise(0)


def rerun_counts(trajectories: DataFrame) -> DataFrame:
    """Number of reruns per instance."""
    return trajectories.groupBy("instance").agg(F.count(F.lit(1)).alias("reruns"))


def run_group_sizes(trajectories: DataFrame, min_instances: int = MIN_INSTANCES_PER_GROUP) -> DataFrame:
    """Instances per rerun count, for the counts shared by more than ``min_instances`` instances."""
    return (rerun_counts(trajectories).groupBy("reruns").agg(F.count(F.lit(1)).alias("instances"))
            .where(F.col("instances") > min_instances)
            .withColumn("trajectories", F.col("reruns") * F.col("instances")))


def assign_runs(trajectories: DataFrame, order, min_instances: int = MIN_INSTANCES_PER_GROUP) -> DataFrame:
    """The i-th trajectory of an instance (in file order) becomes run i of the group of its rerun count.

    The window is per instance: an instance has one row per rerun, so its size does not grow with the data.
    """
    per_instance = Window.partitionBy("instance")
    numbered = (trajectories.withColumn("reruns", F.count(F.lit(1)).over(per_instance))
                .withColumn("run", F.row_number().over(per_instance.orderBy(*order))))
    kept = run_group_sizes(trajectories, min_instances).select("reruns")
    return numbered.join(kept, "reruns", "left_semi")


def run_statistics(runs: DataFrame) -> DataFrame:
    """Per run, and for the whole group (run is null): trajectories, resolved, resolve rate, distinct repositories.

    Repositories are made distinct in their own shuffle with partial aggregation before they are counted.
    """
    flagged = runs.select("reruns", "run", "repository", F.col("passed").cast("long").alias("passed"))
    totals = (flagged.groupBy("reruns", "run", "repository").agg(F.count(F.lit(1)).alias("n"), F.sum("passed").alias("solved")))
    per_run = (totals.groupBy("reruns", "run")
               .agg(F.sum("n").alias("trajectories"), F.sum("solved").alias("resolved"), F.count(F.lit(1)).alias("repositories")))
    whole = (totals.groupBy("reruns", "repository").agg(F.sum("n").alias("n"), F.sum("solved").alias("solved"))
             .groupBy("reruns").agg(F.sum("n").alias("trajectories"), F.sum("solved").alias("resolved"), F.count(F.lit(1)).alias("repositories"))
             .withColumn("run", F.lit(None).cast("int")))
    return (per_run.unionByName(whole)
            .withColumn("resolve_rate", F.col("resolved") / F.col("trajectories")))


def run_group_summary(outcomes: DataFrame) -> DataFrame:
    """One row per run group: resolve percentage of each run in run order, lowest and highest.

    Only the per-run percentages are gathered (one value per run).
    """
    per_run = (outcomes.groupBy("reruns", "run")
               .agg(F.count(F.lit(1)).alias("instances"), F.round(F.avg("passed") * 100, 4).alias("pct")))
    return (per_run.groupBy("reruns")
            .agg(F.max("instances").alias("instances"), F.count(F.lit(1)).alias("runs"),
                 F.array_sort(F.collect_list(F.struct("run", "pct"))).alias("by_run"),
                 F.min("pct").alias("pct_min"), F.max("pct").alias("pct_max"))
            .withColumn("pct_per_run", F.col("by_run.pct")).drop("by_run"))


def trajectory_map(records: DataFrame) -> DataFrame:
    """Trajectory id → instance, repository and outcome; the record with the largest path wins."""
    return (records.where(F.col("trajectory").isNotNull() & (F.col("trajectory") != ""))
            .groupBy("trajectory")
            .agg(F.max_by(F.struct("instance", F.coalesce("repository", F.lit("unknown")).alias("repository"), "passed"), "path").alias("last"))
            .select("trajectory", "last.instance", "last.repository", "last.passed"))


def repository_names(trajectories: DataFrame, min_instances: int = MIN_INSTANCES_PER_GROUP) -> DataFrame:
    """Distinct repositories of all instances whose rerun count forms a kept group."""
    kept = run_group_sizes(trajectories, min_instances).select("reruns")
    members = rerun_counts(trajectories).join(kept, "reruns", "left_semi").select("instance")
    return (trajectories.join(members, "instance", "left_semi")
            .select(F.coalesce("repository", F.lit("unknown")).alias("repository")).distinct())


def complete_outcomes(outcomes: DataFrame) -> DataFrame:
    """Outcomes of the instances that were observed in every run that occurs at all."""
    runs = outcomes.select("run").distinct().agg(F.count(F.lit(1)).alias("_runs"))
    seen = outcomes.groupBy("instance", "run").agg(F.max("passed").alias("passed"))
    counted = seen.groupBy("instance").agg(F.count(F.lit(1)).alias("_runs"))
    return seen.join(counted.join(F.broadcast(runs), "_runs", "left_semi"), "instance", "left_semi")


def outcome_vectors(outcomes: DataFrame, n_runs: int) -> DataFrame:
    """One row per complete instance with its outcomes as a short array, indexed by run.

    A benchmark has few runs (5 to 10 in practice), so the array is small; carrying it in the row lets every later step read
    training and test outcomes without another join.
    """
    cells = [F.max(F.when(F.col("run") == r, F.col("passed"))).cast("int").alias(f"_{r}") for r in range(n_runs)]
    wide = outcomes.groupBy("instance").agg(*cells)
    whole = F.lit(True)
    for r in range(n_runs):
        whole = whole & F.col(f"_{r}").isNotNull()
    return wide.where(whole).select("instance", F.array(*[F.col(f"_{r}") for r in range(n_runs)]).alias("outcomes"))
