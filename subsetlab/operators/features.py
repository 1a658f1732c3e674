"""Numeric trajectory features, their coverage, averages and standardisation."""
from pyspark.sql import DataFrame, Window, functions as F

# Feature names; the second tuple is the five-column count space.
FEATURES = ("n_steps", "total_edit_log", "n_edit_steps", "max_edit_log", "n_errors", "n_unique_files", "n_test_steps",
            "frac_bash", "frac_edit", "mean_obs_len_log")
COUNT_FEATURES = ("n_steps", "n_edit_steps", "n_errors", "n_unique_files", "n_test_steps")
SMALL_SPREAD = 1e-8


def trajectory_features(steps: DataFrame, trajectories: DataFrame, keys=("run", "instance")) -> DataFrame:
    """Ten features per trajectory; all null for a trajectory without steps.

    The steps are read once: a step with several files becomes a row per file, of which only the first counts as the step.
    """
    keys = list(keys)
    measured = steps.select(*keys, F.coalesce("edit_size", F.lit(0)).cast("long").alias("_size"), (F.coalesce("error_message", F.lit("")) != "").alias("_error"),
                            (F.size("tests_run") > 0).alias("_test"), "action_header", F.log1p(F.length(F.coalesce("observation", F.lit(""))).cast("double")).alias("_length"), "files_touched")
    rows = measured.select(*keys, "_size", "_error", "_test", "action_header", "_length", F.posexplode_outer("files_touched").alias("_at", "_file"))
    of_step = lambda value: F.when(F.coalesce("_at", F.lit(0)) == 0, value)
    hit = lambda condition: F.sum(of_step(F.when(condition, 1).otherwise(0)))
    main = rows.groupBy(*keys).agg(
        F.count(of_step(F.lit(1))).alias("n_steps"), F.log1p(F.sum(of_step(F.col("_size"))).cast("double")).alias("total_edit_log"), hit(F.col("_size") > 0).alias("n_edit_steps"),
        F.log1p(F.max("_size").cast("double")).alias("max_edit_log"), hit(F.col("_error")).alias("n_errors"), hit(F.col("_test")).alias("n_test_steps"),
        F.avg(of_step((F.col("action_header") == "execute_bash").cast("double"))).alias("frac_bash"),
        F.avg(of_step((F.col("action_header") == "str_replace_editor").cast("double"))).alias("frac_edit"), F.avg(of_step(F.col("_length"))).alias("mean_obs_len_log"),
        F.countDistinct(F.when(F.col("_at").isNotNull(), F.struct("_file"))).alias("_files"))
    joined = trajectories.select(*keys).distinct().join(main, keys, "left")
    known = joined.withColumn("n_unique_files", F.when(F.col("n_steps").isNotNull(), F.coalesce("_files", F.lit(0))))
    return known.select(*keys, *[F.col(f).cast("double").alias(f) for f in FEATURES])


def feature_coverage(features: DataFrame) -> DataFrame:
    """Per run: instances found and missing among the instances of all runs."""
    every = features.select("instance").distinct().agg(F.count(F.lit(1)).alias("_all"))
    found = features.groupBy("run").agg(F.countDistinct("instance").alias("found")).withColumn("_one", F.lit(1))
    return (found.join(F.broadcast(every.withColumn("_one", F.lit(1))), "_one")
            .select("run", "found", (F.col("_all") - F.col("found")).alias("missing")))


def averaged_features(features: DataFrame, splits: DataFrame) -> DataFrame:
    """Mean of every feature over a split's training runs, missing values ignored."""
    training = splits.select("window", "split", F.explode("train").alias("run"))
    return (features.join(F.broadcast(training), "run").groupBy("window", "split", "instance")
            .agg(*[F.avg(f).alias(f) for f in FEATURES]))


def standardised(values: DataFrame, keys, columns=FEATURES) -> DataFrame:
    """Z-scores per group: constant columns keep unit scale, missing values become 0. Only means and spreads are joined back."""
    moments = values.groupBy(*keys).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_s_{c}") for c in columns])
    joined = values.join(moments, list(keys))
    scale = lambda c: F.when(F.col(f"_s_{c}") < SMALL_SPREAD, 1.0).otherwise(F.col(f"_s_{c}"))
    scaled = [F.coalesce((F.col(c) - F.col(f"_m_{c}")) / scale(c), F.lit(0.0)).alias(c) for c in columns]
    return joined.select(*[c for c in values.columns if c not in columns], *scaled)


def feature_space(averaged: DataFrame, space: str = "features") -> DataFrame:
    """Vector and usable flag in one feature space: all ten features or the five counts; missing values are 0 and not usable."""
    spaces = {"features": FEATURES, "features_top5": COUNT_FEATURES}
    if space not in spaces:
        raise ValueError(f"unknown feature space {space!r}; known: {', '.join(spaces)}")
    columns = spaces[space]
    usable = F.lit(True)
    for c in columns:
        usable = usable & F.col(c).isNotNull()
    others = [c for c in averaged.columns if c not in FEATURES]
    return averaged.select(*others, F.array(*[F.coalesce(c, F.lit(0.0)) for c in columns]).alias("vector"), usable.alias("usable"))
