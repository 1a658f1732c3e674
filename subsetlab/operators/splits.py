"""Temporal splits: every choice of W earlier runs for training, all later runs for testing."""
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def training_sets(n_runs: int, window: int) -> Column:
    """Array of all training sets of ``window`` runs that leave at least one later run, in lexicographic order.

    The expression has no inputs: Catalyst folds it to a literal, so splits are exploded inside the row instead of joined.
    """
    if not 1 <= window < n_runs:
        raise ValueError(f"need 1 <= window < runs, got window {window} and {n_runs} runs")
    runs = F.sequence(F.lit(0), F.lit(n_runs - 2))   # the last run is never trained on
    sets = F.transform(runs, lambda r: F.array(r))
    for _ in range(window - 1):   # every set grows by each later run, so sets stay in lexicographic order
        sets = F.flatten(F.transform(sets, lambda s: F.transform(F.filter(runs, lambda r: r > F.element_at(s, -1)), lambda r: F.concat(s, F.array(r)))))
    return sets


def later_runs(train: Column, n_runs: int) -> Column:
    """Runs after the latest training run."""
    return F.sequence(F.element_at(train, -1) + 1, F.lit(n_runs - 1))


def explode_splits(df: DataFrame, n_runs: int, windows) -> DataFrame:
    """Repeat every row once per (window, split); adds ``window``, ``split``, ``train`` and ``test``."""
    per_window = F.array(*[F.struct(F.lit(w).alias("window"), training_sets(n_runs, w).alias("sets")) for w in windows])
    return (df.withColumn("_w", F.explode(per_window))
            .select(*df.columns, F.col("_w.window").alias("window"), F.posexplode("_w.sets").alias("split", "train"))
            .withColumn("test", later_runs(F.col("train"), n_runs)))


def temporal_splits(spark: SparkSession, n_runs: int, windows) -> DataFrame:
    """The split dimension itself."""
    return explode_splits(spark.range(1).select(F.lit(n_runs).alias("runs")), n_runs, windows).drop("runs")
