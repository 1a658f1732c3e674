"""Catalogue of selection methods, their labels and the evaluation of families."""
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import settled
from . import blocks, calibration, clusters, errors, rounds, selection, strata
from .rankings import FAMILIES

# The parts method names are made of.
ALGORITHMS = ("fl", "medoid", "centroid", "ks", "core_edge")
VARIANTS = ("pooled", "ts")
SHORTLIST_ALGORITHMS = ("fl", "centroid", "ks")
CLUSTERINGS = ("kmeans", "hdbscan")
SPACES = ("pooled", "ts", "features", "features_top5")
MODES = ("strata", "nostrata")
RATIOS = {"15x": 1.5, "20x": 2.0}


def method_names(family: str):
    """(method, smallest window) pairs of a family."""
    if family == "baselines":
        return [(m, 1) for m in strata.ONE_RUN_BASELINES] + [(m, 2) for m in strata.TWO_RUN_BASELINES] + [(strata.CONTROL, 1)]
    if family == "embedding_strata":
        return [(f"{a}_{v}", 1) for v in VARIANTS for a in ALGORITHMS]
    if family == "pure_embedding":
        return [(f"{a}_{v}{s}", 1) for v in VARIANTS for a in ALGORITHMS for s in ("", "_cal")]
    if family == "clustering":
        return [(f"{c}_{s}_{m}", 1) for s in SPACES for c in CLUSTERINGS for m in MODES]
    return [(f"{a}_{v}_{m}_{r}", 1) for v in VARIANTS for a in SHORTLIST_ALGORITHMS for m in MODES for r in RATIOS]


def catalogue(spark: SparkSession) -> DataFrame:
    """methods(family, method, min_window), exploded from one row per family."""
    rows = [(f, [n for n, _ in method_names(f)], [w for _, w in method_names(f)]) for f in FAMILIES]
    table = spark.createDataFrame(rows, "family string, names array<string>, windows array<int>")
    return table.select("family", F.explode(F.arrays_zip("names", "windows")).alias("m")).select("family", F.col("m.names").alias("method"), F.col("m.windows").alias("min_window"))


def chosen_methods(methods: DataFrame, requested: DataFrame, window: int) -> DataFrame:
    """Methods to evaluate at one window: a family with a requested (bare or qualified) name keeps the named ones, others stay whole."""
    names = requested.select(F.col("name"))
    qualified = methods.withColumn("_full", F.concat_ws(":", "family", "method"))
    hits = (qualified.join(names.withColumnRenamed("name", "_full"), "_full", "left_semi").select("family", "method")
            .unionByName(qualified.join(names.withColumnRenamed("name", "method"), "method", "left_semi").select("family", "method"))).distinct()
    named = hits.select("family").distinct().withColumn("_named", F.lit(True))
    marked = (methods.join(named, "family", "left").join(hits.withColumn("_hit", F.lit(True)), ["family", "method"], "left"))
    return marked.where((F.col("_named").isNull() | F.col("_hit").isNotNull()) & (F.col("min_window") <= window)).select("family", "method", "min_window")


def unknown_methods(methods: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested names that match no method, bare or qualified."""
    known = methods.select(F.col("method").alias("name")).unionByName(methods.select(F.concat_ws(":", "family", "method").alias("name")))
    return requested.join(known, "name", "left_anti")


def evaluate_pure_embedding(members: DataFrame, keys, algorithm: str, fractions, rates: DataFrame, n_runs: int) -> DataFrame:
    """Pure embedding and its calibrated form: errors per (keys, subset, method).

    ``members``: keys, instance, outcomes, test, passes, vector.
    """
    keys = list(keys)
    quotas = strata.stratum_quotas(members.withColumn("stratum", F.lit("")), keys, fractions).select(*keys, "subset", "quota")
    rows = members.select(*keys, "instance", "vector", F.lit(True).alias("in_group")).join(quotas, keys)
    picked = rounds.geometric_selection(rows, [*keys, "subset"], algorithm)
    calibrated = calibration.calibrate(picked, members.select(*keys, "instance", "passes"), [*keys, "subset"])
    both = (picked.select(*keys, "subset", "instance").withColumn("method", F.lit(f"{algorithm}_pooled"))
            .unionByName(calibrated.withColumn("method", F.lit(f"{algorithm}_pooled_cal"))))
    chosen = both.join(members.select(*keys, "instance", "outcomes", "test"), [*keys, "instance"])
    return errors.deterministic_metrics(chosen, rates, [*keys, "subset", "method"], n_runs)


def covering_rows(members: DataFrame, keys, quotas: DataFrame, bandwidth: bool) -> DataFrame:
    """Every stratum next to its whole population, for methods that score candidates against all members.

    A member is repeated once per (stratum, subset) of its population; outcome strata are at most one more than the training runs.
    """
    keys = list(keys)
    groups = quotas.groupBy(*keys).agg(F.collect_list(F.struct("stratum", "subset", "quota")).alias("_groups"))
    rows = (members.select(*keys, "instance", "vector", F.col("stratum").alias("_own")).join(groups, keys).withColumn("_g", F.explode("_groups"))
            .select(*keys, "_g.stratum", "_g.subset", "_g.quota", "instance", "vector", (F.col("_own") == F.col("_g.stratum")).alias("in_group")))
    if not bandwidth:
        return rows
    return rows.join(settled(blocks.median_positive_distance(members.where(F.col("vector").isNotNull()), keys)), keys)


def evaluate_within_strata(members: DataFrame, keys, algorithm: str, fractions, rates: DataFrame, n_runs: int) -> DataFrame:
    """A geometric method inside the outcome strata: errors per (keys, subset, method). ``members`` also has ``stratum``."""
    keys = list(keys)
    quotas = strata.stratum_quotas(members, keys, fractions).select(*keys, "stratum", "subset", "quota")
    if algorithm in ("fl", "medoid"):
        rows = covering_rows(members, keys, quotas, algorithm == "fl")
    else:
        rows = members.select(*keys, "stratum", "instance", "vector", F.lit(True).alias("in_group")).join(quotas, [*keys, "stratum"])
    picked = rounds.geometric_selection(rows, [*keys, "stratum", "subset"], algorithm).withColumn("method", F.lit(f"{algorithm}_pooled"))
    chosen = picked.select(*keys, "subset", "method", "instance").join(members.select(*keys, "instance", "outcomes", "test"), [*keys, "instance"])
    return errors.deterministic_metrics(chosen, rates, [*keys, "subset", "method"], n_runs)


def evaluate_clustering(members: DataFrame, keys, method: str, fractions, rates: DataFrame, n_runs: int, n_draws: int) -> DataFrame:
    """Stratified random sampling over clusters: errors per (keys, subset, method), instances outside all clusters fill shortfalls.

    ``members``: keys, instance, outcomes, test, vector, usable.
    """
    keys = list(keys)
    labels = clusters.cluster_strata(members, keys, method).withColumn("method", F.lit(f"{method}_pooled_nostrata"))
    grouped = labels.join(members.select(*keys, "instance", "outcomes", "test"), [*keys, "instance"])
    quotas = strata.stratum_quotas(grouped, [*keys, "method"], fractions)
    drawn = selection.stratified_draws(grouped, quotas, n_draws, "clusters", (*keys, "method"))
    measured = errors.split_metrics(errors.run_errors(drawn, rates, [*keys, "subset", "method", "draw"], n_runs))
    return errors.stochastic_metrics(measured, [*keys, "subset", "method"])
