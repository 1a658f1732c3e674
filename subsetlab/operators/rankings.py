"""Ranking of selection methods: aggregation over windows, compared methods, dominance, reference comparisons, horizons."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from . import stats

# Families, their tags, display labels and reference baselines.
FAMILIES = ("baselines", "embedding_strata", "pure_embedding", "clustering", "shortlist")
FAMILY_TAGS = {"embedding_strata": "[ES]", "pure_embedding": "[PE]", "clustering": "[CL]", "shortlist": "[SL]"}
BASELINE_LABELS = {"random": "Random", "difficulty_stratified": "Diff-Strat", "consistency_stratified": "Consist-Strat", "repo_stratified": "Repo-Strat",
                   "repo_difficulty_stratified": "Repo×Diff", "repo_consistency_stratified": "Repo×Consist"}
WORD_LABELS = {"fl": "FL", "medoid": "Medoid", "centroid": "Centroid", "ks": "KS", "core_edge": "Core/Edge", "kmeans": "K-Means", "hdbscan": "HDBSCAN",
               "pooled": "Pooled", "ts": "TS", "strata": "+Strata", "nostrata": "NoStrata", "cal": "+Cal", "features": "Feat", "features_top5": "Feat5"}
RANDOM = "baselines:random"
DIFFICULTY, CONSISTENCY = "baselines:difficulty_stratified", "baselines:consistency_stratified"
REFERENCES = (RANDOM, DIFFICULTY, CONSISTENCY)
OVERALL = 0      # window number of the table over all windows
ALPHA = 0.05
VALUES = ("rmse", "maxerr", "p95")


def family_of(name: Column, separator: str = ":") -> Column:
    """Family of a qualified method name, ``unknown`` without a known prefix."""
    prefix = F.regexp_extract(name, f"^({'|'.join(FAMILIES)}){separator}", 1)
    return F.when(prefix != "", prefix).otherwise("unknown")


def local_name(name: Column, separator: str = ":") -> Column:
    """Method name without its family."""
    return F.regexp_replace(name, f"^({'|'.join(FAMILIES)}){separator}", "")


def label_of(name: Column, separator: str = ":", times: str = "×") -> Column:
    """Display label, e.g. ``embedding_strata:fl_pooled`` → ``FL Pooled [ES]``."""
    as_map = lambda table: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    local, family = local_name(name, separator), family_of(name, separator)
    joined = F.replace(F.replace(local, F.lit("core_edge"), F.lit("core-edge")), F.lit("features_top5"), F.lit("features-top5"))
    words = F.transform(F.split(joined, "_"), lambda w: F.coalesce(
        F.try_element_at(as_map(WORD_LABELS), F.replace(w, F.lit("-"), F.lit("_"))),
        F.when(w.rlike("^[0-9]+x$"), F.replace(w, F.lit("x"), F.lit(times))), F.initcap(w)))
    tag = F.try_element_at(as_map(FAMILY_TAGS), family)
    plain = F.coalesce(F.try_element_at(as_map(BASELINE_LABELS), local), F.initcap(F.replace(local, F.lit("_"), F.lit(" "))))
    return F.when(family == "baselines", plain).otherwise(F.concat_ws(" ", F.array_join(words, " "), tag))


def window_average(table: DataFrame, unit: str = "population") -> DataFrame:
    """Values of every unit averaged over the windows its method exists in, as window ``OVERALL``."""
    return (table.groupBy(unit, "level", "method", "subset").agg(*[F.avg(v).alias(v) for v in VALUES])
            .withColumn("window", F.lit(OVERALL)).select(*[c for c in table.columns if c in (unit, "level", "method", "subset", "window", *VALUES)]))


def with_overall(table: DataFrame, unit: str = "population") -> DataFrame:
    """Per-window rows and the rows over all windows."""
    overall = window_average(table, unit)
    return table.select(*overall.columns).unionByName(overall)


def strongest_baseline(window: Column, only_baselines: Column = None) -> Column:
    """Reference baseline of a window: difficulty strata at one training run, consistency strata otherwise."""
    rule = F.when(window == 1, DIFFICULTY).otherwise(CONSISTENCY)
    return rule if only_baselines is None else F.when(only_baselines, RANDOM).otherwise(rule)


def method_means(table: DataFrame) -> DataFrame:
    """Mean and median values per (window, subset, method)."""
    return table.groupBy("window", "subset", "method").agg(F.avg("rmse").alias("mean_rmse"), F.avg("maxerr").alias("mean_maxerr"), F.median("rmse").alias("median_rmse"),
                                                           F.count(F.lit(1)).alias("n"))


def top_methods(table: DataFrame, n_top: int, comparisons: DataFrame = None) -> DataFrame:
    """The ``n_top`` methods with the lowest mean RMSE per (window, subset); the references are appended and marked.

    With comparisons (window, subset, method, win_rate, p_value against the strongest baseline) candidates are first the methods that
    win significantly, then those that win, then all, whichever tier is large enough first.
    """
    cell = Window.partitionBy("window", "subset")
    means = method_means(table)
    only = F.min((family_of(F.col("method")) == "baselines").cast("int")).over(cell) == 1
    means = means.withColumn("_reference", strongest_baseline(F.col("window"), only))
    tier = F.lit(3)
    if comparisons is not None:
        means = means.join(comparisons.select("window", "subset", "method", "win_rate", F.col("p_value").alias("_p")), ["window", "subset", "method"], "left")
        tier = F.when((F.col("win_rate") > 50) & (F.col("_p") < ALPHA), 1).when(F.col("win_rate") > 50, 2).otherwise(3)
    tiered = means.withColumn("_tier", tier)
    first, second = F.sum((F.col("_tier") == 1).cast("int")).over(cell), F.sum((F.col("_tier") <= 2).cast("int")).over(cell)
    used = F.when(first >= n_top, 1).when(second >= n_top, 2).otherwise(3)
    open_ = tiered.withColumn("_open", F.col("_tier") <= used)
    order = cell.orderBy(F.desc("_open"), F.round("mean_rmse", 12), F.round("mean_maxerr", 12), "method")
    placed = open_.withColumn("place", F.row_number().over(order))
    is_top = F.col("_open") & (F.col("place") <= n_top)
    is_reference = (F.col("method") == F.col("_reference")) | (F.col("method") == RANDOM)
    return (placed.where(is_top | is_reference).withColumn("reference_only", ~is_top)
            .select("window", "subset", "method", "mean_rmse", "mean_maxerr", "place", "reference_only"))


def compared_methods(table: DataFrame, n_top: int, comparisons: DataFrame = None) -> DataFrame:
    """Methods of the comparison blocks: the reference baselines and the top methods."""
    top = top_methods(table, n_top, comparisons).where(~F.col("reference_only")).select("window", "subset", "method")
    references = table.where(F.col("method").isin(*REFERENCES)).select("window", "subset", "method").distinct()
    return top.unionByName(references).dropDuplicates()


def dominance_ranks(table: DataFrame, unit: str = "population", min_nonzero: int = 1) -> DataFrame:
    """Number of methods that beat each method: pairwise signed-rank tests, Holm over all pairs of a cell, unequal medians.

    Methods of one unit meet each other on the unit key; a unit has as many rows as there are methods.
    """
    a = table.select("window", "subset", unit, F.col("method").alias("first"), F.col("rmse").alias("_a"))
    b = table.select("window", "subset", unit, F.col("method").alias("second"), F.col("rmse").alias("_b"))
    pairs = a.join(b, ["window", "subset", unit]).where(F.col("first") < F.col("second")).withColumn("_d", F.col("_b") - F.col("_a"))
    tests = stats.signed_rank(pairs, ["window", "subset", "first", "second"], "_d", min_nonzero=min_nonzero)
    adjusted = stats.holm(tests.withColumn("_pair", F.concat_ws("|", "first", "second")), ["window", "subset"], tie="_pair")
    medians = method_means(table).select("window", "subset", "method", F.round("median_rmse", 12).alias("median"))
    named = (adjusted.join(medians.withColumnRenamed("method", "first").withColumnRenamed("median", "_m1"), ["window", "subset", "first"])
             .join(medians.withColumnRenamed("method", "second").withColumnRenamed("median", "_m2"), ["window", "subset", "second"]))
    loser = F.when(F.col("_m1") < F.col("_m2"), F.col("second")).otherwise(F.col("first"))
    beaten = (named.where((F.col("holm_p") < ALPHA) & (F.col("_m1") != F.col("_m2"))).withColumn("method", loser)
              .groupBy("window", "subset", "method").agg(F.count(F.lit(1)).alias("_n")))
    return medians.join(beaten, ["window", "subset", "method"], "left").select("window", "subset", "method", F.coalesce("_n", F.lit(0)).alias("beaten_by"))


def comparison_rows(table: DataFrame, reference: Column, unit: str = "population", min_nonzero: int = 1) -> DataFrame:
    """Every method against the reference of its window: p, Holm, paired delta, improvement and win / tie / loss at 1 %."""
    marked = table.withColumn("_ref", reference)
    base = (marked.where(F.col("method") == F.col("_ref")).select("window", "subset", unit, F.col("rmse").alias("_rr"), F.col("maxerr").alias("_rm")))
    paired = marked.where(F.col("method") != F.col("_ref")).join(base, ["window", "subset", unit]).withColumn("_d", F.col("_rr") - F.col("rmse"))
    keys = ["window", "subset", "method"]
    verdict = stats.win_tie_loss(F.col("rmse"), F.col("_rr"))
    count = lambda v: F.sum((verdict == v).cast("long"))
    better = lambda own, ref: F.when(F.avg(ref) > 0, (F.avg(ref) - F.avg(own)) / F.avg(ref) * 100).otherwise(0.0)
    rows = paired.groupBy(*keys, "_ref").agg(
        F.median("rmse").alias("median"), F.avg("rmse").alias("mean"), stats.paired_delta(F.col("_rr"), F.col("rmse")).alias("delta"),
        better("rmse", "_rr").alias("imp_rmse"), better("maxerr", "_rm").alias("imp_maxerr"), count("win").alias("wins"), count("tie").alias("ties"), count("loss").alias("losses"))
    tests = stats.signed_rank(paired, keys, "_d", min_nonzero=min_nonzero).select(*keys, "p_value")
    joined = rows.withColumnRenamed("_ref", "reference").join(tests, keys).withColumn("magnitude", stats.delta_magnitude(F.col("delta")))
    return stats.holm(joined, ["window", "subset"])


def tail_exceedance(values: DataFrame, reference: Column, shares=(0.75, 0.90, 0.95)) -> DataFrame:
    """Share of a method's values above the P75 / P90 / P95 of its window's reference."""
    marked = values.withColumn("_ref", reference)
    limits = marked.where(F.col("method") == F.col("_ref")).groupBy("window", "subset").agg(F.percentile("rmse", list(shares)).alias("_t"))
    joined = marked.join(limits, ["window", "subset"])
    above = [F.avg((F.round(F.col("rmse") - F.get("_t", F.lit(i)), stats.NOISE_DIGITS) > 0).cast("double")).alias(f"above_p{share * 100:g}") for i, share in enumerate(shares)]
    return joined.groupBy("window", "subset", "method").agg(*above)


def superiority_rows(table: DataFrame, reference: Column, unit: str = "population") -> DataFrame:
    """Probability that a method's error is below its window's reference on the same unit."""
    marked = table.withColumn("_ref", reference)
    base = marked.where(F.col("method") == F.col("_ref")).select("window", "subset", unit, F.col("rmse").alias("_r"))
    return (marked.join(base, ["window", "subset", unit]).groupBy("window", "subset", "method")
            .agg(stats.superiority(F.col("rmse"), F.col("_r")).alias("ps")).withColumn("magnitude", stats.superiority_magnitude(F.col("ps"))))


def error_distributions(table: DataFrame, draws: DataFrame) -> DataFrame:
    """Error statistics: baselines over all their draws, other methods over units. Quantiles use the bucketed algorithm."""
    drawn = draws.select("window", "subset", F.concat(F.lit("baselines:"), "method").alias("method"), "rmse")
    fixed = table.join(drawn.select("window", "subset", "method").distinct(), ["window", "subset", "method"], "left_anti").select("window", "subset", "method", "rmse")
    return stats.describe(drawn.unionByName(fixed), ["window", "subset", "method"], "rmse")


def draw_record(table: DataFrame, draws: DataFrame, unit: str = "population") -> DataFrame:
    """Win / tie / loss of every non-baseline method over all (unit, seed) pairs of every baseline, tolerance 1 % of the draw."""
    own = table.where(family_of(F.col("method")) != "baselines").select("window", "subset", unit, "method", F.col("rmse").alias("_own"))
    joined = own.join(draws.select("window", "subset", unit, F.col("method").alias("baseline"), "draw", F.col("rmse").alias("_drawn")), ["window", "subset", unit])
    verdict = stats.win_tie_loss(F.col("_own"), F.col("_drawn"))
    counts = joined.groupBy("window", "subset", "method", "baseline").agg(*[F.sum((verdict == v).cast("long")).alias(v) for v in ("win", "tie", "loss")], F.count(F.lit(1)).alias("n"))
    seeds = (joined.groupBy("window", "subset", "method", "baseline", "draw").agg(F.avg((verdict == "win").cast("double")).alias("_share")).withColumn("_d", F.col("_share") - 0.5))
    test = stats.signed_rank(seeds, ["window", "subset", "method", "baseline"], "_d").select("window", "subset", "method", "baseline", "p_value")
    return counts.join(test, ["window", "subset", "method", "baseline"]).withColumn("win_fraction", F.col("win") / F.col("n"))


def horizon(per_split: DataFrame) -> DataFrame:
    """Median split RMSE by number of test runs, and Spearman's rho between the two, per (window, subset, method).

    The horizon is the size of the split's own test set, so positions and splits cannot fall out of step.
    """
    keys = ["window", "subset", "method"]
    medians = per_split.groupBy(*keys, "horizon").agg(F.median("rmse").alias("median"))
    return medians.join(stats.spearman(medians, keys, "horizon", "median"), keys)


def best_methods(table: DataFrame) -> DataFrame:
    """Best method and runner-up by mean RMSE per (window, level, subset)."""
    means = table.groupBy("window", "level", "subset", "method").agg(F.avg("rmse").alias("value")).withColumn("value", F.round("value", 12))
    order = Window.partitionBy("window", "level", "subset").orderBy("value", "method")
    return (means.withColumn("_r", F.row_number().over(order)).withColumn("runner_up", F.lead("method").over(order)).withColumn("runner_up_value", F.lead("value").over(order))
            .where(F.col("_r") == 1).select("window", "level", "subset", F.col("method").alias("best"), F.col("value").alias("best_value"), "runner_up", "runner_up_value"))


def win_frequency(best: DataFrame) -> DataFrame:
    """How often each method is best."""
    return best.groupBy(F.col("best").alias("method")).agg(F.count(F.lit(1)).alias("cells"))


def all_methods(table: DataFrame, unit: str = "population") -> DataFrame:
    """Statistics of every method: label, family and the description of both errors."""
    keys = ["window", "subset", "method"]
    rmse = stats.describe(table, keys, "rmse").select(*keys, F.struct("mean", "median", "std", "iqr", "p5", "p25", "p75", "p95", "min", "max", "n").alias("rmse"))
    maxerr = stats.describe(table, keys, "maxerr").select(*keys, F.struct("mean", "median", "std", "iqr", "p5", "p25", "p75", "p95", "min", "max", "n").alias("maxerr"))
    return rmse.join(maxerr, keys).withColumn("label", label_of(F.col("method"))).withColumn("family", family_of(F.col("method")))


def family_coverage(table: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Per family: methods of the catalogue, methods present in the results, and whether all are there."""
    present = table.select("method").distinct().withColumn("_here", F.lit(1))
    named = catalogue.withColumn("method", F.concat_ws(":", "family", "method"))
    return (named.join(present, "method", "left").groupBy("family")
            .agg(F.count(F.lit(1)).alias("expected"), F.coalesce(F.sum("_here"), F.lit(0)).alias("found"))
            .withColumn("complete", F.col("expected") == F.col("found")))
