"""Deterministic methods next to the seeded draws of the random baselines."""
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import tails
from . import stats

CATASTROPHIC = 2.0
BAND = (0.025, 0.975)


def per_seed(draws: DataFrame, keys) -> DataFrame:
    """Draw-level values over the splits of a population: mean RMSE and largest MaxErr per seed."""
    return draws.groupBy(*keys, "draw").agg(F.avg("rmse").alias("rmse"), F.max("maxerr").alias("maxerr"))


def binomial_interval(successes: Column, n: Column, alpha: float = 0.05):
    """Exact (Clopper-Pearson) interval; one half stands in for zero at both edges."""
    s, failures = successes.cast("double"), (n - successes).cast("double")
    low = tails.beta_ppf(F.lit(alpha / 2), F.greatest(s, F.lit(0.5)), failures + 1)
    high = tails.beta_ppf(F.lit(1 - alpha / 2), s + 1, F.greatest(failures, F.lit(0.5)))
    return F.when(n > 0, low).otherwise(0.0), F.when(n > 0, high).otherwise(0.0)


def mean_interval(table: DataFrame, mean: str, sd: str, n: str, low: str, high: str) -> DataFrame:
    """Student interval of a mean; collapses to the mean without spread."""
    sem = F.col(sd) / F.sqrt(F.col(n))
    reach = F.when((F.col(n) > 1) & (sem > 0), tails.t_ppf(F.lit(0.975), F.when((F.col(n) > 1) & (sem > 0), F.col(n) - 1).cast("double")) * sem).otherwise(0.0)
    return table.withColumn(low, F.col(mean) - F.coalesce(reach, F.lit(0.0))).withColumn(high, F.col(mean) + F.coalesce(reach, F.lit(0.0)))


def unit_comparison(methods: DataFrame, draws: DataFrame, keys=("window", "subset"), unit: str = "population") -> DataFrame:
    """One row per (method, baseline, unit): win and tie share over the draws, median draw, gap and win / tie / loss.

    Every method row meets the draws of its own unit only; the join key contains the unit, and the draws of a unit are as many as
    there are seeds.
    """
    keys = list(keys)
    m = methods.select(*keys, unit, "level", "method", F.col("rmse").alias("own"))
    d = draws.select(*keys, unit, F.col("method").alias("baseline"), F.col("rmse").alias("drawn"))
    joined = m.join(d, [*keys, unit])
    gap = F.round(F.col("own") - F.col("drawn"), stats.NOISE_DIGITS)
    table = joined.groupBy(*keys, unit, "level", "method", "baseline", "own").agg(
        F.avg((gap < 0).cast("double")).alias("win_share"), F.avg((gap == 0).cast("double")).alias("tie_share"), F.median("drawn").alias("median_draw"),
        F.sum((F.col("drawn") > CATASTROPHIC * F.col("own")).cast("long")).alias("catastrophic"), F.count(F.lit(1)).alias("draws"))
    return (table.withColumn("gap_pct", F.when(F.col("median_draw") > 0, (F.col("median_draw") - F.col("own")) / F.col("median_draw") * 100).otherwise(0.0))
            .withColumn("verdict", stats.win_tie_loss(F.col("own"), F.col("median_draw"))))


def draw_comparison(units: DataFrame, keys=("window", "subset", "method", "baseline")) -> DataFrame:
    """Summary of ``unit_comparison`` over units: win rate, mid percentile, gap, catastrophic rate, win / tie / loss counts."""
    count = lambda verdict: F.sum((F.col("verdict") == verdict).cast("long"))
    return units.groupBy(*keys).agg(
        (F.avg("win_share") * 100).alias("win_rate"), (F.avg(F.col("win_share") + 0.5 * F.col("tie_share")) * 100).alias("percentile"),
        F.avg("own").alias("method_rmse"), F.avg("gap_pct").alias("gap_pct"), F.stddev_samp("gap_pct").alias("gap_sd"), F.median("gap_pct").alias("gap_median_pct"),
        (F.sum("catastrophic") / F.sum("draws") * 100).alias("catastrophic_rate"), count("win").alias("win"), count("tie").alias("tie"),
        count("loss").alias("loss"), F.count(F.lit(1)).alias("n"))


def with_intervals(summary: DataFrame) -> DataFrame:
    """Add the interval of the mean gap and the exact interval of the win fraction."""
    low, high = binomial_interval(F.col("win"), F.col("n"))
    return mean_interval(summary, "gap_pct", "gap_sd", "n", "gap_low", "gap_high").withColumn("win_low", low).withColumn("win_high", high)


def win_statistics(units: DataFrame, keys=("window", "subset", "method", "baseline")) -> DataFrame:
    """Distribution of the per-unit win shares, with a one-sided signed-rank test against one half (at least ten differences)."""
    described = stats.describe(units, keys, "win_share")
    shares = units.groupBy(*keys).agg(F.avg((F.col("win_share") > 0.5).cast("double")).alias("majority"), F.avg((F.col("win_share") > 0.8).cast("double")).alias("supermajority"),
                                      F.avg((F.col("win_share") < 0.5).cast("double")).alias("minority"))
    shifted = units.withColumn("_shift", F.col("win_share") - 0.5)
    test = stats.signed_rank(shifted.where(F.round("_shift", stats.NOISE_DIGITS) != 0), keys, "_shift", one_sided=True)
    tested = test.where(F.col("nonzero") >= 10).select(*keys, "w_plus", "p_value")
    return described.join(shares, list(keys)).join(tested, list(keys), "left")


def level_statistics(units: DataFrame, keys=("window", "subset", "method", "baseline")) -> DataFrame:
    """Win shares per difficulty level with at least two units."""
    return (units.groupBy(*keys, "level").agg(F.count(F.lit(1)).alias("n"), F.avg("win_share").alias("mean"), F.median("win_share").alias("median"),
                                              F.stddev_samp("win_share").alias("std"), F.avg((F.col("win_share") > 0.5).cast("double")).alias("majority"))
            .where(F.col("n") >= 2))


def split_comparison(method_splits: DataFrame, draws: DataFrame, keys=("window", "subset")) -> DataFrame:
    """Run-group comparison: win rate of the mean over splits, per-split win rate, gap and catastrophic rate.

    ``draws`` has one row per (keys, split, baseline, draw), ``method_splits`` one per (keys, split, method).
    """
    keys = list(keys)
    own = method_splits.groupBy(*keys, "method").agg(F.avg("rmse").alias("own"))
    seeds = draws.groupBy(*keys, F.col("method").alias("baseline"), "draw").agg(F.avg("rmse").alias("seed"))
    means = own.join(seeds, keys).groupBy(*keys, "method", "baseline").agg(
        F.avg((F.round(F.col("own") - F.col("seed"), stats.NOISE_DIGITS) < 0).cast("double")).alias("win_rate"), F.median("seed").alias("median_seed"), F.first("own").alias("own"),
        F.avg((F.col("seed") > CATASTROPHIC * F.col("own")).cast("double")).alias("catastrophic_rate"))
    per_split = (method_splits.select(*keys, "split", "method", F.col("rmse").alias("_own"))
                 .join(draws.select(*keys, "split", F.col("method").alias("baseline"), F.col("rmse").alias("_drawn")), [*keys, "split"])
                 .groupBy(*keys, "method", "baseline").agg(F.avg((F.round(F.col("_own") - F.col("_drawn"), stats.NOISE_DIGITS) < 0).cast("double")).alias("split_win_rate")))
    gap = F.when(F.col("median_seed") > 0, (F.col("median_seed") - F.col("own")) / F.col("median_seed") * 100).otherwise(0.0)
    return means.join(per_split, [*keys, "method", "baseline"]).withColumn("gap_pct", gap)


def band_placement(methods: DataFrame, draws: DataFrame, value: str, min_window: int = 1, unit: str = "population") -> DataFrame:
    """Share of units below, inside and above the central 95 % of the draws, both averaged over the windows used."""
    used = lambda df: df.where(F.col("window") >= min_window)
    own = used(methods).groupBy(unit, "subset", "method").agg(F.avg(value).alias("_v"))
    averaged = used(draws).groupBy(unit, "subset", F.col("method").alias("baseline"), "draw").agg(F.avg(value).alias("_d"))
    band = averaged.groupBy(unit, "subset", "baseline").agg(F.percentile("_d", list(BAND)).alias("_b"))
    joined = (own.join(band, [unit, "subset"]).withColumn("_low", F.get("_b", F.lit(0))).withColumn("_high", F.get("_b", F.lit(1))))
    r = lambda c: F.round(c, stats.NOISE_DIGITS)
    return joined.groupBy("subset", "method", "baseline").agg(
        F.count(F.lit(1)).alias("n"), F.round(100 * F.avg((r(F.col("_v") - F.col("_low")) < 0).cast("double")), 1).alias("below"),
        F.round(100 * F.avg(((r(F.col("_v") - F.col("_low")) >= 0) & (r(F.col("_v") - F.col("_high")) <= 0)).cast("double")), 1).alias("inside"),
        F.round(100 * F.avg((r(F.col("_v") - F.col("_high")) > 0).cast("double")), 1).alias("above"), F.median("_v").alias("median"),
        F.median("_low").alias("band_low_median"), F.median("_high").alias("band_high_median"), F.min("_low").alias("band_low_min"),
        F.max("_v").alias("method_max"), F.min(F.col("_low") - F.col("_v")).alias("margin_min"))


def seed_statistics(draws: DataFrame, keys, value: str = "maxerr") -> DataFrame:
    """Median, P95, largest and mean over the seeds of one unit (one value per seed)."""
    return (draws.groupBy(*keys).agg(F.percentile(value, [0.5, 0.95]).alias("_q"), F.max(value).alias("seed_max"), F.avg(value).alias("seed_mean"), F.count(F.lit(1)).alias("seeds"))
            .withColumn("seed_median", F.get("_q", F.lit(0))).withColumn("seed_p95", F.get("_q", F.lit(1))).drop("_q"))


def per_seed_report(methods: DataFrame, draws: DataFrame, stored: DataFrame, unit: str = "population") -> DataFrame:
    """Deterministic MaxErr next to the seeds' and to the stored baselines': values per window and unit, averaged over windows, then over units.

    ``stored`` has the baselines' own results (window, unit, subset, baseline, maxerr, maxerr_mean). A baseline is reported for the windows and
    subsets that have both its draws and its stored result. Changes compare means, and medians where their name says so.
    """
    at = ["window", unit, "subset"]
    seeds = seed_statistics(draws.withColumnRenamed("method", "baseline"), [*at, "baseline"])
    kept = stored.select(*at, "baseline", F.col("maxerr").alias("stored_max"), F.col("maxerr_mean").alias("stored_mean"))
    own = methods.select(*at, "method", F.col("maxerr").alias("det"))
    cells = own.join(seeds.join(kept, [*at, "baseline"]), at)
    statistics = ("seed_median", "seed_p95", "seed_max", "seed_mean")
    units = cells.groupBy(unit, "subset", "method", "baseline").agg(*[F.avg(c).alias(c) for c in ("det", *statistics, "stored_max", "stored_mean")])
    change = lambda reference, value: stats.relative_change(F.col(reference), F.col(value))
    below = lambda c: F.avg((F.round(F.col("det") - F.col(c), stats.NOISE_DIGITS) < 0).cast("double"))
    table = units.groupBy("subset", "method", "baseline").agg(
        F.count(F.lit(1)).alias("units"), *[F.avg(c).alias(f"{c}_mean") for c in ("det", *statistics, "stored_max", "stored_mean")],
        *[F.median(c).alias(f"{c}_median") for c in ("det", "seed_median", "seed_p95", "seed_max")],
        *[below(c).alias(f"below_{c}") for c in ("seed_median", "seed_p95")])
    changes = {"change_vs_median": ("seed_median_mean", "det_mean"), "change_vs_p95": ("seed_p95_mean", "det_mean"), "change_vs_max": ("seed_max_mean", "det_mean"),
               "change_vs_stored": ("stored_max_mean", "det_mean"), "median_change_vs_median": ("seed_median_median", "det_median"),
               "median_change_vs_p95": ("seed_p95_median", "det_median")}
    return table.select("*", *[change(*pair).alias(name) for name, pair in changes.items()])


def run_group_seed_report(method_splits: DataFrame, draws: DataFrame) -> DataFrame:
    """Run groups: per (group, window) the seed statistic of the mean and of the largest split MaxErr, pooled over cells."""
    shape = lambda df, extra: (df.groupBy("reruns", "window", "subset", *extra).agg(F.avg("maxerr").alias("split_mean"), F.max("maxerr").alias("split_max")))
    long = lambda df: df.withColumn("_a", F.explode(F.array(F.struct(F.lit("split_mean").alias("aggregate"), F.col("split_mean").alias("value")),
                                                            F.struct(F.lit("split_max").alias("aggregate"), F.col("split_max").alias("value"))))).select("*", "_a.aggregate", "_a.value").drop("_a")
    seeds = seed_statistics(long(shape(draws.withColumnRenamed("method", "baseline"), ["baseline", "draw"])), ["reruns", "window", "subset", "baseline", "aggregate"], "value")
    own = long(shape(method_splits, ["method"])).select("reruns", "window", "subset", "method", "aggregate", F.col("value").alias("det"))
    cells = own.join(seeds, ["reruns", "window", "subset", "aggregate"])
    pooled = cells.groupBy("subset", "method", "baseline", "aggregate").agg(F.count(F.lit(1)).alias("cells"), *[F.avg(c).alias(c) for c in ("det", "seed_median", "seed_p95", "seed_max", "seed_mean")])
    for name in ("seed_median", "seed_p95", "seed_max"):
        pooled = pooled.withColumn(f"change_vs_{name}", stats.relative_change(F.col(name), F.col("det")))
    return pooled


def stream_check(first: DataFrame, second: DataFrame, keys=("window", "subset", "method")) -> DataFrame:
    """Two independent draw streams: mean over units of the largest MaxErr in each, and their relative difference."""
    unit = [*keys, "population"]
    top = lambda df, name: df.groupBy(*unit).agg(F.max("maxerr").alias("_m")).groupBy(*keys).agg(F.avg("_m").alias(name))
    return (top(first, "first_max").join(top(second, "second_max"), list(keys))
            .withColumn("rel_diff_pct", F.abs(F.col("first_max") - F.col("second_max")) / F.greatest(F.col("second_max"), F.lit(1e-9)) * 100))
