"""Paired statistics as grouped aggregates: describe, signed-rank test, effect sizes, Holm and Fisher."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import tails
from ..functions.ranking import ordered

NOISE_DIGITS = 12       # differences are rounded here, so that summation order cannot break ties or zeros
EXACT_LIMIT = 50
TIE_TOLERANCE = 0.01    # relative, for win / tie / loss
SHARES = (0.05, 0.25, 0.5, 0.75, 0.95)


def describe(df: DataFrame, keys, value: str) -> DataFrame:
    """Mean, median, sample sd, IQR, quantiles, range and count per group."""
    keys = list(keys)
    spread = F.when(F.count(value) > 1, F.stddev_samp(value)).otherwise(F.lit(0.0))
    basics = [F.avg(value).alias("mean"), spread.alias("std"), F.min(value).alias("min"), F.max(value).alias("max"), F.count(value).alias("n")]
    table = df.groupBy(*keys).agg(*basics, F.percentile(value, list(SHARES)).alias("_q"))
    for i, share in enumerate(SHARES):
        table = table.withColumn(f"p{share * 100:g}", F.get("_q", F.lit(i)))
    table = table.drop("_q")
    return table.withColumnRenamed("p50", "median").withColumn("iqr", F.col("p75") - F.col("p25"))


def signed_rank(df: DataFrame, keys, difference: str, one_sided: bool = False, min_nonzero: int = 1) -> DataFrame:
    """Wilcoxon signed-rank test per group: rank sums, zero and tie counts, z and p.

    Ranks come from counts of distinct absolute differences (partial aggregation), so the window runs over distinct values. p is
    exact for at most 50 differences without zeros and ties, else normal with tie correction; 1 when nothing differs.
    """
    keys = list(keys)
    d = F.round(F.col(difference), NOISE_DIGITS)
    rows = df.where(F.col(difference).isNotNull()).withColumn("_d", d)
    counts = (rows.where(F.col("_d") != 0).groupBy(*keys, F.abs("_d").alias("_a"))
              .agg(F.count(F.lit(1)).alias("_n"), F.sum((F.col("_d") > 0).cast("long")).alias("_pos")))
    before = Window.partitionBy(*keys).orderBy("_a").rowsBetween(Window.unboundedPreceding, -1)
    ranked = counts.withColumn("_rank", F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2)
    sums = ranked.groupBy(*keys).agg(F.sum("_n").alias("nonzero"), F.sum(F.col("_pos") * F.col("_rank")).alias("w_plus"),
                                     F.sum((F.col("_n") - F.col("_pos")) * F.col("_rank")).alias("w_minus"),
                                     F.sum(F.col("_n") * F.col("_n") * F.col("_n") - F.col("_n")).alias("tie_term"))
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    table = sizes.join(sums, keys, "left") if keys else sizes.withColumn("_k", F.lit(1)).join(sums.withColumn("_k", F.lit(1)), "_k", "left").drop("_k")
    m = F.col("nonzero").cast("double")
    z = (F.col("w_plus") - m * (m + 1) / 4) / F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - F.col("tie_term") / 48)
    table = table.fillna({"nonzero": 0, "w_plus": 0.0, "w_minus": 0.0, "tie_term": 0}).withColumn("z", F.when(F.col("nonzero") > 0, z))
    exact_ok = (F.col("n") <= EXACT_LIMIT) & (F.col("nonzero") == F.col("n")) & (F.col("tie_term") == 0)
    exact_n = F.when(exact_ok, F.col("nonzero").cast("double"))
    exact = tails.exact_upper(F.col("w_plus"), exact_n) if one_sided else tails.exact_two_sided(F.col("w_plus"), exact_n)
    normal = tails.normal_upper(F.col("z")) if one_sided else tails.normal_two_sided(F.col("z"))
    return table.withColumn("p_value", F.when(F.col("nonzero") < min_nonzero, 1.0).otherwise(F.coalesce(exact, normal, F.lit(1.0))))


def delta_magnitude(delta: Column) -> Column:
    """Magnitude of Cliff's delta."""
    size = F.abs(delta)
    return F.when(size < 0.147, "negligible").when(size < 0.33, "small").when(size < 0.474, "medium").otherwise("large")


def effect_letter(delta: Column) -> Column:
    """Magnitude letter: N, S, M or L."""
    return F.upper(F.substring(delta_magnitude(delta), 1, 1))


def paired_delta(x: Column, y: Column) -> Column:
    """Aggregate: share of pairs with x > y minus share with x < y."""
    return F.avg(F.signum(F.round(x - y, NOISE_DIGITS)))


def superiority(x: Column, y: Column) -> Column:
    """Aggregate: P(x < y) + half of P(x = y)."""
    d = F.round(x - y, NOISE_DIGITS)
    return F.avg(F.when(d < 0, 1.0).when(d == 0, 0.5).otherwise(0.0))


def superiority_magnitude(ps: Column) -> Column:
    """Magnitude of the probability of superiority."""
    away = F.abs(ps - 0.5)
    return F.when(away < 0.06, "negligible").when(away < 0.14, "small").when(away < 0.21, "medium").otherwise("large")


def unpaired_delta(df: DataFrame, keys, sample: str, value: str) -> DataFrame:
    """Cliff's delta over all pairs of two samples (``sample`` is 1 or 2), in rank-sum form: no pair is ever built.

    Positive when the first sample has the lower values.
    """
    keys = list(keys)
    counts = df.withColumn("_v", F.round(value, NOISE_DIGITS)).groupBy(*keys, "_v").agg(
        F.sum((F.col(sample) == 1).cast("long")).alias("_n1"), F.sum((F.col(sample) == 2).cast("long")).alias("_n2"))
    summed = ordered(counts, keys, [F.col("_v")], value="_n1", total="_upto")
    scored = summed.withColumn("_wins", F.col("_n2") * (F.col("_upto") - F.col("_n1") / 2))
    return (scored.groupBy(*keys).agg(F.sum("_wins").alias("_u"), F.sum("_n1").alias("_m"), F.sum("_n2").alias("_k"))
            .select(*keys, (2 * F.col("_u") / (F.col("_m") * F.col("_k")) - 1).alias("delta")))


def holm(df: DataFrame, keys, p: str = "p_value", tie: str = "method", name: str = "holm_p") -> DataFrame:
    """Holm step-down adjustment over the comparisons of each group (a handful of rows per group)."""
    ordered = Window.partitionBy(*keys).orderBy(p, tie)
    tests = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    stepped = df.withColumn("_step", F.col(p) * (tests - F.row_number().over(ordered) + 1))
    running = F.max("_step").over(ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return stepped.withColumn(name, F.least(running, F.lit(1.0))).drop("_step")


def fisher(df: DataFrame, keys, p: str = "p_value") -> DataFrame:
    """Fisher's combination of p-values: one p is passed through, none gives null."""
    statistic = -2.0 * F.sum(F.ln(F.greatest(F.col(p), F.lit(1e-300))))
    table = df.groupBy(*keys).agg(statistic.alias("statistic"), F.count(p).alias("combined"), F.first(p, ignorenulls=True).alias("_only"))
    return table.withColumn("combined_p", F.when(F.col("combined") >= 2, tails.chi_square_upper_even(F.col("statistic"), F.col("combined"))).otherwise(F.col("_only"))).drop("_only")


def relative_change(reference: Column, value: Column) -> Column:
    """Change in percent, null when the reference is not positive."""
    return F.when(reference > 0, (value - reference) / reference * 100.0)


def range_violations(df: DataFrame, keys, value: str, low: float, high: float) -> DataFrame:
    """Groups that hold values outside their scale, with the count and the range found."""
    bad = ~F.col(value).between(low, high)
    return (df.groupBy(*keys).agg(F.sum(bad.cast("long")).alias("outside"), F.min(value).alias("min"), F.max(value).alias("max"))
            .where(F.col("outside") > 0))


def checked_range(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    """The same rows; the job stops with an error at the first value outside the scale."""
    message = F.concat(F.lit(f"{value} outside [{low}, {high}]: "), F.col(value).cast("string"))
    return df.withColumn(value, F.when(F.col(value).between(low, high), F.col(value)).otherwise(F.raise_error(message)))


def spearman(df: DataFrame, keys, x: str, y: str, min_points: int = 3) -> DataFrame:
    """Spearman's rho per group from average ranks."""
    from .populations import average_ranks
    rounded = df.withColumn("_x", F.round(x, NOISE_DIGITS)).withColumn("_y", F.round(y, NOISE_DIGITS))
    ranked = average_ranks(average_ranks(rounded, list(keys), "_x", "_rx"), list(keys), "_y", "_ry")
    return ranked.groupBy(*keys).agg(F.when(F.count(F.lit(1)) >= min_points, F.corr("_rx", "_ry")).alias("rho"))


def win_tie_loss(x: Column, reference: Column, tolerance: float = TIE_TOLERANCE) -> Column:
    """win / tie / loss of x against a reference within a relative tolerance."""
    return F.when(x < reference - tolerance * reference, "win").when(x > reference + tolerance * reference, "loss").otherwise("tie")
