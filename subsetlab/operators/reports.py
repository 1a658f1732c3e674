"""Report tables over the ranked and compared results."""
from pyspark.sql import Column, DataFrame, functions as F

from . import rankings, stats


def error_table(table: DataFrame, pivot: str, values, group=("subset", "method"), value: str = "rmse") -> DataFrame:
    """Median and 95th percentile of an error per (subset, method), one pair of columns per pivot value."""
    return table.groupBy(*group).pivot(pivot, list(values)).agg(F.median(value).alias("median"), F.percentile(value, 0.95).alias("p95"))


def paired_table(first: DataFrame, second: DataFrame, keys, unit: str, tie: str) -> DataFrame:
    """First against second on the units both have: means, change, p, paired delta (positive: first is better), win / tie / loss, Holm.

    ``first`` and ``second``: keys, unit, method, value.
    """
    a = first.select(*keys, unit, F.col("method").alias("first"), F.col("value").alias("_a"))
    b = second.select(*keys, unit, F.col("method").alias("second"), F.col("value").alias("_b"))
    pairs = a.join(b, [*keys, unit]).where(F.col("first") != F.col("second")).withColumn("_d", F.round(F.col("_b") - F.col("_a"), stats.NOISE_DIGITS))
    cell = [*keys, "first", "second"]
    count = lambda c: F.sum(c.cast("long"))
    rows = pairs.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("units"), F.avg("_a").alias("first_mean"), F.avg("_b").alias("second_mean"), F.median("_a").alias("first_median"), F.median("_b").alias("second_median"),
        count(F.col("_d") > 0).alias("wins"), count(F.col("_d") == 0).alias("ties"), count(F.col("_d") < 0).alias("losses"), F.avg(F.signum("_d")).alias("delta"))
    tests = stats.signed_rank(pairs, cell, "_d").select(*cell, "p_value")
    joined = rows.join(tests, cell).withColumn("change_pct", stats.relative_change(F.col("second_mean"), F.col("first_mean"))).withColumn("effect", stats.effect_letter(F.col("delta")))
    return stats.holm(joined, list(keys), tie=tie)


def lower_of(first: Column, second: Column, first_name: str, second_name: str) -> Column:
    """Name of the smaller value, ``tie`` when equal at four decimals."""
    return F.when(F.round(first, 4) == F.round(second, 4), "tie").when(first < second, first_name).otherwise(second_name)


def variant_table(table: DataFrame, first_suffix: str, second_suffix: str) -> DataFrame:
    """Two variants of every algorithm side by side (methods that differ in their suffix only)."""
    means = table.groupBy("subset", "method").agg(F.avg("rmse").alias("mean"), F.median("rmse").alias("median"))
    side = lambda suffix, name: (means.where(F.endswith("method", F.lit(suffix))).select("subset", F.regexp_replace("method", suffix + "$", "").alias("algorithm"),
                                                                                         F.col("mean").alias(f"{name}_mean"), F.col("median").alias(f"{name}_median")))
    joined = side(first_suffix, "first").join(side(second_suffix, "second"), ["subset", "algorithm"])
    return joined.withColumn("lower", lower_of(F.col("first_mean"), F.col("second_mean"), "first", "second"))


def best_of_family(table: DataFrame) -> DataFrame:
    """Method with the lowest median RMSE per (subset, family)."""
    medians = table.groupBy("subset", "method").agg(F.round(F.median("rmse"), 12).alias("median")).withColumn("family", rankings.family_of(F.col("method")))
    return medians.groupBy("subset", "family").agg(F.min_by("method", F.struct("median", "method")).alias("method"), F.min("median").alias("median"))


def ablation_table(table: DataFrame, reference: str, unit: str = "population") -> DataFrame:
    """Full method against the best configuration of every other family."""
    best = best_of_family(table).where(~F.col("family").isin("baselines", reference.split(":")[0])).select("subset", "method")
    values = table.select("subset", unit, "method", F.col("rmse").alias("value"))
    return paired_table(values.where(F.col("method") == reference), values.join(best, ["subset", "method"], "left_semi"), ["subset"], unit, "second")


def configuration_counts(table: DataFrame) -> DataFrame:
    """Stored configurations per group, the control counted apart."""
    local = rankings.local_name(F.col("method"))
    family = rankings.family_of(F.col("method"))
    group = (F.when((family == "baselines") & (local == "random"), "uniform random").when((family == "baselines") & (local == "stability_stratified"), "control")
             .when(family == "baselines", "stratified sampling").otherwise(family))
    return table.select("method", group.alias("group")).distinct().groupBy("group").agg(F.count(F.lit(1)).alias("configurations"))


def control_comparison(table: DataFrame, control: str, other: str, unit: str = "population", min_window: int = 1) -> DataFrame:
    """Control against random draws in the same strata: values averaged over windows, paired table plus the unpaired delta."""
    used = table.where((F.col("window") >= min_window) & F.col("method").isin(control, other)).groupBy("subset", unit, "method").agg(F.avg("rmse").alias("value"))
    paired = paired_table(used.where(F.col("method") == control), used.where(F.col("method") == other), ["subset"], unit, "second")
    samples = used.withColumn("sample", F.when(F.col("method") == control, 1).otherwise(2))
    return paired.join(stats.unpaired_delta(samples, ["subset"], "sample", "value").withColumnRenamed("delta", "unpaired_delta"), "subset")


def cost_table(profile: DataFrame) -> DataFrame:
    """Tokens in millions, steps and input/output ratio per run; the last row is the aggregate with the mean of the runs' step means."""
    runs = profile.where(F.col("scope") != "all")
    steps = runs.agg(F.avg("mean_steps").alias("_steps")).withColumn("_one", F.lit(1))
    joined = profile.withColumn("_one", F.lit(1)).join(F.broadcast(steps), "_one")
    return joined.select("scope", F.round(F.col("total_tokens") / 1e6, 4).alias("total_millions"), F.round(F.col("mean") / 1e6, 6).alias("mean_millions"),
                         F.round(F.when(F.col("scope") == "all", F.col("_steps")).otherwise(F.col("mean_steps")), 1).alias("steps"), "input_output_ratio")


def widest_range(summary: DataFrame) -> DataFrame:
    """Middle 95 % of the random subsets' cost share, from the run with the widest spread, per subset."""
    spread = F.round(F.col("share_high") - F.col("share_low"), 6)
    return (summary.groupBy("subset").agg(F.max_by(F.struct("share_low", "share_high"), F.struct(spread, -F.col("run"))).alias("_r"))
            .select("subset", "_r.share_low", "_r.share_high"))


def rate_ranges(summary: DataFrame) -> DataFrame:
    """Lowest and highest resolve rate of the runs of each group, and their difference."""
    return summary.select("reruns", "runs", F.round("pct_min", 1).alias("lowest"), F.round("pct_max", 1).alias("highest"), F.round(F.col("pct_max") - F.col("pct_min"), 1).alias("difference"))


def window_units(splits: DataFrame) -> DataFrame:
    """Run groups: the units are windows, each method's value is its mean over the splits of the window."""
    return splits.groupBy("subset", "window", "method").agg(F.avg("rmse").alias("value"), F.avg("maxerr").alias("maxerr"))


def as_number(cell: Column) -> Column:
    """Number in a printed cell (minus sign, thousands separators, % and ×), null otherwise."""
    text = F.regexp_replace(F.regexp_replace(F.replace(cell, F.lit("−"), F.lit("-")), ",", ""), "[%×]+$", "")
    return F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), text.cast("double"))


def last_digit(cell: Column) -> Column:
    """One unit in the last printed digit."""
    text = F.regexp_replace(cell, "[%×]+$", "")
    decimals = F.when(F.contains(text, F.lit(".")), F.length(text) - F.instr(text, ".")).otherwise(0)
    return F.pow(F.lit(10.0), -decimals)


def compare_tables(generated: DataFrame, printed: DataFrame, keys=("row", "column")) -> DataFrame:
    """Cell by cell: equal, differs in the last printed digit only, differs, or on one side only; counts and largest gap per class."""
    joined = generated.select(*keys, F.col("cell").alias("_g")).join(printed.select(*keys, F.col("cell").alias("_p")), list(keys), "full")
    gap = F.abs(as_number(F.col("_g")) - as_number(F.col("_p")))
    state = (F.when(F.col("_p").isNull(), "extra").when(F.col("_g").isNull(), "missing").when(F.col("_g") == F.col("_p"), "equal")
             .when(gap <= 1.5 * last_digit(F.col("_p")), "last digit").otherwise("differs"))
    return joined.withColumn("state", state).withColumn("_gap", gap).groupBy("state").agg(F.count(F.lit(1)).alias("cells"), F.round(F.max("_gap"), 6).alias("largest_gap"))
