"""Token cost of conversations and of benchmark subsets."""
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.ranking import group_quantiles

CHARACTERS_PER_TOKEN = 4
SUBSET_PERCENTAGES = (5, 10, 20, 30)


def token_count(text: Column) -> Column:
    """Approximate tokens of a text: characters / 4 rounded half to even, at least one for a non-empty text."""
    length = F.length(F.coalesce(text, F.lit("")))
    return F.when(length == 0, 0).otherwise(F.greatest(F.lit(1), F.bround(length / CHARACTERS_PER_TOKEN).cast("int"))).cast("long")


def message_tokens(messages: DataFrame) -> DataFrame:
    """Tokens per message: its text plus the name and the arguments of each of its tool calls (when the table has them)."""
    own = token_count(F.col("text"))
    if "tool_calls" in messages.columns:
        calls = F.aggregate(F.coalesce("tool_calls", F.array().cast(messages.schema["tool_calls"].dataType)), F.lit(0).cast("long"),
                            lambda acc, c: acc + token_count(c["function"]["name"]) + token_count(c["function"]["arguments"]))
        own = own + calls
    return messages.withColumn("tokens", own)


def trajectory_costs(messages: DataFrame, keys=("run", "instance"), observation_cap=None) -> DataFrame:
    """Flat and triangular cost per conversation.

    Every assistant turn pays for the context before it. The context is a running sum per conversation, which Spark streams over the
    sorted turns. With ``observation_cap``, tool messages enter the context with at most so many tokens and ``cut_tokens`` counts the rest.
    """
    counted = message_tokens(messages)
    cut = F.lit(0).cast("long")
    if observation_cap is not None:
        cut = F.when(F.col("role") == "tool", F.greatest(F.col("tokens") - observation_cap, F.lit(0).cast("long"))).otherwise(cut)
    context = F.col("tokens") - cut
    before = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("_context", F.coalesce(F.sum(context).over(before), F.lit(0)))
    spoken = F.col("role") == "assistant"
    costs = (placed.withColumn("_cut", cut).groupBy(*keys)
            .agg(F.sum("_cut").alias("cut_tokens"), F.sum(spoken.cast("long")).alias("num_steps"), F.sum("tokens").alias("flat_tokens"),
                 F.sum(F.when(spoken, F.col("_context")).otherwise(0)).alias("input_tokens"),
                 F.sum(F.when(spoken, F.col("tokens")).otherwise(0)).alias("output_tokens"))
            .withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens")))
    return costs if observation_cap is not None else costs.drop("cut_tokens")


def cost_summary(costs: DataFrame) -> DataFrame:
    """Totals, means and range per run and over all runs (run is null)."""
    return costs.rollup("run").agg(
        F.count(F.lit(1)).alias("trajectories"), F.sum("flat_tokens").alias("flat_tokens"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("total_tokens").alias("total_tokens"),
        F.round(F.avg("flat_tokens"), 1).alias("mean_flat"), F.round(F.avg("total_tokens"), 1).alias("mean_total"),
        F.min("total_tokens").alias("min_total"), F.max("total_tokens").alias("max_total"))


def cost_profile(costs: DataFrame) -> DataFrame:
    """Cost profile per run and over all runs: totals, input/output ratio, spread and exact quantiles of the total cost."""
    both = costs.withColumn("scope", F.explode(F.array(F.col("run").cast("string"), F.lit("all"))))
    basics = both.groupBy("scope").agg(
        F.count(F.lit(1)).alias("instances"), F.sum("total_tokens").alias("total_tokens"), F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"), F.sum("flat_tokens").alias("flat_tokens"),
        F.avg("total_tokens").alias("mean"), F.stddev_pop("total_tokens").alias("std"), F.min("total_tokens").alias("min"),
        F.max("total_tokens").alias("max"), F.avg("num_steps").alias("mean_steps"))
    spread = group_quantiles(both, ["scope"], "total_tokens", (0.05, 0.25, 0.5, 0.75, 0.95))
    ratio = F.when(F.col("output_tokens") > 0, F.round(F.col("input_tokens") / F.col("output_tokens"), 1)).otherwise(F.lit(0.0))
    return (basics.join(spread, "scope")
            .withColumn("input_output_ratio", ratio)
            .withColumn("input_share_pct", F.when(F.col("total_tokens") > 0, F.round(F.col("input_tokens") / F.col("total_tokens") * 100, 1)))
            .withColumn("max_to_min", F.when(F.col("min") > 0, F.round(F.col("max") / F.col("min"), 1))))


def draw_shares(drawn: DataFrame, totals: DataFrame) -> DataFrame:
    """Cost share (%) of every drawn subset: drawn costs summed per (run, subset, draw) over the run's total."""
    picked = drawn.groupBy("run", "subset", "draw").agg(F.sum("total_tokens").alias("_picked"), F.count(F.lit(1)).alias("size"))
    return (picked.join(totals.select("run", F.col("total_tokens").alias("_all")), "run")
            .withColumn("share", F.when(F.col("_all") > 0, F.col("_picked") / F.col("_all") * 100).otherwise(F.lit(0.0)))
            .drop("_picked"))


def share_summary(shares: DataFrame) -> DataFrame:
    """Mean, spread and middle 95 % of the cost shares per run and subset, and the same for the saving (100 - share)."""
    edges = F.percentile("share", [0.025, 0.975])   # a group holds one value per draw, and the number of draws is a parameter
    basics = shares.groupBy("run", "subset").agg(F.max("size").alias("subset_size"), F.avg("share").alias("mean_share"),
                                                 F.stddev_pop("share").alias("std_share"), F.max("_all").alias("run_tokens"), edges.alias("_edges"))
    return (basics.withColumn("q2_5", F.get("_edges", F.lit(0))).withColumn("q97_5", F.get("_edges", F.lit(1)))
            .select("run", "subset", "subset_size", "run_tokens", F.round("mean_share", 2).alias("mean_share"), F.round("std_share", 2).alias("std_share"),
                    F.round("q2_5", 2).alias("share_low"), F.round("q97_5", 2).alias("share_high"),
                    F.round(100 - F.col("mean_share"), 2).alias("mean_saving"), F.round(100 - F.col("q97_5"), 2).alias("saving_low"),
                    F.round(100 - F.col("q2_5"), 2).alias("saving_high"), F.round(F.col("run_tokens") * (100 - F.col("mean_share")) / 100).alias("mean_saved_tokens")))


def weighted_shares(summary: DataFrame) -> DataFrame:
    """Cost share and saving per subset over all runs, weighted with the run's total cost."""
    weight = F.sum("run_tokens")
    return (summary.groupBy("subset")
            .agg((F.sum(F.col("run_tokens") * F.col("mean_share")) / weight).alias("_share"),
                 (F.sum(F.col("run_tokens") * F.col("mean_saving")) / weight).alias("_saving"), weight.alias("full_tokens"))
            .select("subset", F.round("_share", 2).alias("weighted_share"), F.round("_saving", 2).alias("weighted_saving"), "full_tokens",
                    F.round(F.col("full_tokens") * F.col("_share") / 100).alias("subset_tokens"),
                    F.round(F.col("full_tokens") * F.col("_saving") / 100).alias("saved_tokens")))


def saving_records(selected: DataFrame, members: DataFrame, costs: DataFrame) -> DataFrame:
    """One record per (population, window, split, test run): cost of the population and of the subset, and the saving.

    The population side is aggregated per (population, run) once and not per split.
    """
    cost = costs.select("run", "instance", F.col("total_tokens").alias("_cost"))
    runs = costs.select("run").distinct()
    observed = (members.select("population", "level", "instance").join(cost, "instance")
                .groupBy("population", "level", "run").agg(F.sum("_cost").alias("full_cost"), F.count(F.lit(1)).alias("_found")))
    sizes = members.groupBy("population").agg(F.count(F.lit(1)).alias("population_size"))
    chosen = selected.withColumn("run", F.explode("test"))
    per_run = (chosen.join(cost, ["run", "instance"], "left")
               .groupBy("population", "window", "split", "run")
               .agg(F.coalesce(F.sum("_cost"), F.lit(0)).alias("subset_cost"), F.count(F.lit(1)).alias("subset_size"),
                    F.sum(F.col("_cost").isNull().cast("long")).alias("missing_subset")))
    joined = per_run.join(sizes, "population").join(observed, ["population", "run"], "left").join(runs, "run", "left_semi")
    saved = F.col("full_cost") - F.col("subset_cost")
    return (joined.withColumn("full_cost", F.coalesce("full_cost", F.lit(0)))
            .withColumn("missing_full", F.col("population_size") - F.coalesce("_found", F.lit(0)))
            .withColumn("saved", saved)
            .withColumn("saved_pct", F.when(F.col("full_cost") > 0, F.round(saved / F.col("full_cost") * 100, 2)).otherwise(F.lit(0.0)))
            .drop("_found"))


def saving_summary(records: DataFrame, keys=()) -> DataFrame:
    """Statistics of the per-record saving and the token-weighted saving; by the given keys or overall."""
    full, saved = F.sum("full_cost"), F.sum("saved")
    # The saving is rounded to two digits, so the exact median counts at most 10,001 distinct values per group.
    return records.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("records"), F.round(F.median("saved_pct"), 2).alias("median_saved_pct"), F.round(F.avg("saved_pct"), 2).alias("mean_saved_pct"), F.min("saved_pct").alias("min_saved_pct"),
        F.max("saved_pct").alias("max_saved_pct"), F.round(F.stddev_pop("saved_pct"), 2).alias("std_saved_pct"), full.alias("full_tokens"),
        F.sum("subset_cost").alias("subset_tokens"), saved.alias("saved_tokens"),
        F.when(full > 0, F.round(saved / full * 100, 2)).otherwise(F.lit(0.0)).alias("aggregate_saved_pct"))


def saving_means(records: DataFrame) -> DataFrame:
    """Mean saving and record count overall, per test run and per level, in one pass of grouping sets."""
    return (records.withColumn("_key", F.explode(F.array(
        F.struct(F.lit("overall").alias("by"), F.lit("").alias("value")), F.struct(F.lit("run").alias("by"), F.col("run").cast("string").alias("value")),
        F.struct(F.lit("level").alias("by"), F.col("level").cast("string").alias("value")))))
        .groupBy("_key.by", "_key.value").agg(F.round(F.avg("saved_pct"), 2).alias("mean_saved_pct"), F.count(F.lit(1)).alias("records")))


def content_fingerprint(members: DataFrame, keys=("population",)) -> DataFrame:
    """Order-free fingerprint of each member set: count, sum and xor of a 32-bit md5 prefix (combines on the map side)."""
    code = F.conv(F.substring(F.md5(F.col("instance").cast("string")), 1, 8), 16, 10).cast("long")
    return members.withColumn("_code", code).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("members"), F.sum("_code").alias("code_sum"), F.bit_xor("_code").alias("code_xor"))


def changed_populations(recorded: DataFrame, current: DataFrame, keys=("population",)) -> DataFrame:
    """Populations whose members differ from the recorded ones, or that exist on one side only."""
    left = content_fingerprint(recorded, keys).select(*keys, F.struct("members", "code_sum", "code_xor").alias("_recorded"))
    right = content_fingerprint(current, keys).select(*keys, F.struct("members", "code_sum", "code_xor").alias("_current"))
    return (left.join(right, list(keys), "full")
            .where(~F.col("_recorded").eqNullSafe(F.col("_current")))
            .select(*keys, F.when(F.col("_recorded").isNull(), "added").when(F.col("_current").isNull(), "removed").otherwise("changed").alias("difference")))
