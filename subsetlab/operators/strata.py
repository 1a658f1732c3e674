"""Strata (groups of instances) and the number of subset slots each stratum gets."""
from pyspark.sql import Column, DataFrame, Window, functions as F

# Method names of the random baselines.
RANDOM = "random"
ONE_RUN_BASELINES = ("random", "repo_stratified", "difficulty_stratified", "repo_difficulty_stratified")
TWO_RUN_BASELINES = ("consistency_stratified", "repo_consistency_stratified")
CONTROL = "stability_stratified"


def pass_count(outcomes: Column, train: Column) -> Column:
    """How many training runs the instance passed."""
    return F.aggregate(train, F.lit(0), lambda acc, r: acc + F.get(outcomes, r))


def difficulty(count: Column, window: Column) -> Column:
    """1 when at least half of the training runs (rounded up) passed, else 0."""
    return F.when(count >= F.ceil(window / 2), 1).otherwise(0)


def outcome_stratum(count: Column, window: Column) -> Column:
    """Stratum of the geometric methods: difficulty with one training run, exact pass count otherwise."""
    return F.when(window == 1, difficulty(count, window)).otherwise(count).cast("string")


def outcome_variance(count: Column, window: Column) -> Column:
    """Population variance of the 0/1 training outcomes."""
    share = count / window
    return share * (1 - share)


def label_instances(instances: DataFrame) -> DataFrame:
    """Add pass count, difficulty and outcome variance to rows of (outcomes, window, train)."""
    counted = instances.withColumn("passes", pass_count(F.col("outcomes"), F.col("train")))
    return (counted.withColumn("difficulty", difficulty(F.col("passes"), F.col("window")))
            .withColumn("variance", outcome_variance(F.col("passes"), F.col("window"))))


def baseline_strata(labelled: DataFrame, baselines=ONE_RUN_BASELINES + TWO_RUN_BASELINES, tags=("", "")) -> DataFrame:
    """One row per (instance, baseline) with its stratum key; the two-run baselines only exist from window 2 on.

    ``tags`` are put before the label in crossed keys (run groups spell them ``<repository>_d1`` and ``<repository>_c2``).
    """
    label = {"difficulty": F.col("difficulty").cast("string"), "passes": F.col("passes").cast("string")}
    crossed = lambda tag, name: F.concat(F.col("repository"), F.lit("_" + tag), label[name])
    keys = {"random": F.lit(""), "repo_stratified": F.col("repository"), "difficulty_stratified": label["difficulty"],
            "repo_difficulty_stratified": crossed(tags[0], "difficulty"), "consistency_stratified": label["passes"],
            "repo_consistency_stratified": crossed(tags[1], "passes"), "stability_stratified": label["difficulty"]}
    entries = F.array(*[F.struct(F.lit(name).alias("method"), keys[name].alias("stratum")) for name in baselines])
    return (labelled.withColumn("_entry", F.explode(entries))
            .select("*", "_entry.method", "_entry.stratum").drop("_entry")
            .where((F.col("window") >= 2) | ~F.col("method").isin(*TWO_RUN_BASELINES)))


def subset_size(n: Column, fraction: Column) -> Column:
    """Slots of a subset: the fraction of the population rounded down, at least one."""
    return F.greatest(F.lit(1), F.floor(n * fraction).cast("int"))


def explode_fractions(df: DataFrame, fractions) -> DataFrame:
    """Repeat every row per subset fraction; ``subset`` is its key, e.g. ``10pct``."""
    entries = F.array(*[F.struct(F.lit(f"{int(f * 100)}pct").alias("subset"), F.lit(float(f)).alias("fraction")) for f in fractions])
    return df.withColumn("_f", F.explode(entries)).select(*df.columns, "_f.subset", "_f.fraction")


def proportional_quotas(sizes: DataFrame, keys, slots: str = "slots") -> DataFrame:
    """Largest-remainder allocation of ``slots`` over strata.

    ``sizes`` has one row per (keys, stratum) with ``members``; windows run over strata, never over instances. Leftover slots go
    to the largest fractional parts, equal fractions in the string order of the stratum.
    """
    group = Window.partitionBy(*keys)
    share = F.col(slots) * F.col("members") / F.col("_total")
    based = (sizes.withColumn("_total", F.sum("members").over(group))
             .withColumn("_share", share)
             .withColumn("_base", F.least(F.floor("_share"), F.col("members")))
             .withColumn("_left", F.col(slots) - F.sum("_base").over(group))
             .withColumn("_open", F.when(F.col("members") > F.col("_base"), 1).otherwise(0)))
    order = group.orderBy(F.desc("_open"), F.desc(F.col("_share") - F.floor("_share")), F.asc("stratum"))
    extra = F.when((F.col("_open") == 1) & (F.row_number().over(order) <= F.col("_left")), 1).otherwise(0)
    return (based.withColumn("quota", (F.col("_base") + extra).cast("int"))
            .drop("_total", "_share", "_base", "_left", "_open"))


def stratum_quotas(members: DataFrame, keys, fractions) -> DataFrame:
    """Quota per (keys, stratum, subset) from one row per member; sizes are counted with partial aggregation."""
    sizes = members.groupBy(*keys, "stratum").agg(F.count(F.lit(1)).alias("members"))
    whole = Window.partitionBy(*keys)
    sized = explode_fractions(sizes.withColumn("population_size", F.sum("members").over(whole)), fractions)
    slotted = sized.withColumn("slots", subset_size(F.col("population_size"), F.col("fraction")))
    return proportional_quotas(slotted, [*keys, "subset"]).drop("fraction")
