"""Populations (sub-benchmarks of a chosen difficulty), their validity on other runs, their overlap and churn."""
from pyspark.sql import DataFrame, Window, functions as F

from ..functions.ranking import bucketed_rank, hash_bucket, hash_key, rank_by_value
from ..session import cut_lineage

LEVELS = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)
POPULATION_SIZE = 250
N_POPULATIONS = 1000
MIN_POPULATION = 50
OVERLAP_LIMIT = 0.30


def population_plan(n_populations: int, levels=LEVELS):
    """Array column of the populations to draw: dense position, level in percent, index within the level, name."""
    each, extra = divmod(n_populations, len(levels))
    counts = [each + (1 if order < extra else 0) for order in range(len(levels))]
    starts = [sum(counts[:order]) for order in range(len(levels))]
    blocks = ", ".join(f"struct({int(level * 100)} AS level, {start} AS start, {count} AS count)"
                       for level, start, count in zip(levels, starts, counts) if count)
    return F.expr(f"flatten(transform(array({blocks}), b -> transform(sequence(0, b.count - 1), i -> "
                  "struct(b.start + i AS population, b.level AS level, concat('rate_', b.level, '_run_', i) AS name))))")


def draw_populations(source: DataFrame, n_populations=N_POPULATIONS, size=POPULATION_SIZE, levels=LEVELS, seed="populations") -> DataFrame:
    """Populations with a given share of solved instances, drawn without replacement from one run.

    ``source`` is (instance, passed). Per population floor(size * level) solved and the remaining unsolved instances are drawn by
    hash rank; when a class is too small, all of it is used and the population shrinks. Each row meets the populations through an
    explode of the fixed plan, and every (population, class) is ranked over hash buckets.
    """
    expanded = source.withColumn("_p", F.explode(population_plan(n_populations, levels))).select("instance", "passed", "_p.*")
    solved = F.floor(F.lit(size) * F.col("level") / 100).cast("int")
    keyed = (expanded.withColumn("_key", hash_key(seed, F.col("population"), F.col("instance")))
             .withColumn("quota", F.when(F.col("passed") == 1, solved).otherwise(F.lit(size) - solved)))
    ranked = bucketed_rank(keyed.withColumn("_bucket", hash_bucket(F.col("_key"))), ["population", "passed"], "_bucket",
                           [F.col("_key"), F.col("instance")], "_rank")
    chosen = ranked.where(F.col("_rank") <= F.col("quota"))
    place = Window.partitionBy("population").orderBy(hash_key(seed, F.lit("order"), F.col("population"), F.col("instance")), "instance")
    return chosen.select("population", "level", "name", "instance", "passed", (F.row_number().over(place) - 1).alias("member_pos"))


def population_rates(members: DataFrame) -> DataFrame:
    """Obtained size and resolve rate of every population on its source run."""
    return members.groupBy("population", "level", "name").agg(
        F.count(F.lit(1)).alias("members"), F.round(F.avg("passed"), 4).alias("resolve_rate"))


def scan_populations(stored: DataFrame, known: DataFrame, positions=None, min_members=MIN_POPULATION) -> DataFrame:
    """Stored populations (name, file_pos, instances array) → members with a dense position.

    Kept are populations with a level in their name and at least ``min_members`` known instances; positions are assigned over the
    kept ones in file order and before a subset of positions is taken, so seeds do not depend on the subset.
    """
    level = F.regexp_extract("name", r"rate_(\d+)_run", 1)
    members = (stored.where(level != "").withColumn("level", level.cast("int"))
               .select("name", "file_pos", "level", F.posexplode("instances").alias("member_pos", "instance"))
               .join(known.select("instance"), "instance", "left_semi"))
    sizes = members.groupBy("name", "file_pos", "level").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_members)
    numbered = rank_by_value(sizes, [], "file_pos", ["name"], name="_rank").select("name", (F.col("_rank") - 1).cast("int").alias("population"))
    joined = members.join(numbered, "name")
    return joined if positions is None else joined.where(F.col("population").isin(*positions))


def cross_run_rates(members: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Resolve rate of every population on every run, over the members the run contains, with the coverage."""
    sizes = members.groupBy("population", "level").agg(F.count(F.lit(1)).alias("total"))
    seen = (members.select("population", "instance").join(outcomes, "instance")
            .groupBy("population", "run").agg(F.count(F.lit(1)).alias("matched"), F.avg("passed").alias("rate")))
    runs = outcomes.select("run").distinct().agg(F.array_sort(F.collect_set("run")).alias("_runs"))
    frame = sizes.withColumn("_one", F.lit(1)).join(F.broadcast(runs.withColumn("_one", F.lit(1))), "_one").select("population", "level", "total", F.explode("_runs").alias("run"))
    return (frame.join(seen, ["population", "run"], "left")
            .select("population", "level", "run", "rate", F.coalesce("matched", F.lit(0)).alias("matched"), "total",
                    (F.coalesce("matched", F.lit(0)) / F.col("total")).alias("coverage")))


def pool_statistics(outcomes: DataFrame) -> DataFrame:
    """Instances, resolved instances and resolve rate per run."""
    return outcomes.groupBy("run").agg(F.count(F.lit(1)).alias("total"), F.sum("passed").alias("resolved"), F.avg("passed").alias("rate"))


def churn(members: DataFrame, outcomes: DataFrame, n_runs: int) -> DataFrame:
    """Outcome changes of every population between every pair of runs: by direction, gross, net and cancelled.

    The run pairs are exploded inside the row from the instance's short outcome array (missing runs are null), so instances are
    never joined with themselves.
    """
    cells = [F.max(F.when(F.col("run") == r, F.col("passed"))).cast("int") for r in range(n_runs)]
    wide = outcomes.groupBy("instance").agg(F.array(*cells).alias("_o"))
    pairs = F.array(*[F.struct(F.lit(a).alias("first"), F.lit(b).alias("second")) for a in range(n_runs) for b in range(a + 1, n_runs)])
    both = (members.select("population", "level", "instance").join(wide, "instance").withColumn("_pair", F.explode(pairs))
            .withColumn("_a", F.get("_o", F.col("_pair.first"))).withColumn("_b", F.get("_o", F.col("_pair.second")))
            .where(F.col("_a").isNotNull() & F.col("_b").isNotNull()))
    share = lambda a, b: F.avg(F.when((F.col("_a") == a) & (F.col("_b") == b), 1.0).otherwise(0.0))
    out = (both.groupBy("population", "level", F.col("_pair.first").alias("first"), F.col("_pair.second").alias("second"))
           .agg(F.count(F.lit(1)).alias("n"), share(1, 0).alias("pass_to_fail"), share(0, 1).alias("fail_to_pass"),
                F.abs(F.avg("_a") - F.avg("_b")).alias("net")))
    return out.withColumn("gross", F.col("pass_to_fail") + F.col("fail_to_pass")).withColumn("cancelled", F.col("gross") - F.col("net"))


def shared_members(members: DataFrame) -> DataFrame:
    """Number of shared instances of every pair of populations that share at least one.

    An instance's populations are gathered into one short array (at most one entry per population, and the number of populations
    is fixed by the study design) and pairs are counted with partial aggregation.
    """
    lists = members.groupBy("instance").agg(F.array_sort(F.collect_set("population")).alias("_in"))
    first = lists.select(F.posexplode("_in").alias("_at", "first"), "_in")
    pairs = first.select("first", F.explode(F.slice("_in", F.col("_at") + 2, F.size("_in"))).alias("second"))
    return pairs.groupBy("first", "second").agg(F.count(F.lit(1)).alias("shared"))


def pairwise_jaccard(members: DataFrame) -> DataFrame:
    """Jaccard similarity of every pair of populations with a shared instance (all other pairs are zero)."""
    sizes = members.groupBy("population", "level").agg(F.count(F.lit(1)).alias("n"))
    a = sizes.select(F.col("population").alias("first"), F.col("level").alias("first_level"), F.col("n").alias("_n1"))
    b = sizes.select(F.col("population").alias("second"), F.col("level").alias("second_level"), F.col("n").alias("_n2"))
    return (shared_members(members).join(a, "first").join(b, "second")
            .select("first", "second", "first_level", "second_level", "shared",
                    (F.col("shared") / (F.col("_n1") + F.col("_n2") - F.col("shared"))).alias("jaccard")))


def mean_jaccard(members: DataFrame) -> DataFrame:
    """Mean similarity over all distinct pairs, overall (level is null) and within each level; pairs without overlap count as zero."""
    sizes = members.select("population", "level").distinct()
    pairs = pairwise_jaccard(members)
    n = sizes.rollup("level").agg(F.count(F.lit(1)).alias("_n"))
    n = n.withColumn("pairs", (F.col("_n") * (F.col("_n") - 1) / 2).cast("long"))
    total = (pairs.agg(F.sum("jaccard").alias("_sum")).withColumn("level", F.lit(None).cast("int"))
             .unionByName(pairs.where(F.col("first_level") == F.col("second_level")).groupBy(F.col("first_level").alias("level"))
                          .agg(F.sum("jaccard").alias("_sum"))))
    return (n.join(total, n["level"].eqNullSafe(total["level"]), "left")
            .select(n["level"], "pairs", F.when(F.col("pairs") > 0, F.coalesce("_sum", F.lit(0.0)) / F.col("pairs")).alias("mean_jaccard")))


def greedy_independent(members: DataFrame, limit: float = OVERLAP_LIMIT) -> DataFrame:
    """Populations kept by a greedy pass in stored order: each kept one has similarity below ``limit`` to all earlier kept ones.

    Solved in rounds: a remaining population without a remaining earlier conflict is kept for certain, so all of them are kept
    at once and their neighbours removed. Conflict pairs come from the pair table; rounds are few and independent of the data size.
    """
    conflicts = cut_lineage(pairwise_jaccard(members).where(F.col("jaccard") >= limit).select("first", "second"))
    remaining = cut_lineage(members.select("population").distinct())
    kept = remaining.limit(0)
    while not remaining.isEmpty():
        open_pairs = (conflicts.join(remaining.withColumnRenamed("population", "first"), "first", "left_semi")
                      .join(remaining.withColumnRenamed("population", "second"), "second", "left_semi"))
        free = cut_lineage(remaining.join(open_pairs.select(F.col("second").alias("population")).distinct(), "population", "left_anti"))
        blocked = open_pairs.join(free.withColumnRenamed("population", "first"), "first", "left_semi").select(F.col("second").alias("population"))
        kept = kept.unionByName(free)
        remaining = cut_lineage(remaining.join(free, "population", "left_anti").join(blocked.distinct(), "population", "left_anti"))
    return kept


def average_ranks(df: DataFrame, keys, value: str, name: str) -> DataFrame:
    """Average rank of a value within its group; ranks come from counts of distinct values, ties share the mean rank."""
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select(*keys, value, (F.coalesce(F.sum("_n").over(before), F.lit(0)) + (F.col("_n") + 1) / 2).alias(name))
    return df.join(ranks, [*keys, value])


def level_validity(rates: DataFrame) -> DataFrame:
    """Per run: Spearman correlation of level and rate, inversions and mean gap of consecutive level means, spread within levels."""
    ranked = average_ranks(average_ranks(rates.where(F.col("rate").isNotNull()), ["run"], "level", "_rl"), ["run"], "rate", "_rr")
    correlation = ranked.groupBy("run").agg(F.corr("_rl", "_rr").alias("spearman"))
    by_level = rates.groupBy("run", "level").agg(F.avg("rate").alias("mean"), F.stddev_pop("rate").alias("spread"))
    step = F.round(F.col("mean") - F.lag("mean").over(Window.partitionBy("run").orderBy("level")), 9)
    steps = by_level.withColumn("gap", step).groupBy("run").agg(
        F.sum((F.col("gap") <= 0).cast("int")).alias("inversions"), (F.avg("gap") * 100).alias("mean_gap"), (F.min("gap") * 100).alias("min_gap"),
        (F.max("gap") * 100).alias("max_gap"), (F.min("spread") * 100).alias("min_spread"), (F.max("spread") * 100).alias("max_spread"))
    return correlation.join(steps, "run")


def inventory(members: DataFrame) -> DataFrame:
    """Populations per level: count, smallest and largest size, distinct sizes."""
    sizes = members.groupBy("population", "level").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("level").agg(F.count(F.lit(1)).alias("populations"), F.min("n").alias("smallest"), F.max("n").alias("largest"),
                                      F.countDistinct("n").alias("distinct_sizes"))
