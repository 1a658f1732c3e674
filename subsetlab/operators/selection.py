"""Subset selection by draws and by distance to a centre, for all populations, splits and sizes in one plan."""
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer

from ..functions.vector_udfs import euclidean
from ..session import partitions, settled
from ..functions.ranking import BUCKETS, bucketed_rank, hash_bucket, hash_key, with_value_bucket

LARGE_STRATUM = 100_000   # members; larger strata are ranked over buckets
SPREAD = 5.0              # standard deviations between the expected and the possible key of a draw's last pick
DRAW_COLUMNS = ("population", "window", "split", "subset", "method", "draw", "instance")


def open_quotas(quotas: DataFrame, keys) -> DataFrame:
    """Quotas of the strata that get at least one slot."""
    return quotas.where(F.col("quota") > 0).select(*keys, "subset", "stratum", "members", "quota")


def explode_draws(df: DataFrame, n_draws: int) -> DataFrame:
    """Repeat every row once per draw."""
    return df.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(n_draws - 1))))


def has_large_strata(quotas: DataFrame) -> bool:
    """Does any stratum have more than ``LARGE_STRATUM`` members? (One small job over the counted sizes.)"""
    return not quotas.where(F.col("members") > LARGE_STRATUM).isEmpty()


def top_per_stratum(candidates: DataFrame, keys, order, large: bool, large_bucket) -> DataFrame:
    """The first ``quota`` rows of every (keys, stratum) in the given order.

    Strata up to ``LARGE_STRATUM`` members (the counted column ``members``) are ranked by a streaming window. Where there are
    ``large`` ones, those are ranked over ordered buckets (``large_bucket``: rows -> rows with a monotone ``_bucket``), so no task
    holds a whole stratum. Both ways give the same exact rank.
    """
    group = [*keys, "stratum"]
    window = Window.partitionBy(*group).orderBy(*order)
    small = candidates.withColumn("pick", F.row_number().over(window))
    if large:
        is_large = F.col("members") > LARGE_STRATUM
        ranked = bucketed_rank(large_bucket(candidates.where(is_large)), group, "_bucket", order, "pick").drop("_bucket")
        small = candidates.where(~is_large).withColumn("pick", F.row_number().over(window))
        small = small.unionByName(ranked.select(*small.columns))
    return small.where(F.col("pick") <= F.col("quota"))


def _by_hash(rows: DataFrame) -> DataFrame:
    """Bucket of a draw key."""
    return rows.withColumn("_bucket", hash_bucket(F.col("_key")))


def stratified_draws(members: DataFrame, quotas: DataFrame, n_draws: int, seed="42", keys=("population", "window", "split", "method")) -> DataFrame:
    """Seeded random draws without replacement, each stratum filled up to its quota; uniform draws are the one-stratum case.

    ``members`` has one row per (instance, method) with its stratum. Strata that need nothing (quota 0) drop out before the
    draws are expanded.
    """
    large = has_large_strata(quotas)
    # The members are placed by population and split once, while they are few; draws, ranks and errors then need no further shuffle.
    # A population too large for that is spread by stratum and draw instead.
    places = [k for k in keys if k != "method"]
    placed = members if large or not places else members.repartition(partitions(members), *places)
    candidates = explode_draws(placed.join(open_quotas(quotas, keys), [*keys, "stratum"]), n_draws)
    keyed = candidates.withColumn("_key", hash_key(seed, *[F.col(c) for c in DRAW_COLUMNS]))
    picked = top_per_stratum(keyed, [*keys, "subset", "draw"], [F.col("_key"), F.col("instance")], large, _by_hash)
    return picked.drop("_key", "quota", "members")


def _key_below(share):
    """Text that a uniform md5 key is below with the probability ``share``."""
    digits = F.lpad(F.lower(F.hex(F.floor(share * F.lit(float(1 << 52))).cast("long"))), 13, "0")
    return F.when(share >= 1, "g").when(share <= 0, "").otherwise(digits)


def drawn_totals(members: DataFrame, quotas: DataFrame, n_draws: int, totals: dict, seed="42", keys=("population", "window", "split", "method"), carried=()) -> DataFrame:
    """Totals over the picks of ``stratified_draws`` without a row per pick: (keys, subset, draw, carried, ``picked``, names of ``totals``).

    ``totals`` maps a name to (aggregate over rows, aggregate over its partial values, column); ``carried`` columns depend on the keys.
    Keys are uniform, so those clearly below the place of a draw's last pick are added up where they are, and those clearly above it are
    dropped; only the keys between, about the square root of the picks, are shuffled and ranked. Every draw's picks are counted afterwards;
    draws that do not have their quota are ranked in full, so the picks are exact. The members should come in as many parts as there are cores.
    """
    group, total = [*keys, "subset", "stratum"], [*keys, "subset", "draw"]
    share, n = F.col("quota") / F.col("members"), F.col("members")
    reach = SPREAD * F.sqrt(share * (1 - share) / n)
    opened = settled(open_quotas(quotas, keys).where(F.col("stratum").isNotNull()).select(
        *group, "members", "quota", _key_below(share - reach).alias("_low"), _key_below(share + reach + SPREAD ** 2 / 2 / n).alias("_high")))
    first = [start(column).alias(name) for name, (start, _, column) in totals.items()]
    again = [F.sum("_n").alias("picked"), *[add(name).alias(name) for name, (_, add, _) in totals.items()]]
    keyed = (explode_draws(members.join(opened.drop("members"), [*keys, "stratum"]), n_draws)
             .withColumn("_key", hash_key(seed, *[F.col(c) for c in DRAW_COLUMNS])).where(F.col("_key") < F.col("_high")))
    unsure = lambda c: F.when(F.col("_key") >= F.col("_low"), F.col(c))
    placed = (keyed.withColumn("_at", unsure("_key")).withColumn("_who", unsure("instance"))
              .groupBy(*group, "draw", *carried, "quota", "_at", "_who").agg(F.count(F.lit(1)).alias("_n"), *first))
    upto = Window.partitionBy(*group, "draw").orderBy(F.asc_nulls_first("_at"), F.asc_nulls_first("_who")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    picked = placed.withColumn("_upto", F.sum("_n").over(upto)).where(F.col("_upto") <= F.col("quota"))
    out = settled(picked.groupBy(*total, *carried).agg(*again))
    wanted = explode_draws(opened.groupBy(*keys, "subset").agg(F.sum("quota").alias("_slots")), n_draws)
    short = wanted.join(out.select(*total, "picked"), total, "left").where(F.coalesce("picked", F.lit(0)) != F.col("_slots")).select(*total)
    if short.isEmpty():
        return out
    short = settled(short)
    rest = quotas.join(short.select(*keys, "subset").distinct(), [*keys, "subset"], "left_semi")
    ranked = stratified_draws(members, rest, n_draws, seed, keys).join(short, total, "left_semi")
    ranked = ranked.groupBy(*total, *carried).agg(F.count(F.lit(1)).alias("_n"), *first).groupBy(*total, *carried).agg(*again)
    return out.join(short, total, "left_anti").unionByName(ranked)


def fill_shortfall(selected: DataFrame, members: DataFrame, slots: DataFrame, keys, order) -> DataFrame:
    """Complete selections that are smaller than their size from the not selected members, in the given order.

    ``slots`` has the wanted size per ``keys``. Only selections that really are short reach the anti-join.
    """
    have = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("_have"))
    short = (slots.join(have, list(keys), "left").withColumn("_missing", F.col("slots") - F.coalesce("_have", F.lit(0)))
             .where(F.col("_missing") > 0).select(*keys, "_missing"))
    shared = [k for k in keys if k in members.columns]
    rest = members.join(short, shared).join(selected.select(*keys, "instance"), [*keys, "instance"], "left_anti")
    window = Window.partitionBy(*keys).orderBy(*order)
    extra = rest.withColumn("pick", F.row_number().over(window)).where(F.col("pick") <= F.col("_missing")).drop("_missing")
    return selected.unionByName(extra, allowMissingColumns=True)


def stability_control(members: DataFrame, quotas: DataFrame, keys=("population", "window", "split", "method")) -> DataFrame:
    """Deterministic control: in every difficulty stratum the instances whose training outcomes varied least."""
    candidates = members.join(open_quotas(quotas, keys), [*keys, "stratum"]).withColumn("variance", F.round("variance", 9))
    picked = top_per_stratum(candidates, [*keys, "subset"], [F.col("variance"), F.col("instance")], has_large_strata(quotas),
                             lambda rows: rows.withColumn("_bucket", F.col("variance")))
    return picked.drop("quota", "members")


def group_centres(candidates: DataFrame, keys, vector: str = "vector") -> DataFrame:
    """Mean vector and number of candidates per group, with map-side combine."""
    as_vector = candidates.withColumn("_v", array_to_vector(F.col(vector)))
    return (as_vector.groupBy(*keys).agg(Summarizer.mean(F.col("_v")).alias("_centre"), F.count(F.lit(1)).alias("candidates"))
            .withColumn("centre", vector_to_array("_centre")).drop("_centre"))


def distance_to_centre(candidates: DataFrame, keys, vector: str = "vector", digits: int = 9) -> DataFrame:
    """Distance of every candidate to its group's mean vector, rounded so that ties do not depend on summation order."""
    joined = candidates.join(settled(group_centres(candidates, keys, vector)), list(keys))   # their size is known, so the vectors need no shuffle
    return joined.withColumn("to_centre", F.round(euclidean(F.col(vector), F.col("centre")), digits)).drop("centre")


def nearest_to_centre(candidates: DataFrame, quotas: DataFrame, keys) -> DataFrame:
    """Centroid method inside strata: the ``quota`` candidates nearest to their stratum's mean vector.

    Members without a vector are never candidates; a stratum that has fewer candidates than its quota takes all of them and is
    completed with its first members without a vector.
    """
    measured = distance_to_centre(candidates.where(F.col("vector").isNotNull()), [*keys, "stratum"])
    plain = candidates.where(F.col("vector").isNull())
    ordered = (measured.drop("candidates").withColumn("_missing", F.lit(0))
               .unionByName(plain.withColumn("_missing", F.lit(1)), allowMissingColumns=True))
    far = F.lit(float("inf"))
    joined = ordered.join(open_quotas(quotas, keys), [*keys, "stratum"]).withColumn("_order", F.coalesce("to_centre", far))
    group = [*keys, "subset", "stratum"]
    bucket = lambda rows: (with_value_bucket(rows, group, "to_centre")
                           .withColumn("_bucket", F.when(F.col("to_centre").isNull(), BUCKETS).otherwise(F.col("_bucket"))))
    picked = top_per_stratum(joined, [*keys, "subset"], [F.col("_order"), F.col("instance")], has_large_strata(quotas), bucket)
    return picked.drop("_missing", "quota", "members", "_order")


def draw_from_pool(pool: DataFrame, size: str, n_draws: int, keys, seed="shortlist") -> DataFrame:
    """Seeded uniform draws of ``size`` instances from a shortlist (all of it when the shortlist is smaller)."""
    drawn = explode_draws(pool, n_draws).withColumn("_key", hash_key(seed, *[F.col(k) for k in keys], F.col("draw"), F.col("instance")))
    window = Window.partitionBy(*keys, "draw").orderBy("_key", "instance")
    return drawn.withColumn("pick", F.row_number().over(window)).where(F.col("pick") <= F.col(size)).drop("_key")


def shortlist_size(n, size, ratio: float):
    """Shortlist slots: the size times the ratio rounded down, at least one more than the size, at most the population."""
    return F.least(n, F.greatest(size + 1, F.floor(size * F.lit(ratio)).cast("int")))
