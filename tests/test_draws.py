"""Totals of draws against the draws' rows."""
import pytest
from pyspark.sql import functions as F

from subsetlab.operators import errors, selection, strata
from subsetlab.session import dealt

KEYS = ["population", "window", "split", "method"]


def population(spark, size=3000):
    """One population in strata of very different sizes, down to a single member, and members without a stratum."""
    stratum = F.when(F.col("id") < 2000, "a").when(F.col("id") < 2600, "b").when(F.col("id") < 2990, (F.col("id") % 40).cast("string")).when(F.col("id") < 2991, "one")
    return spark.range(size).select(F.lit(0).alias("population"), F.lit(2).alias("window"), F.lit(0).alias("split"), F.lit("m").alias("method"), F.col("id").alias("instance"),
                                    F.when(F.col("id") < 2995, stratum).alias("stratum"), F.array(F.col("id") % 2, F.col("id") % 3).cast("array<int>").alias("outcomes"), F.array(F.lit(1)).alias("test"))


def both(spark, members, fractions=(0.05, 0.3, 1.0)):
    quotas = strata.stratum_quotas(members, KEYS, fractions)
    totals = errors.run_totals(2) | {"least": (F.min, F.min, F.col("instance")), "sum": (F.sum, F.sum, F.col("instance"))}
    got = selection.drawn_totals(members, quotas, 6, totals, carried=("test",)).select(*KEYS, "subset", "draw", "picked", *totals)
    want = selection.stratified_draws(members, quotas, 6).groupBy(*KEYS, "subset", "draw").agg(F.count(F.lit(1)).alias("picked"), *[f(c).alias(n) for n, (f, _, c) in totals.items()])
    return sorted(map(tuple, got.collect())), sorted(map(tuple, want.collect()))


def test_totals_are_those_of_the_draws(spark):
    got, want = both(spark, population(spark))
    assert got == want and len(got) == 18


@pytest.mark.parametrize("spread", [0.0, 0.5])
def test_draws_outside_the_expected_range_are_ranked_in_full(spark, monkeypatch, spread):
    monkeypatch.setattr(selection, "SPREAD", spread)
    calls, ranked = [], selection.stratified_draws
    monkeypatch.setattr(selection, "stratified_draws", lambda *a, **k: calls.append(1) or ranked(*a, **k))
    got, want = both(spark, population(spark))
    assert got == want and len(calls) == 2   # once by the totals, once by the test


def test_draws_are_not_ranked_whole(spark, monkeypatch):
    members = population(spark).where(F.col("stratum").isNotNull())
    quotas = strata.stratum_quotas(members, KEYS, (0.1,))
    monkeypatch.setattr(selection, "top_per_stratum", None)
    out = selection.drawn_totals(members, quotas, 4, {}).collect()
    assert [r["picked"] for r in out] == [299] * 4


def test_few_rows_are_dealt_even_when_placed_by_their_key(spark):
    placed = spark.range(500).withColumnRenamed("id", "instance").groupBy("instance").count()
    assert dealt(placed).rdd.getNumPartitions() == 4
    assert "xxhash64(instance" in dealt(placed)._jdf.queryExecution().executedPlan().toString()
