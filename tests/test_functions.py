"""Ranks, quantiles and tail probabilities."""
import math

import pytest
from pyspark.sql import Window, functions as F

from subsetlab.functions import ranking, tails


@pytest.fixture(scope="module")
def values(spark):
    return spark.range(5000).select("id", F.when(F.col("id") % 10 < 7, 0).otherwise(F.col("id") % 3).alias("g"), F.pmod(F.col("id") * 37, F.lit(101)).cast("double").alias("v"))


def test_bucketed_ranks_equal_window_ranks(values):
    ranked = ranking.rank_by_value(values, ["g"], "v", ["id"]).withColumn("plain", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert ranked.where("rank <> plain").count() == 0
    keyed = values.withColumn("key", ranking.hash_key("s", F.col("id")))
    hashed = ranking.rank_by_hash(keyed, ["g"], "key", "id").withColumn("plain", F.row_number().over(Window.partitionBy("g").orderBy("key", "id")))
    assert hashed.where("rank <> plain").count() == 0


def test_running_total_equals_window_sum(values):
    window = Window.partitionBy("g").orderBy("v", "id").rowsBetween(Window.unboundedPreceding, 0)
    both = ranking.running_total(values, ["g"], "v", ["id"], "v", "total").withColumn("plain", F.sum("v").over(window))
    assert both.where("total <> plain").count() == 0


def test_ranges_stay_even_when_nearly_all_values_are_equal(spark):
    """The count of nearly every token is one: the tie column cuts the ranges."""
    table = spark.range(40_000).select(F.concat(F.lit("t"), "id").alias("token"), F.when(F.col("id") % 1000 == 0, F.col("id") + 2).otherwise(1).alias("count"))
    sizes = [r["count"] for r in ranking.in_ranges(table.withColumnRenamed("count", "n"), [], [F.desc("n"), F.asc("token")], 8).groupBy("_range").count().collect()]
    assert sum(sizes) == 40_000 and max(sizes) < 2 * 40_000 / 8
    both = ranking.ordered(table, [], [F.desc("count"), F.asc("token")], rank="rank", value="count", total="upto")
    window = Window.orderBy(F.desc("count"), "token")
    plain = both.withColumn("_r", F.row_number().over(window)).withColumn("_t", F.sum("count").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    assert plain.where("rank <> _r OR upto <> _t").count() == 0


def test_group_quantiles_equal_percentile(values):
    shares = (0.0, 0.025, 0.5, 0.95, 1.0)
    ours = {r["g"]: [r[f"p{s * 100:g}".replace(".", "_")] for s in shares] for r in ranking.group_quantiles(values, ["g"], "v", shares).collect()}
    plain = {r["g"]: r["q"] for r in values.groupBy("g").agg(F.percentile("v", list(shares)).alias("q")).collect()}
    assert ours.keys() == plain.keys()
    for g in plain:
        assert ours[g] == pytest.approx(plain[g])


def test_tails_against_textbook_values(spark):
    assert tails.beta_quantile(0.5, 2.0, 2.0) == pytest.approx(0.5, abs=1e-12)
    assert tails.beta_cdf(0.3, 2.0, 5.0) == pytest.approx(0.579825, abs=1e-6)
    assert tails.t_quantile(0.975, 10) == pytest.approx(2.228139, abs=1e-5)
    assert tails.t_quantile(0.975, 1) == pytest.approx(12.706205, abs=1e-4)
    assert tails.signed_rank_exact(15, 5, "two") == pytest.approx(0.0625)
    assert tails.signed_rank_exact(15, 5, "greater") == pytest.approx(0.03125)
    assert tails.signed_rank_exact(8, 10, "two") == pytest.approx(0.048828125)
    row = spark.range(1).select(tails.normal_two_sided(F.lit(1.959963985)).alias("n"), tails.chi_square_upper_even(F.lit(9.487729), F.lit(2)).alias("c"),
                                tails.binomial_two_sided_half(F.lit(9), F.lit(9)).alias("b9"), tails.binomial_two_sided_half(F.lit(8), F.lit(9)).alias("b8")).first()
    assert row["n"] == pytest.approx(0.05, abs=1e-8)
    assert row["c"] == pytest.approx(0.05, abs=1e-6)
    assert row["b9"] == pytest.approx(2 / 512) and row["b8"] == pytest.approx(20 / 512)
    assert math.isclose(tails.beta_quantile(0.025, 8, 3), 0.4439, abs_tol=1e-3)
