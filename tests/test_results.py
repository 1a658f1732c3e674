"""Stored result tables: manifest, checks, pruned scans and replacement of blocks."""
import pytest
from pyspark.sql import functions as F

from subsetlab.session import checkpoint_dir, settled
from subsetlab.sources import results


def rows(spark, populations, families=("a", "b"), shift=0.0):
    table = spark.createDataFrame([(p, s, w, f, f"{f}:{m}", "10pct", p + s / 10 + shift) for p in populations for s in (0, 1) for w in (1, 2) for f in families for m in ("x", "y")],
                                  "population int, split int, window int, family string, method string, subset string, rmse double")
    return table


@pytest.fixture
def folder(spark):
    import uuid
    return f"{checkpoint_dir(spark)}/results-{uuid.uuid4().hex}"


def test_scan_reads_wanted_partitions_and_columns_only(spark, folder):
    results.write_block(rows(spark, range(0, 5)), folder, "0")
    results.write_block(rows(spark, range(5, 9)), folder, "1")
    scanned = results.scan_results(spark, folder, ["population", "rmse"], window=2, family=["a"])
    assert scanned.columns == ["window", "family", "population", "rmse"] and scanned.count() == 9 * 2 * 2
    plan = scanned._jdf.queryExecution().executedPlan().toString()
    filters = plan[plan.index("PartitionFilters"):].split("PushedFilters")[0]
    assert "window" in filters and "family" in filters
    assert "ReadSchema: struct<population:int,rmse:double>" in plan


def test_join_prunes_partitions_at_run_time(spark, folder):
    results.write_block(rows(spark, range(0, 5)), folder, "0")
    dimension = settled(spark.createDataFrame([(1, "one"), (2, "two")], "window int, label string"))
    joined = results.scan_results(spark, folder, ["rmse"]).join(dimension.where(F.col("label") == "two"), "window")
    assert {r["window"] for r in joined.collect()} == {2}
    assert "dynamicpruning" in joined._jdf.queryExecution().executedPlan().toString().lower()


def test_block_written_again_replaces_itself(spark, folder):
    results.write_block(rows(spark, range(0, 5)), folder, "0")
    results.write_block(rows(spark, range(5, 9)), folder, "1")
    results.write_block(rows(spark, range(5, 9), shift=100.0), folder, "1")
    scanned = results.scan_results(spark, folder, window=1, family="a")
    assert scanned.count() == 9 * 2 * 2 and scanned.where("rmse > 100").count() == 4 * 2 * 2
    assert results.manifest(spark, folder).count() == 2 * 2 * 2


@pytest.mark.parametrize("second, metadata, wanted", [
    (range(4, 8), None, "positions overlap or are out of order"),
    (range(5, 8), {"seed": 1}, "metadata differ from the first block")])
def test_blocks_that_do_not_fit_stop_the_scan(spark, folder, second, metadata, wanted):
    results.write_block(rows(spark, range(0, 5)), folder, "0")
    results.write_block(rows(spark, second), folder, "1", metadata=metadata)
    found = results.block_problems(results.manifest(spark, folder)).collect()
    assert {(r["block"], r["problem"]) for r in found} == {("1", wanted)} and len(found) == 4
    with pytest.raises(ValueError, match=wanted):
        results.scan_results(spark, folder, window=1)


def test_interleaved_and_missing_methods_are_found(spark, folder):
    results.write_block(rows(spark, [0, 2, 4]), folder, "even")
    results.write_block(rows(spark, [1, 3]).where("method != 'a:y'"), folder, "odd")
    found = {(r["window"], r["family"], r["block"], r["problem"]) for r in results.block_problems(results.manifest(spark, folder)).collect()}
    assert {f[3] for f in found if f[1] == "b"} == {"positions overlap or are out of order"}
    assert {f[3] for f in found if f[1] == "a"} == {"positions overlap or are out of order", "methods differ from the first block"}


def test_families_must_cover_the_same_pairs(spark, folder):
    table = rows(spark, range(0, 5))
    results.write_block(table.where("NOT (family = 'b' AND window = 2 AND population = 3 AND split = 1)"), folder, "0")
    found = [tuple(r) for r in results.alignment_problems(results.manifest(spark, folder)).collect()]
    assert found == [(2, "b", 5, 9)]
    assert results.scan_results(spark, folder, window=1).count() == 40
    with pytest.raises(ValueError, match="do not fit"):
        results.scan_results(spark, folder, window=2)
    assert results.scan_results(spark, folder, window=2, aligned=False).count() == 38


def test_empty_table_and_null_values(spark, folder):
    results.write_block(rows(spark, range(0, 2)).withColumn("rmse", F.lit(None).cast("double")), folder, "0")
    results.write_block(rows(spark, range(0, 2)).limit(0), folder, "1")
    assert results.scan_results(spark, folder).where("rmse IS NULL").count() == 32
