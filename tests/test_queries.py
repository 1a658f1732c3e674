"""One or more queries of every area against their SQL (``check.py`` runs all of them)."""
import math

import pytest

import __spark_entry__ as entry
from check import rows_of

from .conftest import FOLDER

NAMES = ("outcome_matrix", "temporal_splits", "stratum_quotas", "baseline_metrics", "stability_control", "centroid_selection", "kennard_stone_by_label",
         "core_edge_by_label", "rbf_bandwidth", "population_members", "scanned_populations", "pairwise_jaccard", "trajectory_costs", "cost_profile", "openhands_steps",
         "trae_steps", "refact_steps", "node_tree_steps", "text_log_steps", "step_validation", "masked_texts_multi_model", "masked_records", "vocabulary", "token_ranking",
         "outcome_keyness", "assigned_runs", "raw_file_resolution", "message_log_scan", "reference_comparison", "dominance_ranks", "draw_comparison", "error_distributions")


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, FOLDER)
    result = duck.execute(entry.oracle_sql()[name])
    want = rows_of([d[0] for d in result.description], result.fetchall())
    assert rows_of(df.columns, df.collect()) == want


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship_runs_on_the_smallest_data(spark):
    assert entry.entry(spark).columns[:3] == ["window", "subset", "method"]


@pytest.mark.parametrize("name", ["baseline_draw_errors", "centroid_selection"])
def test_result_does_not_depend_on_partitions(spark, name):
    query, sizes = entry.queries()[name], []
    for partitions in ("3", "11"):
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        df = query(spark, FOLDER)
        sizes.append(rows_of(df.columns, df.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert sizes[0] == sizes[1]


def test_kmeans_strata_looks_at_every_split_of_every_window(spark):
    rows = entry.queries()["kmeans_strata"](spark, FOLDER).select("window", "split").distinct().collect()
    assert {tuple(r) for r in rows} == {(window, split) for window in range(1, 5) for split in range(math.comb(4, window))}
