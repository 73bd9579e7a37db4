"""Queries against DuckDB on the smallest tables, and the hand-computed fixture."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
#: One or two of each family; the whole registry is compared by the driver.
NAMES = ["d_nearest_rows", "p5_encode", "p10_one_hot", "j5_left", "a5_correlations", "a7_spearman", "o5_inverse_frequency_bag", "o7_stratified_folds", "a4_average_distance", "d9_silhouette_rows",
         "u5_jaccard_compatibility", "j6_nearest_labelled", "c1_seeded_clusters", "c2_assignments", "c11_variance_reduction", "c13_best_purity", "m2_label_ap", "m4_label_ranking_precision", "m7_rank_auc", "x2_rule_quality", "g1_regions", "g2_region_weights", "g3_median_of_interest", "g4_distance_to_region_mean", "g6_label_relations", "g7_label_graph", "c9_running_means_legacy", "c14_purity_at_rank_steps", "c15_purity_at_widths", "u10_jaccard_or_zero", "x3_explanation_ranges", "x4_final_decisions", "l1_completed_labels", "t12_local_fill"]


def rows(records, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([repr(tuple(r[i] for i in order)) for r in records])


@pytest.mark.parametrize("name", NAMES)
def test_as_duckdb(spark, name):
    df = entry.queries()[name](spark, SF)
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    want = c.sql(entry.oracle_sql()[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows([tuple(r) for r in df.collect()], df.columns) == rows(want.fetchall(), want.columns)


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_stands_alone():
    """Nothing outside the subpackage of the training-data operators imports it."""
    root = os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "verdigris")
    for p in glob.glob(f"{root}/**/*.py", recursive=True):
        if f"{os.sep}llm{os.sep}" not in p:
            assert "llm" not in open(p).read().replace("outside the llm subpackage", ""), p
