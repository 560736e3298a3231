"""Every registered query runs, and gives the rows of its SQL."""

import glob
import math
import os

import pytest

duckdb = pytest.importorskip("duckdb")

from gaugeline import plans, registry  # noqa: E402

plans.load()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


#: Queries without SQL, and the tests that hold their operators against plain Python.
TESTED = {
    "A11_file_manifest": "test_files",
    "B10_row_seed": "test_row_seeds",
    "D36_running_percentile": "test_running_percentile",
    "F2_item_audit": "test_item_audit",
    "F2_item_audit_labels": "test_item_audit_with_ties_and_weights",
    "F6_null_auc_quantile": "test_null_distribution_equals_the_positive_recurrence",
    "F9_null_by_labels": "test_label_nulls_equal_brute_force",
    "G6_maxmin_select": "test_maxmin_choice_equals_greedy",
    "H12_logo_weights": "test_logistic_folds_equal_direct_fits",
    "H12_pairwise_logistic_fit": "test_logistic_folds_equal_direct_fits",
    "H20_calibrate_scores": "test_calibrated_scores_equal_direct_fits",
    "J9_spectrum": "test_spectrum_traces",
}


def test_every_query_has_sql_or_a_test():
    from tests import test_operators

    assert set(TESTED) == set(registry.QUERIES) - set(registry.SQL)
    assert all(hasattr(test_operators, name) for name in TESTED.values())


def _value(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "null"
    if isinstance(x, float) or type(x).__name__ == "Decimal":
        return f"{float(x):.5g}"
    return str(x)


def _rows(rows, columns):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(tuple(_value(r[k]) for k in order) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    df = registry.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in registry.SQL:
        assert rows and name in TESTED
        return
    want = duck.execute(registry.SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    assert _rows(rows, df.columns) == _rows(want.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_every_part_gets_negatives(spark):
    parts = {r.p_partkey for r in registry.table(spark, SF, "part").collect()}
    ids = {n: [r.item_id for r in registry.QUERIES[n](spark, SF).collect()] for n in ("G2_shortfall", "G3_matched_negatives_ladder")}
    assert sorted(ids["G2_shortfall"]) == sorted(parts)
    assert set(ids["G3_matched_negatives_ladder"]) == parts


def test_documents_of_one_word_set_are_linked(spark, tmp_path):
    rows = [(1, "a b c"), (2, "C b, a"), (3, "b a c a"), (4, "a b c d"), (5, "x y"), (6, ""), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.item_id, r.cand_id): r.d for r in registry.QUERIES["G8_edge_distance"](spark, str(tmp_path)).collect()}
    assert got == {(2, 1): 0.0, (3, 1): 0.0, (1, 4): 0.125, (2, 4): 0.125, (3, 4): 0.125, (4, 1): 0.1}


def test_edges_of_a_graph_are_dealt_to_tasks_of_bounded_size(spark, monkeypatch):
    from gaugeline.operators import ordered

    monkeypatch.setattr(ordered, "TASK", 100)
    lines = registry.table(spark, SF, "lineitem").count()
    degrees = registry.QUERIES["J1_degrees"](spark, SF)
    assert degrees.rdd.getNumPartitions() == -(-lines // 100)
