"""Dataset totals, duplicates, warnings, coverage, several sources."""

import pytest

from plumbline import profile, profile_sources
from plumbline.functions.fields import local_table
from plumbline.operators import datasets as sets


def test_duplicates_treat_null_as_equal(spark):
    rows = [(1, "a"), (1, "a"), (None, "a"), (None, "a"), (None, None), (2, "x" * 100), (2, "x" * 100), (2, "x" * 101)]
    df = spark.createDataFrame(rows, "k int, w string")
    assert sets.duplicate_rows({"t": df}).first().n_duplicate_rows == 3


def test_duplicates_of_nested_columns(spark):
    df = spark.range(6).selectExpr("map('k', id % 2) AS m", "array(id % 2) AS a", "named_struct('m', map(1, id % 2)) AS s")
    assert sets.duplicate_rows({"t": df}).first().n_duplicate_rows == 4


def test_empty_dataset(spark):
    found = profile({"t": spark.createDataFrame([], "a int, b string")})
    row = found["dataset_profile"].first()
    assert (row.n_rows, row.n_cols, row.overall_null_pct, row.n_duplicate_rows) == (0, 2, 0.0, 0)


def test_warnings_in_order_and_strict(spark):
    df = spark.range(10).selectExpr(
        "IF(id < 2, NULL, 1) AS at_limit", "IF(id < 3, NULL, 1) AS above", "map('k', 1) AS pairs"
    )
    found = profile({"t": df})["warnings"].orderBy("seq").collect()
    assert [(w.kind, w.column) for w in found] == [
        ("unprofiled", "pairs"), ("high_nulls", "above"), ("duplicates", None),
    ]
    assert found[1].message == "Column 'above' is 30.00% null"
    assert found[2].message == "7 duplicate rows (70.0%)"


def test_invariants_of_a_sample(churn):
    found = profile({"churn": churn})
    row = found["dataset_profile"].first()
    columns = {r.column: r for r in found["column_profile"].collect()}
    assert (row.n_rows, row.n_cols) == (1000, 8)
    assert row.overall_null_pct == 0.25 and row.size_mb > 0
    assert set(columns) == set(churn.columns)
    assert columns["tenure_months"].inferred_type.startswith("numeric_")
    assert columns["churn"].inferred_type in ("boolean", "numeric_discrete")
    assert columns["customer_id"].unique_ratio > 0.9
    assert columns["age"].mean is not None
    assert sum(r.n_columns for r in found["type_distribution"].collect()) == 8


def test_coverage(spark):
    columns = profile({"t": spark.range(3).selectExpr("id", "id AS extra")})["column_profile"]
    expected = local_table(spark, [("t", "id"), ("t", "gone")], "dataset string, column string")
    found = sets.schema_coverage(columns, expected)
    assert {(r.column, r.status) for r in found.collect()} == {("id", "present"), ("gone", "missing"), ("extra", "extra")}
    assert sets.coverage_summary(found).first().coverage_pct == 50.0


def test_several_sources_as_one(spark):
    a = spark.range(30).selectExpr("id AS user_id", "IF(id < 15, NULL, 1) AS x")
    b = spark.range(10).selectExpr("id AS user_id", "id AS amount")
    c = spark.range(5).selectExpr("id AS other")
    found = profile_sources({"a": a, "b": b, "c": c})
    total = found["dataset_profile"].first()
    assert (total.dataset, total.n_rows, total.n_cols) == ("combined", 45, 5)
    assert total.overall_null_pct == pytest.approx(round(100 * 15 / 85, 2))
    pairs = found["relationships"].collect()
    assert [(r.source_a, r.source_b, r.shared_columns, r.likely_join_key) for r in pairs] == [("a", "b", ["user_id"], "user_id")]
    assert sorted(r.position for r in found["column_profile"].collect()) == [0, 1, 2, 3, 4]
