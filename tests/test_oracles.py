"""Queries against a second engine over the smallest tables.

``python tests/compare.py`` checks all of them, at any scale.
"""

import pytest

import __spark_entry__ as entry
from compare import differences, second_engine

FOLDER = "/root/testdata/sf0.001"
QUICK = [
    "profile_distinct", "profile_types", "profile_numeric", "profile_quartiles", "outliers_iqr", "top_values",
    "date_range", "date_spellings", "column_profile", "duplicate_rows", "profile_warnings", "coverage_summary",
    "source_relationships", "readiness_tiers", "quality_penalty", "encode_features", "target_correlation",
    "mutual_information_binned", "mutual_information_knn", "response_extract", "scan_csv_missing",
    "scan_json_array", "scan_roundtrip_xlsx", "sample_churn", "sample_fraud", "sample_sales",
]


@pytest.fixture(scope="module")
def con():
    return second_engine(FOLDER)


@pytest.mark.parametrize("name", QUICK)
def test_query_agrees(spark, con, name):
    assert differences(spark, con, FOLDER, name) is None


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_differences_are_seen(spark, con, monkeypatch):
    monkeypatch.setattr(entry, "oracle_sql", lambda: {"duplicate_rows": "SELECT 'lineitem' AS dataset, 1::BIGINT AS n_duplicate_rows"})
    assert "rows" in differences(spark, con, FOLDER, "duplicate_rows")
