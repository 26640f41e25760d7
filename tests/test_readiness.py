"""Readiness: published scores, limits of the penalty, advice and risk rules."""

import pytest
from pyspark.sql import functions as F

from plumbline import load_sample
from plumbline.functions import catalog
from plumbline.functions.fields import local_table
from plumbline.operators import readiness as ready
from plumbline.operators.columns import column_sums
from plumbline.functions.fields import clean


def tables(spark, n_rows=5000, null_pct=0.0, duplicates=0, outliers=(), names=("a",)):
    rows = [("t", i, c, float(outliers[i]) if i < len(outliers) else 0.0) for i, c in enumerate(names)]
    columns = local_table(spark, rows, "dataset string, position int, column string, pct_outliers double")
    totals = local_table(spark, [("t", n_rows, null_pct, duplicates)],
                         "dataset string, n_rows long, overall_null_pct double, n_duplicate_rows long")
    return columns, totals


def uses(spark, use_case):
    return local_table(spark, [("t", use_case)], "dataset string, use_case string")


def run(spark, use_case, *args, requirements=None, **options):
    columns, totals = tables(spark, *args, **options)
    return ready.readiness(columns, totals, uses(spark, use_case), requirements or catalog.requirements(spark))


@pytest.mark.parametrize(
    "use_case, score, filled, band",
    [("churn_prediction", 62.0, 19, "MODERATE"), ("fraud_detection", 62.4, 19, "MODERATE"), ("sales_forecasting", 0.0, 0, "VERY LOW")],
)
def test_published_scores(spark, use_case, score, filled, band):
    names = load_sample(spark, use_case).columns
    found = run(spark, use_case, n_rows=1000, names=names)
    row = found["readiness"].first()
    assert (row.score, row.band, row.quality_penalty) == (score, band, 0.0)
    assert row.bar == f"[{'█' * filled}{'░' * (30 - filled)}] {round(score)}%"
    assert found["field_lists"].first().missing_critical == []
    assert [(r.severity, r.risk) for r in found["risks"].collect()] == [("MEDIUM", "Modest number of rows")]


def test_churn_gaps(spark):
    found = run(spark, "churn_prediction", names=load_sample(spark, "churn_prediction").columns)
    lists = found["field_lists"].first()
    assert lists.missing_important == ["Contract or plan", "Signs of recent activity", "Satisfaction rating"]
    tiers = {r.tier: (r.score, r.earned, r.max_weight) for r in found["readiness_tier"].collect()}
    assert tiers == {"critical": (100.0, 40, 40), "important": (38.9, 14, 36), "nice": (33.3, 8, 24)}


def test_catalogue_weights(spark):
    sums = catalog.requirements(spark).groupBy("use_case").agg(F.sum("weight").alias("w"), F.count("*").alias("n"))
    assert {r.use_case: (r.w, r.n) for r in sums.collect()} == {
        "churn_prediction": (100, 15), "customer_support_chatbot": (100, 12), "fraud_detection": (85, 9),
    }


def test_names_match_loosely_in_any_case(spark):
    found = run(spark, "fraud_detection", names=("L_SHIPDATE", "Percentage"))
    hits = {r.description: r.matched_column for r in found["requirement_match"].collect() if r.matched_column}
    assert hits == {"Time of the transaction": "l_shipdate", "Device or network address": "l_shipdate"}


def test_own_requirements_and_empty_tier(spark):
    own = catalog.requirements(spark, {"mine": {"critical": [("A", 3, ["Alpha"]), ("B", 1, ["beta"])]}})
    found = run(spark, "mine", names=("my_ALPHA",), requirements=own)
    assert found["readiness"].first().raw_score == 75.0
    assert {r.tier: r.score for r in found["readiness_tier"].collect()} == {"critical": 75.0, "important": 100.0, "nice": 100.0}


@pytest.mark.parametrize(
    "null_pct, points", [(3.0, 0), (3.01, 1), (8.0, 1), (8.01, 3), (15.0, 3), (15.01, 6), (30.0, 6), (30.01, 10)]
)
def test_null_penalty(spark, null_pct, points):
    assert ready.quality_penalty(*tables(spark, null_pct=null_pct)).first().null_penalty == points


@pytest.mark.parametrize("copies, points", [(50, 0), (51, 2), (250, 2), (251, 5)])
def test_duplicate_penalty(spark, copies, points):
    assert ready.quality_penalty(*tables(spark, duplicates=copies)).first().duplicate_penalty == points


def test_outlier_penalty_counts_columns_and_total_is_capped(spark):
    names = [f"c{i}" for i in range(12)]
    row = ready.quality_penalty(*tables(spark, null_pct=40.0, duplicates=1000, outliers=[10.0] + [10.01] * 11, names=names)).first()
    assert (row.outlier_penalty, row.quality_penalty) == (11.0, 20.0)


def test_score_stays_at_zero(spark):
    found = run(spark, "fraud_detection", null_pct=40.0, names=("nothing",))
    assert found["readiness"].first().score == 0.0


@pytest.mark.parametrize("n_rows, severity", [(499, "HIGH"), (500, "MEDIUM"), (1999, "MEDIUM"), (2000, None)])
def test_row_risks(spark, n_rows, severity):
    found = run(spark, "sales_forecasting", n_rows=n_rows)["risks"].collect()
    assert [r.severity for r in found] == ([severity] if severity else [])


def test_advice_order(spark):
    found = run(spark, "fraud_detection", null_pct=8.01, outliers=[5.0, 5.01], names=("x", "amount"))["recommendations"]
    kinds = [r.severity for r in found.orderBy("seq").collect()]
    assert kinds == ["critical"] * 2 + ["important"] * 4 + ["quality", "outliers", "verdict"]


def test_several_datasets_at_once(spark):
    given = clean({"a": spark.range(3).selectExpr("id AS amount"), "b": spark.range(3).selectExpr("id AS tenure")})
    both = local_table(spark, [("a", "fraud_detection"), ("b", "churn_prediction")], "dataset string, use_case string")
    matches = ready.match_requirements(column_sums(given), both, catalog.requirements(spark))
    raw = {r.dataset: r.raw_score for r in ready.raw_scores(ready.tier_scores(both, matches)).collect()}
    assert raw == {"a": round(1500 / 85, 1), "b": 15.0}


@pytest.mark.parametrize("score, filled, shown", [(0.0, 0, 0), (5.0, 2, 5), (15.0, 4, 15), (99.5, 30, 100), (100.0, 30, 100)])
def test_bar_rounds_half_to_even(spark, score, filled, shown):
    row = spark.range(1).select(ready.bar(F.lit(score)).alias("bar")).first()
    assert row.bar == f"[{'█' * filled}{'░' * (30 - filled)}] {shown}%"
