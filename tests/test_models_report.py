"""Model scores, strategies, reports, replies, and runs with failing stages."""

import json

import pytest
from pyspark.sql import functions as F

from plumbline import discover, load_sample
from plumbline.functions import catalog
from plumbline.functions.fields import local_table
from plumbline.operators import models, report
from plumbline.plans import discover as plan
from plumbline.sources.sinks import nested_json

TRAITS = (
    "dataset string, use_case string, n_rows long, data_size string, class_balance string, "
    "n_high_corr_pairs long"
)


def ranking(spark, use_case, size, balance, categoricals, pairs=0, task="classification", n_rows=1000):
    traits = local_table(spark, [("t", use_case, n_rows, size, balance, pairs)], TRAITS).withColumn("has_categoricals", F.lit(categoricals))
    ranked = models.score_models(traits, catalog.models(spark), task)
    return traits, ranked, [(r.model_key, r.score) for r in ranked.orderBy("rank").collect()]


def test_published_ranking_needs_no_categories(spark):
    _, _, found = ranking(spark, "churn_prediction", "small", "imbalanced", False)
    assert found[:3] == [("logistic_regression", 25), ("xgboost_classifier", 20), ("random_forest_classifier", 0)]


def test_categories_favour_boosting(spark):
    _, _, found = ranking(spark, "churn_prediction", "small", "imbalanced", True)
    assert found == [("xgboost_classifier", 30), ("logistic_regression", 25), ("lightgbm_classifier", 10),
                     ("random_forest_classifier", 0), ("neural_net_tabular", -10)]


def test_sizes_and_affinity(spark):
    _, _, medium = ranking(spark, "fraud_detection", "medium", "unknown", False, pairs=4)
    assert dict(medium) == {"xgboost_classifier": 20, "logistic_regression": 20, "random_forest_classifier": 20,
                            "lightgbm_classifier": 35, "neural_net_tabular": 25}
    _, _, large = ranking(spark, "other", "large", "unknown", False, pairs=3)
    assert dict(large) == {"xgboost_classifier": 0, "logistic_regression": 5, "random_forest_classifier": 10,
                           "lightgbm_classifier": 20, "neural_net_tabular": 20}
    _, _, numbers = ranking(spark, "sales_forecasting", "small", "unknown", True, task="regression")
    assert numbers == [("linear_regression_ridge", 25), ("xgboost_regressor", 10)]


@pytest.mark.parametrize("n, size", [(5000, "small"), (5001, "medium"), (50000, "medium"), (50001, "large")])
def test_size_limits(spark, n, size):
    assert spark.range(1).select(models.size_bucket(F.lit(n)).alias("s")).first().s == size


@pytest.mark.parametrize("n, split", [(999, "80/20 stratified"), (1000, "70/15/15 stratified"), (9999, "70/15/15 stratified"), (10000, "80/10/10")])
def test_training_split(spark, n, split):
    traits, ranked, _ = ranking(spark, "churn_prediction", "small", "imbalanced", True, n_rows=n)
    row = models.strategy(traits, ranked).first()
    assert row.train_split == split
    assert (row.primary_model, row.poc_days, row.production_days) == ("xgboost_classifier", 2, 8)
    assert row.secondary_metrics[0] == "macro F1"


def test_class_balance_looks_at_the_first_label_only(spark):
    rows = [
        ("a", 0, "Churned", [(70, "0"), (30, "1")]), ("a", 1, "label", [(50, "0"), (50, "1")]),
        ("b", 0, "target", [(10, "0"), (3, "1")]), ("c", 0, "target", [(100, "0"), (31, "1")]),
        ("d", 0, "label", [(10, "0")]), ("e", 0, "label", None), ("e", 1, "target", [(5, "0"), (5, "1")]),
        ("f", 0, "is_fraud", [(9, "0"), (1, "1")]),
    ]
    df = spark.createDataFrame(rows, "dataset string, position int, column string, top_values array<struct<n:long,value:string>>")
    found = {r.dataset: r.class_balance for r in models.class_balance(df).collect()}
    assert found == {"a": "balanced", "b": "imbalanced", "c": "balanced", "d": "unknown", "e": "unknown"}


def test_whole_run_with_files(spark, churn, tmp_path):
    found = discover(churn, "churn_prediction", output=str(tmp_path / "out"), generated_at="2024-05-06T07:08:09Z", trees=10)
    assert {r.status for r in found["run_status"].collect()} == {"success"}
    text = found["report"].first().markdown
    for line in ("| Rows | 1,000 |", "| Null rate | 0.25% |", "| Readiness | 62.0/100 (MODERATE) |", "**Missing critical fields:** none"):
        assert line in text
    paths = {r.kind: r.path for r in found["output_paths"].collect()}
    assert "report_20240506_070809.json" in paths["json"]
    assert spark.read.text(paths["markdown"], wholetext=True).first().value.startswith(text)
    saved = json.loads(spark.read.text(paths["json"], wholetext=True).first().value)
    assert saved["readiness"][0]["score"] == 62.0
    assert len(saved["column_profile"]) == 8
    assert found["metadata"].first().generated_at == "2024-05-06T07:08:09Z"


def test_failing_stages_leave_the_others(spark, monkeypatch, tmp_path):
    def broken(*_, **__):
        raise RuntimeError("out of reach")

    monkeypatch.setattr(plan.profiles, "profile", broken)
    monkeypatch.setattr(plan.report, "report_facts", broken)
    df = spark.range(30).selectExpr("id % 2 AS churn", "sin(id) AS x")
    found = discover(df, "churn_prediction", output=str(tmp_path / "out"), generated_at="2024-01-01T00:00:00Z", trees=5, mi="binned")
    status = {r.stage: r.status for r in found["run_status"].collect()}
    assert status == {"profile": "error: out of reach", "readiness": "success", "features": "success",
                      "models": "success", "report": "error: out of reach"}
    assert found["column_profile"].count() == 0
    assert found["readiness"].first().score == 0.0
    assert found["feature_importance"].count() == 1
    path = {r.kind: r.path for r in found["output_paths"].collect()}["markdown"]
    text = spark.read.text(path, wholetext=True).first().value
    assert "- Rows: N/A" in text and "- profile: error: out of reach" in text and "- Score: 0.0/100" in text


def test_a_bad_dataset_leaves_the_others(spark):
    good = spark.range(30).selectExpr("id % 2 AS churn", "sin(id) AS x")
    bad = good.selectExpr("churn", "CAST(raise_error('unreadable') AS DOUBLE) AS x")
    found = discover({"good": good, "bad": bad}, trees=5, mi="binned", generated_at="2024-01-01T00:00:00Z")
    status = {(r.dataset, r.stage): r.status for r in found["run_status"].collect()}
    assert {s for (d, _), s in status.items() if d == "good"} == {"success"}
    assert status["bad", "profile"].startswith("error: ") and status["bad", "features"].startswith("error: ")
    for table in ("column_profile", "feature_importance"):
        assert {r.dataset for r in found[table].collect()} == {"good"}


def test_expected_columns_are_compared(spark):
    df = spark.range(30).selectExpr("id % 2 AS churn", "sin(id) AS x")
    found = discover({"a": df, "b": df}, trees=5, mi="binned", generated_at="2024-01-01T00:00:00Z", expected={"a": ["churn", "age"]})
    status = {(r.dataset, r.column): r.status for r in found["schema_coverage"].collect()}
    assert status == {("a", "churn"): "present", ("a", "age"): "missing", ("a", "x"): "extra"}
    assert [(r.dataset, r.coverage_pct) for r in found["coverage_summary"].collect()] == [("a", 50.0)]


def test_features_of_several_sources_share_one_ranking(spark):
    one = spark.range(40).selectExpr("id % 2 AS is_fraud", "sin(id) AS x", "id % 2 + id / 100 AS y")
    two = spark.range(40).selectExpr("id % 2 AS is_fraud", "cos(id) AS z")
    found = discover({"a": one, "b": two}, "fraud_detection", multi_source=True, trees=5, mi="binned", generated_at="2024-01-01T00:00:00Z")
    assert sorted(r["rank"] for r in found["feature_importance"].collect()) == [1, 2, 3]


def test_files_that_cannot_be_written_leave_the_results(spark, tmp_path):
    (tmp_path / "out").write_text("a file where the folder should be")
    df = spark.range(30).selectExpr("id % 2 AS churn", "sin(id) AS x")
    found = discover(df, "churn_prediction", output=str(tmp_path / "out"), generated_at="2024-01-01T00:00:00Z", trees=5, mi="binned")
    status = {r.stage: r.status for r in found["run_status"].collect()}
    assert status.pop("files").startswith("error: ")
    assert set(status.values()) == {"success"}
    assert found["report"].count() == 1 and found["output_paths"].count() == 0


def test_lists_in_files_are_in_order(spark):
    rows = [("d", "u", i, f"t{i}") for i in (3, 1, 10, 2)]
    table = spark.createDataFrame(rows, "dataset string, use_case string, seq int, text string").repartition(4)
    uses = spark.createDataFrame([("d", "u")], "dataset string, use_case string")
    made = json.loads(nested_json(uses, {"recommendations": table}).first().json)
    assert [r["seq"] for r in made["recommendations"]] == [1, 2, 3, 10]


def test_several_sources_run(spark):
    found = discover(
        {"crm": spark.range(40).selectExpr("id AS customer_id", "id % 2 AS is_fraud", "sin(id) AS x"),
         "pay": spark.range(60).selectExpr("id AS customer_id", "id * 1.5D AS amount", "current_date() AS day")},
        "fraud_detection", multi_source=True, trees=5, generated_at="2024-01-01T00:00:00Z",
    )
    assert {r.status for r in found["run_status"].collect()} == {"success"}
    assert found["readiness"].first().raw_score == round(100 * (20 + 15 + 7) / 85, 1)
    assert found["relationships"].first().likely_join_key == "customer_id"


def test_sales_run_has_no_classes(spark):
    found = discover(load_sample(spark, "sales_forecasting"), "sales_forecasting", trees=5, generated_at="2024-01-01T00:00:00Z")
    assert found["feature_importance"].count() == 0  # classification of a continuous target
    assert found["feature_pairs"].count() == 1
    assert found["strategy"].first().training == "5-fold cross-validation"


REPLIES = [
    ('Here: {"executive_summary": "s", "key_findings": ["a", "b"], "top_opportunities": "one"} end', "s", ["a", "b"], ["one"], True),
    ('```json\n{"executive_summary": "f"}\n```', "f", [], [], True),
    ('{oops ```json\n{"executive_summary": "g"}\n```', "g", [], [], True),
    ("no json at all", "no json at all", ["See the full report"], [], False),
    ("x" * 600, "x" * 500, ["See the full report"], [], False),
    (None, "", ["See the full report"], [], False),
]


@pytest.mark.parametrize("text, summary, findings, chances, parsed", REPLIES)
def test_replies(spark, text, summary, findings, chances, parsed):
    row = report.extract_replies(spark.createDataFrame([(1, text)], "id int, reply string")).first()
    assert (row.executive_summary, row.key_findings, row.top_opportunities, row.parsed) == (summary, findings, chances, parsed)
    assert row.recommended_next_steps == []
    if not parsed:
        assert row.full_report == (text or "")
