"""The whole run: profile, readiness, features, models, report."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions import catalog
from plumbline.functions.fields import Datasets, local_table, small_table, union_all
from plumbline.operators import datasets as profiles
from plumbline.operators import features, models, readiness, report
from plumbline.operators.encode import encode_features
from plumbline.operators.ranks import ROWS_PER_TASK
from plumbline.sources.sinks import save_reports

# The target column a use case is known for.
TARGETS = {"churn_prediction": "churn", "fraud_detection": "is_fraud", "sales_forecasting": "revenue"}
OTHER_TARGET = "target"

# Tables a failed stage leaves empty, so that later stages still run.
EMPTY = {
    "column_profile": "dataset string, position int, column string, dtype string, kind string, "
    "inferred_type string, n_total long, n_null long, null_pct double, n_unique long, "
    "pct_outliers double, top_values array<struct<value:string,n:long>>",
    "dataset_profile": "dataset string, n_rows long, n_cols long, size_mb double, "
    "n_duplicate_rows long, overall_null_pct double",
    "warnings": "dataset string, seq int, column string, kind string, message string",
    "type_distribution": "dataset string, inferred_type string, n_columns long",
    "schema_coverage": "dataset string, column string, status string, n_values long",
    "coverage_summary": "dataset string, expected_columns long, present_columns long, "
    "missing_columns long, extra_columns long, coverage_pct double",
    "feature_correlation": "dataset string, feature string, pearson_r double, abs_r double",
    "feature_pairs": "dataset string, feature_a string, feature_b string, correlation double",
    "feature_mi": "dataset string, feature string, mi_score double, rank int",
    "feature_importance": "dataset string, feature string, importance double, rank int",
    "transform_advice": "dataset string, section int, position int, column string, suggestions array<string>",
    "feature_summary": "dataset string, n_features int, n_pairs long, n_advice long, summary string",
    "feature_warnings": "dataset string, column string, message string",
    "readiness": "dataset string, use_case string, raw_score double, quality_penalty double, "
    "score double, band string, bar string",
    "requirement_match": "dataset string, use_case string, tier string, tier_no int, req_no int, "
    "description string, weight int, matched_column string",
    "readiness_tier": "dataset string, use_case string, tier string, tier_no int, score double, "
    "earned long, max_weight long",
    "field_lists": "dataset string, use_case string, present_fields array<string>, "
    "missing_critical array<string>, missing_important array<string>, missing_nice array<string>",
    "recommendations": "dataset string, use_case string, seq int, severity string, text string",
    "risks": "dataset string, use_case string, seq int, severity string, risk string, "
    "detail string, mitigation string",
    "model_characteristics": "dataset string, use_case string, n_rows long, data_size string, "
    "class_balance string, has_categoricals boolean, n_numeric_features long, "
    "n_high_corr_pairs long, null_pct double, readiness_score double",
    "model_ranking": "dataset string, use_case string, rank int, model_key string, "
    "model_name string, score int, poc_days int, production_days int, rationale string",
    "strategy": "dataset string, use_case string, primary_model string, primary_name string, "
    "training string, training_reason string, train_split string, primary_metric string, "
    "secondary_metrics array<string>, poc_days int, production_days int",
    "report": "dataset string, use_case string, executive_summary string, assessment string, "
    "markdown string, prompt string",
    "findings": "dataset string, use_case string, kind string, seq int, text string",
}

STAGE_TABLES = {
    "profile": ("column_profile", "dataset_profile", "warnings", "type_distribution",
                "schema_coverage", "coverage_summary"),
    "readiness": ("requirement_match", "readiness_tier", "readiness", "field_lists", "recommendations", "risks"),
    "features": ("feature_correlation", "feature_pairs", "feature_mi", "feature_importance",
                 "transform_advice", "feature_summary", "feature_warnings"),
    "models": ("model_characteristics", "model_ranking", "strategy"),
    "report": ("report", "findings"),
}


PATHS = "dataset string, use_case string, kind string, path string"


def _error(problem: Exception) -> str:
    return f"error: {str(problem).splitlines()[0] if str(problem) else type(problem).__name__}"


def target_of(use_case: str) -> str:
    return TARGETS.get(use_case, OTHER_TARGET)


def analyse_features(
    df: DataFrame,
    target: str,
    task: str = "classification",
    dataset: str = "primary",
    mi: str = "knn",
    trees: int = features.TREES,
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[str, DataFrame]:
    """All feature tables of one dataset; without the target only the advice.

    Mutual information uses nearest neighbours, in the plane for a number target (``mi="knn"``),
    or bins.
    """
    advice = small_table(features.transform_advice(df))
    keyed = lambda table: table.select(F.lit(dataset).alias("dataset"), "*")
    spark = df.sparkSession
    if target not in df.columns:
        tables = {name: spark.createDataFrame([], EMPTY[name]) for name in STAGE_TABLES["features"]}
        text = f"No column '{target}': advice for columns only."
        rows = [(dataset, len(df.columns), 0, advice.count(), text)]
        tables["transform_advice"] = keyed(advice)
        tables["feature_summary"] = local_table(
            spark, rows, "dataset string, n_features int, n_pairs long, n_advice long, summary string"
        )
        return tables
    encoded = encode_features(df, rows_per_task)
    table = encoded.table.persist()
    try:
        pairs = small_table(features.high_correlation_pairs(table, target))
        importance = small_table(features.forest_importance(table, target, task, trees=trees))
        if task == "classification" and mi == "knn":
            scores = features.mutual_information_knn(table, target, rows_per_task=rows_per_task)
        elif mi == "knn":
            scores = features.mutual_information_regression(table, target, rows_per_task=rows_per_task)
        else:
            scores = features.mutual_information_binned(table, target, task, rows_per_task=rows_per_task)
        out = {
            "feature_correlation": small_table(features.target_correlation(table, target)),
            "feature_pairs": pairs,
            "feature_mi": small_table(scores),
            "feature_importance": importance,
            "transform_advice": advice,
            "feature_summary": features.feature_summary(dataset, len(df.columns) - 1, importance, pairs, advice),
        }
    finally:
        table.unpersist()
    left_out = [(dataset, c, why) for c, why in encoded.dropped.items()]
    out = {k: v if "dataset" in v.columns else keyed(v) for k, v in out.items()}
    out["feature_warnings"] = local_table(spark, left_out, "dataset string, column string, message string")
    return out


def discover(
    datasets: DataFrame | Datasets,
    use_case: str = "churn_prediction",
    task: str = "classification",
    target: str | None = None,
    multi_source: bool = False,
    requirements: DataFrame | None = None,
    expected: dict[str, list[str]] | None = None,
    output: str | None = None,
    generated_at: str | None = None,
    mode: str = "exact",
    mi: str = "knn",
    trees: int = features.TREES,
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[str, DataFrame]:
    """Run all stages and return their tables by name.

    A stage that fails for a dataset leaves nothing of it in that stage's tables
    and its error in ``run_status``; other datasets and stages still run. The
    results stay if report files cannot be written, which ``run_status`` then
    tells as stage ``files``. With ``multi_source`` the given tables count as parts
    of one dataset ``combined``; the target is looked for in each of them, and
    features are ranked over all. ``expected`` names the columns each dataset
    should have; only datasets named there have a schema coverage.
    """
    datasets = {"primary": datasets} if isinstance(datasets, DataFrame) else dict(datasets)
    spark = next(iter(datasets.values())).sparkSession
    target = target or target_of(use_case)
    when = generated_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    names = ["combined"] if multi_source else list(datasets)
    uses = local_table(spark, [(n, use_case) for n in names], "dataset string, use_case string")
    results: dict[str, DataFrame] = {}
    states: list[tuple[str, int, str, str]] = []

    def stage(name: str, work: Callable[[list[str]], dict[str, DataFrame]]) -> None:
        """Work on all datasets at once; if that fails, on each alone."""
        parts: list[dict[str, DataFrame]] = []
        errors: dict[str, str] = {}
        groups = [names]
        while groups:
            group = groups.pop(0)
            try:
                parts.append({k: small_table(v) for k, v in work(group).items()})
            except Exception as problem:  # noqa: BLE001 - any failure is recorded, the run goes on
                if len(group) > 1:
                    groups = [[n] for n in group]
                else:
                    errors[group[0]] = _error(problem)
        for table in {**dict.fromkeys(STAGE_TABLES[name]), **(parts[0] if parts else {})}:
            made = [p[table] for p in parts if table in p]
            results[table] = union_all(made) if made else spark.createDataFrame([], EMPTY[table])
        states.extend((n, list(STAGE_TABLES).index(name) + 1, name, errors.get(n, "success")) for n in names)

    def of(group: list[str], table: str) -> DataFrame:
        return results[table].where(F.col("dataset").isin(group))

    def profile_stage(group):
        if multi_source:
            found = profiles.profile_sources(datasets, "combined", mode)
        else:
            found = profiles.profile({n: datasets[n] for n in group}, mode)
        wanted = [("combined" if multi_source else n, c) for n, cs in (expected or {}).items() for c in cs]
        if wanted:
            rows = local_table(spark, [w for w in wanted if w[0] in group], "dataset string, column string")
            found["schema_coverage"] = small_table(profiles.schema_coverage(found["column_profile"], rows))
            found["coverage_summary"] = profiles.coverage_summary(found["schema_coverage"])
        return found

    def readiness_stage(group):
        catalogue = requirements if requirements is not None else catalog.requirements(spark)
        return readiness.readiness(
            of(group, "column_profile"), of(group, "dataset_profile"), uses.where(F.col("dataset").isin(group)), catalogue
        )

    def feature_stage(group):
        found = [
            analyse_features(df, target, task, "combined" if multi_source else n, mi, trees, rows_per_task)
            for n, df in datasets.items()
            if multi_source or n in group
        ]
        tables = {k: union_all([f[k] for f in found]) for k in STAGE_TABLES["features"]}
        for table, score in (("feature_mi", "mi_score"), ("feature_importance", "importance")):
            best = Window.partitionBy("dataset").orderBy(F.desc(score), "feature")  # a row per feature
            tables[table] = tables[table].withColumn("rank", F.row_number().over(best))
        return tables

    def pair_counts(group):
        return of(group, "feature_pairs").groupBy("dataset").agg(F.count(F.lit(1)).alias("n_high_corr_pairs"))

    def model_stage(group):
        return models.recommend(
            of(group, "column_profile"), of(group, "dataset_profile"), of(group, "readiness"),
            pair_counts(group), catalog.models(spark), task,
        )

    def report_stage(group):
        known = small_table(
            report.report_facts(
                of(group, "dataset_profile"), of(group, "warnings"), of(group, "type_distribution"),
                {k: of(group, k) for k in STAGE_TABLES["readiness"]},
                {k: of(group, k) for k in STAGE_TABLES["models"]},
                of(group, "feature_importance"), pair_counts(group), of(group, "transform_advice"),
            )
        )
        texts = report.summary(known).join(F.broadcast(report.markdown(known)), report.KEY)
        return {
            "report": texts.join(F.broadcast(report.prompts(known, task)), report.KEY),
            "findings": report.findings(known),
        }

    stage("profile", profile_stage)
    stage("readiness", readiness_stage)
    stage("features", feature_stage)
    stage("models", model_stage)
    stage("report", report_stage)

    results["metadata"] = report.run_metadata(uses, task, when)
    status = local_table(spark, states, "dataset string, seq int, stage string, status string")
    results["run_status"] = status
    if output:
        full = results["report"].select(*report.KEY, "markdown")
        if not full.head(1):
            full = report.minimal_markdown(_basics(uses, results), status, when)
        stamp = when.replace("-", "").replace(":", "").replace("T", "_").rstrip("Z")
        try:
            results["output_paths"] = save_reports(uses, dict(results), full, output, stamp)
        except Exception as problem:  # noqa: BLE001 - files that cannot be written leave the results intact
            results["output_paths"] = spark.createDataFrame([], PATHS)
            states.extend((n, len(STAGE_TABLES) + 1, "files", _error(problem)) for n in names)
            results["run_status"] = local_table(spark, states, "dataset string, seq int, stage string, status string")
    return results


def _basics(uses: DataFrame, results: dict[str, DataFrame]) -> DataFrame:
    """What the short report shows, as far as the stages got."""
    return (
        uses.join(F.broadcast(results["dataset_profile"]), "dataset", "left")
        .join(F.broadcast(results["readiness"].select(*report.KEY, "score", "bar")), report.KEY, "left")
        .join(F.broadcast(results["strategy"].select(*report.KEY, "primary_model")), report.KEY, "left")
    )
