"""Every operator as a query over the test tables: (spark, folder) -> DataFrame.

Numbers are rounded here, at the edge, so that two engines can be compared.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions import catalog
from plumbline.functions.fields import clean, fields_of, local_table, small_table, union_all
from plumbline.functions.text import file_suffix
from plumbline.operators import columns as cols
from plumbline.operators import datasets as sets
from plumbline.operators import encode, features, models, readiness, report
from plumbline.plans.discover import analyse_features, discover
from plumbline.session import run_folder
from plumbline.sources import excel, readers, samples
from plumbline.sources.sinks import save_reports

# Tables with holes, repeats and outliers, made from the given ones by value.
# The same text is valid in both engines.
DERIVED = {
    "events_holes": (
        "SELECT event_id, ts, CASE WHEN event_type NOT IN ('error', 'view') THEN user_id END AS user_id, "
        "event_type, CASE WHEN event_type <> 'error' THEN value END AS value, "
        "value * value * value AS value_cubed, props FROM events"
    ),
    "events_sparse": (
        "SELECT event_id, CASE WHEN event_type = 'click' THEN value END AS value, "
        "CASE WHEN event_type = 'view' THEN user_id END AS user_id FROM events"
    ),
    "lineitem_holes": (
        "SELECT l_quantity, l_extendedprice, NULLIF(l_discount, 0) AS l_discount, NULLIF(l_tax, 0) AS l_tax, "
        "l_linenumber, l_returnflag, l_linestatus, CAST(l_shipdate AS DATE) AS l_shipdate FROM lineitem"
    ),
    "lineitem_flags": "SELECT l_returnflag, l_linestatus FROM lineitem",
    "orders_text_dates": (
        "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)) AS o_orderdate, "
        "concat(lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0'), '/', "
        "lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), '/', CAST(year(o_orderdate) AS VARCHAR(4))) AS o_day_first, "
        "concat(substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), ' ', "
        "CAST(day(o_orderdate) AS VARCHAR(2)), ', ', CAST(year(o_orderdate) AS VARCHAR(4))) AS o_month_name, "
        "CAST(NULL AS VARCHAR(10)) AS o_comment, o_orderpriority FROM orders"
    ),
    "orders_written_dates": (
        "SELECT concat(CAST(day(o_orderdate) AS VARCHAR(2)), '-', "
        "substr('JanFebMarAprMayJunJulAugSepOctNovDec', CAST(3 * month(o_orderdate) - 2 AS INT), 3), '-', "
        "CAST(year(o_orderdate) AS VARCHAR(4))) AS o_month_between, "
        "concat(CAST(year(o_orderdate) AS VARCHAR(4)), lpad(CAST(month(o_orderdate) AS VARCHAR(2)), 2, '0'), "
        "lpad(CAST(day(o_orderdate) AS VARCHAR(2)), 2, '0')) AS o_compact, "
        "concat(CAST(day(o_orderdate) AS VARCHAR(2)), '.', CAST(month(o_orderdate) AS VARCHAR(2)), '.', "
        "CAST(year(o_orderdate) AS VARCHAR(4))) AS o_dotted, "
        "concat(CAST(CAST(o_orderdate AS DATE) AS VARCHAR(10)), 'T10:30:00', "
        "CASE WHEN o_orderkey % 2 = 0 THEN '+05:30' ELSE '-08:00' END) AS o_zoned, "
        "lpad(CAST(o_orderkey AS VARCHAR(8)), 8, '0') AS o_code, "
        "concat('31.', CAST(month(o_orderdate) AS VARCHAR(2)), '.2024') AS o_no_day FROM orders"
    ),
    "documents_text": "SELECT text FROM documents",
    "events_infinite": (
        "SELECT event_id, value, CASE WHEN event_type = 'error' THEN CAST('Infinity' AS DOUBLE) ELSE value END AS spoilt FROM events"
    ),
    "returns": (
        "SELECT CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS target, l_quantity, l_extendedprice, "
        "l_discount, l_tax, l_linenumber, l_extendedprice * (1 - l_discount) AS net_price, "
        "CASE WHEN l_discount < 0.05 THEN 0.0 ELSE l_discount END AS big_discount, 7 AS always, "
        "l_linestatus FROM lineitem"
    ),
    "prices": (
        "SELECT o_totalprice AS target, o_custkey, o_orderstatus, o_orderpriority, "
        "o_totalprice / 2 + o_custkey AS half_price FROM orders"
    ),
}

LIBRARY = ["orders", "events_holes", "events_sparse", "lineitem_flags", "documents", "labels", "conversations"]
TYPED = ["orders", "orders_text_dates", "events_holes", "documents", "labels", "part", "embeddings"]
SOURCES = ["documents", "labels", "conversations", "benchmark"]
EXPECTED = {
    "orders": ["o_orderkey", "o_custkey", "o_totalprice", "o_shippriority", "o_clerk"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
}
OWN_REQUIREMENTS = {
    "returns_review": {
        "critical": [("Order date", 30, ["ORDERDATE", "shipdate"]), ("Reason", 20, ["reason"])],
        "important": [],
        "nice": [("Price", 10, ["price"]), ("Text", 5, ["text", "props"])],
    }
}
GENERATED_AT = "2024-01-01T00:00:00Z"
RECORDS_PER_ARRAY = 1000


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A given table, or a derived one by its definition."""
    if name not in DERIVED:
        return spark.read.parquet(f"{folder}/{name}.parquet")
    body, base = DERIVED[name].rsplit(" FROM ", 1)
    return spark.sql(f"{body} FROM {{base}}", base=table(spark, folder, base))


def tables(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {name: table(spark, folder, name) for name in names}


def rounded(df: DataFrame, **digits: int) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c, n in digits.items()})


# ------------------------------------------------------------------ column profile


def profile_nulls(spark, folder):
    given = clean(tables(spark, folder, ["events_holes", "lineitem_holes", "events_sparse"]))
    typed = cols.typed_columns(cols.column_sums(given), cols.distinct_counts(given))
    return typed.select("dataset", "position", "column", "n_total", "n_null", "null_pct", "unique_ratio")


def profile_distinct(spark, folder):
    given = clean(tables(spark, folder, ["lineitem", "orders", "documents", "pages", "events_holes"]))
    sums = cols.per_column(given, fields_of(given), cols.count_measures)
    return sums.join(F.broadcast(cols.distinct_counts(given)), "id").select(
        "dataset", "column", "n_total", "n_unique"
    )


def profile_distinct_approx(spark, folder):
    """Approximate counts stay near the exact ones, and are exact when small."""
    given = clean(tables(spark, folder, ["lineitem", "events_holes"]))
    sums = cols.per_column(given, fields_of(given), cols.count_measures)
    exact = cols.distinct_counts(given).withColumnRenamed("n_unique", "exact")
    both = cols.distinct_counts(given, mode="approx").join(exact, "id").join(sums, "id")
    few = F.col("exact") <= cols.RECOUNT_LIMIT // 2
    near = F.abs(F.col("n_unique") - F.col("exact")) <= 0.2 * F.col("exact")
    return both.select(
        "dataset", "column",
        F.when(few, F.col("n_unique")).alias("small_count"),
        near.alias("is_near"),
    )


def profile_types(spark, folder):
    given = clean(tables(spark, folder, TYPED))
    typed = cols.typed_columns(cols.column_sums(given), cols.distinct_counts(given))
    return typed.select("dataset", "position", "column", "inferred_type", "n_unique")


def _numbers(spark, folder, names):
    given = clean(tables(spark, folder, names))
    fields = [f for f in fields_of(given) if f.kind in ("integer", "real")]
    return given, fields, small_table(cols.column_sums(given, fields))


def profile_numeric(spark, folder):
    given, fields, sums = _numbers(spark, folder, ["lineitem", "events_holes"])
    cuts = cols.quartiles(given, sums, fields)
    moments = cols.with_moments(sums.join(F.broadcast(cols.deviations(given, fields, sums)), "id"))
    out = moments.join(F.broadcast(cuts), "id").select(
        "dataset", "column", "min", "max", "mean", "median", "std", "skewness", "kurtosis"
    )
    return rounded(out, min=4, max=4, mean=4, median=4, std=4, skewness=4, kurtosis=4)


def profile_infinite(spark, folder):
    """Infinite values spoil the moments of their own column and no other."""
    profile = cols.column_profile(tables(spark, folder, ["events_infinite"]), values=False)
    out = profile.select("column", "n_total", "min", "max", "median", "q1", "q3", "n_outliers", "mean", "std", "skewness")
    return rounded(out, median=4, q1=4, q3=4, mean=4, std=4, skewness=4)


def profile_quartiles(spark, folder):
    given, fields, sums = _numbers(spark, folder, ["lineitem", "orders", "events_holes", "documents"])
    cuts = cols.quartiles(given, sums, fields)
    out = cols.with_fences(sums.join(F.broadcast(cuts), "id")).select(
        "dataset", "column", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence"
    )
    return rounded(out, q1=6, median=6, q3=6, iqr=6, lower_fence=6, upper_fence=6)


def outliers_iqr(spark, folder):
    given, fields, sums = _numbers(spark, folder, ["lineitem", "orders", "events_holes", "documents"])
    fenced = small_table(cols.with_fences(sums.join(F.broadcast(cols.quartiles(given, sums, fields)), "id")))
    beyond = cols.deviations(given, fields, fenced).select("id", "n_outliers")
    n = F.col("n_total") - F.col("n_null")
    return fenced.join(F.broadcast(beyond), "id").select(
        "dataset", "column", "n_outliers",
        F.round(100.0 * F.col("n_outliers") / n, 2).alias("pct_outliers"),
    )


def _listed(spark, folder):
    given = clean(tables(spark, folder, ["orders", "events_holes", "documents", "labels", "part", "pages"]))
    fields = [f for f in fields_of(given) if f.kind in ("integer", "string")]
    typed = cols.typed_columns(cols.column_sums(given, fields), cols.distinct_counts(given, fields))
    listed = typed.where(F.col("inferred_type").isin("boolean", "categorical_low", "categorical_high"))
    ids = {r.id for r in listed.select("id").collect()}  # a row per column
    return cols.top_values(given, [f for f in fields if f.id in ids])


def top_values(spark, folder):
    return _listed(spark, folder).select("dataset", "column", "rank", "value", "n")


def column_mode(spark, folder):
    return _listed(spark, folder).where("rank = 1").select("dataset", "column", F.col("value").alias("mode"))


def date_range(spark, folder):
    given = clean(tables(spark, folder, ["orders", "events_holes", "lineitem_holes", "orders_text_dates"]))
    fields = [f for f in fields_of(given) if f.name in ("o_orderdate", "o_day_first", "o_month_name", "ts", "l_shipdate")]
    return cols.column_sums(given, fields).select("dataset", "column", "date_min", "date_max")


def date_spellings(spark, folder):
    """Days in other spellings, times with zones, and texts that only look like days."""
    given = clean(tables(spark, folder, ["orders_written_dates", "orders_text_dates"]))
    found = cols.column_sums(given, [f for f in fields_of(given) if f.kind == "string"])
    days = [F.when(F.col("date_like"), F.col(c)).alias(c) for c in ("date_min", "date_max")]
    return found.select("dataset", "column", "date_like", *days)


def column_profile(spark, folder):
    """All blocks of the profile, as the inferred type allows them."""
    profile = cols.column_profile(tables(spark, folder, ["orders", "events_holes", "labels"]))
    out = profile.select(
        "dataset", "position", "column", "dtype", "inferred_type", "n_total", "n_null", "null_pct",
        "n_unique", "unique_ratio", "min", "max", "mean", "median", "std", "skewness", "kurtosis",
        "q1", "q3", "n_outliers", "pct_outliers", "mode", "date_min", "date_max",
    )
    return rounded(out, min=4, max=4, mean=4, median=4, std=4, skewness=4, kurtosis=4, q1=4, q3=4)


# ----------------------------------------------------------------- dataset profile


def _library(spark, folder, names=None, values=False):
    given = tables(spark, folder, names or LIBRARY)
    columns = cols.column_profile(given, values=values)
    return columns, small_table(sets.dataset_profile(columns, sets.duplicate_rows(given)))


def dataset_summary(spark, folder):
    given = clean(tables(spark, folder, ["events_holes", "lineitem_holes", "documents", "embeddings"]))
    return sets.dataset_totals(cols.column_sums(given)).select(
        "dataset", "n_rows", "n_cols", "overall_null_pct", "size_mb"
    )


def duplicate_rows(spark, folder):
    return sets.duplicate_rows(
        tables(spark, folder, ["lineitem", "lineitem_flags", "documents_text", "events_sparse", "embeddings"])
    )


def _plain_totals(spark, folder, names):
    """Column and dataset tables as far as null and duplicate rules need them."""
    given = clean(tables(spark, folder, names))
    sums = cols.per_column(
        given, fields_of(given), lambda f: {**cols.count_measures(f), **cols.size_measures(f)}
    )
    null_pct = F.round(100.0 * F.col("n_null") / F.col("n_total"), 2)
    sums = small_table(sums.withColumn("null_pct", null_pct))
    return sums, small_table(sets.dataset_profile(sums, sets.duplicate_rows(given)))


def profile_warnings(spark, folder):
    names = ["events_holes", "events_sparse", "lineitem_flags", "embeddings", "documents_text"]
    return sets.warnings(*_plain_totals(spark, folder, names))


def type_distribution(spark, folder):
    given = clean(tables(spark, folder, TYPED))
    typed = cols.typed_columns(cols.column_sums(given), cols.distinct_counts(given))
    return sets.type_distribution(typed)


def _coverage(spark, folder):
    given = clean(tables(spark, folder, list(EXPECTED)))
    sums = cols.per_column(given, fields_of(given), cols.count_measures)
    rows = [(d, c) for d, names in EXPECTED.items() for c in names]
    return sets.schema_coverage(sums, local_table(spark, rows, "dataset string, column string"))


def schema_coverage(spark, folder):
    return _coverage(spark, folder)


def coverage_summary(spark, folder):
    return sets.coverage_summary(_coverage(spark, folder))


def source_profiles(spark, folder):
    """Several sources as one dataset: totals over all of them."""
    combined = sets.profile_sources(tables(spark, folder, SOURCES))["dataset_profile"]
    return combined.select("dataset", "n_rows", "n_cols", "n_duplicate_rows", "overall_null_pct", "multi_source")


def source_relationships(spark, folder):
    given = clean(tables(spark, folder, SOURCES))
    sums = cols.per_column(given, fields_of(given), cols.count_measures)
    return sets.relationships(sums, SOURCES).select(
        "source_a", "source_b", F.array_join("shared_columns", ",").alias("shared_columns"),
        "likely_join_key", "rows_a", "rows_b",
    )


# ----------------------------------------------------------------------- readiness


def _uses(spark, names, use_cases=None):
    rows = [(d, u) for d in names for u in (use_cases or [*catalog.REQUIREMENTS, "sales_forecasting"])]
    return local_table(spark, rows, "dataset string, use_case string")


def _sums(spark, folder, names):
    given = clean(tables(spark, folder, names))
    return cols.per_column(given, fields_of(given), cols.count_measures)


def readiness_match(spark, folder):
    """Which column meets which requirement, and how full that column is."""
    sums = small_table(_sums(spark, folder, LIBRARY))
    matches = readiness.match_requirements(sums, _uses(spark, LIBRARY), catalog.requirements(spark))
    full = sums.select("dataset", F.lower("column").alias("matched_column"),
                       (F.col("n_total") - F.col("n_null")).alias("n_values"))
    return matches.join(F.broadcast(full), ["dataset", "matched_column"], "left")


def readiness_custom(spark, folder):
    """The same rules with requirements of one's own."""
    names = ["orders", "lineitem_holes", "events_holes"]
    uses = _uses(spark, names, list(OWN_REQUIREMENTS))
    own = catalog.requirements(spark, OWN_REQUIREMENTS)
    matches = readiness.match_requirements(_sums(spark, folder, names), uses, own)
    return readiness.tier_scores(uses, matches)


def readiness_tiers(spark, folder):
    uses = _uses(spark, LIBRARY)
    matches = readiness.match_requirements(_sums(spark, folder, LIBRARY), uses, catalog.requirements(spark))
    return readiness.tier_scores(uses, matches)


def _readiness(spark, folder):
    columns, totals = _library(spark, folder)
    return readiness.readiness(columns, totals, _uses(spark, LIBRARY), catalog.requirements(spark))


def readiness_score(spark, folder):
    return _readiness(spark, folder)["readiness"].select(
        "dataset", "use_case", "raw_score", "quality_penalty", "score", "band"
    )


def readiness_bar(spark, folder):
    return _readiness(spark, folder)["readiness"].select("dataset", "use_case", "bar")


def readiness_gaps(spark, folder):
    uses = _uses(spark, LIBRARY)
    matches = readiness.match_requirements(_sums(spark, folder, LIBRARY), uses, catalog.requirements(spark))
    lists = readiness.field_lists(uses, matches)
    return lists.select(
        "dataset", "use_case", *[F.array_join(c, "|").alias(c) for c in lists.columns if c not in report.KEY]
    )


def quality_penalty(spark, folder):
    return readiness.quality_penalty(*_library(spark, folder))


def readiness_recommendations(spark, folder):
    return _readiness(spark, folder)["recommendations"]


def readiness_risks(spark, folder):
    return _readiness(spark, folder)["risks"]


# ------------------------------------------------------------------------ features


def label_encode(spark, folder):
    return encode.label_encode(table(spark, folder, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


def label_encode_many(spark, folder):
    """Codes of columns with a value per row or nearly so, texts included."""
    given = table(spark, folder, "customer").select("c_custkey", "c_name", "c_mktsegment")
    return encode.label_encode(given)


def median_impute(spark, folder):
    given = table(spark, folder, "events_holes").select("event_id", "user_id", "value")
    return encode.median_impute(given).table


def encode_features(spark, folder):
    given = table(spark, folder, "events_holes").drop("props")
    return rounded(encode.encode_features(given).table, ts=3, value_cubed=3)


def _encoded(spark, folder, name):
    return encode.encode_features(table(spark, folder, name)).table


def target_correlation(spark, folder):
    out = features.target_correlation(_encoded(spark, folder, "returns"), "target")
    return rounded(out, pearson_r=6, abs_r=6)


def high_correlation_pairs(spark, folder):
    out = features.high_correlation_pairs(_encoded(spark, folder, "returns"), "target")
    return rounded(out, correlation=6)


def mutual_information_binned(spark, folder):
    out = features.mutual_information_binned(_encoded(spark, folder, "returns"), "target")
    return rounded(out.select("feature", "mi_score"), mi_score=6)


def mutual_information_regression(spark, folder):
    out = features.mutual_information_binned(_encoded(spark, folder, "prices"), "target", "regression")
    return rounded(out, mi_score=5)


def mutual_information_knn(spark, folder):
    """Nearest-neighbour scores of two continuous features, without jitter."""
    given = table(spark, folder, "returns").select("target", "l_extendedprice", "net_price")
    out = features.mutual_information_knn(encode.encode_features(given).table, "target", jitter=0.0)
    return rounded(out.select("feature", "mi_score"), mi_score=4)


def mutual_information_knn_all(spark, folder):
    """All features of the return flag, ties broken by jitter."""
    return features.mutual_information_knn(_encoded(spark, folder, "returns"), "target")


def mutual_information_regression_knn(spark, folder):
    """Parts' retail price and their size, brand and type, by neighbours in the plane."""
    given = table(spark, folder, "part").select("p_partkey", "p_size", "p_brand", "p_type", "p_retailprice")
    encoded = encode.encode_features(given).table.withColumn("p_partkey", F.col("p_partkey").cast("long"))
    out = features.mutual_information_regression(encoded, "p_retailprice", row_key="p_partkey")
    return rounded(out, mi_score=5)


def forest_importance(spark, folder):
    """Orders above a price against all other columns, 100 trees."""
    return features.forest_importance(_encoded(spark, folder, "prices").withColumn(
        "target", (F.col("target") > 250000).cast("double")
    ), "target")


def forest_importance_regression(spark, folder):
    return features.forest_importance(_encoded(spark, folder, "prices"), "target", "regression")


def forest_best(spark, folder):
    """What holds for any good forest: all features ranked, shares of 1, the telling feature first."""
    prices = _encoded(spark, folder, "prices")
    dear = prices.withColumn("target", (F.col("target") > 250000).cast("double"))
    found = [
        features.forest_importance(table, "target", task, trees=20).agg(
            F.lit(task).alias("task"), F.count(F.lit(1)).alias("n_ranked"),
            F.round(F.sum("importance"), 3).alias("total"), F.min_by("feature", "rank").alias("best"),
        )
        for task, table in (("classification", dear), ("regression", prices))
    ]
    return union_all(found)


def scan_json_columns(spark, folder):
    """JSON by column, as data frames are often saved: {"c_name": {"0": ..., "1": ...}, ...}, a file per batch."""
    given = table(spark, folder, "customer").withColumn("batch", F.floor(F.col("c_custkey") / RECORDS_PER_ARRAY))
    place = F.row_number().over(Window.partitionBy("batch").orderBy("c_custkey")) - 1
    given = given.withColumn("place", place.cast("string"))
    names = ["c_custkey", "c_name", "c_acctbal"]
    cells = [F.map_from_entries(F.collect_list(F.struct("place", c))).alias(c) for c in names]
    path = f"{run_folder(spark, 'scan')}.json"
    made = given.groupBy("batch").agg(*cells).select("batch", F.to_json(F.struct(*names)).alias("value"))
    made.write.partitionBy("batch").text(path)
    return readers.load_json(spark, path, recursiveFileLookup=True)


def _advice(spark, folder, section):
    names = ["returns", "events_holes", "lineitem_holes", "part"]
    parts = [
        features.transform_advice(df).select(F.lit(name).alias("dataset"), "section", "column", F.posexplode("suggestions").alias("seq", "suggestion"))
        for name, df in tables(spark, folder, names).items()
    ]
    return union_all(parts).where(F.col("section") == section).drop("section")


def transform_advice_numeric(spark, folder):
    return _advice(spark, folder, 1)


def transform_advice_categorical(spark, folder):
    return _advice(spark, folder, 2)


# -------------------------------------------------------------------------- models

MODEL_DATA = ["orders", "events_holes", "labels", "returns"]


def _model_inputs(spark, folder):
    """Profile, readiness and correlated pairs, as models are chosen by them."""
    columns, totals = _library(spark, folder, MODEL_DATA, values=True)
    uses = _uses(spark, MODEL_DATA)
    matches = readiness.match_requirements(columns, uses, catalog.requirements(spark))
    raw = readiness.raw_scores(readiness.tier_scores(uses, matches))
    scored = readiness.scores(uses, raw, readiness.quality_penalty(columns, totals))
    pairs = features.high_correlation_pairs(_encoded(spark, folder, "returns"), "target")
    counts = pairs.agg(F.lit("returns").alias("dataset"), F.count(F.lit(1)).alias("n_high_corr_pairs"))
    return columns, totals, small_table(scored), small_table(counts), catalog.models(spark)


def _models(spark, folder):
    return models.recommend(*_model_inputs(spark, folder))


def model_characteristics(spark, folder):
    return _models(spark, folder)["model_characteristics"]


def model_scores(spark, folder):
    inputs = _model_inputs(spark, folder)
    both = [
        models.recommend(*inputs, task)["model_ranking"].select(
            "dataset", "use_case", F.lit(task).alias("task"), "model_key", "score", "rank"
        )
        for task in ("classification", "regression")
    ]
    return union_all(both)


def model_top3(spark, folder):
    top = models.top_models(_models(spark, folder)["model_ranking"])
    return top.select("dataset", "use_case", "rank", "model_key", "model_name", "poc_days", "production_days", "rationale")


def strategy(spark, folder):
    out = _models(spark, folder)["strategy"]
    return out.withColumn("secondary_metrics", F.array_join("secondary_metrics", ", "))


# ------------------------------------------------------------------------- reports


def _facts(spark, folder):
    """Report facts with the stages that a SQL engine can follow."""
    columns, totals = _library(spark, folder, MODEL_DATA, values=True)
    uses = _uses(spark, MODEL_DATA)
    ready = readiness.readiness(columns, totals, uses, catalog.requirements(spark))
    encoded = _encoded(spark, folder, "returns")
    pairs = features.high_correlation_pairs(encoded, "target")
    counts = pairs.agg(F.lit("returns").alias("dataset"), F.count(F.lit(1)).alias("n_high_corr_pairs"))
    scores = features.mutual_information_binned(encoded, "target").select(F.lit("returns").alias("dataset"), "rank", "feature")
    advice = features.transform_advice(table(spark, folder, "returns")).select(F.lit("returns").alias("dataset"), "*")
    counts, scores, advice = small_table(counts), small_table(scores), small_table(advice)
    chosen = models.recommend(columns, totals, ready["readiness"], counts, catalog.models(spark))
    return small_table(
        report.report_facts(
            totals, sets.warnings(columns, totals), sets.type_distribution(columns),
            ready, chosen, scores, counts, advice,
        )
    )


def report_summary(spark, folder):
    return report.summary(_facts(spark, folder))


def report_findings(spark, folder):
    return report.findings(_facts(spark, folder))


def report_markdown(spark, folder):
    return report.markdown(_facts(spark, folder))


def report_minimal(spark, folder):
    facts = _facts(spark, folder).select("dataset", "use_case", "n_rows", "n_cols", "overall_null_pct", "score", "bar")
    stages = [(d, i, s, "success" if i < 3 else "error: out of reach")
              for d in MODEL_DATA for i, s in enumerate(["profile", "readiness", "features"], start=1)]
    status = local_table(spark, stages, "dataset string, seq int, stage string, status string")
    return report.minimal_markdown(facts, status, GENERATED_AT)


def report_files(spark, folder):
    """Write the reports and read them back: first Markdown line, JSON score."""
    facts = _facts(spark, folder)
    uses = facts.select("dataset", "use_case")
    written = save_reports(
        uses, {"readiness": facts.select("dataset", "use_case", "score")}, report.markdown(facts),
        run_folder(spark, "reports"), "20240101_000000",
    )
    roots = {r.kind: r.path.rsplit("/dataset=", 1)[0] for r in written.limit(2).collect()}
    texts = spark.read.text(roots["markdown"], wholetext=True)
    titles = texts.select("dataset", "use_case", F.split_part("value", F.lit("\n"), F.lit(1)).alias("title"))
    jsons = spark.read.text(roots["json"], wholetext=True)
    scores = jsons.select("dataset", "use_case", F.get_json_object("value", "$.readiness[0].score").cast("double").alias("score"))
    return titles.join(scores, ["dataset", "use_case"])


def prompt_render(spark, folder):
    return report.prompts(_facts(spark, folder))


def run_metadata(spark, folder):
    """Metadata per dataset, with the rows it speaks of."""
    totals = sets.dataset_totals(
        cols.per_column(
            clean(tables(spark, folder, LIBRARY)), fields_of(clean(tables(spark, folder, LIBRARY))),
            lambda f: {**cols.count_measures(f), **cols.size_measures(f)},
        )
    )
    meta = report.run_metadata(_uses(spark, LIBRARY, ["fraud_detection"]), "classification", GENERATED_AT)
    return meta.join(totals.select("dataset", "n_rows"), "dataset")


# the text as the inside of a JSON string that also fits between code fences
JSON_TEXT = (
    "translate(replace(replace(text, chr(92), concat(chr(92), chr(92))), '\"', concat(chr(92), '\"')), "
    "concat(chr(9), chr(10), chr(13), '`'), '    ')"
)
REPLY = (
    "CASE role "
    f"WHEN 'user' THEN concat('Sure: {{\"executive_summary\": \"', {JSON_TEXT}, '\", \"key_findings\": [\"turn ', turn, "
    f"'\", \"', {JSON_TEXT}, '\"], \"top_opportunities\": \"only one\", \"full_report\": \"r\"}} Done.') "
    f"WHEN 'assistant' THEN concat('{{broken', chr(10), '```json', chr(10), '{{\"executive_summary\": \"fenced ', turn, "
    f"'\", \"recommended_next_steps\": [\"', {JSON_TEXT}, '\", \"b\"]}}', chr(10), '```') "
    "ELSE replace(replace(text, '{', '('), '}', ')') END"
)


def response_extract(spark, folder):
    replies = table(spark, folder, "conversations").selectExpr("conv_id", "turn", f"{REPLY} AS reply")
    out = report.extract_replies(replies)
    lists = ("key_findings", "top_opportunities", "recommended_next_steps")
    return out.withColumns({c: F.array_join(c, "|") for c in lists})


# ------------------------------------------------------------------ sources, sinks


def scan_detect(spark, folder):
    """Rows per file format, told from the name of the file each row came from."""
    parts = [
        table(spark, folder, name).select(F.lit(name).alias("dataset"), file_suffix(F.input_file_name()).alias("format"))
        for name in ("orders", "lineitem", "events", "documents")
    ]
    return union_all(parts).groupBy("dataset", "format").agg(F.count(F.lit(1)).alias("n_rows"))


def _round_trip(spark, folder, name, fmt):
    given = table(spark, folder, name)
    path = f"{run_folder(spark, 'scan')}.{fmt}"
    writer = given.write.option("header", True) if fmt == "csv" else given.write
    writer.format(fmt).save(path)
    return readers.load(spark, path)


def scan_roundtrip_csv(spark, folder):
    return _round_trip(spark, folder, "customer", "csv")


def scan_csv_missing(spark, folder):
    """Missing values in several spellings; the numbers stay numbers."""
    spelled = table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.when(F.col("l_returnflag") == "A", F.lit("N/A")).otherwise(F.col("l_quantity").cast("string")).alias("l_quantity"),
        F.when(F.col("l_linestatus") == "F", F.lit("null")).otherwise(F.col("l_returnflag")).alias("l_returnflag"),
        F.when(F.col("l_tax") == 0, F.lit("NaN")).otherwise(F.col("l_tax").cast("string")).alias("l_tax"),
    )
    path = f"{run_folder(spark, 'scan')}.csv"
    spelled.write.option("header", True).csv(path)
    return readers.load(spark, path).groupBy("l_returnflag").agg(
        F.count(F.lit(1)).alias("n"), F.count("l_quantity").alias("n_quantity"),
        F.round(F.sum("l_quantity"), 2).alias("sum_quantity"), F.count("l_tax").alias("n_tax"),
        F.max("l_orderkey").alias("max_orderkey"),
    )


def scan_roundtrip_json(spark, folder):
    return _round_trip(spark, folder, "part", "json")


def scan_json_array(spark, folder):
    """JSON written as arrays of records, a file per batch of supplier numbers."""
    path = f"{run_folder(spark, 'scan')}.json"
    _write_arrays(table(spark, folder, "supplier"), "s_suppkey", path)
    return readers.load_json(spark, path, recursiveFileLookup=True)


def _write_arrays(given, key, path):
    """One file with one array per RECORDS_PER_ARRAY values of a unique key."""
    batch = F.floor(F.col(key) / RECORDS_PER_ARRAY).alias("batch")
    arrays = given.groupBy(batch).agg(F.to_json(F.collect_list(F.struct(*given.columns))).alias("value"))
    arrays.write.mode("append").partitionBy("batch").text(path)


def scan_json_mixed(spark, folder):
    """A folder with files of lines and files of arrays: all records of both."""
    given = table(spark, folder, "part")
    path = f"{run_folder(spark, 'scan')}.json"
    as_line = F.col("p_partkey") % 3 == 0
    given.where(as_line).withColumn("batch", F.lit(-1)).write.partitionBy("batch").json(path)
    _write_arrays(given.where(~as_line), "p_partkey", path)
    return readers.load_json(spark, path, recursiveFileLookup=True)


def scan_csv_quoted(spark, folder):
    """Whole texts with doubled quotes and line breaks."""
    path = f"{run_folder(spark, 'scan')}.csv"
    keep = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    quoted_text = F.concat(F.lit('"'), "text", F.lit('"\n,'), "source").alias("text")
    given = table(spark, folder, "documents").select("doc_id", quoted_text, "n_chars")
    given.write.options(header=True, escape='"', **keep).csv(path)
    return readers.load(spark, path)


def scan_roundtrip_parquet(spark, folder):
    return _round_trip(spark, folder, "orders", "parquet")


def scan_roundtrip_xlsx(spark, folder):
    """Customers packed into workbooks in tasks, and read back from their bytes."""
    given = table(spark, folder, "customer")
    books = excel.pack_workbooks(given)
    return excel.read_excel(books).select(
        F.col("c_custkey").cast("bigint"), "c_name", F.col("c_nationkey").cast("int"),
        F.col("c_acctbal").cast("double"), "c_mktsegment",
    )


def _ids(spark, folder, name, key):
    return table(spark, folder, name).select((F.col(key) + 1).alias("id"))


def sample_churn(spark, folder):
    """One sample customer for each real one."""
    return samples.churn(_ids(spark, folder, "customer", "c_custkey"))


def sample_fraud(spark, folder):
    """One sample payment for each order."""
    return samples.fraud(_ids(spark, folder, "orders", "o_orderkey"))


def sample_sales(spark, folder):
    """One sample sale for each event."""
    return samples.sales(_ids(spark, folder, "events", "event_id"))


# ------------------------------------------------------------------- the whole run


def discover_orders(spark, folder):
    """All stages over the orders; one line per table with its number of rows."""
    found = discover(
        table(spark, folder, "prices"), "order_value", "regression", target="target", generated_at=GENERATED_AT, trees=20
    )
    counts = [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows")) for name, t in found.items()]
    return union_all(counts)


def discover_stages(spark, folder):
    """A run whose feature stage has no target: advice only, the rest complete."""
    found = discover(table(spark, folder, "events_holes"), "fraud_detection", generated_at=GENERATED_AT)
    return found["run_status"].join(found["feature_summary"].select("dataset", "n_features", "n_pairs"), "dataset")


def discover_sources(spark, folder):
    """Several tables as one dataset."""
    found = discover(tables(spark, folder, SOURCES), "fraud_detection", multi_source=True, generated_at=GENERATED_AT)
    return found["readiness"].select("dataset", "use_case", "raw_score", "quality_penalty", "score", "band")


def feature_tables(spark, folder):
    """The feature stage on its own, rows per table."""
    found = analyse_features(table(spark, folder, "returns"), "target", mi="binned", trees=20)
    counts = [t.agg(F.lit(name).alias("table"), F.count(F.lit(1)).alias("n_rows")) for name, t in found.items()]
    return union_all(counts)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        profile_nulls, profile_distinct, profile_distinct_approx, profile_types, profile_numeric,
        profile_infinite, profile_quartiles, outliers_iqr, top_values, column_mode, date_range, date_spellings, column_profile,
        dataset_summary, duplicate_rows, profile_warnings, type_distribution, schema_coverage,
        coverage_summary, source_profiles, source_relationships,
        readiness_match, readiness_custom, readiness_tiers, readiness_score, readiness_bar,
        readiness_gaps, quality_penalty, readiness_recommendations, readiness_risks,
        label_encode, label_encode_many, median_impute, encode_features, target_correlation,
        high_correlation_pairs, mutual_information_binned, mutual_information_regression,
        mutual_information_knn, mutual_information_knn_all, mutual_information_regression_knn, forest_importance,
        forest_importance_regression, forest_best, transform_advice_numeric, transform_advice_categorical,
        model_characteristics, model_scores, model_top3, strategy,
        report_summary, report_findings, report_markdown, report_minimal, report_files,
        prompt_render, run_metadata, response_extract,
        scan_detect, scan_roundtrip_csv, scan_csv_missing, scan_csv_quoted, scan_roundtrip_json, scan_json_array, scan_json_mixed,
        scan_json_columns,
        scan_roundtrip_parquet, scan_roundtrip_xlsx, sample_churn, sample_fraud, sample_sales,
        discover_orders, discover_stages, discover_sources, feature_tables,
    )
}
