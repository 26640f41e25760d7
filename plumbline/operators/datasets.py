"""Dataset profile: totals, duplicate rows, warnings, coverage, relationships."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from plumbline.functions.fields import (
    Datasets,
    clean,
    column,
    kind_of,
    local_table,
    small_table,
    union_all,
)
from plumbline.functions.numbers import percent
from plumbline.operators.columns import column_profile

# Fixed value: null percentage above which a column is reported.
HIGH_NULL_PCT = 20


def dataset_totals(columns: DataFrame) -> DataFrame:
    """Row, column, null and byte totals of each dataset, from its column rows.

    Works on ``column_sums`` as well as on a finished column profile.
    """
    return (
        columns.groupBy("dataset")
        .agg(
            F.max("n_total").alias("n_rows"),
            F.count(F.lit(1)).alias("n_cols"),
            F.sum("n_null").alias("n_null_cells"),
            F.sum("n_total").alias("n_cells"),
            F.sum("n_bytes").alias("n_bytes"),
        )
        .select(
            "dataset",
            "n_rows",
            "n_cols",
            F.round(percent(F.col("n_null_cells"), F.col("n_cells")), 2).alias("overall_null_pct"),
            F.round(F.col("n_bytes") / F.lit(1e6), 3).alias("size_mb"),
            "n_null_cells",
            "n_cells",
        )
    )


def duplicate_rows(datasets: Datasets) -> DataFrame:
    """(dataset, n_duplicate_rows): rows equal to an earlier one, NULL equal to NULL.

    Equal rows are counted before the shuffle, so a row repeated a billion times
    costs one record per task; long texts travel as digests.
    """
    parts = []
    for name, df in clean(datasets).items():
        groups = df.groupBy(*_row_key(df)).agg(F.count(F.lit(1)).alias("copies"))
        parts.append(
            groups.agg(
                F.lit(name).alias("dataset"),
                F.coalesce(F.sum(F.col("copies") - 1), F.lit(0)).alias("n_duplicate_rows"),
            )
        )
    return union_all(parts)


def _row_key(df: DataFrame) -> list[Column]:
    key = []
    for i, field in enumerate(df.schema.fields):
        value, kind = column(field.name), kind_of(field.dataType)
        if kind == "string":
            value = F.when(F.length(value) > 64, F.concat(F.sha2(value, 256), F.lit("#"))).otherwise(value)
        elif kind == "other" and "map<" in field.dataType.simpleString():
            value = F.to_json(F.struct(value))  # maps cannot be compared
        key.append(value.alias(f"k{i}"))
    return key


def dataset_profile(
    columns: DataFrame, duplicates: DataFrame, multi_source: bool = False
) -> DataFrame:
    return (
        dataset_totals(columns)
        .join(F.broadcast(duplicates), "dataset", "left")
        .withColumn("multi_source", F.lit(multi_source))
        .select(
            "dataset", "n_rows", "n_cols", "size_mb", "n_duplicate_rows",
            "overall_null_pct", "multi_source", "n_null_cells", "n_cells",
        )
    )


def profile(datasets: Datasets, mode: str = "exact", multi_source: bool = False) -> dict[str, DataFrame]:
    """Column profile, dataset profile, warnings and type counts of all datasets."""
    columns = column_profile(datasets, mode)
    totals = small_table(dataset_profile(columns, duplicate_rows(datasets), multi_source))
    return {
        "column_profile": columns,
        "dataset_profile": totals,
        "warnings": warnings(columns, totals),
        "type_distribution": type_distribution(columns),
    }


def warnings(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """Numbered warnings: unprofiled columns, then high nulls, then duplicates."""
    unprofiled = columns.where(F.col("kind") == "other").select(
        "dataset",
        F.lit(1).alias("section"),
        F.col("position").alias("item"),
        "column",
        F.lit("unprofiled").alias("kind"),
        F.format_string("Column '%s' of type %s has null counts only", "column", "dtype").alias("message"),
    )
    nulls = columns.where(F.col("null_pct") > HIGH_NULL_PCT).select(
        "dataset",
        F.lit(2).alias("section"),
        F.col("position").alias("item"),
        "column",
        F.lit("high_nulls").alias("kind"),
        F.format_string("Column '%s' is %.2f%% null", "column", "null_pct").alias("message"),
    )
    copies = totals.where("n_duplicate_rows > 0").select(
        "dataset",
        F.lit(3).alias("section"),
        F.lit(0).alias("item"),
        F.lit(None).cast("string").alias("column"),
        F.lit("duplicates").alias("kind"),
        F.format_string(
            "%d duplicate rows (%.1f%%)",
            "n_duplicate_rows",
            F.round(percent(F.col("n_duplicate_rows"), F.col("n_rows")), 1),
        ).alias("message"),
    )
    order = Window.partitionBy("dataset").orderBy("section", "item")
    return (
        union_all([unprofiled, nulls, copies])
        .withColumn("seq", F.row_number().over(order))
        .select("dataset", "seq", "column", "kind", "message")
    )


def type_distribution(columns: DataFrame) -> DataFrame:
    return columns.groupBy("dataset", "inferred_type").agg(F.count(F.lit(1)).alias("n_columns"))


# ------------------------------------------------------------ expected columns


def schema_coverage(columns: DataFrame, expected: DataFrame) -> DataFrame:
    """Each expected or actual column as present, missing or extra.

    ``expected`` has (dataset, column). Datasets without any expected column
    have no metadata to compare with and are left out.
    """
    described = expected.select("dataset").distinct()
    actual = columns.select("dataset", "column", "n_total", "n_null").join(
        F.broadcast(described), "dataset", "left_semi"
    )
    wanted = expected.select("dataset", "column").distinct().withColumn("wanted", F.lit(True))
    return wanted.join(actual, ["dataset", "column"], "full_outer").select(
        "dataset",
        "column",
        F.when(F.col("n_total").isNull(), "missing")
        .when(F.col("wanted").isNull(), "extra")
        .otherwise("present")
        .alias("status"),
        (F.col("n_total") - F.col("n_null")).alias("n_values"),
    )


def coverage_summary(coverage: DataFrame) -> DataFrame:
    is_status = lambda s: F.count_if(F.col("status") == s)
    return (
        coverage.groupBy("dataset")
        .agg(
            F.count_if(F.col("status") != "extra").alias("expected_columns"),
            is_status("present").alias("present_columns"),
            is_status("missing").alias("missing_columns"),
            is_status("extra").alias("extra_columns"),
        )
        .withColumn(
            "coverage_pct",
            F.when(F.col("expected_columns") == 0, 100.0).otherwise(
                F.round(percent(F.col("present_columns"), F.col("expected_columns")), 1)
            ),
        )
    )


# ------------------------------------------------------------- several sources


def relationships(columns: DataFrame, sources: Sequence[str]) -> DataFrame:
    """Pairs of sources that share column names, and the likeliest join column.

    ``sources`` fixes which of a pair comes first. Only column names meet here:
    an equi-join on the name, as wide as the schemas.
    """
    spark = columns.sparkSession
    order = local_table(spark, list(enumerate(sources)), "source_pos int, dataset string")
    named = columns.join(F.broadcast(order), "dataset").select(
        "column", F.col("dataset").alias("source"), "source_pos", "n_total"
    )
    first = named.select("column", F.col("source").alias("source_a"),
                         F.col("source_pos").alias("pos_a"), F.col("n_total").alias("rows_a"))
    second = named.select("column", F.col("source").alias("source_b"),
                          F.col("source_pos").alias("pos_b"), F.col("n_total").alias("rows_b"))
    return (
        first.join(second, "column")
        .where("pos_a < pos_b")
        .groupBy("source_a", "source_b")
        .agg(
            F.array_sort(F.collect_set("column")).alias("shared_columns"),
            F.min("column").alias("likely_join_key"),
            F.max("rows_a").alias("rows_a"),
            F.max("rows_b").alias("rows_b"),
        )
    )


def profile_sources(
    datasets: Datasets, name: str = "combined", mode: str = "exact"
) -> dict[str, DataFrame]:
    """Profile several sources and treat them as one dataset called ``name``.

    Totals add up over the sources; the columns of all sources stay in the
    profile, each numbered on from the source before.
    """
    each = profile(datasets, mode, multi_source=True)
    columns, totals = each["column_profile"], each["dataset_profile"]
    start, starts = 0, {}
    for source, df in datasets.items():
        starts[source] = start
        start += len(df.columns)
    spark: SparkSession = columns.sparkSession
    offsets = local_table(spark, list(starts.items()), "dataset string, offset int")
    combined = (
        columns.join(F.broadcast(offsets), "dataset")
        .withColumn("position", F.col("position") + F.col("offset"))
        .withColumn("dataset", F.lit(name))
        .drop("offset")
    )
    summed = totals.agg(
        F.lit(name).alias("dataset"),
        F.sum("n_rows").alias("n_rows"),
        F.sum("n_cols").alias("n_cols"),
        F.sum("size_mb").alias("size_mb"),
        F.sum("n_duplicate_rows").alias("n_duplicate_rows"),
        F.round(percent(F.sum("n_null_cells"), F.sum("n_cells")), 2).alias("overall_null_pct"),
        F.lit(True).alias("multi_source"),
        F.sum("n_null_cells").alias("n_null_cells"),
        F.sum("n_cells").alias("n_cells"),
    )
    return {
        "column_profile": combined,
        "dataset_profile": summed,
        "warnings": warnings(combined, summed),
        "type_distribution": type_distribution(combined),
        "source_column_profile": columns,
        "source_dataset_profile": totals,
        "relationships": relationships(columns, list(datasets)),
    }
