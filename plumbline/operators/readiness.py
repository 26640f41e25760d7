"""Readiness: how far a dataset meets the field requirements of a use case.

Inputs are the column and dataset profile (a row per column or dataset), so all
joins here are as large as the schemas, whatever the number of data rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.functions.catalog import TIERS
from plumbline.functions.fields import small_table, union_all
from plumbline.functions.numbers import percent, share
from plumbline.functions.text import gather

# Penalty steps (limit, points), limits and score bands.
NULL_PENALTIES = [(30, 10.0), (15, 6.0), (8, 3.0), (3, 1.0)]
DUPLICATE_PENALTIES = [(0.05, 5.0), (0.01, 2.0)]
OUTLIER_PENALTY_PCT = 10
PENALTY_CAP = 20.0
NULL_ADVICE_PCT = 8
OUTLIER_ADVICE_PCT = 5
NULL_RISK_PCT = 15
FEW_ROWS, MODEST_ROWS = 500, 2000
BANDS = [(80, "HIGH"), (60, "MODERATE"), (40, "LOW")]
LOWEST_BAND = "VERY LOW"
BAR_WIDTH = 30


def steps(value: Column, limits: list, otherwise, strict: bool = True) -> Column:
    """CASE over falling limits: the first one that is passed decides."""
    result = None
    for limit, outcome in limits:
        passed = value > limit if strict else value >= limit
        result = F.when(passed, outcome) if result is None else result.when(passed, outcome)
    return result.otherwise(otherwise)


def band(score: Column) -> Column:
    return steps(score, BANDS, LOWEST_BAND, strict=False)


def bar(score: Column, width: int = BAR_WIDTH) -> Column:
    """``[███░░░] 43%``, filled to the nearest whole step, halves to even."""
    filled = F.bround(score / 100 * width).cast("int")
    return F.format_string(
        "[%s%s] %d%%",
        F.repeat(F.lit("█"), filled),
        F.repeat(F.lit("░"), F.lit(width) - filled),
        F.bround(score).cast("long"),
    )


# ---------------------------------------------------------------- requirements


def match_requirements(
    columns: DataFrame, uses: DataFrame, requirements: DataFrame
) -> DataFrame:
    """Each requirement of each (dataset, use_case), with the column that meets it.

    A column meets a requirement when its name contains one of the patterns, in
    any letter case. Of several the smallest name is taken; NULL means missing.
    The names of a dataset travel as one array, so requirements meet datasets in
    an equi-join on the use case.
    """
    names = columns.groupBy("dataset").agg(F.collect_set(F.lower("column")).alias("names"))
    known = uses.join(F.broadcast(names), "dataset", "left").withColumn(
        "names", F.coalesce("names", F.array().cast("array<string>"))
    )
    hits = F.filter(
        "names", lambda name: F.exists("patterns", lambda pattern: F.contains(name, pattern))
    )
    return (
        known.join(F.broadcast(requirements), "use_case")
        .select(
            "dataset", "use_case", "tier", "tier_no", "req_no", "description", "weight",
            F.array_min(hits).alias("matched_column"),
        )
    )


def tier_scores(uses: DataFrame, matches: DataFrame) -> DataFrame:
    """Earned and possible weight per tier; a tier without requirements scores 100."""
    tiers = F.explode(
        F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(i).alias("tier_no")) for i, t in enumerate(TIERS)])
    )
    every = uses.select("dataset", "use_case", tiers.alias("t")).select("dataset", "use_case", "t.*")
    summed = matches.groupBy("dataset", "use_case", "tier").agg(
        F.sum("weight").alias("max_weight"),
        F.sum(F.when(F.col("matched_column").isNotNull(), F.col("weight")).otherwise(0)).alias("earned"),
    )
    score = F.when(
        F.col("max_weight") > 0, F.round(percent(F.col("earned"), F.col("max_weight")), 1)
    ).otherwise(100.0)
    return every.join(summed, ["dataset", "use_case", "tier"], "left").select(
        "dataset", "use_case", "tier", "tier_no",
        score.alias("score"),
        F.coalesce("earned", F.lit(0)).alias("earned"),
        F.coalesce("max_weight", F.lit(0)).alias("max_weight"),
    )


def raw_scores(tiers: DataFrame) -> DataFrame:
    """Share of all weights earned; 0 for a use case without requirements."""
    return tiers.groupBy("dataset", "use_case").agg(
        F.round(percent(F.sum("earned"), F.sum("max_weight")), 1).alias("raw_score")
    )


def field_lists(uses: DataFrame, matches: DataFrame) -> DataFrame:
    """Descriptions present and missing per tier, in catalogue order, as arrays."""
    absent = F.col("matched_column").isNull()

    def listed(condition: Column) -> Column:
        return gather(F.col("req_no"), F.when(condition, F.col("description")))

    lists = matches.groupBy("dataset", "use_case").agg(
        listed(~absent).alias("present_fields"),
        *[listed(absent & (F.col("tier") == t)).alias(f"missing_{t}") for t in TIERS],
    )
    empty = F.array().cast("array<string>")
    return uses.join(lists, ["dataset", "use_case"], "left").select(
        "dataset",
        "use_case",
        *[F.coalesce(c, empty).alias(c) for c in ("present_fields", *[f"missing_{t}" for t in TIERS])],
    )


# -------------------------------------------------------------- quality, scores


def quality_penalty(columns: DataFrame, totals: DataFrame) -> DataFrame:
    """Points off for nulls, columns full of outliers, and duplicate rows."""
    outliers = columns.groupBy("dataset").agg(
        F.count_if(F.col("pct_outliers") > OUTLIER_PENALTY_PCT).alias("n_outlier_columns")
    )
    copies = share(F.col("n_duplicate_rows"), F.col("n_rows"))
    parts = totals.join(F.broadcast(outliers), "dataset", "left").select(
        "dataset",
        steps(F.col("overall_null_pct"), NULL_PENALTIES, 0.0).alias("null_penalty"),
        F.coalesce("n_outlier_columns", F.lit(0)).cast("double").alias("outlier_penalty"),
        steps(copies, DUPLICATE_PENALTIES, 0.0).alias("duplicate_penalty"),
    )
    total = F.col("null_penalty") + F.col("outlier_penalty") + F.col("duplicate_penalty")
    return parts.withColumn("quality_penalty", F.least(total, F.lit(PENALTY_CAP)))


def scores(uses: DataFrame, raw: DataFrame, penalty: DataFrame) -> DataFrame:
    """Readiness after the penalty; a dataset without a profile has no penalty."""
    adjusted = F.round(F.col("raw_score") - F.col("quality_penalty"), 1)
    return (
        uses.join(raw, ["dataset", "use_case"])
        .join(F.broadcast(penalty.select("dataset", "quality_penalty")), "dataset", "left")
        .withColumn("quality_penalty", F.coalesce("quality_penalty", F.lit(0.0)))
        .withColumn("score", F.greatest(adjusted, F.lit(0.0)))
        .withColumn("band", band(F.col("score")))
        .withColumn("bar", bar(F.col("score")))
        .select("dataset", "use_case", "raw_score", "quality_penalty", "score", "band", "bar")
    )


# ------------------------------------------------------- recommendations, risks

def recommendations(
    columns: DataFrame, totals: DataFrame, matches: DataFrame, score_table: DataFrame
) -> DataFrame:
    """Ordered advice: missing fields, nulls, outlier columns, then one verdict."""
    uses = score_table.select("dataset", "use_case")
    keys = [F.col("dataset"), F.col("use_case")]

    def part(df: DataFrame, section: int, item, severity: str, text: Column) -> DataFrame:
        return df.select(
            *keys,
            F.lit(section).alias("section"),
            item.cast("int").alias("item"),
            F.lit(severity).alias("severity"),
            text.alias("text"),
        )

    missing = matches.where("matched_column IS NULL")
    sparse = uses.join(F.broadcast(totals), "dataset").where(F.col("overall_null_pct") > NULL_ADVICE_PCT)
    spread = uses.join(columns, "dataset").where(F.col("pct_outliers") > OUTLIER_ADVICE_PCT)
    verdict = F.format_string("%s of 100 points after %s off for quality: %s.", F.col("score").cast("string"),
                              F.col("quality_penalty").cast("string"), "band")
    parts = [
        part(
            missing.where("tier = 'critical'"), 1, F.col("req_no"), "critical",
            F.format_string("No column for '%s' (critical, weight %d).", "description", "weight"),
        ),
        part(
            missing.where("tier = 'important'"), 2, F.col("req_no"), "important",
            F.format_string("No column for '%s' (important, weight %d).", "description", "weight"),
        ),
        part(
            sparse, 3, F.lit(0), "quality",
            F.format_string("%.2f%% of the cells hold nothing.", "overall_null_pct"),
        ),
        part(
            spread, 4, F.col("position"), "outliers",
            F.format_string("%.2f%% of the values of '%s' lie outside its fences.", "pct_outliers", "column"),
        ),
        part(score_table, 5, F.lit(0), "verdict", verdict),
    ]
    order = Window.partitionBy("dataset", "use_case").orderBy("section", "item")
    return (
        union_all(parts)
        .withColumn("seq", F.row_number().over(order))
        .select("dataset", "use_case", "seq", "severity", "text")
    )


def risks(totals: DataFrame, matches: DataFrame, score_table: DataFrame) -> DataFrame:
    """Ordered risks: missing critical fields, null rate, number of rows."""
    uses = score_table.select("dataset", "use_case").join(F.broadcast(totals), "dataset", "left")
    uses = uses.withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    gaps = (
        matches.where("tier = 'critical' AND matched_column IS NULL")
        .groupBy("dataset", "use_case")
        .agg(F.count(F.lit(1)).alias("n_missing"))
    )

    def part(df, section, severity, risk, detail, mitigation):
        return df.select(
            "dataset",
            "use_case",
            F.lit(section).alias("section"),
            F.lit(severity).alias("severity"),
            F.lit(risk).alias("risk"),
            detail.alias("detail"),
            F.lit(mitigation).alias("mitigation"),
        )

    few = F.col("n_rows") < FEW_ROWS
    modest = ~few & (F.col("n_rows") < MODEST_ROWS)
    parts = [
        part(gaps, 1, "HIGH", "Critical fields missing",
             F.format_string("%d critical field(s) not in the data", "n_missing"),
             "See the list of missing fields"),
        part(uses.where(F.col("overall_null_pct") > NULL_RISK_PCT), 2, "HIGH", "Many nulls",
             F.format_string("%.2f%% of all values are null", "overall_null_pct"),
             "See the null share of each column"),
        part(uses.where(few), 3, "HIGH", "Too few rows",
             F.format_string("%d rows, under %d", "n_rows", F.lit(FEW_ROWS)),
             "Compare scores over several splits"),
        part(uses.where(modest), 3, "MEDIUM", "Modest number of rows",
             F.format_string("%d rows, under %d", "n_rows", F.lit(MODEST_ROWS)),
             "Watch how scores vary with the split"),
    ]
    order = Window.partitionBy("dataset", "use_case").orderBy("section")
    return (
        union_all(parts)
        .withColumn("seq", F.row_number().over(order))
        .select("dataset", "use_case", "seq", "severity", "risk", "detail", "mitigation")
    )


def readiness(
    columns: DataFrame, totals: DataFrame, uses: DataFrame, requirements: DataFrame
) -> dict[str, DataFrame]:
    """All readiness tables for the (dataset, use_case) pairs in ``uses``."""
    matches = small_table(match_requirements(columns, uses, requirements))
    tiers = small_table(tier_scores(uses, matches))
    score_table = small_table(scores(uses, raw_scores(tiers), quality_penalty(columns, totals)))
    return {
        "requirement_match": matches,
        "readiness_tier": tiers,
        "readiness": score_table,
        "field_lists": field_lists(uses, matches),
        "recommendations": recommendations(columns, totals, matches, score_table),
        "risks": risks(totals, matches, score_table),
    }
