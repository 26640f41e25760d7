"""Column profile: counts, types, moments, quartiles, outliers, frequent values."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from plumbline.functions.fields import (
    NUMERIC,
    Datasets,
    Field,
    clean,
    fields_of,
    local_table,
    small_table,
    text_literal,
    union_all,
)
from plumbline.functions.numbers import double_literal, percent, share
from plumbline.operators.ranks import ROWS_PER_TASK, quantiles

# Limits of the type rules, the outlier rule and the value lists.
BOOLEAN_LIMIT = 2
DISCRETE_LIMIT = 15
LOW_CATEGORY_LIMIT = 20
LOW_CATEGORY_SHARE = 0.05
TEXT_LENGTH = 50
OUTLIER_MIN_VALUES = 10
FENCE_FACTOR = 1.5
TOP_VALUES = 10
# An approximate distinct count up to this is counted again exactly.
RECOUNT_LIMIT = 100
# Columns per aggregation: few enough that the JVM compiles the generated code.
COLUMNS_PER_PASS = 8

# Month names.
MONTHS = "January February March April May June July August September October November December".split()
MONTH = "(" + "|".join(f"{m[:3]}(?:{m[3:]})?" for m in MONTHS) + ")"
ZONE = "(?:Z|UTC|[+-][0-9]{2}:?[0-9]{2})"
CLOCK = f"((?:[T ][0-9]{{1,2}}:[0-9]{{2}}(?::[0-9]{{2}}(?:[.][0-9]{{1,9}})?)?(?: ?{ZONE})?)?)$"
ZONED = f"(:[0-9]{{2}}(?:[.][0-9]+)?) ?({ZONE})$"
ISO_DATE = "^[0-9]{4}-[0-9]{2}-[0-9]{2}"
# Other ways to write a day that say which part is which, and the parts in ISO order
# (M is the number of the month's name).
DAY_SHAPES = [
    (r"^([0-9]{4})([/.-])([0-9]{1,2})\2([0-9]{1,2})", "$1-$3-$4$5"),
    ("^((?:19|20)[0-9]{2})([0-9]{2})([0-9]{2})", "$1-$2-$3$4"),
    (f"(?i)^{MONTH}[.]? ([0-9]{{1,2}}),? ([0-9]{{4}})", "$3-M-$2$4"),
    (f"(?i)^([0-9]{{1,2}})[- ]{MONTH}[.]?[- ]([0-9]{{4}})", "$3-M-$1$4"),
]
# Two small numbers and a year: month or day first, as all values of the column allow, month before day.
SMALL_FIRST = r"^([0-9]{1,2})([/.-])([0-9]{1,2})\2([0-9]{4})"
DAY_ORDERS = {"month_first": "$4-$1-$3$5", "day_first": "$4-$3-$1$5"}
LONGEST_DAY = 60
# How any of these begin, and the characters that tell: other texts are not looked at further.
NAMED = "(?:" + "|".join(m[:3] for m in MONTHS) + ")"
DAY_START = f"(?i)^(?:[0-9]{{4}}[/.-][0-9]|(?:19|20)[0-9]{{6}}|[0-9]{{1,2}}(?:[/.-][0-9]|[- ]{NAMED})|{NAMED})"
DAY_START_LENGTH = 8


# ---------------------------------------------------------------- one-pass sums


def per_column(
    datasets: Datasets,
    fields: Sequence[Field],
    measures: Callable[[Field], dict[str, str]],
    ahead: Sequence[Callable[[Field], dict[str, str]]] = (),
) -> DataFrame:
    """One global aggregation per dataset, turned into one row per column.

    ``measures`` gives SQL aggregates by name, the same names and types for
    every field. ``ahead`` gives columns that they use, step by step, named with
    the field's id. No shuffle but the merge of one partial row per task.
    """
    parts = []
    for name, df in datasets.items():
        mine = [f for f in fields if f.dataset == name]
        for start in range(0, len(mine), COLUMNS_PER_PASS):
            chunk = mine[start : start + COLUMNS_PER_PASS]
            sums, rows = [], []
            for f in chunk:
                row = [
                    f"{f.id} AS id",
                    f"{text_literal(f.dataset)} AS dataset",
                    f"{f.position} AS position",
                    f"{text_literal(f.name)} AS column",
                    f"{text_literal(f.dtype)} AS dtype",
                    f"{text_literal(f.kind)} AS kind",
                ]
                for key, aggregate in measures(f).items():
                    sums.append(f"{aggregate} AS {key}_{f.id}")
                    row.append(f"{key}_{f.id} AS {key}")
                rows.append(f"struct({', '.join(row)})")
            rows_of = df
            for step in ahead:
                more = [f"{sql} AS {key}_{f.id}" for f in chunk for key, sql in step(f).items()]
                rows_of = rows_of.selectExpr("*", *more) if more else rows_of
            parts.append(rows_of.selectExpr(*sums).selectExpr(f"inline(array({', '.join(rows)}))"))
    return union_all(parts)


def count_measures(f: Field) -> dict[str, str]:
    return {"n_total": "count(1)", "n_null": f"count(1) - count({f.sql})"}


def number_measures(f: Field) -> dict[str, str]:
    x = f"CAST({f.sql if f.kind in NUMERIC else 'NULL'} AS DOUBLE)"
    return {
        "min": f"min({x})",
        "max": f"max({x})",
        "sum": f"sum({x})",
        "n_zero": f"count(CASE WHEN {x} = 0 THEN 1 END)",
    }


def size_measures(f: Field) -> dict[str, str]:
    if f.width:
        measure = f"count(1) * {f.width}"
    elif f.kind == "string" or f.dtype == "binary":
        measure = f"sum(octet_length({f.sql}))"
    elif f.dtype in ("array<float>", "array<int>"):
        measure = f"4 * sum(size({f.sql}))"
    elif f.dtype in ("array<double>", "array<bigint>"):
        measure = f"8 * sum(size({f.sql}))"
    else:
        measure = f"sum(octet_length(CAST({f.sql} AS STRING)))"
    return {"n_bytes": f"coalesce({measure}, 0L)"}


def day_start(f: Field) -> str:
    """Whether a text begins like a day in any spelling; most are told by this look at their start."""
    return f"left({f.sql}, {DAY_START_LENGTH}) RLIKE r'{DAY_START}'"


def day_texts(f: Field) -> dict[str, str]:
    """ISO forms of a text column's values: as their shape says, and in each order of day and month."""
    x, short = f.sql, f"octet_length({f.sql}) <= {LONGEST_DAY}"  # long texts are told by their length alone
    initials = "".join(m[:3] for m in MONTHS).lower()
    month = f"CAST((locate(lower(regexp_extract({x}, '(?i)[a-z]{{3}}', 0)), '{initials}') + 2) DIV 3 AS STRING)"
    shape, plain = f"WHEN {x} RLIKE '{ISO_DATE}' THEN 0", f"WHEN {x} RLIKE '{ISO_DATE}' THEN {x}"
    for i, (day, parts) in enumerate(DAY_SHAPES, 1):
        fits = f"WHEN {short} AND {x} RLIKE r'{day}{CLOCK}' THEN"
        before, named, after = parts.partition("M")
        iso = f"concat('{before}', {month}, '{after}')" if named else f"'{parts}'"
        shape += f" {fits} {i}"
        plain += f" {fits} regexp_replace({x}, r'{day}{CLOCK}', {iso})"
    out = {"day_shape": f"CASE {shape} END", "day_plain": f"CASE {plain} END"}
    for order, parts in DAY_ORDERS.items():
        day = f"r'{SMALL_FIRST}{CLOCK}'"
        out[f"day_{order}"] = f"CASE WHEN {short} AND {x} RLIKE {day} THEN regexp_replace({x}, {day}, '{parts}') END"
    return out


def day_times(f: Field) -> dict[str, str]:
    """The times that ``day_texts`` stand for, in UTC if they name a zone; NULL if there is no such day."""
    out = {}
    for key in ("plain", *DAY_ORDERS):
        text = f"day_{key}_{f.id}"
        zone = f"regexp_extract({text}, '{ZONED}', 2)"
        ahead = (
            f"CASE WHEN length({zone}) < 5 THEN 0 ELSE 60 * CAST(substr({zone}, 1, 3) AS INT) "
            f"+ CAST(concat(substr({zone}, 1, 1), right({zone}, 2)) AS INT) END"
        )
        local = f"try_cast(regexp_replace({text}, '{ZONED}', '$1') AS timestamp_ntz)"
        out[f"time_{key}"] = (
            f"CASE WHEN {text} RLIKE '{ZONED}' THEN timestampadd(MINUTE, -({ahead}), {local}) "
            f"ELSE try_cast({text} AS timestamp_ntz) END"
        )
    return out


def text_measures(f: Field) -> dict[str, str]:
    """Lengths of texts, how many begin like a day, and the first and last instant of other columns."""
    words = f.kind == "string"
    instant = f"CAST({f.sql if f.kind == 'instant' else 'NULL'} AS timestamp_ntz)"
    return {
        "avg_length": f"avg(length({f.sql}))" if words else "CAST(NULL AS DOUBLE)",
        "n_day_starts": f"count(CASE WHEN {day_start(f)} THEN 1 END)" if words else "0L",
        "date_like": "false",
        "date_min": f"CAST(min({instant}) AS STRING)",
        "date_max": f"CAST(max({instant}) AS STRING)",
    }


def day_measures(f: Field) -> dict[str, str]:
    """What a text column holds as days (after ``day_texts`` and ``day_times``), by way of reading them."""
    out = {"one_shape": f"min(day_shape_{f.id}) = max(day_shape_{f.id})"}
    for key in ("plain", *DAY_ORDERS):
        time = f"time_{key}_{f.id}"
        out |= {f"n_{key}": f"count({time})"} | {f"{m}_{key}": f"CAST({m}({time}) AS STRING)" for m in ("min", "max")}
    return out


def _with_days(datasets: Datasets, fields: Sequence[Field], sums: DataFrame) -> DataFrame:
    """``sums`` with the days of the text columns in which some value begins like one.

    Only such values are read as days, a scan per column: the code for it is too long
    for the JVM to compile, so no other value should pass through it. A column holds days
    if all its values have one shape, or one order of day and month, and all exist.
    """
    some = {r.id for r in sums.where("n_day_starts > 0").select("id").collect()}
    parts = [
        per_column({f.dataset: datasets[f.dataset].where(day_start(f))}, [f], day_measures, ahead=(day_texts, day_times))
        for f in fields if f.id in some
    ]
    if not parts:
        return sums.drop("n_day_starts")
    days = union_all(parts).drop("dataset", "position", "column", "dtype", "kind")
    n = "n_total - n_null"
    every = {k: f"({n} > 0 AND n_{k} = {n})" for k in ("plain", *DAY_ORDERS)}
    every["plain"] = f"({every['plain']} AND one_shape)"

    def of_first(least: str) -> str:
        return f"CASE {' '.join(f'WHEN {e} THEN {least}_{k}' for k, e in every.items())} ELSE {least}_plain END"

    read = {
        "date_like": F.expr(f"coalesce({' OR '.join(every.values())}, false)"),
        "date_min": F.expr(f"CASE WHEN kind = 'string' THEN {of_first('min')} ELSE date_min END"),
        "date_max": F.expr(f"CASE WHEN kind = 'string' THEN {of_first('max')} ELSE date_max END"),
    }
    both = sums.join(F.broadcast(days), "id", "left").withColumns(read)
    return both.select(*[c for c in sums.columns if c != "n_day_starts"])


def column_sums(datasets: Datasets, fields: Sequence[Field] | None = None) -> DataFrame:
    """Everything that plain scans give, a row per column: one per dataset, and one per text column with days."""
    fields = fields_of(datasets) if fields is None else fields
    sums = per_column(
        datasets,
        fields,
        lambda f: {
            **count_measures(f),
            **number_measures(f),
            **size_measures(f),
            **text_measures(f),
        },
    )
    return _with_days(datasets, fields, small_table(sums))


# ------------------------------------------------------- distinct values, modes


def _countable(fields: Sequence[Field]) -> list[Field]:
    return [f for f in fields if f.kind != "other"]


def _lane(f: Field, as_digest: bool) -> tuple[str, Column]:
    """The common type a column's values are counted in, and the values in it."""
    if f.kind in ("integer", "boolean"):
        return "bigint", f.col.cast("bigint")
    if f.kind == "real" and not f.dtype.startswith("decimal"):
        return "double", f.col.cast("double")
    if f.dtype == "timestamp":
        return "bigint", F.unix_micros(f.col)
    if f.kind == "instant":
        return "timestamp_ntz", f.col.cast("timestamp_ntz")
    words = f.col.cast("string")
    if as_digest:
        # Long texts are told apart by digest, so they are not shuffled whole.
        # A digest key is 65 characters long and never equals a short text.
        words = F.when(F.length(words) > 64, F.concat(F.sha2(words, 256), F.lit("#"))).otherwise(words)
    return "string", words


def frequencies(
    datasets: Datasets, fields: Sequence[Field], as_digest: bool = False
) -> dict[str, DataFrame]:
    """Rows (id, value, n) per distinct non-null value, one table per value type.

    Values are counted before the shuffle, so a value that fills a third of the
    table arrives as one row per task.
    """
    lanes: dict[str, list[DataFrame]] = {}
    for name, df in datasets.items():
        by_lane: dict[str, list[tuple[Field, Column]]] = {}
        for f in _countable(fields):
            if f.dataset == name:
                lane, values = _lane(f, as_digest)
                by_lane.setdefault(lane, []).append((f, values))
        for lane, members in by_lane.items():
            wide = df.select(*[values.alias(str(f.id)) for f, values in members])
            long = wide.unpivot([], [str(f.id) for f, _ in members], "id", "value")
            lanes.setdefault(lane, []).append(long)
    return {
        lane: union_all(parts)
        .where("value IS NOT NULL")
        .groupBy("id", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("id", F.col("id").cast("int"))
        for lane, parts in lanes.items()
    }


def distinct_counts(
    datasets: Datasets,
    fields: Sequence[Field] | None = None,
    mode: str = "exact",
) -> DataFrame:
    """(id, n_unique) per countable column, exact or approximate.

    Approximate counts of few values are repeated exactly, because the type
    rules turn on small numbers.
    """
    fields = _countable(fields_of(datasets) if fields is None else fields)
    if mode == "exact":
        return _exact_distinct(datasets, fields)
    rough = per_column(
        datasets, fields, lambda f: {"n_unique": f"approx_count_distinct({f.sql})"}
    ).select("id", "n_unique")
    guesses = {r.id: r.n_unique for r in rough.collect()}
    few = [f for f in fields if guesses[f.id] <= RECOUNT_LIMIT]
    spark = rough.sparkSession
    many = local_table(
        spark,
        [(i, n) for i, n in guesses.items() if n > RECOUNT_LIMIT], "id int, n_unique long"
    )
    return many.unionByName(_exact_distinct(datasets, few)) if few else many


def _exact_distinct(datasets: Datasets, fields: Sequence[Field]) -> DataFrame:
    spark = next(iter(datasets.values())).sparkSession
    # columns without any value have no frequency rows, hence the zero row
    zero = local_table(spark, [(f.id, 0) for f in fields], "id int, n_unique long")
    counted = [
        freq.groupBy("id").agg(F.count(F.lit(1)).alias("n_unique"))
        for freq in frequencies(datasets, fields, as_digest=True).values()
    ]
    return union_all([zero, *counted]).groupBy("id").agg(F.sum("n_unique").alias("n_unique"))


def top_values(
    datasets: Datasets, fields: Sequence[Field] | None = None, k: int = TOP_VALUES
) -> DataFrame:
    """The k most frequent values of each column; ties by value, smallest first.

    The rank limit is applied in each task before rows meet (window group limit).
    """
    fields = _countable(fields_of(datasets) if fields is None else fields)
    best = Window.partitionBy("id").orderBy(F.desc("n"), F.asc("value"))
    kept = [
        freq.withColumn("rank", F.row_number().over(best))
        .where(F.col("rank") <= k)
        .select("id", "rank", F.col("value").cast("string").alias("value"), "n")
        for freq in frequencies(datasets, fields).values()
    ]
    booleans = [f.id for f in fields if f.kind == "boolean"]
    ranked = union_all(kept).join(F.broadcast(_names(datasets, fields)), "id")
    if booleans:
        words = F.when(F.col("value") == "1", "true").otherwise("false")
        shown = F.when(F.col("id").isin(booleans), words).otherwise(F.col("value"))
        ranked = ranked.withColumn("value", shown)
    return ranked.select("dataset", "position", "column", "rank", "value", "n")


def _names(datasets: Datasets, fields: Sequence[Field]) -> DataFrame:
    spark = next(iter(datasets.values())).sparkSession
    return local_table(
        spark,
        [(f.id, f.dataset, f.position, f.name) for f in fields],
        "id int, dataset string, position int, column string",
    )


# -------------------------------------------------------------------- type rules


def inferred_type(
    kind: Column, n_nonnull: Column, n_unique: Column, avg_length: Column, date_like: Column
) -> Column:
    numeric = kind.isin(*NUMERIC)
    words = kind == "string"
    return (
        F.when(kind == "instant", "datetime")
        .when((kind == "boolean") | (numeric & (n_unique <= BOOLEAN_LIMIT)), "boolean")
        .when(numeric & (n_unique <= DISCRETE_LIMIT), "numeric_discrete")
        .when(numeric, "numeric_continuous")
        .when(~words | (n_nonnull == 0), "unknown")
        .when(date_like, "datetime")
        .when(avg_length > TEXT_LENGTH, "text")
        .when(
            (n_unique <= LOW_CATEGORY_LIMIT)
            | (share(n_unique, n_nonnull) < LOW_CATEGORY_SHARE),
            "categorical_low",
        )
        .otherwise("categorical_high")
    )


def typed_columns(sums: DataFrame, distinct: DataFrame) -> DataFrame:
    """Column sums with distinct counts, shares and the semantic type."""
    nonnull = F.col("n_total") - F.col("n_null")
    return (
        sums.join(F.broadcast(distinct), "id", "left")
        .withColumn("null_pct", F.round(percent(F.col("n_null"), F.col("n_total")), 2))
        .withColumn("unique_ratio", F.round(share(F.col("n_unique"), nonnull), 4))
        .withColumn(
            "inferred_type",
            inferred_type(
                F.col("kind"), nonnull, F.col("n_unique"), F.col("avg_length"), F.col("date_like")
            ),
        )
    )


# ------------------------------------------------------------ quartiles, outliers


def quartiles(
    datasets: Datasets,
    sums: DataFrame,
    fields: Sequence[Field],
    mode: str = "exact",
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """q1, median and q3, a row per numeric field."""
    numeric = [f for f in fields if f.kind in NUMERIC]
    cuts = [0.25, 0.5, 0.75]
    if not numeric:
        found = {}
    elif mode == "exact":
        found = quantiles(datasets, numeric, spans_of(sums), cuts, rows_per_task)
    else:
        rough = per_column(
            datasets,
            numeric,
            lambda f: {
                "cuts": f"percentile_approx(CAST({f.sql} AS DOUBLE), array(0.25, 0.5, 0.75), 10000)"
            },
        )
        found = {r.id: r.cuts or [None] * 3 for r in rough.select("id", "cuts").collect()}
    return local_table(
        sums.sparkSession, [(i, *values) for i, values in found.items()],
        "id int, q1 double, median double, q3 double",
    )


def spans_of(sums: DataFrame) -> dict[int, tuple[int, float, float]]:
    rows = sums.selectExpr("id", "n_total - n_null AS n", "min", "max").collect()
    return {r.id: (r.n, r["min"], r["max"]) for r in rows}


def with_fences(table: DataFrame) -> DataFrame:
    """IQR fences; none for columns with fewer than ten values."""
    enough = F.col("n_total") - F.col("n_null") >= OUTLIER_MIN_VALUES
    iqr = F.when(enough, F.col("q3") - F.col("q1"))
    return (
        table.withColumn("iqr", iqr)
        .withColumn("lower_fence", F.col("q1") - FENCE_FACTOR * iqr)
        .withColumn("upper_fence", F.col("q3") + FENCE_FACTOR * iqr)
    )


def deviations(datasets: Datasets, fields: Sequence[Field], table: DataFrame) -> DataFrame:
    """Central power sums, and values strictly beyond the fences, in one scan.

    The means and fences are known by now, so each is a constant in plain sums:
    quicker than running moments, and no less accurate.
    """
    with_outliers = "upper_fence" in table.columns
    known = {r.id: r for r in table.collect()}

    def measures(f: Field) -> dict[str, str]:
        row = known[f.id]
        n = row.n_total - row.n_null
        x = f"CAST({f.sql} AS DOUBLE)"
        mean = row["sum"] / n if n else math.nan
        # a mean that is not finite leaves this column, and no other, without moments
        off = f"({x} - {mean!r}D)" if math.isfinite(mean) else "CAST(NULL AS DOUBLE)"
        out = {
            "m2": f"sum({off} * {off})",
            "m3": f"sum({off} * {off} * {off})",
            "m4": f"sum({off} * {off} * {off} * {off})",
        }
        if with_outliers:
            beyond = "false"
            fences = [v for v in (row.lower_fence, row.upper_fence) if v is not None]
            if fences and not any(math.isnan(v) for v in fences):
                beyond = f"{x} < {double_literal(fences[0])} OR {x} > {double_literal(fences[1])}"
            out["n_outliers"] = f"count(CASE WHEN {beyond} THEN 1 END)"
        return out

    extra = ["n_outliers"] if with_outliers else []
    numeric = [f for f in fields if f.kind in NUMERIC]
    if not numeric:
        columns = "id int, m2 double, m3 double, m4 double" + ", n_outliers long" * with_outliers
        return local_table(table.sparkSession, [], columns)
    return per_column(datasets, numeric, measures).select("id", "m2", "m3", "m4", *extra)


def with_moments(table: DataFrame) -> DataFrame:
    """Mean, sample deviation, population skewness and excess kurtosis.

    A constant column has deviation 0 and neither skewness nor kurtosis.
    """
    n = F.col("n_total") - F.col("n_null")
    varies = F.col("min") < F.col("max")
    spread = F.when(varies, F.col("m2")).otherwise(F.lit(0.0))
    variance = F.when(varies, F.col("m2") / n)
    return (
        table.withColumn("mean", F.try_divide(F.col("sum"), n))
        .withColumn("std", F.when((n > 1) & F.col("m2").isNotNull(), F.sqrt(F.try_divide(spread, n - 1))))
        .withColumn("skewness", F.try_divide(F.col("m3") / n, F.pow(variance, 1.5)))
        .withColumn("kurtosis", F.try_divide(F.col("m4") / n, variance * variance) - 3)
        .drop("sum", "m2", "m3", "m4")
    )


# ----------------------------------------------------------------- whole profile

PROFILE_COLUMNS = [
    "dataset", "position", "column", "dtype", "kind", "inferred_type",
    "n_total", "n_null", "null_pct", "n_unique", "unique_ratio",
    "min", "max", "mean", "median", "std", "skewness", "kurtosis", "n_zero",
    "q1", "q3", "iqr", "lower_fence", "upper_fence", "n_outliers", "pct_outliers",
    "top_values", "mode", "date_min", "date_max", "avg_length", "n_bytes",
]

NUMBER_BLOCK = [
    "min", "max", "mean", "median", "std", "skewness", "kurtosis",
    "q1", "q3", "iqr", "lower_fence", "upper_fence", "n_outliers", "pct_outliers",
]


def column_profile(
    datasets: Datasets,
    mode: str = "exact",
    values: bool = True,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """The full profile, one row per column of every dataset.

    Scans: one for the sums, one for distinct counts, one to select quartiles
    (more for columns longer than ``rows_per_task``), one for moments and
    outliers, and one over the categorical columns for their frequent values. Only tables with a
    row per column pass through the driver between them.
    """
    datasets = clean(datasets)
    fields = fields_of(datasets)
    sums = small_table(column_sums(datasets, fields))
    typed = small_table(typed_columns(sums, distinct_counts(datasets, fields, mode)))
    types = {r.id: r.inferred_type for r in typed.select("id", "inferred_type").collect()}

    numeric = [f for f in fields if types[f.id].startswith("numeric_")]
    cuts = quartiles(datasets, sums, numeric, mode, rows_per_task)
    fenced = small_table(with_fences(typed.join(F.broadcast(cuts), "id", "left")))
    beyond = deviations(datasets, numeric, fenced)
    nonnull = F.col("n_total") - F.col("n_null")
    profile = with_moments(fenced.join(F.broadcast(beyond), "id", "left")).withColumn(
        "pct_outliers", F.round(percent(F.col("n_outliers"), nonnull), 2)
    )

    listed = [f for f in fields if types[f.id] in ("boolean", "categorical_low", "categorical_high")]
    if values and listed:
        tops = small_table(top_values(datasets, listed))
        profile = profile.join(F.broadcast(value_lists(tops)), ["dataset", "position"], "left")
    else:
        profile = profile.withColumn("top_values", F.lit(None).cast(TOP_VALUES_TYPE))
        profile = profile.withColumn("mode", F.lit(None).cast("string"))
    return small_table(by_type(profile).select(*PROFILE_COLUMNS))


TOP_VALUES_TYPE = T.ArrayType(
    T.StructType([T.StructField("value", T.StringType()), T.StructField("n", T.LongType())])
)


def value_lists(tops: DataFrame) -> DataFrame:
    """Top values of a column as one array, and the mode (its first entry)."""
    entries = F.sort_array(F.collect_list(F.struct("rank", "value", "n")))
    return (
        tops.groupBy("dataset", "position")
        .agg(entries.alias("entries"))
        .select(
            "dataset",
            "position",
            F.transform("entries", lambda e: F.struct(e["value"].alias("value"), e["n"].alias("n"))).alias("top_values"),
            F.col("entries")[0]["value"].alias("mode"),
        )
    )


def by_type(profile: DataFrame) -> DataFrame:
    """Keep only the block of statistics that belongs to the inferred type.

    Outlier counts are 0 for numeric columns too short to have fences.
    """
    numeric = F.col("inferred_type").startswith("numeric_")
    dated = F.col("inferred_type") == "datetime"
    few = F.col("n_total") - F.col("n_null") < OUTLIER_MIN_VALUES
    quartile_block = ("q1", "q3", "iqr")
    changes = {}
    for c in NUMBER_BLOCK:
        value = F.col(c)
        if c in ("n_outliers", "pct_outliers"):
            value = F.coalesce(value, F.lit(0).cast("long" if c == "n_outliers" else "double"))
        if c in quartile_block:
            value = F.when(~few, value)
        changes[c] = F.when(numeric, value)
    for c in ("date_min", "date_max"):
        changes[c] = F.when(dated, F.col(c))
    return profile.withColumns(changes)
