"""Column profile: type rules, moments, quantiles, outliers, frequent values."""

import math
import statistics

import pytest
from pyspark.sql import functions as F

from plumbline.functions.fields import clean, fields_of, small_table
from plumbline.operators import columns as cols
from plumbline.operators.ranks import quantiles


def profile(df, **options):
    return {r.column: r for r in cols.column_profile({"t": df}, **options).collect()}


def test_semantic_types(spark):
    df = spark.range(40).selectExpr(
        "id AS many",
        "id % 2 AS two",
        "id % 3 AS three",
        "id % 15 AS fifteen",
        "id % 16 AS sixteen",
        "CAST(id % 2 = 0 AS BOOLEAN) AS flag",
        "CAST(NULL AS INT) AS no_numbers",
        "CAST(NULL AS STRING) AS no_words",
        "5 AS same",
        "concat('w', id % 20) AS low",
        "concat('w', id % 21) AS high",
        "repeat('x', 50) AS fifty",
        "repeat('x', 51) AS longer",
        "CAST(date_add(DATE '2024-01-01', CAST(id AS INT)) AS STRING) AS day_text",
        "IF(id = 0, 'oops', '2024-01-01') AS nearly_day",
        "CAST(id AS STRING) AS digits",
        "DATE '2024-01-01' AS day",
        "CAST(id AS DECIMAL(30, 5)) AS exact",
        "array(id) AS list",
        "map('k', id) AS pairs",
        "struct(id) AS inner",
        "CAST('ab' AS BINARY) AS raw",
    )
    found = {c: r.inferred_type for c, r in profile(df).items()}
    assert found == {
        "many": "numeric_continuous",
        "two": "boolean",
        "three": "numeric_discrete",
        "fifteen": "numeric_discrete",
        "sixteen": "numeric_continuous",
        "flag": "boolean",
        "no_numbers": "boolean",
        "no_words": "unknown",
        "same": "boolean",
        "low": "categorical_low",
        "high": "categorical_high",
        "fifty": "categorical_low",
        "longer": "text",
        "day_text": "datetime",
        "nearly_day": "categorical_low",
        "digits": "categorical_high",
        "day": "datetime",
        "exact": "numeric_continuous",
        "list": "unknown",
        "pairs": "unknown",
        "inner": "unknown",
        "raw": "unknown",
    }


def test_low_share_of_distinct_values_is_low_category(spark):
    df = spark.range(500).selectExpr("concat('w', id % 24) AS below", "concat('w', id % 25) AS at_limit")
    found = profile(df)
    assert found["below"].inferred_type == "categorical_low"
    assert found["at_limit"].inferred_type == "categorical_high"


def test_empty_table(spark):
    df = spark.createDataFrame([], "a int, b string, c double, d timestamp")
    found = profile(df)
    assert [r.n_total for r in found.values()] == [0, 0, 0, 0]
    assert [r.null_pct for r in found.values()] == [0.0, 0.0, 0.0, 0.0]
    assert found["d"].inferred_type == "datetime" and found["d"].date_min is None


def test_nan_is_null_and_constant_has_no_shape(spark):
    rows = [(float("nan"), 3.0), (None, 3.0), (1.0, 3.0), (2.5, 3.0), (9.0, 3.0)]
    df = spark.createDataFrame(rows, "x double, same double")
    given = clean({"t": df})
    fields = fields_of(given)
    sums = small_table(cols.column_sums(given, fields))
    joined = sums.join(cols.deviations(given, fields, sums), "id")
    x, same = (r for r in cols.with_moments(joined).orderBy("position").collect())
    assert (x.n_null, x["min"], x["max"]) == (2, 1.0, 9.0)
    assert x["std"] == pytest.approx(statistics.stdev([1.0, 2.5, 9.0]))
    assert (same["std"], same.skewness, same.kurtosis) == (0.0, None, None)


def test_moments_are_population_shape(spark):
    values = [1.0, 2.0, 2.0, 3.0, 50.0, 7.0, 7.5, 8.0, 9.0, 9.5, 11.0, 12.0, 13.0, 14.0, 15.0, 16.0]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    r = profile(df)["x"]
    mean = sum(values) / len(values)
    m = {k: sum((v - mean) ** k for v in values) / len(values) for k in (2, 3, 4)}
    assert r.skewness == pytest.approx(m[3] / m[2] ** 1.5)
    assert r.kurtosis == pytest.approx(m[4] / m[2] ** 2 - 3)
    assert r.n_outliers == 1 and r.pct_outliers == 6.25


@pytest.mark.parametrize("n, fenced", [(9, False), (10, True)])
def test_ten_values_make_fences(spark, n, fenced):
    # 3 distinct values would be enough for numeric_discrete
    df = spark.range(n).selectExpr("IF(id = 0, 1000D, CAST(id AS DOUBLE)) AS x")
    r = profile(df)["x"]
    assert (r.upper_fence is not None) == fenced
    assert r.n_outliers == (1 if fenced else 0)


def test_top_values_break_ties_by_value(spark):
    df = spark.createDataFrame([(v,) for v in ["b", "a", "c", "a", "b", None]], "w string")
    r = profile(df)["w"]
    assert [(v.value, v.n) for v in r.top_values] == [("a", 2), ("b", 2), ("c", 1)]
    assert r["mode"] == "a"


def test_boolean_values_are_named(spark):
    df = spark.createDataFrame([(True,), (False,), (True,)], "b boolean")
    assert profile(df)["b"]["mode"] == "true"


def test_odd_column_names(spark):
    df = spark.range(20).selectExpr("id AS `a.b`", "id AS `it's`", "concat('x', id) AS `tick``s`")
    assert [r.n_unique for r in profile(df).values()] == [20, 20, 20]


def exact_quantile(values, p):
    values = sorted(values)
    at = p * (len(values) - 1)
    low = math.floor(at)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (at - low)


@pytest.mark.parametrize("rows_per_task", [1_000_000, 300, 20])
def test_quantiles_are_exact_on_every_path(spark, rows_per_task):
    """One window, narrowed spans, and sliced ranks give the same order statistics."""
    df = spark.range(5000).selectExpr(
        "sin(id) * 1000 AS wave",
        "CAST(IF(id % 3 = 0, 7, id) AS DOUBLE) AS hot",  # a third of the rows is one value
        "exp(id % 600) AS far",  # spans hundreds of orders of magnitude
        "IF(id = 0, double('infinity'), CAST(id AS DOUBLE)) AS endless",
        "1D AS same",
    )
    given = {"t": df}
    fields = fields_of(given)
    spans = cols.spans_of(cols.column_sums(given, fields))
    cuts = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99]
    found = quantiles(given, fields, spans, cuts, rows_per_task)
    rows = df.collect()
    for f in fields:
        values = [r[f.name] for r in rows]
        assert found[f.id] == [pytest.approx(exact_quantile(values, p), rel=1e-12) for p in cuts], f.name


def test_profile_does_not_depend_on_partitions(spark):
    df = spark.range(3000).selectExpr("sin(id) AS x", "id % 40 AS k", "concat('w', id % 30) AS w")
    names = ["n_unique", "q1", "median", "q3", "n_outliers", "mode", "inferred_type"]
    one = cols.column_profile({"t": df.repartition(1)}).select(*names).collect()
    seven = cols.column_profile({"t": df.repartition(7)}, rows_per_task=200).select(*names).collect()
    assert one == seven


def test_approximate_mode_recounts_small_columns(spark):
    df = spark.range(20000).selectExpr("id", "id % 97 AS small", "concat('w', id % 50) AS w")
    found = profile(df, mode="approx")
    assert (found["small"].n_unique, found["w"].n_unique) == (97, 50)
    assert abs(found["id"].n_unique - 20000) < 3000
    assert abs(found["id"].median - 9999.5) < 50


def test_top_values_are_cut_before_the_shuffle(spark):
    df = spark.range(100).selectExpr("concat('w', id % 30) AS w")
    plan = cols.top_values({"t": df})._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan


@pytest.mark.parametrize(
    "texts, least, most",
    [
        (["03/15/2024", "12/1/2023"], "2023-12-01 00:00:00", "2024-03-15 00:00:00"),
        (["15/03/2024", "1/12/2023", None], "2023-12-01 00:00:00", "2024-03-15 00:00:00"),
        (["Mar 15, 2024", "Dec 1, 2023"], "2023-12-01 00:00:00", "2024-03-15 00:00:00"),
        (["2024/3/15"], "2024-03-15 00:00:00", "2024-03-15 00:00:00"),
        (["15/03/2024", "Dec 1, 2023"], None, None),
        (["31/02/2024"], None, None),
        (["15-Mar-2024", "1-dec-2023"], "2023-12-01 00:00:00", "2024-03-15 00:00:00"),
        (["March 15, 2024", "Dec 1 2023", "May 2, 2024"], "2023-12-01 00:00:00", "2024-05-02 00:00:00"),
        (["20240315", "20231201"], "2023-12-01 00:00:00", "2024-03-15 00:00:00"),
        (["20240315", "20231301"], None, None),
        (["00000315"], None, None),
        (["15.03.2024", "1-12-2023"], "2023-12-01 00:00:00", "2024-03-15 00:00:00"),
        (["3/1.2024"], None, None),
        (["2024-03-15T10:00:00Z", "2024-03-15 10:00:00+02:00"], "2024-03-15 08:00:00", "2024-03-15 10:00:00"),
        (["2024-03-15T10:00-0530", "2024-03-15"], "2024-03-15 00:00:00", "2024-03-15 15:30:00"),
        (["15/03/2024 10:30:15.5", "1/12/2023 0:05"], "2023-12-01 00:05:00", "2024-03-15 10:30:15.5"),
        (["15/03/2024 25:00"], None, None),
        (["2024-03-15", "20240316"], None, None),
        (["Mayor 5, 2024"], None, None),
        (["", "2024-03-15"], None, None),
        (["2024-03-15" * 50], None, None),
        ([None, None], None, None),
    ],
)
def test_days_in_other_spellings(spark, texts, least, most):
    row = profile(spark.createDataFrame([(t,) for t in texts], "x string"))["x"]
    assert (row.inferred_type == "datetime") == (least is not None)
    assert (row.date_min, row.date_max) == (least, most)
