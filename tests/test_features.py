"""Encoding, correlation, mutual information, forests, advice."""

import math
from collections import namedtuple
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from plumbline import analyse_features
from plumbline.functions.numbers import digamma
from plumbline.operators import encode, features, plane, products
from plumbline.session import shared_folder


def test_codes_follow_sorted_values(spark):
    df = spark.createDataFrame([("b",), ("a",), (None,), ("é",), ("B",)], "w string")
    assert [r.w for r in encode.label_encode(df).collect()] == [2, 1, None, 3, 0]


def test_large_dictionary_is_split_into_hot_and_rare(spark, monkeypatch):
    monkeypatch.setattr(encode, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(encode, "HOT_SHARE", 5)
    df = spark.range(900).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'hot' WHEN id % 100 = 7 THEN NULL ELSE concat('w', id % 200) END AS w")
    words = sorted({r.w for r in df.collect() if r.w is not None})
    found = encode.label_encode(df, rows_per_task=20)
    assert found.count() == 900
    for plain, coded in zip(df.orderBy("id").collect(), found.orderBy("id").collect()):
        assert coded.w == (None if plain.w is None else words.index(plain.w))


def test_encode_fills_and_drops(spark):
    df = spark.createDataFrame(
        [(1, None, True, None, [1]), (2, 4.0, None, None, [2]), (3, float("nan"), False, None, [3]), (4, 8.0, True, None, [4])],
        "k int, x double, b boolean, nothing string, list array<int>",
    )
    found = encode.encode_features(df)
    assert found.table.columns == ["k", "x", "b"]
    assert set(found.dropped) == {"nothing", "list"}
    assert [tuple(r) for r in found.table.collect()] == [(1.0, 6.0, 1.0), (2.0, 4.0, 1.0), (3.0, 6.0, 0.0), (4.0, 8.0, 1.0)]


def test_times_become_seconds(spark):
    df = spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:00.5' AS t, DATE '2024-01-01' AS d, TIMESTAMP_NTZ '2024-01-01 00:00:00' AS n")
    assert [tuple(r) for r in encode.encode_features(df).table.collect()] == [(1704067200.5, 1704067200.0, 1704067200.0)]


def test_correlation_of_constant_is_zero_and_limit_is_included(spark):
    df = spark.range(100).selectExpr("CAST(id AS DOUBLE) AS target", "7D AS same", "-3D * id + 1 AS down", "sin(id) AS wave")
    found = {r.feature: r.pearson_r for r in features.target_correlation(df, "target").collect()}
    assert found["same"] == 0.0 and found["down"] == pytest.approx(-1.0)
    pairs = features.correlations(df, [("down", "wave"), ("same", "wave")])
    r = {(p.feature_a, p.feature_b): p.r for p in pairs.collect()}
    assert r["same", "wave"] is None
    limit = abs(r["down", "wave"])
    assert len(features.high_correlation_pairs(df, "target", threshold=limit).collect()) == 1


def test_correlated_pairs_of_very_many_columns(spark, tmp_path):
    rng = np.random.default_rng(2)
    n, p = 80, 1100  # five blocks
    x = rng.normal(size=(n, p)) + 1e6
    x[:, 1099] = -2 * x[:, 3] + rng.normal(size=n) / 9
    x[:, 700] = x[:, 255] + rng.normal(size=n) / 3
    x[:, 257] = x[:, 256]
    x[:, 11] = 5.0
    x[:, 12] = 1e9 + 0.1
    pd.DataFrame(x, columns=[f"c.{i}" for i in range(p)]).to_parquet(tmp_path / "wide.parquet")
    table = spark.read.parquet(str(tmp_path / "wide.parquet"))
    z = np.delete(x, [11, 12], axis=1)
    r = np.corrcoef(z, rowvar=False)
    at = np.delete(np.arange(p), [11, 12])
    expected = {(f"c.{at[a]}", f"c.{at[b]}"): r[a, b] for a, b in zip(*np.nonzero(np.triu(np.abs(r) >= 0.6, 1)))}
    found = {(f.feature_a, f.feature_b): f.correlation for f in features.high_correlation_pairs(table, threshold=0.6).collect()}
    assert set(found) == set(expected) and len(found) >= 3
    assert all(found[k] == pytest.approx(expected[k], abs=1e-6) for k in found)
    told = features.target_correlation(table, "c.3").collect()
    assert len(told) == p - 1 and told[0].feature == "c.1099" and told[0].pearson_r < -0.9
    assert {t.feature for t in told if t.pearson_r == 0.0} == {"c.11", "c.12"}


def test_blocks_of_few_columns(spark, monkeypatch):
    monkeypatch.setattr(products, "BLOCK", 2)
    monkeypatch.setattr(products, "PAIRS_PER_SCAN", 2)
    df = spark.range(300).selectExpr("sin(id) AS a", "cos(id) AS b", "id % 7 AS c", "sin(id) * 2 + id % 3 AS d", "1 AS one", "id % 5 AS e")
    found = {(p.feature_a, p.feature_b): p.r for p in products.blocked_correlations(df, df.columns).collect()}
    kept = [c for c in df.columns if c != "one"]
    plain = df.toPandas()[kept].corr()
    assert set(found) == {(a, b) for i, a in enumerate(kept) for b in kept[i + 1 :]}
    assert all(found[a, b] == pytest.approx(plain.loc[a, b], abs=1e-9) for a, b in found)
    assert products.blocked_correlations(df.limit(0), df.columns).count() == 0
    assert products.blocked_correlations(df, ["a", "one"]).count() == 0
    target = products.blocked_correlations(df, df.columns, target="d").collect()
    assert sorted((p.feature_a, p.feature_b) for p in target) == [("a", "d"), ("b", "d"), ("c", "d"), ("d", "e")]


def test_wide_tables_use_the_matrix(spark, monkeypatch):
    df = spark.range(200).selectExpr("sin(id) AS a", "cos(id) + 1e6 AS b", "id % 7 + 1e9 AS c", "sin(id) * 2 + id % 3 AS d")
    pairs = [("a", "b"), ("a", "c"), ("a", "d"), ("b", "d")]
    plain = [p.r for p in features.correlations(df, pairs).collect()]
    monkeypatch.setattr(features, "MATRIX_PAIRS", 1)
    assert [p.r for p in features.correlations(df, pairs).collect()] == pytest.approx(plain, abs=1e-9)


def test_digamma(spark):
    values = [r.d for r in spark.createDataFrame([(1,), (2,), (10,)], "n int").select(digamma(F.col("n")).alias("d")).collect()]
    gamma = 0.5772156649015329
    assert values == pytest.approx([-gamma, 1 - gamma, sum(1 / k for k in range(1, 10)) - gamma], abs=1e-10)


def brute_force_mi(x, y, k=3):
    """All distances between all rows, as the definition has it."""
    keep = np.array([np.sum(y == c) > 1 for c in y])
    x, y = x[keep], y[keep]
    psi = lambda n: -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))
    total = 0.0
    for i in range(len(x)):
        same = np.sort(np.abs(x[y == y[i]] - x[i]))[1:]
        k_here = min(k, len(same))
        reach = same[k_here - 1]
        near = np.abs(x - x[i])
        m = np.sum(near < reach) if reach > 0 else np.sum(near == 0)
        total += psi(k_here) - psi(len(same) + 1) - psi(m)
    return max(0.0, psi(len(x)) + total / len(x))


@pytest.mark.parametrize("rows_per_task", [1_000_000, 60, 7])
def test_neighbour_scores_equal_brute_force(spark, rows_per_task):
    rng = np.random.default_rng(3)
    y = np.concatenate([rng.integers(0, 3, 350), [5, 6, 6]])  # one class of one row, one of two
    frame = pd.DataFrame({"target": y.astype(float), "near": rng.normal(size=353) + y, "noise": rng.exponential(size=353),
                          "ties": rng.integers(0, 4, 353) + (y > 1)})
    found = features.mutual_information_knn(spark.createDataFrame(frame), "target", rows_per_task=rows_per_task, jitter=0.0)
    scores = {r.feature: r.mi_score for r in found.collect()}
    for c in ("near", "noise", "ties"):
        assert scores[c] == pytest.approx(brute_force_mi(frame[c].to_numpy(float), y), abs=1e-9), c


@pytest.mark.parametrize("rows_per_task", [1_000_000, 4])
def test_a_reach_below_a_power_of_two_holds_the_row_itself(spark, rows_per_task):
    """The neighbour lies half a step below 1.0: as far above it, rounding gives 1.0 again."""
    below = math.nextafter(1.0, 0.0)
    x = np.array([1.0, 1.0, below, below, below, -1.0, -below, -below, -below, 1.0, 7.0, 8.0, 9.0])
    y = np.array([0] * 9 + [1] * 4)
    frame = pd.DataFrame({"target": y.astype(float), "x": x})
    found = features.mutual_information_knn(spark.createDataFrame(frame), "target", rows_per_task=rows_per_task, jitter=0.0)
    assert [r.mi_score for r in found.collect()] == pytest.approx([brute_force_mi(x, y)], abs=1e-9)


def test_closer_rows_along_an_axis_hold_the_row_itself(spark):
    below = math.nextafter(1.0, 0.0)
    rows = [(0, 1, 1.0, 1.0 - below, below), (0, 2, 1.0, 0.0, 1.0), (0, 3, below, below - 0.5, 0.5), (0, 4, 0.5, 1e-20, 4.0)]
    df = spark.createDataFrame(rows, "feature int, row long, x double, far double, ax double")
    found = plane.closer_along(df, "x", "ax", 4).collect()
    assert {r.row: r.m for r in found} == {1: 2, 2: 2, 3: 3, 4: 1}


def plane_scores(x, y, k=3):
    """All distances in the plane between all rows, both axes scaled."""
    x, y = (v / v.std() if v.std() else v for v in (x, y))
    psi = lambda n: -0.5772156649015329 + sum(1 / j for j in range(1, int(n)))
    dx, dy = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    both = np.maximum(dx, dy)
    np.fill_diagonal(both, np.inf)
    k = min(k, len(x) - 1)
    reach = np.sort(both, axis=1)[:, k - 1 : k]
    counts = [np.where(reach > 0, d < reach, d == 0).sum(axis=1) for d in (dx, dy)]
    return max(0.0, psi(len(x)) + psi(k) - sum(np.mean([psi(n) for n in c]) for c in counts))


@pytest.mark.parametrize("cell_rows, rows_per_task", [(512, 1_000_000), (16, 1_000_000), (5, 40)])
def test_plane_scores_equal_brute_force(spark, cell_rows, rows_per_task):
    rng = np.random.default_rng(7)
    n = 400
    y = rng.normal(size=n)
    far = rng.standard_cauchy(n)  # a few rows reach over very many cells
    frame = pd.DataFrame({"target": y, "near": y + rng.normal(size=n) / 3, "copy": y * 4, "noise": rng.exponential(size=n),
                          "far": far, "bent": np.abs(y) + rng.normal(size=n) / 9, "clump": np.where(np.arange(n) < 250, 0.0, rng.normal(size=n))})
    found = features.mutual_information_regression(
        spark.createDataFrame(frame).repartition(3), "target", cell_rows=cell_rows, rows_per_task=rows_per_task, jitter=0.0
    )
    scores = {r.feature: r.mi_score for r in found.collect()}
    for c in frame.columns[1:]:
        # without jitter the last bits of equal distances may differ
        assert scores[c] == pytest.approx(plane_scores(frame[c].to_numpy(), y), abs=1e-6), c


def test_plane_scores_of_ties_and_few_rows(spark):
    rng = np.random.default_rng(8)
    y = rng.integers(0, 5, 300).astype(float)
    frame = pd.DataFrame({"target": y, "same": y, "x": rng.integers(0, 3, 300).astype(float), "one": 1.0, "key": np.arange(300)})
    df = spark.createDataFrame(frame)
    score = lambda parts: {r.feature: r.mi_score for r in features.mutual_information_regression(
        df.repartition(parts), "target", cell_rows=20, row_key="key").collect()}
    one, other = score(2), score(5)
    assert one == pytest.approx(other, abs=1e-9) and set(one) == {"same", "x", "one"}
    assert one["same"] > 1 and one["x"] < 0.2 and one["one"] < 0.2
    assert features.mutual_information_regression(df.limit(3).drop("key"), "target").count() == 3
    assert features.mutual_information_regression(df.limit(1).drop("key"), "target").count() == 0
    assert features.mutual_information_regression(df.limit(0).drop("key"), "target").count() == 0


def test_binned_scores(spark):
    df = spark.range(2000).selectExpr("CAST(id % 2 AS DOUBLE) AS target", "CAST(id % 2 AS DOUBLE) * 5 AS copy", "CAST(id DIV 2 AS DOUBLE) AS other")
    found = {r.feature: r.mi_score for r in features.mutual_information_binned(df, "target").collect()}
    assert found["copy"] == pytest.approx(math.log(2)) and found["other"] == pytest.approx(0.0, abs=1e-3)
    regression = features.mutual_information_binned(df.withColumn("target", F.col("other") * 2), "target", "regression")
    assert regression.first().feature == "other" and regression.first().mi_score == pytest.approx(math.log(10), abs=1e-3)


def test_feature_stage_of_a_sample(churn):
    found = analyse_features(churn, "churn", trees=20)
    importance = found["feature_importance"].orderBy("rank").collect()
    assert sum(r.importance for r in importance) == pytest.approx(1.0, abs=0.01)
    assert [r.importance for r in importance] == sorted((r.importance for r in importance), reverse=True)
    assert all(r.mi_score >= 0 for r in found["feature_mi"].collect())
    assert all(-1 <= r.pearson_r <= 1 for r in found["feature_correlation"].collect())
    assert found["feature_summary"].first().n_features == 7


def test_missing_target_leaves_the_advice(churn):
    found = analyse_features(churn, "not_there")
    assert found["feature_importance"].count() == 0 and found["feature_mi"].count() == 0
    assert found["transform_advice"].count() > 0
    assert found["feature_summary"].first().n_features == 8


def test_continuous_target_is_no_class(spark):
    df = spark.range(50).selectExpr("id + 0.5D AS target", "sin(id) AS x")
    assert features.forest_importance(df, "target").count() == 0
    assert features.mutual_information_knn(df, "target").count() == 0


def test_numeric_advice_limits(spark):
    df = spark.range(100).selectExpr(
        "CAST(id % 10 AS INT) AS ten", "CAST(id % 11 AS INT) AS eleven",
        "IF(id = 0, NULL, CAST(id % 3 AS INT)) AS holed", "CAST(id % 3 AS SMALLINT) AS short_type",
        "IF(id < 30, 0D, id * 1D) AS thirty", "IF(id < 31, 0D, id * 1D) AS more",
        "IF(id = 0, 5000D, 1D) AS spread", "IF(id = 0, 990D, -10D) * 2 AS centred",
        "IF(id < 9, id * 1D, NULL) AS few", "'a' AS one", "concat('w', id % 2) AS two",
        "concat('w', id % 10) AS ten_words", "concat('w', id % 50) AS fifty", "concat('w', id % 51) AS more_words",
    )
    found = {r.column: r.suggestions for r in features.transform_advice(df).collect()}
    category = "treat as category, one-hot encode"
    assert found["ten"] == [category] and "eleven" not in found
    assert "holed" not in found or category not in found["holed"]
    assert category not in found.get("short_type", [])
    assert "thirty" not in found and found["more"] == ["add a zero flag (31% zeros)"]
    assert found["spread"][0].startswith("log transform") and found["spread"][-1] == "standardise (wide spread)"
    assert found["centred"] == ["standardise (wide spread)"]  # mean 0, not below 0 only
    assert "few" not in found
    assert found["one"] == ["one-hot encode (1 categories)"] and found["two"] == ["encode as 0/1"]
    assert found["ten_words"] == ["one-hot encode (10 categories)"]
    assert found["fifty"] == ["target or frequency encode"]
    assert found["more_words"] == ["hash or embed (very many values)"]


def test_neighbour_information_of_repeated_rows(spark):
    df = spark.range(2000).selectExpr("CAST(id % 2 AS DOUBLE) AS target", "CAST(5 * (id % 2) AS DOUBLE) AS x")
    score = features.mutual_information_knn(df, "target").first().mi_score
    assert abs(score - math.log(2)) < 0.01


def test_infinite_value_spoils_one_column_only(spark):
    from plumbline import profile

    df = spark.range(30).selectExpr("IF(id = 3, double('Infinity'), double(id)) AS x", "double(id) AS y")
    rows = {r.column: r for r in profile({"d": df})["column_profile"].collect()}
    assert rows["x"]["std"] is None and abs(rows["y"]["std"] - 8.8034) < 1e-3


def shared_bytes(spark):
    return sum(p.stat().st_size for p in Path(shared_folder(spark)).rglob("*") if p.is_file())


def test_neighbour_scores_leave_no_tables_behind(spark):
    """A feature is sorted, counted and deleted: disk does not grow with the number of features."""
    rng = np.random.default_rng(5)
    n = 20_000
    frame = pd.DataFrame({"target": rng.integers(0, 2, n).astype(float), **{f"f{i}": rng.normal(size=n) for i in range(4)}})
    df = spark.createDataFrame(frame)
    before = shared_bytes(spark)
    found = features.mutual_information_knn(df, "target")
    assert found.count() == 4
    assert shared_bytes(spark) - before < 200_000


def test_a_forest_is_fitted_on_parts_of_bounded_size(spark, monkeypatch):
    """However few files a table has, a task's share of the rows does not grow with it."""
    seen = []
    fit = features.RandomForestClassifier.fit
    monkeypatch.setattr(features.RandomForestClassifier, "fit", lambda self, df: (seen.append(df.rdd.getNumPartitions()), fit(self, df))[1])
    monkeypatch.setattr(features, "FOREST_CELLS", 2_000, raising=False)
    df = spark.range(1000).repartition(1).select((F.col("id") % 2).cast("double").alias("target"), F.col("id").cast("double").alias("a"))
    found = features.forest_importance(df, "target", trees=3).collect()
    assert seen == [10] and [r.feature for r in found] == ["a"]


def test_rows_of_one_code_are_cut_along_the_target_only():
    """Strips by rank inside a code are far narrower than a row's reach: each row would ask them all."""
    Strip = namedtuple("Strip", "feature strip low high n")
    coded = [Strip(0, s, float(s // 10), s // 10 + 1e-9, 5000) for s in range(30)]
    even = [Strip(1, s, s * 0.35, s * 0.35 + 0.35, 5120) for s in range(10)]
    found = {(f, s): (to, n) for f, s, to, n in plane._merged_strips(coded + even, 512)}
    assert [found[0, s] for s in range(30)] == [(s // 10 * 10, 50_000) for s in range(30)]
    assert [found[1, s] for s in range(10)] == [(s, 5120) for s in range(10)]


def test_repeated_row_keys_have_their_counts_added_up(spark):
    rng = np.random.default_rng(2)
    once = pd.DataFrame({"key": range(300), "target": rng.normal(size=300), "a": rng.normal(size=300)})
    df = spark.createDataFrame(pd.concat([once, once]))
    found = features.mutual_information_regression(df, "target", row_key="key").collect()
    assert [(r.feature, r.mi_score) for r in found] == [("a", 0.0)]
