"""What features say about a target, about each other, and how to reshape them."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window, functions as F

from plumbline.functions.fields import (
    NUMERIC,
    Field,
    column,
    fields_of,
    local_table,
    nan_to_null,
    quoted,
    small_table,
    text_literal,
    union_all,
)
from plumbline.functions.numbers import digamma, double_literal, percent
from plumbline.functions.text import gather
from plumbline.operators.columns import (
    column_sums,
    count_measures,
    deviations,
    distinct_counts,
    number_measures,
    per_column,
    spans_of,
    with_moments,
)
from plumbline.operators.line import ROWS_AT_ONCE, class_counts
from plumbline.operators.plane import CELL_ROWS, JITTER, plane_information
from plumbline.operators.products import blocked_correlations
from plumbline.operators.ranks import ROWS_PER_TASK, quantiles
from plumbline.session import discard, freeze, store

# Limits of the pair rule, the estimators and the advice rules.
HIGH_CORRELATION = 0.85
MAX_FEATURES = 20
NEIGHBOURS = 3
TREES, DEPTH, SEED = 100, 8, 42
# Numbers that a task holds of a forest's rows, of 4 bytes or so.
FOREST_CELLS = 8_000_000
ADVICE_MIN_VALUES = 10
SKEW_LIMIT = 1.5
FEW_VALUES = 10
MANY_VALUES = 50
ZERO_PCT = 30
LARGE_MAX, LARGE_SPREAD = 1000, 2

# Products per aggregation, and pairs beyond which whole blocks are multiplied.
PRODUCTS_PER_PASS = 60
MATRIX_PAIRS = 600


# ------------------------------------------------------------------ correlation


def correlations(table: DataFrame, pairs: Sequence[tuple[str, str]], least: float = 0.0) -> DataFrame:
    """(feature_a, feature_b, r) for the named pairs of a table without nulls.

    One scan for the means, one for all centred products. ``r`` is NULL where
    either side is constant. Pairs below ``least`` may be left out.
    """
    spark = table.sparkSession
    if not pairs:
        return local_table(spark, [], "feature_a string, feature_b string, r double")
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    numbers = {"": table.select(*[column(c) for c in used])}
    sums = per_column(
        numbers, fields_of(numbers), lambda f: {**count_measures(f), **number_measures(f)}
    ).collect()
    means = {r.column: (r.sum / r.n_total if r.n_total and r.min < r.max else None) for r in sums}
    varying = [p for p in pairs if means[p[0]] is not None and means[p[1]] is not None]
    known = set(varying)
    constant = [(*p, None) for p in pairs if p not in known]
    parts = [local_table(spark, constant, "feature_a string, feature_b string, r double")]
    # products of whole blocks pay for themselves only if most of them are wanted
    if len(varying) > max(MATRIX_PAIRS, 2 * len(used)):
        parts.append(_chosen(numbers[""], varying, least))
    else:
        for start in range(0, len(varying), PRODUCTS_PER_PASS):
            parts.append(_centred_products(numbers[""], means, varying[start : start + PRODUCTS_PER_PASS]))
    return union_all(parts)


def _centred_products(table, means, pairs):
    off = {c: f"({quoted(c)} - {double_literal(means[c])})" for pair in pairs for c in pair}
    at = {c: i for i, c in enumerate(off)}
    squares = [f"sum({x} * {x}) AS s{at[c]}" for c, x in off.items()]
    products = [f"sum({off[a]} * {off[b]}) AS p{i}" for i, (a, b) in enumerate(pairs)]
    rows = [
        f"struct({text_literal(a)} AS feature_a, {text_literal(b)} AS feature_b, "
        f"p{i} / sqrt(s{at[a]} * s{at[b]}) AS r)"
        for i, (a, b) in enumerate(pairs)
    ]
    return table.selectExpr(*squares, *products).selectExpr(f"inline(array({', '.join(rows)}))")


def _chosen(table, pairs, least):
    """The named pairs out of blocked products of all their columns."""
    used = list(dict.fromkeys(c for pair in pairs for c in pair))
    at = {c: i for i, c in enumerate(used)}
    shown = [(min(p, key=at.get), max(p, key=at.get), *p) for p in pairs]
    wanted = local_table(table.sparkSession, shown, "first string, second string, feature_a string, feature_b string")
    found = blocked_correlations(table, used, least).toDF("first", "second", "r")
    return found.join(F.broadcast(wanted), ["first", "second"]).select("feature_a", "feature_b", "r")


def target_correlation(table: DataFrame, target: str) -> DataFrame:
    """Pearson r of every feature with the target, 0 where it is undefined."""
    features = [c for c in table.columns if c != target]
    r = F.coalesce("r", F.lit(0.0))
    if len(features) > PRODUCTS_PER_PASS:
        # the target stands first in its pairs
        named = local_table(table.sparkSession, [(c,) for c in features], "feature string")
        found = blocked_correlations(table, [target, *features], target=target)
        found = named.join(found.select(F.col("feature_b").alias("feature"), "r"), "feature", "left")
    else:
        found = correlations(table, [(c, target) for c in features]).withColumnRenamed("feature_a", "feature")
    return found.select("feature", r.alias("pearson_r"), F.abs(r).alias("abs_r")).orderBy(F.desc("abs_r"), "feature")


def high_correlation_pairs(
    table: DataFrame, target: str | None = None, threshold: float = HIGH_CORRELATION
) -> DataFrame:
    """Feature pairs, in column order, with \\|r\\| at or above the threshold.

    Wide tables are multiplied in blocks, where the threshold is applied: neither
    all pairs nor a matrix of all columns comes into being.
    """
    features = [c for c in table.columns if c != target]
    if len(features) * (len(features) - 1) // 2 > MATRIX_PAIRS:
        found = blocked_correlations(table, features, threshold)
    else:
        found = correlations(table, list(combinations(features, 2)), threshold)
    return (
        found
        .where(F.abs("r") >= threshold)
        .select("feature_a", "feature_b", F.col("r").alias("correlation"))
        .orderBy(F.desc(F.abs("correlation")), "feature_a", "feature_b")
    )


# ----------------------------------------------------------- mutual information


def top_features(scored: DataFrame, score: str, limit: int) -> DataFrame:
    """The best features with their 1-based rank; ties by name."""
    best = Window.orderBy(F.desc(score), "feature")  # one row per feature
    return scored.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= limit)


def _no_scores(table: DataFrame, score: str, limit: int) -> DataFrame:
    nothing = local_table(table.sparkSession, [], f"feature string, {score} double")
    return top_features(nothing, score, limit)


def mutual_information_binned(
    table: DataFrame,
    target: str,
    task: str = "classification",
    bins: int = 10,
    max_features: int = MAX_FEATURES,
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """Mutual information of binned features with the target, in nats.

    Features, and the target in regression, are cut at their exact quantiles.
    Joint counts have bins x classes cells per feature and are added up before
    the shuffle; bin totals are few, class totals are joined by class, so any
    number of classes will do. A target that is no class gives no scores.
    """
    features = [c for c in table.columns if c != target]
    if not features or (task == "classification" and not _is_class(table, target)):
        return _no_scores(table, "mi_score", max_features)
    cut = features + ([target] if task == "regression" else [])
    numbers = {"": table}
    fields = [f for f in fields_of(numbers) if f.name in cut]
    sums = small_table(
        per_column(numbers, fields, lambda f: {**count_measures(f), **number_measures(f)})
    )
    inner = [i / bins for i in range(1, bins)]
    spans = spans_of(sums)
    if not next(iter(spans.values()))[0]:
        return _no_scores(table, "mi_score", max_features)
    edges = quantiles(numbers, fields, spans, inner, rows_per_task)

    def bin_of(f: Field) -> str:
        cuts = sorted({e for e in edges[f.id] if e is not None})
        return " + ".join(["0", *[f"CAST({f.sql} > {double_literal(e)} AS INT)" for e in cuts]])

    binned = {f.name: bin_of(f) for f in fields}
    by_name = {f.name: f.id for f in fields}
    y = f"CAST({binned[target]} AS DOUBLE)" if task == "regression" else f"CAST({quoted(target)} AS DOUBLE)"
    wide = table.selectExpr(f"{y} AS y", *[f"{binned[c]} AS `{by_name[c]}`" for c in features])
    joint = (
        wide.unpivot(["y"], [str(by_name[c]) for c in features], "id", "bin")
        .groupBy("id", "bin", "y")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("id", F.col("id").cast("int"))
    )
    total = float(next(iter(spans.values()))[0])
    bin_totals = joint.groupBy("id", "bin").agg(F.sum("n").cast("double").alias("in_bin"))
    class_totals = wide.groupBy("y").agg(F.count(F.lit(1)).cast("double").alias("in_class"))
    names = local_table(table.sparkSession, [(by_name[c], c) for c in features], "id int, feature string")
    n = F.col("n").cast("double")
    scored = (
        joint.join(F.broadcast(bin_totals), ["id", "bin"])
        .join(class_totals, "y")
        .groupBy("id")
        .agg(F.sum(n / total * F.ln(n * total / (F.col("in_bin") * F.col("in_class")))).alias("mi"))
        .join(F.broadcast(names), "id")
        .select("feature", F.greatest("mi", F.lit(0.0)).alias("mi_score"))
    )
    return top_features(scored, "mi_score", max_features)


def mutual_information_knn(
    table: DataFrame,
    target: str,
    k: int = NEIGHBOURS,
    max_features: int = MAX_FEATURES,
    rows_per_task: int = ROWS_PER_TASK,
    jitter: float = 1e-10,
) -> DataFrame:
    """Nearest-neighbour mutual information of features with a class target.

    For every row: the distance to its k-th nearest row of the same class, and
    how many rows of any class lie closer than that. On a line both come from
    sorted order: neighbours are the rows next in rank, and the count is a
    difference of two positions. So there are no pairs of rows. Features are
    sorted a few at a time, one of a long table, and what they leave is deleted.

    A jitter far below the scale of a feature, drawn for each row and feature,
    breaks ties, also between equal rows.
    """
    features = [c for c in table.columns if c != target]
    if not features or not _is_class(table, target):
        return _no_scores(table, "mi_score", max_features)
    wide, shown = _jittered(table, target, features, jitter)
    sizes = wide.where("y IS NOT NULL").groupBy("y").agg(F.count(F.lit(1)).alias("size"))
    n = wide.count()
    classes = sizes.where("size > 1")
    within = F.least(F.lit(k), F.col("size") - 1)
    every = classes.agg(
        F.sum("size").alias("total"),
        F.sum(F.col("size") * digamma(within)).alias("of_k"),
        F.sum(F.col("size") * digamma(F.col("size"))).alias("of_class"),
    )
    every = every.select("total", *[(F.col(c) / F.col("total")).alias(c) for c in ("of_k", "of_class")], digamma(F.col("total")).alias("of_all")).first()
    total = every.total or 0
    if not total:
        discard(wide)
        return _no_scores(table, "mi_score", max_features)
    # rows that are alone in their class have no neighbour
    kept = wide if total == n else wide.join(classes.select("y"), "y", "left_semi")
    names = list(shown)
    at_once = max(1, ROWS_AT_ONCE // n)
    scores = []
    for start in range(0, len(names), at_once):
        some = names[start : start + at_once]
        long = kept.selectExpr("y", "row", *[f"{shown[c]} AS `{c}`" for c in some]).unpivot(["y", "row"], some, "feature", "x")
        long = long.withColumn("feature", F.col("feature").cast("int"))
        for r in class_counts(long, total * len(some), k, rows_per_task):
            scores.append((features[r.feature], max(0.0, every.of_all + every.of_k - every.of_class - r.of_m)))
    discard(wide)
    return top_features(local_table(table.sparkSession, scores, "feature string, mi_score double"), "mi_score", max_features)


def mutual_information_regression(
    table: DataFrame,
    target: str,
    k: int = NEIGHBOURS,
    max_features: int = MAX_FEATURES,
    rows_per_task: int = ROWS_PER_TASK,
    cell_rows: int = CELL_ROWS,
    jitter: float = JITTER,
    row_key: str | None = None,
) -> DataFrame:
    """Nearest-neighbour mutual information of features with a number target, both scaled to deviation 1.

    For every row: the distance to its k-th nearest row in the plane of feature
    and target, the larger of the two axes' distances, and how many rows lie
    closer than that along each axis alone. ``row_key`` is no feature.
    """
    features = [c for c in table.columns if c not in (target, row_key)]
    if not features:
        return _no_scores(table, "mi_score", max_features)
    scored = plane_information(table, target, features, k, rows_per_task, cell_rows, jitter, row_key)
    return top_features(scored, "mi_score", max_features)


def _jittered(table, target, features, jitter):
    """(y, row and a column per feature, stored; the jittered value of each, as SQL, by its number).

    Scores do not depend on the scale of a feature, only the jitter does. The
    row number only tells rows apart; it is fixed by storing it.
    """
    numbers = {"": table.select(*[column(c) for c in features])}
    fields = fields_of(numbers)
    sums = small_table(
        per_column(numbers, fields, lambda f: {**count_measures(f), **number_measures(f)})
    )
    spread = {r.id: r for r in with_moments(sums.join(deviations(numbers, fields, sums), "id")).collect()}
    shown = [f"CAST({quoted(target)} AS DOUBLE) AS y", "monotonically_increasing_id() AS row"]
    # stored first, so that the row numbers the jitter is drawn from stay
    wide = store(table.selectExpr(*shown, *[f"{f.sql} AS `{f.id}`" for f in fields]), "features")
    values = {}
    for f in fields:
        row = spread[f.id]
        size = jitter * max(row["std"] or 1.0, abs(row["mean"] or 0.0))
        u1 = f"((xxhash64({f.id}, row) & 9007199254740991) + 1) / 9007199254740993D"
        u2 = f"(xxhash64({f.id}, 'angle', row) & 9007199254740991) / 9007199254740992D"
        normal = f"sqrt(-2 * ln({u1})) * cos(2 * pi() * {u2})"
        values[str(f.id)] = f"`{f.id}` + {double_literal(size)} * {normal}"
    return wide, values


# -------------------------------------------------------------- forest importance


def forest_importance(
    table: DataFrame,
    target: str,
    task: str = "classification",
    max_features: int = MAX_FEATURES,
    trees: int = TREES,
    depth: int = DEPTH,
    seed: int = SEED,
) -> DataFrame:
    """Impurity importances of a random forest, adding up to 1 over all features.

    A classification target must have whole values; otherwise, as for any target
    a forest cannot learn, the result is empty.
    """
    features = [c for c in table.columns if c != target]
    if not features:
        return _no_scores(table, "importance", max_features)
    label, extra = column(target), {"featureSubsetStrategy": "all"}
    forest = RandomForestRegressor
    if task == "classification":
        if not _is_class(table, target):
            return _no_scores(table, "importance", max_features)
        table, target, n_classes = _with_class_number(table, target)
        values = {"ml_attr": {"type": "nominal", "name": "label", "num_vals": n_classes}}
        label = column(target).cast("double").alias("label", metadata=values)
        forest, extra = RandomForestClassifier, {"featureSubsetStrategy": "sqrt"}
    named = table.select(label.alias("label") if task != "classification" else label,
                         *[column(c).alias(f"f{i}") for i, c in enumerate(features)])
    # a task holds its rows with a draw per tree, and reads them once per group of nodes
    parts = -(-table.count() * (trees + 16 + len(features)) // FOREST_CELLS)
    if parts > 1:
        named = named.repartition(parts)
    vectors = VectorAssembler(inputCols=[f"f{i}" for i in range(len(features))], outputCol="features")
    model = forest(
        numTrees=trees, maxDepth=depth, seed=seed, labelCol="label", featuresCol="features", **extra
    ).fit(vectors.transform(named).select("label", "features"))
    scores = [(c, float(v)) for c, v in zip(features, model.featureImportances.toArray())]
    scored = local_table(table.sparkSession, scores, "feature string, importance double")
    return top_features(scored, "importance", max_features)


def _is_class(table: DataFrame, target: str) -> bool:
    """Whether all target values are whole numbers, as classes are."""
    y = column(target).cast("double")
    return bool(table.agg(F.bool_and(y == F.floor(y)).alias("whole")).first().whole)


def _with_class_number(table: DataFrame, target: str) -> tuple[DataFrame, str, int]:
    """Add the number 0..k-1 of each row's class; (table, name of the added column, k)."""
    name = "class number"
    while name in table.columns:
        name += "'"
    y = column(target).cast("double")
    classes = table.select(y.alias("class value")).distinct()
    number = F.row_number().over(Window.orderBy("class value")) - 1  # one row per class
    classes = freeze(classes.select("class value", number.alias(name)))
    joined = table.join(classes, y == F.col("class value")).drop("class value")
    return joined, name, classes.count()


# --------------------------------------------------------------- transform advice


def transform_advice(df: DataFrame, mode: str = "exact") -> DataFrame:
    """How to reshape each column: numeric columns with a finding, all string ones.

    Columns: section (1 numeric, 2 string), position, column, suggestions.
    """
    datasets = {"": nan_to_null(df)}
    fields = [f for f in fields_of(datasets) if f.kind in (*NUMERIC, "string")]
    if not fields:
        return local_table(
            df.sparkSession, [], "section int, position int, column string, suggestions array<string>"
        )
    sums = small_table(column_sums(datasets, fields))
    moments = with_moments(sums.join(F.broadcast(deviations(datasets, fields, sums)), "id", "left"))
    table = small_table(moments.join(F.broadcast(distinct_counts(datasets, fields, mode)), "id"))
    numeric = table.where(F.col("kind").isin(*NUMERIC)).withColumn("suggestions", numeric_advice())
    words = table.where("kind = 'string'").withColumn("suggestions", F.array(category_advice()))
    return union_all(
        [
            part.where(F.size("suggestions") > 0).select(
                F.lit(section).alias("section"), "position", "column", "suggestions"
            )
            for section, part in ((1, numeric), (2, words))
        ]
    ).orderBy("section", "position")


def numeric_advice():
    n = F.col("n_total") - F.col("n_null")
    zeros = percent(F.col("n_zero"), n)
    whole = F.col("dtype").isin("int", "bigint") & (F.col("n_null") == 0)
    wide = F.when(F.col("mean") == 0, F.col("std") > 0).otherwise(
        F.try_divide(F.col("std"), F.col("mean")) > LARGE_SPREAD
    )
    found = F.array_compact(
        F.array(
            F.when((F.abs("skewness") > SKEW_LIMIT) & (F.col("min") >= 0),
                   F.format_string("log transform (skewness %.2f)", "skewness")),
            F.when(whole & (F.col("n_unique") <= FEW_VALUES), F.lit("treat as category, one-hot encode")),
            F.when(zeros > ZERO_PCT, F.format_string("add a zero flag (%.0f%% zeros)", zeros)),
            F.when((F.col("max") > LARGE_MAX) & wide, F.lit("standardise (wide spread)")),
        )
    )
    return F.when(n >= ADVICE_MIN_VALUES, found).otherwise(F.array().cast("array<string>"))


def category_advice():
    n = F.col("n_unique")
    return (
        F.when(n == 2, F.lit("encode as 0/1"))
        .when(n <= FEW_VALUES, F.format_string("one-hot encode (%d categories)", n))
        .when(n <= MANY_VALUES, F.lit("target or frequency encode"))
        .otherwise(F.lit("hash or embed (very many values)"))
    )


def feature_summary(
    dataset: str, n_features: int, importance: DataFrame, pairs: DataFrame, advice: DataFrame
) -> DataFrame:
    """One line on the feature stage: counts and the three best features."""
    kinds = [
        importance.where("rank <= 3").select(F.lit("best").alias("kind"), "rank", "feature"),
        pairs.select(F.lit("pair").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("feature")),
        advice.select(F.lit("advice").alias("kind"), F.lit(0).alias("rank"), F.lit("").alias("feature")),
    ]
    is_kind = lambda kind: F.col("kind") == kind
    one = union_all(kinds).agg(
        F.array_join(gather(F.col("rank"), F.when(is_kind("best"), F.col("feature"))), ", ").alias("best"),
        F.count_if(is_kind("pair")).alias("n_pairs"),
        F.count_if(is_kind("advice")).alias("n_advice"),
    )
    return one.select(
        F.lit(dataset).alias("dataset"),
        F.lit(n_features).alias("n_features"),
        "n_pairs",
        "n_advice",
        F.format_string(
            "%d features; best by forest: %s; %d highly correlated pair(s); advice for %d column(s).",
            F.lit(n_features), F.when(F.col("best") == "", "none").otherwise(F.col("best")),
            F.col("n_pairs"), F.col("n_advice"),
        ).alias("summary"),
    )
