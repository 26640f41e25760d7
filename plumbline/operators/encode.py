"""Turn a table into numbers: label codes, 0/1, epoch seconds, median filling."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from plumbline.functions.fields import (
    NUMERIC,
    Field,
    column,
    fields_of,
    nan_to_null,
    small_table,
)
from plumbline.operators.columns import (
    count_measures,
    frequencies,
    number_measures,
    per_column,
    spans_of,
)
from plumbline.operators.ranks import ROWS_PER_TASK, quantiles, running_totals
from plumbline.session import freeze

# A dictionary up to this size is broadcast; beyond it only its hot values are.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 32 * 1024 * 1024
# A value is hot when it fills more than one row in this many, so at most this
# many values can be hot.
HOT_SHARE = 1000


@dataclass(frozen=True)
class Encoded:
    """An all-double table, and the columns that could not be encoded."""

    table: DataFrame
    dropped: dict[str, str]

    def features(self, target: str) -> list[str]:
        return [c for c in self.table.columns if c != target]


def label_dictionary(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """(id, column, value, n, code) for all string columns of a table.

    Codes count from 0 in ascending order of the distinct values of a column.
    """
    datasets = {"": df}
    words = [f for f in fields_of(datasets) if f.kind == "string"]
    counted = frequencies(datasets, words)["string"].withColumn("one", F.lit(1))
    largest = counted.groupBy("id").count().agg(F.max("count")).first()[0] or 0
    ranked = running_totals(counted, ["id"], ["value"], "one", largest > rows_per_task)
    names = F.create_map(*[F.lit(x) for f in words for x in (f.id, f.name)])
    return ranked.select(
        "id", names[F.col("id")].alias("column"), "value", "n", F.col("before").alias("code")
    )


def label_encode(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Replace every string column by its codes; NULL stays NULL."""
    words = [f for f in fields_of({"": df}) if f.kind == "string"]
    if not words:
        return df
    codes = freeze(label_dictionary(df, rows_per_task))
    sizes = {
        r.id: r
        for r in codes.groupBy("id")
        .agg(F.count(F.lit(1)).alias("rows"), F.sum(F.octet_length("value")).alias("bytes"),
             F.sum("n").alias("values"))
        .collect()
    }
    small = {i: s.rows <= BROADCAST_ROWS and s.bytes <= BROADCAST_BYTES for i, s in sizes.items()}
    out = df
    if not all(small.values()):
        # a number per row, fixed by the checkpoint, so that equal rows can be spread
        out = freeze(df.withColumn("_row", F.monotonically_increasing_id()))
    for f in words:
        size = sizes.get(f.id)
        if size is None:  # nothing but NULL
            out = out.withColumn(f.name, F.lit(None).cast("long"))
        else:
            mine = codes.where(F.col("id") == f.id).select("value", "n", "code")
            out = _look_up(out, f, mine, small[f.id], size["values"] / HOT_SHARE)
    return out.select(*[column(c) for c in df.columns])


def _look_up(df: DataFrame, f: Field, codes: DataFrame, small: bool, hot_from: float) -> DataFrame:
    """Join one column with its dictionary.

    A large dictionary is split: values that fill many rows are few, so they are
    broadcast, and rows with rare values meet theirs in a shuffle. The other rows get
    a key drawn from their row number that matches nothing, so they do not meet in
    one task, not even if they are all equal.
    """
    if small:
        known = F.broadcast(codes.select(F.col("value").alias("_value"), F.col("code").alias("_code")))
        joined = df.join(known, f.col == F.col("_value"), "left")
        return joined.withColumn(f.name, F.col("_code")).drop("_value", "_code")
    hot = codes.where(F.col("n") > hot_from)
    cold = codes.where(F.col("n") <= hot_from)
    hot = F.broadcast(hot.select(F.col("value").alias("_hot"), F.col("code").alias("_hot_code")))
    cold = cold.select(F.col("value").alias("_value"), F.lit(0).alias("_spread"), F.col("code").alias("_code"))
    rare = f.col.isNotNull() & F.col("_hot_code").isNull()
    spread = 1 + F.pmod(F.xxhash64("_row"), F.lit(HOT_SHARE)).cast("int")
    first = df.join(hot, f.col == F.col("_hot"), "left").withColumns(
        {"_key": F.when(rare, f.col), "_part": F.when(rare, 0).otherwise(spread)}
    )
    joined = first.join(
        cold, (F.coalesce("_key", F.lit("")) == F.col("_value")) & (F.col("_part") == F.col("_spread")), "left"
    )
    return joined.withColumn(f.name, F.coalesce("_hot_code", "_code")).drop(
        "_hot", "_hot_code", "_key", "_part", "_value", "_spread", "_code"
    )


def as_number(f: Field) -> Column:
    if f.kind == "instant":
        return F.unix_micros(f.col.cast("timestamp")) / F.lit(1e6)
    if f.kind == "boolean":
        return f.col.cast("int").cast("double")
    return f.col.cast("double")


def to_numbers(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> Encoded:
    """All columns as doubles, nulls kept; columns of other types are left out."""
    df = nan_to_null(df)
    fields = fields_of({"": df})
    dropped = {f.name: f"type {f.dtype} has no numeric form" for f in fields if f.kind == "other"}
    kept = [f for f in fields if f.kind != "other"]
    coded = label_encode(df.select(*[f.col for f in kept]), rows_per_task)
    return Encoded(coded.select(*[as_number(f).alias(f.name) for f in kept]), dropped)


def median_impute(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> Encoded:
    """Fill nulls of each numeric column with its exact median.

    Medians are only looked for where there are nulls. Columns without any
    value have no median and are left out.
    """
    datasets = {"": nan_to_null(df)}
    fields = fields_of(datasets)
    numeric = [f for f in fields if f.kind in NUMERIC]
    sums = small_table(
        per_column(datasets, numeric, lambda f: {**count_measures(f), **number_measures(f)})
    )
    counts = {r.id: r for r in sums.collect()}
    empty = [f for f in numeric if counts[f.id].n_null == counts[f.id].n_total]
    holed = [f for f in numeric if 0 < counts[f.id].n_null < counts[f.id].n_total]
    medians = quantiles(datasets, holed, spans_of(sums), [0.5], rows_per_task) if holed else {}
    shown = []
    for f in fields:
        if f in empty:
            continue
        if f.id in medians:
            shown.append(F.coalesce(f.col.cast("double"), F.lit(medians[f.id][0])).alias(f.name))
        else:
            shown.append(f.col)
    table = datasets[""].select(*shown)
    return Encoded(table, {f.name: "no values to take a median of" for f in empty})


def encode_features(df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> Encoded:
    """Numbers in place of labels, flags and times, and no nulls left."""
    numbers = to_numbers(df, rows_per_task)
    filled = median_impute(numbers.table, rows_per_task)
    return Encoded(filled.table, {**numbers.dropped, **filled.dropped})
