"""Positions in sorted order and exact quantiles, without one task per column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.functions.fields import Datasets, Field, local_table, union_all
from plumbline.session import freeze

# Sorted groups up to this many rows go to a single window task.
ROWS_PER_TASK = 1_000_000
# Spans of more rows than this are narrowed before values are compared.
SPAN_ROWS = 100_000
# Histogram cells per narrowing round, and how many rounds are tried.
CELLS = 4096
ROUNDS = 4


def running_totals(
    rows: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    weight: str,
    sliced: bool,
) -> DataFrame:
    """Add ``before``: the weight of all rows of the group that sort earlier.

    ``rows`` must be distinct in (group, order). A plain window sorts each group
    in one task. With ``sliced`` the rows are range-partitioned instead, so that
    a group of any size spreads over all tasks: each slice adds up its own rows
    and starts from the total of the slices ahead of it. The slice number is
    frozen in a checkpoint because range bounds are sampled anew per run.
    """
    order_by = [F.asc_nulls_first(c) for c in order]
    if not sliced:
        ahead = Window.partitionBy(*group).orderBy(*order_by)
        ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn("before", F.coalesce(F.sum(weight).over(ahead), F.lit(0)))

    keys = [*[F.asc_nulls_first(c) for c in group], *order_by]
    n_slices = max(_slices(rows.sparkSession), -(-rows.count() // ROWS_PER_TASK))
    slices = freeze(
        rows.repartitionByRange(n_slices, *keys).withColumn(
            "slice", F.spark_partition_id()
        )
    )
    # At most one row per slice and group that touches it.
    totals = slices.groupBy(*group, "slice").agg(F.sum(weight).alias("in_slice"))
    earlier = Window.partitionBy(*group).orderBy("slice")
    earlier = earlier.rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group, "slice", F.coalesce(F.sum("in_slice").over(earlier), F.lit(0)).alias("offset")
    )
    inside = Window.partitionBy(*group, "slice").orderBy(*order_by)
    inside = inside.rowsBetween(Window.unboundedPreceding, -1)
    return (
        slices.withColumn("before", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
        .join(offsets, [*group, "slice"])
        .withColumn("before", F.col("before") + F.col("offset"))
        .drop("slice", "offset")
    )


def _slices(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def long_numbers(datasets: Datasets, fields: Sequence[Field]) -> DataFrame:
    """All non-null values of numeric fields as rows (id, value)."""
    parts = []
    for name, df in datasets.items():
        mine = [f for f in fields if f.dataset == name]
        if mine:
            wide = df.select(*[f.col.cast("double").alias(str(f.id)) for f in mine])
            parts.append(wide.unpivot([], [str(f.id) for f in mine], "id", "value"))
    return union_all(parts).where("value IS NOT NULL").withColumn("id", F.col("id").cast("int"))


def quantiles(
    datasets: Datasets,
    fields: Sequence[Field],
    spans: dict[int, tuple[int, float, float]],
    probabilities: Sequence[float],
    rows_per_task: int = ROWS_PER_TASK,
) -> dict[int, list[float]]:
    """Exact quantiles of numeric fields, interpolated between order statistics.

    ``spans`` gives (number of non-null values, least, greatest) per field id.
    Long columns are narrowed first: histogram counts find the cell that holds
    each wanted rank, and only rows of that cell are looked at again. Cells that
    stay longer than ``rows_per_task`` are ranked in slices. Each round is a scan with map-side counting; what returns
    to the driver is one row per field and quantile.
    """
    wanted = {}  # (field id, probability) -> (rank, rows below the span, lo, hi, rows inside)
    for f in fields:
        n, low, high = spans[f.id]
        if n:
            for p in probabilities:
                wanted[f.id, p] = (p * (n - 1), 0, low, high, n)
    if not wanted:
        return {f.id: [None] * len(probabilities) for f in fields}

    numbers = long_numbers(datasets, [f for f in fields if spans[f.id][0]])
    found = select_ranks(numbers, wanted, rows_per_task)
    return {f.id: [found.get((f.id, p)) for p in probabilities] for f in fields}


def select_ranks(numbers: DataFrame, wanted: dict, rows_per_task: int = ROWS_PER_TASK) -> dict:
    """Values at 0-based ranks of (id, value) rows; fractions are interpolated.

    ``wanted`` maps (id, name of the rank) to (rank, rows below the span, lowest
    and highest value of the span, rows in the span).
    """
    spark = numbers.sparkSession
    wanted = dict(wanted)
    for _ in range(ROUNDS):
        limit = min(rows_per_task, SPAN_ROWS)
        wide = {k: w for k, w in wanted.items() if w[4] > limit and w[2] < w[3]}
        if not wide:
            break
        wanted.update(_narrow(spark, numbers, wide))
    sliced = any(w[4] > rows_per_task for w in wanted.values())
    return _select(spark, numbers, wanted, sliced)


def _span_tables(spark, wanted):
    """Spans to look into, each once, and the ranks wanted from each."""
    spans, ranks = {}, []
    for (i, p), (rank, below, low, high, _) in wanted.items():
        span = spans.setdefault((i, low, high), (len(spans), i, below, low, high))
        ranks.append((span[0], i, p, rank))
    return (
        local_table(
            spark,
            list(spans.values()), "span int, id int, below long, low double, high double"
        ),
        local_table(spark, ranks, "span int, id int, p double, rank double"),
    )


def _inside(numbers, spans):
    return numbers.join(F.broadcast(spans), "id").where("value BETWEEN low AND high")


def _narrow(spark, numbers, wanted):
    """Cut each span to the histogram cells that hold its two neighbouring ranks."""
    spans, ranks = _span_tables(spark, wanted)
    place = F.try_divide(F.col("value") - F.col("low"), F.col("high") - F.col("low")) * CELLS
    cell = F.when(F.isnan(place), F.lit(CELLS)).otherwise(F.floor(place)).cast("int")
    cells = (
        _inside(numbers, spans)
        .groupBy("span", "below", F.coalesce(cell, F.lit(0)).alias("cell"))
        .agg(F.count(F.lit(1)).alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    )
    ahead = Window.partitionBy("span").orderBy("cell")
    ahead = ahead.rowsBetween(Window.unboundedPreceding, -1)
    held = (
        cells.withColumn("ahead", F.col("below") + F.coalesce(F.sum("n").over(ahead), F.lit(0)))
        .join(F.broadcast(ranks), "span")
        # the cell of floor(rank), and that of the next rank, which may be another one
        .where("ahead + n > floor(rank) AND ahead <= floor(rank) + 1")
        .groupBy("id", "p", "rank")
        .agg(F.min("ahead").alias("ahead"), F.min("lo").alias("lo"),
             F.max("hi").alias("hi"), F.sum("n").alias("n"))
    )
    return {(r.id, r.p): (r.rank, r.ahead, r.lo, r.hi, r.n) for r in held.collect()}


def _select(spark, numbers, wanted, sliced):
    spans, ranks = _span_tables(spark, wanted)
    counted = (
        _inside(numbers, spans)
        .groupBy("span", "below", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )
    ranked = running_totals(counted, ["span", "below"], ["value"], "n", sliced)
    at = F.col("before") + F.col("below")

    def value_at(rank):
        return F.min(F.when((at <= rank) & (rank < at + F.col("n")), F.col("value")))

    picked = (
        ranked.join(F.broadcast(ranks), "span")
        .groupBy("id", "p", "rank")
        .agg(value_at(F.floor("rank")).alias("lower"), value_at(F.floor("rank") + 1).alias("upper"))
    )
    part = F.col("rank") - F.floor("rank")
    step = F.coalesce(F.col("upper") - F.col("lower"), F.lit(0.0))
    value = F.col("lower") + F.when(step == 0, 0.0).otherwise(step * part)
    return {(r.id, r.p): r.value for r in picked.select("id", "p", value.alias("value")).collect()}
