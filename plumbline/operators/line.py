"""Sorted runs of numbers, spread over tasks, and counts of what lies within reach on a line.

Values of a feature are range-partitioned and packed in sorted order into runs of bounded
length. How many rows each run has, and its least and greatest value, are known for all
runs (a row per run), so the position of a value is known wherever no run has values on
both sides of it. Nearly all ends of a reach lie in the row's own run or between runs; the
others are sent to the one run that holds them. So rows are sorted once, not once per end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plumbline.functions.numbers import digamma
from plumbline.session import discard, store

# Rows of a run, and rows of all features that are sorted at a time.
RUN_ROWS = 1 << 16
ROWS_AT_ONCE = 20_000_000
# Edges of runs, a row per run and class in it, that are broadcast.
BROADCAST_EDGES = 50_000

ENDS = "feature int, m long, n long, run long, id long, value double, after boolean, sign int"
_ENDS = pa.schema([
    ("feature", pa.int32()), ("m", pa.int64()), ("n", pa.int64()), ("run", pa.int64()), ("id", pa.int64()),
    ("value", pa.float64()), ("after", pa.bool_()), ("sign", pa.int32()),
])


def _numbers(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def _packed(carried: list[str], run_rows: int, schema: pa.Schema):
    """A partition's rows in order of feature and value, run by run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(b.column("feature").to_numpy(), *(_numbers(b.column(c)) for c in ("x", *carried))) for b in batches]
        if not rows:
            return
        feature, *values = (np.concatenate(v) for v in zip(*rows))
        order = np.lexsort((values[0], feature))
        feature, values = feature[order], [v[order] for v in values]
        run = TaskContext.get().partitionId() << 20
        cuts = [0, *(np.flatnonzero(np.diff(feature)) + 1).tolist(), len(feature)]
        for low, high in zip(cuts[:-1], cuts[1:]):
            for at in range(low, high, run_rows):
                part = [v[at : min(high, at + run_rows)] for v in values]
                x = part[0]
                row = [feature[at], run, len(x), x[0], x[-1], *(v.tobytes() for v in part)]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
                run += 1

    return work


def sorted_runs(rows: DataFrame, carried: list[str], n_rows: int, rows_per_task: int) -> DataFrame:
    """(feature, run, n, low, high, x, *carried): numbers packed in order, stored.

    ``rows`` has (feature, x, row) and the carried numbers; ``row`` only spreads equal values.
    """
    spark = rows.sparkSession
    slices = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // rows_per_task))
    schema = StructType.fromDDL("feature int, run long, n long, low double, high double")
    for c in ("x", *carried):
        schema = schema.add(c, "binary")
    spread = rows.select("feature", "x", *carried, "row").repartitionByRange(slices, "feature", "x", "row").drop("row")
    work = _packed(carried, min(RUN_ROWS, rows_per_task), to_arrow_schema(schema))
    return store(spread.mapInArrow(work, schema), "runs")


class Places:
    """Where each run of a feature stands; positions of values as far as they follow from that."""

    def __init__(self, runs: list[tuple[int, int, float, float]]):
        runs = sorted(runs, key=lambda r: (r[2], r[3]))
        self.run = [r[0] for r in runs]
        self.n = np.array([r[1] for r in runs])
        self.low, self.high = (np.array([r[i] for r in runs]) for i in (2, 3))
        self.ahead = np.concatenate([[0], np.cumsum(self.n)])
        self.at = {r: i for i, r in enumerate(self.run)}

    def position(self, x: np.ndarray, mine: int, value: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rows less than each value, or not greater if ``after``; the run to ask, -1 if none)."""
        first = np.searchsorted(self.high, value, "left")
        last = np.searchsorted(self.low, value, "right") - 1
        held = np.where(after, last, first)
        inside = np.clip(held, 0, len(self.run) - 1)
        some = (held == inside) & np.where(after, self.high[inside] > value, self.low[inside] < value)
        before = self.ahead[held + after]
        here = some & (inside == mine)
        near = np.where(after, np.searchsorted(x, value, "right"), np.searchsorted(x, value, "left"))
        before = np.where(here, self.ahead[mine] + near, before)
        return before, np.where(some & ~here, inside, -1)


def _ends(places: Places, feature: int, run: int, x: np.ndarray, far: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    """How often each count occurs, and what has to be asked of other runs for the rest.

    Ends are open, unless nothing is closer than an equal row. An end at the neighbour
    takes the neighbour's own value, so that rounding cannot move it across. The other
    end may round to the row's own value, as below a power of two, where numbers lie
    closer than above; an open reach holds the row itself all the same.
    """
    tied = far == 0
    on_end = np.abs(at - x) == far
    low = np.where(on_end & (at < x), at, x - far)
    high = np.where(on_end & (at > x), at, x + far)
    low = np.where(tied, low, np.minimum(low, np.nextafter(x, -np.inf)))
    high = np.where(tied, high, np.maximum(high, np.nextafter(x, np.inf)))
    mine = places.at[run]
    left, ask_left = places.position(x, mine, low, ~tied)
    right, ask_right = places.position(x, mine, high, tied)
    known = (ask_left < 0) & (ask_right < 0)
    m, n = np.unique((right - left)[known], return_counts=True)
    nothing = np.zeros(len(m), np.int64)
    parts = [(m, n, nothing - 1, nothing, nothing * 0.0, nothing > 0, nothing)]
    if not known.all():
        asked = np.flatnonzero(~known)
        keys = np.stack([low[asked], high[asked], tied[asked]])
        _, some, n = np.unique(keys, axis=1, return_index=True, return_counts=True)
        some = asked[some]
        ids = (run << 17) + np.arange(len(some))
        base = np.where(ask_right[some] < 0, right[some], 0) - np.where(ask_left[some] < 0, left[some], 0)
        for ask, value, after, sign in ((ask_left, low, ~tied, -1), (ask_right, high, tied, 1)):
            mask = ask[some] >= 0
            who = some[mask]
            # what is known of a count goes with the first of its ends
            known_part = base[mask] if sign < 0 else np.where(ask_left[who] >= 0, 0, base[mask])
            target = np.array(places.run)[ask[who]]
            parts.append((known_part, n[mask], target, ids[mask], value[who], after[who], np.full(len(who), sign)))
    m, n, target, ids, value, after, sign = (np.concatenate(v) for v in zip(*parts))
    columns = [np.full(len(m), feature, np.int32), m, n, target, ids, value, after, sign.astype(np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _ENDS)], schema=_ENDS)


def _unpacked(batch: pa.RecordBatch, names: list[str]) -> Iterator[tuple]:
    for i in range(batch.num_rows):
        packed = (np.frombuffer(batch.column(c)[i].as_py(), np.float64) for c in names)
        yield (i, batch.column("feature")[i].as_py(), batch.column("run")[i].as_py(), *packed)


def known_places(runs: DataFrame) -> dict[int, Places]:
    """A row per run, RUN_ROWS data rows, comes to the driver."""
    found: dict[int, list] = {}
    for r in runs.select("feature", "run", "n", "low", "high").collect():
        found.setdefault(r.feature, []).append((r.run, r.n, r.low, r.high))
    return {f: Places(rs) for f, rs in found.items()}


def mean_digamma(runs: DataFrame, ends: DataFrame) -> list:
    """(feature, total, of_m) of the counts in ``ends``, those asked of other runs included."""
    ends = store(ends, "ends")
    asks = ends.where("run >= 0")

    def answer(key, asked: pa.Table, held: pa.Table) -> pa.Table:
        m = np.zeros(asked.num_rows, np.int64)
        if asked.num_rows:
            x = np.frombuffer(held.column("x")[0].as_py(), np.float64)
            value, after = _numbers(asked.column("value")), asked.column("after").to_numpy()
            place = np.where(after, np.searchsorted(x, value, "right"), np.searchsorted(x, value, "left"))
            m = asked.column("m").to_numpy() + asked.column("sign").to_numpy() * (place + held.column("ahead")[0].as_py())
        return pa.table({"feature": asked.column("feature"), "id": asked.column("id"), "m": m, "n": asked.column("n")})

    counts = ends.where("run < 0").select("feature", "m", "n")
    if not asks.isEmpty():
        places = known_places(runs)
        ahead = [(f, run, int(p.ahead[i])) for f, p in places.items() for i, run in enumerate(p.run)]
        ahead = runs.sparkSession.createDataFrame(ahead, "feature int, run long, ahead long")
        wanted = asks.select("feature", "run").distinct()
        held = runs.select("feature", "run", "x").join(F.broadcast(wanted), ["feature", "run"], "left_semi")
        held = held.join(F.broadcast(ahead), ["feature", "run"])
        parts = asks.groupBy("feature", "run").cogroup(held.groupBy("feature", "run")).applyInArrow(
            answer, "feature int, id long, m long, n long"
        )
        whole = parts.groupBy("feature", "id").agg(F.sum("m").alias("m"), F.max("n").alias("n"))
        counts = counts.unionByName(whole.select("feature", "m", "n"))
    counts = counts.groupBy("feature", "m").agg(F.sum("n").alias("n"))
    found = counts.groupBy("feature").agg(
        F.sum("n").alias("total"), (F.sum(F.col("n") * digamma(F.col("m"))) / F.sum("n")).alias("of_m")
    ).collect()
    discard(ends)
    return found


def _first_and_last(k: int, schema: pa.Schema):
    """The first and last k values of each class in a run."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, feature, run, x, y in _unpacked(batch, ["x", "y"]):
                order = np.argsort(y, kind="stable")
                x, y = x[order], y[order]
                starts = np.flatnonzero(np.concatenate([[True], y[1:] != y[:-1]]))
                sizes = np.diff(np.append(starts, len(y)))
                place = np.arange(len(y)) - np.repeat(starts, sizes)
                lengths = np.concatenate([[0], np.cumsum(np.minimum(sizes, k))])
                first, last = x[place < k], x[place >= np.repeat(sizes, sizes) - k]
                columns = [np.full(len(starts), feature), np.full(len(starts), run), y[starts]]
                lists = [pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(v)) for v in (first, last)]
                arrays = [pa.array(c, f.type) for c, f in zip(columns, schema)]
                yield pa.RecordBatch.from_arrays([*arrays, *(v.cast(f.type) for v, f in zip(lists, list(schema)[3:]))], schema=schema)

    return work


def _class_reach(x: np.ndarray, y: np.ndarray, beside: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """How far the k-th nearest row of the same class is, or the last, and its value."""
    edges = [(v, e["y"]) for e in beside for v in (*e["before"], *e["after"])]
    near = np.array(edges, np.float64).reshape(-1, 2)
    values, classes = np.concatenate([x, near[:, 0]]), np.concatenate([y, near[:, 1]])
    order = np.lexsort((values, classes))
    values, classes = values[order], classes[order]
    own = np.flatnonzero(order < len(x))
    far = np.full((len(own), 2 * k), np.inf)
    at = np.zeros((len(own), 2 * k))
    for j in range(1, k + 1):
        for column, step in ((j - 1, -j), (k + j - 1, j)):
            other = np.clip(own + step, 0, len(values) - 1)
            same = (other == own + step) & (classes[other] == classes[own])
            far[same, column] = np.abs(values[other] - values[own])[same]
            at[same, column] = values[other][same]
    nearest = np.argsort(far, axis=1, kind="stable")  # of equally far ones those below come first
    kth = np.minimum(k, np.isfinite(far).sum(axis=1)) - 1
    chosen = np.take_along_axis(nearest, kth[:, None], axis=1)
    out = np.empty((2, len(x)))
    out[0, order[own]] = np.take_along_axis(far, chosen, axis=1)[:, 0]
    out[1, order[own]] = np.take_along_axis(at, chosen, axis=1)[:, 0]
    return out[0], out[1]


def class_counts(rows: DataFrame, n_rows: int, k: int, rows_per_task: int) -> list:
    """(feature, total, of_m) for (feature, x, y, row), where every class y has two rows or more.

    m is how many rows of any class lie nearer than a row's k-th neighbour of its own class.
    """
    spark = rows.sparkSession
    runs = sorted_runs(rows, ["y"], n_rows, rows_per_task)
    schema = StructType.fromDDL("feature int, run long, y double, first array<double>, last array<double>")
    edges = store(runs.select("feature", "run", "x", "y").mapInArrow(_first_and_last(k, to_arrow_schema(schema)), schema), "edges")
    places = known_places(runs)
    sent = spark.sparkContext.broadcast(places)
    # runs in order of their values; a class has at least one value in each run that holds it
    rank = [(f, run, i) for f, p in places.items() for i, run in enumerate(p.run)]
    rank = spark.createDataFrame(rank, "feature int, run long, place int")
    line = Window.partitionBy("feature", "y").orderBy("place")
    before = F.flatten(F.collect_list("last").over(line.rowsBetween(-k, -1)))
    after = F.flatten(F.collect_list("first").over(line.rowsBetween(1, k)))
    beside = edges.join(F.broadcast(rank), ["feature", "run"]).select("feature", "run", "y", before.alias("before"), after.alias("after"))
    beside = beside.select(
        "feature", "run",
        F.struct("y", F.slice("before", F.greatest(F.size("before") - k + 1, F.lit(1)), k).alias("before"), F.slice("after", 1, k).alias("after")).alias("edge"),
    )
    beside = beside.groupBy("feature", "run").agg(F.collect_list("edge").alias("beside"))
    if edges.count() <= BROADCAST_EDGES:
        beside = F.broadcast(beside)

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, feature, run, x, y in _unpacked(batch, ["x", "y"]):
                far, at = _class_reach(x, y, batch.column("beside")[i].as_py(), k)
                yield _ends(sent.value[feature], feature, run, x, far, at)

    found = mean_digamma(runs, runs.select("feature", "run", "x", "y").join(beside, ["feature", "run"]).mapInArrow(reached, ENDS))
    discard(edges, runs)
    return found


def axis_counts(reach: DataFrame, n_rows: int, rows_per_task: int) -> list:
    """(feature, total, of_m) for (feature, x, far, at, row): rows nearer along one axis than ``far``, self included."""
    runs = sorted_runs(reach, ["far", "at"], n_rows, rows_per_task)
    sent = reach.sparkSession.sparkContext.broadcast(known_places(runs))

    def reached(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, feature, run, x, far, at in _unpacked(batch, ["x", "far", "at"]):
                yield _ends(sent.value[feature], feature, run, x, far, at)

    found = mean_digamma(runs, runs.select("feature", "run", "x", "far", "at").mapInArrow(reached, ENDS))
    discard(runs)
    return found
