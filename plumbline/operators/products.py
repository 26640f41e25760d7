"""Correlations of very many columns, by blocked products of the standardised columns.

Columns are cut into blocks. A task adds up the products of a few pairs of blocks over
its rows, then the partial sums of each pair of blocks meet, and the pairs of columns
that are wanted are picked where a block is complete. What any process holds is bounded
by the blocks, and what returns is the wanted pairs: there is no matrix of all columns.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from plumbline.functions.fields import column, local_table, union_all

# Columns in a block, and pairs of blocks that a task adds up at a time.
BLOCK = 256
PAIRS_PER_SCAN = 64
FOUND = "feature_a string, feature_b string, r double"


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    values = batch.column("v")
    return values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1)


def _numbers(table: DataFrame, names: list[str]) -> DataFrame:
    """One array of doubles per row, in no more tasks than keep all cores busy: each sends its sums."""
    n = 4 * table.sparkSession.sparkContext.defaultParallelism
    return table.select(F.array(*[column(c).cast("double") for c in names]).alias("v")).coalesce(n)


def column_moments(table: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
    """(means, population deviations, rows) of all columns in one scan, whatever their number.

    Sums are taken off each column's value in some row, so that a mean far larger
    than the deviation costs no digits. A row per column returns to the driver.
    """
    numbers = _numbers(table, names)
    one = numbers.first()
    if one is None:
        return np.zeros(len(names)), np.zeros(len(names)), 0
    off = np.array(one.v, float)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, squares = 0, np.zeros(len(off)), np.zeros(len(off))
        for batch in batches:
            x = _matrix(batch) - off
            n += len(x)
            sums += x.sum(axis=0)
            squares += np.einsum("ij,ij->j", x, x)
        if n:
            columns = [np.arange(len(off)), np.full(len(off), n), sums, squares]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["at", "n", "s", "q"])

    parts = numbers.mapInArrow(work, "at long, n long, s double, q double")
    rows = parts.groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).collect()
    n = rows[0].n
    means, deviations = np.zeros(len(names)), np.zeros(len(names))
    for r in rows:
        mean = r.s / n
        means[r.at], deviations[r.at] = off[r.at] + mean, np.sqrt(max(r.q / n - mean * mean, 0.0))
    # what is left of equal values after rounding is no deviation
    deviations[deviations <= 1e-12 * np.abs(means)] = 0.0
    return means, deviations, n


def _slices(size: int) -> list[slice]:
    return [slice(at, min(at + BLOCK, size)) for at in range(0, size, BLOCK)]


def _partial(pairs: list[tuple[int, int]], cuts: list[slice], means: np.ndarray, scales: np.ndarray):
    """Sums of products over a task's rows, for the given pairs of blocks."""
    used = sorted({i for pair in pairs for i in pair})

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            x = _matrix(batch)
            blocks = {i: (x[:, cuts[i]] - means[cuts[i]]) * scales[cuts[i]] for i in used}
            for pair in pairs:
                product = blocks[pair[0]].T @ blocks[pair[1]]
                sums[pair] = sums[pair] + product if pair in sums else product
        for (i, j), part in sums.items():
            columns = [pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([part.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["i", "j", "part"])

    return work


def _complete(cuts: list[slice], n_rows: int, least: float, target: int | None):
    """Add up the partial sums of each pair of blocks, which come one after another, and pick its pairs."""

    def picked(i: int, j: int, sums: np.ndarray) -> pa.RecordBatch:
        r = np.clip(sums / n_rows, -1.0, 1.0)
        wanted = ~(np.abs(r) < least)
        if i == j:
            wanted &= np.triu(np.ones_like(wanted), 1)
        a, b = np.nonzero(wanted)
        columns = [pa.array(a + cuts[i].start), pa.array(b + cuts[j].start), pa.array(r[a, b])]
        made = pa.RecordBatch.from_arrays(columns, ["a", "b", "r"])
        if target is None:
            return made
        ends = (a + cuts[i].start, b + cuts[j].start)
        return made.filter(pa.array((ends[0] == target) | (ends[1] == target)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None
        for batch in batches:
            for i, j, part in zip(*[batch.column(c).to_pylist() for c in ("i", "j", "part")]):
                shape = (cuts[i].stop - cuts[i].start, cuts[j].stop - cuts[j].start)
                part = np.frombuffer(part).reshape(shape)
                if (i, j) != now:
                    if now:
                        yield picked(*now, sums)
                    now, sums = (i, j), part
                else:
                    sums = sums + part
        if now:
            yield picked(*now, sums)

    return work


def blocked_correlations(
    table: DataFrame, names: list[str], least: float = 0.0, target: str | None = None
) -> DataFrame:
    """(feature_a, feature_b, r) of columns without nulls, in their order, with \\|r\\| of at least ``least``.

    With ``target``, one of the names, only the pairs that it is part of. A pair
    with a constant column, or one with infinite values, has no r and is left
    out, as is everything for a table without rows. One scan for the moments,
    then one per PAIRS_PER_SCAN pairs of blocks.
    """
    spark = table.sparkSession
    means, deviations, n_rows = column_moments(table, names)
    varying = [i for i in range(len(names)) if np.isfinite(deviations[i]) and deviations[i] > 0]
    if len(varying) < 2:
        return local_table(spark, [], FOUND)
    kept = [names[i] for i in varying]
    means, scales = means[varying], 1.0 / deviations[varying]
    cuts = _slices(len(kept))
    pairs = list(combinations_with_replacement(range(len(cuts)), 2))
    at = None
    if target is not None:
        if target not in kept:
            return local_table(spark, [], FOUND)
        at = kept.index(target)
        pairs = [p for p in pairs if at // BLOCK in p]
    numbers = _numbers(table, kept)
    parts = [
        numbers.mapInArrow(_partial(pairs[s : s + PAIRS_PER_SCAN], cuts, means, scales), "i int, j int, part binary")
        for s in range(0, len(pairs), PAIRS_PER_SCAN)
    ]
    together = union_all(parts).repartition("i", "j").sortWithinPartitions("i", "j")
    found = together.mapInArrow(_complete(cuts, n_rows, least, at), "a long, b long, r double")
    # a row per column
    named = local_table(spark, list(enumerate(kept)), "at long, feature string")
    first = named.select(F.col("at").alias("a"), F.col("feature").alias("feature_a"))
    second = named.select(F.col("at").alias("b"), F.col("feature").alias("feature_b"))
    return found.join(F.broadcast(first), "a").join(F.broadcast(second), "b").select("feature_a", "feature_b", "r")
