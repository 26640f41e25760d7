"""Mix sources to target weights: choose whole documents so that each source's words meet its budget.

A source's target gives whole passes over all its documents and a budget beyond
them. Documents are counted by exact length; every length gives its share of the
budget, rounded down, and what remains is fitted as a subset sum: long documents
first, then bounded-knapsack dynamic programming over documents to add and to drop.
Which documents of a length are taken follows a seeded hash of their ids.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from plumbline.llm.tables import carried, same_row, stash, unpacked, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SEED = 17
# Words that the dynamic program may be off the greedy choice at first, and at most (or four of the longest documents).
PROGRAM, LARGEST = 1 << 16, 1 << 24
# Hash slices of a (source, length) group; only the slice at the edge is sorted.
SLICES = 4096


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """Add ``target`` to (source, key, words), one row per source.

    Weights go round the sources in code point order, NULL last. ``share`` of all
    words is dealt by weight; a source gets ``most`` times its words at most and
    the excess goes round again. The level at which that ends is found directly:
    sources reach their limit in the order of limit per weight.
    """
    place = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.get(F.array(*[F.lit(w) for w in weights]), place % len(weights))
    rows = sizes.withColumn("weight", weight).withColumn("limit", most * F.col("words"))
    rows = rows.withColumn("ratio", F.col("limit") / F.col("weight"))
    order = Window.orderBy("ratio", F.asc_nulls_last("source"))
    ahead, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent = F.coalesce(F.sum("limit").over(ahead), F.lit(0))
    gone = F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    level = (share * F.sum("words").over(all_) - spent) / (F.sum("weight").over(all_) - gone)
    rows = rows.withColumn("level", level).withColumn("rank", F.row_number().over(order))
    fits = F.when(F.col("level") <= F.col("ratio"), F.struct("rank", "level"))
    found = F.min(fits).over(all_)["level"]
    target = F.least(F.col("limit").cast("double"), found * F.col("weight"))
    return rows.select("source", "key", "words", F.coalesce(target, F.col("limit").cast("double")).alias("target"))


def fit(
    lengths: np.ndarray, counts: np.ndarray, budget: int, program: int = PROGRAM, start: np.ndarray | None = None
) -> np.ndarray:
    """How many documents of each length to take so that their words come closest to the budget from below.

    From ``start`` (nothing by default, at most the budget) what fits is added, long
    documents first; then dynamic programming over documents to add and to drop
    looks for what is left. Sums on the way stay in a window of at least four of the
    longest documents, which grows to LARGEST or all documents while words are left.
    """
    taken = np.zeros(len(lengths), np.int64) if start is None else start.copy()
    if (counts * lengths).sum() <= budget:
        return counts.astype(np.int64)
    unit = int(np.gcd.reduce(lengths[counts > 0]))
    lengths, left = lengths // unit, budget // unit - int((taken * lengths).sum()) // unit
    for i in [i for i in np.argsort(-lengths, kind="stable") if counts[i]]:
        more = min(int(counts[i] - taken[i]), left // int(lengths[i]))
        taken[i] += more
        left -= more * int(lengths[i])
    wide = max(program, 4 * int(lengths[counts > 0].max()))
    while left > 0:
        full = max(int((taken * lengths).sum()), int(((counts - taken) * lengths).sum()))
        change, gain = _exchange(lengths, counts - taken, taken, left, min(wide, full))
        taken, left = taken + change, left - gain
        if wide >= full or wide >= LARGEST:
            break
        wide *= 4
    return taken


def _exchange(lengths: np.ndarray, spare: np.ndarray, taken: np.ndarray, left: int, wide: int) -> tuple[np.ndarray, int]:
    """Documents to add (or drop, below 0) of each length whose sum is closest to ``left`` from below, and the sum."""
    size = left + 2 * wide + 1  # bit s: a change by s - wide is reached
    mask, reach, goal = (1 << size) - 1, 1 << wide, left + wide
    step, pieces = np.full(size, -1, np.int32), []
    for i in [i for i in np.argsort(lengths, kind="stable").tolist() if spare[i] or taken[i]]:
        for sign, most in ((1, int(spare[i])), (-1, int(taken[i]))):
            most, piece = min(most, (left + wide) // int(lengths[i])), 1
            while most > 0 and not reach >> goal & 1:
                n = min(piece, most)
                most, piece = most - n, piece * 2
                by = n * int(lengths[i])
                fresh = (reach << by if sign > 0 else reach >> by) & mask & ~reach
                if fresh:
                    reach |= fresh
                    bits = np.frombuffer(fresh.to_bytes(size // 8 + 1, "little"), np.uint8)
                    step[np.flatnonzero(np.unpackbits(bits, bitorder="little"))] = len(pieces)
                    pieces.append((i, sign * n))
    at = (reach & ((1 << (goal + 1)) - 1)).bit_length() - 1
    change, gain = np.zeros(len(lengths), np.int64), at - wide
    while step[at] >= 0:  # a sum was reached from one that an earlier piece had reached
        i, n = pieces[step[at]]
        change[i] += n
        at -= n * int(lengths[i])
    return change, gain


def _fit_source(group: pd.DataFrame) -> pd.DataFrame:
    """Whole copies, and documents with one more, per length of one source: a row per distinct length comes in."""
    budget, words, whole = (int(group[c].iloc[0]) for c in ("budget", "words", "whole"))
    lengths, counts = group["size"].to_numpy(np.int64), group["n"].to_numpy(np.int64)
    share = np.minimum(np.floor(counts * (budget / words)).astype(np.int64), counts)
    extra = fit(lengths, counts, budget, start=share)
    base = np.full(len(lengths), whole, np.int64)
    target = whole * words + budget
    if (extra * lengths).sum() < budget:
        # leaving some documents out to take others again may come closer
        copies = fit(lengths, int(group["most"].iloc[0]) * counts, target, start=whole * counts + extra)
        if (copies * lengths).sum() > whole * words + (extra * lengths).sum():
            base, extra = np.divmod(copies, counts)
    return pd.DataFrame({"key": group["key"], "size": group["size"], "base": base, "extra": extra})


def mix_sources(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    most: int = MOST,
    seed: int = SEED,
) -> DataFrame:
    """(id, th, source, size, source_size, target, copies, taken) of every row.

    ``size`` counts the words; a NULL text has none and is never taken, NULL is a
    source of its own. A document is taken 0 to ``most`` times, whole. Repeated
    rows are documents of their own; which of them is taken makes no difference.
    An empty table gives an empty result.
    """
    size = F.regexp_count(whole_text(text_col), F.lit(WORD)).cast("long")
    rows = stash(
        docs.select(
            F.col(id_col).alias("id"), F.xxhash64(whole_text(text_col)).alias("th"), F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("key"),
            size.alias("size"),
        ),
        "sizes",
    )
    lengths = rows.groupBy("source", "key", "size").agg(F.count(F.lit(1)).alias("n"))
    lengths = stash(lengths, "lengths")
    sizes = lengths.groupBy("source", "key").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    aims = targets(sizes, weights, share, most)
    whole = F.when(F.col("words") > 0, F.floor(F.col("target") / F.col("words"))).otherwise(0)
    aims = aims.withColumn("whole", F.least(whole, F.lit(most)).cast("long"))
    budget = F.when(F.col("whole") < most, F.round("target").cast("long") - F.col("whole") * F.col("words")).otherwise(0)
    aims = stash(aims.withColumn("budget", F.least(F.greatest(budget, F.lit(0)), F.col("words"))), "aims")

    work = lengths.where("size > 0").select("key", "size", "n").join(aims.where("budget > 0"), "key")
    work = work.select("key", "size", "n", "budget", "words", "whole", F.lit(most).alias("most"))
    extra = work.groupBy("key").applyInPandas(_fit_source, "key string, size long, base long, extra long")

    # Slices before the edge are taken whole, the one at the edge in hash order.
    draw = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("th"))
    rows = rows.withColumn("draw", draw).withColumn("slice", F.pmod("draw", F.lit(SLICES)))
    slices = rows.where("size > 0").groupBy("key", "size", "slice").agg(F.count(F.lit(1)).alias("n"))
    slices = slices.join(extra, ["key", "size"])
    ahead = Window.partitionBy("key", "size").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("left", F.col("extra") - F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    slices = slices.select("key", "size", "slice", "base", F.col("n").alias("n_slice"), F.greatest("left", F.lit(0)).alias("left"))
    joined = rows.join(slices, ["key", "size", "slice"], "left")
    edge = joined.where("left > 0 AND left < n_slice")
    rank = F.row_number().over(Window.partitionBy("key", "size", "slice").orderBy("draw", "id", "th"))
    edge = edge.withColumn("more", (rank <= F.col("left")).cast("int"))
    sure = joined.where("left IS NULL OR left = 0 OR left >= n_slice")
    sure = sure.withColumn("more", F.coalesce((F.col("left") > 0).cast("int"), F.lit(0)))
    copies = F.when(F.col("size") > 0, F.coalesce("base", "whole") + F.col("more")).otherwise(F.lit(0))
    aims = aims.select("key", F.col("words").alias("source_size"), "target", "whole")
    return (
        sure.unionByName(edge).join(aims, "key").withColumn("copies", copies.cast("long"))
        .select("id", "th", "source", "size", "source_size", "target", "copies",
                (F.col("copies") * F.col("size")).alias("taken"))
    )


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, with ``size``, ``source_size``, ``target`` and ``taken`` (words, repeats counted).

    Columns of ``docs`` with these names are replaced. Of rows equal in id and
    text each is returned with the same, summed figures once.
    """
    found = mix_sources(docs, id_col, text_col, source_col).where("taken > 0")
    found = found.groupBy("id", "th").agg(
        F.max("size").alias("size"), F.max("source_size").alias("source_size"), F.max("target").alias("target"),
        F.sum("taken").alias("taken"), F.count(F.lit(1)).alias("n"),
    )
    found = stash(found, "taken")
    rows = carried(docs, id_col, text_col)
    joined = rows.join(found, same_row(rows, found)).select(rows["*"], "size", "source_size", "target", "taken", "n")
    if not found.where("n > 1").isEmpty():
        joined = joined.dropDuplicates(["id", "th"])
    made = ["size", "source_size", "target", "taken"]
    return joined.select(*unpacked([c for c in docs.columns if c not in made]), *made)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix_sources(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")
