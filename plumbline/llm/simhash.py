"""SimHash fingerprints of word shingles, and links between them by exact tiled comparison.

Distinct fingerprints are sorted by population count, then by the counts of their
four 16-bit parts, and cut into tiles. Two fingerprints at distance d have part counts that
differ by at most d in sum, so a pair of tiles whose ranges of counts lie further
apart than the radius is skipped; the others are compared bit by bit with numpy.
A pair of tiles returns a spanning forest of its links, which connects the same
fingerprints as all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F

from plumbline.llm.components import components
from plumbline.llm.tables import carried, keyed, same_row, stash, trimmed, unpacked

SHINGLE = 3
RADIUS = 3
SEED = 42
# Fingerprints in a tile.
TILE = 2048
# Shingles whose bits are added up at a time.
PART = 1 << 16


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """Majority of the bits of all shingle hashes; 0 for a text without words."""
    words = text.lower().split()  # ASCII letters and white space only, as these are bytes
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(lengths)
    width = min(shingle, len(words))
    starts = np.concatenate([[0], ends[: len(words) - width]])
    total, hashes = len(starts), xxhash.xxh64_intdigest
    stops = ends[width - 1 :] - 1
    ones = np.zeros(64, np.int64)
    for at in range(0, total, PART):
        pairs = zip(starts[at : at + PART].tolist(), stops[at : at + PART].tolist())
        made = np.array([hashes(joined[a:b], SEED) for a, b in pairs], np.uint64)
        ones += np.unpackbits(made.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > total, bitorder="little")
    return int(bits.view(np.uint64)[0])


def _marker(shingle: int):
    @F.pandas_udf("long")
    @trimmed
    def mark(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            made = np.array([fingerprint(t.encode(), shingle) for t in texts], np.uint64)
            yield pd.Series(made.view(np.int64))

    return mark


def part_counts(marks: np.ndarray) -> np.ndarray:
    """Population counts of the four 16-bit parts, one row per fingerprint."""
    return np.bitwise_count(marks.view(np.uint16).reshape(-1, 4)).astype(np.int16)


def forest(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> list[tuple[int, int]]:
    """Links between two tiles that suffice to connect all that are within the radius."""
    counts_a, counts_b = part_counts(a), part_counts(b)
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    out = []
    step = 64
    for low in range(0, len(a), step):
        rows, of = a[low : low + step], counts_a[low : low + step]
        # only columns whose counts are near those of some row of this strip
        gap = np.maximum(counts_b - of.max(axis=0), of.min(axis=0) - counts_b).clip(0).sum(axis=1)
        near = np.flatnonzero(gap <= radius)
        if not len(near):
            continue
        apart = np.bitwise_count(rows[:, None] ^ b[near][None, :])
        left, right = np.nonzero(apart <= radius)
        left, right = left + low, near[right]
        if same:
            left, right = left[left < right], right[left < right]
        for x, y in zip(a[left].tolist(), b[right].tolist()):
            p, q = root(x), root(y)
            if p != q:
                parent[p] = q
                out.append((x, y))
    return out


def mark_links(marks: DataFrame, radius: int = RADIUS, tile: int = TILE) -> DataFrame:
    """(a, b) between distinct fingerprints (column ``mark``) that connect all within the radius.

    Tiles are slices of the fingerprints sorted by part counts, so their ranges
    are narrow. What is compared with what is decided from one row per tile, by
    an equality on the total count that both tiles may hold.
    """
    tiles = stash(marks.select("mark").distinct().mapInArrow(_with_counts, "mark long, total int, c0 int, c1 int, c2 int, c3 int"), "marks")
    n = tiles.count()
    parts = max(1, -(-n // tile))
    order = ["total", "c0", "c1", "c2", "c3", "mark"]
    cut = tiles.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    blocks = stash(cut.mapInArrow(_blocks(tile), _BLOCK), "tiles")

    ranges = blocks.drop("marks")
    left = ranges.select("tile", "low", "high", F.explode(F.sequence("low_total", "high_total")).alias("total"))
    reach = F.sequence(F.col("low_total") - radius, F.col("high_total") + radius)
    right = ranges.select(
        F.col("tile").alias("other"), F.col("low").alias("other_low"), F.col("high").alias("other_high"),
        F.explode(reach).alias("total"),
    )
    gaps = [
        F.greatest(F.col("low")[i] - F.col("other_high")[i], F.col("other_low")[i] - F.col("high")[i], F.lit(0))
        for i in range(4)
    ]
    pairs = left.join(right, "total").where("tile <= other").where(gaps[0] + gaps[1] + gaps[2] + gaps[3] <= radius)
    pairs = pairs.select("tile", "other").distinct()
    other = blocks.select(F.col("tile").alias("other"), F.col("marks").alias("other_marks"))
    work = pairs.join(blocks.select("tile", "marks"), "tile").join(other, "other")
    return work.select("tile", "other", "marks", "other_marks").mapInArrow(_compare(radius), "a long, b long")


_BLOCK = "tile string, marks binary, low array<int>, high array<int>, low_total int, high_total int"


@trimmed
def _with_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column("mark").to_numpy(zero_copy_only=False).astype(np.int64)
        counts = part_counts(marks).astype(np.int32)
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (marks, counts.sum(axis=1, dtype=np.int32), *counts.T)],
            ["mark", "total", "c0", "c1", "c2", "c3"],
        )


def _blocks(tile: int):
    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(0, np.int64)

        def block(marks: np.ndarray) -> pa.RecordBatch:
            counts = part_counts(marks).astype(np.int32)
            totals = counts.sum(axis=1)
            name = f"{marks[0]}"  # distinct fingerprints, so the first one names the tile
            columns = [[name], [marks.tobytes()], [counts.min(axis=0).tolist()], [counts.max(axis=0).tolist()],
                       [int(totals.min())], [int(totals.max())]]
            kinds = [pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32()]
            names = ["tile", "marks", "low", "high", "low_total", "high_total"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

        for batch in batches:
            held = np.concatenate([held, batch.column("mark").to_numpy(zero_copy_only=False)])
            while len(held) >= tile:
                yield block(held[:tile].copy())
                held = held[tile:]
        if len(held):
            yield block(held.copy())

    return work


def _compare(radius: int):
    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = (np.frombuffer(batch.column(c)[i].as_py(), np.int64) for c in ("marks", "other_marks"))
                same = batch.column("tile")[i].as_py() == batch.column("other")[i].as_py()
                links = forest(a, b, radius, same)
                if links:
                    x, y = zip(*links)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], ["a", "b"])

    return work


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS
) -> DataFrame:
    """(id, th, mark, component_id) of every row; ``mark`` is the fingerprint as a signed long.

    Two rows are linked if their fingerprints differ in at most ``radius`` bits;
    the component's id is the least id reachable over links, NULL only if all ids
    are. Texts without words (NULL ones too) have fingerprint zero. Rows with
    equal fingerprints are one node from the start, however many they are; an
    empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col).withColumn("mark", _marker(SHINGLE)("text")).drop("text")
    rows = stash(rows, "fingerprints")
    return grouped(rows, mark_links(rows, radius))


def grouped(rows: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (id, th, mark) with the least id of the component that ``links`` (a, b) between marks make."""
    nodes = components(links)
    marks = rows.groupBy("mark").agg(F.min("id").alias("least"))
    marks = marks.join(nodes.withColumnRenamed("node", "mark"), "mark", "left")
    marks = stash(marks.select("mark", "least", F.coalesce("root", "mark").alias("root")), "roots")
    ids = marks.groupBy("root").agg(F.min("least").alias("component_id"))
    named = marks.join(ids, "root").select("mark", "component_id")
    return rows.join(named, "mark").select("id", "th", "mark", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=near_duplicates) -> DataFrame:
    """The row with the least id of each component that ``find`` gives, all columns as they are.

    Without any id the one with the least text hash stays; of rows that are equal
    in id and text, any one.
    """
    found = find(docs, id_col, text_col)
    counted = found.groupBy("component_id", "id", "th", "mark").agg(F.count(F.lit(1)).alias("n"))
    # rows without any id share the NULL component: there the fingerprint tells groups apart
    group = F.when(F.col("component_id").isNull(), F.col("mark"))
    best = counted.where(F.col("id").eqNullSafe(F.col("component_id"))).groupBy("component_id", group.alias("lone"))
    keep = best.agg(F.min(F.struct("th", "id", "n")).alias("k")).select("k.*")
    keep = stash(keep, "kept")
    rows = carried(docs, id_col, text_col)
    kept = rows.join(keep, same_row(rows, keep), "left_semi")
    if not keep.where("n > 1").isEmpty():
        kept = kept.dropDuplicates(["id", "th"])
    return kept.select(*unpacked(docs.columns))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digits = F.lower(F.lpad(F.hex("mark"), 16, "0"))
    return found.select(F.col("id").alias("doc_id"), digits.alias("fingerprint"), "component_id")
