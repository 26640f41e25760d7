"""Documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more, found exactly.

Sets that are so alike share one of the first shingles of each (a fifth of the set),
whatever order all sets are sorted in; here shingles that many documents have come
last. Documents with such a shingle in common are compared by their whole sets: first
with the least and the greatest of them, then with all that are not yet connected to
them. Equal sets are one node; shingles and sets are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from plumbline.llm.components import components
from plumbline.llm.hashing import U, mix, words_of_rows
from plumbline.llm.set_join import bitmap, passing, with_sides
from plumbline.llm.simhash import grouped
from plumbline.llm.tables import keyed, small_batches, stash, text_bytes, trimmed

WIDTH = 5
# Least similarity, as a fraction of whole numbers: no rounding decides.
UP, DOWN = 4, 5
# Cells in which shingles are counted for their order, and cells sent in a row.
CELLS, SLICE = 1 << 20, 1 << 14
# Bits by text hash that tell which texts sets are made of; others that share a bit are joined away.
BITS = 1 << 25
# Marks of equal sets that a task remembers.
REMEMBERED = 1 << 16

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [U(pow(0x9E3779B97F4A7C15, k + 1, 1 << 64)) for k in range(WIDTH)]


def shingle_sets(offsets: np.ndarray, data: np.ndarray) -> Iterator[np.ndarray]:
    """The sorted hashes of each row's shingles; a text of fewer words is one shingle, one without words none."""
    low, high = int(offsets[0]), int(offsets[-1])
    hashes, _, _, before = words_of_rows(offsets - low, _LOWER[data[low:high]])
    for i in range(len(offsets) - 1):
        words = hashes[before[i] : before[i + 1]]
        width = min(WIDTH, len(words))
        if not width:
            yield np.zeros(0, U)
            continue
        total = np.full(len(words) - width + 1, width, U)
        for k in range(width):
            total += mix(words[k : len(words) - width + 1 + k] ^ _ODD[k]) * _ODD[k]
        yield np.unique(mix(total))


def set_mark(shingles: np.ndarray) -> int:
    """One hash for the whole set; 0 for the empty one."""
    if not len(shingles):
        return 0
    both = np.array([shingles.sum(dtype=U), np.bitwise_xor.reduce(mix(shingles ^ _ODD[1]))], U)
    return int(mix(mix(both[:1] + U(len(shingles))) ^ both[1:]).view(np.int64)[0])


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


def most_apart(a, b):
    """Shingles in which sets of these sizes may differ and still be alike."""
    return (a + b) * (DOWN - UP) // (DOWN + UP)


def _cells(shingles: np.ndarray) -> np.ndarray:
    return (shingles >> U(44)).astype(np.int64)


@trimmed
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(CELLS, np.int64)
    for batch in batches:
        for shingles in shingle_sets(*text_bytes(batch.column("text"))):
            np.add.at(counts, _cells(shingles), 1)
    slices = counts.reshape(-1, SLICE)
    used = np.flatnonzero(slices.any(axis=1))
    parts = pa.array([slices[i].tobytes() for i in used], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), parts], ["slice", "part"])


def _add_up(group: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(p, np.int64) for p in group["part"])
    return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": [total.tobytes()]})


def frequency_classes(texts: DataFrame) -> np.ndarray:
    """For each cell the power of two that its count of shingles reaches: a bounded array, whatever the input."""
    counted = texts.mapInArrow(_count, "slice long, part binary").groupBy("slice")
    classes = np.zeros(CELLS, np.uint8)
    with small_batches(texts.sparkSession):
        added = counted.applyInPandas(_add_up, "slice long, part binary").collect()
    for r in added:
        counts = np.frombuffer(r["part"], np.int64)
        at = r["slice"] * SLICE
        classes[at : at + SLICE] = np.ceil(np.log2(1 + counts))
    return classes


def prefix(shingles: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The first shingles, rare ones ahead; two sets that are alike share one of them."""
    size = len(shingles)
    order = np.argsort(classes[_cells(shingles)], kind="stable")
    return shingles[order[: size - -(-UP * size // DOWN) + 1]]


@trimmed
def _marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, sizes, maps = [], [], []
        for shingles in shingle_sets(*text_bytes(batch.column("text"))):
            marks.append(set_mark(shingles))
            sizes.append(len(shingles))
            maps.append(bitmap(shingles))
        columns = [batch.column("id"), batch.column("th"), pa.array(marks, pa.int64()), pa.array(sizes, pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(maps, pa.binary())], ["id", "th", "mark", "size", "bitmap"])


def _prefixes(sent):
    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()  # equal sets that a task meets send one prefix, as long as their marks are remembered
        for batch in batches:
            made = [(np.zeros(0, np.int64),) * 4]
            for shingles in shingle_sets(*text_bytes(batch.column("text"))):
                mark = set_mark(shingles)
                if len(shingles) and mark not in seen:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen.add(mark)
                    first = prefix(shingles, sent.value).view(np.int64)
                    n = len(first)
                    made.append((first, np.full(n, mark), np.full(n, len(shingles)), np.arange(n)))
            columns = [pa.array(np.concatenate(c), k) for c, k in zip(zip(*made), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["shingle", "mark", "size", "place"])

    return work


@trimmed
def _bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    bits = np.zeros(BITS, bool)
    for batch in batches:
        bits[batch.column("th").to_numpy(zero_copy_only=False) & (BITS - 1)] = True
    slices = np.packbits(bits).reshape(-1, SLICE)
    used = np.flatnonzero(slices.any(axis=1))
    parts = pa.array([slices[i].tobytes() for i in used], pa.binary())
    yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), parts], ["slice", "part"])


def _either(group: pd.DataFrame) -> pd.DataFrame:
    both = np.bitwise_or.reduce([np.frombuffer(p, np.uint8) for p in group["part"]])
    return pd.DataFrame({"slice": group["slice"].iloc[:1], "part": [both.tobytes()]})


def text_bits(chosen: DataFrame) -> np.ndarray:
    """Packed bits by text hash: most texts that are not chosen are passed over where they lie, without a shuffle."""
    bits = np.zeros(BITS // 8, np.uint8)
    marked = chosen.select("th").mapInArrow(_bits, "slice long, part binary").groupBy("slice")
    for r in marked.applyInPandas(_either, "slice long, part binary").collect():
        bits[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["part"], np.uint8)
    return bits


def _sets(sent):
    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("th").to_numpy(zero_copy_only=False) & (BITS - 1)
            some = batch.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))
            made = pa.array([s.tobytes() for s in shingle_sets(*text_bytes(some.column("text")))], pa.binary())
            yield pa.RecordBatch.from_arrays([some.column("th"), made], ["th", "shingles"])

    return work


@trimmed
def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = ([np.frombuffer(s.as_py(), U) for s in batch.column(c)] for c in ("x", "y"))
        yield batch.select(["a", "b"]).filter(pa.array([alike(x, y) for x, y in zip(left, right)], pa.bool_()))


def _possible(a: str, b: str) -> Column:
    """Whether two sets can be alike, by their sizes and the places of a shingle that both have.

    A shared shingle at place i is the first that both have, or an earlier one
    stands in both too: a pair that is alike passes at the first.
    """
    x, y, i, j = F.col(f"{a}.size"), F.col(f"{b}.size"), F.col(f"{a}.place"), F.col(f"{b}.place")
    return (UP + DOWN) * (1 + F.least(x - i - 1, y - j - 1)) >= UP * (x + y)


def verified(pairs: DataFrame, rows: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) of marks whose sets are alike; sets are made only of texts that bitmaps leave in a pair."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("mark")).distinct()
    maps = rows.select("mark", "size", "bitmap").join(ends, "mark", "left_semi").dropDuplicates(["mark"])
    wide = with_sides(pairs, stash(maps, "bitmaps"), {"size": ("size_a", "size_b"), "bitmap": ("map_a", "map_b")})
    pairs = stash(wide.mapInArrow(passing(most_apart), "a long, b long"), "passing")
    nodes = pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()
    chosen = rows.groupBy("mark").agg(F.min("th").alias("th")).join(nodes, "mark", "left_semi")
    chosen = stash(chosen, "chosen")
    sent = texts.sparkSession.sparkContext.broadcast(text_bits(chosen))
    sets = texts.mapInArrow(_sets(sent), "th long, shingles binary").join(chosen, "th")
    sets = stash(sets.groupBy("mark").agg(F.first("shingles").alias("shingles")), "sets")
    work = pairs.join(sets.select(F.col("mark").alias("a"), F.col("shingles").alias("x")), "a")
    work = work.join(sets.select(F.col("mark").alias("b"), F.col("shingles").alias("y")), "b")
    return work.select("a", "b", "x", "y").mapInArrow(_verify, "a long, b long")


def similar_links(rows: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b) between distinct marks whose sets are alike, enough to connect all that are."""
    sent = texts.sparkSession.sparkContext.broadcast(frequency_classes(texts))
    first = texts.mapInArrow(_prefixes(sent), "shingle long, mark long, size int, place int")
    bucket, own = Window.partitionBy("shingle"), F.struct("mark", "size", "place")
    ends = first.select("*", F.min(own).over(bucket).alias("low"), F.max(own).over(bucket).alias("high"))
    shared = stash(ends.where("low.mark < high.mark").distinct(), "shared")
    # pairs that are not possible here are left to the second round: they may be in another bucket
    near = [
        shared.withColumn("own", own).where(_possible("own", end)).select(F.col("mark").alias("a"), F.col(f"{end}.mark").alias("b")).where("a <> b")
        for end in ("low", "high")
    ]
    near = near[0].unionByName(near[1]).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    links = stash(verified(stash(near.distinct(), "pairs"), rows, texts), "alike")

    roots = stash(components(links), "joined").select(F.col("node").alias("mark"), "root")
    open_ = shared.select("shingle", "mark", "size", "place").join(roots, "mark", "left")
    open_ = open_.withColumn("root", F.coalesce("root", "mark"))
    apart = open_.groupBy("shingle").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    open_ = stash(open_.join(apart, "shingle", "left_semi"), "open")
    a, b = open_.alias("a"), open_.alias("b")
    same = (F.col("a.shingle") == F.col("b.shingle")) & (F.col("a.mark") < F.col("b.mark"))
    pairs = a.join(b, same & (F.col("a.root") != F.col("b.root")) & _possible("a", "b"))
    pairs = pairs.select(F.col("a.mark").alias("a"), F.col("b.mark").alias("b")).distinct()
    return links.unionByName(verified(stash(pairs.join(near, ["a", "b"], "left_anti"), "pairs"), rows, texts))


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, th, mark, component_id) of every row; ``mark`` is the hash of the set of shingles as a signed long.

    Words are compared as in ``simhash``. Two rows are linked if their sets have a
    Jaccard similarity of at least UP / DOWN; the component's id is the least id
    reachable over links, NULL only if all ids are. Texts without words are alike.
    """
    texts = keyed(docs, id_col, text_col)
    schema = texts.select("id", "th", F.lit(0).cast("long").alias("mark")).schema
    schema = schema.add("size", "long").add("bitmap", "binary")
    rows = stash(texts.mapInArrow(_marks, schema), "set-marks")
    links = stash(similar_links(rows, texts.select("th", "text")), "alike")
    return grouped(rows.drop("size", "bitmap"), links)
