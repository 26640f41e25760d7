"""Documents whose sets of three-word shingles have a Jaccard similarity of 0.9 or more, found exactly.

Sets are sorted arrays of shingle hashes; equal sets are one node. Sizes fall into
bands. Two sets that are alike, the smaller one in a band, differ in at most a known
number of shingles; cut the range of hashes into one part more, and in some part both
hold the same shingles. So a set belongs to the tiles (band, part, content of the part)
of its own band and, near the lower edge, of the band below. A part holds some eight
shingles from all over the text, which a shared passage or template does not repeat.

Within tiles, hashed bitmaps (each shingle flips one bit) come first: the bits in
which two bitmaps differ are at most the shingles in which the sets do, which bounds
the overlap from above. What passes is compared exactly, by intersecting the sorted
arrays. A tile's members are compared with a few pivots first; only tiles that still
hold several components are then compared in full, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.components import components
from plumbline.llm.hashing import U, mix, words_of_rows
from plumbline.llm.tables import keyed, record_batch, stash, text_bytes, trimmed

WIDTH = 3
# Least similarity, as a fraction of whole numbers: no rounding decides.
UP, DOWN = 9, 10
# A smaller set is alike only to an equal one: one shingle more is below the least similarity.
LEAST_SIZE = UP
# Bits of a bitmap per shingle, and the fewest.
SPREAD, LEAST_BITS = 2, 256
# Members that each tile is compared with, and members or bytes of bitmaps in a block.
PIVOTS = 3
BLOCK, BLOCK_BYTES = 512, 1 << 20
# Bits that tell which rows a set is to be made of; others that share a bit are joined away.
ROW_BITS = 1 << 24
SLICE = 1 << 14

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = [U(pow(0xD1342543DE82EF95, k + 1, 1 << 64)) for k in range(WIDTH + 2)]


def _edges() -> np.ndarray:
    """Least sizes of the bands, each a quarter larger than the one before."""
    edges = [LEAST_SIZE]
    while edges[-1] < 1 << 40:
        edges.append(max(edges[-1] + 2, edges[-1] * 5 // 4))
    return np.array(edges, np.int64)


EDGES = _edges()


def alike_sizes(a: int, b: int) -> bool:
    return DOWN * min(a, b) >= UP * max(a, b)


def most_apart(a, b):
    """Shingles in which sets of these sizes may differ and still be alike."""
    return (a + b) * (DOWN - UP) // (DOWN + UP)


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets have the least similarity, by exact intersection."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DOWN * both >= UP * (len(a) + len(b) - both)


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
        last = len(words) - width + 1
        total = np.full(last, width, U)
        for k in range(width):
            total = mix(total ^ (words[k : last + k] * _ODD[k]))
        yield np.unique(total)


def set_mark(shingles: np.ndarray) -> int:
    """One hash for the whole set; 0 for the empty one."""
    if not len(shingles):
        return 0
    sums = np.array([shingles.sum(dtype=U), mix(shingles ^ _ODD[3]).sum(dtype=U)], U)
    return int((mix(sums[:1] + U(len(shingles))) ^ mix(sums[1:] * _ODD[4])).view(np.int64)[0]) or 1


def tile_keys(shingles: np.ndarray) -> np.ndarray:
    """Keys of the tiles that a set belongs to."""
    size = len(shingles)
    if size < LEAST_SIZE:
        return np.zeros(0, np.int64)
    band = int(np.searchsorted(EDGES, size, "right")) - 1
    bands = [band]
    # the larger partner of a set of the band below
    if band and alike_sizes(int(EDGES[band]) - 1, size):
        bands.append(band - 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(shingles * _ODD[0]))])
    out = []
    for b in bands:
        # sets alike, the smaller of size a, differ in at most a / UP shingles
        parts = (int(EDGES[b + 1]) - 1) // UP + 1
        cuts = ((np.arange(1, parts, dtype=U) << U(32)) + U(parts - 1)) // U(parts)
        at = np.concatenate([[0], np.searchsorted(shingles >> U(32), cuts), [size]])
        content = sums[at[1:]] - sums[at[:-1]]
        where = mix(np.arange(parts, dtype=U) + U(b << 32) + U(1))
        out.append(mix(mix(content + U(1)) ^ where))
    return np.concatenate(out).view(np.int64)


def bitmap(shingles: np.ndarray) -> bytes:
    """Each shingle flips one bit; the number of bits is a power of two that follows the size."""
    bits = LEAST_BITS
    while bits < SPREAD * len(shingles):
        bits *= 2
    flips = np.bincount((shingles & U(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def fold(maps: np.ndarray, words: int) -> np.ndarray:
    """Bitmaps (rows of 64-bit words) as they would be with fewer bits."""
    return np.bitwise_xor.reduce(maps.reshape(len(maps), -1, words), axis=1)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks, sizes, maps, keys = [], [], [], []
        for shingles in shingle_sets(*text_bytes(batch.column("text"))):
            marks.append(set_mark(shingles))
            sizes.append(len(shingles))
            keys.append(tile_keys(shingles))
            maps.append(bitmap(shingles) if len(keys[-1]) else None)
        at = np.concatenate([[0], np.cumsum([len(k) for k in keys])])
        lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
        columns = [pa.array(marks, pa.int64()), pa.array(sizes, pa.int64()), pa.array(maps, pa.binary()), lists]
        yield pa.RecordBatch.from_arrays(
            [batch.column("id"), batch.column("at"), *columns], ["id", "at", "mark", "size", "bitmap", "keys"]
        )


# ------------------------------------------------------------- pairs of sets


def passing(limit=most_apart):
    """Keep the pairs (a, b) that the bitmaps do not rule out; ``limit`` bounds the differences by the sizes."""

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [batch.column(c).to_pylist() for c in ("map_a", "map_b")]
            lengths = np.array([[len(m) for m in side] for side in maps], np.int64).reshape(2, -1)
            sizes = [batch.column(c).to_numpy() for c in ("size_a", "size_b")]
            keep = np.zeros(batch.num_rows, bool)
            for la, lb in {tuple(x) for x in lengths.T.tolist()}:
                rows = np.flatnonzero((lengths[0] == la) & (lengths[1] == lb))
                x, y = (
                    fold(np.frombuffer(b"".join(side[i] for i in rows), U).reshape(len(rows), -1), min(la, lb) // 8)
                    for side in maps
                )
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                keep[rows] = apart <= limit(sizes[0][rows], sizes[1][rows])
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    return work


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = (batch.column(c) for c in ("x", "y"))
        keep = [alike(*(np.frombuffer(s[i].as_py(), U) for s in (left, right))) for i in range(batch.num_rows)]
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def with_sides(pairs: DataFrame, table: DataFrame, names: dict[str, tuple[str, str]]) -> DataFrame:
    """Pairs (a, b) with columns of ``table`` (mark, ...) for either side."""
    for side, i in (("a", 0), ("b", 1)):
        shown = [F.col(c).alias(both[i]) for c, both in names.items()]
        pairs = pairs.join(table.select(F.col("mark").alias(side), *shown), side)
    return pairs


class Sets:
    """The sets of a table: (id, at, mark, size, bitmap, keys) per row, and each row's text."""

    def __init__(self, rows: DataFrame, texts: DataFrame):
        self.rows, self.texts = rows, texts
        # a row that stands for its mark: the least of the row hashes
        firsts = rows.where(F.size("keys") > 0).groupBy("mark").agg(F.min("at").alias("at"))
        self.firsts = stash(firsts, "firsts")

    def bitmaps(self, marks: DataFrame) -> DataFrame:
        """(mark, size, bitmap) of the given marks, each once."""
        chosen = self.firsts.join(marks, "mark", "left_semi")
        found = self.rows.select("at", "mark", "size", "bitmap").join(chosen, ["at", "mark"], "left_semi")
        return stash(found.dropDuplicates(["mark"]).drop("at"), "bitmaps")

    def shingles(self, marks: DataFrame) -> DataFrame:
        """(mark, shingles) of the given marks, made anew from one text each."""
        chosen = stash(self.firsts.join(marks, "mark", "left_semi"), "chosen")
        sent = self.texts.sparkSession.sparkContext.broadcast(_row_bits(chosen))
        made = self.texts.mapInArrow(_shingles_of(sent), "at long, mark long, shingles binary")
        return stash(made.join(chosen, ["at", "mark"], "left_semi").dropDuplicates(["mark"]).drop("at"), "sets")

    def alike(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) of marks whose sets are alike: bitmaps first, then the sorted arrays."""
        maps = self.bitmaps(_ends(pairs))
        wide = with_sides(pairs, maps, {"size": ("size_a", "size_b"), "bitmap": ("map_a", "map_b")})
        near = stash(wide.mapInArrow(passing(), "a long, b long"), "passing")
        sets = self.shingles(_ends(near))
        return stash(with_sides(near, sets, {"shingles": ("x", "y")}).mapInArrow(_exact, "a long, b long"), "alike")


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("a").alias("mark")).unionByName(pairs.select(F.col("b").alias("mark"))).distinct()


def _bits_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of the bit table that a batch touches."""
    for batch in batches:
        at = np.unique(batch.column("at").to_numpy(zero_copy_only=False) & (ROW_BITS - 1))
        owner = at // (SLICE * 8)
        made = []
        for s in np.unique(owner):
            bits = np.zeros(SLICE * 8, np.uint8)
            bits[at[owner == s] - s * SLICE * 8] = 1
            made.append((int(s), np.packbits(bits).tobytes()))
        if made:
            numbers, parts = zip(*made)
            yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(parts, pa.binary())], ["slice", "part"])


def _either(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One slice of several: a running union, whatever order they come in."""
    held: dict[int, np.ndarray] = {}
    for batch in parts:
        for s, part in zip(batch.column("slice").to_pylist(), batch.column("part").to_pylist()):
            bits = np.frombuffer(part, np.uint8)
            held[s] = held[s] | bits if s in held else bits
    if held:
        columns = [pa.array(list(held), pa.int64()), pa.array([b.tobytes() for b in held.values()], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, ["slice", "part"])


def _row_bits(chosen: DataFrame) -> np.ndarray:
    """A bit per row hash, 2 MB whatever the input: most other rows are passed over where they lie."""
    kind = "slice long, part binary"
    parts = chosen.select("at").mapInArrow(_bits_of, kind).mapInArrow(_either, kind)
    merged = parts.repartition("slice").mapInArrow(_either, kind)
    bits = np.zeros(ROW_BITS // 8, np.uint8)
    for r in merged.collect():
        bits[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["part"], np.uint8)
    return bits


def _shingles_of(sent):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column("at").to_numpy(zero_copy_only=False) & (ROW_BITS - 1)
            some = batch.filter(pa.array((sent.value[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 > 0))
            if some.num_rows:
                made = list(shingle_sets(*text_bytes(some.column("text"))))
                marks = pa.array([set_mark(s) for s in made], pa.int64())
                sets = pa.array([s.tobytes() for s in made], pa.binary())
                yield pa.RecordBatch.from_arrays([some.column("at"), marks, sets], ["at", "mark", "shingles"])

    return work


# -------------------------------------------------------------------- tiles


def tiles(rows: DataFrame) -> DataFrame:
    """(key, mark, size) of all tiles that hold several sets."""
    members = rows.select(F.explode("keys").alias("key"), "mark", "size")
    several = members.groupBy("key").agg(F.min("mark").alias("low"), F.max("mark").alias("high")).where("low < high")
    return stash(members.join(several.select("key"), "key", "left_semi").distinct(), "members")


def _pairs_with(members: DataFrame, pivots: DataFrame) -> DataFrame:
    """Pairs (a < b) of members with their tile's pivot (key, pivot, its size), sizes allowing."""
    joined = members.join(pivots, "key").where("mark <> pivot").where(_sizes_allow("size", "pivot_size"))
    return joined.select(F.least("mark", "pivot").alias("a"), F.greatest("mark", "pivot").alias("b")).distinct()


def _sizes_allow(a: str, b: str) -> Column:
    return F.lit(DOWN) * F.least(a, b) >= F.lit(UP) * F.greatest(a, b)


def _with_roots(members: DataFrame, links: DataFrame) -> DataFrame:
    roots = stash(components(links), "joined").select(F.col("node").alias("mark"), "root")
    joined = members.drop("root").join(roots, "mark", "left")
    return joined.withColumn("root", F.coalesce("root", "mark"))


def _open(members: DataFrame) -> DataFrame:
    """Members of the tiles in which several components meet."""
    apart = members.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most")
    return stash(members.join(apart.select("key"), "key", "left_semi"), "open")


def links_between(sets: Sets) -> DataFrame:
    """(a, b) between distinct marks whose sets are alike, enough to connect all that are.

    Pivots turn a tile of mutual copies into one component without comparing all
    of them. A tile of up to three is done after its least and greatest members,
    the first two pivots; the others go on until one component is left, or to a
    comparison in full of members in different components.
    """
    members = tiles(sets.rows)
    spark = members.sparkSession
    links = tested = spark.createDataFrame([], "a long, b long")
    for turn in range(PIVOTS):
        if turn == 0:
            ends = [(F.min_by, "mark"), (F.max_by, "mark")]
        else:
            ends = [(F.min_by, F.xxhash64("mark", F.lit(turn)))]
        pivots = [
            members.groupBy("key").agg(pick(F.struct("mark", "size"), by).alias("p")).select(
                "key", F.col("p.mark").alias("pivot"), F.col("p.size").alias("pivot_size")
            )
            for pick, by in ends
        ]
        pairs = [_pairs_with(members, p) for p in pivots]
        pairs = pairs[0] if len(pairs) == 1 else pairs[0].unionByName(pairs[1]).distinct()
        pairs = stash(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        links = stash(links.unionByName(sets.alike(pairs)), "links")
        tested = tested.unionByName(pairs)
        if turn == 0:
            # least, greatest and one more: all pairs of a tile of three have been compared
            large = members.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 3").select("key")
            members = stash(members.join(large, "key", "left_semi"), "large")
        members = _open(_with_roots(members, links))
        if members.isEmpty():
            return links
    rest = _block_pairs(members, sets).distinct().join(tested, ["a", "b"], "left_anti")
    return stash(links.unionByName(sets.alike(stash(rest, "pairs"))), "links")


# ------------------------------------------------------- blocks of open tiles

_BLOCK = T.StructType().add("key", "long").add("block", "string").add("low", "long").add("high", "long")
_BLOCK = _BLOCK.add("least", "long").add("most", "long").add("words", "integer").add("members", "binary").add("maps", "binary")


def _block_pairs(members: DataFrame, sets: Sets) -> DataFrame:
    """Pairs (a < b) within tiles, of different components, that sizes and bitmaps allow.

    Members are sorted by component within their tile, so blocks of one component
    are not compared with each other, and a tile of any size spreads over tasks.
    """
    maps = sets.bitmaps(members.select("mark").distinct())
    wide = members.select("key", "mark", "root").join(maps, "mark")
    order = ["key", "root", "size", "mark"]
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = wide.repartitionByRange(n, *order).sortWithinPartitions(*order)
    blocks = stash(cut.mapInArrow(_blocks, _BLOCK), "blocks")
    ranges = blocks.drop("words", "members", "maps")
    other = ranges.select("key", *[F.col(c).alias(f"other_{c}") for c in ranges.columns if c != "key"])
    pairs = ranges.join(other, "key").where("block <= other_block")
    pairs = pairs.where("NOT (least = most AND other_least = other_most AND least = other_least)")
    # the least size of one may be alike to the greatest of the other
    pairs = pairs.where(F.lit(DOWN) * F.col("high") >= F.lit(UP) * F.col("other_low"))
    pairs = pairs.where(F.lit(DOWN) * F.col("other_high") >= F.lit(UP) * F.col("low"))
    content = ["words", "members", "maps"]
    second = blocks.select("key", F.col("block").alias("other_block"), *[F.col(c).alias(f"other_{c}") for c in content])
    work = pairs.select("key", "block", "other_block").join(blocks.select("key", "block", *content), ["key", "block"])
    work = work.join(second, ["key", "other_block"]).drop("key")
    return work.mapInArrow(_compare, "a long, b long")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = to_arrow_schema(_BLOCK)
    held: list[tuple] = []
    room = 0

    def block() -> pa.RecordBatch:
        key = held[0][0]
        roots, sizes, marks = (np.array([h[i] for h in held], np.int64) for i in (1, 2, 3))
        words = min(len(h[4]) for h in held) // 8
        maps = np.concatenate([fold(np.frombuffer(h[4], U)[None, :], words) for h in held])
        name = f"{roots[0]}:{sizes[0]}:{marks[0]}"  # a member is in one block of a tile
        values = [key, name, int(sizes.min()), int(sizes.max()), int(roots.min()), int(roots.max()), words,
                  np.stack([marks, sizes, roots]).tobytes(), maps.tobytes()]
        return record_batch(arrow, [[v] for v in values])

    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in ("key", "root", "size", "mark", "bitmap")]):
            if held and (row[0] != held[0][0] or len(held) >= BLOCK or room + len(row[4]) > BLOCK_BYTES):
                yield block()
                held, room = [], 0
            held.append(row)
            room += len(row[4])
    if held:
        yield block()


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            (a, size_a, root_a), (b, size_b, root_b) = (
                np.frombuffer(r[f"{p}members"], np.int64).reshape(3, -1) for p in ("", "other_")
            )
            words = min(r["words"], r["other_words"])
            x, y = (fold(np.frombuffer(r[f"{p}maps"], U).reshape(n, -1), words) for p, n in (("", len(a)), ("other_", len(b))))
            found = []
            for i in range(len(a)):
                near = (root_b != root_a[i]) & (DOWN * np.minimum(size_b, size_a[i]) >= UP * np.maximum(size_b, size_a[i]))
                near = np.flatnonzero(near)
                apart = np.bitwise_count(y[near] ^ x[i]).sum(axis=1, dtype=np.int64)
                passing = near[apart <= most_apart(size_a[i], size_b[near])]
                found.append(np.stack([np.full(len(passing), a[i]), b[passing]]))
            pairs = np.sort(np.concatenate(found, axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], ["a", "b"])


# ------------------------------------------------------------------- documents


def join_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_shingles, mark, component_id) of every row; ``mark`` is the hash of its set as a signed long.

    A-Z count as a-z, words end at ASCII white space, and a text of one or two
    words is one shingle. Rows are linked if their sets have a Jaccard similarity
    of at least UP / DOWN; the component's id is the least id reachable over
    links, NULL only if all ids are. Texts without words, NULL ones too, have an
    empty set that is linked with nothing: their component is their own id. Equal
    sets are one node, however many rows have them; other columns are not read;
    an empty table gives no rows.
    """
    texts = keyed(docs, id_col, text_col).select("id", F.xxhash64("id", "th").alias("at"), "text")
    schema = T.StructType([texts.schema["id"], T.StructField("at", T.LongType()), T.StructField("mark", T.LongType())])
    schema = schema.add("size", "long").add("bitmap", "binary").add("keys", T.ArrayType(T.LongType()))
    rows = stash(texts.mapInArrow(_rows, schema), "sets")
    links = links_between(Sets(rows, texts.select("at", "text")))
    full = rows.where("size > 0").select("id", "size", "mark")
    roots = components(links).select(F.col("node").alias("mark"), "root")
    marks = full.groupBy("mark").agg(F.min("id").alias("least")).join(roots, "mark", "left")
    marks = stash(marks.select("mark", "least", F.coalesce("root", "mark").alias("root")), "roots")
    ids = marks.groupBy("root").agg(F.min("least").alias("component_id"))
    named = marks.join(ids, "root").select("mark", "component_id")
    alone = rows.where("size = 0").select("id", "size", "mark", F.col("id").alias("component_id"))
    found = full.join(named, "mark").select("id", "size", "mark", "component_id").unionByName(alone)
    return found.withColumnRenamed("size", "n_shingles")


def op11_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = join_sets(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id")
