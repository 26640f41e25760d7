"""Find benchmark passages in documents by latent semantic retrieval.

Benchmark items and documents are cut into passages of words; TF-IDF over the
benchmark's words, with document counts from the whole table, is projected on the
leading singular directions of passages of documents and benchmark together, found by
a distributed randomised SVD. The directions are fitted on every passage of every document
and are far fewer than the passages; every document is searched. Document
passages are candidates if their projection is near that of an item's passage, by the
cosine and by how much of the latter it holds. Verbatim copies are looked up by their first
words and do not depend on the directions. Candidates are checked by the longest common
subsequence of words, and a paraphrase, whose subsequence is shorter, counts only if
the item's answer, its last words, stands nearby too. Texts stay where they are; only
numbers move.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.hashing import words_of_rows
from plumbline.llm.line_runs import LOWER, UPPER
from plumbline.llm.tables import discard, keyed, record_batch, segments, small_batches, stash, text_bytes, trimmed, whole_text

# Words of a passage, and from one document passage to the next (benchmark passages do not overlap).
PASSAGE, STRIDE = 24, 12
# Items with fewer words than this are too short to be found.
LEAST_WORDS = 5
# Directions of the space.
DIRECTIONS = 128
POWER_ROUNDS = 2
# Products of terms that a task adds up at a time, terms held to be added up in several such bands, pairs made at once.
BAND_CELLS, HELD_TERMS, PAIRS = 1 << 24, 1 << 22, 1 << 18
# Least cosine of the projections of two passages (less where an item's fills only part of one), and
# least length of a document's along an item's, as a part of the latter's.
COSINE, HELD = 0.3, 0.2
# Share of an item's passage in the common subsequence: enough alone, and enough with the answer.
COPY, PARAPHRASE = 0.8, 0.6
ANSWER_WORDS = 6
# Benchmark passages, about, searched for in one scan.
BLOCK = 512
PIECE = 1 << 15
# Text taken at a time, whatever the size of a batch: arrays of its words are several times as large.
SLICE_BYTES = 1 << 20
# Document passages or candidates looked at together, and terms whose sums travel together.
TOGETHER, STRIP = 512, 256

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = 0x9E3779B97F4A7C15
_APART = np.ones(256, bool)
_APART[48:58] = _APART[97:123] = _APART[128:] = False


def plain_words(offsets: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of words, words before each row): runs of a-z, 0-9 and non-ASCII after lower-casing A-Z."""
    hashes, _, _, before = words_of_rows(offsets, _LOWER[data], blank=_APART)
    return hashes, before


def row_slices(offsets: np.ndarray, data: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, offsets, bytes) of consecutive rows of SLICE_BYTES together, or of one longer row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        low = int(offsets[row])
        end = max(row + 1, int(np.searchsorted(offsets, low + SLICE_BYTES, "right")) - 1)
        yield row, offsets[row : end + 1] - low, data[low : int(offsets[end])]
        row = end


def _grams(words: np.ndarray) -> np.ndarray:
    """A hash of the LEAST_WORDS words from each position on."""
    if len(words) < LEAST_WORDS:
        return words[:0]
    last = len(words) - LEAST_WORDS + 1
    return sum(words[k : last + k] * np.uint64(_ODD**(k + 1) % (1 << 64)) for k in range(LEAST_WORDS))


def common_length(masks: dict[int, int], size: int, words: list[int]) -> int:
    """Length of the longest common subsequence with a passage, whose positions per word are bits of ``masks``."""
    open_ = full = (1 << size) - 1
    for w in words:
        here = masks.get(w)
        if here:
            used = open_ & here
            open_ = ((open_ + used) | (open_ - used)) & full
    return size - open_.bit_count()


@dataclass
class Passage:
    item: int
    words: np.ndarray
    answer: np.ndarray

    def __post_init__(self):
        self.masks = _masks(self.words)
        self.answer_masks = _masks(self.answer)


def _masks(words: np.ndarray) -> dict[int, int]:
    masks: dict[int, int] = {}
    for i, w in enumerate(words.tolist()):
        masks[w] = masks.get(w, 0) | 1 << i
    return masks


def cut_items(items: list[tuple[object, str]]) -> list[Passage]:
    """Passages of all items, in order; the last of an item reaches back to be whole."""
    out = []
    for i, (_, text) in enumerate(items):
        data = np.frombuffer(text.encode(), np.uint8)
        words = plain_words(np.array([0, len(data)]), data)[0]
        if len(words) < LEAST_WORDS:
            continue
        last = max(0, len(words) - PASSAGE)
        for at in sorted({*range(0, last, PASSAGE), last}):
            out.append(Passage(i, words[at : at + PASSAGE], words[-ANSWER_WORDS:]))
    return out


class Space:
    """TF-IDF over the benchmark's words, and the latent directions once they are known."""

    def __init__(self, passages: list[Passage]):
        self.terms = np.unique(np.concatenate([p.words for p in passages]))
        self.passages = passages
        self.seen = np.zeros(1 << 20, bool)  # leading bits of the terms, to pass over most other words
        self.seen[(self.terms >> np.uint64(44)).astype(np.int64)] = True
        self.weight = np.ones(len(self.terms))
        self.latent = np.zeros((len(self.terms) + 1, 0), np.float32)
        self.sought = np.zeros((len(passages), 0), np.float32)
        self.lengths = np.zeros(len(passages), np.float32)
        self.holds = np.zeros((len(passages), len(self.terms) + 1), bool)
        # numbers of each passage's words; short passages are filled up with the number of no term
        self.members = np.full((len(passages), PASSAGE), len(self.terms))
        for i, p in enumerate(passages):
            self.members[i, : len(p.words)] = np.searchsorted(self.terms, p.words)
            self.holds[i, self.members[i, : len(p.words)]] = True
        self.sizes = np.array([len(p.words) for p in passages])
        self.cosines = (COSINE * self.sizes / PASSAGE).astype(np.float32)
        heads = np.concatenate([_grams(p.words[:LEAST_WORDS]) for p in passages])
        self.by_head = np.argsort(heads, kind="stable")
        self.heads = heads[self.by_head]

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Number of each word among the terms; len(terms) for words that are none."""
        out = np.full(len(words), len(self.terms))
        some = np.flatnonzero(self.seen[(words >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.terms, words[some]), len(self.terms) - 1)
        same = self.terms[at] == words[some]
        out[some[same]] = at[same]
        return out

    def weigh(self, counts: np.ndarray, documents: int) -> None:
        """Inverse document frequencies."""
        self.weight = np.log((1 + documents) / (1 + counts)) + 0.1

    def set_directions(self, directions: np.ndarray) -> None:
        """Keep each word's projection, and the unit vector and length of each benchmark passage's.

        The projection of a document's passage is the sum over its words.
        """
        self.latent = np.zeros((len(self.terms) + 1, directions.shape[1]), np.float32)  # other words: zero
        self.latent[:-1] = directions * self.weight[:, None]
        sought = np.stack([self.latent[m].sum(axis=0) for m in self.members])
        self.lengths = np.linalg.norm(sought, axis=1)
        self.sought = sought / np.maximum(self.lengths, np.finfo(np.float32).tiny)[:, None]

    def matches(self, offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        """(row, item, cosine, share of the passage, answer found) of verified matches, the best of each row and item."""
        out = []
        for row, ends, part in row_slices(offsets, data):
            out += [(row + m[0], *m[1:]) for m in self._matches(ends, part)]
        return out

    def _matches(self, offsets: np.ndarray, data: np.ndarray) -> list[tuple[int, int, float, float, bool]]:
        words, before = plain_words(offsets, data)
        numbers = self.numbers(words)
        best: dict[tuple[int, int], tuple[float, float, bool]] = {}
        for row, end, low, high in segments(before, PIECE, PASSAGE - 1):
            bounds = np.clip(before[row : end + 1] - low, 0, high - low)
            found = [np.array(list(self._copies(words[low:high], bounds)), np.float64).reshape(-1, 3).T]
            found += self._candidates(numbers[low:high], bounds)
            at, p, cos = np.concatenate(found, axis=1)
            at, p = at.astype(np.int64) + low, p.astype(np.int64)
            mine = np.searchsorted(before, at, "right") - 1
            some = self._overlapping(numbers, before[mine], before[mine + 1], at, p)
            for i in some.tolist():
                passage = self.passages[p[i]]
                checked = self._verify(words, int(before[mine[i]]), int(before[mine[i] + 1]), int(at[i]), passage)
                if checked:
                    key = int(mine[i]), passage.item
                    match = (checked[0], float(cos[i]), checked[1])
                    if key not in best or match > best[key]:
                        best[key] = match
        return [(row, item, cos, share, answer) for (row, item), (share, cos, answer) in sorted(best.items())]

    def _copies(self, words: np.ndarray, bounds: np.ndarray) -> Iterator[tuple[int, int, float]]:
        """(first word, passage, cosine) of benchmark passages that stand there word for word."""
        grams = _grams(words)
        low, high = (np.searchsorted(self.heads, grams, side) for side in ("left", "right"))
        for at in np.flatnonzero(low < high).tolist():
            end = bounds[np.searchsorted(bounds, at, "right")]
            for p in self.by_head[low[at] : high[at]].tolist():
                sought = self.passages[p].words
                if at + len(sought) <= end and np.array_equal(words[at : at + len(sought)], sought):
                    yield at, p, float(self.lengths[p] > 0)

    def _candidates(self, numbers: np.ndarray, bounds: np.ndarray) -> Iterator[np.ndarray]:
        """Rows of first words, passages and cosines of document passages near a benchmark passage."""
        blocks = -(-np.diff(bounds) // STRIDE)
        if not blocks.sum():
            return
        ahead = np.concatenate([[0], np.cumsum(blocks)])
        block = np.arange(ahead[-1])
        row = np.searchsorted(ahead, block, "right") - 1
        start = bounds[row] + (block - ahead[row]) * STRIDE
        # a passage is a block and the next one of its document; a last block belongs to the one before
        more = block + 1 < ahead[row + 1]
        alone = ~more & (block == ahead[row])
        # the words of each block side by side; the number of no term, whose projection is zero, fills short ones
        place = start[:, None] + np.arange(STRIDE)
        ends = np.append(start[1:], len(numbers))[:, None]
        words = np.where(place < ends, numbers[np.minimum(place, len(numbers) - 1)], len(self.terms))
        sums = self.latent[words[:, 0]]
        for k in range(1, STRIDE):
            sums += self.latent[words[:, k]]
        near = sums.copy()
        near[more] += sums[np.flatnonzero(more) + 1]
        length = np.linalg.norm(near, axis=1)
        some = self.lengths > 0
        least = np.where(some, HELD * self.lengths, np.inf).astype(np.float32)
        # no product exceeds the length of the projection
        hopeful = np.flatnonzero((more | alone) & (length >= least.min()))
        for i in range(0, len(hopeful), TOGETHER):
            first = hopeful[i : i + TOGETHER]
            products = near[first] @ self.sought.T
            at, p = np.nonzero((products >= length[first, None] * self.cosines) & (products >= least))
            if len(at):
                yield np.stack([start[first[at]], p, products[at, p] / length[first[at]]]).astype(np.float64)

    def _overlapping(self, numbers, low, high, at, p) -> np.ndarray:
        """Candidates that have enough words of the passage nearby for a paraphrase, in whatever order."""
        keep = np.zeros(len(at), bool)
        offsets = np.arange(-STRIDE, PASSAGE + STRIDE)
        for i in range(0, len(at), TOGETHER):
            some = slice(i, i + TOGETHER)
            where = at[some, None] + offsets
            inside = (where >= low[some, None]) & (where < high[some, None])
            here = np.where(inside, numbers[np.where(inside, where, at[some, None])], len(self.terms))
            held = self.holds[p[some, None], here].sum(axis=1) / self.sizes[p[some]] >= PARAPHRASE
            here, left = here[held], np.flatnonzero(held) + i
            # and enough words of the passage are there at all
            seen = np.zeros((len(here), len(self.terms) + 1), bool)
            seen[np.arange(len(here))[:, None], here] = True
            seen[:, -1] = False
            there = seen[np.arange(len(here))[:, None], self.members[p[left]]].sum(axis=1)
            keep[left] = there / self.sizes[p[left]] >= PARAPHRASE
        return np.flatnonzero(keep)

    def _verify(self, words, low: int, high: int, at: int, passage: Passage) -> tuple[float, bool] | None:
        size = len(passage.words)
        near = words[max(low, at - STRIDE) : min(high, at + PASSAGE + STRIDE)].tolist()
        share = common_length(passage.masks, size, near) / size
        if share < PARAPHRASE:
            return None
        around = words[max(low, at - 4 * PASSAGE) : min(high, at + 5 * PASSAGE)].tolist()
        tail = len(passage.answer)
        answer = common_length(passage.answer_masks, tail, around) >= 0.8 * tail
        return (share, answer) if share >= COPY or answer else None


def _document_counts(space) -> callable:
    """Passages of each slice of texts as numbers of the benchmark's words; last, in how many rows each word is.

    ``terms`` has the passages with any such word, each followed by -1, and ``n`` is how many
    they are. Other rows have a word's number, or -1 for all rows, in ``term``.
    """

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = space.value
        size, rows = len(known.terms), 0
        counts = np.zeros(size + 1, np.int64)
        for batch in batches:
            for _, offsets, data in row_slices(*text_bytes(batch.column("text"))):
                words, before = plain_words(offsets, data)
                numbers = known.numbers(words)
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
                held = np.flatnonzero(numbers < size)
                numbers, row = numbers[held], row[held]
                pairs = np.unique(row * (size + 1) + numbers)
                counts += np.bincount(pairs % (size + 1), minlength=size + 1)
                ahead = np.cumsum([0, *-(-np.diff(before) // PASSAGE)])
                passage = ahead[row] + (held - before[row]) // PASSAGE
                ends = np.flatnonzero(np.diff(passage, append=-1)) + 1 if len(passage) else passage
                terms = np.insert(numbers, ends, -1).astype(np.int32).tobytes()
                yield _counted([None], [len(ends)], [terms])
            rows += batch.num_rows
        term = np.append(np.flatnonzero(counts), -1)  # -1: the number of rows
        yield _counted(term, np.append(counts[term[:-1]], rows), [None] * len(term))

    return work


def _counted(term, n, terms) -> pa.RecordBatch:
    columns = [pa.array(term, pa.int64()), pa.array(n, pa.int64()), pa.array(terms, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["term", "n", "terms"])


def _shares(batch: pa.RecordBatch, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(terms, their shares, first term of each passage, terms of each): rows of A, as they stand."""
    offsets, data = text_bytes(batch.column("terms"))
    terms = np.frombuffer(data[offsets[0] : offsets[-1]].tobytes(), np.int32)
    first = (offsets[:-1] - offsets[0]) // 4
    # a passage ends with -1, and with its row
    cut = np.zeros(len(terms) + 1, np.int64)
    cut[first] += 1
    cut[:-1] += terms < 0
    some = np.flatnonzero(terms >= 0)
    passage, terms = np.cumsum(cut)[some], terms[some].astype(np.int64)
    starts = np.flatnonzero(np.diff(passage, prepend=-1))
    sizes = np.diff(np.append(starts, len(terms)))
    share = weight[terms]
    if len(terms):
        share = share / np.repeat(np.sqrt(np.add.reduceat(share * share, starts)), sizes)
    if "times" in batch.schema.names:
        row = np.searchsorted(first, some[starts], "right") - 1
        share = share * np.repeat(np.sqrt(batch.column("times").to_numpy())[row], sizes)
    return terms, share, starts, sizes


def _add_pairs(squares: np.ndarray, low: int, terms, share, starts, sizes) -> None:
    """Add the products of each term with those after it in its passage to the rows of A'A from ``low`` on."""
    height, size = squares.shape
    flat, share = squares.reshape(-1), share.astype(np.float32)
    for long in np.unique(sizes[sizes > 1]).tolist():
        first = starts[sizes == long]
        i, j = np.triu_indices(long, 1)
        step = max(1, PAIRS // len(i))
        for at in range(0, len(first), step):
            held = first[at : at + step, None] + np.arange(long)
            t, s = terms[held], share[held]
            left = np.take(t, i, axis=1) - low
            code = (left * size + np.take(t, j, axis=1)).ravel()
            product = (np.take(s, i, axis=1) * np.take(s, j, axis=1)).ravel()
            if height < size:
                mine = ((left >= 0) & (left < height)).ravel()
                code, product = code[mine], product[mine]
            np.add.at(flat, code, product)


def _normal_product(sent, weights) -> callable:
    """One partial product per task: A'(A Z) in strips of terms, where A is the task's TF-IDF passages.

    A row has the terms of a passage, or of several, each followed by -1. Passages are short,
    so what stands above the diagonal of A'A is added up pair by pair of their terms, in a
    band of bounded size, and multiplies Z once for many passages.
    """

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, weight = sent.value, weights.value
        size = len(z)
        height = max(1, min(size, BAND_CELLS // size))
        squares, narrow = np.zeros((height, size), np.float32), z.astype(np.float32)
        out, diagonal = np.zeros_like(z), np.zeros(size)

        def multiply(low: int) -> None:
            band = squares[: size - low]
            out[low : low + height] += band @ narrow
            out[:] += band.T @ narrow[low : low + height]
            squares.fill(0)

        def flush(held: list) -> None:
            for low in range(0, size, height):
                for rows in held:
                    _add_pairs(squares, low, *rows)
                multiply(low)

        held, many = [], 0
        for batch in batches:
            rows = _shares(batch, weight)
            diagonal += np.bincount(rows[0], rows[1] ** 2, minlength=size)
            if height == size:
                _add_pairs(squares, 0, *rows)
                continue
            held.append(rows)
            many += len(rows[0])
            if many >= HELD_TERMS:
                flush(held)
                held, many = [], 0
        if height == size:
            multiply(0)
        elif held:
            flush(held)
        out += diagonal[:, None] * z
        strips = [i for i in range(0, len(out), STRIP) if out[i : i + STRIP].any()]
        parts = [out[i : i + STRIP].astype(np.float32).tobytes() for i in strips]
        yield pa.RecordBatch.from_arrays([pa.array(strips, pa.int64()), pa.array(parts, pa.binary())], ["strip", "part"])

    return work


def _add_parts(table: pa.Table) -> pa.Table:
    """The sum of one strip, a part per task; in a set order, so that it can be repeated."""
    parts = sorted(table.column("part").to_pylist())
    total = sum(np.frombuffer(p, np.float32).astype(np.float64) for p in parts)
    return pa.table({"strip": table.column("strip")[:1], "part": pa.array([total.tobytes()], pa.binary())})


def latent_directions(passages: DataFrame, weight: np.ndarray, directions: int = DIRECTIONS) -> np.ndarray:
    """Leading right singular vectors of the TF-IDF passages (terms x directions).

    Randomised range finding with power rounds: every round is a Spark job that
    multiplies by A'A; the parts are added strip by strip, and what comes back is one
    (terms x directions) matrix. ``passages`` has (terms), numbers of one passage or of
    several, each followed by -1, and may have (times), how many times each of them counts.
    """
    spark = passages.sparkSession
    wide = min(directions + 8, len(weight))
    z = np.linalg.qr(np.random.default_rng(1).standard_normal((len(weight), wide)))[0]
    weights = spark.sparkContext.broadcast(weight)

    def product(z: np.ndarray) -> np.ndarray:
        sent = spark.sparkContext.broadcast(z)
        total = np.zeros_like(z)
        parts = passages.mapInArrow(_normal_product(sent, weights), "strip long, part binary")
        with small_batches(spark):
            added = parts.groupBy("strip").applyInArrow(_add_parts, "strip long, part binary").collect()
        for row in added:
            total[row["strip"] : row["strip"] + STRIP] = np.frombuffer(row["part"]).reshape(-1, wide)
        sent.unpersist()
        return total

    for _ in range(POWER_ROUNDS):
        z = np.linalg.qr(product(z))[0]
    values, vectors = np.linalg.eigh(z.T @ product(z))
    return (z @ vectors[:, ::-1])[:, : min(directions, wide)]


def fit_directions(read: DataFrame, space: Space, passages: int) -> np.ndarray:
    """The directions of documents' and benchmark passages; each kind counts for half.

    ``read`` has the terms of all ``passages`` of all documents that hold a word of the
    benchmark, those of copies as often as they stand there, like the document counts.
    """
    rows = read.where("terms IS NOT NULL").select("terms", F.lit(1.0 / max(1, passages)).alias("times"))
    own = np.concatenate([np.append(space.numbers(p.words), -1) for p in space.passages]).astype(np.int32).tobytes()
    own = read.sparkSession.createDataFrame([(own, 1.0 / len(space.passages))], "terms binary, times double")
    return latent_directions(rows.unionAll(own), space.weight)


def spaces(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text"
) -> Iterator[tuple[list, object]]:
    """(item ids, broadcast Space) for each block of the benchmark; a block has a bounded number of passages."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).alias("item"), whole_text(item_text).alias("text")).dropDuplicates()
    size = F.ceil(F.regexp_count(F.translate("text", UPPER, LOWER), F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")) / PASSAGE)
    blocks = max(1, -(-(items.agg(F.sum(size)).first()[0] or 0) // BLOCK))
    items = items.withColumn("block", F.pmod(F.xxhash64("item", "text"), F.lit(blocks)))
    texts = docs.select(whole_text(text_col).alias("text"))
    for block in range(blocks):
        mine = [(r["item"], r["text"]) for r in items.where(F.col("block") == block).collect()]
        mine.sort(key=lambda r: (r[0] is None, r[0], r[1]))
        own = cut_items(mine)
        if not own:
            continue
        space = Space(own)
        sent = spark.sparkContext.broadcast(space)
        read = stash(texts.mapInArrow(_document_counts(sent), "term long, n long, terms binary"), "passages")
        counts = np.zeros(len(space.terms))
        documents = passages = 0
        # a row per benchmark word of the block
        for r in read.groupBy("term").agg(F.sum("n").alias("n")).collect():
            if r["term"] is None:
                passages = r["n"]
            elif r["term"] < 0:
                documents = r["n"]
            else:
                counts[r["term"]] = r["n"]
        space.weigh(counts, documents)
        space.set_directions(fit_directions(read, space, passages))
        discard(read)
        yield [i for i, _ in mine], spark.sparkContext.broadcast(space)


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """(id, th, item, cosine, share, answer) of every document and benchmark item found in it.

    ``share`` is the part of an item's passage that the document has in order, at
    least PARAPHRASE, and at least COPY unless the ``answer`` was found. Words
    are compared without case and punctuation. NULL texts and items under
    LEAST_WORDS words match nothing; repeated rows each have their matches;
    either table may be empty.
    """
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    item_type = benchmark.schema[item_col].dataType
    schema = T.StructType().add("id", rows.schema["id"].dataType).add("th", "long").add("item", item_type)
    schema = schema.add("cosine", "double").add("share", "double").add("answer", "boolean")
    found = [rows.mapInArrow(_leak_rows(sent, ids, schema), schema) for ids, sent in
             spaces(docs, benchmark, text_col, item_col, item_text)]
    out = spark.createDataFrame([], schema)
    for part in found:
        out = out.unionAll(part)
    return out


def _leak_rows(sent, ids: list, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    @trimmed
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = sent.value.matches(*text_bytes(batch.column("text")))
            if found:
                row, item, cos, share, answer = zip(*found)
                took = pa.array(row, pa.int64())
                columns = [batch.column("id").take(took), batch.column("th").take(took), [ids[i] for i in item]]
                yield record_batch(arrow, [*columns, cos, share, answer])

    return work


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows in which no benchmark item is found, all columns as they are; decided row by row, without a shuffle."""
    for _, sent in spaces(docs, benchmark, text_col):
        docs = docs.where(~_leaks(sent)(whole_text(text_col)))
    return docs


def _leaks(sent):
    @F.arrow_udf("boolean")
    @trimmed
    def leaks(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            found = np.zeros(len(texts), bool)
            found[[m[0] for m in sent.value.matches(*text_bytes(texts))]] = True
            yield pa.array(found)

    return leaks


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.round("cosine", 4).alias("cosine"),
        "share", F.col("answer").alias("answer_found"),
    )
