"""Runs of text that occur twice anywhere: what the two substring operators share.

A *window* is a fixed number of units (bytes or words). Each method picks, from a
window's content alone, one anchor inside the window, so equal windows have equal
anchors. Consecutive windows with the same anchor make a *chunk*: one row (anchor
hash, content hash, place) instead of one row per position. Then

1. anchors that occur once anywhere cannot be part of a repeat and drop out;
2. chunks with equal content repeat as a whole;
3. different chunks round an equal anchor are *contested*: one copy of each is
   read again and compared window by window, by the method's own means.

Texts move twice at most: to their marks, and, only those with contested chunks,
to the outcome. Counting is combined before every shuffle and the joins may be
split, so an anchor that is in a third of all documents needs no single task.
Anchors with very many different chunks are compared by counting window hashes
instead of sorting, which gives the same answer without a group in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from plumbline.llm.tables import discard, keyed, record_batch, same_row, stash, text_bytes

# An anchor with more different chunks than this is settled by window hashes.
SORTED_CHUNKS = 2_000
REPEATED, CONTESTED, CROWDED = 0, 1, 2
DONE, PENDING, CONTEXT, WINDOW = 0, 1, 2, 3


def pack(first: np.ndarray, anchor: np.ndarray, last: np.ndarray) -> np.ndarray:
    """First window, anchor and last window of a chunk as one number."""
    return (first << 16) | ((anchor - first) << 8) | (last - first)


def unpack(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    first = place >> 16
    return first, first + ((place >> 8) & 255), first + (place & 255)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of ``size`` units lie in any of the ranges."""
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, starts, 1)
    np.add.at(steps, ends, -1)
    return np.cumsum(steps[:-1]) > 0


def outcome(kept: bytes, size: int, gone: np.ndarray | None) -> tuple[int, int, int, str]:
    """Units, units removed, maximal removed runs, digest of what is kept."""
    digest = hashlib.sha256(kept).hexdigest()
    if gone is None or not gone.any():
        return size, 0, 0, digest
    return size, int(gone.sum()), int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()), digest


class Method:
    """What differs between the two operators. Instances are sent to the tasks."""

    window: int
    sorted_chunks: int = SORTED_CHUNKS

    def chunks(self, offsets, data) -> tuple[np.ndarray, ...]:
        """(row, key, content, place) of all chunks of a batch."""
        raise NotImplementedError

    def cut(self, text: bytes, starts, ends) -> tuple[bytes, int, np.ndarray | None]:
        """(kept bytes, units, which units are removed)."""
        raise NotImplementedError

    def context(self, text, first: int, last: int) -> bytes:
        """Content of the windows first..last."""
        raise NotImplementedError

    def window_hashes(self, text: bytes, first: np.ndarray, last: np.ndarray):
        """(start, hash, second hash) of all windows of the given chunks."""
        raise NotImplementedError

    def settle(self, contexts: DataFrame) -> DataFrame | None:
        """(id, th, start, end) of repeated runs among contexts (key, id, th, place, blob)."""
        return None


def find_repeats(docs: DataFrame, method: Method, id_col: str, text_col: str, with_text: bool) -> DataFrame:
    """One row per document: id, th, n_units, n_removed, n_spans, kept_sha256, kept.

    ``kept`` holds the bytes that stay, as text for word methods and as binary
    for byte methods; without ``with_text`` it stays NULL and is never written. NULL texts count as empty, rows with equal id and text get
    equal results, an empty table gives an empty result.
    """
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType
    place = T.StructType().add("id", id_type).add("th", "long").add("key", "long")
    place = place.add("content", "long").add("place", "long")
    found = stash(rows.mapInArrow(_chunk_rows(method, place), place), "chunks")

    shared_keys = found.groupBy("key").count().where("count > 1").select("key")
    shared = stash(found.join(shared_keys, "key", "left_semi"), "shared")
    discard(found)
    # Equal content: the whole chunk repeats. One place is kept to stand for it.
    kinds = stash(
        shared.groupBy("key", "content").agg(
            F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "th", "place")).alias("one")
        ),
        "kinds",
    )
    several = kinds.groupBy("key").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    contested = kinds.join(several, "key").select(
        "one.id",
        "one.th",
        F.struct(
            "one.place",
            "key",
            F.when(F.col("kinds") > method.sorted_chunks, CROWDED).otherwise(CONTESTED).alias("kind"),
        ).alias("mark"),
    )
    repeated = shared.join(kinds.where("n > 1").select("key", "content"), ["key", "content"], "left_semi")
    repeated = repeated.select(
        "id", "th", F.struct("place", F.lit(0).cast("long").alias("key"), F.lit(REPEATED).alias("kind")).alias("mark")
    )
    marks = repeated.unionByName(contested).groupBy("id", "th").agg(F.collect_set("mark").alias("marks"))

    marked = rows.join(marks, same_row(rows, marks), "left").select(rows["*"], "marks")
    first = stash(marked.mapInArrow(_first_look(method, id_type, with_text), _look_schema(id_type)), "looked")
    discard(shared, kinds)
    done = first.where(F.col("kind") == DONE)
    pending = first.where(F.col("kind") == PENDING).select("id", "th", "text", "known")
    windows = first.where(F.col("kind") == WINDOW).select("id", "th", "key", "second", "place")
    twice = windows.groupBy("key", "second").count().where("count > 1").select("key", "second")
    ranges = windows.join(twice, ["key", "second"], "left_semi").select(
        "id", "th", F.col("place").alias("start"), (F.col("place") + method.window).alias("end")
    )
    settled = method.settle(first.where(F.col("kind") == CONTEXT).select("key", "id", "th", "place", "blob"))
    if settled is not None:
        ranges = ranges.unionByName(settled)
    more = ranges.groupBy("id", "th").agg(F.collect_set(F.struct("start", "end")).alias("ranges"))
    late = pending.join(more, same_row(pending, more), "left").select(pending["*"], "ranges")
    late = stash(late.mapInArrow(_last_look(method, id_type, with_text), _result_schema(id_type)), "late")
    return done.select(late.columns).unionByName(late)


def _result_schema(id_type: T.DataType) -> T.StructType:
    out = T.StructType().add("id", id_type).add("th", "long").add("n_units", "long")
    return out.add("n_removed", "long").add("n_spans", "long").add("kept_sha256", "string").add("kept", "binary")


def _look_schema(id_type: T.DataType) -> T.StructType:
    out = T.StructType([T.StructField("kind", T.IntegerType()), *_result_schema(id_type).fields])
    out = out.add("text", "binary").add("known", "binary").add("key", "long").add("second", "long")
    return out.add("place", "long").add("blob", "binary")


def _chunk_rows(method: Method, schema: T.StructType):
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            row, key, content, at = method.chunks(offsets, data)
            if len(row):
                took = pa.array(row)
                columns = [batch.column("id").take(took), batch.column("th").take(took), key, content, at]
                yield record_batch(arrow, columns)

    return work


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.StructArray]:
    """Offsets and items of a list column, counted from its first row."""
    offsets = column.offsets.to_numpy(zero_copy_only=False)
    return offsets - offsets[0], column.flatten()


def _field(items: pa.StructArray, name: str) -> np.ndarray:
    return items.field(name).to_numpy(zero_copy_only=False)


class _Out:
    """Rows of one output batch, column by column."""

    def __init__(self, schema: T.StructType):
        self.schema = to_arrow_schema(schema)
        self.rows: dict[str, list] = {f.name: [] for f in self.schema}
        self.size = 0

    def add(self, bytes_: int = 0, **values) -> None:
        for name, into in self.rows.items():
            into.append(values.get(name))
        self.size += 100 + bytes_

    def batch(self) -> pa.RecordBatch:
        made = record_batch(self.schema, list(self.rows.values()))
        for into in self.rows.values():
            into.clear()
        self.size = 0
        return made


def _first_look(method: Method, id_type: T.DataType, with_text: bool):
    schema = _look_schema(id_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for batch in batches:
            offsets, data = text_bytes(batch.column("text"))
            at, marks = _lists(batch.column("marks"))
            place, key, kind = (_field(marks, n) for n in ("place", "key", "kind"))
            ids, ths = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for i in range(batch.num_rows):
                text = data[offsets[i] : offsets[i + 1]].tobytes()
                mine = slice(at[i], at[i + 1])
                first, _, last = unpack(place[mine])
                whole = kind[mine] == REPEATED
                starts, ends = first[whole], last[whole] + method.window
                if whole.all():
                    kept, size, gone = method.cut(text, starts, ends)
                    n, removed, spans, digest = outcome(kept, size, gone)
                    out.add(len(kept), kind=DONE, id=ids[i], th=ths[i], n_units=n, n_removed=removed,
                            n_spans=spans, kept_sha256=digest, kept=kept if with_text else None)
                else:
                    known = np.stack([starts, ends]).astype(np.int64).tobytes()
                    out.add(len(text), kind=PENDING, id=ids[i], th=ths[i], text=text, known=known)
                    for j in np.flatnonzero(kind[mine] == CONTESTED):
                        blob = method.context(text, int(first[j]), int(last[j]))
                        out.add(len(blob), kind=CONTEXT, id=ids[i], th=ths[i], key=int(key[mine][j]),
                                place=int(place[mine][j]), blob=blob)
                    crowd = kind[mine] == CROWDED
                    if crowd.any():
                        for s, one, two in zip(*method.window_hashes(text, first[crowd], last[crowd])):
                            out.add(kind=WINDOW, id=ids[i], th=ths[i], key=one, second=two, place=s)
                if out.size > 4_000_000:
                    yield out.batch()
        if out.size:
            yield out.batch()

    return work


def _last_look(method: Method, id_type: T.DataType, with_text: bool):
    schema = _result_schema(id_type)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = _Out(schema)
        for batch in batches:
            at, ranges = _lists(batch.column("ranges"))
            starts, ends = _field(ranges, "start"), _field(ranges, "end")
            ids, ths = batch.column("id").to_pylist(), batch.column("th").to_pylist()
            for i in range(batch.num_rows):
                text = batch.column("text")[i].as_py()
                known = np.frombuffer(batch.column("known")[i].as_py(), np.int64).reshape(2, -1)
                s = np.concatenate([known[0], starts[at[i] : at[i + 1]]])
                e = np.concatenate([known[1], ends[at[i] : at[i + 1]]])
                kept, size, gone = method.cut(text, s, e)
                n, removed, spans, digest = outcome(kept, size, gone)
                out.add(len(kept), id=ids[i], th=ths[i], n_units=n, n_removed=removed, n_spans=spans,
                        kept_sha256=digest, kept=kept if with_text else None)
                if out.size > 4_000_000:
                    yield out.batch()
        if out.size:
            yield out.batch()

    return work
