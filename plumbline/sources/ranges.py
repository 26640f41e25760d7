"""Records of one large CSV or JSON file, read by byte ranges in many tasks.

A range of a CSV file may begin inside a quoted value, and one of a JSON array inside a
string or several objects deep. Each range says what it would do to that state, running
sums over a file's ranges (a row each) tell the state that every range begins in, and
then each range cuts its own records. What a range has of a record that begins before or
ends after it is put together with its neighbours' parts.

Lines of CSV end at line feeds. Text of JSON is read up to closing braces, so a file
without any line break is split as well.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

WHOLE, HEAD, TAIL, MIDDLE = range(4)
RECORDS = T.StructType().add("file", "string").add("start", "long").add("no", "long").add("kind", "integer")
RECORDS = RECORDS.add("value", "string").add("sound", "boolean")
STATES = T.StructType().add("file", "string").add("start", "long").add("parity", "long").add("out", "long")
STATES = STATES.add("inside", "long").add("head", "string")
# Rows of an output batch, and characters.
ROWS_OUT, CHARS_OUT = 5_000, 4 << 20
HEAD_CHARS = 256
_ESCAPED = re.compile(r"\\.", re.S)
_ARRAY = r"^[ \t\r\n\x{FEFF}]*\[[ \t\r\n]*\{"


def pieces(spark: SparkSession, files: list[str], mark: str) -> DataFrame:
    """(value, file, start): the text between marks, in order within each range of each file."""
    text = spark.read.option("lineSep", mark).text(files)
    return text.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _state_before(ranges: DataFrame) -> DataFrame:
    """Add ``quoted``, whether a range begins inside quotes; ``parity`` is its own number of quotes."""
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    return ranges.withColumn("quoted", F.coalesce(F.sum("parity").over(earlier), F.lit(0)) % 2 == 1)


class _Out:
    """Rows of records, as batches of bounded size."""

    def __init__(self):
        self.arrow, self.rows, self.chars = to_arrow_schema(RECORDS), [], 0

    def add(self, *row) -> None:
        self.rows.append(row)
        self.chars += len(row[4])

    def batches(self, last: bool = False) -> Iterator[pa.RecordBatch]:
        if self.rows and (last or len(self.rows) >= ROWS_OUT or self.chars >= CHARS_OUT):
            columns = [pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.arrow)]
            yield pa.RecordBatch.from_arrays(columns, schema=self.arrow)
            self.rows, self.chars = [], 0


def _by_range(batches: Iterator[pa.RecordBatch], *more: str):
    """(range, its other columns, value) of each row, in order."""
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("file", "start", *more, "value")]
        for file, start, *rest, value in zip(*columns):
            yield (file, start), rest, value


def _together(parts: DataFrame, between: str, closing: str) -> DataFrame:
    """Records that lie in several ranges, out of the parts in each; a row or two per range."""
    order = Window.partitionBy("file").orderBy("start", "no")
    numbered = parts.withColumn("record", F.sum((F.col("kind") == HEAD).cast("long")).over(order))
    joined = numbered.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("start", "no", "value"))).alias("parts"),
        F.bool_and("sound").alias("sound"), F.max((F.col("kind") == TAIL).cast("int")).alias("ends"),
    )
    text = F.array_join(F.transform("parts", lambda p: p["value"]), between)
    # what follows the last record of a file
    ended = (F.col("ends") == 1) | ~F.regexp_like("value", F.lit(closing))
    return joined.select(
        "file", F.col("parts")[0]["start"].alias("start"), F.col("parts")[0]["no"].alias("no"), text.alias("value"),
        F.col("sound"), "ends",
    ).where(ended).select("file", "start", "no", "value", (F.col("sound") & (F.col("ends") == 1)).alias("sound"))


def _records(found: DataFrame, between: str, closing: str) -> DataFrame:
    whole = found.where(F.col("kind") == WHOLE).select("file", "start", "no", "value", "sound")
    return whole.unionByName(_together(found.where(F.col("kind") != WHOLE), between, closing))


# ------------------------------------------------------------------------- CSV


def csv_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, parity, broken, bare): quotes of each range, whether a line leaves one open or has a bare carriage return."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    lines = pieces(spark, [path], "\n").select("file", "start", quotes.alias("quotes"), "value")
    return lines.groupBy("file", "start").agg(
        F.sum("quotes").cast("long").alias("parity"), F.bool_or(F.col("quotes") % 2 == 1).alias("broken"),
        F.bool_or(F.regexp_like("value", F.lit("\\r(?!$)"))).alias("bare"),
    )


def _sound(sep: str):
    """Whether quotes stand only round whole fields, doubled inside."""
    field = f'(?:"[^"]*+(?:""[^"]*+)*+"|[^"{re.escape(sep)}]*+)'
    whole = re.compile(f"{field}(?:{re.escape(sep)}{field})*+\r?")
    return lambda record: '"' not in record or whole.fullmatch(record) is not None


def _cut_csv(sep: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, sound = _Out(), _sound(sep)
        now, held, began, inside, no = None, [], False, False, 0

        def left_over():
            if held or (inside and not began):
                out.add(*now, no, HEAD if began else MIDDLE, "\n".join(held), True)

        for place, (quoted,), line in _by_range(batches, "quoted"):
            if place != now:
                if now is not None:
                    left_over()
                now, held, began, inside, no = place, [], False, quoted, 0
            odd = line.count('"') % 2
            if inside:
                held.append(line)
                if odd:
                    record = "\n".join(held)
                    out.add(*now, no, WHOLE if began else TAIL, record, not began or sound(record))
                    held, inside, no = [], False, no + 1
            elif odd:
                held, began, inside = [line], True, True
            elif line not in ("", "\r"):
                out.add(*now, no, WHOLE, line, sound(line))
                no += 1
            yield from out.batches()
        if now is not None:
            left_over()
        yield from out.batches(last=True)

    return work


def _checked(sep: str):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sound = _sound(sep)
        for batch in batches:
            fine = [s and sound(v) for v, s in zip(batch.column("value").to_pylist(), batch.column("sound").to_pylist())]
            yield batch.set_column(batch.schema.get_field_index("sound"), "sound", pa.array(fine, pa.bool_()))

    return work


def csv_records(spark: SparkSession, files: list[str], ranges: DataFrame, sep: str) -> DataFrame:
    """(file, start, no, value, sound): the records of files whose lines end at line feeds.

    ``ranges`` is that of ``csv_ranges``. A record is not sound if a quote stands
    inside a field without quotes, or is never closed: then its file cannot be cut.
    """
    states = _state_before(ranges).select("file", "start", "quoted")
    lines = pieces(spark, files, "\n").join(F.broadcast(states), ["file", "start"])  # a row per range
    found = lines.select("file", "start", "quoted", "value").mapInArrow(_cut_csv(sep), RECORDS)
    whole = found.where(F.col("kind") == WHOLE).select("file", "start", "no", "value", "sound")
    parts = _together(found.where(F.col("kind") != WHOLE), "\n", "^$")
    return whole.unionByName(parts.mapInArrow(_checked(sep), parts.schema))


# ------------------------------------------------------------------------ JSON


def _effect(text: str) -> tuple[int, int, int]:
    """(quotes odd, change of depth if the text begins outside a string, or inside one), closing brace included."""
    if "\\" in text:
        text = _ESCAPED.sub("", text)
    parts = text.split('"')
    odd = (len(parts) + 1) % 2
    depth = [sum(p.count("{") + p.count("[") - p.count("]") for p in parts[at::2]) for at in (0, 1)]
    return odd, depth[0] - (1 - odd), depth[1] - odd


def _json_states(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to the state: its quotes, and the change of depth from either state."""
    rows, now = [], None
    for place, _, text in _by_range(batches):
        if place != now:
            now = place
            rows.append([*place, 0, 0, 0, text[:HEAD_CHARS] if place[1] == 0 else None])
        odd, plain, quoted = _effect(text)
        row = rows[-1]
        row[3], row[4] = row[3] + (quoted if row[2] else plain), row[4] + (plain if row[2] else quoted)
        row[2] ^= odd
    if rows:
        arrow = to_arrow_schema(STATES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)], schema=arrow)


def json_ranges(spark: SparkSession, files: list[str]) -> DataFrame:
    """(file, start, parity, out, inside, head): the effect of each range, and how its file begins."""
    return pieces(spark, files, "}").select("file", "start", "value").mapInArrow(_json_states, STATES)


def begins_array():
    """Whether ``head`` begins an array of objects."""
    return F.regexp_like("head", F.lit(_ARRAY))


def _cut_json(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = _Out()
    now, held, began, quoted, depth, no = None, [], True, False, 0, 0

    def left_over():
        if held:
            out.add(*now, no, HEAD if began else MIDDLE, "".join(held), True)

    for place, (was_quoted, was_deep), text in _by_range(batches, "quoted", "depth"):
        if place != now:
            if now is not None:
                left_over()
            now, held, quoted, depth, no = place, [], was_quoted, was_deep, 0
            # in the array or before it, the next brace begins a record
            began = not quoted and depth <= 1
        odd, plain, inside = _effect(text)
        depth += inside if quoted else plain
        quoted ^= bool(odd)
        held.append(text + "}")
        if depth == 1 and not quoted:
            record = "".join(held)
            sound = True
            if began:
                at = record.index("{")
                sound = record[:at].strip(" \t\r\n,[﻿") == ""
                record = record[at:]
            out.add(*now, no, WHOLE if began else TAIL, record, sound)
            held, began, no = [], True, no + 1
        yield from out.batches()
    if now is not None:
        left_over()
    yield from out.batches(last=True)


def json_records(spark: SparkSession, files: list[str], ranges: DataFrame) -> DataFrame:
    """(file, start, no, value, sound): the objects of files that hold one array of objects each.

    ``ranges`` is that of ``json_ranges``. A record is not sound if something
    else than an object stands before it, or if its file does not close the array.
    """
    states = _state_before(ranges)
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    change = F.when(F.col("quoted"), F.col("inside")).otherwise(F.col("out"))
    states = states.withColumn("depth", F.coalesce(F.sum(change).over(earlier), F.lit(0)))
    # the bracket that ends the array, and the brace that the last piece is read as having
    closed = states.groupBy("file").agg((F.sum(change) == -1).alias("closed"))
    states = states.select("file", "start", "quoted", "depth")
    text = pieces(spark, files, "}").join(F.broadcast(states), ["file", "start"])  # a row per range
    found = text.select("file", "start", "quoted", "depth", "value").mapInArrow(_cut_json, RECORDS)
    # the brace that the last piece of a file is given was not there
    records = _records(found, "", r"^[ \t\r\n]*\][ \t\r\n]*\}?$")
    at = F.instr("value", "{")
    before = F.substring_index("value", "{", 1)
    joined = F.when(F.startswith("value", F.lit("{")), F.col("value")).otherwise(F.expr("substring(value, instr(value, '{'))"))
    clean = (at > 0) & F.regexp_like(before, F.lit(r"^[ \t\r\n,\[\x{FEFF}]*$"))
    sound = F.col("sound") & clean & F.col("closed")
    records = records.join(F.broadcast(closed), "file")  # a row per file
    return records.select("file", "start", "no", joined.alias("value"), sound.alias("sound"))
