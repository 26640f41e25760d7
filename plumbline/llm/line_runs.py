"""Drop lines that an earlier document already holds, with levelled runs of line hashes.

Documents come in batches, in order of their ids. A batch's line hashes are
merge-anti-joined with the runs written so far; what is new becomes another
sorted run. When a level has ``fan_in`` runs they are merged into one of the next
level, so a batch meets few runs however many came before. Each hash is in one
run only, with the first document that holds it. DataFrame functions throughout.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from plumbline.llm.tables import carried, in_row, keyed, same_row, stash, unpacked, whole_text
from plumbline.session import run_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANK = " \t\n\x0b\f\r"
LEAST_CHARS = 10
BATCHES = 4
FAN_IN = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


class LineRuns:
    """Runs (line, first) in the shared folder: each line hash once, sorted, with its first document."""

    def __init__(self, spark: SparkSession, id_type: T.DataType, fan_in: int = FAN_IN):
        self.spark, self.fan_in = spark, fan_in
        self.schema = T.StructType().add("line", "binary").add("first", id_type)
        self.levels: list[list[str]] = [[]]

    def known(self) -> DataFrame:
        """All runs together."""
        runs = [self._read(p) for level in self.levels for p in level]
        return reduce(DataFrame.unionAll, runs) if runs else self.spark.createDataFrame([], self.schema)

    def add(self, lines: DataFrame) -> None:
        """Enter a batch of (line, id); of several ids the least counts, NULL only if alone."""
        mine = lines.groupBy("line").agg(F.min("id").alias("first"))
        if any(self.levels):
            mine = mine.hint("merge").join(self.known(), "line", "left_anti")
        self.levels[0].append(self._write(mine))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) >= self.fan_in:
            runs = reduce(DataFrame.unionAll, [self._read(p) for p in self.levels[level]])
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._write(runs.repartition("line")))
            self.levels[level] = []
            level += 1

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(path)

    def _write(self, run: DataFrame) -> str:
        path = run_folder(self.spark, "line-run")
        run.select("line", "first").sortWithinPartitions("line").write.parquet(path)
        return path


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, batches: int = BATCHES) -> DataFrame:
    """(id, th, gone): sorted positions of the lines to drop, for rows that lose any."""
    spark = docs.sparkSession
    rows = keyed(docs, id_col, text_col)
    id_type = rows.schema["id"].dataType
    lines = (
        rows.select("id", "th", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
        .select("id", "th", "pos", line_key(F.col("line")).alias("key"))
        .where(F.char_length("key") >= LEAST_CHARS)
        .select("id", "th", "pos", F.unhex(F.md5("key")).alias("line"))
    )
    cuts = []
    if isinstance(id_type, T.NumericType) and batches > 1:
        shares = [i / batches for i in range(1, batches)]
        cuts = rows.agg(F.percentile_approx("id", shares).alias("cuts")).first().cuts or []
    # NULL ids compare as NULL, count as 0 cuts passed, and are sent to the last batch
    passed = reduce(Column.__add__, [(F.col("id") > c).cast("int") for c in cuts], F.lit(0))
    lines = stash(lines.withColumn("batch", F.coalesce(passed, F.lit(len(cuts)))), "lines", "batch")

    runs = LineRuns(spark, id_type)
    for batch in range(len(cuts) + 1):
        runs.add(lines.where(F.col("batch") == batch))
    later = F.col("first").isNotNull() & (F.col("id").isNull() | (F.col("id") > F.col("first")))
    return (
        lines.join(runs.known(), "line").where(later).groupBy("id", "th")
        .agg(F.sort_array(F.collect_set("pos")).alias("gone"))
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", batches: int = BATCHES
) -> DataFrame:
    """Each line text stays in the document of the least id that holds it, and only there.

    Lines are split at line feeds and compared by ``line_key``; keys under ten
    code points always stay. All columns of ``docs`` are returned, in a struct
    ``row`` whose text has lost its repeated lines, with ``n_lines`` (before) and
    ``n_dropped``. Repeats inside one document stay. A NULL text is one empty
    line. Rows with the same id count as one document, as do all rows without id,
    which come last. An empty table gives an empty result.
    """
    gone = repeated_lines(docs, id_col, text_col, batches)
    rows = carried(docs, id_col, text_col)
    joined = rows.join(gone, same_row(rows, gone), "left").select("row", "gone")
    split = joined.withColumn("lines", F.split(F.coalesce(in_row(text_col).cast("string"), F.lit("")), "\n"))
    # Kept stretches lie between the dropped lines.
    starts = F.concat(F.array(F.lit(0)), F.transform("gone", lambda p: p + 1))
    ends = F.concat(F.col("gone"), F.array(F.size("lines")))
    stretches = F.transform(
        F.arrays_zip(starts.alias("s"), ends.alias("e")),
        lambda x: F.slice(F.col("lines"), x["s"] + 1, x["e"] - x["s"]),
    )
    kept = F.when(F.col("gone").isNull(), in_row(text_col)).otherwise(F.array_join(F.flatten(stretches), "\n"))
    return split.select(
        F.struct(*unpacked(docs.columns, **{text_col: kept})).alias("row"),
        F.size("lines").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = F.coalesce(in_row("text"), F.lit(""))
    return dedup_lines(docs).select(
        in_row("doc_id").alias("doc_id"), "n_lines", "n_dropped", F.sha2(kept, 256).alias("kept_sha256")
    )


OP2_SQL = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keys AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
first AS (SELECT key, min(doc_id) AS doc_id FROM keys WHERE length(key) >= 10 GROUP BY key),
marked AS (
  SELECT k.doc_id, k.pos, k.line, coalesce(f.doc_id < k.doc_id, false) AS gone
  FROM keys k LEFT JOIN first f ON f.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
