"""Readers for CSV, JSON, Excel and Parquet, chosen by file extension."""

from __future__ import annotations

from functools import reduce
from pathlib import PurePosixPath
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from plumbline.functions.fields import column, quoted, small_table
from plumbline.sources import ranges as ranged
from plumbline.sources.excel import read_excel

SUPPORTED = (".csv", ".json", ".parquet", ".xls", ".xlsx")

# Spellings of a missing value in text files.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

WHOLE = "^[+-]?[0-9]{1,18}$"
DECIMAL = "^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI]nf|[iI]nfinity)$"
TRUTH = "^(true|false|True|False|TRUE|FALSE)$"


def detect_format(path: str) -> str:
    """Lower-case extension with its dot, ``''`` when there is none."""
    return PurePosixPath(str(path).rstrip("/")).suffix.lower()


def load(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read a file or folder in the format its name tells."""
    readers = {
        ".csv": load_csv,
        ".json": load_json,
        ".parquet": load_parquet,
        ".xlsx": load_excel,
        ".xls": load_excel,
    }
    fmt = detect_format(path)
    if fmt not in readers:
        raise ValueError(f"Unsupported format '{fmt}'. Supported: {', '.join(SUPPORTED)}")
    return readers[fmt](spark, path, **options)


def load_parquet(spark: SparkSession, path: str, **options) -> DataFrame:
    return spark.read.options(**options).parquet(str(path))


def load_csv(spark: SparkSession, path: str, schema=None, **options) -> DataFrame:
    """Read CSV with a header; all usual spellings of a missing value are NULL.

    Without a schema the types come from one pass over all values, after the
    missing ones are out of the way: whole numbers, decimals, true/false, text.
    Quotes inside quotes are doubled. Files in which a quoted value has a line
    break are cut into records by ranges, so one file feeds many tasks; only
    those that cannot be cut (quotes inside plain fields, bare carriage returns,
    other quotes or escapes) are read whole, each in a task.
    """
    options = {"header": True, "escape": '"', **options}
    if schema is not None:
        return _read_csv(spark, path, options, schema)
    raw = _read_csv(spark, path, {**options, "inferSchema": False}, None)
    text = raw.select(
        *[F.when(~column(c).isin(*MISSING), column(c)).alias(c) for c in raw.columns]
    )
    return typed_text(text)


# Options with which records can be cut: others change what a quote or a line means.
_CUT_OPTIONS = {"header", "escape", "sep", "inferSchema"}


def _read_csv(spark: SparkSession, path: str, options: dict, schema) -> DataFrame:
    """Files without broken lines are read by lines, the others by ranges, or whole where that fails."""
    prepared = lambda: spark.read.options(**options) if schema is None else spark.read.options(**options).schema(schema)
    ranges = small_table(ranged.csv_ranges(spark, str(path)))
    files = ranges.groupBy("file").agg(F.bool_or("broken").alias("broken"), F.bool_or("bare").alias("bare")).collect()
    lines, cut, whole = [], [], []
    cuttable = set(options) <= _CUT_OPTIONS and options["escape"] == '"' and len(options.get("sep", ",")) == 1
    for r in sorted(files, key=lambda r: r.file):  # a row per file
        (lines if not r.broken else cut if cuttable and not r.bare else whole).append(unquote(r.file))
    parts = []
    if cut:
        records = ranged.csv_records(spark, cut, ranges, options.get("sep", ","))
        torn = {unquote(r.file) for r in records.where(~F.col("sound")).select("file").distinct().collect()}
        whole, cut = whole + [f for f in cut if f in torn], [f for f in cut if f not in torn]
    if cut:
        records = ranged.csv_records(spark, cut, ranges, options.get("sep", ","))
        parts += _parsed_csv(spark, records, options, schema)
    if lines or not parts and not whole:
        parts.append(prepared().csv(lines or str(path)))
    if whole:
        parts.append(prepared().option("multiLine", True).csv(whole))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _parsed_csv(spark: SparkSession, records: DataFrame, options: dict, schema) -> list[DataFrame]:
    """Fields of records, a table for each spelling of the header."""
    is_first = (F.col("start") == 0) & (F.col("no") == 0)
    firsts = records.where(is_first).select("file", "value").collect()  # a row per file
    by_header: dict[str, list[str]] = {}
    has_header = str(options["header"]).lower() == "true"
    for r in sorted(firsts, key=lambda r: r.file):
        by_header.setdefault(r.value.strip("\r\ufeff") if has_header else "", []).append(r.file)
    parts = []
    for header, files in by_header.items():
        sample = header if has_header else firsts[0].value
        # the reader itself names the columns, as for any other file
        told = spark.read.options(**options) if schema is None else spark.read.options(**options).schema(schema)
        names = told.csv(spark.sparkContext.parallelize([sample], 1)).schema
        fields = ", ".join(f"{quoted(f.name)} {f.dataType.simpleString()}" for f in names)
        mine = records.where(F.col("file").isin(files))
        mine = mine.where(~is_first) if has_header else mine
        line = F.regexp_replace("value", "\\r$", "")
        shown = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items() if k in ("sep", "escape")}
        shown["multiLine"] = "true"  # line ends inside quotes stay as they are
        parts.append(mine.select(F.from_csv(line, fields, shown).alias("r")).select("r.*"))
    return parts


def typed_text(text: DataFrame) -> DataFrame:
    """Cast text columns to the narrowest of bigint, double, boolean, string."""
    tests = {"bigint": WHOLE, "double": DECIMAL, "boolean": TRUTH}
    measures = [
        f"coalesce(bool_and({quoted(c)} RLIKE '{pattern}'), false) AS `{i}_{name}`"
        for i, c in enumerate(text.columns)
        for name, pattern in tests.items()
    ]
    fits = text.selectExpr(*measures).first()
    shown = []
    for i, c in enumerate(text.columns):
        kind = next((name for name in tests if fits[f"{i}_{name}"]), "string")
        shown.append(column(c).cast(kind).alias(c))
    return text.select(*shown)


def load_json(spark: SparkSession, path: str, **options) -> DataFrame:
    """Read JSON records: one array, one spread-out object, one object per line, or columns of numbered cells.

    Each file is read in its own way: in a file of lines no line begins an array
    or is a brace alone, and any other file has such a line. A file that is one
    array of objects is cut into records by ranges, so it feeds many tasks; other
    files that are not lines are read whole, each in a task. Objects that hold
    nothing but columns, each an object of cells by row number, are turned into
    rows; rows without any value are left out.
    """
    found = _read_json(spark, path, options)
    return _rows_of_columns(found) if _is_by_column(found.schema) else found


def _is_by_column(schema: T.StructType) -> bool:
    """Whether all columns are objects with the same row numbers as names."""
    kinds = [f.dataType for f in schema.fields]
    if not kinds or not all(isinstance(k, T.StructType) for k in kinds):
        return False
    numbers = set(kinds[0].names)
    return bool(numbers) and all(set(k.names) == numbers for k in kinds) and all(n.isdigit() for n in numbers)


def _rows_of_columns(table: DataFrame) -> DataFrame:
    cells = lambda c: F.from_json(F.to_json(column(c), {"ignoreNullFields": "false"}), "map<string,string>")
    wide = table.select(*[F.map_values(cells(c)).alias(c) for c in table.columns])
    rows = wide.select(F.inline(F.arrays_zip(*[column(c) for c in table.columns])))
    return typed_text(rows.toDF(*table.columns).dropna("all"))


# A line that no file of JSON records has.
_NOT_A_RECORD = "ltrim(value) LIKE '[%' OR trim(value) = '{'"


def _read_json(spark: SparkSession, path: str, options: dict) -> DataFrame:
    """Files of lines are read by lines, arrays of objects by ranges, and the rest whole."""
    text = spark.read.options(**{k: v for k, v in options.items() if k in ("recursiveFileLookup", "pathGlobFilter")})
    found = text.text(str(path)).select("value", F.col("_metadata.file_path").alias("file"))
    files = found.groupBy("file").agg(F.coalesce(F.bool_or(F.expr(_NOT_A_RECORD)), F.lit(False)).alias("other")).collect()
    lines = sorted(unquote(r.file) for r in files if not r.other)  # a row per file
    whole = sorted(unquote(r.file) for r in files if r.other)
    if not whole:
        return spark.read.options(**options).json(str(path))
    parts = []
    ranges = small_table(ranged.json_ranges(spark, whole))
    arrays = {unquote(r.file) for r in ranges.where(ranged.begins_array()).select("file").distinct().collect()}
    if arrays:
        records = ranged.json_records(spark, sorted(arrays), ranges)
        arrays -= {unquote(r.file) for r in records.where(~F.col("sound")).select("file").distinct().collect()}
    if arrays:
        records = ranged.json_records(spark, sorted(arrays), ranges).select("value")
        texts = getattr(records._jdf, "as")(spark._jvm.org.apache.spark.sql.Encoders.STRING())
        parts.append(DataFrame(spark.read.options(**options)._jreader.json(texts), spark))
    if lines:
        parts.append(spark.read.options(**options).json(lines))
    rest = [f for f in whole if f not in arrays]
    if rest:
        parts.append(spark.read.options(**options).option("multiLine", True).json(rest))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def load_excel(spark: SparkSession, path: str, sheet: int | str = 0) -> DataFrame:
    """Read one sheet of a workbook, or of every workbook in a folder."""
    if detect_format(path) == ".xls":
        raise ValueError("Legacy .xls workbooks are not supported; save them as .xlsx")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[xX][lL][sS][xX]").load(str(path))
    return read_excel(files.select("path", "content"), sheet)
