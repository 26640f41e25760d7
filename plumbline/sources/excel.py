"""Excel workbooks: each is unpacked in one task, typed over all of them.

An .xlsx file is a zip of XML parts, so the standard library is enough.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from xml.etree import ElementTree
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from plumbline.session import freeze

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
# Number formats that the file format itself reserves for dates.
DATE_FORMATS = {*range(14, 23), *range(45, 48)}
FIRST_DAY = datetime(1899, 12, 30)
ROWS_PER_BATCH = 10_000

CELLS = "path string, row long, cells map<string,struct<kind:string,text:string,position:int>>"


def read_excel(files: DataFrame, sheet: int | str = 0) -> DataFrame:
    """Rows of a sheet from a table of (path, content).

    Columns are named by each workbook's first row; a column's type is what all
    its cells agree on: number, date, true/false, else text.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                rows = []
                for number, cells in sheet_rows(content, sheet):
                    rows.append((path, number, cells))
                    if len(rows) == ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=["path", "row", "cells"])
                        rows = []
                yield pd.DataFrame(rows, columns=["path", "row", "cells"])

    # unpacking is dear, and both the types and the rows are read from it
    rows = freeze(files.select("path", "content").mapInPandas(unpack, CELLS))
    kinds = (
        rows.select(F.explode("cells").alias("name", "cell"))
        .groupBy("name")
        .agg(
            F.min("cell.position").alias("position"),
            F.collect_set(F.when(F.col("cell.text").isNotNull(), F.col("cell.kind"))).alias("kinds"),
            F.bool_and(F.coalesce(F.col("cell.text").rlike("^-?[0-9]{1,15}$"), F.lit(True))).alias("whole"),
        )
        .orderBy("position", "name")
        .collect()
    )  # a row per column of the sheet
    shown = []
    for k in kinds:
        text = F.col("cells")[k.name]["text"]
        target = {"n": "bigint" if k.whole else "double", "b": "boolean", "d": "timestamp_ntz"}
        shown.append(text.cast(target.get(k.kinds[0], "string") if len(k.kinds) == 1 else "string").alias(k.name))
    return rows.select(*shown)


def sheet_rows(content: bytes, sheet: int | str):
    """(row number, {column: (kind, text, position)}) for each row below the header."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        shared, dates = _shared_texts(book), _date_styles(book)
        names: dict[int, str] = {}
        with book.open(_sheet_part(book, sheet)) as part:
            for _, node in ElementTree.iterparse(part):
                if node.tag != MAIN + "row":
                    continue
                cells = dict(_cell(c, i, shared, dates) for i, c in enumerate(node.findall(MAIN + "c")))
                number = int(node.get("r", 0))
                node.clear()
                if not names:
                    names = headings({at: text for at, (_, text) in cells.items() if text is not None})
                else:
                    blank = ("", None)
                    for at in cells.keys() - names.keys():
                        names[at] = f"Unnamed: {at}"
                    yield number, {n: (*cells.get(at, blank), at) for at, n in names.items()}


def headings(texts: dict[int, str]) -> dict[int, str]:
    """A name for every column up to the last heading: empty ones by position, equal ones numbered."""
    names: dict[int, str] = {}
    for at in range(max(texts, default=-1) + 1):
        name = base = texts.get(at, f"Unnamed: {at}")
        n = 0
        while name in names.values():
            n += 1
            name = f"{base}.{n}"
        names[at] = name
    return names


def _cell(node, index, shared, dates):
    letters = re.match("[A-Z]+", node.get("r", ""))
    at = index
    if letters:
        at = 0
        for letter in letters.group():
            at = at * 26 + ord(letter) - 64
        at -= 1
    kind, value = node.get("t", "n"), node.findtext(MAIN + "v")
    if kind == "inlineStr":
        return at, ("s", "".join(t.text or "" for t in node.iter(MAIN + "t")))
    if value is None or kind == "e":
        return at, ("", None)
    if kind == "s":
        return at, ("s", shared[int(value)])
    if kind == "b":
        return at, ("b", "true" if value == "1" else "false")
    if kind == "d":
        return at, ("d", value.replace("T", " "))
    if kind == "n" and int(node.get("s", 0)) in dates:
        return at, ("d", str(FIRST_DAY + timedelta(microseconds=round(float(value) * 86400e6))))
    return at, (kind if kind == "n" else "s", value)


def _shared_texts(book):
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in item.iter(MAIN + "t")) for item in root.findall(MAIN + "si")]


def _date_styles(book):
    """Numbers of the cell styles that show a number as a date."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    own = {
        int(f.get("numFmtId"))
        for f in root.iter(MAIN + "numFmt")
        if re.search("[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", f.get("formatCode", "")).lower())
    }
    formats = root.find(MAIN + "cellXfs")
    styles = formats.findall(MAIN + "xf") if formats is not None else []
    return {i for i, s in enumerate(styles) if int(s.get("numFmtId", 0)) in DATE_FORMATS | own}


def _sheet_part(book, sheet):
    sheets = ElementTree.fromstring(book.read("xl/workbook.xml")).findall(f"{MAIN}sheets/{MAIN}sheet")
    by_name = {s.get("name"): s for s in sheets}
    if isinstance(sheet, str) and sheet not in by_name:
        raise ValueError(f"No sheet named '{sheet}'; there are {sorted(by_name)}")
    chosen = by_name[sheet] if isinstance(sheet, str) else sheets[sheet]
    links = ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))
    target = next(r.get("Target") for r in links if r.get("Id") == chosen.get(LINK))
    return target.lstrip("/") if target.startswith("/") else "xl/" + target


# ------------------------------------------------------------------------ packing


def pack_workbooks(df: DataFrame) -> DataFrame:
    """(path, content): the rows of a table as workbooks.

    Each task makes a workbook of every batch of rows it is handed, so nothing
    is shuffled and a workbook never holds more rows than an Arrow batch.
    """
    names = df.columns

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            yield pd.DataFrame({"path": [f"book-{task}-{i}.xlsx"], "content": [workbook(names, batch)]})

    return df.mapInPandas(pack, "path string, content binary")


def workbook(names: list[str], frame: pd.DataFrame) -> bytes:
    """A workbook with one sheet: a header row, then the rows of the frame."""
    rows = [names, *frame.itertuples(index=False)]
    sheet = "".join("<row>" + "".join(_cell_xml(v) for v in row) + "</row>" for row in rows)
    space = MAIN.strip("{}")
    link_space = LINK[1:].split("}")[0]
    package = "http://schemas.openxmlformats.org/package/2006"
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{package}/content-types"><Default Extension="xml" '
        'ContentType="application/xml"/><Default Extension="rels" '
        'ContentType="application/vnd.openxmlformats-package.relationships+xml"/></Types>',
        "_rels/.rels": f'<Relationships xmlns="{package}/relationships"><Relationship Id="r1" '
        f'Type="{link_space}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="{link_space}"><sheets>'
        '<sheet name="Sheet1" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{package}/relationships"><Relationship '
        f'Id="r1" Type="{link_space}/worksheet" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData>{sheet}</sheetData></worksheet>',
    }
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for name, text in parts.items():
            book.writestr(name, text)
    return out.getvalue()


def _cell_xml(value) -> str:
    if value is None or value != value:
        return "<c/>"
    if isinstance(value, (bool, np.bool_)):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, np.integer, np.floating)):
        return f"<c><v>{value.item()!r}</v></c>" if hasattr(value, "item") else f"<c><v>{value!r}</v></c>"
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'
