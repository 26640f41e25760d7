"""Readers by format, workbooks, samples."""

import io
import json
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline import load, load_sample
from plumbline.functions.text import file_suffix
from plumbline.sources import excel, ranges, readers, samples


@pytest.mark.parametrize(
    "name, ext", [("data.csv", ".csv"), ("DATA.CSV", ".csv"), ("a/b.c/x.JSON", ".json"), ("x.xlsx", ".xlsx"), ("x.parquet/", ".parquet"), ("none", "")]
)
def test_format_detection(spark, name, ext):
    assert readers.detect_format(name) == ext
    path = spark.createDataFrame([(name.rstrip("/"),)], "p string")
    assert path.select(file_suffix(F.col("p")).alias("s")).first().s == ext


def test_unknown_formats(spark):
    with pytest.raises(ValueError, match="Unsupported format '.txt'"):
        load(spark, "a.txt")
    with pytest.raises(ValueError, match="xls"):
        load(spark, "a.xls")


def test_csv_missing_spellings_and_types(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("id,x,flag,word,day\n1,1.5,True,a,2024-01-01\nNA,n/a,False,null,2024-01-02\n3,2e3,NaN,None,#N/A\n")
    df = load(spark, str(path))
    assert df.dtypes == [("id", "bigint"), ("x", "double"), ("flag", "boolean"), ("word", "string"), ("day", "string")]
    assert [tuple(r) for r in df.collect()] == [
        (1, 1.5, True, "a", "2024-01-01"), (None, None, False, None, "2024-01-02"), (3, 2000.0, None, None, None),
    ]
    assert load(spark, str(path), schema="id string, x string, flag string, word string, day string").dtypes[0] == ("id", "string")
    assert load(spark, str(path), sep=";").columns == ["id,x,flag,word,day"]


@pytest.mark.parametrize(
    "text", ['[{"a": 1, "b": "x"}, {"a": 2, "b": "y"}]', '[\n  {"a": 1, "b": "x"},\n  {"a": 2, "b": "y"}\n]', '\n  {"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n']
)
def test_json_arrays_and_lines(spark, tmp_path, text):
    (tmp_path / "t.json").write_text(text)
    assert [tuple(r) for r in load(spark, str(tmp_path / "t.json")).orderBy("a").collect()] == [(1, "x"), (2, "y")]


def office_workbook(path):
    """A workbook as office programs write it: shared texts, styles, two sheets."""
    space = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    links = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    rel = 'xmlns="http://schemas.openxmlformats.org/package/2006/relationships"'
    head = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c></row>'
    first = (
        f"<worksheet {space}><sheetData>{head}"
        '<row r="2"><c r="A2"><v>1</v></c><c r="B2" s="1"><v>45292.5</v></c><c r="C2" t="b"><v>1</v></c><c r="D2" t="s"><v>4</v></c></row>'
        '<row r="3"><c r="A3"><v>2.5</v></c><c r="D3" t="e"><v>#N/A</v></c></row></sheetData></worksheet>'
    )
    second = f'<worksheet {space}><sheetData><row><c t="inlineStr"><is><t>only</t></is></c></row><row><c><v>9</v></c></row></sheetData></worksheet>'
    with zipfile.ZipFile(path, "w") as book:
        book.writestr("xl/workbook.xml", f'<workbook {space} xmlns:r="{links}"><sheets><sheet name="One" r:id="r1"/><sheet name="Two" r:id="r2"/></sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", f'<Relationships {rel}><Relationship Id="r1" Target="worksheets/a.xml"/><Relationship Id="r2" Target="/xl/worksheets/b.xml"/></Relationships>')
        book.writestr("xl/sharedStrings.xml", f"<sst {space}><si><t>num</t></si><si><t>day</t></si><si><t>ok</t></si><si><t>word</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>")
        book.writestr("xl/styles.xml", f'<styleSheet {space}><numFmts><numFmt numFmtId="170" formatCode="yyyy-mm-dd"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/></cellXfs></styleSheet>')
        book.writestr("xl/worksheets/a.xml", first)
        book.writestr("xl/worksheets/b.xml", second)


def test_workbook_from_an_office_program(spark, tmp_path):
    office_workbook(tmp_path / "book.xlsx")
    df = load(spark, str(tmp_path / "book.xlsx"))
    assert df.dtypes == [("num", "double"), ("day", "timestamp_ntz"), ("ok", "boolean"), ("word", "string")]
    assert [tuple(r) for r in df.collect()] == [(1.0, datetime(2024, 1, 1, 12), True, "two runs"), (2.5, None, None, None)]
    assert readers.load_excel(spark, str(tmp_path / "book.xlsx"), "Two").first().only == 9
    assert readers.load_excel(spark, str(tmp_path / "book.xlsx"), 1).dtypes == [("only", "bigint")]


def test_workbooks_of_a_folder(spark):
    df = spark.range(25).selectExpr("id", "concat('<&', id) AS w", "IF(id = 3, NULL, id / 2) AS x")
    books = excel.pack_workbooks(df.repartition(3))
    assert books.count() == 3
    assert sorted(map(tuple, excel.read_excel(books).collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_samples_have_their_shape(spark, churn):
    rows = churn.collect()
    assert len(rows) == 1000 and sum(r.total_charges is None for r in rows) == 20
    assert {r.churn for r in rows} == {0, 1}
    assert all(18 <= r.age <= 74 and 1 <= r.tenure_months <= 71 and 20 <= r.monthly_charge <= 120 for r in rows)
    assert all(1 <= r.num_products <= 5 and 0 <= r.support_calls <= 14 for r in rows)
    assert 0.1 < sum(r.churn for r in rows) / 1000 < 0.4

    paid = load_sample(spark, "fraud_detection").collect()
    assert len({r.transaction_id for r in paid}) == 1000 and len({r.merchant_category for r in paid}) == 8
    assert all(0.5 <= r.amount <= 5000 for r in paid)
    assert 60 < sum(r.amount for r in paid) / 1000 < 100

    sold = load_sample(spark, "sales_forecasting").collect()
    assert len(sold) == 500 and all(r.revenue > 0 for r in sold)
    assert [r.date for r in sold] == sorted(r.date for r in sold)
    assert all(r.product_id[:3] == r.category[:3].upper() for r in sold)
    with pytest.raises(ValueError, match="Unknown sample use case"):
        load_sample(spark, "nonexistent")


def test_samples_do_not_depend_on_partitions(spark):
    ids = spark.range(1, 401).select("id")
    for make in (samples.churn, samples.sales):
        one = sorted(map(str, make(ids.repartition(1)).collect()))
        many = sorted(map(str, make(ids.repartition(7), rows_per_task=30).collect()))
        assert one == many


def test_csv_quotes_and_line_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text,n\n1,"say ""hi"", ok",5\n2,"two\nlines",6\n')
    (tmp_path / "b.csv").write_text('id,text,n\n3,"plain",7\n')
    rows = readers.load_csv(spark, str(tmp_path)).orderBy("id").collect()
    assert [tuple(r) for r in rows] == [(1, 'say "hi", ok', 5), (2, "two\nlines", 6), (3, "plain", 7)]


def test_json_folder_of_both_kinds(spark, tmp_path):
    (tmp_path / "a.json").write_text("[\n" + ",\n".join(f'{{"id": {i}, "x": [1]}}' for i in range(100)) + "\n]")
    (tmp_path / "b.json").write_text("\n".join(f'{{"id": {i}}}' for i in range(100, 103)))
    got = readers.load_json(spark, str(tmp_path))
    assert got.columns == ["id", "x"] and sorted(r.id for r in got.collect()) == list(range(103))


def test_json_by_column(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"a": {"0": 1, "1": 2, "10": null}, "b": {"0": "x", "1": null, "10": "y"}}')
    got = readers.load_json(spark, str(tmp_path / "a.json"))
    assert got.dtypes == [("a", "bigint"), ("b", "string")]
    assert {tuple(r) for r in got.collect()} == {(1, "x"), (2, None), (None, "y")}


def test_excel_headings():
    assert excel.headings({0: "a", 1: "a", 3: "c"}) == {0: "a", 1: "a.1", 2: "Unnamed: 2", 3: "c"}


def test_equal_draws_still_leave_two_percent_without_total(spark, monkeypatch):
    even = lambda ids, salt, seed, names: ids.withColumns({n: samples.F.lit(0.5) for n in names})
    monkeypatch.setattr(samples, "uniforms", even)
    rows = samples.churn(spark.range(1, 101).select("id")).collect()
    assert [r.customer_id for r in rows if r.total_charges is None] == ["CUST-00001", "CUST-00002"]


def _in_pieces(spark, size):
    """Files are split into ranges of about so many bytes."""
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    spark.conf.set("spark.sql.files.openCostInBytes", "1")


def _as_usual(spark):
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def _quoted(value):
    return '"' + value.replace('"', '""') + '"'


@pytest.mark.parametrize("size", [173, 1 << 27])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_ranges_cut_the_same_records(spark, tmp_path, size, end):
    texts = ["plain", 'say "hi", ok', "two\nlines", "\n\n", ",\n,", "", 'a "" b\n"', "x" * 150 + "\n" + "y" * 200, "ü\r\nü"]
    rows = [(i, texts[i * 7 % len(texts)], i * 2) for i in range(120)]
    for f in ("a", "b"):
        body = [f"{i},{_quoted(t)},{n}" for i, t, n in rows]
        (tmp_path / f"{f}.csv").write_bytes(end.join(["id,text,n", *body, ""]).encode())
    try:
        _in_pieces(spark, size)
        df = readers.load_csv(spark, str(tmp_path))
        got = sorted(tuple(r) for r in df.select("id", F.coalesce("text", F.lit("")), "n").collect())
    finally:
        _as_usual(spark)
    assert got == sorted(rows * 2)


def test_sound_records():
    fine = ranges._sound(",")
    assert all(fine(r) for r in ["", "a,b", '"a,""b"",\n",c', '"",""', 'a,"b"\r', ',"x",'])
    assert not any(fine(r) for r in ['5" pipe,x', '"a"b,c', 'a,"b', '"a""'])


def test_one_csv_file_feeds_many_tasks(spark, tmp_path):
    lines = ["id,text"] + [f'{i},"a\n{i}"' if i == 500 else f"{i},t{i}" for i in range(4000)]
    (tmp_path / "a.csv").write_text("\n".join(lines) + "\n")
    try:
        _in_pieces(spark, 2000)
        df = readers.load_csv(spark, str(tmp_path / "a.csv"))
        tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
        assert tasks > 10 and df.count() == 4000 and df.where("id = 500").first().text == "a\n500"
    finally:
        _as_usual(spark)


def test_csv_files_that_cannot_be_cut_are_read_whole(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,text\n1,5" pipe\n2,"two\nlines"\n3,x\n')
    (tmp_path / "b.csv").write_text('id,text\n4,"b\nb"\n')
    (tmp_path / "c.csv").write_text('text,id\n"c\nc",5\n')
    rows = sorted(tuple(r) for r in readers.load_csv(spark, str(tmp_path)).select("id", "text").collect())
    assert rows == [(1, '5" pipe'), (2, "two\nlines"), (3, "x"), (4, "b\nb"), (5, "c\nc")]
    told = readers.load_csv(spark, str(tmp_path / "b.csv"), schema="id int, text string")
    assert told.dtypes == [("id", "int"), ("text", "string")] and told.first().text == "b\nb"
    (tmp_path / "d.csv").write_text('id;text\n6;"d\n;d"\n')
    assert readers.load_csv(spark, str(tmp_path / "d.csv"), sep=";").first().text == "d\n;d"


@pytest.mark.parametrize("size", [120, 700, 1 << 27])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_ranges_cut_the_same_records(spark, tmp_path, size, indent):
    words = ["plain", "}, {", 'q"uo"te', "back\\slash\\", "[{]}", "", "ü}\n", '\\"}']
    rows = [{"id": i, "text": words[i % 8], "deep": {"a": [{"b": words[(i + 3) % 8]}, {"b": "x" * (i % 90)}]}} for i in range(150)]
    (tmp_path / "a.json").write_text(json.dumps(rows, indent=indent, ensure_ascii=False))
    (tmp_path / "b.json").write_text(" " + json.dumps(rows[:3], indent=indent) + "\n\n")
    try:
        _in_pieces(spark, size)
        df = readers.load_json(spark, str(tmp_path))
        got = sorted((r.id, r.text, r.deep.asDict(True)["a"]) for r in df.collect())
        tasks = df.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        _as_usual(spark)
    assert got == sorted((r["id"], r["text"], r["deep"]["a"]) for r in rows + rows[:3])
    # records that lie in several ranges are put together in one task of each file
    assert size != 700 or tasks > 5


def test_json_arrays_that_cannot_be_cut(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, 7, {"id": 2}]')
    (tmp_path / "b.json").write_text('[{"id": 3}, {"id": 4}]')
    (tmp_path / "c.json").write_text('[{"id": 5}, {"id": 6')
    files = [str(tmp_path / f"{f}.json") for f in "abc"]
    found = ranges.json_records(spark, files, ranges.json_ranges(spark, files)).collect()
    torn = {r.file[-6:] for r in found if not r.sound}
    assert torn == {"a.json", "c.json"} and [r.value for r in found if "b.json" in r.file] == ['{"id": 3}', '{"id": 4}']
