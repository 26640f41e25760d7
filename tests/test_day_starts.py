"""Texts are read as days only where they begin like one."""

from plumbline.functions.fields import clean
from plumbline.operators import columns


def test_only_columns_with_day_starts_are_read_as_days(spark, monkeypatch):
    read, plain = [], columns.day_texts
    monkeypatch.setattr(columns, "day_texts", lambda f: [read.append(f.name), plain(f)][1])
    rows = [
        ("O", "2024-02-03", "2024-02-03", "March 5, 2023", "13/02/2024", "31.04.2024", None, "Mary went 1-2", 1),
        ("F", "2023-12-31T10:30:00+05:30", "no day", "7-Jan-2021", "02/03/2024", "x", None, "20240101", 2),
        ("1-URGENT", "2024-02-03", None, None, None, "4 DECades", None, "sub-may 1-Mai", 3),
    ]
    names = "flag string, iso string, mixed string, named string, small string, none string, empty string, begins string, n int"
    given = clean({"t": spark.createDataFrame(rows, names)})
    got = {r.column: r for r in columns.column_sums(given).collect()}
    assert set(read) == {"iso", "mixed", "named", "small", "none", "begins"}
    assert [r.date_like for r in map(got.get, ("flag", "iso", "mixed", "named", "small", "none", "empty", "begins", "n"))] == [
        False, True, False, False, True, False, False, False, False
    ]
    assert (got["iso"].date_min, got["iso"].date_max) == ("2023-12-31 05:00:00", "2024-02-03 00:00:00")
    assert (got["small"].date_min, got["small"].date_max) == ("2024-02-13 00:00:00", "2024-03-02 00:00:00")
    assert got["mixed"].date_min == got["mixed"].date_max == "2024-02-03 00:00:00"
    assert (got["named"].date_min, got["named"].date_max) == ("2021-01-07 00:00:00", "2023-03-05 00:00:00")
    assert got["begins"].date_min == "2024-01-01 00:00:00"
    assert got["none"].date_min is got["flag"].date_min is got["empty"].date_min is None
    assert got["flag"].avg_length == 10 / 3 and got["flag"].n_total == 3
