"""Notices in other spellings count by their share, whatever words are rare in the table."""

from plumbline.llm.license_scan import scan_licenses


def test_other_spellings_of_notices(spark):
    apache = "Licensed under the Apache License, v2.0"
    mit = "Permission is hereby granted, free of charge, to everybody who gets a copy of this software"
    common = ["the licensed under license is to a copy of this software permission free charge granted"] * 30
    df = spark.createDataFrame([(t,) for t in [apache, mit, "the apache license", *common]], "text string")
    got = {r.text: (r.labels, r.score) for r in scan_licenses(df).select("row.text", "labels", "score").collect()}
    assert got[apache] == ("apache-2.0", 5 / 8)
    assert got[mit][0] == "mit-text" and got[mit][1] >= 0.6
    assert got["the apache license"] == ("", 0.0) and got[common[0]] == ("", 0.0)
