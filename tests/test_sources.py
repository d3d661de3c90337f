"""Uploads in, tables out, streams that resume."""

import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlink.sources import tables as T
from ledgerlink.streaming import runs

SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="inlineStr"><is><t>Rapport</t></is></c></row><row r="2"/>
<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="inlineStr"><is><t>Country</t></is></c><c r="C3" t="inlineStr"><is><t>Country</t></is></c></row>
<row r="4"><c r="A4" t="inlineStr"><is><t>FR1</t></is></c><c r="C4"><v>7</v></c></row><row r="5"><c r="A5" t="inlineStr"><is><t>FR2</t></is></c><c r="B5"><v>8</v></c></row></sheetData></worksheet>"""
SHARED = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><r><t>VAT </t></r><r><t>Number</t></r></si></sst>'


def test_spreadsheet(spark, tmp_path):
    p = tmp_path / "a.xlsx"
    with zipfile.ZipFile(p, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", SHEET)
        z.writestr("xl/sharedStrings.xml", SHARED)
    df = T.read_upload(spark, str(p))
    assert df.columns == ["VAT Number", "Country", "Country (2)"]
    assert [tuple(r) for r in df.collect()] == [("FR1", None, "7"), ("FR2", "8", None)]


@pytest.mark.parametrize("text, sep", [("a;b\n1,5;2", ";"), ("a,b\n1,2", ","), ("a\tb", "\t"), ("FR_SIRET\n1", ","), ("a|b;c\n1|2", "|")])
def test_delimiters(text, sep):
    assert T.sniffed_delimiter(text) == sep


def test_delimited_text_and_refused_files(spark, tmp_path):
    p = tmp_path / "a.csv"
    p.write_text('﻿FR_SIRET;N\n"012";"a ""b"";c"\n', encoding="utf-8")
    df = T.read_upload(spark, str(p))
    assert [tuple(r) for r in df.collect()] == [("012", 'a "b";c')]
    with pytest.raises(ValueError):
        T.read_upload(spark, "x.xls")
    assert T.prepared(df, "N").first().FR_SIRET == 'a "b";c'
    out = str(tmp_path / "out")
    T.write_csv(df, out)
    assert '"012","a ""b"";c"' in "\n".join(r.value for r in spark.read.text(out).collect())


def test_stream_enriches_and_resumes(spark, tmp_path):
    registry = spark.createDataFrame([("1" * 14, "x")], "siret string, n string")
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    for n, expected in ((1, 1), (2, 2)):
        spark.createDataFrame([("1" * 14, n)], "k string, n int").coalesce(1).write.mode("append").parquet(src)
        q = runs.enrich_stream(spark.readStream.schema("k string, n int").parquet(src), registry, F.col("k"), out, cp)
        q.awaitTermination(60)
        got = spark.read.parquet(out)
        assert got.count() == expected and got.where("status = 'OK'").count() == expected
