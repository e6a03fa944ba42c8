"""Long and awkward input: one cell, line or word of a million characters, quotes, blanks, other separators."""

from __future__ import annotations

import csv
import io

import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import names as n
from ledgermesh.functions import text as t
from ledgermesh.operators import answers
from ledgermesh.sinks import files
from ledgermesh.sources import holdings as h
from ledgermesh.sources import tables

LONG = 1_000_000


def value(spark, text, expression):
    return spark.createDataFrame([(text,)], "c string").select(expression(F.col("c")).alias("v")).first().v


def test_long_csv_cells(spark):
    cell = "x," * (LONG // 2)
    assert value(spark, f'a,"{cell}",b', h.csv_cells) == ["a", cell, "b"]
    assert value(spark, '"' + '""' * (LONG // 2) + '",b', h.csv_cells) == ['"' * (LONG // 2), "b"]
    assert len(value(spark, ",".join("ab" * (LONG // 4)), h.csv_cells)) == LONG // 2


@pytest.mark.parametrize("line", [
    ",AAPL,Apple,Equity", "", ",", "a,,", '"",x', '"a ""b"" c",d', '"a\nb",c', 'a"b,c', '"a"b,c', ",,x", '"x, y","z"', " a , b ",
])
def test_csv_cells_as_a_csv_reader_has_them(spark, line):
    assert value(spark, line, h.csv_cells) == (next(csv.reader(io.StringIO(line, newline=""))) if line else [""])


def test_other_separators(spark):
    assert value(spark, 'a;"b;c";d,e', lambda c: h.csv_cells(c, ";")) == ["a", "b;c", "d,e"]
    assert value(spark, "a\tb|c\t", lambda c: h.csv_cells(c, "\t")) == ["a", "b|c", ""]
    assert value(spark, "a|b.c", lambda c: h.csv_cells(c, "|")) == ["a", "b.c"]
    with pytest.raises(ValueError, match="separator"):
        h.csv_cells(F.lit("a"), '"')


@pytest.mark.parametrize("text,records", [
    ('a,"b\nc",d\r\ne\n', ['a,"b\nc",d', "e", ""]), ("a\nb", ["a", "b"]), ("", [""]), ('5" pipe\nnext "one"\n', ['5" pipe', 'next "one"', ""]),
    ('x\r\r\n"q ""\n"" r"', ["x", "", '"q ""\n"" r"']),
])
def test_records_keep_quoted_line_breaks(spark, text, records):
    assert value(spark, text, h.csv_records) == records


def test_holdings_file_with_a_blank_first_column(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text('Report\n\n,Ticker,Name,Asset Class\n,AAPL,"Apple\nInc",Equity\n,USD,Cash,Cash\n')
    rows = h.read_preamble_csv(h.text_lines(spark, str(path)), "Ticker")
    found = h.holdings_tickers(rows, ["ticker", "name", "asset class"], ["ticker"])
    assert [r.ticker for r in found.collect()] == ["AAPL"]


def test_header_beyond_the_first_rows(spark):
    rows = spark.createDataFrame([("f", k, ["note"]) for k in range(30)] + [("f", 30, ["Ticker"]), ("f", 31, ["AAPL"])], "file string, idx int, cells array<string>")
    assert h.promote_header(rows, ["ticker"]).count() == 0
    assert [r.cells for r in h.promote_header(rows, ["ticker"], header_rows=None).collect()] == [["AAPL"]]


def test_interchange_files_round_trip(spark, tmp_path):
    rows = [("1", 'a\nb "q", c'), ("2", "\r\nx"), ("3", "plain")]
    files.export_csv(spark.createDataFrame(rows, "k string, v string"), str(tmp_path / "t"), ["k", "v"], ["k"])
    read = tables.read_csv_table(spark, str(tmp_path / "t"), ["k", "v"])
    assert sorted((r.k, r.v.replace("\r\n", "\n")) for r in read.collect()) == [(k, v.replace("\r\n", "\n")) for k, v in rows]


def test_long_json_strings(spark):
    text = '{"a": "' + "x\\\\" * (LONG // 3) + '", "b": "https://h.org/' + "y" * LONG + '", "c": "https://h.org/z"}'
    urls = value(spark, text, lambda c: t.extract_urls(c, "https://h.org"))
    assert [len(u) for u in urls] == [14 + LONG, 15]


@pytest.mark.parametrize("unit", ["Word ", "Dr. ", "Jr. ", "AbC", "ab_cd", "chief ", "x", ". ", "Ann Lee Director "])
def test_long_lines_as_names(spark, unit):
    line = (unit * (LONG // len(unit))).strip()
    got = spark.createDataFrame([(line,)], "c string").select(
        n.normalize_name(F.col("c")).alias("a"), n.signature_name(F.col("c")).alias("b"), n.signature_candidate(F.col("c")).alias("d"),
        n.name_rejection_reason(F.col("c")).alias("e"), n.canonical_name(F.col("c")).alias("f"), t.person_id_for(F.col("c")).alias("g"),
    ).first()
    assert got.d == "" or unit.startswith("Ann")


@pytest.mark.parametrize("line,name", [
    ("Ann Lee Ann Lee", "Ann Lee"), ("Ann Lee Ann Lee Treasurer Chief", "Ann Lee Ann Lee Treasurer"), ("Ann B. Lee Chief of Staff", "Ann B Lee"), ("Ann Director Lee", "Ann"),
    ("ANN LEE", "Ann Lee"), ("Ann", "Ann"), ("Ann Lee Chairperson", "Ann Lee"), ("Ann Lee Chiefs", "Ann Lee Chiefs"), ("", ""),
])
def test_signer_names(spark, line, name):
    assert value(spark, line, n.signature_name) == name


def test_answers_are_read_by_path(spark):
    good = '{"ticker":"A","notes":{"relationships":"x","companies":1},"relationships":[{"person_name":"Ann Lee","role":"Director","role_category":"BOARD"}]}'
    bodies = {
        "plain": f'{{"companies":[{good}],"meta":{{"companies":"none","relationships":3}}}}', "none": '{"other":{"companies":7}}', "text": '{"companies":"none"}',
        "bad": '{"companies":[{"ticker":"A","relationships":"x"}]}', "numbers": '{"companies":[1]}', "empty": '{"companies":[]}',
        "null": '{"companies":[{"ticker":"A","relationships":null}]}',
    }
    df = spark.createDataFrame(list(bodies.items()), "batch_id string, raw_response string")
    assert [r.person_name for r in answers.parse_answers(df).collect()] == ["Ann Lee"]
    outcome = answers._payload(df).select("batch_id", answers._outcome().alias("o")).collect()
    assert {r.batch_id for r in outcome if r.o == "parse_exception"} == {"text", "bad", "numbers", "null"}
