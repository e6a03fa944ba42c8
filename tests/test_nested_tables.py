"""Tables inside tables, attributes with brackets, and entities."""

from __future__ import annotations

import html as library
import time

import pytest
from pyspark.sql import functions as F

from ledgermesh.operators import extraction as x
from ledgermesh.sources import html as w

LAYOUT = (
    "<table><tr><td>Outer A<table class='x>y'><tr><td>in 1</td><td>in 2</td></tr></table></td><td>Title</td></tr>"
    "<tr><td>Z</td></tr></table><p title=\"a>b\">after</p><TABLE><TR><TH>H<TH>I<TR><TD>open"
)


def rows(spark, html):
    found = w.html_table_rows(spark.createDataFrame([(1, html)], "doc_id int, html string"))
    return [(r.table_no, r.cells) for r in found.orderBy("table_no", "row_no").collect()]


def test_each_table_ends_at_its_own_tag(spark):
    assert rows(spark, LAYOUT) == [
        (0, ["Outer A in 1 in 2", "in 1", "in 2", "Title"]), (0, ["in 1", "in 2"]), (0, ["Z"]), (1, ["in 1", "in 2"]),
        (2, ["H", "I"]), (2, ["open"]),
    ]
    starts = w.html_tables(spark.createDataFrame([(1, LAYOUT)], "doc_id int, html string")).orderBy("table_no").collect()
    marked = spark.createDataFrame([(LAYOUT,)], "h string").select(w.with_levels(F.col("h")).alias("m")).first().m
    assert [marked[t.start : t.start + len(t.markup)] for t in starts] == [t.markup for t in starts]


@pytest.mark.parametrize("depth", [1, 5])
def test_depth(spark, depth):
    html = "<table><tr><td>a" * depth + "</td></tr></table>" * depth
    assert len({t for t, _ in rows(spark, html)}) == depth
    assert rows(spark, html)[-1] == (depth - 1, ["a"])


def test_documents_without_tables(spark):
    assert rows(spark, "<p>none</p></table>") == [] and rows(spark, "") == []
    assert rows(spark, "</table></table><table><tr><td>x</td></tr></table>") == [(0, ["x"])]


def test_text_without_tags(spark):
    text = "M&uuml;ller &euro;5 &hellip; &#0000000038; &amp;lt; &bogus; &#x1F600; AT&T &copy; a & b"
    got = spark.createDataFrame([(text, LAYOUT)], "t string, h string").select(w.decode_entities(F.col("t")).alias("t"), w.html_text(F.col("h")).alias("h")).first()
    assert got.t == library.unescape(text)
    assert got.h == "Outer A in 1 in 2 Title Z after H I open"


def test_signature_table_inside_a_layout_table(spark):
    anchor = "Pursuant to the requirements of the Securities Exchange Act of 1934, this report has been signed"
    before = "<table><tr><td>/s/ Wilma Prior</td><td>Chief Executive Officer</td></tr></table>"
    signed = "<table><tr><td>/s/ Hanna Berg</td><td>Chief Financial Officer</td></tr></table>"
    html = f"<html><body>{before}<h1>SIGNATURES</h1><table><tr><td>{anchor}</td></tr><tr><td>{signed}</td></tr></table></body></html>"
    inner = f"<p>{anchor}</p><table><tr><td><table><tr><td>note</td></tr></table></td></tr><tr><td>/s/ Otto Lang</td><td>Director</td></tr></table>"
    docs = spark.createDataFrame([(1, html), (2, inner)], "doc_id int, html string")
    found = x.signature_table_edges(x.signature_tables(docs)).select("doc_id", "name").distinct().collect()
    assert sorted((r.doc_id, r.name) for r in found) == [(1, "Hanna Berg"), (2, "Otto Lang")]


def test_nested_rows_cost_no_more_than_flat_ones():
    """Many rows inside a layout table, deep nesting and open tags are read in one pass."""
    flat = "<table>" + "<tr><td>a</td><td>b</td></tr>" * 2000 + "</table>"
    nested = f"<table><tr><td>{flat}</td></tr></table>"
    for html, rows in ((flat, 2000), (nested, 2001), ("<table><tr><td>" * 40, 40), ("<table>" + "<tr><td>x" * 5000, 5000)):
        began = time.perf_counter()
        markup, tags = w._levelled(html)
        tables = w._tables(markup, tags)
        assert len(tables[0]["rows"]) == rows and time.perf_counter() - began < 1
    assert [len(t["rows"]) for t in w._tables(*w._levelled(nested))] == [2001, 2000]
