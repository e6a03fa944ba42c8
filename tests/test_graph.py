from __future__ import annotations

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from ledgermesh.operators import graph as g
from ledgermesh.operators import merge
from ledgermesh.schemas import RELATIONSHIPS


def strings(columns):
    return ", ".join(f"{c} string" for c in columns)


def graph(spark, companies, people, edges):
    blank = ["", "", "", "", ""]
    return g.Graph(
        spark.createDataFrame([(t, *blank) for t in companies], strings(g.COMPANY_FIELDS)),
        spark.createDataFrame([(q, n) for q, n in people], "person_id string, person_name string"),
        spark.createDataFrame([(q, t, "CEO_OF", "CEO", "EXECUTIVE", "") for q, t in edges], strings([*g.EDGE_KEY, "extraction_time"])),
    )


def rel(spark, *rows):
    return spark.createDataFrame([(t, "", q, "", role, cat, "") for t, q, role, cat in rows], RELATIONSHIPS)


def test_edge_types(spark):
    rows = rel(
        spark, ("A", "p1", "CEO", "EXECUTIVE"), ("B", "p2", "CFO", "EXECUTIVE"), ("C", "p3", "Executive Chairman", "BOARD"),
        ("D", "p4", "Director", "BOARD"), ("E", "p5", "Chief Operating Officer", "EXECUTIVE"), ("F", "p6", "Advisor", "ADVISOR"),
    )
    kinds = {r.ticker: r.relationship_type for r in g.build_edges(rows).collect()}
    assert kinds == {"A": "CEO_OF", "B": "CFO_OF", "C": "CHAIRMAN_OF", "D": "BOARD_OF", "E": "EXECUTIVE_OF"}
    assert [r.ticker for r in g.bad_categories(rows).collect()] == ["F"]
    counts = {r.relationship_type: r.edge_count for r in g.counts_by_type(g.build_edges(rows)).collect()}
    assert set(counts.values()) == {1} and len(counts) == 5


def test_isolated_nodes_stay(spark):
    found = graph(spark, ["NVDA", "GSBC"], [("JENSEN_HUANG", "Jensen Huang"), ("ISOLATED_PERSON", "")], [("JENSEN_HUANG", "NVDA")])
    nodes, edges = g.full_graph(found)
    assert {(r.id, r.label) for r in nodes.collect()} == {
        ("company:NVDA", "NVDA"), ("company:GSBC", "GSBC"), ("person:JENSEN_HUANG", "Jensen Huang"),
        ("person:ISOLATED_PERSON", "ISOLATED_PERSON"),
    }
    (edge,) = edges.collect()
    raw = "\x1f".join(["JENSEN_HUANG", "NVDA", "CEO_OF", "CEO", "EXECUTIVE"])
    assert edge.id == "edge:" + hashlib.sha256(raw.encode()).hexdigest()
    lines = [json.loads(r.document) for r in g.graph_document(nodes, edges).filter("element = 'edge'").collect()]
    assert lines[0]["data"]["source"] == "person:JENSEN_HUANG"


def test_radius(spark):
    found = graph(spark, ["NVDA", "AMD", "AAPL"], [], [("CEO_ONLY", "NVDA"), ("SHARED", "NVDA"), ("SHARED", "AMD")])
    one = {(r.person_id, r.ticker) for r in g.company_graph(found, "nvda", 1).collect()}
    two = {(r.person_id, r.ticker) for r in g.company_graph(found, "nvda", 2).collect()}
    assert one < two and two - one == {("SHARED", "AMD")} and ("CEO_ONLY", "NVDA") in two
    found = graph(spark, [], [], [("JH", "NVDA"), ("JH", "AAPL"), ("OTHER", "NVDA")])
    assert {r.person_id for r in g.person_graph(found, "JH", 1).collect()} == {"JH"}
    assert {r.person_id for r in g.person_graph(found, "JH", 2).collect()} == {"JH", "OTHER"}
    assert {r.person_id for r in g.cross_company(found).collect()} == {"JH"}
    for radius in (0, 3):
        with pytest.raises(ValueError):
            g.company_graph(found, "NVDA", radius)


def test_checks(spark):
    people = spark.createDataFrame([("p1", ""), ("p1", ""), (" ", ""), (None, "")], "person_id string, person_name string")
    found = [(r.check, r.value, r.row_count) for r in g.check_people(people).orderBy("check", "value").collect()]
    assert found == [("blank_person_id", "", 1), ("blank_person_id", " ", 1), ("duplicate_person_id", "p1", 2)]
    assert [r.ticker for r in merge.duplicate_keys(spark.createDataFrame([("ACME",), ("ACME",), ("B",)], "ticker string"), ["ticker"]).collect()] == ["ACME"]
    rows = rel(spark, ("MISSING", "p1", "CEO", "EXECUTIVE"), ("ACME", "gone", "CEO", "EXECUTIVE"))
    companies = spark.createDataFrame([("ACME",)], "ticker string")
    orphans = g.orphan_edges(rows, companies, people.select("person_id"))
    assert {(r.ticker, r.missing) for r in orphans.collect()} == {("MISSING", "company"), ("ACME", "person")}


def test_same_identity_merges(spark):
    base = graph(spark, ["A"], [("p", "")], [("p", "A")]).edges
    late = base.withColumn("extraction_time", F.lit("2030")).withColumn("seq", F.lit(1))
    (row,) = g.merge_edges(base, late, "seq").collect()
    assert row.extraction_time == "2030"


def test_company_fields(spark):
    df = spark.createDataFrame([("A", "n", "u", None, "", "long", "short")], "ticker string, company_name string, universe string, sector string, industry string, description string, description_short string")
    row = g.graph_companies(df).first().asDict()
    assert row["sector"] == "" and "description" not in row


def test_search_and_filters(spark):
    found = graph(spark, ["NV", "NVDA", "ANV"], [("NVA", "Nina Vale"), ("X_NV", None)], [("NVA", "NVDA")])
    assert [(r.id, r.rank) for r in g.search(found, " nv ").collect()] == [
        ("company:NV", 0), ("company:NVDA", 1), ("person:NVA", 3), ("person:X_NV", 3),
    ]
    assert g.search(found, " ").count() == 0
    nodes, edges = g.full_graph(found)
    near, links = g.neighborhood(nodes, edges, "company:NVDA")
    assert {r.id for r in near.collect()} == {"company:NVDA", "person:NVA"} and links.count() == 1
    assert g.filter_graph(nodes, edges, ["Person"])[1].count() == 0
