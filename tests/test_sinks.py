"""Tables, appends and output sets, read back and compared."""

from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from ledgermesh.operators import answers, filings
from ledgermesh.operators import projection as p
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.people_queries import relationships
from ledgermesh.sinks import files
from ledgermesh.sources import tables

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not there")


def ids(df):
    return sorted(r.id for r in df.collect())


def failing(spark):
    return spark.range(10).select(F.when(F.col("id") == 7, F.raise_error(F.lit("broken"))).otherwise(F.col("id")).alias("id"))


def test_published_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        files.read_published(spark, root)
    assert files.publish(spark.range(3), root) == 1 and ids(files.read_published(spark, root)) == [0, 1, 2]
    held = files.read_published(spark, root)
    assert files.publish(files.read_published(spark, root).filter("id > 0"), root) == 2
    assert ids(files.read_published(spark, root)) == [1, 2] and ids(held) == [0, 1, 2]
    with pytest.raises(Exception, match="broken"):  # fails while the version is written
        files.publish(failing(spark), root)
    assert ids(files.read_published(spark, root)) == [1, 2]
    assert files.publish(spark.range(5), root) > 2 and ids(files.read_published(spark, root)) == [0, 1, 2, 3, 4]


def test_a_failure_before_the_pointer_leaves_the_old_version(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "t")
    files.publish(spark.range(3), root)
    with monkeypatch.context() as broken:
        broken.setattr(files, "_write_small", lambda *_: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            files.publish(spark.range(9), root)
    assert ids(files.read_published(spark, root)) == [0, 1, 2]
    files.publish(spark.range(1), root)
    assert ids(files.read_published(spark, root)) == [0]


@pytest.mark.parametrize("fails_at", [1, 2])
def test_a_broken_replacement_is_made_good(spark, tmp_path, monkeypatch, fails_at):
    path, calls, rename = str(tmp_path / "t"), [], files._rename
    files.replace_table(spark.range(3), path)
    with pytest.raises(Exception, match="broken"):
        files.replace_table(failing(spark), path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2]

    def breaks(*args):
        calls.append(args)
        return 1 / 0 if len(calls) == fails_at else rename(*args)

    with monkeypatch.context() as broken:
        broken.setattr(files, "_rename", breaks)
        with pytest.raises(ZeroDivisionError):
            files.replace_table(spark.range(9), path)
    files.recover_table(spark, path)
    assert ids(spark.read.parquet(path)) == [0, 1, 2]
    files.replace_table(spark.read.parquet(path).filter("id > 1"), path)
    assert ids(spark.read.parquet(path)) == [2] and [d.name for d in tmp_path.iterdir()] == ["t"]


def test_missing_companies_are_appended(spark, tmp_path):
    path = str(tmp_path / "missing")
    body = '{"companies":[{"ticker":"QZLM","relationships":[]}]}'
    for batch, asked in (("b1", ["QZLM", "VRTN"]), ("b2", ["HLXW", "QZLM", "ORCK"])):
        df = spark.createDataFrame([(batch, asked, body)], "batch_id string, tickers array<string>, raw_response string")
        files.append_missing(answers.missing_rows(answers.answer_status(df), "2024-01-01"), path)
    got = sorted(tuple(r) for r in tables.read_csv_table(spark, path, ["ticker", "batch_id"]).collect())
    assert got == [(t, b, "missing_from_response", "2024-01-01") for t, b in (("HLXW", "b2"), ("ORCK", "b2"), ("VRTN", "b1"))]


def manifest(folder) -> dict:
    return json.loads((folder / "manifest.json").read_text())


@needs_data
def test_reports_hold_what_the_operators_give(spark, tmp_path):
    rel = relationships(Inputs(spark, FOLDER))
    files.write_reports(rel, str(tmp_path), top=(5, 6, 7), complete=True)
    pairs = p.person_companies(rel)
    edges, names, degrees = p.projection(pairs), p.company_names(rel), p.person_degrees(pairs)
    distribution, labels = p.company_distribution(edges, names), p.projection_components(pairs)
    expected = {
        "shared_person_distribution": p.shared_distribution(edges), "person_degree_distribution": p.degree_buckets(degrees),
        "top_people_by_company_degree": p.top_people(degrees, pairs, rel, 5), "company_degree_distribution": distribution,
        "top_companies_by_projected_degree": p.top_companies(distribution, 6), "top_company_edges": p.top_edges(edges, rel, 7),
        "connected_components": p.component_report(edges, labels), "threshold_simulation": p.threshold_report(edges, names),
        "topk_simulation": p.topk_report(edges, names), "complete_company_projection": edges,
    }
    told = manifest(tmp_path)
    assert set(told) == {*expected, "summary", "projection_concentration"}
    for name, df in expected.items():
        read = spark.read.csv(str(tmp_path / name), header=True, escape='"')
        rows = sorted(str([None if v is None else str(v) for v in r]) for r in df.select([F.col(c).cast("string") for c in df.columns]).collect())
        assert read.columns == df.columns == told[name]["columns"] and told[name]["rows"] == len(rows)
        assert sorted(str([v if v is None else str(v) for v in r]) for r in read.collect()) == rows
    (summary,) = spark.read.json(str(tmp_path / "summary")).collect()
    (row,) = p.projection_summary(rel, pairs, edges, distribution, labels).collect()
    assert {k: v for k, v in row.asDict().items() if isinstance(v, int)}.items() <= summary.asDict().items()


def test_filing_outputs(spark, tmp_path):
    companies = spark.createDataFrame([("QZLM", "7", "Quartz Loom"), ("VRTN", None, "Verdant")], "ticker string, cik string, company_name string")
    filed = spark.createDataFrame([("QZLM", "Quartz Loom", "2024-02-01", "u")], "ticker string, company_name string, filing_date string, filing_url string")
    found = spark.createDataFrame(
        [("QZLM", "Mira Okafor", "CEO_OF", "signature_table", [0]), ("QZLM", "Ivo Brandt", "BOARD_OF", "signature_table", [1]),
         ("QZLM", "Annual Report", "BOARD_OF", "item_10", [2])],
        "doc_id string, name string, relationship_type string, source string, pos array<int>",
    )
    edges = filings.unique_edges(filings.filing_edges(filed, found))
    log = filings.parse_log(companies, companies, filed, filings.source_counts(found, found, found.filter("source = 'item_10'")))
    files.write_filing_outputs(companies, edges, log, str(tmp_path))

    def read(name):
        return spark.read.csv(str(tmp_path / name), header=True, escape='"')

    told = manifest(tmp_path)
    assert {k: v["rows"] for k, v in told.items()} == {"company_nodes": 2, "person_nodes": 2, "edges": 2, "parse_log": 2}
    assert all(read(k).columns == v["columns"] for k, v in told.items())
    assert [(r.source_person, r.relationship_type, r.ticker) for r in read("edges").collect()] == [
        ("Ivo Brandt", "BOARD_OF", "QZLM"), ("Mira Okafor", "CEO_OF", "QZLM")]
    assert sorted(r.name for r in read("person_nodes").collect()) == ["Ivo Brandt", "Mira Okafor"]
    assert {r.source_node_id for r in read("edges").collect()} == {r.node_id for r in read("person_nodes").collect()}
    assert [(r.node_id, r.cik) for r in read("company_nodes").collect()] == [("company:QZLM", "7"), ("company:VRTN", None)]
    assert [(r.ticker, r.status, r.reason) for r in read("parse_log").collect()] == [("QZLM", "success", None), ("VRTN", "failed", "cik_not_found")]
