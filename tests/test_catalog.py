"""Registered queries against their check SQL, on the smallest data.

By default every query is built, its staged tables with it, and a sample of every module
is run and compared; ``CATALOG=all`` compares every query.
"""

from __future__ import annotations

import os
from concurrent.futures import ThreadPoolExecutor

import pytest

from ledgermesh.plans import catalog
from ledgermesh.plans.bindings import TABLES
from ledgermesh.sinks import files

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not there")


NAMES = sorted(catalog.queries()) if os.environ.get("CATALOG") == "all" else [
    "strongest_company_pairs", "normalize_summary", "derive_people", "top_edge_evidence_json", "projection_summary",
    "component_report", "threshold_retention", "topk_retention", "market_snapshot", "upsert_prices", "merge_snapshot",
    "incremental_price_load", "company_master", "company_batches", "graph_reconciliation", "graph_document_lines",
    "search_name", "answer_status", "upsert_raw", "response_usage", "holdings_tickers", "workbook_rows",
    "name_rejections", "signature_edges", "item10_edges", "parse_log",
]


@pytest.fixture(scope="module")
def database():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"create view {name} as select * from '{FOLDER}/{name}.parquet'")
    return con


def lines(columns, rows):
    order = sorted(range(len(columns)), key=lambda k: columns[k])

    def text(value):
        return f"{value:.9g}" if isinstance(value, float) else str(value)

    return sorted("|".join(text(row[k]) for k in order) for row in rows)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    df = catalog.queries()[name](spark, FOLDER)
    rows = df.collect()
    check = catalog.check_sql().get(name)
    if check is None:
        return
    result = database.execute(check)
    columns = [d[0] for d in result.description]
    assert sorted(df.columns) == sorted(columns)
    assert lines(df.columns, rows) == lines(columns, result.fetchall())


def test_every_query_builds(spark):
    """No query breaks unseen: its code runs, and its plan is resolved against the tables."""
    found = catalog.queries()

    def broken(name: str) -> str | None:
        try:
            return None if found[name](spark, FOLDER).columns else f"{name}: no columns"
        except Exception as error:  # told for all queries at once
            return f"{name}: {str(error)[:300]}"

    with ThreadPoolExecutor(6) as pool:
        assert [e for e in pool.map(broken, sorted(set(found) - set(NAMES))) if e] == []


def test_report_files(spark, tmp_path):
    from ledgermesh.plans.bindings import Inputs
    from ledgermesh.plans.people_queries import relationships

    files.write_reports(relationships(Inputs(spark, FOLDER)), str(tmp_path), complete=True)
    assert len([p for p in tmp_path.iterdir() if p.is_dir()]) == 12
    top = spark.read.csv(f"{tmp_path}/top_company_edges", header=True, escape='"')
    weights = [int(r.shared_person_count) for r in top.collect()]
    assert weights == sorted(weights, reverse=True)


def test_replace_reads_its_own_table(spark, tmp_path):
    path = str(tmp_path / "t")
    files.replace_table(spark.range(3), path)
    files.replace_table(spark.read.parquet(path).filter("id > 0"), path)
    assert spark.read.parquet(path).count() == 2
    files.export_csv(spark.range(5).selectExpr("5 - id as k", "id as v"), f"{path}-csv", ["v", "k"], ["k"])
    exported = spark.read.csv(f"{path}-csv", header=True)
    assert exported.columns == ["v", "k"] and [r.k for r in exported.collect()] == ["1", "2", "3", "4", "5"]
