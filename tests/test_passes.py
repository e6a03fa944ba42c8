"""Costly parsing is spread over all tasks and done once."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.operators import canonical as c
from ledgermesh.operators import extraction as x
from ledgermesh.operators import graph as g
from ledgermesh.plans import catalog
from ledgermesh.session import spread, stage
from ledgermesh.sources import holdings as h
from ledgermesh.sources import html as w


def staged(df, label):
    return any(f"/{label}-" in path for path in df.inputFiles())


def test_few_rows_of_one_task_are_spread(spark):
    rows = spark.range(40).select(F.when(F.col("id") > 3, F.col("id")).alias("k")).coalesce(1)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = spread(rows).withColumn("task", F.spark_partition_id()).collect()
    assert len({r.task for r in dealt}) == tasks and len(dealt) == 40
    assert sorted(r.k or 0 for r in dealt) == [0, 0, 0, 0, *range(4, 40)]


def test_documents_of_small_tables_are_parsed_in_all_tasks(spark, tmp_path, capsys):
    part = spark.range(6).selectExpr("id as p_partkey", "'red blue' as p_name", "'B' as p_brand", "'STEEL' as p_type")
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    for name in ("executive_officers", "executives_from_text", "board_tables"):
        df = catalog.queries()[name](spark, str(tmp_path))
        df.explain()
        assert "RoundRobinPartitioning(" in capsys.readouterr().out, name
        assert {r.doc_id for r in df.collect()} == ({1, 2, 3, 5} if name == "board_tables" else set(range(6)))


def test_tables_of_constituents_are_parsed_once(spark):
    page = "<table><tr><th>Symbol</th></tr><tr><td>{0}</td></tr></table>"
    rows = [(1, page.format("a.b")), (1, page.format("c")), (2, page.format("--") + page.format("d")), (None, page.format("e"))]
    found = w.constituents_from_html(spark.createDataFrame(rows, "doc_id int, html string"))
    assert sorted(map(tuple, found.collect())) == [(1, "A-B"), (1, "C"), (2, "D")]
    assert staged(found, "table-tickers")


def test_sheets_are_parsed_once(spark):
    sheet = "<Workbook><Worksheet><Table><Row><Cell><Data>Ticker</Data></Cell><Cell><Data>n</Data></Cell></Row><Row><Cell><Data>x</Data></Cell></Row></Table></Worksheet></Workbook>"
    found = h.read_sheet_rows(spark.createDataFrame([(1, sheet), (2, None)], "file int, xml string"))
    assert sorted(map(tuple, found.collect())) == [(1, 0, ["Ticker", "n"]), (1, 1, ["x", ""])]
    assert staged(found, "sheet-rows")


def test_officers_search_the_text_once(spark, tmp_path, capsys):
    both = "Anna Stone, Chief Executive Officer; later Anna Stone, Chief Financial Officer."
    two = "Anna Stone, Chief Executive Officer; later Carl Reed, Chief Financial Officer."
    rows = [(1, both), (2, two), (3, "Carl Reed, Chief Financial Officer."), (None, both)]
    spark.createDataFrame(rows, "doc_id int, text string").coalesce(1).write.parquet(f"{tmp_path}/texts")
    found = x.officers(spark.read.parquet(f"{tmp_path}/texts"))
    found.explain()
    assert capsys.readouterr().out.count("FileScan") == 1
    assert sorted(((r.doc_id or 0), r.name, r.relationship_type) for r in found.collect()) == [
        (0, "Anna Stone", "CEO_OF"), (0, "Anna Stone", "CFO_OF"), (1, "Anna Stone", "CEO_OF"),
        (2, "Anna Stone", "CEO_OF"), (2, "Carl Reed", "CFO_OF"), (3, "Carl Reed", "CFO_OF"),
    ]


def test_sections_and_signature_tables_are_cut_out_once(spark, monkeypatch):
    page = "<h1>SIGNATURES</h1><table><tr><td>Orla Finch</td><td>signature, Director</td></tr></table>"
    texts = x.filing_texts(spark.createDataFrame([(1, page)], "doc_id int, html string"))
    assert staged(x.item10_edges(texts), "item10-scope")
    written = []
    monkeypatch.setattr(x, "stage", lambda df, label: written.append(label) or stage(df, label))
    signed = x.signature_edges(texts)
    assert "signature-tables" in written
    assert [(r.doc_id, r.name, r.relationship_type) for r in signed.collect()] == [(1, "Orla Finch", "BOARD_OF")]


def test_merges_read_relationships_once(spark):
    folder = "/root/testdata/sf0.001"
    assert staged(catalog.queries()["merge_edges"](spark, folder), "relationships")
    assert staged(catalog.queries()["merge_nodes"](spark, folder), "people")


def test_only_kept_rows_are_cleaned(spark):
    folder = "/root/testdata/sf0.001"
    for name in ("typed_edges", "edge_counts_by_type"):
        assert staged(catalog.queries()[name](spark, folder), "kept"), name


def test_relationship_types_are_told_by_the_category_first(spark, capsys):
    values = [None, "", " ", "CEO", "CFO", "Chairman", "Director", "BOARD", "EXECUTIVE", "ADVISOR"]
    pairs = spark.createDataFrame([(r, k) for r in values for k in values], "role string, role_category string")
    role, category = F.col("role"), F.col("role_category")
    said, typed = t.has_relationship_type(role, category), t.relationship_type(role, category).isNotNull()
    assert pairs.filter(F.coalesce(said, F.lit(False)) != typed).count() == 0
    rel = pairs.withColumns({n: F.lit("x") for n in ("person_id", "ticker", "extraction_time")})
    edges = g.build_edges(rel)
    assert edges.count() == pairs.filter(typed).count()
    edges.explain()
    assert "isnotnull(CASE" not in capsys.readouterr().out


def test_summary_reads_raw_rows_and_snapshot_once(spark):
    files = catalog.queries()["normalize_summary"](spark, "/root/testdata/sf0.001").inputFiles()
    assert not [path for path in files if path.startswith("file:///root/testdata/")]


def test_normalize_takes_a_written_snapshot(spark):
    rows = spark.createDataFrame(
        [(1, "A", "Ann Lee", "CEO", "EXECUTIVE", "A Inc", "2020", "2021"), (2, "A", "Old One", "CEO", "EXECUTIVE", "A Inc", "2020", None),
         (2, "A", "Ann Lee", " CEO", "EXECUTIVE", "A Inc", "2020", "2021"), (None, "A", "Ann Lee", " ", "EXECUTIVE", None, None, "2021"),
         (3, "B", "Bo", "Director", "BOARD", None, None, None), (4, None, "C", "Director", "BOARD", None, None, None)],
        "id long, ticker string, person_name string, role string, role_category string, company_name string, created_at string, updated_at string",
    )
    master = spark.createDataFrame([("A",), ("A",), ("B",)], "ticker string")
    snapshot = stage(c.latest_snapshot(rows), "snapshot")
    found = c.normalize(rows, master, snapshot)
    assert sorted((r.ticker, r.person_id, r.role) for r in found.collect()) == [("A", "ANN_LEE", "CEO"), ("B", "BO", "Director")]
    assert sorted(found.collect()) == sorted(c.normalize(rows, master).collect())
    assert c.normalize_summary(rows, master, found, snapshot).first() == c.normalize_summary(rows, master, found).first()
