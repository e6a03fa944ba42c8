from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.operators import answers as a
from ledgermesh.operators import companies as co
from ledgermesh.plans import catalog
from ledgermesh.schemas import RELATIONSHIPS_RAW
from ledgermesh.sources import holdings as h
from ledgermesh.sources import tables

BODY = (
    '{"companies":[{"ticker":"QZLM","relationships":[{"person_name":"Mira Okafor-Lind",'
    '"role":"Chief Executive Officer and Founder","role_category":"executive"},'
    '{"person_name":"A B","role":"r","role_category":"OTHER"}]}]}'
)


def answers(spark, *rows):
    return spark.createDataFrame(list(rows), "batch_id string, tickers array<string>, raw_response string")


def test_fenced_and_bare(spark):
    df = answers(spark, ("b1", ["QZLM"], f"```json\n{BODY}\n```"), ("b2", ["HLXW"], ' {"companies":[{"ticker":"HLXW","relationships":[]}]} '))
    (row,) = a.parse_answers(df).collect()
    assert (row.batch_id, row.person_key, row.role_category) == ("b1", "MIRA_OKAFORLIND", "EXECUTIVE")
    assert {tuple(r) for r in a.returned_tickers(df).collect()} == {("b1", "QZLM"), ("b2", "HLXW")}


def test_outcomes(spark):
    df = answers(
        spark, ("ok", ["QZLM"], BODY), ("part", ["QZLM", "VRTN"], BODY), ("none", ["A"], " \n"), ("null", ["A"], None),
        ("cut", ["A"], BODY[:30]), ("list", ["A"], "[1]"), ("word", ["A"], '{"companies":"x"}'), ("bare", ["A"], "{}"),
        ("nest", ["A"], '{"companies":[{"ticker":"A","relationships":null}]}'),
    )
    found = {r.batch_id: (r.status, r.reason, r.missing) for r in a.answer_status(df).collect()}
    assert found == {
        "ok": ("success", None, []), "part": ("partial", "missing_from_response", ["VRTN"]),
        "none": ("failed", "no_final_text", []), "null": ("failed", "no_final_text", []),
        "cut": ("failed", "invalid_json", []), "list": ("failed", "parse_exception", []),
        "word": ("failed", "parse_exception", []), "bare": ("partial", "missing_from_response", ["A"]),
        "nest": ("failed", "parse_exception", []),
    }


def test_company_name_and_retry(spark):
    rows = a.parse_answers(answers(spark, ("b", ["QZLM"], BODY)))
    names = spark.createDataFrame([("QZLM", "Quartz Loom")], "ticker string, company_name string")
    assert a.add_company_names(rows, names).first().company_name == "Quartz Loom"
    events = spark.createDataFrame(
        [("qzlm", "batch_1", "missing_from_response", 1), ("QZLM", "batch_2", "api_exception", 2)],
        "ticker string, batch_id string, reason string, seq long",
    )
    (row,) = a.merge_retry(events).collect()
    assert (row.ticker, row.batch_id, row.reason) == ("QZLM", "batch_2", "api_exception")


def test_retry_list(spark):
    df = spark.createDataFrame([(0, " qzlm ", "Quartz Loom"), (1, "HLXW", "Helix Works ")], "idx long, ticker string, company_name string")
    assert [r.ticker for r in tables.read_retry_list(df).orderBy("idx").collect()] == ["QZLM", "HLXW"]
    with pytest.raises(Exception, match="row 2 must have"):
        tables.read_retry_list(df.withColumn("ticker", F.when(F.col("idx") == 1, "HLXW"))).collect()
    with pytest.raises(ValueError, match="company_name"):
        tables.read_retry_list(df.drop("company_name"))


def test_upsert_keeps_id_and_creation(spark):
    old = spark.createDataFrame([(7, "A", "Old", "K", "r", "BOARD", "c", "b0", "m", "t0", "t0")], RELATIONSHIPS_RAW)
    new = spark.createDataFrame(
        [(8, "A", "New", "K", "r", "BOARD", "c", "b1", "m", "t1", "t1", 1), (9, "B", "One", "K", "r", "BOARD", "c", "b1", "m", "t1", "t1", 2),
         (10, "B", "Two", "K", "r", "BOARD", "c", "b2", "m", "t2", "t2", 3)],
        "id long, ticker string, person_name string, person_key string, role string, role_category string, company_name string,"
        " batch_id string, extraction_method string, created_at string, updated_at string, seq long",
    )
    rows = {r.ticker: r for r in a.upsert_raw(old, new).collect()}
    assert (rows["A"].id, rows["A"].created_at, rows["A"].person_name, rows["A"].updated_at) == (7, "t0", "New", "t1")
    assert (rows["B"].id, rows["B"].created_at, rows["B"].person_name, rows["B"].batch_id) == (9, "t1", "Two", "b2")


def test_company_hygiene(spark):
    members = spark.createDataFrame([("--", "RUSSELL2000"), ("N/A", "RUSSELL1000"), ("HLXW", "SPX")], "ticker string, universe string")
    real, bad = co.split_placeholders(members, "now")
    assert [r.ticker for r in real.collect()] == ["HLXW"] and {r.reason for r in bad.collect()} == {"invalid_placeholder_ticker"}
    rows = spark.createDataFrame(
        [("BAD", "SPX", None, None, None, None), ("GOOD", "SPX", "Good Co", None, None, None)],
        "ticker string, universe string, company_name string, sector string, industry string, description string",
    )
    known, unknown = co.split_identity(rows, "now")
    assert [r.ticker for r in known.collect()] == ["GOOD"]
    assert unknown.first().reason == "metadata_not_found_empty_company"


def test_workbook(spark):
    xml = (
        '<?xml version="1.0"?><Workbook xmlns="urn:a" xmlns:ss="urn:b"><Worksheet ss:Name="Positions"><Table>'
        '<Row><Cell><Data ss:Type="String">Ticker</Data></Cell><Cell><Data>Name</Data></Cell><Cell><Data>Asset Class</Data></Cell></Row>'
        '<Row><Cell><Data>ORC.K</Data></Cell><Cell><Data>Orchard & Kiln\x08 Works</Data></Cell><Cell><Data>Equity</Data></Cell></Row>'
        '<Row><Cell><Data>USD</Data></Cell><Cell><Data>Dollar</Data></Cell><Cell ss:Index="3"><Data>Cash</Data></Cell></Row>'
        "</Table></Worksheet></Workbook>"
    )
    rows = h.read_sheet_rows(spark.createDataFrame([("f", xml)], "file string, xml string"))
    assert [r.ticker for r in h.holdings_tickers(rows, ["ticker"], ["ticker"]).collect()] == ["ORC-K"]
    with pytest.raises(ValueError):
        h.require_tickers(h.holdings_tickers(rows.filter("idx <> 1"), ["ticker"], ["ticker"]))


def test_short_description(spark):
    sentence = "This company makes many useful things for people. "
    texts = {
        "short": "  A  b. ", "late": sentence * 8, "early": sentence * 3 + "x" * 400, "cut": "word, " * 80, "none": "", "long": "y" * 400,
    }
    df = spark.createDataFrame(list(texts.items()), "k string, v string")
    got = {r.k: r.s for r in df.select("k", t.description_short(F.col("v")).alias("s")).collect()}
    assert got["short"] == "A b." and got["none"] is None
    assert got["late"] == (sentence * 6).strip() and got["early"] == (sentence * 3).strip()
    assert got["cut"] == ("word, " * 48 + "word") + "..." and got["long"] == "y" * 300 + "..."


def test_read_csv(spark, tmp_path):
    (tmp_path / "t.csv").write_text('ticker,extra,name\nA,,"x, ""y"""\n')
    row = tables.read_csv_table(spark, str(tmp_path / "t.csv"), ["ticker", "name"]).first()
    assert (row.ticker, row.extra, row.name) == ("A", "", 'x, "y"')
    with pytest.raises(ValueError, match="a, b"):
        tables.read_csv_table(spark, str(tmp_path / "t.csv"), ["b", "ticker", "a"])


def test_preamble_file(spark, tmp_path):
    (tmp_path / "h.csv").write_text('Fund\nAs of\n"Ticker","Name"\nAAA,"b, c"\n')
    rows = h.read_preamble_csv(h.text_lines(spark, str(tmp_path / "h.csv")), "ticker").orderBy("idx").collect()
    assert [(r.idx, r.cells) for r in rows] == [(2, ["Ticker", "Name"]), (3, ["AAA", "b, c"])]


def test_urls(spark):
    text = '{"a":"https://x.org/f.csv","fileType=":"n","b":["/dl/file.xlsx?x=1","n\\/q"],"c":"see https://y.org/p fileType=csv"}'
    urls = spark.createDataFrame([(text,)], "j string").select(t.extract_urls(F.col("j"), "https://h.org").alias("u")).first().u
    assert urls == [
        "https://x.org/f.csv", "https://h.org/dl/file.xlsx?x=1", "https://y.org/p", "https://h.org/see https://y.org/p fileType=csv",
    ]


def test_numbered_is_global_and_dense(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7)
    rows = co.assign_batches(df, 30, ["k"]).collect()
    assert all(r.row_index == r.k and r.batch_index == r.k // 30 for r in rows) and len(rows) == 1000


def test_usage_keeps_the_whole_object(spark):
    responses = [
        ("a", '{"id":"r","output_text":"hello","status":"done","output":[{"type":"message"}],"usage":{"input_tokens":5,"zeta":{"b":[1,null]},"extraction_method":"x","note":"é \\"q\\""}}'),
        ("b", '{"output":null,"usage":null}'), ("c", '{"usage":[1]}'),
    ]
    got = {r.batch_id: r.usage_json for r in a.usage(spark.createDataFrame(responses, "batch_id string, response string"), "m").collect()}
    assert list(json.loads(got["a"])) == sorted(json.loads(got["a"]))
    assert json.loads(got["a"]) == {
        "extracted_text_len": 5, "extraction_method": "output_text", "input_tokens": 5, "note": 'é "q"', "output_item_types": ["message"],
        "response_status": "done", "zeta": {"b": [1, None]},
    }
    assert json.loads(got["b"]) == json.loads(got["c"]) == {"output_item_types": []}


def test_batches_of_a_union_of_joins(spark, tmp_path):
    """Both sides of a union are joined by the key alike, with joins that shuffle: every batch stands once."""
    orders = [(n, n % 7, "F" if n % 2 else "O", None, None, "1-URGENT") for n in range(44)]
    kinds = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    spark.createDataFrame(orders, kinds).write.parquet(f"{tmp_path}/orders.parquet")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = catalog.queries()["upsert_batches"](spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    failed = {n for n in range(44) if n % 11 in (0, 1, 4, 5)}
    assert sorted(tuple(r) for r in rows) == sorted(
        (f"b{n}", "failed" if n in failed else "success", "2024-01-01" if n % 2 else "2023") for n in range(44)
    )


def test_headers_are_not_sent_to_every_task(spark):
    """There is a header for every file, so their number grows with the input."""
    rows = spark.createDataFrame([("f", 0, ["Ticker", "Name"]), ("f", 1, ["AB", "A"])], "file string, idx int, cells array<string>")
    found = h.promote_header(rows, ["ticker"])
    assert [r.cells for r in found.collect()] == [["AB", "A"]]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()
