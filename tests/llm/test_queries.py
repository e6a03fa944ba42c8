"""The registered corpus queries on the smallest tables, and the pipeline on hard cases."""

from __future__ import annotations

import hashlib
import os

import pytest

import corpus_pipeline
from ledgermesh.llm import queries
from tests.llm.helpers import brute_classes, brute_removed, by_row, hard_rows, prose, table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
needs_data = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test data is not there")


def plain(value):
    return None if value is None or value != value else value


@needs_data
@pytest.mark.parametrize("name", sorted(queries.CHECKS))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    result = con.execute(queries.CHECKS[name])
    columns = sorted(d[0] for d in result.description)
    expected = [dict(zip([d[0] for d in result.description], r, strict=True)) for r in result.fetchall()]
    got = queries.QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == columns
    assert by_row([[r[c] for c in columns] for r in got.collect()]) == by_row([[e[c] for c in columns] for e in expected])


@needs_data
def test_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in queries.documents(spark, FOLDER).collect()]
    got = queries.QUERIES["op6_near_duplicate_classes"](spark, FOLDER).collect()
    assert by_row(got) == by_row(brute_classes(rows))
    texts = [(t or "").encode() for _, t in rows]
    expected = [
        (d, len(t), n, runs, hashlib.sha256(rest).hexdigest())
        for (d, _), t, (n, runs, rest) in zip(rows, texts, brute_removed(texts, 400), strict=True)
    ]
    assert by_row(queries.QUERIES["op1_repeated_strings"](spark, FOLDER).collect()) == by_row(expected)


@needs_data
@pytest.mark.parametrize("name", ["op2_tokenizer_fertility", "op4_packed_token_files", "op5_mixing_to_weights", "op7_best_two_fit",
                                  "op9_cross_entropy_difference", "op10_toxicity"])
def test_one_row_per_document(spark, name):
    n = queries.documents(spark, FOLDER).count()
    got = queries.QUERIES[name](spark, FOLDER)
    assert got.select("doc_id").distinct().count() == n and (name.startswith("op7") or got.count() == n)


def test_pipeline(spark, tmp_path):
    rows = hard_rows() + [(100 + k, prose(5000 + k, 60) + (" you scum" if k % 4 == 0 else ""), "en", f"s{k % 3}", 1) for k in range(160)]
    table(spark, rows, clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(100 + k, 1, int(k % 4 == 0)) for k in range(160)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = queries.documents(spark, str(tmp_path))
    columns, kept = docs.columns, {}
    for name, work in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stage(work(spark, docs, str(tmp_path)), f"test-{name}")
        kept[name] = [r.doc_id for r in docs.collect()]
        assert name == "packing" or docs.columns == columns
    assert set(range(100, 260, 4)).isdisjoint(kept["toxicity"]) and {1, 2, 3, 4, 5, 8, 101, 102} <= set(kept["toxicity"])
    assert 1 in kept["exact_dedup"] and {2, 3, 6}.isdisjoint(kept["exact_dedup"])
    assert 4 not in kept["near_duplicates"] and set(kept["near_duplicates"]) <= set(kept["exact_dedup"])
    assert set(kept["mixing"]) <= set(kept["near_duplicates"]) and sorted(set(kept["packing"]), key=str) == sorted(set(kept["mixing"]), key=str)


def test_pipeline_of_nothing(spark, tmp_path):
    table(spark, [], clashes=False).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
