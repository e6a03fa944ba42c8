from __future__ import annotations

import itertools
import pathlib
import random
import time

import pytest

from pyspark.sql import functions as F

from ledgermesh.operators import components as components_of
from ledgermesh.operators import merge
from ledgermesh.operators import projection as p
from ledgermesh.operators.components import components
from ledgermesh.plans import catalog
from ledgermesh.plans.bindings import Inputs
from ledgermesh.schemas import RELATIONSHIPS
from ledgermesh.session import run_folder, stage


def rel(spark, *rows):
    data = [(r[0], r[0] + " Inc", r[1], r[1].upper(), r[2] if len(r) > 2 else "Director", "BOARD", "") for r in rows]
    return spark.createDataFrame(data, RELATIONSHIPS)


def edges(spark, *rows, block=p.BLOCK):
    found = p.projection(p.person_companies(rel(spark, *rows)), block)
    return {(r.source_ticker, r.target_ticker): r.shared_person_count for r in found.collect()}


def test_pairs(spark):
    assert edges(spark, ("A", "p1")) == {}
    assert edges(spark, ("B", "p1"), ("A", "p1")) == {("A", "B"): 1}
    assert edges(spark, ("C", "p1"), ("A", "p1"), ("B", "p1")) == {("A", "B"): 1, ("A", "C"): 1, ("B", "C"): 1}
    assert edges(spark, ("A", "p1", "CEO"), ("A", "p1", "Chair"), ("B", "p1")) == {("A", "B"): 1}
    assert edges(spark, ("A", "p1"), ("B", "p1"), ("A", "p2"), ("B", "p2")) == {("A", "B"): 2}


@pytest.mark.parametrize("block", [1, 3, 512])
def test_blocks_of_a_hot_person_change_nothing(spark, block):
    """One person holds a third of all rows; every block size gives all pairs once."""
    rng = random.Random(7)
    hot = [(f"T{n:02d}", "hot") for n in range(25)]
    others = [(f"T{rng.randrange(30):02d}", f"p{rng.randrange(12)}") for _ in range(50)]
    rows = set(hot + others)
    expected: dict[tuple[str, str], int] = {}
    for person in {person for _, person in rows}:
        for pair in itertools.combinations(sorted(ticker for ticker, q in rows if q == person), 2):
            expected[pair] = expected.get(pair, 0) + 1
    assert edges(spark, *rows, block=block) == expected


def test_threshold_and_topk(spark):
    data = rel(spark, ("A", "p1"), ("B", "p1"), ("A", "p2"), ("B", "p2"), ("B", "p3"), ("C", "p3"))
    graph, names = p.projection(p.person_companies(data)), p.company_names(data)
    row = {r.threshold: r for r in p.threshold_report(graph, names).collect()}
    assert (row[2].retained_edge_count, row[2].companies_with_zero_retained_edges) == (1, 1)
    assert (row[1].connected_component_count, row[1].largest_connected_component_size) == (1, 3)
    assert (row[10].retained_edge_count, row[10].companies_with_zero_retained_edges) == (0, 3)
    data = rel(spark, *[(t, q) for q, ts in {"p1": "AB", "p2": "AC", "p3": "AD", "p4": "BD"}.items() for t in ts])
    graph, names = p.projection(p.person_companies(data)), p.company_names(data)
    (row,) = p.topk_report(graph, names, [1]).collect()
    assert row.retained_unique_edge_count == 3


def test_retention_is_nested_whatever_the_levels(spark):
    """Thresholds in any order, some that add no edge, against components of each variant by itself."""
    rng = random.Random(5)
    graph = {}
    for _ in range(60):
        a, b = sorted(rng.sample([f"T{n:02d}" for n in range(40)], 2))
        graph[a, b] = rng.choice([1, 2, 3, 3, 5, 8])
    rows = spark.createDataFrame([(a, b, n) for (a, b), n in graph.items()], "source_ticker string, target_ticker string, shared_person_count long")
    names = spark.createDataFrame([(f"T{n:02d}", "x") for n in range(45)], "ticker string, company_name string")

    def expected(kept):
        label = _brute(kept)
        parts = [list(label.values()).count(root) for root in set(label.values())]
        return len(kept), len(label), 45 - len(label), len(parts), max(parts, default=0)

    def figures(r, kept):
        return (
            r[kept], r.companies_with_at_least_one_retained_edge, r.companies_with_zero_retained_edges,
            r.connected_component_count, r.largest_connected_component_size,
        )

    found = {r.threshold: figures(r, "retained_edge_count") for r in p.threshold_report(rows, names, [3, 9, 1, 4, 5]).collect()}
    assert found == {t: expected([e for e, n in graph.items() if n >= t]) for t in (1, 3, 4, 5, 9)}
    found = {r.top_k: figures(r, "retained_unique_edge_count") for r in p.topk_report(rows, names, [3, 1, 2]).collect()}
    ends = {}
    for (a, b), n in graph.items():
        ends.setdefault(a, []).append((-n, b, (a, b)))
        ends.setdefault(b, []).append((-n, a, (a, b)))
    assert found == {k: expected(sorted({e for own in ends.values() for *_, e in sorted(own)[:k]})) for k in (1, 2, 3)}
    assert [figures(r, "retained_edge_count") for r in p.threshold_report(rows.limit(0), names, [2, 1]).collect()] == [(0, 0, 45, 0, 0)] * 2


@pytest.mark.parametrize("size", [1, 4, 1000])
def test_lists_in_chunks(spark, size):
    """A key with most rows, a key with one: chunks are full, in order, and join to the whole list."""
    rows = [("hot", n) for n in range(50)] + [("cold", 7)]
    random.Random(1).shuffle(rows)
    chunks = merge.chunked(spark.createDataFrame(rows, "k string, n long"), ["k"], "n", size, F.col("n"), "items")
    for key, items in (("hot", list(range(50))), ("cold", [7])):
        own = {r.chunk: r["items"] for r in chunks.filter(F.col("k") == key).collect()}
        assert own == {c: items[c * size : (c + 1) * size] for c in range(-(-len(items) // size))}
    cells = merge.joined_chunks(chunks, ["k"], F.array_join(F.col("items").cast("array<string>"), ","), ",", "text").collect()
    assert {r.k: r.text for r in cells} == {"hot": ",".join(map(str, range(50))), "cold": "7"}


def test_concentration(spark):
    data = rel(spark, ("A", "p1"), ("B", "p1"), ("C", "p1"), ("A", "p2"))
    row = p.concentration(p.person_degrees(p.person_companies(data))).first()
    assert row.total_person_pair_contributions_before_deduplication == 3
    assert row.top_1_person_percentage == 100.0


def test_evidence(spark):
    data = rel(spark, ("A", "p1", "CEO"), ("A", "p1", "Chair"), ("B", "p1"))
    (row,) = p.top_edges(p.projection(p.person_companies(data)), data).collect()
    assert row.shared_people_evidence == (
        '[{"person_id":"p1","person_name":"P1","source_role_categories":["BOARD"],"source_roles":["CEO","Chair"],'
        '"target_role_categories":["BOARD"],"target_roles":["Director"]}]'
    )


def _brute(links):
    label = {n: n for link in links for n in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return label


def test_components_against_brute_force(spark):
    rng = random.Random(3)
    path = [(f"n{n:03d}", f"n{n + 1:03d}") for n in range(40)]
    star = [("hub", f"s{n:02d}") for n in range(40)]
    loose = [(f"x{rng.randrange(60)}", f"x{rng.randrange(60)}") for _ in range(45)]
    links = [(a, b) for a, b in path + star + loose if a != b]
    found = components(spark.createDataFrame(links, "a string, b string")).collect()
    assert {r.node: r.component for r in found} == _brute(links)
    assert len(found) == len({n for link in links for n in link})


def test_components_without_edges(spark):
    assert components(spark.createDataFrame([], "a string, b string")).count() == 0


def test_projection_components_match_edges(spark):
    data = rel(spark, ("A", "p1"), ("B", "p1"), ("C", "p2"), ("D", "p2"), ("E", "p3"))
    found = p.projection_components(p.person_companies(data)).collect()
    assert {r.node: r.component for r in found} == {"A": "A", "B": "A", "C": "C", "D": "C"}


def test_summary_of_nothing(spark):
    data = rel(spark, ("A", "p1"))
    pairs = p.person_companies(data)
    graph = p.projection(pairs)
    row = p.projection_summary(data, pairs, graph, p.company_distribution(graph, p.company_names(data)), p.projection_components(pairs)).first()
    assert (row.maximum_shared_person_count, row.mean_shared_person_count, row.companies_without_cross_company_connections) == (0, 0.0, 1)


@pytest.mark.parametrize("block", [1, 4, 512])
def test_companies_with_many_pairs_are_spread(spark, monkeypatch, block):
    """With few pairs to a task, companies have several slots; repeated links count as often as they stand."""
    monkeypatch.setattr(p, "TASK_PAIRS", 5)
    rng = random.Random(11)
    rows = [(f"p{n}", f"T{rng.randrange(25):02d}") for n in range(6) for _ in range(14)] + [(None, "T01"), ("p1", None), ("one", "T02")]
    expected: dict[tuple[str, str], int] = {}
    for n in range(6):
        for a, b in itertools.combinations(sorted(t for q, t in rows if q == f"p{n}" and t), 2):
            if a != b:
                expected[a, b] = expected.get((a, b), 0) + 1
    found = p.projection(spark.createDataFrame(rows, "person_id string, ticker string"), block)
    assert {(r.source_ticker, r.target_ticker): r.shared_person_count for r in found.collect()} == expected
    assert found.count() == len(expected)


def test_pairs_are_counted_where_they_are_made(spark):
    graph = p.projection(p.person_companies(rel(spark, ("A", "p1"), ("B", "p1"), ("C", "p1"))))
    assert "hashpartitioning(source_ticker#" in (plan := graph._jdf.queryExecution().executedPlan().toString())
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning(source_ticker" in line and "target" in line]


@pytest.mark.parametrize("fold", [8, 1 << 21])
def test_spanning_links_keep_components_of_each_level(spark, monkeypatch, fold):
    monkeypatch.setattr(components_of, "FOLD", fold)
    rng = random.Random(2)
    links = [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}", rng.randrange(3)) for _ in range(200)] + [(None, "n1", 0)]
    kept = [tuple(r) for r in components_of.spanning_links(spark.createDataFrame(links, "a string, b string, level int").coalesce(1)).collect()]
    assert set(kept) <= set(links) and len(kept) < 30 * (1 if fold > 200 else 3)
    for level in range(3):
        assert _brute([e[:2] for e in kept if e[2] <= level]) == _brute([e[:2] for e in links if e[2] <= level and e[0] and e[0] != e[1]])
    bare = components_of.spanning_links(spark.createDataFrame([e[:2] for e in links], "a string, b string"))
    assert _brute([tuple(r) for r in bare.collect()]) == _brute([e[:2] for e in links if e[0] and e[0] != e[1]])


def test_edges_are_not_shuffled_one_by_one(spark, monkeypatch):
    """Tickers meet chunks of edges, range by range, however many companies there are and however few a task takes."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(p, "TASK_PAIRS", 40)
    monkeypatch.setattr(p, "GROUP", 4)
    rng = random.Random(5)
    rows = {(f"T{rng.randrange(60):02d}", f"p{n}") for n in range(12) for _ in range(9)} | {(f"T{n:02d}", "hot") for n in range(0, 60, 2)}
    expected: dict[tuple[str, str], int] = {}
    for person in {person for _, person in rows}:
        for pair in itertools.combinations(sorted(ticker for ticker, q in rows if q == person), 2):
            expected[pair] = expected.get(pair, 0) + 1
    try:
        pairs = spark.createDataFrame(sorted(rows), "ticker string, person_id string")
        graph = p.projection(pairs, 8)
        plan = graph._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(range#" in plan and "hashpartitioning(target#" not in plan
        found = graph.collect()
        numbered, companies = p.numbered_projection(pairs, 8)
        tickers = {r.number: r.ticker for r in companies.collect()}
        counted = numbered.collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert {(r.source_ticker, r.target_ticker): r.shared_person_count for r in found} == expected and len(found) == len(expected)
    assert {(tickers[r.source_ticker], tickers[r.target_ticker]): r.shared_person_count for r in counted} == expected
    assert sorted(tickers.values()) == [tickers[n] for n in sorted(tickers)]


def test_rounds_of_components_leave_no_tables_behind(spark):
    links = [(f"n{n:03d}", f"n{n + 1:03d}") for n in range(40)]
    folder = pathlib.Path(run_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    found = components(spark.createDataFrame(links, "a string, b string"))
    left = [path.name for path in set(folder.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("links-"), left
    assert found.count() == 41


def test_component_edges_writes_edges_as_chunks(spark):
    folder = "/root/testdata/sf0.001"
    made = set(pathlib.Path(run_folder(spark).removeprefix("file:")).glob("*"))
    found = catalog.queries()["component_edges"](spark, folder)
    made = {path.name for path in set(pathlib.Path(run_folder(spark).removeprefix("file:")).glob("*")) - made}
    assert not [name for name in made if name.startswith("edges-")] and any(name.startswith("edge-chunks-") for name in made)
    assert found.columns == ["a", "b", "component"]
    labels = {r.node: r.component for r in catalog.queries()["components_of_ragged_links"](spark, folder).collect()}
    rows = found.collect()
    assert rows and all(labels[r.a] == labels[r.b] == r.component and r.a < r.b for r in rows)


def test_tables_that_nothing_reads_are_not_kept(spark):
    folder = pathlib.Path(run_folder(spark).removeprefix("file:"))
    before = set(folder.iterdir()) if folder.exists() else set()
    assert catalog.queries()["components_of_ragged_links"](spark, "/root/testdata/sf0.001").count()
    assert not [path for path in set(folder.iterdir()) - before if path.name.startswith("edges-")]


def test_component_report_counts_edges_where_they_are(spark, capsys):
    report = catalog.queries()["component_report"](spark, "/root/testdata/sf0.001")
    report.explain()
    assert "hashpartitioning(range#" not in capsys.readouterr().out  # no edge meets the ticker of its target
    pairs = spark.createDataFrame([(t, q) for q, ts in {"p1": "BCA", "p2": "CD", "p3": "XY", "p4": "Z"}.items() for t in [*ts, None]], "ticker string, person_id string")
    found = p.component_report(p.edges_by_source(pairs), p.projection_components(pairs))
    assert [(r.component_rank, r.company_count, r.edge_count, r.tickers) for r in found.orderBy("component_rank").collect()] == [
        (1, 4, 4, '["A","B","C","D"]'), (2, 2, 1, '["X","Y"]'),
    ]


def test_ranking_of_topk_edges_is_worked_out_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(p, "stage", lambda df, label: written.append(label) or stage(df, label))
    pairs = spark.createDataFrame([("A", "p1"), ("B", "p1"), ("B", "p2"), ("C", "p2")], "ticker string, person_id string")
    graph = p.numbered_projection(pairs)[0]
    (row,) = p.topk_report(graph, pairs.select("ticker").distinct(), [1]).collect()
    assert (row.retained_unique_edge_count, row.connected_component_count, row.largest_connected_component_size) == (2, 1, 3)
    assert written.count("topk-edges") == 1


def test_threshold_report_of_ragged_links_keeps_numbers(spark):
    files = pathlib.Path(run_folder(spark).removeprefix("file:"))
    before = set(files.glob("edges-*"))
    catalog.queries()["threshold_retention_of_ragged_links"](spark, "/root/testdata/sf0.001")
    (made,) = set(files.glob("edges-*")) - before
    assert dict(spark.read.parquet(str(made)).dtypes) == {"source_ticker": "int", "target_ticker": "int", "shared_person_count": "bigint"}


def test_shuffle_files_go_with_the_write_that_made_them(spark):
    folders = [pathlib.Path(str(f)) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]

    def files():
        return {path for folder in folders for path in folder.glob("*/shuffle_*.data")}

    key, before = "spark.sql.classic.shuffleDependency.fileCleanup.enabled", files()
    set_before = spark.conf.get(key, None)
    held = stage(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(key, None) == set_before
    assert held.count() == 7


def test_retention_reports_read_their_view_once(spark, monkeypatch):
    views, view = [], Inputs.view
    monkeypatch.setattr(Inputs, "view", lambda self, name: views.append(name) or view(self, name))
    for name, rows in (("topk_retention", 3), ("threshold_retention", 5)):
        assert catalog.queries()[name](spark, "/root/testdata/sf0.001").count() == rows
    assert views == ["v_islands", "v_islands"]
