"""Company-to-company projection of person-company relationships, and its reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.functions.numbers import pair_count, pct, percentile_of_counts
from ledgermesh.functions.text import blank_to_null
from ledgermesh.operators.canonical import beside
from ledgermesh.operators.components import component_edges, component_sizes, components, spanning_links
from ledgermesh.operators.merge import chunked, joined_chunks, numbered, top_per_key
from ledgermesh.operators.pairing import Ranges, chunks, named
from ledgermesh.operators.pairing import edges as chunk_edges
from ledgermesh.session import stage, unstage

# Companies of one person that meet in one join group; a person with more is
# split into blocks of about this size.
BLOCK = 512

# Pairs that one task of the projection takes apart and counts.
TASK_PAIRS = 1 << 21

# Companies whose weights are summed before the sums are put in order.
GROUP = 4096

# Items of one row where the list of a person or an edge is cut into rows.
CHUNK = 1000

SHARED_BUCKETS = ["=1", "=2", "=3", "=4", "=5", ">=6", ">=2", ">=3", ">=5", ">=10"]
DEGREE_BUCKETS = ["=1", "=2", "=3", "=4", "=5", "6-10", "11-20", ">20"]
THRESHOLDS = [1, 2, 3, 5, 10]
TOP_KS = [3, 5, 10]


def person_companies(rel: DataFrame) -> DataFrame:
    """Distinct (person, company), so several roles count once."""
    return rel.select("person_id", "ticker").distinct()


def person_degrees(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("person_id").agg(F.count("*").alias("degree"))


def shared_pairs(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """(source, target, person) for every two companies a person links.

    People with one company drop out before the join. A person with many is
    split into blocks of companies; block pairs, not people, are the join key,
    so the work for one hot person spreads over many tasks and stays exact.
    """
    blocks = person_degrees(pairs).filter("degree > 1").select(
        "person_id", F.ceil(F.col("degree") / block).cast("int").alias("blocks")
    )
    placed = pairs.join(blocks, "person_id").withColumn(
        "block", F.pmod(F.xxhash64("ticker"), F.col("blocks")).cast("int")
    )
    left = placed.select(
        "person_id", F.col("ticker").alias("a"), F.col("block").alias("i"),
        F.explode(F.sequence(F.col("block"), F.col("blocks") - 1)).alias("j"),
    )
    right = placed.select(
        "person_id", F.col("ticker").alias("b"), F.col("block").alias("j"),
        F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"),
    )
    met = left.join(right, ["person_id", "i", "j"]).filter("i < j or a < b")
    return met.select(
        F.least("a", "b").alias("source_ticker"), F.greatest("a", "b").alias("target_ticker"), "person_id"
    )


def _company_numbers(placed: DataFrame) -> tuple[DataFrame, Ranges]:
    """Numbers of the companies in ticker order (number, ticker), and their ranges of about ``TASK_PAIRS`` pairs.

    A company weighs the pairs that it may be in. One with more than a range should hold is a range of
    its own, dealt over slots. Sums over ``GROUP`` companies give where a range begins; two numbers and
    a ticker of each range go to the driver.
    """
    weights = placed.filter("ticker is not null").groupBy("ticker").agg(F.sum("degree").alias("weight"))
    numbered_ = numbered(weights, ["ticker"], "number").select(
        F.col("number").cast("int").alias("number"), "ticker", "weight", (F.col("weight") > TASK_PAIRS).alias("hot")
    )
    companies = stage(numbered_, "company-numbers")
    group = F.floor(F.col("number") / GROUP)
    sums = companies.groupBy(group.alias("group")).agg(F.sum("weight").alias("total"))
    before = Window.orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    sums = stage(sums.select("group", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset")), "company-offsets")
    own = Window.partitionBy("group").orderBy("number")
    placed_ = companies.withColumn("group", group).join(sums, "group").withColumn(
        "range", F.floor((F.col("offset") + F.sum("weight").over(own) - F.col("weight")) / TASK_PAIRS)
    )
    cold = placed_.filter(~F.col("hot")).groupBy("range").agg(F.min("number").alias("number"), F.min("ticker").alias("ticker"))
    hot = companies.filter("hot").select("number", "ticker", F.ceil(F.col("weight") / TASK_PAIRS).cast("int").alias("slots"))
    found = cold.select("number", "ticker", F.lit(1).alias("slots")).unionByName(hot).orderBy("number").collect()
    ranges = Ranges(
        np.array([r["number"] for r in found], np.int64), np.array([r["slots"] for r in found], np.int64), [r["ticker"] for r in found]
    )
    return companies.select("number", "ticker"), ranges


def _company_lists(pairs: DataFrame, block: int) -> tuple[DataFrame, DataFrame, Ranges, int]:
    """Numbered companies, the lists of each person that meet, ranges of companies, and the number of tasks.

    The lists (own, theirs) hold about ``block`` companies each, in number
    order. People with one company drop out.
    """
    degrees = person_degrees(pairs).filter("degree > 1")
    placed = stage(pairs.join(degrees, "person_id"), "projection-pairs")
    companies, ranges = _company_numbers(placed)
    blocks = F.ceil(F.col("degree") / block).cast("int")
    found = placed.join(companies, "ticker").withColumn("blocks", blocks).groupBy(
        "person_id", "blocks", F.pmod(F.xxhash64("ticker"), F.col("blocks")).cast("int").alias("block")
    ).agg(F.sort_array(F.collect_list("number")).alias("own"))
    lists = stage(found, "company-lists")
    most = placed.agg(F.sum("degree")).first()[0] or 0
    tasks = max(most // 2 // TASK_PAIRS + 1, pairs.sparkSession.sparkContext.defaultParallelism)
    unstage(placed)
    alone = lists.filter("blocks = 1").select("own", F.col("own").alias("theirs"))
    split = lists.filter("blocks > 1")
    left = split.select("person_id", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    theirs = split.select("person_id", F.col("block").alias("other"), F.col("own").alias("theirs"))
    return companies, alone.unionByName(left.join(theirs, ["person_id", "other"]).select("own", "theirs")), ranges, tasks


def edge_chunks(pairs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame, Ranges, int]:
    """Counted edges in chunks, the companies by number, their ranges and the number of tasks.

    The companies of a person travel once for each range of companies they
    are in, with the numbers of those behind; only there are pairs made and
    counted, so they are neither sorted nor shuffled. Tasks follow the number
    of pairs, about ``TASK_PAIRS`` to one.
    """
    companies, lists, ranges, tasks = _company_lists(pairs, block)
    return chunks(lists, companies, ranges, tasks), companies, ranges, tasks


def projection(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Weighted company graph: chunks of counted edges meet the tickers of their targets, range by range."""
    return named(*edge_chunks(pairs, block))


def numbered_projection(pairs: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Weighted company graph over company numbers, which order as the tickers do, and the companies (number, ticker)."""
    packed, companies, _, _ = edge_chunks(pairs, block)
    return chunk_edges(packed), companies


def edges_by_source(pairs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Weighted company graph with the tickers of its sources and the numbers of its targets, for counts by source."""
    return chunk_edges(edge_chunks(pairs, block)[0], with_tickers=True)


def labels_by_ticker(labels: DataFrame, companies: DataFrame) -> DataFrame:
    """Component labels over company numbers as tickers."""
    nodes = companies.select(F.col("number").alias("node"), F.col("ticker").alias("_node"))
    heads = companies.select(F.col("number").alias("component"), F.col("ticker").alias("_component"))
    return labels.join(nodes, "node").join(heads, "component").select(F.col("_node").alias("node"), F.col("_component").alias("component"))


def company_names(rel: DataFrame) -> DataFrame:
    """Name of a company: the first in canonical order, which is the smallest."""
    return rel.select("ticker", "company_name").distinct().groupBy("ticker").agg(
        F.min("company_name").alias("company_name")
    )


def duplicate_rows(rel: DataFrame) -> DataFrame:
    """Number of rows that repeat an earlier one in every column."""
    counts = rel.groupBy(*rel.columns).agg(F.count("*").alias("n"))
    return counts.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_rows"))


def person_names(rel: DataFrame) -> DataFrame:
    """First non-blank name of a person in canonical order."""
    order = F.struct("ticker", "company_name", "person_name", "role", "role_category", "extraction_time")
    named = F.min_by(F.col("person_name"), F.when(F.col("person_name") != "", order))
    return rel.groupBy("person_id").agg(F.coalesce(named, F.lit("")).alias("person_name"))


def profiles(rel: DataFrame) -> DataFrame:
    """Roles and categories of each person at each company."""
    return rel.groupBy("person_id", "ticker").agg(
        F.sort_array(F.collect_set(blank_to_null(F.col("role")))).alias("roles"),
        F.sort_array(F.collect_set(blank_to_null(F.col("role_category")))).alias("role_categories"),
    )


def both_ends(edges: DataFrame) -> DataFrame:
    """Each edge once per end: (ticker, neighbour, source, target, weight)."""
    ends = F.explode(
        F.array(
            F.struct(F.col("source_ticker").alias("ticker"), F.col("target_ticker").alias("neighbour")),
            F.struct(F.col("target_ticker").alias("ticker"), F.col("source_ticker").alias("neighbour")),
        )
    )
    return edges.withColumn("_end", ends).select(
        "_end.ticker", "_end.neighbour", "source_ticker", "target_ticker", "shared_person_count"
    )


def company_distribution(edges: DataFrame, names: DataFrame) -> DataFrame:
    """Degree and strength of every company, zero without an edge."""
    totals = both_ends(edges).groupBy("ticker").agg(
        F.count("*").alias("degree"), F.sum("shared_person_count").alias("strength")
    )
    return names.join(totals, "ticker", "left").select(
        "ticker", "company_name",
        F.coalesce("degree", F.lit(0)).alias("company_projected_degree"),
        F.coalesce("strength", F.lit(0)).alias("total_shared_person_connections"),
    )


def _buckets(histogram: DataFrame, labels: list[str], tests: list[Column], names: tuple[str, str, str]) -> DataFrame:
    """Overlapping buckets over a (value, n) histogram, one row per label."""
    label, count, share = names
    sums = [F.coalesce(F.sum(F.when(t, F.col("n"))), F.lit(0)).alias(f"b{i}") for i, t in enumerate(tests)]
    row = histogram.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *sums)
    entries = F.explode(
        F.array(*[F.struct(F.lit(text).alias("label"), F.col(f"b{i}").alias("n")) for i, text in enumerate(labels)])
    )
    return row.select("total", entries.alias("e")).select(
        F.col("e.label").alias(label), F.col("e.n").alias(count), pct(F.col("e.n"), F.col("total")).alias(share)
    )


def shared_distribution(edges: DataFrame) -> DataFrame:
    histogram = edges.groupBy(F.col("shared_person_count").alias("value")).agg(F.count("*").alias("n"))
    v = F.col("value")
    tests = [v == 1, v == 2, v == 3, v == 4, v == 5, v >= 6, v >= 2, v >= 3, v >= 5, v >= 10]
    return _buckets(histogram, SHARED_BUCKETS, tests, ("shared_person_count", "edge_count", "edge_percentage"))


def degree_buckets(degrees: DataFrame) -> DataFrame:
    histogram = degrees.groupBy(F.col("degree").alias("value")).agg(F.count("*").alias("n"))
    v = F.col("value")
    tests = [v == 1, v == 2, v == 3, v == 4, v == 5, v.between(6, 10), v.between(11, 20), v > 20]
    return _buckets(
        histogram, DEGREE_BUCKETS, tests, ("person_company_degree", "person_count", "person_percentage")
    )


def concentration(degrees: DataFrame) -> DataFrame:
    """Share of pair contributions held by the top people and by high degrees."""
    pairs = degrees.select("person_id", "degree", pair_count(F.col("degree")).alias("pairs"))
    d = F.col("degree")
    totals = pairs.agg(
        F.coalesce(F.sum("pairs"), F.lit(0)).alias("total"),
        *[F.coalesce(F.sum(F.when(d >= n, F.col("pairs"))), F.lit(0)).alias(f"ge{n}") for n in (5, 10, 20)],
    )
    top = pairs.orderBy(F.desc("pairs"), "person_id").limit(50)
    ranked = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("pairs"), "person_id")))
    heads = ranked.agg(
        *[F.coalesce(F.sum(F.when(F.col("rank") <= n, F.col("pairs"))), F.lit(0)).alias(f"top{n}") for n in (1, 5, 10, 50)]
    )
    total = F.col("total")
    return beside([totals, heads]).select(
        total.alias("total_person_pair_contributions_before_deduplication"),
        pct(F.col("top1"), total).alias("top_1_person_percentage"),
        pct(F.col("top5"), total).alias("top_5_people_percentage"),
        pct(F.col("top10"), total).alias("top_10_people_percentage"),
        pct(F.col("top50"), total).alias("top_50_people_percentage"),
        pct(F.col("ge5"), total).alias("degree_at_least_5_percentage"),
        pct(F.col("ge10"), total).alias("degree_at_least_10_percentage"),
        pct(F.col("ge20"), total).alias("degree_at_least_20_percentage"),
    )


def most_connected(degrees: DataFrame, k: int = 50) -> DataFrame:
    return degrees.orderBy(F.desc("degree"), "person_id").limit(k)


def company_chunks(kept: DataFrame, pairs: DataFrame, size: int = CHUNK) -> DataFrame:
    """Companies of the kept people: (person_id, chunk, tickers), ``size`` tickers to a row."""
    listed = pairs.join(F.broadcast(kept.select("person_id")), "person_id", "left_semi")  # k rows
    return chunked(listed, ["person_id"], "ticker", size, F.col("ticker"), "tickers")


def top_people(degrees: DataFrame, pairs: DataFrame, rel: DataFrame, k: int = 50) -> DataFrame:
    """People with the most companies; the list of each of the ``k`` kept is put together from its chunks."""
    kept = stage(most_connected(degrees, k), "most-connected")
    chunks = company_chunks(kept, pairs)
    listed = joined_chunks(chunks, ["person_id"], F.array_join("tickers", ";"), ";", "company_tickers")
    named = person_names(rel.join(F.broadcast(kept.select("person_id")), "person_id", "left_semi"))
    return kept.join(listed, "person_id").join(named, "person_id").select(
        "person_id", "person_name", F.col("degree").alias("person_company_degree"), "company_tickers"
    )


def top_companies(distribution: DataFrame, k: int = 50) -> DataFrame:
    return distribution.orderBy(F.desc("company_projected_degree"), "ticker").limit(k)


def strongest_edges(edges: DataFrame, k: int = 100) -> DataFrame:
    return edges.orderBy(F.desc("shared_person_count"), "source_ticker", "target_ticker").limit(k)


def edge_people(kept: DataFrame, pairs: DataFrame) -> DataFrame:
    """(source, target, person) of the kept edges, by two joins on their ends."""
    ends = kept.select("source_ticker", "target_ticker")
    at_source = pairs.select("person_id", F.col("ticker").alias("source_ticker"))
    at_target = pairs.select("person_id", F.col("ticker").alias("target_ticker"))
    return ends.join(at_source, "source_ticker").join(at_target, ["target_ticker", "person_id"])


def edge_evidence(kept: DataFrame, rel: DataFrame) -> DataFrame:
    """One row per kept edge and shared person with the roles at both ends."""
    shared = edge_people(kept, person_companies(rel))
    people = shared.select("person_id").distinct()
    relevant = rel.join(people, "person_id", "left_semi")
    profile = profiles(relevant)
    source = profile.select(
        "person_id", F.col("ticker").alias("source_ticker"),
        F.col("roles").alias("source_roles"), F.col("role_categories").alias("source_role_categories"),
    )
    target = profile.select(
        "person_id", F.col("ticker").alias("target_ticker"),
        F.col("roles").alias("target_roles"), F.col("role_categories").alias("target_role_categories"),
    )
    return (
        shared.join(source, ["person_id", "source_ticker"])
        .join(target, ["person_id", "target_ticker"])
        .join(person_names(relevant), "person_id")
    )


EDGE = ["source_ticker", "target_ticker"]


def evidence_chunks(kept: DataFrame, rel: DataFrame, size: int = CHUNK) -> DataFrame:
    """Evidence of the kept edges in order of person_id: (source, target, chunk, people), ``size`` people to a row."""
    fields = [
        "person_id", "person_name", "source_role_categories", "source_roles",
        "target_role_categories", "target_roles",
    ]
    return chunked(edge_evidence(kept, rel), EDGE, "person_id", size, F.struct(*fields), "people")


def top_edges(edges: DataFrame, rel: DataFrame, k: int = 100) -> DataFrame:
    """Strongest edges with company names and the evidence behind each.

    The evidence is compact JSON with keys in alphabetical order, put together
    from its chunks.
    """
    kept = stage(strongest_edges(edges, k), "strongest-edges")
    inner = F.to_json("people")
    evidence = joined_chunks(
        evidence_chunks(kept, rel), EDGE, inner.substr(F.lit(2), F.length(inner) - 2), ",", "_people"
    )
    names = company_names(rel)
    source = names.select(F.col("ticker").alias("source_ticker"), F.col("company_name").alias("source_company_name"))
    target = names.select(F.col("ticker").alias("target_ticker"), F.col("company_name").alias("target_company_name"))
    return (
        kept.join(evidence, EDGE)
        .join(source, "source_ticker", "left")
        .join(target, "target_ticker", "left")
        .select(
            "source_ticker", F.coalesce("source_company_name", F.lit("")).alias("source_company_name"),
            "target_ticker", F.coalesce("target_company_name", F.lit("")).alias("target_company_name"),
            "shared_person_count", F.concat(F.lit("["), "_people", F.lit("]")).alias("shared_people_evidence"),
        )
    )


def topk_edges(edges: DataFrame, k: int) -> DataFrame:
    """The ``k`` strongest edges of every company, one row per end."""
    return top_per_key(both_ends(edges), ["ticker"], k, F.desc("shared_person_count"), F.asc("neighbour"))


def _retention(kept: DataFrame, edges: DataFrame, names: DataFrame, variant: str, values: list[int], kept_name: str) -> DataFrame:
    """Kept-edge metrics per variant, each of which keeps what the one before it in ``values`` does.

    ``kept`` holds each edge once with its ``level``, the first variant (from
    0) that keeps it. Components are found level by level: those of the
    stricter variant stand in for its edges, as links of its nodes to their
    component, beside the edges that the next one adds. Edges that a partition
    does not need to link its nodes at each level are left out before.
    """
    added = {r["level"]: r["count"] for r in kept.groupBy("level").count().collect()}  # one row per variant
    links = kept.select("level", F.col("source_ticker").alias("a"), F.col("target_ticker").alias("b"))
    stored = stage(spanning_links(links), "spanning-links")
    n_edges, n_companies = F.lit(edges.count()), F.lit(names.count())
    nothing = F.lit(0).cast("long")
    shape = edges.sparkSession.range(1).select(nothing.alias("nodes"), nothing.alias("parts"), nothing.alias("largest"))
    forest, rows, held = None, [], 0
    for level, value in enumerate(values):
        if added.get(level):
            links = stored.filter(F.col("level") == level).select("a", "b")
            labels = components(links if forest is None else links.unionByName(forest))
            forest = labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))
            shape = component_sizes(labels).agg(
                F.sum("company_count").alias("nodes"), F.count("*").alias("parts"), F.max("company_count").alias("largest")
            )
            held += added[level]
        rows.append(shape.select(F.lit(value).alias(variant), F.lit(held).cast("long").alias("kept"), "nodes", "parts", "largest"))
    return reduce(DataFrame.unionByName, rows).select(
        variant,
        F.col("kept").alias(kept_name),
        pct(F.col("kept"), n_edges).alias("retained_edge_percentage"),
        F.col("nodes").alias("companies_with_at_least_one_retained_edge"),
        (n_companies - F.col("nodes")).alias("companies_with_zero_retained_edges"),
        F.col("parts").alias("connected_component_count"),
        F.col("largest").alias("largest_connected_component_size"),
    )


def _level(values: list[int], keeps: Callable[[int], Column]) -> Column:
    """Place of the first of some nested variants that keeps a row; null where none does."""
    return F.coalesce(*[F.when(keeps(value), F.lit(level)) for level, value in enumerate(values)])


def threshold_report(edges: DataFrame, names: DataFrame, thresholds: list[int] = THRESHOLDS) -> DataFrame:
    """What stays when only edges of a minimum weight are kept; an edge enters once, at its highest threshold."""
    strict = sorted(thresholds, reverse=True)
    kept = edges.withColumn("level", _level(strict, lambda t: F.col("shared_person_count") >= t)).filter("level is not null")
    return _retention(kept, edges, names, "threshold", strict, "retained_edge_count")


def topk_report(edges: DataFrame, names: DataFrame, ks: list[int] = TOP_KS) -> DataFrame:
    """What stays when each company keeps its strongest edges; one ranking serves every k."""
    ranked = top_per_key(
        both_ends(edges), ["ticker"], max(ks), F.desc("shared_person_count"), F.asc("neighbour"), rank="rank"
    )
    best = ranked.groupBy(*EDGE).agg(F.min("rank").alias("rank"))
    strict = sorted(ks)
    kept = stage(best.withColumn("level", _level(strict, lambda k: F.col("rank") <= k)), "topk-edges")
    return _retention(kept, edges, names, "top_k", strict, "retained_unique_edge_count")


def component_report(edges: DataFrame, labels: DataFrame, k: int = 20, preview: int = 100) -> DataFrame:
    """Largest components with their edge count and a preview of their tickers."""
    top = component_sizes(labels).orderBy(F.desc("company_count"), "component").limit(k)
    rank = F.row_number().over(Window.orderBy(F.desc("company_count"), "component"))
    ranked = top.withColumn("component_rank", rank)
    members = labels.join(F.broadcast(top.select("component")), "component", "left_semi")
    per_company = edges.groupBy(F.col("source_ticker").alias("a")).agg(F.count("*").alias("n"))  # edges stay where they are
    counts = component_edges(per_company, members).groupBy("component").agg(F.sum("n").alias("edge_count"))
    shown = top_per_key(members, ["component"], preview, F.asc("node")).groupBy("component").agg(
        F.sort_array(F.collect_list("node")).alias("nodes")
    )
    return ranked.join(counts, "component").join(shown, "component").select(
        "component_rank", "company_count", "edge_count",
        F.to_json("nodes").alias("tickers"),
        (F.col("company_count") > preview).alias("ticker_list_truncated"),
    )


def projection_components(pairs: DataFrame) -> DataFrame:
    """Components of the whole projection, found on links to the first company of each person.

    Two companies share a component exactly when people connect them, so these
    links, linear in the input, replace the pair expansion. Companies stand in
    them by their numbers in ticker order.
    """
    firsts = pairs.groupBy("person_id").agg(F.count("*").alias("degree"), F.min("ticker").alias("first"))
    linked = stage(pairs.join(firsts.filter("degree > 1"), "person_id").select("ticker", "first").distinct(), "first-links")
    companies = stage(numbered(linked.select("ticker").filter("ticker is not null").distinct(), ["ticker"], "number").select("ticker", F.col("number").cast("int").alias("number")), "company-numbers")
    links = linked.join(companies.withColumnRenamed("number", "a"), "ticker").join(
        companies.select(F.col("ticker").alias("first"), F.col("number").alias("b")), "first"
    )
    return labels_by_ticker(components(spanning_links(links.select("a", "b"))), companies)


def _spread(histogram: DataFrame, prefix: str, with_minimum: bool) -> DataFrame:
    """Minimum, maximum, mean, median and high percentiles of a (value, n) histogram."""
    v, n = F.col("value"), F.col("n")
    zero = F.lit(0)
    stats = [
        F.coalesce(F.max(v), zero).alias(f"{prefix}_maximum"),
        F.coalesce(F.round(F.sum(v * n) / F.sum(n), 6), F.lit(0.0)).alias(f"{prefix}_mean"),
        percentile_of_counts(v, 0.5, n).alias(f"{prefix}_median"),
        percentile_of_counts(v, 0.90, n).alias(f"{prefix}_p90"),
        percentile_of_counts(v, 0.95, n).alias(f"{prefix}_p95"),
        percentile_of_counts(v, 0.99, n).alias(f"{prefix}_p99"),
    ]
    if with_minimum:
        stats.insert(0, F.coalesce(F.min(v), zero).alias(f"{prefix}_minimum"))
    return histogram.agg(*stats)


def _histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))


def projection_summary(
    rel: DataFrame, pairs: DataFrame, edges: DataFrame, distribution: DataFrame, labels: DataFrame
) -> DataFrame:
    """One row with the input, weight, degree and component figures."""
    degrees = person_degrees(pairs)
    zero = F.lit(0)
    parts = [
        rel.agg(F.count("*").alias("total_relationship_rows")),
        duplicate_rows(rel).withColumnRenamed("duplicate_rows", "duplicate_exact_relationship_rows"),
        degrees.agg(
            F.count("*").alias("unique_people"),
            F.count_if(F.col("degree") == 1).alias("people_with_exactly_1_distinct_company"),
            F.count_if(F.col("degree") > 1).alias("people_with_more_than_1_distinct_company"),
        ),
        distribution.agg(
            F.count("*").alias("unique_companies"),
            F.count_if(F.col("company_projected_degree") > 0).alias("companies_with_cross_company_connections"),
            F.count_if(F.col("company_projected_degree") == 0).alias("companies_without_cross_company_connections"),
        ),
        _histogram(edges, "shared_person_count").agg(
            F.coalesce(F.sum("n"), zero).alias("total_unique_unordered_company_edges"),
            F.coalesce(F.min("value"), zero).alias("minimum_shared_person_count"),
            F.coalesce(F.max("value"), zero).alias("maximum_shared_person_count"),
            F.coalesce(F.round(F.sum(F.col("value") * F.col("n")) / F.sum("n"), 6), F.lit(0.0)).alias("mean_shared_person_count"),
            percentile_of_counts(F.col("value"), 0.5, F.col("n")).alias("median_shared_person_count"),
        ),
        _spread(_histogram(degrees, "degree"), "person_company_degree", False),
        _spread(_histogram(distribution, "company_projected_degree"), "company_projected_degree", True),
        component_sizes(labels).agg(
            F.count("*").alias("total_connected_components_companies_in_projection"),
            F.coalesce(F.max("company_count"), zero).alias("largest_connected_component_company_count"),
        ),
    ]
    row = beside(parts)
    return row.withColumn(
        "largest_connected_component_percentage_of_all_companies",
        pct(F.col("largest_connected_component_company_count"), F.col("unique_companies")),
    ).withColumn(
        "singleton_companies_with_no_cross_company_edge", F.col("companies_without_cross_company_connections")
    )
