"""Connected components of many edge sets at once."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.session import stage, unstage

# Links that are folded into a forest at a time.
FOLD = 1 << 21


def _forest_rows(a: np.ndarray, b: np.ndarray, n_nodes: int) -> np.ndarray:
    """Places of the links that make up the spanning forest which prefers earlier links.

    In each pass every part takes the first link that leaves it, and the parts so linked become one.
    """
    root, taken = np.arange(n_nodes), []
    place = np.arange(len(a))
    while True:
        ends = root[a[place]], root[b[place]]
        leaving = ends[0] != ends[1]
        place, ends = place[leaving], [end[leaving] for end in ends]
        if not len(place):
            return np.unique(np.concatenate(taken)) if taken else place
        first = np.full(n_nodes, len(place))
        for end in ends:
            own, at = np.unique(end, return_index=True)
            first[own] = np.minimum(first[own], at)
        parts = np.flatnonzero(first < len(place))
        link = first[parts]
        taken.append(place[link])
        into = np.arange(n_nodes)
        into[parts] = ends[0][link] + ends[1][link] - parts
        mutual = parts[(into[into[parts]] == parts) & (parts < into[parts])]
        into[mutual] = mutual
        while not np.array_equal(into, into[into]):
            into = into[into]
        root = into[root]


def _folded(schema: pa.Schema) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def fold(links: pa.Table) -> pa.Table:
        links = links.sort_by("level") if "level" in links.column_names else links
        nodes = pa.chunked_array(links["a"].chunks + links["b"].chunks, schema.field("a").type).combine_chunks().dictionary_encode()
        places = nodes.indices.to_numpy(zero_copy_only=False)
        return links.take(_forest_rows(places[: len(links)], places[len(links) :], len(nodes.dictionary)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, fresh = [], 0
        for batch in batches:
            held.append(batch)
            fresh += len(batch)
            if fresh >= FOLD:
                kept = fold(pa.Table.from_batches(held)).combine_chunks()
                if len(kept) > FOLD:
                    yield from kept.to_batches(max_chunksize=1 << 16)
                    kept = kept.slice(0, 0)
                held, fresh = kept.to_batches(), 0
        if held:
            yield from fold(pa.Table.from_batches(held)).to_batches(max_chunksize=1 << 16)

    return run


def spanning_links(edges: DataFrame) -> DataFrame:
    """Links with the components of ``edges`` (a, b, and a level or none), in general far fewer.

    The rows of each partition are folded into a spanning forest, ``FOLD``
    links at a time, before anything is shuffled; links of a node to itself
    and with nulls drop out. Where links have a level, those up to any level
    link the same nodes as before.
    """
    columns = [name for name in ("a", "b", "level") if name in edges.columns]
    links = edges.select(*columns).filter("a <> b")
    types = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    schema = pa.schema([(name, types[kind]) for name, kind in links.dtypes])
    return links.mapInArrow(_folded(schema), links.schema)


def _large_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link every larger neighbour of a node to the smallest node around it; the staged ``edges`` are deleted after."""
    both = edges.unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst")))
    low = stage(both.groupBy(*keys, "src").agg(F.least(F.min("dst"), F.col("src")).alias("low")), "links-low")
    linked = both.filter("dst > src").join(low, [*keys, "src"])
    found = stage(linked.select(*keys, F.col("dst").alias("src"), F.col("low").alias("dst")).distinct(), "links-large")
    unstage(edges, low)
    return found


def _small_star(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Link a node and its smaller neighbours to the smallest of them; the staged ``edges`` are deleted after."""
    low = stage(edges.groupBy(*keys, "src").agg(F.min("dst").alias("low")), "links-low")
    moved = edges.join(low, [*keys, "src"]).filter("dst > low")
    links = moved.select(*keys, F.col("dst").alias("src"), F.col("low").alias("dst"))
    found = stage(links.unionByName(low.select(*keys, "src", F.col("low").alias("dst"))).distinct(), "links")
    unstage(edges, low)
    return found


def _fingerprint(links: DataFrame, columns: list[str]) -> tuple:
    """Number of links with two independent combinations of their hashes: equal for equal sets, in one small pass."""
    code = F.xxhash64(*columns)
    return tuple(links.agg(F.count("*"), F.bit_xor(code), F.sum(F.xxhash64(F.lit(1), *columns).cast("decimal(38,0)"))).first())


def components(edges: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Component of every node that has an edge: (keys, node, component).

    ``edges`` has ``a`` and ``b``; ``keys`` name columns that keep edge sets
    apart, so several graphs are solved in the same rounds. The component is
    named by its smallest node. Rounds alternate between linking large and
    small neighbours to local minima, which only ever aggregates a minimum per
    node, combined before the shuffle. The minima are written before they are
    joined back, so that the links of a hot node are split over tasks by
    adaptive skew handling. Links that have become equal are folded before they
    are written, so a dense graph shrinks towards its number of nodes in the
    first round. Each half of a round is written to the shared folder, and
    nothing is recomputed when an executor is lost, and the half before it is
    deleted; the rounds end when one leaves the links as they were.
    """
    keys = keys or []
    pairs = edges.filter("a <> b").select(
        *keys, F.greatest("a", "b").alias("src"), F.least("a", "b").alias("dst")
    )
    linked, before = stage(pairs.distinct(), "links"), None
    while True:
        linked = _small_star(_large_star(linked, keys), keys)
        now = _fingerprint(linked, [*keys, "src", "dst"])
        if now == before:
            break
        before = now
    members = linked.select(*keys, F.col("src").alias("node"), F.col("dst").alias("component"))
    roots = linked.select(*keys, F.col("dst").alias("node"), F.col("dst").alias("component")).distinct()
    return members.unionByName(roots)


def component_sizes(labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    return labels.groupBy(*(keys or []), "component").agg(F.count("*").alias("company_count"))


def component_edges(edges: DataFrame, labels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Edges with the component both ends belong to."""
    ends = labels.select(*(keys or []), F.col("node").alias("a"), "component")
    return edges.join(ends, [*(keys or []), "a"])
