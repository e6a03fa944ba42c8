"""Merkle manifest of a table: a content-addressed tree of digests, descended from its root for inclusion proofs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import stage
from ledgermesh.operators.merge import numbered

FAN_OUT = 8
SEGMENT = "struct<before: binary, after: binary>"


@dataclass(frozen=True)
class Manifest:
    """A stored tree.

    ``leaves`` has (tree, rank, group, key, leaf, carried columns): the trees of groups are
    numbered in group order, the leaves of each by key. ``levels`` has the digest-to-children
    records of the trees of groups by height from 1, ``top`` those above their roots.
    ``subroots`` has (tree, digest, height), and ``root`` one row (digest), none if the table is empty.
    """

    leaves: DataFrame
    levels: list[DataFrame]
    top: list[DataFrame]
    subroots: DataFrame
    root: DataFrame


def coded(value: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and itself; ``-`` for null."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    """SHA-256 of a row's values, 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[coded(v) for v in values]), 256))


def _hex(name: str) -> str:
    return f"lower(hex({name}))"


def _grow(nodes: DataFrame, most: int, fan_out: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Levels over the nodes (tree, idx, n, digest) of trees of n nodes each, and the last node of every tree.

    A level has one record per run of ``fan_out`` consecutive nodes: its place, digest and
    children. Trees that are down to one node drop out.
    """
    levels, ends = [], [nodes.filter("n = 1").select("tree", "digest", F.lit(0).alias("height"))]
    while most > 1:
        kids = F.sort_array(F.collect_list(F.struct((F.col("idx") % fan_out).alias("digit"), "digest")))
        runs = nodes.filter("n > 1").groupBy("tree", F.expr(f"idx div {fan_out}").alias("idx"), F.expr(f"(n + {fan_out - 1}) div {fan_out}").alias("n"))
        records = runs.agg(kids.alias("kids")).select("tree", "idx", "n", F.col("kids.digest").alias("children"))
        above = F.expr(f"unhex(sha2(array_join(transform(children, c -> {_hex('c')}), ''), 256))")
        nodes = stage(records.withColumn("digest", above), label)
        levels.append(nodes)
        ends.append(nodes.filter("n = 1").select("tree", "digest", F.lit(len(levels)).alias("height")))
        most = -(-most // fan_out)
    last = ends[0]
    for end in ends[1:]:
        last = last.unionByName(end)
    return levels, last


def build(docs: DataFrame, fields: list[str], key: str, group: str, carry: list[str] | None = None, fan_out: int = FAN_OUT) -> Manifest:
    """The manifest of a table whose rows are leaves.

    A leaf is the SHA-256 of the row's ``fields`` in that order, each coded by its length.
    In each group leaves ascend by ``key``; while several nodes are left, each ``fan_out``
    consecutive ones become the SHA-256 of their hexadecimal digests (the last run may be
    shorter, down to one node). What is left is the group's root; the roots of groups, in
    the order of the groups, become the root of the table in the same way.

    Leaves are numbered over a range partitioning by (group, key, leaf), so a group or a key
    of any size spreads over tasks; each level then is one shuffle of a digest per node, an
    ``fan_out``-th of the level below. Nothing but two counts reaches the driver.

    Nulls: a null field is coded as ``-``; the null group and null keys come first. Rows of
    equal key are ordered by their leaf, and rows equal in all fields are leaves of their
    own. An empty table has no root. Columns that are not named are ignored.
    """
    carry = carry or []
    rows = docs.select(
        F.col(group).alias("group"), F.col(key).alias("key"), leaf_digest([F.col(f) for f in fields]).alias("leaf"), *carry,
    )
    held = stage(rows.withColumn("_tie", F.monotonically_increasing_id()), "merkle-leaves")  # equal rows spread too
    placed = numbered(held, ["group", "key", "leaf", "_tie"], "_place").drop("_tie")
    groups = stage(placed.groupBy("group").agg(F.min("_place").alias("_first"), F.count("*").alias("n")), "merkle-groups")
    trees = numbered(groups, ["group"], "tree").withColumnRenamed("group", "_group")
    joined = placed.join(trees, F.col("group").eqNullSafe(F.col("_group")))
    leaves = stage(joined.select("tree", (F.col("_place") - F.col("_first")).alias("rank"), "n", "group", "key", "leaf", *carry), "merkle-ranks")
    sizes = groups.agg(F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.count("*").alias("trees")).first()
    nodes = leaves.select("tree", F.col("rank").alias("idx"), "n", F.col("leaf").alias("digest"))
    levels, ends = _grow(nodes, sizes.most, fan_out, "merkle-records")
    subroots = stage(ends, "merkle-subroots")
    above = subroots.select(F.lit(0).alias("tree"), F.col("tree").alias("idx"), F.lit(sizes.trees).alias("n"), "digest")
    top, root = _grow(above, sizes.trees, fan_out, "merkle-top")
    return Manifest(leaves.drop("n"), levels, top, subroots, root.select("digest"))


def _followed(frontier: DataFrame, records: DataFrame) -> DataFrame:
    """The records that the digests of a frontier lead to; a digest that stands in several places has one record."""
    return frontier.join(records.select("digest", "children").dropDuplicates(["digest"]), "digest")


def _segment(digit: str) -> Column:
    """The children that are not selected, joined: those before and those after ``digit``."""
    joined = "aggregate(slice(children, {}, {}), X'', (a, c) -> concat(a, c))"
    before, after = joined.format("1", digit), joined.format(f"{digit} + 2", f"size(children) - {digit} - 1")
    return F.expr(f"named_struct('before', {before}, 'after', {after})")


def _descended(frontier: DataFrame, records: DataFrame, fan_out: int) -> DataFrame:
    """One level down: every child with its place, and the path to it longer by the other children."""
    opened = _followed(frontier, records).select("*", F.posexplode("children").alias("_digit", "_child"))
    return opened.select(
        *[c for c in frontier.columns if c not in ("idx", "digest", "path")],
        (F.col("idx") * fan_out + F.col("_digit")).alias("idx"), F.col("_child").alias("digest"),
        F.concat("path", F.array(_segment("_digit"))).alias("path"),
    )


def prove(manifest: Manifest, requests: DataFrame | None = None, fan_out: int = FAN_OUT) -> DataFrame:
    """Inclusion proofs of leaves: the columns of ``leaves`` with (subroot, root, segments).

    ``requests`` has (tree, rank) of the leaves asked for; without it, all are. Requests
    descend from the root by the digits of their rank: a digest is looked up among the
    stored records, the digit selects a child, and the other children make a segment of
    the path. Requests that agree in their first digits travel as one row as far as the
    record above their leaves, so no task holds the requests of one digest. ``segments`` is
    the path reversed, from the leaf up: what stands before and after the node at each level.
    """
    start = manifest.root.select(
        "digest", F.col("digest").alias("root"), F.lit(0).cast("long").alias("idx"), F.array().cast(f"array<{SEGMENT}>").alias("path")
    )
    for records in reversed(manifest.top):
        start = _descended(start, records, fan_out)
    roots = start.select(F.col("idx").alias("tree"), "root", "digest", F.col("digest").alias("subroot"), "path")
    waiting = roots.join(manifest.subroots.select("tree", "height"), "tree").withColumn("idx", F.lit(0).cast("long"))
    asked = manifest.leaves
    if requests is not None:
        asked = stage(asked.join(requests.select("tree", "rank").distinct(), ["tree", "rank"], "left_semi"), "merkle-requests")
        waiting = waiting.join(asked.select("tree").distinct(), "tree", "left_semi")
    waiting = stage(waiting, "merkle-frontier")
    frontier = waiting.filter("false").drop("height")
    for height in range(len(manifest.levels), 0, -1):
        frontier = frontier.unionByName(waiting.filter(F.col("height") == height).drop("height"))
        if height > 1:
            frontier = _descended(frontier, manifest.levels[height - 1], fan_out)
            if requests is not None:
                prefix = F.expr(f"rank div {fan_out ** (height - 1)}").alias("idx")
                frontier = frontier.join(asked.select("tree", prefix).distinct(), ["tree", "idx"], "left_semi")
            frontier = stage(frontier, "merkle-frontier")
    kept = ["tree", "idx", "root", "subroot", "path"]
    alone = waiting.filter("height = 0").select(*kept, F.expr("cast(null as array<binary>)").alias("children"))
    parents = alone
    if manifest.levels:
        parents = _followed(frontier, manifest.levels[0]).select(*kept, "children").unionByName(alone)
    met = asked.withColumn("idx", F.expr(f"rank div {fan_out}")).join(parents, ["tree", "idx"])
    met = met.withColumn("_digit", (F.col("rank") % fan_out).cast("int"))
    own = F.when(F.col("children").isNotNull(), F.array(_segment("_digit"))).otherwise(F.array().cast(f"array<{SEGMENT}>"))
    return met.withColumn("segments", F.concat(own, F.reverse("path"))).drop("idx", "path", "children", "_digit")


def folded(leaf: str, segments: str = "segments") -> Column:
    """The root that a leaf and its proof lead to, in hexadecimal."""
    return F.expr(f"aggregate({segments}, {_hex(leaf)}, (a, s) -> sha2(concat({_hex('s.before')}, a, {_hex('s.after')}), 256))")


def verification(docs: DataFrame) -> DataFrame:
    """The contract's columns: proofs of all documents, tampered with where 3 divides the crc32 of the doc_id."""
    fields = ["doc_id", "source", "lang", "n_chars", "text"]
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    altered = leaf_digest([F.translate(F.col(f), upper, upper.lower()) if f == "text" else F.col(f) for f in fields])
    rows = docs.select(*fields).withColumn("altered", F.when(hit, altered))
    proved = prove(build(rows, fields, "doc_id", "lang", ["altered"])).withColumn("shown", F.coalesce("altered", "leaf"))
    listed = F.expr(f"array_join(transform(segments, s -> {_hex('concat(s.before, s.after)')}), '')")
    found = proved.withColumn("folded_root", folded("shown"))
    return found.select(
        F.col("key").alias("doc_id"), *[F.lower(F.hex(c)).alias(c) for c in ("leaf", "subroot", "root")],
        F.sha2(listed, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.lower(F.hex("root"))).alias("verified"),
    )
