"""Near duplicates on word shingles: a MinHash LSH forest of sorted prefix tries, followed by exact verification."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import WORD, batches_of_rows, stage, text_of
from ledgermesh.operators.components import components
from ledgermesh.operators.merge import top_per_key

TREES, DEPTH = 24, 8
SIGNED_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("set_id", pa.binary()), ("n_shingles", pa.int64()), ("signature", pa.binary()), ("shingles", pa.binary()),
    ("text_key", pa.int64()),
])
#: Sets of a trie that one task compares, by their 192-byte signatures; sets, and shingles, of a block of a cluster.
TRIE_SETS, BLOCK_SETS, BLOCK_SHINGLES = 2048, 1024, 1 << 19
_WORD = re.compile(WORD)
_KEPT, _CHUNK = 200_000, 16_384
_MIX = np.uint64(0x9E3779B97F4A7C15)
_FACTORS = (np.random.default_rng(7).integers(0, 1 << 63, TREES * DEPTH, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)
_known: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    """64-bit hashes of words, remembered for a task."""
    if len(_known) > _KEPT:
        _known.clear()
    known, digest = _known, xxhash.xxh3_64_intdigest
    for w in set(words):
        if w not in known:
            known[w] = digest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles_of(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` words; of all words where there are fewer."""
    hashed = _word_hashes(_WORD.findall(text))
    n = len(hashed)
    size = min(size, n)
    if not size:
        return np.empty(0, np.uint64)
    whole = np.zeros(n - size + 1, np.uint64)
    for k in range(size):
        whole = (whole ^ hashed[k : n - size + 1 + k]) * _MIX
        whole ^= whole >> np.uint64(29)
    return np.unique(whole)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One byte per permutation and set: a hash of the set's smallest element under it."""
    out = np.zeros((len(sets), len(_FACTORS)), np.uint8)
    full = [k for k, s in enumerate(sets) if len(s)]
    at = 0
    while at < len(full):
        some, total = [], 0
        while at < len(full) and (not some or total + len(sets[full[at]]) <= _CHUNK):
            some.append(full[at])
            total += len(sets[full[at]])
            at += 1
        x = np.concatenate([sets[k] for k in some])
        starts = np.cumsum([0, *[len(sets[k]) for k in some[:-1]]])
        low = np.empty((len(_FACTORS), len(some)), np.uint64)
        for j, factor in enumerate(_FACTORS):
            low[j] = np.minimum.reduceat(x * factor, starts)
        low ^= low >> np.uint64(31)
        out[some] = ((low * _MIX) >> np.uint64(56)).astype(np.uint8).T
    return out


def signed(docs: DataFrame, size: int, with_shingles: bool) -> DataFrame:
    """(doc_id, set_id, n_shingles, signature, shingles, text_key) of every row; rows with equal sets share the set_id."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 256):
                    some = batch.slice(at, 256)
                    sets = [shingles_of(t, size) for t in some.column(1).to_pylist()]
                    held = signatures(sets)
                    for doc, own, sig, key in zip(some.column(0).to_pylist(), sets, held, some.column(2).to_pylist(), strict=True):
                        raw = own.tobytes()
                        yield doc, xxhash.xxh3_128_digest(raw), len(own), sig.tobytes(), raw if with_shingles else None, key

        yield from batches_of_rows(each(), SIGNED_ARROW, 512)
        _known.clear()  # the worker lives on

    columns = "doc_id long, set_id binary, n_shingles long, signature binary, shingles binary, text_key long"
    return docs.select("doc_id", text_of().alias("text"), _text_key()).mapInArrow(rows, columns)


def _text_key() -> Column:
    """Tells rows of one doc_id apart by their text."""
    return F.xxhash64(text_of()).alias("text_key")


def matched_depth(similarity: float, recall: float) -> int:
    """How short a prefix that two signatures share in one of the trees must become.

    Starts at the full depth and shortens until a pair right at ``similarity`` is found
    with probability ``recall`` at least; pairs above it are found more surely. ValueError
    where a prefix of one byte does not reach that.
    """
    depth = DEPTH
    while depth > 1 and 1 - (1 - similarity**depth) ** TREES < recall:
        depth -= 1
    if 1 - (1 - similarity**depth) ** TREES < recall:
        raise ValueError(f"{TREES} trees do not reach a recall of {recall} at a similarity of {similarity}")
    return depth


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[list[tuple]]:
    """Runs of rows that agree in the first ``keys`` columns, across batches."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if held and held[0][:keys] != row[:keys]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _blocks(df: DataFrame, n: Column) -> DataFrame:
    """Adds block pairs: a group is cut into ``n`` blocks, and each row goes to every pair its block is in."""
    own = F.pmod(F.xxhash64("set_id", F.lit(5)), n).cast("int")
    cut = df.withColumn("_n", n).withColumn("_own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("_n") - 1))
    paired = cut.withColumn("_other", other)
    return paired.withColumns({"low": F.least("_own", "_other"), "high": F.greatest("_own", "_other")}).drop("_n", "_other")


EDGE_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary())])
LINK_ARROW = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64())])


def _edge(a: bytes, b: bytes) -> tuple[bytes, bytes]:
    return (a, b) if a < b else (b, a)


def _joined(sig: np.ndarray, part: np.ndarray, least: int) -> Iterator[tuple[int, int]]:
    """Edges that join parts of some sets: pairs of different parts whose signatures agree in ``least`` places. Updates ``part``."""
    for k in range(len(sig) - 1):
        others = np.flatnonzero(part[k + 1 :] != part[k]) + k + 1
        if not len(others):
            continue
        near = others[(sig[others] == sig[k]).sum(1) >= least]
        for j in near.tolist():
            if part[j] != part[k]:
                part[part == part[j]] = part[k]
                yield k, j


def _trie(least: int, depth: int):
    """Per trie of (bucket, block, label, set_id, signature), sorted by label: edges of alike sets, the longest prefixes first.

    The sets of a trie share ``depth`` bytes. Those that share all their label are compared
    first; then matched prefixes are shortened a byte at a time, and only sets that are not
    yet joined are compared. A trie that is one part already is shortened no more.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for group in _groups(batches, 2):
                if len(group) < 2:
                    continue
                sig = np.frombuffer(b"".join([r[4] for r in group]), np.uint8).reshape(len(group), -1)
                part = np.arange(len(group))
                for length in range(DEPTH, depth - 1, -1):
                    cuts = [k for k in range(1, len(group)) if group[k][2][:length] != group[k - 1][2][:length]]
                    for low, high in zip([0, *cuts], [*cuts, len(group)], strict=True):
                        own = part[low:high]
                        if high - low < 2 or (own == own[0]).all():
                            continue
                        for a, b in _joined(sig[low:high], own, least):  # parts lie in one node each, as longer prefixes did
                            yield _edge(group[low + a][3], group[low + b][3])
                    if (part == part[0]).all():
                        break

        yield from batches_of_rows(each(), EDGE_ARROW, 16_384)

    return rows


def _late(least: int):
    """Per block of a trie (bucket, block, asks, root, signature), those that only ask last: edges between roots of alike sets.

    The block's own sets are held, and the sets that ask pass by one batch at a time.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            key, held, sig = None, [], None
            for batch in batches:
                for bucket, block, asks, root, signature in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if (bucket, block) != key:
                        key, held, sig = (bucket, block), [], None
                    if not asks:
                        held.append((root, signature))
                        continue
                    if not held:
                        continue
                    if sig is None:
                        sig = np.frombuffer(b"".join([s for _, s in held]), np.uint8).reshape(len(held), -1)
                    near = np.flatnonzero((sig == np.frombuffer(signature, np.uint8)).sum(1) >= least)
                    for other in {held[k][0] for k in near.tolist()} - {root}:
                        yield _edge(root, other)

        yield from batches_of_rows(each(), EDGE_ARROW, 16_384)

    return rows


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by 0/1 matrices of a few thousand elements at a time."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    element = np.unique(flat, return_inverse=True)[1]
    often = np.bincount(element) > 1
    owner, element = owner[often[element]], element[often[element]]
    out = np.zeros((len(sets), len(sets)), np.float32)
    if not len(element):
        return out
    element = np.unique(element, return_inverse=True)[1]
    order = np.argsort(element, kind="stable")
    owner, element = owner[order], element[order]
    for at in range(0, int(element[-1]) + 1, 4096):
        low, high = np.searchsorted(element, [at, at + 4096])
        own = np.zeros((len(sets), 4096), np.float32)
        own[owner[low:high], element[low:high] - at] = 1
        out += own @ own.T
    return out


def _parts(linked: np.ndarray, part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Edges of a link matrix that join different parts; updates ``part``."""
    for k in range(len(part)):
        near = np.flatnonzero(linked[k] & (part != part[k]))
        for j in near.tolist():
            if part[j] != part[k]:
                part[part == part[j]] = part[k]
                yield k, j


def _verified(similarity: float):
    """Per cluster (and block pair): links of exact similarity, counted per set, and edges that join its parts.

    Two blocks report only the edges that join parts which neither block joins by itself.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for group in _groups(batches, 3):
                members = list({r[4]: r for r in group}.values())
                if len(members) < 2:
                    continue
                low, high = members[0][1:3]
                ids = [r[4] for r in members]
                sets = [np.frombuffer(r[5], np.uint64) for r in members]
                copies = np.array([r[6] for r in members], np.int64)
                sizes = np.array([len(s) for s in sets], np.float64)
                both = _shared(sets).astype(np.float64)
                linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
                np.fill_diagonal(linked, False)
                part, across = np.arange(len(members)), linked
                if low != high:
                    block = np.array([r[3] for r in members])
                    apart = block[:, None] != block[None, :]
                    for _ in _parts(linked & ~apart, part):
                        pass
                    across = linked & apart
                counts = across @ copies
                for k in np.flatnonzero(counts):
                    yield ids[k], None, int(counts[k])
                for a, b in _parts(across, part):
                    yield (*_edge(ids[a], ids[b]), None)

        yield from batches_of_rows(each(), LINK_ARROW, 16_384)

    return rows


def classes(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.9999, bucket: int = TRIE_SETS, cluster: int = BLOCK_SETS,
) -> DataFrame:
    """One row per input row: (doc_id, class_id, n_links).

    Documents are linked when the Jaccard similarity of their sets of ``size``-word
    shingles (all words as one shingle where there are fewer) is ``similarity`` or more.
    n_links counts the other rows a row is linked to, copies included; class_id is the
    smallest doc_id of everything reachable over links.

    Rows with equal sets are one set from the start. Each set has a signature of one byte
    per MinHash permutation, and stands in ``TREES`` tries under labels of ``DEPTH`` bytes.
    A trie is sorted by its labels: sets under one full label are compared first, then
    matched prefixes are shortened byte by byte, for the sets that are not joined yet, until
    ``matched_depth`` reaches the target recall. Sets that meet and agree in enough bytes of
    the whole signature (nine standard deviations below what the threshold gives) are joined
    into one cluster, and within a cluster every pair is compared exactly on its shingles.

    A trie of more than ``bucket`` sets under one shortest prefix is cut into blocks that are
    joined by themselves; where several parts are left, the sets outside the largest part
    pass by every block. Clusters are cut into blocks of ``cluster`` sets (and a number of
    shingles), and their block pairs spread over tasks: no cap, no sampling, and no pair is
    ever written out; a task reports link counts and the edges that join what was apart.

    A null text has no shingles; rows without shingles are copies of each other. Repeated
    rows are copies too. A class without any doc_id has a null class_id. An empty table
    gives no rows. Other columns are ignored.
    """
    return _classes(docs, size, similarity, recall, bucket, cluster).select("doc_id", "class_id", "n_links")


def _clusters(sets: DataFrame, least: int, depth: int, bucket: int) -> DataFrame:
    """(node, component) of the sets that the forest joins."""
    prefixes = F.array(*[
        F.struct(F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("signature", t * DEPTH + 1, depth)).alias("bucket")) for t in range(TREES)
    ])
    leaves = sets.select("set_id", F.inline(prefixes))
    shared = stage(leaves.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    met = leaves.join(shared, "bucket").join(sets.select("set_id", "signature"), "set_id")
    blocks = F.ceil(F.col("size") / bucket)
    label = F.expr(f"substring(signature, tree * {DEPTH} + 1, {DEPTH})")
    met = met.select(
        "bucket", F.pmod(F.xxhash64("set_id", "bucket"), blocks).alias("block"), label.alias("label"), "set_id", "signature", "size"
    )
    large = shared.filter(F.col("size") > bucket)
    crowded = not large.isEmpty()
    met = stage(met, "tries") if crowded else met
    edges = stage(
        met.drop("size").repartition("bucket", "block").sortWithinPartitions("bucket", "block", "label", "set_id")
        .mapInArrow(_trie(least, depth), "a binary, b binary").distinct(), "alike",
    )
    known = stage(components(edges), "clusters")
    if not crowded:
        return known
    roots = known.select(F.col("node").alias("set_id"), F.col("component").alias("root"))
    held = stage(
        met.filter(F.col("size") > bucket).join(roots, "set_id", "left").withColumn("root", F.coalesce("root", "set_id")).drop("label", "set_id"),
        "crowded-tries",
    )
    parts = held.groupBy("bucket", "root").agg(F.count("*").alias("n"))
    most = parts.groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("most"), F.count("*").alias("parts")).filter("parts > 1")
    apart = held.join(stage(most.drop("parts"), "parts"), "bucket")
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("size") / bucket) - 1))
    asking = apart.filter("root <> most").withColumn("block", every).withColumn("asks", F.lit(True))
    both = apart.withColumn("asks", F.lit(False)).unionByName(asking).select("bucket", "block", "asks", "root", "signature")
    late = stage(
        both.repartition("bucket", "block").sortWithinPartitions("bucket", "block", "asks").mapInArrow(_late(least), "a binary, b binary").distinct(),
        "alike-late",
    )
    if late.isEmpty():
        return known
    return components(edges.unionByName(late))


def _classes(
    docs: DataFrame, size: int = 5, similarity: float = 0.8, recall: float = 0.9999, bucket: int = TRIE_SETS, cluster: int = BLOCK_SETS,
) -> DataFrame:
    """``classes`` with text_key, and class_set, which tells classes apart that share a class_id."""
    rows = stage(signed(docs, size, False).drop("shingles"), "signatures")
    sets = stage(
        rows.groupBy("set_id").agg(
            F.min("doc_id").alias("first_id"), F.count("*").alias("copies"), F.first("signature").alias("signature"), F.first("n_shingles").alias("n_shingles")
        ),
        "sets",
    )
    places = TREES * DEPTH
    least = int(places * similarity - 9 * (places * similarity * (1 - similarity)) ** 0.5)
    clusters = stage(_clusters(sets, least, matched_depth(similarity, recall), bucket), "clusters")
    members = clusters.withColumnRenamed("node", "set_id").join(sets.drop("signature"), "set_id")
    members = stage(members, "cluster-members")
    blocks = F.ceil(F.greatest(F.count("*") / cluster, F.sum("n_shingles") / BLOCK_SHINGLES)).cast("int")
    sizes = stage(members.groupBy("component").agg(blocks.alias("blocks")), "cluster-sizes")
    chosen = docs.select("doc_id", "text").join(
        members.select(F.col("first_id").alias("_first")).distinct(), F.col("doc_id").eqNullSafe(F.col("_first")), "left_semi"
    )
    texts = signed(chosen, size, True).select("set_id", "shingles").dropDuplicates(["set_id"])
    held = _blocks(members.join(sizes, "component").join(texts, "set_id"), F.col("blocks"))
    links = stage(
        held.select("component", "low", "high", "_own", "set_id", "shingles", "copies").repartition("component", "low", "high")
        .sortWithinPartitions("component", "low", "high").mapInArrow(_verified(similarity), "a binary, b binary, n long"),
        "links",
    )
    joined = stage(components(links.filter("b is not null").select("a", "b")), "classes-joined")
    named = joined.join(sets.select(F.col("set_id").alias("node"), "first_id"), "node")
    least_id = named.groupBy("component").agg(F.min("first_id").alias("class_id"))
    of_set = joined.join(least_id, "component").select(F.col("node").alias("set_id"), "class_id", F.col("component").alias("class_set"))
    counts = links.filter("b is null").groupBy(F.col("a").alias("set_id")).agg(F.sum("n").alias("n"))
    known = sets.join(of_set, "set_id", "left").join(counts, "set_id", "left").select(
        "set_id", F.coalesce("class_id", "first_id").alias("class_id"), F.coalesce("class_set", "set_id").alias("class_set"),
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
    )
    return rows.select("doc_id", "set_id", "text_key").join(stage(known, "classes"), "set_id")


def one_of_each_class(docs: DataFrame, **settings) -> DataFrame:
    """One row of every class of ``docs``, with its columns.

    A class keeps the row with its smallest doc_id, or any of its rows if none has one.
    Where several rows of the class have that doc_id one stays, chosen by a hash of its
    text, then of its other columns, so reruns agree.
    """
    known = _classes(docs, **settings).groupBy("class_set", "doc_id", "text_key").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("_class_id"), F.col("text_key").alias("_text_key"), "n"))
    kept = stage(known.groupBy("class_set").agg(first.alias("first")).select("first.*"), "class-firsts")
    own = F.col("doc_id").eqNullSafe(F.col("_class_id")) & (F.xxhash64(text_of()) == F.col("_text_key"))
    others = [c for c, kind in docs.dtypes if c != "text" and "map<" not in kind]
    repeated = docs.join(kept.filter("n > 1").drop("last", "n"), own)
    one = top_per_key(repeated, ["_class_id", "_text_key"], 1, F.xxhash64(*others)).select(*docs.columns)
    return docs.join(kept.filter("n = 1").drop("last", "n"), own, "left_semi").unionByName(one)
