"""Repeated byte strings across a corpus: bucketed suffix arrays and their common-prefix intervals."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, stage, text_of

#: A stretch is the bytes covered by a run of windows that share one anchor.
STRETCH_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("size", pa.int32()), ("anchor", pa.int64()), ("content", pa.int64()),
])
STRETCH = "doc_id long, row long, start long, size int, anchor long, content long"
#: With the byte before the stretch, -1 at the start of a text.
LED_ARROW = STRETCH_ARROW.append(pa.field("lead", pa.int32()))
LED = f"{STRETCH}, lead int"
#: Distinct stretches of an anchor in one task. By measured memory: 1,024 near copies of one passage are what one task may hold, see the README.
BUCKET = 1024
_CUTS = 8  # ranges that the windows of a hot anchor are dealt into, and each of them again
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_BATCH = 1 << 20  # bytes hashed at once


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def grown(factor: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        done, power = 1, factor
        while done < n:
            more = min(done, n - done)
            out[done : done + more] = out[:more] * np.uint64(power)
            done += more
            power = power * power & _MASK
        return out

    return grown(_BASE), grown(pow(_BASE, -1, 1 << 64))


def _gram_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A mixed 64-bit hash of the ``k`` bytes at every position."""
    up, down = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    h = (sums[k:] - sums[:-k]) * down[: len(data) - k + 1]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by minima from both ends of blocks."""
    n = len(values)
    blocks = -(-n // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    padded = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(padded, axis=1).reshape(-1)
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def _anchors(data: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of the anchor of the window at every position, and the gram hashes.

    The anchor of a window is its gram with the smallest hash (by the upper half), the
    first of equals. Equal windows have equal anchors at equal distances, wherever they lie.
    """
    hashes = _gram_hashes(data, gram)
    half = np.uint64(32)
    packed = ((hashes >> half) << half) | np.arange(len(hashes), dtype=np.uint64)
    return (_window_minima(packed, window - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64), hashes


def _edges(anchors: np.ndarray) -> list[int]:
    return [0, *(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1).tolist()]


def _stretches(texts: list[bytes], window: int, gram: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(text, start, size, anchor hash, content hash) of each run of windows with the same anchor.

    Texts are hashed together up to a size, longer ones alone and a part at a time.
    """
    digest = xxhash.xxh3_64_intdigest
    long = [k for k, t in enumerate(texts) if len(t) > _BATCH]
    short = [k for k, t in enumerate(texts) if window <= len(t) <= _BATCH]
    if short:
        joined = b"".join([texts[k] for k in short])
        anchors, hashes = _anchors(np.frombuffer(joined, np.uint8), window, gram)
        first = 0
        for k in short:
            n = len(texts[k]) - window + 1
            own = anchors[first : first + n]
            edges = [*_edges(own), n]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                size = high - low + window - 1
                at = first + low
                yield k, low, size, int(hashes[own[low]]), digest(joined[at : at + size])
            first += len(texts[k])
    for k in long:
        text, n = texts[k], len(texts[k]) - window + 1
        start, anchor, code = 0, -1, 0
        for at in range(0, n, _BATCH):
            count = min(_BATCH, n - at)
            own, hashes = _anchors(np.frombuffer(text, np.uint8, count + window - 1, at), window, gram)
            for low in _edges(own[:count]):
                place = at + int(own[low])
                if place != anchor:
                    if anchor >= 0:
                        yield k, start, at + low - start + window - 1, code, digest(text[start : at + low + window - 1])
                    start, anchor, code = at + low, place, int(hashes[own[low]])
        yield k, start, n - start + window - 1, code, digest(text[start:])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def stretches(docs: DataFrame, window: int, gram: int, led: bool = False) -> DataFrame:
    """Stretches of every text; ``row`` tells rows of one doc_id apart by their text. ``led`` adds the byte before them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                ids, texts, held, size = [], [], [], 0
                for k in range(batch.num_rows):
                    ids.append(batch.column(0)[k].as_py())
                    held.append(batch.column(2)[k].as_py())
                    texts.append(batch.column(1)[k].as_py())
                    size += len(texts[-1])
                    if size >= _BATCH or k == batch.num_rows - 1:
                        for t, start, n, anchor, content in _stretches(texts, window, gram):
                            lead = ((texts[t][start - 1] if start else -1),) if led else ()
                            yield ids[t], held[t], start, n, _signed(anchor), _signed(content), *lead
                        ids, texts, held, size = [], [], [], 0

        yield from batches_of_rows(each(), LED_ARROW if led else STRETCH_ARROW, 16_384)

    return docs.select("doc_id", "bytes", "row").mapInArrow(rows, LED if led else STRETCH)


def intervals(suffixes: list[bytes], leads: list[int], least: int) -> list[tuple[int, list[int]]]:
    """Maximal repeats among some suffixes, as (length, members), by one scan of their suffix array.

    The suffixes are sorted and the common prefixes of neighbours taken; a stack of open
    intervals yields the interval tree. An interval whose members differ in the byte before
    them (``leads``; -1 differs from everything) cannot be extended to the left: it is a
    maximal repeat, and all its occurrences are reported. The others show up, longer, at
    the suffixes one byte earlier.
    """
    order = sorted(range(len(suffixes)), key=suffixes.__getitem__)
    common = [0] * (len(order) + 1)
    for k in range(1, len(order)):
        a, b = suffixes[order[k - 1]], suffixes[order[k]]
        n = min(len(a), len(b))
        if a[:n] != b[:n]:
            differ = np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)
            n = int(differ.argmax())
        common[k] = n if n >= least else 0
    # An open interval: its depth, its first place, and the byte before all its members (None: they differ).
    found, stack = [], []
    for k in range(1, len(order) + 1):
        depth, first, left = common[k], k - 1, leads[order[k - 1]]
        left = None if left < 0 else left
        while stack and stack[-1][0] > depth:
            d, f, own = stack.pop()
            own = own if own == left else None
            if own is None:
                found.append((d, [order[j] for j in range(f, k)]))
            first, left = f, own
        if stack and stack[-1][0] == depth:
            stack[-1][2] = stack[-1][2] if stack[-1][2] == left else None
        elif depth:
            stack.append([depth, first, left])
    return found


CUT_ARROW = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("bytes", pa.binary()), ("n", pa.int64()),
    ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()),
])
CUT = "anchor long, content long, bytes binary, n long, doc_id long, row long, at long"
REPEAT_ARROW = pa.schema([
    ("anchor", pa.int64()), ("content", pa.int64()), ("n", pa.int64()), ("doc_id", pa.int64()), ("row", pa.int64()), ("at", pa.int64()),
    ("inner", pa.int64()), ("length", pa.int32()), ("repeat_id", pa.int64()),
])
REPEAT = "anchor long, content long, n long, doc_id long, row long, at long, inner long, length int, repeat_id long"
PIECE_ARROW = CUT_ARROW.append(pa.field("pin", pa.int32()))
PIECE = f"{CUT}, pin int"


def _repeats_of(group: list[tuple], window: int) -> Iterator[tuple]:
    """The longest repeat at every place of one anchor's distinct stretches that are found once."""
    blobs = [r[2] for r in group]
    flat = np.frombuffer(b"".join(blobs), np.uint8)
    sizes = np.array([len(b) for b in blobs])
    hashes = _gram_hashes(flat, window)
    begins = np.cumsum(sizes) - sizes
    counts = sizes - window + 1
    place = np.concatenate([np.arange(b, b + n) for b, n in zip(begins, counts, strict=True)])
    owner = np.repeat(np.arange(len(group)), counts)
    kind, many = np.unique(hashes[place], return_inverse=True, return_counts=True)[1:]
    keep = many[kind] > 1
    place, owner, kind = place[keep], owner[keep], kind[keep]
    if not len(place):
        return
    inner = place - begins[owner]
    lead = np.where(inner > 0, flat[place - 1].astype(np.int64), -1)
    # Windows all preceded by one byte are found longer one byte earlier: only the others open intervals.
    kinds = np.unique(kind, return_inverse=True)[1]
    low = np.full(kinds.max() + 1, 1 << 10)
    high = np.full(kinds.max() + 1, -1)
    np.minimum.at(low, kinds, lead)
    np.maximum.at(high, kinds, lead)
    open_ = (low != high)[kinds] | (low < 0)[kinds]
    owner, inner, lead = owner[open_], inner[open_], lead[open_]
    suffixes = [blobs[o][i:] for o, i in zip(owner.tolist(), inner.tolist(), strict=True)]
    told: set[int] = set()
    for length, members in intervals(suffixes, lead.tolist(), window):  # the inner ones, which are longer, come first
        name = _signed(xxhash.xxh3_64_intdigest(suffixes[members[0]][:length]))
        for m in members:
            anchor, content, _, n, doc, row, at = group[owner[m]]
            if n > 1 or m in told:
                continue
            told.add(m)
            yield anchor, content, n, doc, row, at, int(inner[m]), length, name


def _tree(window: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if held and held[0][0] != row[0]:
                        if len(held) > 1:
                            yield from _repeats_of(held, window)
                        held = []
                    held.append(row)
            if len(held) > 1:
                yield from _repeats_of(held, window)

        yield from batches_of_rows(each(), REPEAT_ARROW, 16_384)

    return rows


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the chosen stretches of each document, with their place."""

    def each() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, row, data, cuts = (c[k].as_py() for c in batch.columns)
                for s in cuts:
                    yield s["anchor"], s["content"], data[s["start"] : s["start"] + s["size"]], s["n"], doc, row, s["start"]

    yield from batches_of_rows(each(), CUT_ARROW, 4096)


def _pin(data: bytes, window: int, gram: int) -> int:
    """Place of the anchor in a stretch: that of its first window, and so of all."""
    hashes = _gram_hashes(np.frombuffer(data, np.uint8, window), gram)
    return int((hashes >> np.uint64(32)).argmin())


def _pieces(window: int, gram: int, width: int):
    """Stretches cut at the same distances from their anchors: pieces that can share a window stay together.

    A window begins some bytes before the anchor, fewer than ``window - gram + 1``. Windows
    are dealt by that distance into ranges of ``width``; all windows of a range have the
    bytes in their middle in common, so equal windows lie in pieces of one range with equal
    middles, which become the new key.
    ``pin`` is the place of the anchor in a piece, null in a whole stretch.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            digest = xxhash.xxh3_64_intdigest
            for batch in batches:
                for anchor, _, data, n, doc, row, at, pin in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    pin = _pin(data, window, gram) if pin is None else pin
                    least, most = max(0, pin - (len(data) - window)), pin  # distances of the last and the first window
                    for k in range(least // width, most // width + 1):
                        start, stop = pin - min(most, (k + 1) * width - 1), pin - max(least, k * width) + window
                        middle = data[pin - k * width : pin - (k + 1) * width + 1 + window]
                        piece = data[start:stop]
                        key = digest(b"%d %d %d " % (anchor, width, k) + middle)
                        yield _signed(key), _signed(digest(piece)), piece, n, doc, row, at + start, pin - start

        yield from batches_of_rows(each(), PIECE_ARROW, 4096)

    return rows


#: A window that starts a maximal repeat, at its place in a distinct stretch; ``class`` names its bytes, ``lead`` the byte before it in the stretch.
OPEN_ARROW = pa.schema([("anchor", pa.int64()), ("content", pa.int64()), ("inner", pa.int64()), ("class", pa.binary()), ("lead", pa.int32())])
OPEN = "anchor long, content long, inner long, class binary, lead int"
LED_WINDOW_ARROW = pa.schema([*list(OPEN_ARROW)[:4], ("n", pa.int64()), ("low", pa.int32()), ("high", pa.int32())])
LED_WINDOW = "anchor long, content long, inner long, class binary, n long, low int, high int"
#: What follows a start: at most so many bytes at once, ``ends`` where the text does.
NEXT_ARROW = pa.schema([
    ("class", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("start", pa.int64()), ("lead", pa.int32()), ("n", pa.int64()),
    ("bytes", pa.binary()),
])
NEXT = "class binary, doc_id long, row long, start long, lead int, n long, bytes binary"
NODE_ARROW = pa.schema([
    *[f for f in NEXT_ARROW if f.name not in ("lead", "bytes", "class")], ("length", pa.int64()), ("repeat_id", pa.int64()),
])
NODE = "doc_id long, row long, start long, n long, length long, repeat_id long"
STEP_ARROW = pa.schema([("prefix", pa.binary()), ("length", pa.int64()), ("repeat_id", pa.int64()), ("next", pa.int32()), *list(NEXT_ARROW)[1:6]])
STEP = "prefix binary, length long, repeat_id long, next int, doc_id long, row long, start long, lead int, n long"
_FIRST, _MOST = 256, 1 << 20


def _led_windows(group: list[tuple], window: int) -> Iterator[tuple]:
    """Every window of distinct stretches (anchor, content, bytes, n, low, high), with the bytes before it: lowest and highest."""
    for anchor, content, data, n, low, high in group:
        for k in range(len(data) - window + 1):
            if k:
                low = high = data[k - 1]
            yield anchor, content, k, xxhash.xxh3_128_digest(data[k : k + window]), n, low, high


def _open_of(group: list[tuple], window: int) -> Iterator[tuple]:
    """Of one anchor's windows, those found twice that different bytes come before."""
    known: dict[bytes, list[int]] = {}
    for *_, code, n, low, high in _led_windows(group, window):
        held = known.setdefault(code, [0, low, high])
        held[0], held[1], held[2] = held[0] + n, min(held[1], low), max(held[2], high)
    for anchor, content, inner, code, _, lead, _ in _led_windows(group, window):
        n, low, high = known[code]
        if n > 1 and (low < high or low < 0):
            yield anchor, content, inner, code, lead if inner else None


def _name(code: bytes, prefix: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(code + prefix))


def _nodes_of(group: list[tuple], depth: int, block: int) -> Iterator[tuple]:
    """Maximal repeats of a class of starts that agree in ``depth`` bytes and end within the next ``block``."""
    # A byte before every block makes what they all share an interval too; two places tell all that more copies would.
    owners = [k for k, r in enumerate(group) for _ in range(min(r[5], 2))]
    suffixes = [b"\0" + group[k][6] for k in owners]
    for length, members in intervals(suffixes, [group[k][4] for k in owners], 1):
        if length <= block:
            name = _name(group[0][0], suffixes[members[0]][1:length])
            for k in {owners[m] for m in members}:
                yield *group[k][1:4], group[k][5], depth + length - 1, name


def _per_group(work, schema: pa.Schema):
    """Runs ``work`` on each run of rows that agree in the first column."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            held: list[tuple] = []
            for batch in batches:
                for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    if held and held[0][0] != row[0]:
                        yield from work(held)
                        held = []
                    held.append(row)
            if held:
                yield from work(held)

        yield from batches_of_rows(each(), schema, 4096)

    return rows


def _next_bytes(depth: int, block: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    doc, row, data, starts = (c[k].as_py() for c in batch.columns)
                    for s in starts:
                        at = s["start"] + depth
                        yield s["class"], doc, row, s["start"], s["lead"], s["n"], data[at : at + block]

        yield from batches_of_rows(each(), NEXT_ARROW, 1024)

    return rows


def _steps(depth: int, block: int):
    """Every prefix of what follows a start, with the byte after it (-1 where the text ends)."""

    def work(group: list[tuple]) -> Iterator[tuple]:
        for code, *place, data in group:
            for k in range(min(len(data), block - 1) + 1):
                after = data[k] if k < len(data) else -1
                yield xxhash.xxh3_128_digest(code + data[:k]), depth + k, _name(code, data[:k]), after, *place

    return _per_group(work, STEP_ARROW)


def _is_open() -> Column:
    """Of groups with n, low and high: two places or more that cannot all be extended to the left."""
    return (F.col("n") > 1) & ((F.col("low") < F.col("high")) | (F.col("low") < 0))


def repeats(docs: DataFrame, window: int = 400, gram: int = 64, bucket: int = BUCKET) -> DataFrame:
    """All maximal repeated byte strings of ``window`` bytes or more: (doc_id, row, start, length, repeat_id).

    A string found at two places or more is maximal if the bytes before its places differ,
    and those after them, where the start and the end of a text differ from everything.
    Every row is an occurrence, start counted in bytes of its document; occurrences of one
    string share the repeat_id. Repeated rows are other places. See ``without_repeats`` for
    the other edge cases.

    A window's anchor (its gram of ``gram`` bytes with the smallest hash) depends on the
    window alone, so equal windows meet under equal anchors. The windows of one anchor form
    a stretch; stretches are counted by content with the bytes before them, so exact copies
    cost one row each. A maximal repeat starts at a window that is found twice behind
    different bytes, in whichever stretch. From these starts on, the texts are compared a
    block at a time, each round twice as long (up to 1 MB), as far as two of them agree: the
    common-prefix intervals of a block's suffix array with diverse left extensions are the
    maximal repeats that end in it, so their length has no limit.

    Where an anchor has more than ``bucket`` distinct stretches, or a class of equal starts
    more than ``bucket`` places, that is not one task's work: windows, or prefixes of the
    block, are spread by content instead and counted after folding, with the same result.
    The result is as large as the places of all maximal repeats together, which grows with
    the square of the length of a run of one byte.
    """
    raw = docs.select("doc_id", text_of().cast("binary").alias("bytes")).withColumn("row", F.xxhash64("bytes"))
    texts = stage(raw.dropDuplicates(["doc_id", "row"]), "repeat-texts")
    parts, depth, block = [], window, _FIRST
    starts = _starts(raw, texts, window, gram, bucket)
    while not starts.isEmpty():
        asked = starts.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(
            F.collect_list(F.struct("class", "start", "lead", "n")).alias("starts")
        )
        one = texts.join(asked, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
        after = stage(one.select("doc_id", "row", "bytes", "starts").mapInArrow(_next_bytes(depth, block), NEXT), "repeat-blocks")
        sizes = after.groupBy("class").agg(F.count("*").alias("places"))
        few, many = (sizes.filter(c).select("class") for c in (F.col("places") <= bucket, F.col("places") > bucket))
        inside = (
            after.join(few, "class", "left_semi").select(*NEXT_ARROW.names).repartition("class").sortWithinPartitions("class")
            .mapInArrow(_per_group(lambda g, d=depth, b=block: _nodes_of(g, d, b), NODE_ARROW), NODE)
        )
        hot = stage(after.join(many, "class", "left_semi").select(*NEXT_ARROW.names), "repeat-hot")
        parts.append(stage(inside.unionByName(_spread_nodes(hot, depth, block)), "repeat-nodes"))
        full = after.filter(F.octet_length("bytes") == block).withColumn(
            "class", F.unhex(F.md5(F.concat("class", "bytes")))
        ).drop("bytes")
        open_ = full.groupBy("class").agg(F.sum("n").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high")).filter(_is_open())
        starts = stage(full.join(open_.select("class"), "class", "left_semi"), "repeat-starts")
        depth, block = depth + block, min(2 * block, _MOST)
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], NODE)
    for part in parts[1:]:
        found = found.unionByName(part)
    every = found.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    return every.select("doc_id", "row", "start", "length", "repeat_id")


def _starts(raw: DataFrame, texts: DataFrame, window: int, gram: int, bucket: int) -> DataFrame:
    """(class, doc_id, row, start, lead, n) of the windows found twice behind different bytes; n counts equal rows."""
    found = stage(stretches(raw, window, gram, True), "stretches")
    twice = found.groupBy("anchor").agg(F.count("*").alias("m")).filter("m > 1").select("anchor")
    live = found.join(stage(twice, "anchors-twice"), "anchor", "left_semi")
    live = stage(live.groupBy("doc_id", "row", "start", "size", "anchor", "content", "lead").agg(F.count("*").alias("n")), "stretches-met")
    kinds = stage(live.groupBy("anchor", "content").agg(
        F.sum("n").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high"), F.min(F.struct("doc_id", "row", "start", "size")).alias("first"),
    ), "stretch-kinds")
    # A single content that one byte comes before is found longer in the stretch before.
    anchors = stage(kinds.groupBy("anchor").agg(
        F.count("*").alias("kinds"), F.min("low").alias("_low"), F.max("high").alias("_high")
    ).filter("kinds > 1 or _low < _high or _low < 0").select("anchor", "kinds"), "stretch-anchors")
    cuts = F.struct("anchor", "content", "n", "low", "high", F.col("first.start").alias("start"), F.col("first.size").alias("size"))
    wanted = kinds.join(anchors, "anchor").groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.row").alias("_row")).agg(
        F.collect_list(cuts).alias("cuts")
    )
    one = texts.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
    one = one.select("bytes", F.explode("cuts").alias("cut")).select("cut.*", "bytes")
    cut = stage(one.select(
        "anchor", "content", F.expr("substring(bytes, cast(start + 1 as int), size)").alias("bytes"), "n", "low", "high"
    ), "stretch-bytes")
    few, many = (anchors.filter(c).select("anchor") for c in (F.col("kinds") <= bucket, F.col("kinds") > bucket))
    near = (
        cut.join(few, "anchor", "left_semi").repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(_per_group(lambda g: _open_of(g, window), OPEN_ARROW), OPEN)
    )
    spread = stage(
        cut.join(many, "anchor", "left_semi").mapInArrow(_per_group(lambda g: _led_windows(g, window), LED_WINDOW_ARROW), LED_WINDOW), "windows"
    )
    hot = spread.groupBy("class").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high")).filter(_is_open())
    far = spread.join(hot.select("class"), "class", "left_semi").withColumn("lead", F.when(F.col("inner") > 0, F.col("low"))).select(*OPEN_ARROW.names)
    places = stage(near.unionByName(far), "open-windows")
    return stage(live.withColumnRenamed("lead", "before").join(places, ["anchor", "content"]).select(
        "class", "doc_id", "row", (F.col("start") + F.col("inner")).alias("start"), F.coalesce("lead", "before").alias("lead"), "n"
    ), "repeat-starts")


def _spread_nodes(hot: DataFrame, depth: int, block: int) -> DataFrame:
    """``_nodes_of`` for classes of many places: prefixes are counted, not sorted."""
    steps = stage(hot.mapInArrow(_steps(depth, block), STEP), "repeat-steps")
    kept = steps.groupBy("prefix").agg(
        F.sum("n").alias("n"), F.min("lead").alias("low"), F.max("lead").alias("high"), F.min("next").alias("_next"), F.max("next").alias("_last")
    ).filter(_is_open() & ((F.col("_next") < F.col("_last")) | (F.col("_next") < 0)))
    return steps.join(kept.select("prefix"), "prefix", "left_semi").select(*NODE_ARROW.names)


def _whole(live: DataFrame, copies: DataFrame) -> DataFrame:
    """Stretches found twice or more."""
    return live.join(copies, ["anchor", "content"], "left_semi").select(
        "doc_id", "row", "start", F.col("size").alias("length"), F.col("content").alias("repeat_id")
    )


def _repeats(docs: DataFrame, window: int, gram: int, bucket: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stretches whose anchor occurs twice, the contents found twice, and the repeats inside distinct stretches."""
    found = stage(stretches(docs, window, gram), "stretches")
    twice = found.groupBy("anchor").agg(F.count("*").alias("n")).filter("n > 1").select("anchor")
    live = stage(found.join(stage(twice, "anchors-twice"), "anchor", "left_semi"), "stretches-met")
    place = F.struct("doc_id", "row", "start", "size")
    kinds = stage(live.groupBy("anchor", "content").agg(F.count("*").alias("n"), F.min(place).alias("first")), "stretch-kinds")
    anchors = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "stretch-anchors")
    wanted = kinds.join(anchors, "anchor").groupBy(F.col("first.doc_id").alias("_doc"), F.col("first.row").alias("_row")).agg(
        F.collect_list(F.struct("anchor", "content", "n", F.col("first.start").alias("start"), F.col("first.size").alias("size"))).alias("cuts")
    )
    one = docs.join(wanted, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")))
    cut = stage(one.select("doc_id", "row", "bytes", "cuts").mapInArrow(_cut, CUT), "stretch-bytes")
    copies = stage(kinds.filter("n > 1").select("anchor", "content"), "stretch-copies")
    trees, hot = _grouped(cut.withColumn("pin", F.lit(None).cast("int")), anchors, window, bucket)
    width = window - gram + 1
    while width > 1 and not hot.isEmpty():
        width = -(-width // _CUTS)
        pieces = stage(hot.select(*PIECE_ARROW.names).mapInArrow(_pieces(window, gram, width), PIECE), "pieces")
        first = F.min(F.struct("doc_id", "row", "at", "pin")).alias("first")
        kinds = stage(pieces.groupBy("anchor", "content").agg(F.sum("n").alias("n"), first, F.first("bytes").alias("bytes")), "piece-kinds")
        twice = kinds.filter("n > 1").select("anchor", "content")
        whole = pieces.filter("n = 1").join(twice, ["anchor", "content"], "left_semi").select(
            *REPEAT_ARROW.names[:6], F.lit(0).cast("long").alias("inner"), F.octet_length("bytes").alias("length"), F.col("content").alias("repeat_id")
        )
        anchors = stage(kinds.groupBy("anchor").agg(F.count("*").alias("kinds")).filter("kinds > 1"), "piece-anchors")
        inside, hot = _grouped(kinds.select("anchor", "content", "bytes", "n", "first.*"), anchors, window, bucket)
        trees = trees.unionByName(whole).unionByName(inside)
    return live, copies, trees


def _grouped(cut: DataFrame, anchors: DataFrame, window: int, bucket: int) -> tuple[DataFrame, DataFrame]:
    """Repeats inside the distinct pieces of each anchor that one task holds, and the pieces of the other anchors."""
    few, many = (anchors.filter(c).select("anchor") for c in (F.col("kinds") <= bucket, F.col("kinds") > bucket))
    trees = (
        cut.join(few, "anchor", "left_semi").select(*CUT_ARROW.names).repartition("anchor").sortWithinPartitions("anchor")
        .mapInArrow(_tree(window), REPEAT)
    )
    return trees, stage(cut.join(many, "anchor", "left_semi"), "hot-pieces")


KEPT_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()),
    ("kept", pa.binary()),
])


def _remove(with_bytes: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in batches:
                for k in range(batch.num_rows):
                    doc, data, spans = (c[k].as_py() for c in batch.columns)
                    left, at, removed, merged = hashlib.sha256(), 0, 0, []
                    for s in sorted(spans or [], key=lambda s: s["start"]):
                        low, high = s["start"], s["start"] + s["length"]
                        if merged and low <= merged[-1][1]:
                            merged[-1][1] = max(high, merged[-1][1])
                        else:
                            merged.append([low, high])
                    parts = []
                    for low, high in merged:
                        parts.append(data[at:low])
                        removed += high - low
                        at = high
                    parts.append(data[at:])
                    for p in parts:
                        left.update(p)
                    yield doc, len(data), removed, len(merged), left.hexdigest(), b"".join(parts) if with_bytes else None

        yield from batches_of_rows(each(), KEPT_ARROW, 1024)

    return rows


def without_repeats(docs: DataFrame, window: int = 400, gram: int = 64, bucket: int = BUCKET, with_bytes: bool = True) -> DataFrame:
    """One row per input row: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept).

    Removed is every byte covered by a string of ``window`` bytes that also starts at
    another place of the table, the same document included; overlaps count, and strings are
    judged on the input. n_spans counts maximal removed runs; ``kept`` is the rest, joined.

    Windows meet under their anchors as in ``repeats``. A stretch found twice is removed as
    a whole; among distinct stretches of one anchor, one copy of each is brought together
    and the repeats are cut off at the ends of the stretches, which covers the same bytes.
    Where an anchor has more than ``bucket`` distinct stretches, all are cut at the same
    distances from the anchor, and pieces meet that agree in their middle; equal pieces are
    folded, and groups that are still too large are cut again, down to single windows. So
    rows grow with distinct pieces, and every group is searched in the same way.

    A null text is empty; texts shorter than ``window`` keep all their bytes. Repeated rows
    are other places, so long texts that occur in two rows go entirely. Null doc_ids are
    allowed. An empty table gives no rows. Other columns are ignored.
    """
    raw = docs.select("doc_id", text_of().cast("binary").alias("bytes")).withColumn("row", F.xxhash64("bytes"))
    live, copies, parts = _repeats(raw, window, gram, bucket)
    inside = parts.select("doc_id", "row", (F.col("at") + F.col("inner")).alias("start"), "length")
    found = _whole(live, copies).drop("repeat_id").unionByName(inside)
    spans = found.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(
        F.collect_set(F.struct("start", "length")).alias("spans")
    )
    spans = stage(spans, "removed-spans")
    joined = raw.join(spans, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row")), "left")
    columns = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.select("doc_id", "bytes", "spans").mapInArrow(_remove(with_bytes), columns)
