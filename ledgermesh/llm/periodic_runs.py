"""Periodic runs of words: common extensions over a difference cover, queried on a harmonic grid."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import WORD, batches_of_rows, text_of

#: A difference cover modulo 31: every difference of two residues is a difference of two members.
PERIOD = 31
COVER = (1, 5, 11, 24, 25, 27)
_MEMBER = np.isin(np.arange(PERIOD), COVER)
#: Steps from residues a and b to the nearest places where both lie in the cover.
_STEPS = np.array([
    [next(k for k in range(PERIOD) if _MEMBER[(a + k) % PERIOD] and _MEMBER[(b + k) % PERIOD]) for b in range(PERIOD)]
    for a in range(PERIOD)
])
_WORD = re.compile(WORD)
_WORDS = 1 << 16  # words of short texts that are searched together
_QUERIES = 1 << 18  # grid places compared at once

RUN_ARROW = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
FOUND_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(RUN_ARROW)), ("collapsed", pa.string()),
])
FOUND = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


class Extensions:
    """Longest common extensions of two places of a sequence.

    Only suffixes at places whose residue is in the cover are sorted, by doubling from
    their first ``PERIOD`` symbols, and only when a comparison first reaches one. Two places
    are compared symbol by symbol up to the nearest places where both are in the cover; from
    there the answer is the minimum of the sorted suffixes' common prefixes between them,
    read off a sparse table.
    """

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = len(symbols)
        # What lies past the end differs from everything, and each such place from the others.
        self.symbols = np.concatenate([symbols, -1 - np.arange(2 * PERIOD, dtype=np.int64)])
        self.table: list[np.ndarray] | None = None

    def _sort(self) -> None:
        places = np.flatnonzero(_MEMBER[np.arange(self.n + PERIOD) % PERIOD])
        self.slot = np.full(self.n + 2 * PERIOD, -1, np.int64)
        self.slot[places] = np.arange(len(places))
        count = len(places)
        after = np.full(count, count, np.int64)  # the sampled place one period on; past the end there is none
        near = places + PERIOD < self.n + PERIOD
        after[near] = self.slot[places[near] + PERIOD]
        # A rank and the next few symbols in one number, as far as 62 bits hold them.
        low = self.symbols.min()
        bits = int(self.symbols.max() - low).bit_length()
        some = max(1, (62 - count.bit_length()) // bits)
        rank = np.zeros(count, np.int64)
        for at in range(0, PERIOD, some):
            for k in range(at, min(PERIOD, at + some)):
                rank = (rank << bits) | (self.symbols[places + k] - low)
            rank = _ranks(rank)
        # ranks[j] tells suffixes apart by their first PERIOD * 2 ** j symbols; steps[j] leads that far on.
        ranks, steps = [rank], [np.append(after, count)]
        while rank.max() + 1 < count:
            further = np.append(rank, -1)[steps[-1][:count]]
            rank = _ranks(rank * (count + 1) + further + 1)
            ranks.append(rank)
            steps.append(steps[-1][steps[-1]])
        self.rank = rank
        order = np.argsort(rank, kind="stable")
        a, b = order[:-1].copy(), order[1:].copy()
        common = np.zeros(max(count - 1, 0), np.int64)
        for level in range(len(ranks) - 1, -1, -1):
            if not len(a):
                break
            known = np.append(ranks[level], -1)
            alike = known[a] == known[b]  # never where a symbol past the end comes in
            common[alike] += PERIOD << level
            a[alike], b[alike] = steps[level][a[alike]], steps[level][b[alike]]
        live = np.arange(len(common))  # less than a period is left of each
        for k in range(PERIOD):
            live = live[self.symbols[places[a[live]] + k] == self.symbols[places[b[live]] + k]]
            if not len(live):
                break
            common[live] += 1
        self.table = [common]
        while 2 * (1 << (len(self.table) - 1)) <= len(common):
            half = 1 << (len(self.table) - 1)
            last = self.table[-1]
            self.table.append(np.minimum(last[:-half], last[half:]))

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at ``a`` and at ``b``, a < b."""
        steps = _STEPS[a % PERIOD, b % PERIOD]
        out = np.zeros(len(a), np.int64)
        live = np.arange(len(a))
        synced = []
        for k in range(PERIOD):
            there = steps[live] == k
            synced.append(live[there])
            live = live[~there]
            live = live[self.symbols[a[live] + k] == self.symbols[b[live] + k]]
            out[live] += 1
            if not len(live):
                break
        met = np.concatenate(synced)
        if len(met):
            if self.table is None:
                self._sort()
            x, y = self.rank[self.slot[a[met] + steps[met]]], self.rank[self.slot[b[met] + steps[met]]]
            low, high = np.minimum(x, y), np.maximum(x, y)
            level = np.frexp((high - low).astype(np.float64))[1] - 1
            for j in np.unique(level):
                own, row = level == j, self.table[j]
                out[met[own]] += np.minimum(row[low[own]], row[high[own] - (1 << int(j))])
        return out


def _ranks(keys: np.ndarray) -> np.ndarray:
    """Dense ranks of numbers."""
    order = np.argsort(keys)
    held = keys[order]
    out = np.empty(len(keys), np.int64)
    out[order] = np.concatenate([[0], np.cumsum(held[1:] != held[:-1])])
    return out


def _grid(sizes: np.ndarray, begins: np.ndarray, least: int, power: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place, period) of every grid place of every period that a run of each text may have.

    A run of period q repeats, one period on, over max(least, power * q) - q words at least,
    so places that far apart cannot miss it.
    """
    longest = sizes // power
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(longest.sum()) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    step = np.maximum(least, power * period) - period
    counts = np.maximum((sizes[text] - period + step - 1) // step, 0)
    edges = np.searchsorted(np.cumsum(counts), np.arange(_QUERIES, counts.sum() + _QUERIES, _QUERIES))
    low = 0
    for high in [*(edges + 1).tolist(), len(counts)]:
        high = min(high, len(counts))
        if low >= high:
            continue
        n = counts[low:high]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(begins[text[low:high]], n) + nth * np.repeat(step[low:high], n), np.repeat(period[low:high], n)
        low = high


def runs_of(texts: list[np.ndarray], least: int, power: int) -> list[list[tuple[int, int, int]]]:
    """Maximal runs (start, length, period) of each sequence of non-negative symbols, by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    spans = sizes + 1  # a symbol of its own ends each text
    begins = np.cumsum(spans) - spans
    total = int(spans.sum())
    symbols = np.empty(total, np.int64)
    owner = np.repeat(np.arange(len(texts)), spans)
    for k, t in enumerate(texts):
        symbols[begins[k] : begins[k] + len(t)] = t
    stops = begins + sizes
    symbols[stops] = -1 - 2 * PERIOD - np.arange(len(texts))
    ahead, behind = Extensions(symbols), Extensions(symbols[::-1].copy())
    found: list[np.ndarray] = []
    for place, period in _grid(sizes, begins, least, power):
        near = symbols[place] == symbols[place + period]
        place, period = place[near], period[near]
        forward = ahead(place, place + period)
        # Words before both places, read in the reversed sequence; a place at the very start has none.
        inner = place > 0
        backward = np.zeros(len(place), np.int64)
        q, p = place[inner], period[inner]
        backward[inner] = behind(total - q - p, total - q)
        length = forward + backward + period
        long = length >= np.maximum(least, power * period)
        found = [_least_periods(np.concatenate([*found, np.stack([place[long] - backward[long], length[long], period[long]])], axis=1))]
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    for runs in found:
        for at, n, q in runs[:, np.lexsort((runs[2], runs[0]))].T.tolist():
            out[owner[at]].append((at - int(begins[owner[at]]), n, q))
    return out


def _least_periods(runs: np.ndarray) -> np.ndarray:
    """Of the periods found for one stretch the smallest; the others are its multiples."""
    runs = runs[:, np.lexsort((runs[2], runs[1], runs[0]))]
    first = np.ones(runs.shape[1], bool)
    first[1:] = (runs[:2, 1:] != runs[:2, :-1]).any(0)
    return runs[:, first]


def collapsed(words: list[str], runs: list[tuple[int, int, int]]) -> list[str]:
    """The words that no run repeats from an earlier period of its own."""
    if not runs:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    return [words[k] for k in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, least: int = 24, power: int = 3) -> DataFrame:
    """One row per input row: (doc_id, n_words, runs, collapsed).

    A run is a stretch of consecutive words of a text with smallest period q (words q apart
    are equal), at least ``least`` and ``power`` * q words long (power 3 or more), that no
    neighbouring word extends keeping period q. ``runs`` holds all of them by start, then
    period, as word numbers from 0. ``collapsed`` joins by one space the words that no run
    contains after its first period.

    Rows are independent: nothing is shuffled, and a task holds some ten thousand words of
    short texts, or one long text, at a time. For each period, places of a grid as far apart
    as the shortest run allows are compared with the place one period on; the grids of all
    periods together have about n log n places. A comparison takes its words up to
    synchronised places of a difference cover, and the rest from the sorted suffixes of the
    sampled places (``Extensions``), so a run costs no more for being long.

    A null or blank text has no words, no runs and an empty ``collapsed``. Repeated rows are
    judged each on their own; doc_id may be null. An empty table gives no rows. Other
    columns are ignored.
    """
    if power < 3 or least < 1:
        raise ValueError("a run holds its period three times at least")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def some(ids: list, texts: list[list[str]]) -> Iterator[tuple]:
            code: defaultdict[str, int] = defaultdict()
            code.default_factory = code.__len__
            coded = [np.fromiter(map(code.__getitem__, words), np.int64, len(words)) for words in texts]
            for doc, words, runs in zip(ids, texts, runs_of(coded, least, power), strict=True):
                yield doc, len(words), [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], " ".join(collapsed(words, runs))

        def each() -> Iterator[tuple]:
            ids, texts, held = [], [], 0
            for batch in batches:
                for k in range(batch.num_rows):
                    words = _WORD.findall(batch.column(1)[k].as_py())
                    if held and held + len(words) > _WORDS:
                        yield from some(ids, texts)
                        ids, texts, held = [], [], 0
                    ids.append(batch.column(0)[k].as_py())
                    texts.append(words)
                    held += len(words)
            if ids:
                yield from some(ids, texts)

        yield from batches_of_rows(each(), FOUND_ARROW, 256)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(rows, FOUND)


def with_periodic_tails(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with planted repetition: the test input of the registered query.

    With h = crc32 of the decimal doc_id and g = h div 10: where h ends in 0, each word from
    a = g mod n on is replaced by the word at a + (i - a) mod p, p = 1 + (n - a) div (3 + g mod 8).
    """
    h = F.crc32(F.col("doc_id").cast("string"))
    words = f"regexp_extract_all(text, '{WORD.replace(chr(92), chr(92) * 2)}', 0)"
    tail = F.expr(f"""
        transform(array({words}), ws -> if(size(ws) = 0, '', transform(array(named_struct('a', cast(g % size(ws) as int))), t ->
            transform(array(cast(1 + (size(ws) - t.a) div (3 + g % 8) as int)), p ->
                array_join(transform(ws, (w, i) -> if(i < t.a, w, ws[t.a + (i - t.a) % p])), ' '))[0])[0]))[0]
    """)
    known = docs.select("doc_id", text_of().alias("text"), F.floor(h / 10).alias("g"), h.alias("h"))
    return known.select("doc_id", F.when((F.col("h") % 10 == 0), tail).otherwise(F.col("text")).alias("text"))


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns: number of runs, the one of greatest exponent, and digests of runs and rest."""
    best = F.expr("""
        aggregate(runs, cast(null as struct<start: bigint, length: bigint, period: bigint>), (b, r) -> case
            when b is null or r.length * b.period > b.length * r.period then r
            when r.length * b.period = b.length * r.period and (r.start < b.start or r.start = b.start and r.period < b.period) then r
            else b end)
    """)
    listed = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("_best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "_best.start", "_best.length", "_best.period",
        F.expr("(1000 * _best.length) div _best.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
