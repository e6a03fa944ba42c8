"""Pairs of the companies behind each person, made and counted in Arrow batches.

Companies are numbered in ticker order and cut into ranges of about as many
pairs. The companies that a person has in a range travel once, under the
range, with those behind them; there the pairs are made, counted and packed
into chunks, one for every range of targets. Numbers become tickers where the
chunks of a range meet the tickers of its companies, so a pair is neither
sorted nor shuffled by itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Pairs of two lists that one pass over a batch takes apart.
PASS_PAIRS = 1 << 22

# Rows of one batch that is handed on.
ROWS = 1 << 16

_EDGES = pa.schema([("source", pa.int32()), ("target", pa.int32()), ("shared_person_count", pa.int64())])
_NAMES = pa.schema([("source", pa.int32()), ("source_ticker", pa.string())])
_LISTS = ["own", "own_sizes", "theirs", "their_sizes"]
_CHUNKS = pa.schema([("target_range", pa.int32()), ("target_slot", pa.int32()), ("edges", pa.binary()), ("names", pa.binary())])


@dataclass(frozen=True)
class Ranges:
    """Ranges of company numbers: the first number and its ticker, and the slots the pairs of the range are dealt over."""

    firsts: np.ndarray
    slots: np.ndarray
    tickers: list[str]

    def of(self, numbers: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.firsts, numbers, "right") - 1


def _flat(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each list begins, and the end of the last, with the items of all."""
    at = lists.offsets.to_numpy().astype(np.int64)
    return at - at[0], lists.values.slice(at[0], at[-1] - at[0])


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places from each start on, as many as its size, one after the other."""
    ends = np.cumsum(sizes)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - sizes - starts, sizes)


def _keyed(at: np.ndarray, numbers: np.ndarray) -> np.ndarray:
    """Numbers in the order of their lists, comparable across them."""
    return (np.repeat(np.arange(len(at) - 1), np.diff(at)) << 32) | numbers


def _cut(cuts: np.ndarray, sizes: np.ndarray, items: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Lists in rows: the items and the sizes of those from each cut to the next."""
    at = np.concatenate([[0], np.cumsum(sizes)])[cuts]
    return tuple(pa.ListArray.from_arrays(pa.array(x.astype(np.int32)), pa.array(y.astype(np.int32))) for x, y in ((at, items), (cuts, sizes)))


def _new(*keys: np.ndarray) -> np.ndarray:
    """Places where one of the keys differs from the row before."""
    first = np.ones(len(keys[0]), bool)
    first[1:] = np.logical_or.reduce([key[1:] != key[:-1] for key in keys])
    return np.flatnonzero(first)


def met(lists: DataFrame, ranges: Ranges) -> DataFrame:
    """The companies of a list in each range, with those of the other list behind the first of them.

    ``lists`` is (own, theirs), in number order; ``source_ticker`` names the range by its first company. Lists
    that one pass finds for a range are one row, with their sizes.
    """

    def part(batch: pa.RecordBatch) -> pa.RecordBatch:
        (own_at, own), (their_at, theirs) = ([at, items.to_numpy()] for at, items in (_flat(batch["own"]), _flat(batch["theirs"])))
        row, place = np.repeat(np.arange(len(batch)), np.diff(own_at)), ranges.of(own)
        first = _new(row, place)
        size = np.diff(np.append(first, len(own)))
        start = np.searchsorted(_keyed(their_at, theirs), (row[first] << 32) | own[first], "right")
        behind = their_at[row[first] + 1] - start
        deal = ranges.slots[place[first]] * (behind > 0)
        turn, slot = np.repeat(np.arange(len(first)), deal), _spans(np.zeros(len(first), np.int64), deal)
        order = np.lexsort((slot, place[first][turn]))
        turn, slot, own_place = turn[order], slot[order], place[first][turn[order]]
        sources, targets, sizes = _spans(first[turn], size[turn]), theirs[_spans(start[turn], behind[turn])], behind[turn]
        if (deal > 1).any():
            line = np.repeat(np.arange(len(turn)), sizes)
            here = targets % ranges.slots[own_place][line] == slot[line]
            targets, sizes = targets[here], np.bincount(line[here], minlength=len(turn))
        cuts = np.append(_new(own_place, slot), len(turn)) if len(turn) else np.zeros(1, np.int64)
        return pa.RecordBatch.from_arrays([
            tickers.take(pa.array(own_place[cuts[:-1]])), pa.array(own_place[cuts[:-1]].astype(np.int32)), pa.array(slot[cuts[:-1]].astype(np.int32)),
            *_cut(cuts, size[turn], own[sources]), *_cut(cuts, sizes, targets),
        ], names=["source_ticker", "range", "slot", *_LISTS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = np.cumsum(pc.list_value_length(batch["own"]).to_numpy().astype(np.int64) * pc.list_value_length(batch["theirs"]).to_numpy())
            cuts = [0, *(np.flatnonzero(np.diff(pairs // PASS_PAIRS)) + 1), len(batch)]
            for low, high in zip(cuts, cuts[1:]):
                if high > low:
                    yield part(batch.slice(low, high - low))

    tickers = pa.array(ranges.tickers, pa.string())
    return lists.select("own", "theirs").mapInArrow(
        run, "source_ticker string, range int, slot int" + "".join(f", {name} array<int>" for name in _LISTS)
    )


def dealt(companies: DataFrame, ranges: Ranges) -> DataFrame:
    """Companies, by ``number``, once for each slot of their range: (source_ticker, range, slot, and their columns)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = ranges.of(batch["number"].to_numpy())
            turn = np.repeat(np.arange(len(place)), ranges.slots[place])
            slot = _spans(np.zeros(len(place), np.int64), ranges.slots[place])
            yield pa.RecordBatch.from_arrays(
                [tickers.take(pa.array(place[turn])), pa.array(place[turn].astype(np.int32)), pa.array(slot.astype(np.int32)), *batch.take(pa.array(turn)).columns],
                names=["source_ticker", "range", "slot", *batch.schema.names],
            )

    tickers = pa.array(ranges.tickers, pa.string())
    own = ", ".join(f"{name} {kind}" for name, kind in companies.dtypes)
    return companies.mapInArrow(run, f"source_ticker string, range int, slot int, {own}")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.RecordBatch]:
    """Rows with equal keys that stand one after the other, whole."""
    held, last = [], None
    for batch in batches:
        if len(batch):
            values = [batch[key].to_numpy() for key in keys]
            cuts = [*_new(*values), len(batch)]
            for low, high in zip(cuts, cuts[1:]):
                now = [value[low] for value in values]
                if held and now != last:
                    yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                    held = []
                held.append(batch.slice(low, high - low))
                last = now
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def _packed(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
        stream.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(payload: pa.BinaryScalar) -> pa.RecordBatch:
    return next(iter(pa.ipc.open_stream(payload.as_buffer())))


def chunks(lists: DataFrame, companies: DataFrame, ranges: Ranges, tasks: int) -> DataFrame:
    """Counted pairs of ``lists`` (own, theirs) in chunks: (target_range, target_slot, edges, names).

    The companies of a range, or of a slot of one with too many pairs, meet in one task; every pair
    is counted whole there. ``edges`` is (source, target, count), ``names`` the tickers of its sources,
    from ``companies`` (number, ticker) that meet there too.
    """

    def count(group: pa.RecordBatch) -> Iterator[tuple]:
        own, own_sizes, theirs, their_sizes = (_flat(group[name])[1].to_numpy() for name in _LISTS)
        own_row, their_at = np.repeat(np.arange(len(own_sizes)), own_sizes), np.concatenate([[0], np.cumsum(their_sizes, dtype=np.int64)])
        start = np.searchsorted(_keyed(their_at, theirs), (own_row << 32) | own, "right")
        behind = their_at[own_row + 1] - start
        pairs = np.sort((np.repeat(own.astype(np.int64), behind) << 32) | theirs[_spans(start, behind)])
        first = _new(pairs)
        counts, pairs = np.diff(np.append(first, len(pairs))), pairs[first]
        source, target = pairs >> 32, pairs & 0xFFFFFFFF
        known = group.filter(group["number"].is_valid()).select(["number", "ticker"]).sort_by("number")
        numbers, tickers = known["number"].to_numpy(), known["ticker"]
        place = ranges.of(target)
        slot = source % ranges.slots[place]
        order = np.lexsort((slot, place))
        source, target, counts, place, slot = (x[order] for x in (source, target, counts, place, slot))
        cuts = [*_new(place, slot), len(place)] if len(place) else []
        for low, high in zip(cuts, cuts[1:]):
            edges = [pa.array(x[low:high], field.type) for x, field in zip((source.astype(np.int32), target.astype(np.int32), counts), _EDGES)]
            named = np.searchsorted(numbers, source[low:high][_new(source[low:high])])
            names = [pa.array(numbers[named], pa.int32()), tickers.take(pa.array(named))]
            yield int(place[low]), int(slot[low]), _packed(pa.RecordBatch.from_arrays(edges, schema=_EDGES)), _packed(pa.RecordBatch.from_arrays(names, schema=_NAMES))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, ["range", "slot"]):
            rows = list(count(group))
            for low in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array(x, field.type) for x, field in zip(zip(*rows[low : low + 256]), _CHUNKS)], schema=_CHUNKS)

    nothing = F.array().cast("array<int>")
    known = dealt(companies.select("number", "ticker"), ranges).withColumns({name: nothing for name in _LISTS})
    rows = met(lists, ranges).unionByName(known, allowMissingColumns=True)
    together = rows.repartition(tasks, "source_ticker", "slot").sortWithinPartitions("range", "slot")
    return together.mapInArrow(run, "target_range int, target_slot int, edges binary, names binary")


def _sources(names: pa.RecordBatch, numbers: pa.Array) -> pa.Array:
    """Tickers of source numbers of a chunk."""
    return names["source_ticker"].take(pa.array(np.searchsorted(names["source"].to_numpy(), numbers.to_numpy())))


def edges(packed: DataFrame, with_tickers: bool = False) -> DataFrame:
    """Edges of the chunks with the numbers of their companies, or with the tickers of their sources."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                found = _unpacked(batch["edges"][at])
                names = _unpacked(batch["names"][at]) if with_tickers else None
                for low in range(0, len(found), ROWS):
                    some = found.slice(low, ROWS)
                    source = _sources(names, some["source"]) if with_tickers else some["source"]
                    yield pa.RecordBatch.from_arrays([source, *some.columns[1:]], names=["source_ticker", "target_ticker", "shared_person_count"])

    kind = "string" if with_tickers else "int"
    return packed.select("edges", *(["names"] if with_tickers else [])).mapInArrow(
        run, f"source_ticker {kind}, target_ticker int, shared_person_count bigint"
    )


def named(packed: DataFrame, companies: DataFrame, ranges: Ranges, tasks: int) -> DataFrame:
    """Edges of the chunks with the tickers of their companies, and with what else ``companies`` has of the target.

    ``companies`` is (number, ticker, and others). Tickers and chunks of a
    range meet in one task, the tickers first, and pass through it in order.
    """
    others = [name for name in companies.columns if name not in ("number", "ticker")]
    kinds = dict(companies.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, known, numbers, facts = None, [], None, None
        for batch in batches:
            place, slot, packs = batch["range"].to_numpy(), batch["slot"].to_numpy(), batch["edges"]
            chunk = packs.is_valid().to_numpy(zero_copy_only=False)
            cuts = [*_new(place, slot, chunk), len(batch)] if len(batch) else []
            for low, high in zip(cuts, cuts[1:]):
                if here != (here := (place[low], slot[low])):
                    known, facts = [], None
                if not chunk[low]:
                    known.append(batch.slice(low, high - low).select(["number", "ticker", *others]))
                    continue
                if facts is None:
                    facts = pa.Table.from_batches(known).combine_chunks().sort_by("number")
                    numbers = facts["number"].to_numpy()
                for at in range(low, high):
                    found, names = _unpacked(packs[at]), _unpacked(batch["names"][at])
                    for begin in range(0, len(found), ROWS):
                        some = found.slice(begin, ROWS)
                        sources = _sources(names, some["source"])
                        targets = facts.take(pa.array(np.searchsorted(numbers, some["target"].to_numpy()))).combine_chunks()
                        columns = [targets[name].combine_chunks() for name in ("ticker", *others)]
                        yield pa.RecordBatch.from_arrays(
                            [sources, columns[0], some["shared_person_count"], *columns[1:]],
                            names=["source_ticker", "target_ticker", "shared_person_count", *others],
                        )

    known = dealt(companies.select("number", "ticker", *others), ranges).drop("source_ticker")
    packs = packed.select(F.col("target_range").alias("range"), F.col("target_slot").alias("slot"), "edges", "names")
    rows = known.unionByName(packs, allowMissingColumns=True)
    together = rows.repartition(tasks, "range", "slot").sortWithinPartitions("range", "slot", F.asc_nulls_last("number"))
    own = "".join(f", {name} {kinds[name]}" for name in others)
    return together.mapInArrow(run, f"source_ticker string, target_ticker string, shared_person_count bigint{own}")
