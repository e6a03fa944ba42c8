"""Best-two-fit packing of token pieces into sequences of a fixed length."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, running_totals, stage, text_of
from ledgermesh.llm.tokens import encoder, slices

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"
PIECE_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
])


def token_pieces(docs: DataFrame, tokenizer: str, limit: int, end_id: int) -> DataFrame:
    """Pieces of at most ``limit`` ids of each document, its end id included."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at, n in slices(batch.column(1)):
                    some = batch.slice(at, n)
                    for doc, own in zip(some.column(0).to_pylist(), encode.encode(some.column(1)), strict=True):
                        ids = own + end
                        for k, cut in enumerate(range(0, len(ids), 4 * limit)):
                            part = ids[cut : cut + 4 * limit]
                            yield doc, k, cut // 4, len(part) // 4, zlib.crc32(part)

        yield from batches_of_rows(rows(), PIECE_ARROW)

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(pieces, PIECE)


def _two_for_one(left: np.ndarray, below: np.ndarray, room: int, least: int) -> tuple[int, int] | None:
    """The two unpacked lengths whose sum is largest within ``room`` and above ``least``."""
    first = np.flatnonzero(left[: room]).astype(np.int64)
    if not len(first):
        return None
    second = below[np.minimum(first, room - first)]
    alone = (second == first) & (left[first] < 2)
    second[alone] = below[first[alone] - 1]
    total = np.where(second > 0, first + second, 0)
    best = int(total.argmax())
    return (int(first[best]), int(second[best])) if total[best] > least else None


def plan_bins(counts: dict[int, int], limit: int) -> list[tuple[int, list[int]]]:
    """Bins as (times, lengths) for so many pieces of each length.

    A bin is filled greedily, the longest unpacked length that fits first. Its smallest
    piece is then replaced by two unpacked ones that fit the gap it leaves more tightly,
    if there are such. The same bin is repeated for as long as its lengths last. The work
    depends on ``limit``, not on the number of pieces: every bin uses up a length or what
    whole bins leave of it.
    """
    left = np.zeros(limit + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    bins = []
    index = np.arange(limit + 1)
    while left.any():
        own: list[int] = []
        gap = limit
        while gap:
            below = np.maximum.accumulate(np.where(left > 0, index, 0))
            length = int(below[gap])
            if not length:
                break
            n = min(int(left[length]), gap // length)
            own += [length] * n
            left[length] -= n
            gap -= n * length
        if gap:
            left[own[-1]] += 1
            below = np.maximum.accumulate(np.where(left > 0, index, 0))
            two = _two_for_one(left, below, gap + own[-1], own[-1])
            own = own[:-1] + (list(two) if two else own[-1:])
            for length in own[-2:] if two else own[-1:]:
                left[length] -= 1
            own.sort(reverse=True)
        used = np.bincount(own, minlength=limit + 1)
        kinds = np.flatnonzero(used)
        times = 1 + int((left[kinds] // used[kinds]).min())
        left[kinds] -= (times - 1) * used[kinds]
        bins.append((times, own))
    return bins


def _runs(bins: list[tuple[int, list[int]]]) -> np.ndarray:
    """Places by length: (length, first rank, first sequence, offset, pieces of it per sequence)."""
    runs, sequence, rank = [], 0, {}
    for times, own in bins:
        offset = 0
        for length, same in groupby(own):
            n = len(list(same))
            runs.append((length, rank.get(length, 0), sequence, offset, n))
            rank[length] = rank.get(length, 0) + n * times
            offset += n * length
        sequence += times
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


def pack_sequences(docs: DataFrame, tokenizer: str, limit: int = 4096, end_id: int = 1) -> DataFrame:
    """Places of all documents' pieces: (doc_id, piece, start, length, ids_crc32, sequence_id, offset).

    Only documents of more than ``limit`` ids are cut. Bins are planned on the driver from
    the number of pieces of each length, at most ``limit`` numbers; the plan has one run
    per bin kind and length, again bounded by ``limit``. Pieces of one length are numbered
    across the cluster by doc_id and piece, and each reads its place off the runs of its
    length, so no task or driver ever holds the pieces.

    A null or empty text is one piece that holds the end id. Repeated rows are pieces of
    their own; an empty table gives no rows. Other columns are ignored.
    """
    pieces = stage(token_pieces(docs, tokenizer, limit, end_id), "pieces")
    counts = {r.length: r.n for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most limit
    runs = _runs(plan_bins(counts, limit))
    lengths = np.array(sorted(counts), np.int64)
    shorter = np.concatenate([[0], np.cumsum([counts[x] for x in lengths.tolist()])]).astype(np.int64)
    numbered = running_totals(
        pieces.withColumn("one", F.lit(1)), [F.col("length"), F.col("doc_id"), F.col("piece")], {"place": "one"}, "piece-order"
    )

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = runs[:, 0] * (1 << 44) + runs[:, 1]
        for batch in batches:
            length, place = (batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("length", "place"))
            rank = place - shorter[np.searchsorted(lengths, length)]
            own = runs[np.searchsorted(key, length * (1 << 44) + rank, "right") - 1]
            times, turn = np.divmod(rank - own[:, 1], own[:, 4])
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(n) for n in PIECE_ARROW.names], pa.array(own[:, 2] + times), pa.array(own[:, 3] + turn * length)],
                schema=PIECE_ARROW.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64())),
            )

    return numbered.select(*PIECE_ARROW.names, "place").mapInArrow(places, PIECE + ", sequence_id long, offset long")
