"""Token ids in fixed-width bit-packed blocks, with offsets for random access."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, text_of
from ledgermesh.llm.tokens import encoder, slices
from ledgermesh.session import shared_folder

BLOCK = "shard int, block int, first long, n_ids int, bits int, packed binary, doc_ids array<long>, doc_firsts array<int>"
BLOCK_ARROW = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("bits", pa.int32()),
    ("packed", pa.binary()), ("doc_ids", pa.list_(pa.int64())), ("doc_firsts", pa.list_(pa.int32())),
])
DOC_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("ids", pa.binary())])


def width(vocabulary: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids side by side in ``bits`` bits each, lowest bit first."""
    if not len(ids):
        return b""
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if bits % 8 == 0:  # the same bytes, without unfolding every bit
        return octets[:, : bits // 8].tobytes()
    planes = np.unpackbits(octets, axis=1, bitorder="little")
    return np.packbits(planes[:, :bits].reshape(-1), bitorder="little").tobytes()


def unpack(packed: bytes, bits: int, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block; only their own bytes are touched."""
    if stop <= start:
        return np.empty(0, "<u4")
    low, high = start * bits, stop * bits
    part = np.frombuffer(packed, np.uint8)[low // 8 : -(-high // 8)]
    if bits % 8 == 0:
        octets = np.zeros((stop - start, 4), np.uint8)
        octets[:, : bits // 8] = part.reshape(stop - start, -1)
        return octets.view("<u4").reshape(-1)
    flat = np.unpackbits(part, bitorder="little")[low % 8 : low % 8 + high - low]
    planes = np.zeros((stop - start, 32), np.uint8)
    planes[:, :bits] = flat.reshape(-1, bits)
    return np.packbits(planes, axis=1, bitorder="little").view("<u4").reshape(-1)


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, block_ids: int = 65536) -> None:
    """Writes the ids of all documents to ``path`` in ascending order of doc_id.

    Documents are range-partitioned by doc_id (rows of one doc_id by the bytes of their text,
    then the text, so that they have a fixed order and may be spread over partitions); each
    partition is a shard of blocks. A block holds whole documents, at least ``block_ids``
    ids of them (the last of a shard may hold fewer, and one long document makes one long
    block), as packed bits, with ``first`` (ids before it in its shard), doc_ids and where
    each document begins. Blocks are rows of a columnar table, so a reader fetches single
    blocks by shard and first.

    A null text is empty and has its end id only; null doc_ids come first; repeated rows
    are stored again. An empty table writes a table of no blocks. Other columns are ignored.
    """

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, encode = TaskContext.get().partitionId(), encoder(tokenizer)
        bits, end = width(encode.size), np.array([end_id], "<u4").tobytes()

        def blocks() -> Iterator[tuple]:
            block = first = held = 0
            parts: list[bytes] = []
            ids: list[int | None] = []
            firsts: list[int] = []

            def row() -> tuple:
                return number, block, first, held, bits, pack(np.frombuffer(b"".join(parts), "<u4"), bits), ids, firsts

            for batch in batches:
                for at, n in slices(batch.column(1)):
                    some = batch.slice(at, n)
                    for doc, own in zip(some.column(0).to_pylist(), encode.encode(some.column(1)), strict=True):
                        ids.append(doc)
                        firsts.append(held)
                        parts.append(own + end)
                        held += len(own) // 4 + 1
                        if held >= block_ids:
                            yield row()
                            block, first, held, parts, ids, firsts = block + 1, first + held, 0, [], [], []
            if ids:
                yield row()

        yield from batches_of_rows(blocks(), BLOCK_ARROW, 16)

    order = [F.col("doc_id"), F.octet_length("text"), F.col("text")]
    ordered = docs.select("doc_id", text_of().alias("text")).repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    ordered.mapInArrow(shard, BLOCK).write.parquet(path)


def token_blocks(spark: SparkSession, path: str) -> DataFrame:
    """The stored blocks with ``start``, the number of ids before each in all shards."""
    blocks = spark.read.schema(BLOCK).parquet(path)
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("shard_ids"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = shards.select("shard", F.coalesce(F.sum("shard_ids").over(before), F.lit(0)).alias("shard_start"))
    placed = blocks.join(F.broadcast(starts), "shard")  # one row per shard
    return placed.withColumn("start", F.col("shard_start") + F.col("first")).drop("shard_start")


def read_token_files(blocks: DataFrame) -> DataFrame:
    """Documents of some blocks: (doc_id, start, ids), ids as little-endian unsigned 32-bit integers."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ends = [*b["doc_firsts"][1:], b["n_ids"]]
                ids = unpack(b["packed"], b["bits"], 0, b["n_ids"])
                yield from batches_of_rows(
                    ((d, b["start"] + s, ids[s:e].tobytes()) for d, s, e in zip(b["doc_ids"], b["doc_firsts"], ends, strict=True)),
                    DOC_ARROW,
                )

    return blocks.select("start", "n_ids", "bits", "packed", "doc_ids", "doc_firsts").mapInArrow(
        rows, "doc_id long, start long, ids binary"
    )


def ids_between(spark: SparkSession, path: str, start: int, stop: int) -> np.ndarray:
    """Ids ``start`` to ``stop`` of the whole collection; only the blocks that hold them are read."""
    blocks = token_blocks(spark, path).filter((F.col("start") < stop) & (F.col("start") + F.col("n_ids") > start))
    parts = [
        unpack(b.packed, b.bits, max(0, start - b.start), min(b.n_ids, stop - b.start))
        for b in blocks.select("start", "n_ids", "bits", "packed").orderBy("start").collect()
    ]
    return np.concatenate(parts) if parts else np.empty(0, "<u4")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"
