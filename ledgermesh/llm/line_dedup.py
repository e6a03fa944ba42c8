"""Lines that several documents share: hashed, counted by document and kept in one of them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, stage, text_of

_BLANK = b" \t\n\x0b\x0c\r"
KEY_ARROW = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("keys", pa.list_(pa.binary())), ("places", pa.list_(pa.int32()))])
KEYS = "doc_id long, row long, keys array<binary>, places array<int>"
KEPT_ARROW = pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_dropped", pa.int64()), ("kept_text", pa.string())])


def line_key(line: bytes) -> bytes:
    """A line without white space at its ends, A to Z in lower case."""
    return line.strip(_BLANK).lower()


def _is_long(key: bytes, least: int) -> bool:
    """Whether a key has ``least`` code points or more."""
    return len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)


def line_keys(docs: DataFrame, least: int) -> DataFrame:
    """(doc_id, row, keys, places) of every row of (doc_id, row, text): 128-bit hashes of its long keys, and the lines that have them."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            digest = xxhash.xxh3_128_digest
            for batch in batches:
                for k in range(batch.num_rows):
                    keys, places = [], []
                    for at, line in enumerate(batch.column(2)[k].as_py().split(b"\n")):
                        key = line_key(line)
                        if _is_long(key, least):
                            keys.append(digest(key))
                            places.append(at)
                    if keys:
                        yield batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), keys, places

        yield from batches_of_rows(each(), KEY_ARROW, 1024)

    return docs.select("doc_id", "row", F.col("text").cast("binary")).mapInArrow(rows, KEYS)


def _assembled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each text that are not dropped, in their order."""

    def each() -> Iterator[tuple]:
        for batch in batches:
            for k in range(batch.num_rows):
                doc, text, drop = (c[k].as_py() for c in batch.columns)
                lines = text.split("\n")
                gone = set(drop or ())
                yield doc, len(lines), len(gone), "\n".join([x for at, x in enumerate(lines) if at not in gone]) if gone else text

    yield from batches_of_rows(each(), KEPT_ARROW, 256)


def without_shared_lines(docs: DataFrame, least: int = 10, documents: int = 2) -> DataFrame:
    """One row per input row: (doc_id, n_lines, n_dropped, kept_text).

    A text is split at line feeds. The key of a line is the line without white space at its
    ends, A to Z in lower case. Keys of ``least`` code points or more that are found in at
    least ``documents`` documents lose all their lines, but for those in the document with
    the smallest doc_id that holds them, whose lines all stay. What is left is joined by
    line feeds in its order; a text that loses all lines is empty.

    Lines are exploded as 128-bit hashes with their places, each hash once per row; a hash
    is counted by its documents on the map side before anything is shuffled, so a line that
    stands in a third of all rows sends one row per task. Only hashes found often enough are
    joined back; that join has one row per hash on one side, so a hot hash can be split by
    adaptive skew handling. The texts move once, to meet the places they lose.

    Documents are told apart by doc_id: rows that repeat one, with whatever text, are one
    document, and so are rows without doc_id, which count as the largest. A null or empty
    text is one empty line. An empty table gives no rows. Other columns are ignored.
    """
    raw = docs.select("doc_id", text_of().alias("text")).withColumn("row", F.xxhash64("text"))
    keyed = stage(line_keys(raw, least), "line-keys")
    held = keyed.select("doc_id", F.explode(F.array_distinct("keys")).alias("key"))
    holder = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id")
    first = F.min(holder).alias("first")
    if documents > 2:
        found = held.distinct().groupBy("key").agg(first, F.count("*").alias("n")).filter(F.col("n") >= documents)
    else:  # two documents show in the smallest and the largest
        found = held.groupBy("key").agg(first, F.max(holder).alias("most")).filter("first <> most")
    shared = stage(found.select("key", F.col("first.doc_id").alias("first_id")), "shared-lines")
    lines = keyed.select("doc_id", "row", F.explode(F.arrays_zip("keys", "places")).alias("line"))
    lines = lines.select("doc_id", "row", F.col("line.keys").alias("key"), F.col("line.places").alias("place"))
    lost = lines.join(shared, "key").filter(~F.col("doc_id").eqNullSafe(F.col("first_id")))
    drops = lost.groupBy(F.col("doc_id").alias("_doc"), F.col("row").alias("_row")).agg(F.collect_set("place").alias("drop"))
    own = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("row") == F.col("_row"))
    joined = raw.join(stage(drops, "dropped-lines"), own, "left")
    return joined.select("doc_id", "text", "drop").mapInArrow(_assembled, "doc_id long, n_lines long, n_dropped long, kept_text string")
