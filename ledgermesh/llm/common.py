"""Shared pieces of the corpus operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgermesh.session import stage

__all__ = ["BLANK", "WORD", "batches_of_rows", "documents", "running_totals", "stage", "text_of"]

#: White space and words, as every contract of this subpackage reads them.
BLANK = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/documents.parquet")


def text_of(name: str = "text") -> Column:
    """The text column, a null read as empty."""
    return F.coalesce(F.col(name), F.lit(""))


def batches_of_rows(rows: Iterable[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    """Arrow batches of at most ``size`` rows."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns: list[Any] = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema
    )


def running_totals(df: DataFrame, order: list[Column], totals: dict[str, str], label: str) -> DataFrame:
    """Exclusive running sums over a global order, without one big task.

    ``totals`` maps a new column to the column it sums. Rows are range-partitioned by
    ``order`` (end it with something that tells the rows of a hot key apart), sorted and
    written once; the running sum is taken per partition, and only the sum of each
    partition meets in one place. Reading the table back may split or join the written
    parts, so a row keeps the number of the partition that wrote it.
    """
    local = df.repartitionByRange(*order).sortWithinPartitions(*order)
    held = stage(local.withColumn("_slot", F.monotonically_increasing_id()), label)
    held = held.withColumn("_part", F.shiftright("_slot", 33))
    within = Window.partitionBy("_part").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    sums = held.groupBy("_part").agg(*[F.sum(c).alias(f"_all_{n}") for n, c in totals.items()])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_part", *[F.sum(f"_all_{n}").over(before).alias(f"_start_{n}") for n in totals])
    placed = held.withColumns({n: F.sum(c).over(within) for n, c in totals.items()})
    joined = placed.join(F.broadcast(starts), "_part")  # one row per partition
    return joined.withColumns(
        {n: F.coalesce(F.col(n), F.lit(0)) + F.coalesce(F.col(f"_start_{n}"), F.lit(0)) for n in totals}
    ).drop("_slot", "_part", *[f"_start_{n}" for n in totals])
