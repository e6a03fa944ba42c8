"""Keyed merges: latest row per key, and upserts of one table into another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.session import stage


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row per key in the given order.

    Rank 1 of a window lets Spark drop the other rows of a key before the
    shuffle, so a hot key never travels whole.
    """
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter("_rank = 1").drop("_rank")


def top_per_key(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str | None = None) -> DataFrame:
    """First ``k`` rows per key, with their rank from 1 where ``rank`` names a column for it."""
    ranked = df.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    kept = ranked.filter(F.col(rank or "_rank") <= k)
    return kept if rank else kept.drop("_rank")


def replace_by_key(old: DataFrame, new: DataFrame, keys: list[str], seq: str) -> DataFrame:
    """Incoming rows replace stored rows; within ``new`` the highest ``seq`` wins."""
    both = old.withColumn("_rank_source", F.lit(0)).withColumn(seq, F.lit(None).cast("long")).unionByName(
        new.withColumn("_rank_source", F.lit(1)).withColumn(seq, F.col(seq).cast("long"))
    )
    kept = latest_per_key(both, keys, F.desc("_rank_source"), F.desc_nulls_last(seq))
    return kept.drop("_rank_source", seq)


def update_by_key(old: DataFrame, new: DataFrame, keys: list[str], seq: str, keep: list[str]) -> DataFrame:
    """Upsert that overwrites every column except ``keep``, which stay as stored.

    When a batch brings a new key twice, the kept columns come from its first
    row and the others from its last, as one insert followed by one update.

    ``new`` is read twice and written first. That also hides a union in it: Spark
    may hold the sides of a union of joins for one partitioning and skip
    the shuffle of the join below, which then fails on unequal partitions.
    """
    new = stage(new, "arrivals")
    payload = [c for c in old.columns if c not in keys]
    last = latest_per_key(new, keys, F.desc(seq)).select(*keys, *payload)
    opening = latest_per_key(new, keys, F.asc(seq)).select(*keys, *[F.col(c).alias(f"_first_{c}") for c in keep])
    incoming = last.join(opening, keys).withColumn("_arrived", F.lit(True))
    stored = old.select(*keys, *[F.col(c).alias(f"_old_{c}") for c in payload], F.lit(True).alias("_stored"))

    def pick(name: str) -> Column:
        if name in keep:
            return F.when(F.col("_stored"), F.col(f"_old_{name}")).otherwise(F.col(f"_first_{name}"))
        return F.when(F.col("_arrived"), F.col(name)).otherwise(F.col(f"_old_{name}"))

    joined = stored.join(incoming, keys, "full_outer")
    return joined.select(*[F.col(c) if c in keys else pick(c).alias(c) for c in old.columns])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return df.groupBy(*keys).agg(F.count("*").alias("row_count")).filter("row_count > 1")


def numbered(df: DataFrame, order: list[str], column: str) -> DataFrame:
    """Consecutive row numbers from 0 over a global order, without one big task.

    Rows are range-partitioned, sorted per partition and written once; only the
    row count of each partition meets in one place.
    """
    local = df.repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order)
    staged = stage(local.withColumn("_slot", F.monotonically_increasing_id()), "numbered")
    split = staged.withColumn("_part", F.shiftright("_slot", 33)).withColumn(
        "_pos", F.col("_slot").bitwiseAND(F.lit((1 << 33) - 1))
    )
    sizes = split.groupBy("_part").agg(F.count("*").alias("_size"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_offset"))
    placed = split.join(F.broadcast(offsets), "_part")
    return placed.withColumn(column, F.col("_offset") + F.col("_pos")).drop("_slot", "_part", "_pos", "_offset", "_size")


def chunked(df: DataFrame, keys: list[str], order: str, size: int, item: Column, column: str) -> DataFrame:
    """Long lists as rows: (keys, chunk, ``column``), with at most ``size`` items to a chunk.

    Items stand in the order of the column ``order``, ties in any order; chunks count from 0. The
    rows of one key are numbered over range partitions, so a key of any
    length is spread over tasks and no list is longer than ``size``.
    """
    rows = numbered(df.select(*keys, order, item.alias("_item")), [*keys, order], "_row")
    first = rows.groupBy(*keys).agg(F.min("_row").alias("_first"))
    placed = rows.join(first, keys).withColumn("chunk", F.floor((F.col("_row") - F.col("_first")) / size))
    lists = placed.groupBy(*keys, "chunk").agg(F.sort_array(F.collect_list(F.struct("_row", "_item"))).alias("_items"))
    return lists.select(*keys, "chunk", F.col("_items._item").alias(column))


def joined_chunks(chunks: DataFrame, keys: list[str], text: Column, separator: str, column: str) -> DataFrame:
    """The texts of all chunks of a key in one cell, for exports that ask for it."""
    parts = F.sort_array(F.collect_list(F.struct(F.col("chunk"), text.alias("text"))))
    return chunks.groupBy(*keys).agg(parts.alias("_parts")).select(
        *keys, F.array_join(F.col("_parts.text"), separator).alias(column)
    )
