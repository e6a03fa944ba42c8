"""Incremental price load as a Structured Streaming job over an append-only log.

Bar files arrive in a folder. A micro-batch appends its bars to a log, in a folder of its
own, and reads nothing that is stored: it writes rows in proportion to what arrived, and
replaying it writes the same folder again. Readers take the latest row per key of the
stored tables and the log together. Compaction folds the log into the price table, which
is partitioned by a ticker bucket, prunes it, and rebuilds the snapshot of the tickers
that came up; only the buckets that the log touches are rewritten, once for all its batches.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.operators.market import PRICE_KEY, merge_snapshot, prune_prices, snapshot, valid_bar
from ledgermesh.operators.merge import latest_per_key
from ledgermesh.schemas import MARKET_PRICES, MARKET_SNAPSHOT
from ledgermesh.session import run_folder, stage

BUCKETS = 256
BAR_SCHEMA = (
    "ticker string, trade_date date, close double, adjusted_close double, volume long,"
    " data_source string, updated_at timestamp, seq long"
)
#: Batch number of what is stored already: every batch of the log comes after it.
_STORED = -1


def bucket_of(ticker: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(ticker), F.lit(buckets)).cast("int")


def _folder(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _exists(spark: SparkSession, path: str) -> bool:
    files, folder = _folder(spark, path)
    return files.exists(folder)


def _stored(spark: SparkSession, path: str, schema) -> DataFrame:
    """A stored table with its bucket; no rows where it is not there yet."""
    fields = ", ".join([*[f"{f.name} {f.dataType.simpleString()}" for f in schema.fields], "bucket int"])
    return spark.read.schema(fields).parquet(path) if _exists(spark, path) else spark.createDataFrame([], fields)


def logged_batches(spark: SparkSession, state_dir: str) -> list[int]:
    """Numbers of the batches that the log holds: one per micro-batch since the last compaction."""
    files, folder = _folder(spark, f"{state_dir}/log")
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder)]
    return sorted(int(name.removeprefix("batch=")) for name in names if name.startswith("batch="))


def _log(spark: SparkSession, state_dir: str, batches: list[int]) -> DataFrame:
    """Bars of some batches of the log."""
    fields = f"{BAR_SCHEMA}, bucket int, batch long"
    paths = [f"{state_dir}/log/batch={n}" for n in batches]
    if not paths:
        return spark.createDataFrame([], fields)
    return spark.read.schema(fields).option("basePath", f"{state_dir}/log").parquet(*paths)


def append_bars(batch: DataFrame, state_dir: str, number: int, buckets: int = BUCKETS) -> None:
    """Append one batch of bars to the log, the last bar of each key. A repeated number replaces its own folder only."""
    last = latest_per_key(valid_bar(batch), PRICE_KEY, F.desc_nulls_last("seq"))
    placed = last.withColumn("bucket", bucket_of(F.col("ticker"), buckets))
    placed.write.mode("overwrite").parquet(f"{state_dir}/log/batch={number}")


def _merged(stored: DataFrame, log: DataFrame) -> DataFrame:
    """Latest row per key of stored prices and logged bars, with its bucket; rows pruned to the sessions that are kept."""
    old = stored.withColumns({"batch": F.lit(_STORED).cast("long"), "seq": F.lit(None).cast("long")})
    both = old.unionByName(log.select(*old.columns))
    return prune_prices(latest_per_key(both, PRICE_KEY, F.desc("batch"), F.desc_nulls_last("seq")).drop("batch", "seq"))


def current_prices(spark: SparkSession, state_dir: str) -> DataFrame:
    """The price table as of the last batch, compacted or not."""
    log = _log(spark, state_dir, logged_batches(spark, state_dir))
    return _merged(_stored(spark, f"{state_dir}/prices", MARKET_PRICES), log).drop("bucket")


def current_snapshot(spark: SparkSession, state_dir: str, now: Column) -> DataFrame:
    """The snapshot as of the last batch; only tickers of the log are worked out anew."""
    log = _log(spark, state_dir, logged_batches(spark, state_dir))
    touched, tickers = log.select("bucket").distinct(), log.select("ticker").distinct()
    stored = _stored(spark, f"{state_dir}/prices", MARKET_PRICES).join(touched, "bucket", "left_semi").join(tickers, "ticker", "left_semi")
    old = _stored(spark, f"{state_dir}/snapshot", MARKET_SNAPSHOT).drop("bucket")
    return merge_snapshot(old, snapshot(_merged(stored, log).drop("bucket")), now)


def _overwrite(ready: DataFrame, path: str) -> None:
    """Replace the buckets of a written table. Rows are rebalanced by bucket: small buckets share a task, a hot one is split."""
    writer = ready.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket")
    writer.option("partitionOverwriteMode", "dynamic").parquet(path)


def compact(spark: SparkSession, state_dir: str, now: Column, buckets: int = BUCKETS) -> None:
    """Fold the log into the price table and the snapshot, and drop the folded batches.

    Batches go in ascending order once the tables are written. Folding a batch again
    changes nothing, so a run that breaks off anywhere is made good by the next one.
    """
    batches = logged_batches(spark, state_dir)
    if not batches:
        return
    log = _log(spark, state_dir, batches)
    touched, tickers = stage(log.select("bucket").distinct(), "buckets"), stage(log.select("ticker").distinct(), "tickers")
    numbers = [row.bucket for row in touched.collect()]  # at most ``buckets`` small numbers, for partition pruning
    stored = _stored(spark, f"{state_dir}/prices", MARKET_PRICES).filter(F.col("bucket").isin(numbers))
    merged = stage(_merged(stored, log), "prices")
    _overwrite(merged, f"{state_dir}/prices")
    fresh = snapshot(merged.drop("bucket").join(tickers, "ticker", "left_semi"))
    old = _stored(spark, f"{state_dir}/snapshot", MARKET_SNAPSHOT).filter(F.col("bucket").isin(numbers)).drop("bucket")
    shown = merge_snapshot(old, fresh, now).withColumn("bucket", bucket_of(F.col("ticker"), buckets))
    _overwrite(stage(shown, "snapshot"), f"{state_dir}/snapshot")
    for number in batches:
        files, folder = _folder(spark, f"{state_dir}/log/batch={number}")
        files.delete(folder, True)


def run_incremental(
    spark: SparkSession, in_dir: str, state_dir: str, buckets: int = BUCKETS, files_per_batch: int | None = None,
    compact_every: int | None = None,
) -> None:
    """Process all bar files that have arrived, compact the log, and stop.

    ``compact_every`` also compacts after so many batches, so that a long run keeps its log short.
    """
    reader = spark.readStream.schema(BAR_SCHEMA)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def work(batch: DataFrame, number: int) -> None:
        append_bars(batch, state_dir, number, buckets)
        if compact_every and (number + 1) % compact_every == 0:
            compact(batch.sparkSession, state_dir, F.current_timestamp(), buckets)

    stream = (
        reader.parquet(in_dir)
        .writeStream.foreachBatch(work)
        .option("checkpointLocation", f"{state_dir}/progress")
        .trigger(availableNow=True)
        .start()
    )
    stream.awaitTermination()
    compact(spark, state_dir, F.current_timestamp(), buckets)


def run_incremental_once(spark: SparkSession, stored: DataFrame, arrivals: DataFrame) -> DataFrame:
    """Load a stored history and then some arrivals through the stream; the price table it leaves."""
    base = f"{run_folder(spark)}/incremental-{uuid.uuid4().hex}"
    columns = [F.col(c).cast(t).alias(c) for c, t in (part.split() for part in BAR_SCHEMA.split(", "))]
    state = f"{base}/state"
    history = stored.withColumn("seq", F.lit(0)).select(*columns)
    history.write.parquet(f"{base}/in/first")
    run_incremental(spark, f"{base}/in/*", state, buckets=8)
    arrivals.select(*columns).write.parquet(f"{base}/in/second")
    run_incremental(spark, f"{base}/in/*", state, buckets=8)
    return spark.read.parquet(f"{state}/prices").drop("bucket")
