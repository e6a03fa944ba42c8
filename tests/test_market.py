from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ledgermesh.operators import market as m
from ledgermesh.schemas import FAILURES, MARKET_PRICES, MARKET_SNAPSHOT
from ledgermesh.streaming import prices
from ledgermesh.streaming.prices import run_incremental

DAY = dt.date(2024, 1, 1)


def at(text):
    return F.lit(text).cast("timestamp")


def bars(spark, ticker, n, base=100.0, first=0):
    rows = [
        (ticker, DAY + dt.timedelta(days=i), base + i, base + i, 1000 + i, "test", None) for i in range(first, first + n)
    ]
    return spark.createDataFrame(rows, MARKET_PRICES)


def test_upsert_last_row_wins(spark):
    old = bars(spark, "AAA", 1)
    new = spark.createDataFrame(
        [(" aaa", "2024-01-01", 10.0, None, 5, "t", None, 1), ("AAA", "2024-01-01", 11.0, None, 6, "t", None, 2),
         ("AAA", "bad", 11.0, None, 6, "t", None, 3), ("AAA", "2024-01-02", -1.0, None, 6, "t", None, 4),
         ("AAA", "2024-01-03", 1.0, None, -6, "t", None, 5), (" ", "2024-01-04", 1.0, None, 6, "t", None, 6)],
        "ticker string, trade_date string, close double, adjusted_close double, volume long, data_source string,"
        " updated_at timestamp, seq long",
    )
    (row,) = m.upsert_prices(old, new).collect()
    assert (row.ticker, row.close, row.volume, row.adjusted_close) == ("AAA", 11.0, 6, None)


def test_prune(spark):
    kept = m.prune_prices(bars(spark, "AAA", 260).unionByName(bars(spark, "BBB", 10)))
    rows = {r.ticker: r for r in kept.groupBy("ticker").agg(F.count("*").alias("n"), F.min("trade_date").alias("d")).collect()}
    assert (rows["AAA"].n, rows["AAA"].d, rows["BBB"].n) == (250, dt.date(2024, 1, 11), 10)


def test_snapshot_of_31_sessions(spark):
    row = m.snapshot(bars(spark, "AAA", 31)).first()
    assert row.as_of_date == dt.date(2024, 1, 31)
    assert row.return_1d == pytest.approx(130 / 129 - 1)
    assert row.return_5d == pytest.approx(130 / 125 - 1)
    assert row.return_30d == pytest.approx(130 / 100 - 1)
    assert row.avg_volume_30d == pytest.approx(sum(1000 + i for i in range(1, 31)) / 30)
    assert row.avg_dollar_volume_30d == pytest.approx(sum((100 + i) * (1000 + i) for i in range(1, 31)) / 30)


def test_short_history(spark):
    row = m.snapshot(bars(spark, "AAA", 30)).first()
    assert row.return_30d is None and row.avg_volume_30d is not None
    row = m.snapshot(bars(spark, "AAA", 29)).first()
    assert row.avg_volume_30d is None and row.return_1d is not None


def test_caps_survive(spark):
    empty = spark.createDataFrame([], MARKET_SNAPSHOT)
    caps = spark.createDataFrame([("AAA", 123.0), ("BBB", None), ("CCC", -1.0)], "ticker string, market_cap double")
    first = m.merge_caps(empty, caps, "feed", at("2024-06-01"))
    again = m.merge_caps(first, caps.withColumn("market_cap", F.lit(None).cast("double")), "feed", F.current_timestamp())
    (row,) = again.collect()
    assert (row.ticker, row.market_cap, row.market_cap_updated_at) == ("AAA", 123.0, dt.datetime(2024, 6, 1))
    merged = m.merge_snapshot(again, m.snapshot(bars(spark, "AAA", 31)), F.current_timestamp()).first()
    assert (merged.market_cap, merged.close) == (123.0, 130.0)
    assert [r.ticker for r in m.cap_failures(caps, "x").orderBy("ticker").collect()] == ["BBB", "CCC"]


def test_failure_ledger_ignores_order(spark):
    rows = [("B", "price", "x", "1", "t1", 1), ("A", "price", "x", "1", "t2", 2), ("B", "price", "x", "2", "t3", 3)]
    schema = "ticker string, stage string, reason string, attempt_count string, created_at string, seq long"
    empty = spark.createDataFrame([], FAILURES)
    one = m.merge_failures(empty, spark.createDataFrame(rows, schema)).collect()
    other = m.merge_failures(empty, spark.createDataFrame(rows[::-1], schema)).collect()
    assert one == other and [(r.ticker, r.created_at) for r in one] == [("A", "t2"), ("B", "t3")]


def test_stream_matches_batch_and_replay(spark, tmp_path):
    seq = F.lit(1).cast("long")
    first = bars(spark, "AAA", 40).unionByName(bars(spark, "BBB", 5)).withColumn("seq", seq)
    late = bars(spark, "AAA", 5, base=200.0, first=38).withColumn("seq", seq)
    source, state = str(tmp_path / "in"), str(tmp_path / "state")
    first.write.mode("append").parquet(source)
    run_incremental(spark, source, state, buckets=4)
    late.write.mode("append").parquet(source)
    run_incremental(spark, source, state, buckets=4)
    expected = m.prune_prices(m.upsert_prices(first.drop("seq"), late))

    def rows(df):
        return sorted((r.ticker, r.trade_date, r.close) for r in df.collect())

    stored = spark.read.parquet(f"{state}/prices")
    assert rows(stored) == rows(expected)
    shown = {r.ticker: r for r in spark.read.parquet(f"{state}/snapshot").collect()}
    assert shown["AAA"].close == 242.0 and shown["BBB"].return_5d is None
    late.write.mode("append").parquet(source)  # the same bars arrive again
    run_incremental(spark, source, state, buckets=4)
    assert rows(spark.read.parquet(f"{state}/prices")) == rows(expected)


def test_log_is_read_before_and_after_compaction(spark, tmp_path):
    """A batch writes its own rows only; readers see it at once, compaction changes nothing that they see, and neither does a replay."""
    state, seq = str(tmp_path / "state"), F.lit(1).cast("long")
    batches = [bars(spark, "HOT", 260), bars(spark, "AAA", 40).unionByName(bars(spark, "BBB", 5)), bars(spark, "HOT", 7, base=300.0, first=258)]
    batches = [b.withColumn("seq", seq) for b in batches]
    batches[1] = batches[1].unionByName(bars(spark, "AAA", 1, base=500.0, first=39).withColumn("seq", F.lit(2).cast("long")))

    def rows(df):
        return sorted((r.ticker, r.trade_date, r.close) for r in df.collect())

    def shown(df):
        return sorted((r.ticker, r.as_of_date, r.close, r.return_30d) for r in df.collect())

    expected = None
    for number, batch in enumerate(batches):
        prices.append_bars(batch, state, number, buckets=4)
        assert spark.read.parquet(f"{state}/log/batch={number}").count() == [260, 45, 7][number]
        expected = m.upsert_prices(batch.drop("seq").limit(0) if expected is None else expected, batch)
        seen, seen_snapshot = rows(prices.current_prices(spark, state)), shown(prices.current_snapshot(spark, state, at("2024-06-01")))
        assert seen == rows(m.prune_prices(expected)) and seen_snapshot == shown(m.snapshot(expected))
        if number == 1:
            prices.compact(spark, state, at("2024-06-01"), buckets=4)
            assert prices.logged_batches(spark, state) == []
            assert rows(prices.current_prices(spark, state)) == seen and shown(prices.current_snapshot(spark, state, at("2024-06-01"))) == seen_snapshot
    prices.append_bars(batches[2], state, 2, buckets=4)  # the batch is replayed
    assert prices.logged_batches(spark, state) == [2]
    for _ in range(2):
        assert rows(prices.current_prices(spark, state)) == seen
        prices.compact(spark, state, at("2024-06-01"), buckets=4)
    prices.append_bars(batches[2], state, 2, buckets=4)  # and once more, after its compaction
    prices.compact(spark, state, at("2024-06-01"), buckets=4)
    assert rows(spark.read.parquet(f"{state}/prices")) == seen and shown(spark.read.parquet(f"{state}/snapshot")) == seen_snapshot


def test_a_broken_compaction_is_made_good(spark, tmp_path, monkeypatch):
    state, seq = str(tmp_path / "state"), F.lit(1).cast("long")
    prices.append_bars(bars(spark, "AAA", 40).withColumn("seq", seq), state, 0, buckets=4)
    prices.append_bars(bars(spark, "AAA", 3, base=700.0, first=38).withColumn("seq", seq), state, 1, buckets=4)
    before = sorted(map(tuple, prices.current_prices(spark, state).collect()))
    with monkeypatch.context() as broken:
        broken.setattr(prices, "merge_snapshot", lambda *_: 1 / 0)  # prices are written, the snapshot is not
        with pytest.raises(ZeroDivisionError):
            prices.compact(spark, state, at("2024-06-01"), buckets=4)
    assert prices.logged_batches(spark, state) == [0, 1]
    assert sorted(map(tuple, prices.current_prices(spark, state).collect())) == before
    prices.compact(spark, state, at("2024-06-01"), buckets=4)
    assert sorted(map(tuple, prices.current_prices(spark, state).collect())) == before
    assert spark.read.parquet(f"{state}/snapshot").first().close == 740.0


@pytest.mark.parametrize("every", [None, 1, 2])
def test_stream_of_several_batches(spark, tmp_path, every):
    source, state, expected = str(tmp_path / "in"), str(tmp_path / "state"), None
    for k in range(3):
        batch = bars(spark, "AAA", 20, base=100.0 * (k + 1), first=10 * k).withColumn("seq", F.lit(1).cast("long"))
        batch.coalesce(1).write.mode("append").parquet(source)
        expected = m.upsert_prices(batch.drop("seq").limit(0) if expected is None else expected, batch)
        if k != 1:
            run_incremental(spark, source, state, buckets=4, files_per_batch=1, compact_every=every)
    got = sorted((r.trade_date, r.close) for r in spark.read.parquet(f"{state}/prices").collect())
    assert got == sorted((r.trade_date, r.close) for r in expected.collect()) and prices.logged_batches(spark, state) == []
