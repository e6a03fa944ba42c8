"""Daily bars: price history, retention, and the per-ticker snapshot."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.numbers import bar_date, iso_date
from ledgermesh.functions.text import text_or_empty, upper_key
from ledgermesh.operators.canonical import beside
from ledgermesh.operators.merge import replace_by_key, top_per_key

PRICE_KEY = ["ticker", "trade_date"]
CAP_COLUMNS = ["market_cap", "market_cap_data_source", "market_cap_updated_at"]
SNAPSHOT_DEPTH = 31


def explode_bars(df: DataFrame) -> DataFrame:
    """Rows of a map symbol -> array of bars (t, c, v)."""
    return df.select(F.explode("bars").alias("symbol", "series")).select("symbol", F.inline("series"))


def to_price_bars(raw: DataFrame, adjusted: DataFrame | None, source: str) -> DataFrame:
    """Raw bars with the adjusted close of the same session, where there is one."""
    bars = raw.select(
        F.upper("symbol").alias("ticker"), bar_date(F.col("t")).alias("trade_date"),
        F.col("c").cast("double").alias("close"), F.coalesce(F.col("v").cast("long"), F.lit(0)).alias("volume"),
        F.lit(source).alias("data_source"),
    )
    if adjusted is None:
        return bars.withColumn("adjusted_close", F.lit(None).cast("double"))
    lookup = adjusted.select(
        F.upper("symbol").alias("ticker"), bar_date(F.col("t")).alias("trade_date"),
        F.col("c").cast("double").alias("adjusted_close"),
    )
    return bars.join(lookup, PRICE_KEY, "left")


def valid_bar(df: DataFrame) -> DataFrame:
    """Bars with an ISO date, a ticker, a positive or null close, and no negative volume."""
    cleaned = df.withColumn("ticker", upper_key(F.col("ticker")))
    if dict(df.dtypes)["trade_date"] == "string":
        cleaned = cleaned.withColumn("trade_date", iso_date(F.col("trade_date")))
    return cleaned.filter(
        "trade_date is not null and ticker <> '' and (close is null or close > 0) and (volume is null or volume >= 0)"
    )


def upsert_prices(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Stored prices with the incoming bars over them; later bars of a batch win."""
    incoming = valid_bar(new).select(*old.columns, seq)
    return replace_by_key(old, incoming, PRICE_KEY, seq)


def prune_prices(df: DataFrame, keep: int = fixed.PRICE_SESSIONS_KEPT) -> DataFrame:
    """Latest ``keep`` sessions of each ticker."""
    return top_per_key(df, ["ticker"], keep, F.desc("trade_date"))


def snapshot(prices: DataFrame) -> DataFrame:
    """Latest session of each ticker with returns and 30-session averages.

    Offsets count sessions. Only the last 31 sessions are ranked out of the
    history, and the ranking drops the others before the shuffle.
    """
    order = Window.partitionBy("ticker").orderBy(F.desc("trade_date"))
    recent = prices.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= SNAPSHOT_DEPTH)
    px = F.coalesce("adjusted_close", "close")
    dollars = F.col("close") * F.col("volume")

    def at(session: int, value):
        return F.max(F.when(F.col("rn") == session, value))

    last30 = F.col("rn") <= 30
    rows = recent.groupBy("ticker").agg(
        at(1, F.col("trade_date")).alias("as_of_date"),
        at(1, F.col("close")).alias("close"),
        *[at(n, px).alias(f"px{n}") for n in (1, 2, 6, 31)],
        F.count_if(last30 & F.col("volume").isNotNull()).alias("volumes"),
        F.sum(F.when(last30, F.col("volume"))).alias("volume_sum"),
        F.count_if(last30 & dollars.isNotNull()).alias("dollar_days"),
        F.sum(F.when(last30, dollars)).alias("dollar_sum"),
        at(1, F.col("data_source")).alias("price_data_source"),
        at(1, F.col("updated_at")).alias("price_updated_at"),
    )

    def back(n: int):
        return F.try_divide("px1", F.col(f"px{n + 1}")) - 1

    return rows.select(
        "ticker", "as_of_date", "close",
        back(1).alias("return_1d"), back(5).alias("return_5d"), back(30).alias("return_30d"),
        F.when(F.col("volumes") == 30, F.col("volume_sum") / 30).alias("avg_volume_30d"),
        F.when(F.col("dollar_days") == 30, F.col("dollar_sum") / 30).alias("avg_dollar_volume_30d"),
        "price_data_source", "price_updated_at",
    )


def canonical_snapshot(prices: DataFrame, canonical: DataFrame) -> DataFrame:
    """Snapshot of the tickers in the company master."""
    return snapshot(prices.join(canonical.select("ticker"), "ticker", "left_semi"))


def session_returns(prices: DataFrame) -> DataFrame:
    """Returns over 1, 5 and 30 sessions at every session of the history."""
    order = Window.partitionBy("ticker").orderBy("trade_date")
    px = F.coalesce("adjusted_close", "close")
    return prices.select(
        "ticker", "trade_date",
        *[(F.try_divide(px, F.lag(px, n).over(order)) - 1).alias(f"return_{n}d") for n in (1, 5, 30)],
    )


def rolling_averages(prices: DataFrame) -> DataFrame:
    """30-session average volume at every session, null before the 30th."""
    window = Window.partitionBy("ticker").orderBy("trade_date").rowsBetween(-29, 0)
    full = F.count("volume").over(window) == 30
    return prices.select("ticker", "trade_date", F.when(full, F.sum("volume").over(window) / 30).alias("avg_volume_30d"))


def merge_snapshot(old: DataFrame, new: DataFrame, now) -> DataFrame:
    """Stored snapshot with new price figures; market caps stay as stored."""
    price_cols = [c for c in new.columns if c != "ticker"]
    incoming = new.select("ticker", *[F.col(c).alias(f"_new_{c}") for c in price_cols], F.lit(True).alias("_arrived"))
    joined = old.join(incoming, "ticker", "full_outer")
    arrived = F.col("_arrived")

    def pick(name: str):
        if name == "ticker":
            return F.col(name)
        if name == "updated_at":
            return F.when(arrived, now).otherwise(F.col(name)).alias(name)
        if name in price_cols:
            return F.when(arrived, F.col(f"_new_{name}")).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[pick(c) for c in old.columns])


def merge_caps(old: DataFrame, caps: DataFrame, source: str, now) -> DataFrame:
    """Stored snapshot with new market caps; a missing or bad cap changes nothing."""
    good = caps.filter("market_cap > 0").select(
        "ticker", F.col("market_cap").alias("_cap"), F.lit(True).alias("_arrived")
    )
    joined = old.join(good, "ticker", "full_outer")
    fresh = {
        "market_cap": F.col("_cap"), "market_cap_data_source": F.lit(source),
        "market_cap_updated_at": now, "updated_at": now,
    }
    columns = [
        F.when(F.col("_arrived"), fresh[c]).otherwise(F.col(c)).alias(c) if c in fresh else F.col(c) for c in old.columns
    ]
    return joined.select(*columns)


def cap_failures(caps: DataFrame, created_at: str) -> DataFrame:
    bad = caps.filter("market_cap is null or market_cap <= 0")
    return failure_rows(bad, "market_cap", "missing_or_invalid_market_cap", created_at)


def failure_rows(tickers: DataFrame, stage: str, reason: str, created_at: str) -> DataFrame:
    return tickers.select(
        "ticker", F.lit(stage).alias("stage"), F.lit(reason).alias("reason"),
        F.lit("1").alias("attempt_count"), F.lit(created_at).alias("created_at"),
    )


def missing_tickers(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Requested tickers that came back with nothing."""
    return requested.select("ticker").distinct().join(returned.select("ticker"), "ticker", "left_anti")


def merge_failures(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Failure ledger keyed by (ticker, stage, reason); the last entry wins."""
    incoming = new.select(*[text_or_empty(F.col(c).cast("string")).alias(c) for c in old.columns], seq)
    return replace_by_key(old, incoming, ["ticker", "stage", "reason"], seq).orderBy("ticker", "stage", "reason")


def run_summary(tickers: DataFrame, bars: DataFrame, failures: DataFrame, start: str, end: str, dry_run: bool = False) -> DataFrame:
    """Status and counts of one price run."""
    row = beside([
        tickers.agg(F.count("*").alias("tickers")),
        bars.agg(F.count("*").alias("price_rows_upserted")),
        failures.agg(F.count("*").alias("failures")),
    ])
    return row.select(
        F.when(F.col("failures") > 0, "PARTIAL").otherwise("PASS").alias("status"),
        "tickers", "price_rows_upserted", "failures",
        F.lit(dry_run).alias("dry_run"), F.lit(start).alias("start"), F.lit(end).alias("end"),
    )
