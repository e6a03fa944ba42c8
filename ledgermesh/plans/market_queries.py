"""Queries over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import numbers as n
from ledgermesh.operators import market as m
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.registry import query
from ledgermesh.schemas import MARKET_SNAPSHOT
from ledgermesh.streaming.prices import run_incremental_once

STAMP = "2024-01-01T00:00:00+00:00"
LATER = "2024-02-01T00:00:00+00:00"


def prices(i: Inputs) -> DataFrame:
    """Stored price history."""
    return i.view("v_bars").select(
        "ticker", "trade_date", "close", "adjusted_close", "volume",
        F.lit("feed_raw").alias("data_source"), F.lit(STAMP).alias("updated_at"),
    )


def increment(i: Inputs) -> DataFrame:
    """Late bars, each twice; the second one of a session counts."""
    bars = i.view("v_increment").select(
        F.concat(F.lit(" "), F.lower("ticker")).alias("ticker"), "trade_date", "close", "adjusted_close", "volume",
        F.lit("feed_raw").alias("data_source"), F.lit(LATER).alias("updated_at"),
    )
    first = bars.withColumn("close", F.col("close") * 2).withColumn("seq", F.lit(1))
    return first.unionByName(bars.withColumn("seq", F.lit(2)))


def stored_snapshot(i: Inputs) -> DataFrame:
    """A snapshot with caps for every other ticker and one that has no price."""
    caps = i.view("v_caps").filter("market_cap > 0 and cast(substr(ticker,2,6) as int) % 2 = 0")
    blank = [
        F.lit(None).cast(f.dataType).alias(f.name)
        for f in MARKET_SNAPSHOT.fields
        if f.name not in ("ticker", "market_cap", "market_cap_data_source", "market_cap_updated_at", "updated_at")
    ]
    return caps.select(
        "ticker", *blank, "market_cap", F.lit("caps_feed").alias("market_cap_data_source"),
        F.lit(STAMP).cast("timestamp").alias("market_cap_updated_at"), F.lit(STAMP).cast("timestamp").alias("updated_at"),
    ).select(*MARKET_SNAPSHOT.names)


_FIGURES = """ticker, cast(as_of_date as varchar) as as_of_date, close, round(return_1d,9) as return_1d,
    round(return_5d,9) as return_5d, round(return_30d,9) as return_30d, round(avg_volume_30d,6) as avg_volume_30d,
    round(avg_dollar_volume_30d,6) as avg_dollar_volume_30d"""


def figures(df: DataFrame) -> DataFrame:
    return df.select(
        "ticker", F.col("as_of_date").cast("string").alias("as_of_date"), "close",
        *[F.round(c, 9).alias(c) for c in ("return_1d", "return_5d", "return_30d")],
        F.round("avg_volume_30d", 6).alias("avg_volume_30d"), F.round("avg_dollar_volume_30d", 6).alias("avg_dollar_volume_30d"),
    )


@query("market_snapshot", f"select {_FIGURES} from o_market")
def _(i):
    return figures(m.snapshot(prices(i)))


@query("canonical_snapshot", f"select {_FIGURES} from o_market where ticker in (select ticker from v_master)")
def _(i):
    return figures(m.canonical_snapshot(prices(i), i.view("v_master")))


@query(
    "session_returns",
    """select ticker, cast(trade_date as varchar) as trade_date, round(px/nullif(lag(px,1) over w,0)-1,9) as return_1d,
         round(px/nullif(lag(px,5) over w,0)-1,9) as return_5d, round(px/nullif(lag(px,30) over w,0)-1,9) as return_30d
       from (select *, coalesce(adjusted_close,close) as px from v_bars)
       window w as (partition by ticker order by trade_date)""",
)
def _(i):
    return m.session_returns(prices(i)).select(
        "ticker", F.col("trade_date").cast("string").alias("trade_date"),
        *[F.round(c, 9).alias(c) for c in ("return_1d", "return_5d", "return_30d")],
    )


@query(
    "rolling_average_volume",
    """select ticker, cast(trade_date as varchar) as trade_date,
         round(case when count(volume) over w=30 then sum(volume) over w/30.0 end,6) as avg_volume_30d
       from v_bars window w as (partition by ticker order by trade_date rows between 29 preceding and current row)""",
)
def _(i):
    return m.rolling_averages(prices(i)).select(
        "ticker", F.col("trade_date").cast("string").alias("trade_date"), F.round("avg_volume_30d", 6).alias("avg_volume_30d")
    )


@query("prune_prices", "select ticker, cast(trade_date as varchar) as trade_date, volume from o_rn where rn<=250")
def _(i):
    return m.prune_prices(prices(i)).select("ticker", F.col("trade_date").cast("string").alias("trade_date"), "volume")


_UPSERTED = """
    select b.ticker, cast(b.trade_date as varchar) as trade_date, coalesce(n.close,b.close) as close,
      coalesce(n.adjusted_close,b.adjusted_close) as adjusted_close, coalesce(n.volume,b.volume) as volume,
      case when n.ticker is null then '2024-01-01T00:00:00+00:00' else '2024-02-01T00:00:00+00:00' end as updated_at
    from v_bars b left join v_increment n on b.ticker=n.ticker and b.trade_date=n.trade_date"""


def _prices_out(df: DataFrame) -> DataFrame:
    return df.select(
        "ticker", F.col("trade_date").cast("string").alias("trade_date"), "close",
        "adjusted_close", "volume", "updated_at",
    )


@query("upsert_prices", _UPSERTED)
def _(i):
    return _prices_out(m.upsert_prices(prices(i), increment(i)))


@query("upsert_prices_replayed", _UPSERTED)
def _(i):
    once = m.upsert_prices(prices(i), increment(i))
    return _prices_out(m.upsert_prices(once, increment(i)))


@query("snapshot_after_increment", f"""
    select {_FIGURES} from (
      select ticker, max(case when rn=1 then trade_date end) as as_of_date, max(case when rn=1 then close end) as close,
        max(case when rn=1 then px end)/nullif(max(case when rn=2 then px end),0)-1 as return_1d,
        max(case when rn=1 then px end)/nullif(max(case when rn=6 then px end),0)-1 as return_5d,
        max(case when rn=1 then px end)/nullif(max(case when rn=31 then px end),0)-1 as return_30d,
        case when count(*)>=30 then sum(case when rn<=30 then volume end)/30.0 end as avg_volume_30d,
        case when count(*)>=30 then sum(case when rn<=30 then close*volume end)/30.0 end as avg_dollar_volume_30d
      from (select b.ticker, b.trade_date, coalesce(n.close,b.close) as close, coalesce(n.volume,b.volume) as volume,
          coalesce(n.adjusted_close,b.adjusted_close) as px,
          row_number() over (partition by b.ticker order by b.trade_date desc) as rn
        from v_bars b left join v_increment n on b.ticker=n.ticker and b.trade_date=n.trade_date)
      group by ticker)""")
def _(i):
    return figures(m.snapshot(m.prune_prices(m.upsert_prices(prices(i), increment(i)))))


@query(
    "valid_bars",
    """select 'S'||cast(l_suppkey as varchar) as ticker, cast(cast(l_shipdate as date) as varchar) as trade_date, count(*) as bars
       from lineitem where l_linenumber<>1 and l_linenumber<>2 and l_linenumber<>3 and (l_tax=0 or l_discount>0) group by 1,2""",
)
def _(i):
    day = F.col("l_shipdate").cast("date").cast("string")
    n_ = F.col("l_linenumber")
    bars = i.table("lineitem").select(
        F.when(n_ == 1, " ").otherwise(F.concat(F.lit("s"), F.col("l_suppkey").cast("string"))).alias("ticker"),
        F.when(n_ == 2, F.concat(F.substring(day, 1, 8), F.lit("45"))).otherwise(day).alias("trade_date"),
        F.when(F.col("l_tax") == 0, None).otherwise(F.col("l_discount")).alias("close"),
        F.when(n_ == 3, -1).when(n_ == 4, None).otherwise(F.lit(5)).alias("volume"), "l_discount",
    )
    kept = m.valid_bar(bars)
    return kept.groupBy("ticker", F.col("trade_date").cast("string").alias("trade_date")).agg(F.count("*").alias("bars"))


@query(
    "price_bars_from_feed",
    """select r.ticker, cast(r.trade_date as varchar) as trade_date, r.close, coalesce(r.volume,0) as volume,
         a.adjusted_close
       from (select ticker, trade_date, close, case when volume%7=0 then null else volume end as volume from v_bars) r
       left join (select * from v_bars where volume%3<>0) a on a.ticker=r.ticker and a.trade_date=r.trade_date""",
)
def _(i):
    stamp = F.concat(F.col("trade_date").cast("string"), F.lit("T05:00:00Z"))
    bar = F.struct(stamp.alias("t"), F.col("close").alias("c"), F.when(F.col("volume") % 7 != 0, F.col("volume")).alias("v"))
    raw = i.view("v_bars").select(F.create_map(F.lower("ticker"), F.array(bar)).alias("bars"))
    adjusted_bar = F.struct(stamp.alias("t"), F.col("adjusted_close").alias("c"))
    adjusted = i.view("v_bars").filter("volume % 3 <> 0").select(
        F.create_map(F.lower("ticker"), F.array(adjusted_bar)).alias("bars")
    )
    joined = m.to_price_bars(m.explode_bars(raw), m.explode_bars(adjusted), "feed_raw")
    return joined.select(
        "ticker", F.col("trade_date").cast("string").alias("trade_date"), "close",
        "volume", "adjusted_close",
    )


@query(
    "merge_snapshot",
    """select coalesce(m.ticker,c.ticker) as ticker, m.close, round(return_5d,9) as return_5d, c.market_cap,
         c.ticker is not null as had_cap, m.ticker is not null as rebuilt
       from o_market m full join (select * from v_caps where market_cap>0 and cast(substr(ticker,2,6) as int)%2=0) c
         on m.ticker=c.ticker""",
)
def _(i):
    new = m.snapshot(prices(i)).withColumn("price_updated_at", F.col("price_updated_at").cast("timestamp"))
    merged = m.merge_snapshot(stored_snapshot(i), new, F.lit(LATER).cast("timestamp"))
    return merged.select(
        "ticker", "close", F.round("return_5d", 9).alias("return_5d"), "market_cap",
        F.col("market_cap_updated_at").isNotNull().alias("had_cap"), F.col("price_updated_at").isNotNull().alias("rebuilt"),
    )


@query(
    "merge_caps",
    """select ticker, case when market_cap>0 then market_cap*2 end as market_cap, market_cap>0 as fresh from (
         select ticker, market_cap from v_caps where market_cap>0)""",
)
def _(i):
    caps = i.view("v_caps").withColumn("market_cap", F.col("market_cap") * 2)
    merged = m.merge_caps(stored_snapshot(i), caps, "caps_feed", F.lit(LATER).cast("timestamp"))
    return merged.select("ticker", "market_cap", (F.col("market_cap_updated_at") == F.lit(LATER).cast("timestamp")).alias("fresh"))


@query(
    "cap_failures",
    """select ticker, 'market_cap' as stage, 'missing_or_invalid_market_cap' as reason, '1' as attempt_count,
         '2024-01-01' as created_at from v_caps where market_cap is null or market_cap<=0""",
)
def _(i):
    return m.cap_failures(i.view("v_caps"), "2024-01-01")


@query(
    "merge_failures",
    """select ticker, 'price' as stage, reason, attempt_count, created_at from (
         select 'S'||cast(l_suppkey as varchar) as ticker, l_returnflag as reason, cast(l_linenumber as varchar) as attempt_count,
           cast(cast(l_shipdate as date) as varchar) as created_at,
           row_number() over (partition by l_suppkey, l_returnflag order by ((l_orderkey*100000+l_partkey)*10000+l_suppkey)*10+l_linenumber desc) as rn
         from lineitem) where rn=1""",
)
def _(i):
    rows = i.table("lineitem").select(
        F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), F.lit("price").alias("stage"),
        F.col("l_returnflag").alias("reason"), F.col("l_linenumber").cast("string").alias("attempt_count"),
        F.col("l_shipdate").cast("date").cast("string").alias("created_at"),
        (((F.col("l_orderkey") * 100000 + F.col("l_partkey")) * 10000 + F.col("l_suppkey")) * 10 + F.col("l_linenumber")).alias("seq"),
    )
    old = rows.filter("attempt_count = '1'").drop("seq").withColumn("created_at", F.lit("old")).dropDuplicates(["ticker", "stage", "reason"])
    return m.merge_failures(old, rows)


_ASKED = "select t1 as ticker from v_asked union select t2 from v_asked"


def asked(i: Inputs) -> DataFrame:
    return i.sql(_ASKED)


@query("missing_price_tickers", f"({_ASKED}) except select ticker from v_bars")
def _(i):
    return m.missing_tickers(asked(i), i.view("v_bars"))


@query(
    "price_run_summary",
    """select case when f>0 then 'PARTIAL' else 'PASS' end as status, t as tickers, b as price_rows_upserted, f as failures,
         false as dry_run, '2024-01-01' as start, '2024-01-31' as "end" from (
         select (select count(*) from (select t1 as ticker from v_asked union select t2 from v_asked)) as t, (select count(*) from v_increment) as b,
           (select count(*) from ((select t1 as ticker from v_asked union select t2 from v_asked) except select ticker from v_bars)) as f)""",
)
def _(i):
    missing = m.missing_tickers(asked(i), i.view("v_bars"))
    failures = m.failure_rows(missing, "price", "no_bars_returned", STAMP)
    return m.run_summary(asked(i), i.view("v_increment"), failures, "2024-01-01", "2024-01-31")


@query(
    "price_windows",
    """select o_orderkey, cast(cast(o_orderdate as date) - case when o_orderstatus='F' then 430 when o_orderstatus='P' then 430
         else 14 end as varchar) as start from orders""",
)
def _(i):
    mode = F.when(F.col("o_orderstatus") == "F", "backfill").when(F.col("o_orderstatus") == "P", "dry_run").otherwise("incremental")
    start = n.window_start(mode, F.col("o_orderdate").cast("date"))
    return i.table("orders").select("o_orderkey", start.cast("string").alias("start"))


@query(
    "event_session_dates",
    "select event_id, cast(cast(ts as date) as varchar) as session_date from events",
)
def _(i):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return i.table("events").select("event_id", n.bar_date(stamp).cast("string").alias("session_date"))


@query(
    "incremental_price_load",
    """select b.ticker, cast(b.trade_date as varchar) as trade_date, coalesce(n.close,b.close) as close,
         coalesce(n.adjusted_close,b.adjusted_close) as adjusted_close, coalesce(n.volume,b.volume) as volume
       from v_bars b left join v_increment n on b.ticker=n.ticker and b.trade_date=n.trade_date
       qualify row_number() over (partition by b.ticker order by b.trade_date desc)<=250""",
)
def _(i):
    return _prices_out(run_incremental_once(i.spark, prices(i), increment(i))).drop("updated_at")
