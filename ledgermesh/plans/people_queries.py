"""Queries over raw relationships: snapshot, canonical rows, people."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.operators import canonical as c
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.registry import query
from ledgermesh.session import stage
from ledgermesh.sources import tables


def relationships(i: Inputs) -> DataFrame:
    return c.normalize(i.view("v_raw"), i.view("v_master"))


def stored_relationships(i: Inputs) -> DataFrame:
    """Canonical relationships as the written table later steps read."""
    return stage(relationships(i), "relationships")


RAW = "id, ticker, person_name, role, role_category, company_name, created_at, updated_at"


@query("latest_snapshot", f"select {RAW} from o_snap")
def _(i):
    return c.latest_snapshot(i.view("v_raw"))


@query("filter_to_master", f"select {RAW} from o_kept")
def _(i):
    return c.filter_to_master(c.latest_snapshot(i.view("v_raw")), i.view("v_master"))


@query("excluded_tickers", "select distinct ticker from o_snap except select ticker from v_master")
def _(i):
    return c.excluded_tickers(c.latest_snapshot(i.view("v_raw")), i.view("v_master"))


@query("master_tickers", "select distinct ticker from v_mem")
def _(i):
    mixed = i.view("v_mem").select(F.concat(F.lit(" "), F.lower("ticker"), F.lit("\t")).alias("ticker"))
    return tables.master_tickers(mixed)


@query("canonical_tickers", "select ticker, min(id) as first_idx from v_raw group by ticker")
def _(i):
    return tables.canonical_tickers(i.view("v_raw").withColumn("ticker", F.lower("ticker")), "id")


@query(
    "head_tickers",
    "select ticker, min(id) as first_idx from v_raw group by ticker order by 2 limit 25",
)
def _(i):
    return tables.head_tickers(i.view("v_raw"), 25, "id")


@query("head_tickers_no_limit", "select ticker, min(id) as first_idx from v_raw group by ticker")
def _(i):
    return tables.head_tickers(i.view("v_raw"), 0, "id")


@query(
    "retry_tickers",
    "select 'C'||cast(o_custkey as varchar) as ticker, min(o_orderkey) as first_idx from orders group by 1",
)
def _(i):
    listed = i.table("orders").select(
        F.concat(F.lit(" c"), F.col("o_custkey").cast("string")).alias("ticker"), F.col("o_orderkey").alias("idx")
    )
    return tables.retry_tickers(listed)


@query(
    "read_retry_list",
    """select o_orderkey as idx, 'C'||cast(o_custkey as varchar) as ticker,
         'Customer '||cast(o_custkey as varchar) as company_name from orders""",
)
def _(i):
    key = F.col("o_custkey").cast("string")
    listed = i.table("orders").select(
        F.concat(F.lit(" c"), key).alias("ticker"), F.concat(F.lit("Customer "), key, F.lit("\n")).alias("company_name"),
        F.col("o_orderkey").alias("idx"),
    )
    return tables.read_retry_list(listed)


@query(
    "read_universe",
    """select idx, ticker, cik, company_name from (
         select o_orderkey as idx, 'C-'||cast(o_custkey as varchar) as ticker,
           cast(o_custkey as varchar) as cik, 'Order '||cast(o_orderkey as varchar) as company_name
         from orders where o_custkey%10<>0)
       qualify row_number() over (partition by ticker order by idx)=1""",
)
def _(i):
    key = F.col("o_custkey").cast("string")
    blank = F.col("o_custkey") % 10 == 0
    rows = i.table("orders").select(
        F.when(blank, " ").otherwise(F.concat(F.lit(" c."), key)).alias("ticker"),
        F.concat(F.lit(" "), key).alias("cik"),
        F.concat(F.lit("Order \xa0 "), F.col("o_orderkey").cast("string"), F.lit(" ")).alias("company_name"),
        F.col("o_orderkey").alias("idx"),
    )
    return tables.read_universe(rows)


@query("read_relationships", "select ticker, company_name, person_id, person_name, role, role_category, extraction_time from o_canon")
def _(i):
    padded = relationships(i).select(*[F.concat(F.lit("\t "), F.col(n), F.lit(" \n")).alias(n) for n in tables.RELATIONSHIPS.names])
    return tables.read_relationships(padded)


@query("restrict_to_tickers", f"select {RAW} from v_raw where ticker in (select ticker from v_master)")
def _(i):
    return tables.restrict(i.view("v_raw"), i.view("v_master"))


@query(
    "incomplete_rows",
    "select ticker, count(*) as skipped from o_kept where trim(role)='' group by ticker",
)
def _(i):
    kept = c.filter_to_master(c.latest_snapshot(i.view("v_raw")), i.view("v_master"))
    _, incomplete = c.split_incomplete(kept)
    return incomplete.groupBy("ticker").agg(F.count("*").alias("skipped"))


@query("canonical_relationships", "select * from o_canon")
def _(i):
    return relationships(i)


@query("canonical_order", "select * from o_canon order by all")
def _(i):
    return c.canonical_order(relationships(i))


@query(
    "dedupe_latest",
    """select * from o_typed qualify row_number() over (
         partition by ticker, person_id, role, role_category order by extraction_time desc, id desc)=1""",
)
def _(i):
    complete, _ = c.split_incomplete(c.filter_to_master(c.latest_snapshot(i.view("v_raw")), i.view("v_master")))
    keyed = complete.withColumn("person_id", t.person_id_for(F.col("person_name"))).withColumn(
        "role", t.normalized_role(F.col("role"), F.col("role_category"))
    )
    return c.dedupe_latest(keyed)


@query(
    "normalize_summary",
    """select (select count(*) from v_raw) as source_row_count,
         (select count(*) from o_snap) as selected_latest_snapshot_row_count,
         (select count(*) from v_master) as company_master_ticker_count,
         (select count(distinct ticker) from o_snap) as raw_snapshot_distinct_ticker_count,
         (select count(distinct ticker) from o_snap where ticker not in (select ticker from v_master)) as excluded_ticker_count,
         (select count(distinct ticker) from o_canon) as canonical_ticker_count,
         (select count(*) from o_canon) as canonical_relationship_count,
         (select count(*) from o_kept where trim(role)='') as skipped_row_count""",
)
def _(i):
    # Each is read several times: without a written table the joins of the view would run for every read.
    raw, master = stage(i.view("v_raw"), "raw"), stage(i.view("v_master"), "master")
    snapshot = stage(c.latest_snapshot(raw), "snapshot")
    canonical = stage(c.normalize(raw, master, snapshot), "relationships")
    return c.normalize_summary(raw, master, canonical, snapshot)


@query("derive_people", "select * from o_people")
def _(i):
    return c.derive_people(relationships(i))


@query(
    "people_summary",
    """select (select count(*) from o_canon) as relationship_rows_read,
         (select count(*) from o_people) as unique_people_rows_written,
         (select count(*) from o_canon where person_id='') as skipped_blank_person_id_rows""",
)
def _(i):
    rel = stored_relationships(i)
    return c.people_summary(rel, c.derive_people(rel))
