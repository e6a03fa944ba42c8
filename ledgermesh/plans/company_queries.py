"""Queries over the company master."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.operators import companies as co
from ledgermesh.operators.merge import numbered
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.registry import query
from ledgermesh.session import stage

STAMP = "2024-01-01T00:00:00+00:00"
COLUMNS = "ticker, company_name, universe, sector, industry, description, description_short, updated_at"


def members(i: Inputs) -> DataFrame:
    return co.membership(i.view("v_mem"))


def master(i: Inputs) -> DataFrame:
    return co.company_rows(members(i), i.view("v_meta"), STAMP)


def exclusions(i: Inputs) -> DataFrame:
    real, placeholders = co.split_placeholders(with_placeholders(i), STAMP)
    _, unknown = co.split_identity(co.with_metadata(real, i.view("v_meta")), STAMP)
    return co.all_exclusions(placeholders, unknown)


def with_placeholders(i: Inputs) -> DataFrame:
    """Memberships in which some tickers are placeholders."""
    number = F.substring("ticker", 2, 6).cast("int")
    broken = F.when(number % 13 == 0, " -- ").when(number % 13 == 1, "n/a").otherwise(F.col("ticker"))
    return co.membership(i.view("v_mem").withColumn("ticker", broken))


_BROKEN = """select ticker, string_agg(distinct universe,';' order by universe) as universe from (
    select case when cast(substr(ticker,2,6) as int)%13=0 then ' -- ' when cast(substr(ticker,2,6) as int)%13=1 then 'n/a'
      else ticker end as ticker, universe from v_mem) group by ticker"""


@query("company_master", f"select {COLUMNS} from o_companies")
def _(i):
    return master(i)


@query("membership", "select * from o_members")
def _(i):
    return members(i)


@query("union_universes", "select ticker, 'Q'||cast(cast(l_linenumber as int) as varchar) as universe from (select distinct 'S'||cast(l_suppkey as varchar) as ticker, l_linenumber from lineitem)")
def _(i):
    lines = i.table("lineitem").select(F.concat(F.lit("S"), F.col("l_suppkey").cast("string")).alias("ticker"), "l_linenumber")
    return co.union_universes({f"Q{n}": lines.filter(F.col("l_linenumber") == n) for n in range(1, 8)})


@query("company_metadata", "select ticker, universe, company_name, sector, industry, description from o_known")
def _(i):
    return co.with_metadata(members(i), i.view("v_meta"))


@query("real_tickers", f"select * from ({_BROKEN}) where ticker not in (' -- ','n/a')")
def _(i):
    return co.split_placeholders(with_placeholders(i), STAMP)[0]


@query("company_exclusions", f"""
    select ticker, universe, 'invalid_placeholder_ticker' as reason, '{STAMP}' as updated_at from ({_BROKEN}) where ticker in (' -- ','n/a')
    union all
    select ticker, universe, 'metadata_not_found_empty_company', '{STAMP}' from o_known
    where coalesce(company_name,sector,industry,description) is null and cast(substr(ticker,2,6) as int)%13>1""")
def _(i):
    return exclusions(i)


@query("exclusion_reasons", f"""
    select reason, count(*) as excluded_count from (
      select 'invalid_placeholder_ticker' as reason from ({_BROKEN}) where ticker in (' -- ','n/a')
      union all select 'metadata_not_found_empty_company' from o_known
      where coalesce(company_name,sector,industry,description) is null and cast(substr(ticker,2,6) as int)%13>1) group by 1""")
def _(i):
    return co.reason_counts(exclusions(i))


def audit(i: Inputs) -> DataFrame:
    """Audit over the brands as providers, one of them without tickers."""
    brands = i.table("part").select(F.col("p_brand").alias("universe")).distinct()
    idle = brands.select(F.lit("Brand#0").alias("universe")).distinct()
    providers = brands.unionByName(idle).withColumn("provider", F.concat(F.lit("list "), "universe"))
    return co.universe_audit(providers, i.view("v_mem"), STAMP)


@query("universe_audit", f"""
    select universe, 'list '||universe as provider, case when n>0 then 'fetched' else 'skipped' end as status, coalesce(n,0) as count,
      '{STAMP}' as fetched_at, case when coalesce(n,0)=0 then 'No tickers fetched for '||universe end as error
    from (select distinct p_brand as universe from part union all select 'Brand#0')
    left join (select universe, count(*) as n from v_mem group by 1) using (universe)""")
def _(i):
    return audit(i)


@query("universe_audit_summary", """
    select (select count(distinct universe) from v_mem) as fetched_universes,
      (select count(distinct p_brand)+1 from part)-(select count(distinct universe) from v_mem) as skipped_universes,
      (select count(*) from o_known where coalesce(company_name,sector,industry,description) is null) as excluded_company_count""")
def _(i):
    _, unknown = co.split_identity(co.with_metadata(members(i), i.view("v_meta")), STAMP)
    return co.audit_summary(audit(i), unknown)


@query("missing_metadata", """
    select count(*) as missing_metadata_count from o_companies
    where company_name is null or sector is null or industry is null or description is null""")
def _(i):
    return co.missing_metadata(master(i))


@query("check_companies", """
    select 'unexpected_columns' as "check", cast(0 as bigint) as bad_count union all
    select 'empty_ticker', (select count(*) from v_mem where cast(substr(ticker,2,6) as int)%11=0) union all
    select 'duplicate_ticker', (select count(*) from (select case when cast(substr(ticker,2,6) as int)%11=0 then '' else ticker end as t
      from v_mem group by 1, universe having true) where false)+(select count(*) from (select t from (
      select case when cast(substr(ticker,2,6) as int)%11=0 then '' else ticker end as t from v_mem) group by t having count(*)>1)) union all
    select 'empty_universe', (select count(*) from v_mem where universe='Brand#3')""")
def _(i):
    rows = i.view("v_mem").select(
        F.when(F.substring("ticker", 2, 6).cast("int") % 11 == 0, " ").otherwise(F.col("ticker")).alias("ticker"),
        F.lit("x").alias("company_name"),
        F.when(F.col("universe") == "Brand#3", "\t").otherwise(F.col("universe")).alias("universe"),
        *[F.lit("x").alias(c) for c in ("sector", "industry", "description", "description_short", "updated_at")],
    )
    return co.check_companies(rows)


@query("unsorted_export_rows", """
    select ticker, idx from (select *, row_number() over (order by ticker, idx)-1 as place from (
      select 'O'||lpad(cast(o_orderkey - case when o_orderkey%50=7 then 3 else 0 end as varchar),12,'0') as ticker,
        row_number() over (order by o_orderkey)-1 as idx from orders)) where place<>idx""")
def _(i):
    moved = F.col("o_orderkey") - F.when(F.col("o_orderkey") % 50 == 7, 3).otherwise(0)
    named = F.concat(F.lit("O"), F.lpad(moved.cast("string"), 12, "0"))
    export = numbered(i.table("orders").select("o_orderkey"), ["o_orderkey"], "idx").select(named.alias("ticker"), "idx")
    return co.unsorted_rows(export)


@query("companies_of_universe", "select distinct p_brand as ticker, p_type as company_name from part where p_brand='Brand#3'")
def _(i):
    rows = i.table("part").select(F.col("p_brand").alias("ticker"), F.col("p_type").alias("company_name"), F.upper("p_brand").alias("universe"))
    return co.select_companies(rows, universe="brand#3")


@query("companies_in_any_universe", "select distinct ticker, company_name from o_companies where list_contains(string_split(universe,';'),'BRAND#3') or list_contains(string_split(upper(universe),';'),'BRAND#3')")
def _(i):
    rows = master(i).withColumn("universe", F.upper("universe"))
    return co.select_companies(rows, universe="Brand#3", any_universe=True)


@query("company_page", "select ticker, company_name from o_companies order by 1,2 offset 20 limit 30")
def _(i):
    return co.page(co.select_companies(master(i)), 20, 30)


@query("company_batches", """
    select ticker, company_name, row_number() over (order by ticker, company_name)-1 as row_index,
      cast(floor((row_number() over (order by ticker, company_name)-1)/5) as bigint) as batch_index
    from (select distinct 'C'||cast(c_custkey as varchar) as ticker, c_name as company_name from customer)""")
def _(i):
    named = i.table("customer").select(F.concat(F.lit("C"), F.col("c_custkey").cast("string")).alias("ticker"), F.col("c_name").alias("company_name"))
    return co.assign_batches(named, 5, ["ticker", "company_name"])


_HOLDING = """case p_size%6 when 0 then 'Equity' when 1 then ' STOCK ' when 2 then '' when 3 then 'Cash and Derivatives'
    when 4 then 'Fixed Income' else 'equity' end"""
_HOLDING_NAME = "p_name||case p_partkey%9 when 0 then ' Treasury Bill' when 1 then ' Adoption Group' when 2 then ' Cash Fund' else '' end"


def holdings(i: Inputs) -> DataFrame:
    size, key = F.col("p_size") % 6, F.col("p_partkey") % 9
    asset = (
        F.when(size == 0, "Equity").when(size == 1, " STOCK ").when(size == 2, "").when(size == 3, "Cash and Derivatives")
        .when(size == 4, "Fixed Income").otherwise("equity")
    )
    suffix = F.when(key == 0, " Treasury Bill").when(key == 1, " Adoption Group").when(key == 2, " Cash Fund").otherwise("")
    ticker = F.when(F.col("p_partkey") % 7 == 0, "-").otherwise(F.concat(F.lit("p."), F.col("p_partkey").cast("string")))
    return i.table("part").select(ticker.alias("Ticker"), F.concat("p_name", suffix).alias("Name"), asset.alias("Asset Class"))


_HOLDINGS = f"""select case when p_partkey%7=0 then '-' else 'p.'||cast(p_partkey as varchar) end as ticker,
    {_HOLDING_NAME} as name, {_HOLDING} as asset from part"""
_TERMS = "cash|money market|treasury|collateral|future|futures|swap|option|derivative|receivable|payable"


@query("equity_holdings", f"""
    select ticker as "Ticker", name as "Name", asset as "Asset Class" from ({_HOLDINGS})
    where lower(trim(asset)) in ('','equity','stock') and not regexp_matches(lower(ticker||' '||name||' '||asset),'{_TERMS}')""")
def _(i):
    return co.is_equity(holdings(i))


@query("equity_holdings_legacy", f"""
    select ticker as "Ticker", name as "Name", asset as "Asset Class" from ({_HOLDINGS})
    where ticker<>'-' and (trim(asset)='' or lower(asset) like '%equity%') and lower(name) not like '%cash%' and lower(name) not like '%collateral%'""")
def _(i):
    return co.is_equity_legacy(holdings(i))


@query("short_descriptions", "select * from o_short")
def _(i):
    rows = i.view("v_meta").select("ticker", t.description_short(F.col("description")).alias("description_short"))
    return rows.filter("description_short is not null")


@query("short_documents", """
    select doc_id, case when length(t)<=300 then t when late<>'' then late when early<>'' then early
        else regexp_replace(regexp_replace(rtrim(substr(t,1,300)),'(?s) [^ ]*$',''),'[.,;:]+$','')||'...' end as short
    from (select doc_id, t, regexp_extract(t,'(?s)^(.{198,298}[.!?]) ',1) as late, regexp_extract(t,'(?s)^(.{118,197}[.!?]) ',1) as early
      from (select doc_id, trim(regexp_replace(text,'\\s+',' ','g')) as t from documents where text<>''))""")
def _(i):
    return i.table("documents").filter("text <> ''").select("doc_id", t.description_short(F.col("text")).alias("short"))


@query("normalized_tickers", """
    select p_partkey, case when up in ('','-','--','------------','*','—','N/A','NA','NAN','NONE','NULL','CASH','USD','US DOLLAR') then '' else up end as ticker
    from (select p_partkey, replace(regexp_replace(upper(raw),'\\s+','','g'),'.','-') as up from (
      select p_partkey, case p_partkey%5 when 0 then ' n/a ' when 1 then 'cash' when 2 then null
        else ' '||p_name||'.'||cast(p_partkey as varchar) end as raw from part))
    where up is not null union all select p_partkey, '' from part where p_partkey%5=2""")
def _(i):
    key = F.col("p_partkey") % 5
    raw = F.when(key == 0, " n/a ").when(key == 1, "cash").when(key == 2, None).otherwise(
        F.concat(F.lit(" "), "p_name", F.lit("."), F.col("p_partkey").cast("string"))
    )
    return i.table("part").select("p_partkey", t.normalize_ticker(raw).alias("ticker"))


@query("normalized_tickers_basic", "select p_partkey, replace(upper(trim(p_name)),'.','-')||'-'||cast(p_partkey as varchar) as ticker from part")
def _(i):
    raw = F.concat(F.lit("\n"), "p_name", F.lit("."), F.col("p_partkey").cast("string"), F.lit(" \t"))
    return i.table("part").select("p_partkey", t.normalize_ticker_basic(raw).alias("ticker"))


@query("collapsed_documents", "select doc_id, md5(trim(regexp_replace(text,'[\\s\\x{a0}\\x{85}\\x{1c}-\\x{1f}\\x{2028}\\x{2029}\\x{3000}\\x{2000}-\\x{200a}\\x{202f}]+',' ','g'))) as digest from documents")
def _(i):
    return i.table("documents").select("doc_id", F.md5(t.collapse_spaces(F.col("text"))).alias("digest"))


@query("header_labels", "select page_id, trim(regexp_replace(lower(trim(regexp_replace(url,'\\s+',' ','g'))),'[^a-z0-9]+',' ','g')) as label from pages")
def _(i):
    return i.table("pages").select("page_id", t.header_label(F.col("url")).alias("label"))


@query("last_updated_notes", """
    select o_orderkey, case when o_orderkey%3=0 then null else 'Last Updated '||cast(cast(o_orderdate as date) as varchar)||' by desk' end as note from orders""")
def _(i):
    page = F.concat(F.lit("<p>x</p><i>Last   Updated\t"), F.col("o_orderdate").cast("date").cast("string"), F.lit("  by desk </i>"))
    html = F.when(F.col("o_orderkey") % 3 == 0, F.lit("<p>none</p>")).otherwise(page)
    return i.table("orders").select("o_orderkey", t.last_updated(html).alias("note"))


@query("holdings_urls", """
    select page_id, url||'.csv' as first_url, 3 as urls from pages""")
def _(i):
    links = F.to_json(F.struct(
        F.struct(F.concat("url", F.lit("/about")).alias("home"), F.concat("url", F.lit(".csv")).alias("data")).alias("links"),
        F.array(F.lit("/files/list.xlsx?x=1"), F.concat("url", F.lit("/about"))).alias("more"),
    ))
    urls = t.extract_urls(links, "https://data.example.com")
    pages = i.table("pages").withColumn("urls", urls)
    return pages.select("page_id", t.holdings_url(F.col("urls")).alias("first_url"), F.size("urls").alias("urls"))
