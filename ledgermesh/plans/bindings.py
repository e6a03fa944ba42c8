"""Views that give the star-schema tables the shape of the engine's inputs.

Each view is plain SQL both Spark and the checking database accept. ``{table}``
stands for an input table; a view may name other views.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages"
    " benchmark labels conversations"
).split()

VIEWS = {
    # Raw relationships: company = supplier, person = customer, years as stamps.
    "v_raw": """
        select ((l_orderkey*100000+l_partkey)*10000+l_suppkey)*10+l_linenumber as id,
          'S'||lpad(cast(l_suppkey as varchar(20)),6,'0') as ticker,
          case when l_linenumber=1 then 'Dr. ' when l_linenumber=2 then 'Mr. ' else '' end
            ||'Customer '||cast(o_custkey as varchar(20))
            ||case when l_linenumber=3 then ', Jr.' else '' end as person_name,
          case l_partkey%6 when 0 then 'President and Chief Executive Officer' when 1 then 'EVP and CFO'
            when 2 then 'Independent Chair of the Board' when 3 then 'Director'
            when 4 then 'General Counsel' else '' end as role,
          case when l_linestatus='F' then 'EXECUTIVE' else 'BOARD' end as role_category,
          s_name as company_name,
          substr(cast(cast(o_orderdate as date) as varchar(20)),1,4) as created_at,
          case when l_partkey%10=0 then null
            else substr(cast(cast(l_shipdate as date) as varchar(20)),1,4) end as updated_at
        from {lineitem} join {orders} on l_orderkey=o_orderkey join {supplier} on l_suppkey=s_suppkey""",
    # Bars: one session per supplier and ship date.
    "v_bars": """
        select 'S'||lpad(cast(l_suppkey as varchar(20)),6,'0') as ticker,
          cast(l_shipdate as date) as trade_date,
          cast(sum(cast(l_extendedprice as decimal(12,2))) as double)/sum(l_quantity) as close,
          cast(sum(cast(l_extendedprice as decimal(12,2))*(1-cast(l_discount as decimal(4,2)))) as double)
            /sum(l_quantity) as adjusted_close,
          cast(sum(l_quantity) as bigint) as volume
        from {lineitem} group by 1,2""",
    # Index membership.
    "v_mem": """
        select distinct 'S'||lpad(cast(l_suppkey as varchar(20)),6,'0') as ticker, p_brand as universe
        from {lineitem} join {part} on l_partkey=p_partkey""",
    # Metadata; every 17th company has none, every 5th no sector.
    "v_meta": """
        select 'S'||lpad(cast(s_suppkey as varchar(20)),6,'0') as ticker,
          case when s_suppkey%17=0 then null else s_name end as company_name,
          case when s_suppkey%17=0 or s_suppkey%5=0 then null else r_name end as sector,
          case when s_suppkey%17=0 then null else n_name end as industry,
          case when s_suppkey%17=0 then null else text end as description
        from {supplier} join {nation} on s_nationkey=n_nationkey join {region} on n_regionkey=r_regionkey
          left join {documents} on doc_id=s_suppkey""",
    # Company master: listed tickers, one in ten left out.
    "v_master": """
        select distinct ticker from v_mem where cast(substr(ticker,2,6) as integer)%10 <> 3""",
    # Bipartite links with eight components, and with twenty of uneven size.
    "v_islands": """
        select distinct 'S'||lpad(cast(l_suppkey as varchar(20)),6,'0') as ticker,
          'P'||cast(o_custkey-o_custkey%8+l_suppkey%8 as varchar(20)) as person_id
        from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    "v_ragged": """
        select distinct 'S'||lpad(cast(l_suppkey as varchar(20)),6,'0')||'/'||cast(cast(floor(sqrt(o_custkey%400)) as integer) as varchar(20)) as ticker,
          'P'||cast(o_custkey as varchar(20)) as person_id
        from {lineitem} join {orders} on l_orderkey=o_orderkey""",
    # Late bars: the last 14 days of each ticker, one percent up.
    "v_increment": """
        select b.ticker, b.trade_date, b.close*1.01 as close, b.adjusted_close*1.01 as adjusted_close,
          b.volume+1 as volume
        from v_bars b join (select ticker, max(trade_date) as last_date from v_bars group by ticker) m
          on b.ticker=m.ticker where b.trade_date > m.last_date - interval '14' day""",
    # Market caps, some missing or not positive.
    "v_caps": """
        select 'S'||lpad(cast(s_suppkey as varchar(20)),6,'0') as ticker,
          case when s_suppkey%9=0 then null when s_suppkey%7=0 then -s_acctbal else s_acctbal end as market_cap
        from {supplier}""",
    # Filings: form, date and accession of every order of a customer.
    "v_filings": """
        select cast(o_custkey as varchar(20)) as cik,
          case substr(o_orderpriority,1,1) when '1' then '10-K' when '2' then '10-K/A' when '3' then '8-K'
            when '4' then '10 k' else '10-Q' end as form,
          cast(cast(o_orderdate as date) as varchar(20)) as filing_date,
          lpad(cast(o_custkey as varchar(20)),10,'0')||'-'
            ||substr(cast(cast(o_orderdate as date) as varchar(20)),3,2)||'-'
            ||lpad(cast(o_orderkey as varchar(20)),6,'0') as accession,
          'doc'||cast(o_orderkey as varchar(20))||'.htm' as document,
          o_orderkey as pos
        from {orders}""",
    # Answers: one per order, asking for two companies, with all kinds of faults.
    "v_asked": """
        select o_orderkey as k, 'b'||cast(o_orderkey as varchar(20)) as batch_id, o_orderkey%11 as fault,
          'S'||lpad(cast(o_custkey%97 as varchar(20)),6,'0') as t1,
          'T'||lpad(cast(o_orderkey%89 as varchar(20)),6,'0') as t2,
          'Customer '||cast(o_custkey as varchar(20)) as name1,
          case when o_orderstatus='F' then 'EXECUTIVE' else 'BOARD' end as category1
        from {orders}""",
    "v_answers": """
        select k, batch_id, t1, t2, case fault when 0 then '  ' when 1 then substr(body,1,40)
            when 2 then '```json'||chr(10)||body||chr(10)||'```' when 4 then '[1,2]' when 5 then '{"companies":"none"}'
            else chr(10)||body||' ' end as raw_response
        from (select *, '{"companies":[{"ticker":"'||case fault when 6 then lower(t1) else t1 end||'","relationships":['
            ||case fault when 7 then '' else '{"person_name":"'||name1||'","role":"Chief Executive Officer","role_category":"'
              ||case fault when 6 then lower(category1) else category1 end||'"},{"person_name":" ","role":"Director","role_category":"BOARD"},'
              ||'{"person_name":"Dr. '||name1||'","role":"Advisor","role_category":"ADVISOR"}' end||']}'
            ||case fault when 3 then '' else ',{"ticker":"'||t2||'","relationships":[{"person_name":"'||name1
              ||'","role":"Director","role_category":"BOARD"}]}' end||']}' as body from v_asked)""",
    # Service responses: one per event, the text in either place or missing.
    "v_responses": """
        select event_id, 'r'||cast(event_id as varchar(20)) as batch_id, event_id%5 as kind, user_id,
          '{"id":"resp_'||cast(event_id as varchar(20))||'","model":'||case event_id%3 when 0 then 'null' else '"model-b"' end
          ||',"status":"completed",'||case event_id%5 when 0 then '"output_text":"direct '||event_type||'",' when 1 then '"output_text":"  ",' else '' end
          ||'"output":['||case event_id%5 when 2 then '' else '{"type":"reasoning"},{"type":"message","role":"'
            ||case event_id%5 when 3 then 'user' else 'assistant' end||'","content":[{"type":"output_text","text":"'||event_type
            ||'"},{"type":"refusal","text":"no"},{"type":"output_text","text":"user '||cast(user_id as varchar(20))||'"}]}' end
          ||'],"usage":{'||case event_id%4 when 0 then '"prompt_tokens":'||cast(user_id as varchar(20))||',"completion_tokens":"7"'
            when 1 then '"input_tokens":'||cast(user_id as varchar(20))||',"output_tokens":"x"'
            else '"input_tokens":'||cast(user_id as varchar(20))||',"output_tokens":9,"total_tokens":'||cast(user_id+9 as varchar(20))
              ||',"input_tokens_details":{"cached_tokens":3}' end||'}}' as response
        from {events}""",
    # Signers of invented filings: three names per part.
    "v_signers": """
        select p_partkey as k, p_partkey%10 as layout,
          upper(substr(p_name,1,1))||substr(p_name,2,instr(p_name,' ')-2)||' '
            ||upper(substr(p_name,instr(p_name,' ')+1,1))||substr(p_name,instr(p_name,' ')+2) as n1,
          substr(p_type,1,1)||lower(substr(p_type,2))||' '
            ||upper(substr(p_name,instr(p_name,' ')+1,1))||substr(p_name,instr(p_name,' ')+2)||'son' as n2,
          upper(substr(p_name,1,1))||substr(p_name,2,instr(p_name,' ')-2)||' '||substr(p_type,1,1)||lower(substr(p_type,2))||'ton' as n3
        from {part}""",
    "v_docs": """
        select k as doc_id, '<html><body><h1>SIGNATURES</h1>'||case when layout in (3,5,7,8) then '' else
            '<p>Pursuant to the requirements of the Securities Exchange&nbsp;Act of 1934, this report has been signed.</p>' end
          ||case layout
            when 0 then '<table><tr><th>Signature</th><th>Title</th><th>Date</th></tr><tr><td>/s/ '||n1||'<br>'||n1
              ||'</td><td>President, Chief Executive Officer and Director</td><td>July 1</td></tr><tr><td>'||n2
              ||'</td><td>Chief Financial Officer</td></tr><tr><td>/s/ '||n3||'</td><td>Director</td></tr></table>'
            when 1 then '<table><tr><td>'||n1||'</td><td>Director</td><td>'||n2||'</td><td>Chief Financial Officer</td></tr></table>'
            when 2 then '<table><tr><th>Signature</th><th>Title</th><th>Signature</th><th>Title</th></tr><tr><td>/s/ '||n1
              ||'</td><td>Chief Executive Officer</td><td>'||n2||' Title</td><td>Principal Financial Officer</td></tr></table>'
            when 3 then '<p>/s/ '||n1||'</p><p>Chief Financial Officer and Director</p>'
            when 4 then '<table><tr><td>'||n1||'</td><td>'||n2||' Chief Executive Officer</td></tr></table>'
            when 5 then '<p>/s/ '||n1||' '||n1||' Director Principal Financial Officer</p>'
            when 6 then '<table><tr><th>Signature</th><th>Name</th><th>Title</th></tr><tr><td>/s/</td><td>'||n1
              ||'</td><td>Chief Executive Officer and Director</td></tr></table>'
            when 7 then '<p>No one signed here.</p>'
            when 8 then '<table><tr><td>Signature</td><td>Capacity</td></tr><tr><td>'||upper(n1)||'</td><td>Director</td></tr></table>'
            else '<table><tr><td>Dr. '||n1||', Jr.</td><td>CFO</td></tr><tr><td>'||n2||'</td><td>Director</td></tr></table>' end
          ||'</body></html>' as html
        from v_signers""",
    # Governance items of the same parts.
    "v_item10_docs": """
        select k as doc_id, '<p>Item 10. Directors and Officers</p><p>In charge is '||n1
          ||', Chief Financial Officer since 2001; and '||n2||', Director; the directors are '||n2||' and '||n3||'.</p><p>'
          ||repeat('filler words stand here and there. ',20)||'</p><p>Item 11. Pay</p><p>'||n3||', Chief Financial Officer</p>' as html
        from v_signers""",
    # Filings with a governance item, a signature page, or both.
    "v_reports": """
        select k as doc_id, '<html><body>'||case when k%3=2 then '' else '<p>Item 10. Directors and Officers</p><p>In charge is '||n1
            ||', Chief Financial Officer since 2001; and '||n2||', Director; the directors are '||n2||' and '||n3||'.</p><p>'
            ||repeat('filler words stand here and there. ',20)||'</p><p>Item 11. Remuneration follows.</p>' end
          ||case when k%3=1 then '' else '<h1>SIGNATURES</h1><p>Pursuant to the requirements of the Securities Exchange Act of 1934, this report has been signed.</p>'
            ||'<table><tr><td>/s/ '||n1||'</td><td>Chief Financial Officer since 2001</td></tr><tr><td>'||n3||'</td><td>Director</td></tr></table>' end||'</body></html>' as html
        from v_signers""",
    # Name candidates of sixteen kinds.
    "v_candidates": """
        select k, k%16 as kind, case k%16 when 0 then n1 when 1 then 'Dr. '||n1||', Jr.' when 2 then n1||', Age 55'
          when 3 then ' - ' when 4 then 'Chief Executive Officer' when 5 then 'Officer Pursuant' when 6 then n1||' Restricted Stock'
          when 7 then substr(n1,1,instr(n1,' ')-1) when 8 then n1||' '||n2||' '||n3 when 9 then 'Vice Chairman'
          when 10 then n1||' Plan' when 11 then n1||' and '||n2 when 12 then n1||' Holdings' when 13 then lower(n1)
          when 14 then 'Legal Proceedings Business' else 'Executive Vice President' end as candidate from v_signers""",
    # Holdings files as text, one per part.
    "v_files": """
        select k as file, 'Fund report for '||n1||chr(10)||'As of today'||chr(13)||chr(10)
          ||case k%3 when 0 then 'Ticker,Name,Asset Class' when 1 then 'Name,Symbol,Asset Class' else 'Name, TICKER ,Weight' end||chr(10)
          ||case k%3 when 0 then 'p.'||cast(k as varchar(20))||',"'||n1||', Inc",Equity' when 1 then n1||',q '||cast(k as varchar(20))||',Stock'
            else '"say '||chr(34)||chr(34)||n1||chr(34)||chr(34)||'",r-'||cast(k as varchar(20))||',1.5' end||chr(10)
          ||case k%3 when 2 then 'Cash fund,cash,2' else 'USD,Some cash,Cash' end||chr(10)||chr(10) as content
        from v_signers""",
    # Spreadsheet XML, one workbook per part.
    "v_workbooks": """
        select k as file, '<?xml version="1.0"?><Workbook xmlns="urn:x" xmlns:ss="urn:y"><Worksheet ss:Name="Notes"><Table><Row><Cell><Data>'
          ||case k%2 when 0 then 'Ticker' else 'About' end||'</Data></Cell></Row></Table></Worksheet><Worksheet ss:Name="'
          ||case k%3 when 0 then 'Holdings' else 'Sheet' end||'"><Table><Row><Cell><Data ss:Type="String">Ticker</Data></Cell><Cell ss:Index="3"><Data>Name</Data></Cell></Row>'
          ||'<Row><Cell><Data>W.'||cast(k as varchar(20))||'</Data></Cell><Cell/><Cell><Data>'||n1||' & '||n2||chr(8)||' &lt;x&gt;</Data></Cell></Row>'
          ||'<Row><Cell><Data>last</Data></Cell></Row></Table></Worksheet></Workbook>' as xml
        from v_signers""",
}


def _names_in(sql: str, known: dict[str, str]) -> list[str]:
    return [name for name in known if re.search(rf"\b{name}\b", sql)]


def _needed(sql: str, known: dict[str, str], seen: list[str]) -> None:
    for name in _names_in(sql, known):
        if name not in seen:
            _needed(known[name], {k: v for k, v in known.items() if k != name}, seen)
            seen.append(name)


def with_views(sql: str, extra: dict[str, str] | None = None, keyword: str = "with") -> str:
    """``sql`` behind the views it names, dependencies first."""
    known = {**VIEWS, **(extra or {})}
    names: list[str] = []
    _needed(sql, known, names)
    if not names:
        return sql
    views = ",\n".join(f"{name} as ({known[name]})" for name in names)
    own = sql.strip()
    return f"{keyword} {views},\n{own[5:]}" if own.startswith("with ") else f"{keyword} {views}\n{own}"


class Inputs:
    """The input tables and views of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def sql(self, text: str) -> DataFrame:
        """Run SQL over views; tables are read from the folder."""
        full = with_views(text)
        prefix = "t" + hashlib.md5(self.folder.encode()).hexdigest()[:12]
        for name in TABLES:
            if "{" + name + "}" in full:
                self.table(name).createOrReplaceTempView(f"{prefix}_{name}")
                full = full.replace("{" + name + "}", f"{prefix}_{name}")
        return self.spark.sql(full)

    def view(self, name: str) -> DataFrame:
        return self.sql(f"select * from {name}")


def plain(sql: str, extra: dict[str, str]) -> str:
    """The same SQL for a database where the tables are registered by name."""
    full = with_views(sql, extra, "with recursive")
    for name in TABLES:
        full = full.replace("{" + name + "}", name)
    return full
