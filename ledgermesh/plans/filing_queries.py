"""Queries over filings: sources, names, extraction, and coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import names as n
from ledgermesh.functions import text as t
from ledgermesh.operators import extraction as x
from ledgermesh.operators import filings as fl
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.people_queries import stored_relationships
from ledgermesh.plans.registry import query
from ledgermesh.session import spread, stage
from ledgermesh.sources import holdings as h
from ledgermesh.sources import html as w
from ledgermesh.sources import submissions as s

BASE = "https://filings.example.com/data/"


def signers(i: Inputs) -> DataFrame:
    """Signers over all tasks: the table is small, parsing the documents made from it is not."""
    return spread(i.view("v_signers"))


# --- sources -----------------------------------------------------------------


@query("page_texts", """
    select page_id, md5(trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(html,
      '(?is)<!--.*?-->|<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!doctype[^>]*>',' ','g'),'(?s)<[^>]*>',' ','g'),
      '&copy;','©'),'&quot;','"'),'&middot;','·'),'&lt;','<'),'&gt;','>'),'&amp;','&'),'[\\s\\x{a0}\\x{85}\\x{2000}-\\x{200a}\\x{3000}]+',' ','g'))) as digest from pages""")
def _(i):
    return i.table("pages").select("page_id", F.md5(w.html_text(F.col("html"))).alias("digest"))


@query("sanitized_pages", """
    select page_id, md5(regexp_replace(replace(regexp_replace(html,'[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F]','','g'),'&','&amp;'),
      '&amp;(#\\d+;|#x[0-9A-Fa-f]+;|[A-Za-z_:][A-Za-z0-9_.:-]*;)','&\\1','g')) as digest from pages""")
def _(i):
    return i.table("pages").select("page_id", F.md5(h.sanitize_xml(F.col("html"))).alias("digest"))


_CELL_TEXT = "trim(regexp_replace(replace(regexp_replace(c,'<[^>]*>',' ','g'),'&nbsp;',' '),'\\s+',' ','g'))"
_TABLE_ROWS = """
    select doc_id, rn-1 as row_no, unnest(regexp_extract_all(r,'<t[hd]>(.*?)</t[hd]>',1)) as c, generate_subscripts(regexp_extract_all(r,'<t[hd]>(.*?)</t[hd]>',1),1) as cn
    from (select doc_id, unnest(regexp_extract_all(html,'<tr>(.*?)</tr>',1)) as r, generate_subscripts(regexp_extract_all(html,'<tr>(.*?)</tr>',1),1) as rn from v_docs)"""


@query("html_table_rows", f"""
    select doc_id, cast(row_no as int) as row_no, string_agg({_CELL_TEXT},'|' order by cn) as cells from ({_TABLE_ROWS}) group by 1,2""")
def _(i):
    rows = w.html_table_rows(i.view("v_docs"))
    return rows.select("doc_id", "row_no", F.array_join("cells", "|").alias("cells"))


@query("html_table_cell_lines", f"""
    select doc_id, cast(row_no as int) as row_no, string_agg(trim(replace(c,'<br>','/')),'|' order by cn) as cells from ({_TABLE_ROWS}) group by 1,2""")
def _(i):
    rows = w.html_table_cell_lines(i.view("v_docs"))
    joined = F.transform("cells", lambda lines: F.array_join(lines, "/"))
    return rows.select("doc_id", "row_no", F.array_join(joined, "|").alias("cells"))


@query("page_tables", "select page_id, len(regexp_extract_all(html,'(?is)<table\\b')) as tables from pages where regexp_matches(html,'(?is)<table\\b')")
def _(i):
    return w.html_tables(i.table("pages"), "page_id").groupBy("page_id").agg(F.count("*").alias("tables"))


@query("nested_tables", """
    select page_id, cast(2*m+case when r.nth=3 then 1 else 0 end as int) as table_no, cast(r.nth%3 as int) as row_no, replace(r.cells,'#',cast(page_id as varchar)) as cells
    from (select page_id, unnest(range(0,1+page_id%3)) as m from pages)
      cross join (values (0,'outer|#'),(1,'inner a & b|inner|a & b'),(2,'inner|a & b'),(3,'inner|a & b')) r(nth,cells)""")
def _(i):
    table = F.concat(
        F.lit("<table class='a>b'><tr><td>outer</td><td>"), F.col("page_id").cast("string"),
        F.lit("<!-- <table> --></td></tr><tr><td><TABLE><tr><th>inner<td>a &amp; b</TABLE></td></tr></table><br>"),
    )
    html = F.concat("html", F.repeat(table, (F.col("page_id") % 3 + 1).cast("int")))
    rows = w.html_table_rows(i.table("pages").select("page_id", html.alias("html")), "page_id")
    return rows.select("page_id", "table_no", "row_no", F.array_join("cells", "|").alias("cells"))


@query("constituents_from_html", "select k as doc_id, 'BRK-'||cast(k as varchar) as ticker from v_signers union all select k, 'Q'||cast(k as varchar) from v_signers where k%2=0")
def _(i):
    key = F.col("k").cast("string")
    second = F.when(F.col("k") % 2 == 0, F.concat(F.lit("<tr><td>q "), key, F.lit("</td></tr>"))).otherwise("<tr><td>--</td><td>none</td></tr>")
    html = F.concat(
        F.lit("<table><tr><th>Other</th></tr><tr><td>X</td></tr></table><table><tr><th>Symbol</th><th>Company Name</th></tr><tr><td></td></tr></table>"),
        F.lit("<TABLE class=a><tr><th> Symbol </th><th>Company&nbsp;Name</th></tr><tr><td>brk."), key, F.lit("</td><td>B</td></tr>"), second, F.lit("</TABLE>"),
    )
    return w.constituents_from_html(signers(i).select(F.col("k").alias("doc_id"), html.alias("html")), "symbol", ["company name"])


def file_lines(i: Inputs) -> DataFrame:
    lines = F.split("content", r"\r\n|[\r\n]")
    return i.view("v_files").select("file", F.posexplode(lines).alias("idx", "line"))


_TICKER = "case k%3 when 0 then 'p.'||cast(k as varchar) when 1 then 'q '||cast(k as varchar) else 'r-'||cast(k as varchar) end"


@query("preamble_csv", f"""
    select file, cast(idx as int) as idx, cells from (
      select k as file, 2 as idx, case k%3 when 0 then 'Ticker|Name|Asset Class' when 1 then 'Name|Symbol|Asset Class' else 'Name| TICKER |Weight' end as cells from v_signers
      union all select k, 3, case k%3 when 0 then {_TICKER}||'|'||n1||', Inc|Equity' when 1 then n1||'|'||{_TICKER}||'|Stock' else 'say "'||n1||'"|'||{_TICKER}||'|1.5' end from v_signers
      union all select k, 4, case k%3 when 2 then 'Cash fund|cash|2' else 'USD|Some cash|Cash' end from v_signers
      union all select k, 0, 'Fund report for '||n1 from v_signers where k%3=1 union all select k, 1, 'As of today' from v_signers where k%3=1)""")
def _(i):
    return h.read_preamble_csv(file_lines(i), "Ticker").withColumn("cells", F.array_join("cells", "|"))


@query("promoted_headers", f"""
    select k as file, 3 as idx, 2 as header_idx, case k%3 when 0 then 'Ticker|Name|Asset Class' when 1 then 'Name|Symbol|Asset Class' else 'Name|TICKER|Weight' end as header,
      case k%3 when 0 then {_TICKER}||'|'||n1||', Inc|Equity' when 1 then n1||'|'||{_TICKER}||'|Stock' else 'say "'||n1||'"|'||{_TICKER}||'|1.5' end as cells from v_signers
    union all select k, 4, 2, case k%3 when 0 then 'Ticker|Name|Asset Class' when 1 then 'Name|Symbol|Asset Class' else 'Name|TICKER|Weight' end,
      case k%3 when 2 then 'Cash fund|cash|2' else 'USD|Some cash|Cash' end from v_signers""")
def _(i):
    rows = file_lines(i).select("file", "idx", h.csv_cells(F.col("line")).alias("cells"))
    promoted = h.promote_header(rows, ["ticker", "symbol", "name", "weight"])
    return promoted.withColumn("header", F.array_join("header", "|")).withColumn("cells", F.array_join("cells", "|"))


@query("holdings_tickers", f"select k as file, upper(replace(replace({_TICKER},' ',''),'.','-')) as ticker from v_signers")
def _(i):
    rows = file_lines(i).select("file", "idx", h.csv_cells(F.col("line")).alias("cells"))
    return h.holdings_tickers(rows, ["ticker", "symbol", "name", "weight"], ["ticker", "symbol"])


@query("workbook_rows", """
    select k as file, 0 as idx, 'Ticker||Name' as cells from v_signers where k%3=0 or k%2=1
    union all select k, 1, 'W.'||cast(k as varchar)||'||'||n1||' & '||n2||' <x>' from v_signers where k%3=0 or k%2=1
    union all select k, 2, 'last||' from v_signers where k%3=0 or k%2=1
    union all select k, 0, 'Ticker' from v_signers where k%3<>0 and k%2=0""")
def _(i):
    return h.read_sheet_rows(spread(i.view("v_workbooks"))).withColumn("cells", F.array_join("cells", "|"))


@query("filing_rows", """
    select cast(o_custkey as varchar) as cik, o_orderkey as k, 0 as pos, '10-K' as form, 'a'||cast(o_orderkey as varchar) as accession from orders
    union all select cast(o_custkey as varchar), o_orderkey, 1, '8-K', 'b'||cast(o_orderkey as varchar) from orders
    union all select cast(o_custkey as varchar), o_orderkey, 2, '10-Q', 'c'||cast(o_orderkey as varchar) from orders where o_orderkey%2=0""")
def _(i):
    key = F.col("o_orderkey").cast("string")

    def arrays(forms: list[str], letters: list[str]) -> DataFrame:
        return i.table("orders").select(
            F.col("o_custkey").cast("string").alias("cik"), "o_orderkey",
            F.array(*[F.lit(f) for f in forms]).alias("form"), F.array(*[key for _ in forms]).alias("filingDate"),
            F.array(*[F.concat(F.lit(a), key) for a in letters]).alias("accessionNumber"),
            F.array(*[F.concat(key, F.lit(".htm")) for _ in forms]).alias("primaryDocument"),
        )

    older = arrays(["10-Q"], ["c"]).filter("o_orderkey % 2 = 0")
    rows = s.flatten_filings(arrays(["10-K", "8-K"], ["a", "b"]), older)
    return rows.select(
        "cik", F.col("filingDate").cast("long").alias("k"), (F.col("pos") + F.col("part") * 2).alias("pos"), "form",
        F.col("accessionNumber").alias("accession"),
    )


def filing_list(i: Inputs) -> DataFrame:
    return i.view("v_filings").select(
        "cik", "form", F.col("filing_date").alias("filingDate"), F.col("accession").alias("accessionNumber"),
        F.col("document").alias("primaryDocument"), F.lit(0).alias("part"), "pos",
    )


@query("latest_filings", f"""
    select cik, filing_date, accession, '{BASE}'||cast(cast(cik as bigint) as varchar)||'/'||replace(accession,'-','')||'/'||document as filing_url
    from v_filings where regexp_replace(upper(form),'[^A-Z0-9]','','g')='10K'
    qualify row_number() over (partition by cik order by filing_date desc, pos)=1""")
def _(i):
    latest = s.latest_filing(filing_list(i))
    url = t.filing_url(t.padded_cik(F.col("cik")), F.col("accessionNumber"), F.col("primaryDocument"), BASE)
    return latest.select("cik", F.col("filingDate").alias("filing_date"), F.col("accessionNumber").alias("accession"), url.alias("filing_url"))


@query("annual_reports", "select cik, pos from v_filings where regexp_replace(upper(form),'[^A-Z0-9]','','g')='10K'")
def _(i):
    return filing_list(i).filter(t.is_10k(F.col("form"))).select("cik", "pos")


@query("padded_ciks", "select distinct cik, lpad(cik,10,'0') as padded from v_filings")
def _(i):
    return i.view("v_filings").select("cik", t.padded_cik(F.col("cik")).alias("padded")).distinct()


def reference_map(i: Inputs) -> DataFrame:
    """Two-entry maps of every customer; the tickers of the second entries collide."""
    key = F.col("c_custkey").cast("string")
    entry = '"{0}":{{"cik_str":{1},"ticker":"{2}","title":"{3}"}}'
    first = F.format_string(entry.format("%s", "%s", "c.%s", "Customer %s"), F.lit("0"), key, key, key)
    second = F.format_string(entry.format("%s", "%s", "g.%s", "Group %s"), F.lit("1"), key, (F.col("c_custkey") % 10).cast("string"), key)
    maps = i.table("customer").select(F.col("c_custkey").alias("idx"), F.concat(F.lit("{"), first, F.lit(","), second, F.lit("}")).alias("entries"))
    return s.ticker_map(maps)


_MAP = """select 'C-'||cast(c_custkey as varchar) as ticker, cast(c_custkey as varchar) as cik, 'Customer '||cast(c_custkey as varchar) as company_name from customer
    union all select 'G-'||cast(max(c_custkey)%10 as varchar), cast(max(c_custkey) as varchar), 'Group '||cast(max(c_custkey) as varchar) from customer group by c_custkey%10"""


@query("ticker_map", _MAP)
def _(i):
    return reference_map(i)


@query("resolved_companies", f"""
    select u.ticker, coalesce(nullif(u.cik,''),m.cik) as cik, case when u.cik<>'' then u.company_name else m.company_name end as company_name
    from (select case when o_orderkey%5=0 then 'Z-' else 'C-' end||cast(o_custkey as varchar)||'' as ticker,
      case when o_orderkey%2=0 then 'own'||cast(o_orderkey as varchar) else '' end as cik, 'Order '||cast(o_orderkey as varchar) as company_name from orders) u
    left join ({_MAP}) m using (ticker)""")
def _(i):
    rows = i.table("orders").select(
        F.concat(F.when(F.col("o_orderkey") % 5 == 0, "Z-").otherwise("C-"), F.col("o_custkey").cast("string")).alias("ticker"),
        F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit("own"), F.col("o_orderkey").cast("string"))).otherwise("").alias("cik"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("company_name"),
    )
    return s.resolve_companies(rows, reference_map(i))


@query("latest_available_date", "select max(cast(o_orderdate as date)) as trade_date from orders where o_orderstatus='F' and cast(o_orderdate as date) between (select max(cast(o_orderdate as date)) from orders)-7 and (select max(cast(o_orderdate as date)) from orders)")
def _(i):
    days = i.table("orders").select(F.col("o_orderdate").cast("date").alias("trade_date"), "o_orderstatus")
    return h.latest_available(days.filter("o_orderstatus = 'F'"), days.agg(F.max("trade_date")).scalar())


# --- names -------------------------------------------------------------------

_REASONS = """case kind when 3 then 'empty_after_normalization' when 4 then 'sec_section_or_stopword' when 5 then 'legal_boilerplate_phrase'
    when 6 then 'document_name_phrase' when 7 then 'too_few_tokens' when 8 then 'too_many_tokens' when 9 then 'all_title_words'
    when 10 then 'document_name_term' when 11 then 'blocked_connector_token' when 12 then 'organization_term'
    when 13 then 'invalid_name_casing_or_characters' when 14 then 'all_filing_vocabulary' when 15 then 'title_only_phrase' end"""


@query("name_rejections", f"select k, {_REASONS} as reason from v_candidates")
def _(i):
    return i.view("v_candidates").select("k", n.name_rejection_reason(F.col("candidate")).alias("reason"))


@query("accepted_names", "select k, candidate as name from v_candidates where kind<3")
def _(i):
    return x.split_candidates(i.view("v_candidates").withColumnRenamed("candidate", "name"))[0].select("k", "name")


@query("rejected_names", f"select k, candidate as name, {_REASONS} as reason from (select k, kind, case kind when 3 then '-' else candidate end as candidate from v_candidates where kind>=3)")
def _(i):
    return x.split_candidates(i.view("v_candidates").withColumnRenamed("candidate", "name"))[1].select("k", "name", "reason")


@query("normalized_names", "select v.k, case when kind<3 then n1 when kind=3 then '' else candidate end as name from v_candidates v join v_signers s on v.k=s.k")
def _(i):
    return i.view("v_candidates").select("k", n.normalize_name(F.col("candidate")).alias("name"))


@query("canonical_names", "select v.k, regexp_replace(lower(case when kind<3 then n1 when kind=3 then '' else candidate end),'[^a-z0-9]','','g') as canonical from v_candidates v join v_signers s on v.k=s.k")
def _(i):
    return i.view("v_candidates").select("k", n.canonical_name(F.col("candidate")).alias("canonical"))


@query("filing_labels", "select k from v_candidates where kind=20 union all select k from v_signers where k%3=0 union all select k from v_signers where k%3=1")
def _(i):
    text = F.when(F.col("k") % 3 == 0, "us-gaap:Revenues").when(F.col("k") % 3 == 1, F.concat(F.lit("Item "), (F.col("k") % 15).cast("string"), F.lit("A. x"))).otherwise(F.col("n1"))
    return i.view("v_signers").filter(n.is_filing_label(text)).select("k")


@query("signature_names", "select k, n1 as name from v_signers")
def _(i):
    kind = F.col("k") % 4
    raw = (
        F.when(kind == 0, F.upper("n1")).when(kind == 1, F.concat("n1", F.lit(" "), "n1"))
        .when(kind == 2, F.concat("n1", F.lit(" Senior Adviser"))).otherwise(F.concat(F.lit("Mr. "), "n1", F.lit(", Ph.D.")))
    )
    return i.view("v_signers").select("k", n.signature_name(raw).alias("name"))


@query("signature_candidates", "select k, case k%4 when 0 then n1 when 1 then '' when 2 then '' else n2 end as name from v_signers")
def _(i):
    kind = F.col("k") % 4
    raw = (
        F.when(kind == 0, F.concat("n1", F.lit(" Title:"))).when(kind == 1, F.concat(F.lit("Name "), "n1"))
        .when(kind == 2, "Chief Financial Officer Title").otherwise(F.col("n2"))
    )
    return i.view("v_signers").select("k", n.signature_candidate(raw).alias("name"))


@query("captured_names", "select k, array_to_string([n1,n2,n3],'|') as found from v_signers")
def _(i):
    text = F.concat(F.lit("it says "), "n1", F.lit(", then "), "n2", F.lit("; also x "), "n3", F.lit(" é."))
    return i.view("v_signers").select("k", F.array_join(n.names_in(text), "|").alias("found"))


@query("person_node_ids", "select k, 'person:'||lower(replace(n1,' ','_'))||':'||substr(sha1(lower(replace(n1,' ',''))),1,10) as id from v_signers")
def _(i):
    return i.view("v_signers").select("k", n.person_node_id(F.concat(F.lit("Dr. "), "n1")).alias("id"))


@query("document_name_captures")
def _(i):
    found = F.explode(n.names_in(F.col("text")))
    return i.table("documents").select(found.alias("name")).groupBy("name").agg(F.count("*").alias("n"))


# --- extraction --------------------------------------------------------------


def documents(i: Inputs, view: str = "v_docs") -> DataFrame:
    """Filing documents over all tasks: parsing them is the costly part."""
    return spread(i.view(view))


def texts(i: Inputs, view: str = "v_docs") -> DataFrame:
    return stage(x.filing_texts(documents(i, view)), "filing-texts")


@query("item_sections", """
    select k as doc_id, md5('Item 10. Directors and Officers In charge is '||n1||', Chief Financial Officer since 2001; and '||n2
      ||', Director; the directors are '||n2||' and '||n3||'. '||trim(repeat('filler words stand here and there. ',20))) as digest from v_signers""")
def _(i):
    section = t.py_strip(x.item_section(F.col("text"), "10"))
    return texts(i, "v_item10_docs").select("doc_id", F.md5(section.cast("binary")).alias("digest"))


@query("context_windows", "select k as doc_id, 'x. executive officers are '||substr(n1||' and '||n2,1,8) as near from v_signers")
def _(i):
    text = F.concat(F.lit("x. executive officers are "), "n1", F.lit(" and "), "n2")
    near = x.context_windows(text, r"(?i)executive\s+officers?", 13)
    return i.view("v_signers").select(F.col("k").alias("doc_id"), near.alias("near"))


@query("signature_sections", """
    select doc_id, md5(trim(regexp_replace(replace(regexp_replace(html,'<[^>]*>',' ','g'),'&nbsp;',' '),'\\s+',' ','g'))) as digest from v_docs""")
def _(i):
    section = x.signature_section(F.col("text"))
    return texts(i).select("doc_id", F.md5(section.cast("binary")).alias("digest"))


@query("signature_table_candidates", "select k as doc_id, true as has_evidence, 1 as tables from v_signers where layout not in (3,5,7)")
def _(i):
    found = x.signature_tables(documents(i))
    return found.select("doc_id", "has_evidence", F.size("tables").alias("tables")).filter("tables > 0")


@query("signature_table_edges", "select * from o_signed where source='signature_table'")
def _(i):
    tables = x.signature_tables(documents(i))
    return x.dedupe_relationships(x.signature_table_edges(tables)).drop("pos")


@query("signature_text_edges", "select * from o_signed where source='signature_free_text'")
def _(i):
    sections = texts(i).select("doc_id", x.signature_section(F.col("text")).alias("section"))
    found = x.dedupe_relationships(x.signature_text_edges(sections)).drop("pos")
    tables = x.signature_tables(documents(i)).filter("has_evidence").select("doc_id")
    return found.join(tables, "doc_id", "left_anti")


@query("signature_edges", "select * from o_signed")
def _(i):
    return x.extract_filings(documents(i), signature_only=True).drop("pos")


@query("signer_title_edges", "select k, 'CEO_OF,BOARD_OF' as edges from v_signers where k%4=0 union all select k, 'CFO_OF' from v_signers where k%4=1 union all select k, '' from v_signers where k%4=2 union all select k, 'CEO_OF,CFO_OF' from v_signers where k%4=3")
def _(i):
    kind = F.col("k") % 4
    title = (
        F.when(kind == 0, "CEO & Director").when(kind == 1, "Principal Financial Officer").when(kind == 2, "Vice President, Directorate")
        .otherwise("Principal Executive Officer, CFO")
    )
    return i.view("v_signers").select("k", F.array_join(n.signer_title_edges(title), ",").alias("edges"))


@query("officers", "select k as doc_id, n1 as name, 'CFO_OF' as relationship_type from v_signers")
def _(i):
    docs = texts(i, "v_item10_docs").withColumn("text", x.item_section(F.col("text"), "10"))
    return x.officers(docs).select("doc_id", "name", "relationship_type")


@query("board_members", "select k as doc_id, n2 as name from v_signers union all select k, n3 from v_signers")
def _(i):
    docs = texts(i, "v_item10_docs").withColumn("text", x.item_section(F.col("text"), "10"))
    return x.board_members(docs).select("doc_id", "name")


@query("executive_officers", "select k as doc_id, n1 as name, 'EXECUTIVE_OFFICER_OF' as relationship_type from v_signers union all select k, n1, 'CFO_OF' from v_signers union all select k, n2, 'EXECUTIVE_OFFICER_OF' from v_signers")
def _(i):
    rows = F.concat(
        F.lit("<table><tr><th>Name</th><th>Age</th><th>Position</th></tr><tr><td>"), "n1",
        F.lit("</td><td>50</td><td>Chief Financial Officer</td></tr><tr><td>"), "n2", F.lit("</td><td>51</td><td>Head of sales</td></tr>"),
        F.lit("<tr><td>none</td></tr></table><p>These executive officers serve.</p>"),
    )
    html = F.concat(F.lit("<table><tr><td>Our executive officers</td></tr></table>"), F.replace(rows, F.lit("<th>Age"), F.lit("<th>Age of executive staff officers")))
    tagged = F.replace(html, F.lit("Head of sales"), F.lit("Head of sales, executive officer"))
    docs = signers(i).select(F.col("k").alias("doc_id"), tagged.alias("html"))
    return x.executive_officers(x.filing_texts(docs)).select("doc_id", "name", "relationship_type")


@query("item10_edges", """
    select k as doc_id, n1 as name, 'CFO_OF' as relationship_type, 'item_10' as source from v_signers
    union all select k, n2, 'BOARD_OF', 'item_10' from v_signers union all select k, n3, 'BOARD_OF', 'item_10' from v_signers""")
def _(i):
    return x.item10_edges(texts(i, "v_item10_docs")).drop("pos")


@query("extracted_filings")  # combined_filings checks the same function
def _(i):
    return x.extract_filings(documents(i)).drop("pos")


@query("combined_filings", """
    select k as doc_id, n1 as name, 'CFO_OF' as relationship_type, case when k%3=1 then 'item_10' else 'signature_table' end as source from v_signers
    union all select k, n3, 'BOARD_OF', case when k%3=1 then 'item_10' else 'signature_table' end from v_signers
    union all select k, n2, 'BOARD_OF', 'item_10' from v_signers where k%3<>2""")
def _(i):
    return x.extract_filings(documents(i, "v_reports")).drop("pos")


@query("executives_from_text", """
    select k as doc_id, n1 as name, 'CFO_OF' as relationship_type from v_signers union all select k, n1, 'EXECUTIVE_OFFICER_OF' from v_signers
    union all select k, n2, 'EXECUTIVE_OFFICER_OF' from v_signers where k%2=0""")
def _(i):
    text = F.concat(
        F.lit("These executive officers serve. "), "n1", F.lit(", Chief Financial Officer since May. "), "n2",
        F.when(F.col("k") % 2 == 0, " (Senior Vice President of sales); ").otherwise(" (head of sales); "), "n3", F.lit(", clerk."),
    )
    docs = signers(i).select(F.col("k").alias("doc_id"), text.alias("text"))
    return x.dedupe_relationships(x.executives_from_text(docs)).select("doc_id", "name", "relationship_type")


@query("board_tables", "select k as doc_id, n1 as name from v_signers where k%4<>0 union all select k, n2 from v_signers where k%4<>0")
def _(i):
    head = F.when(F.col("k") % 4 == 0, "<tr><th>Item</th><th>Year</th></tr>").otherwise("<tr><th>Age</th><th>Nominee</th><th>Director since</th></tr>")
    html = F.concat(
        F.lit("<table>"), head, F.lit("<tr><td>50</td><td>"), "n1", F.lit("</td><td>2001</td></tr><tr><td>61</td><td>Dr. "), "n2",
        F.lit("</td><td>1999</td></tr><tr><td>Total</td></tr></table>"),
    )
    docs = signers(i).select(F.col("k").alias("doc_id"), html.alias("html"))
    return x.dedupe_relationships(x.board_from_tables(docs)).select("doc_id", "name")


@query("merged_sources", """
    select doc_id, name, relationship_type, source from o_signed union all
    select k, n1, 'CFO_OF', 'item_10' from v_signers where k not in (select doc_id from o_signed where relationship_type='CFO_OF' and name=n1)
    union all select k, n2, 'BOARD_OF', 'item_10' from v_signers where layout<>9
    union all select k, n3, 'BOARD_OF', 'item_10' from v_signers where layout<>0""")
def _(i):
    signatures = x.extract_filings(documents(i), signature_only=True)
    return x.merge_sources(signatures, x.item10_edges(texts(i, "v_item10_docs"))).drop("pos")


@query("most_common_names", """
    select o_custkey, name from (select o_custkey, o_clerk as name, count(*) as c, min(o_orderkey) as f from (
      select o_custkey, o_orderkey, 'Person '||case o_orderpriority when '1-URGENT' then 'Urgent' when '2-HIGH' then 'High' when '3-MEDIUM' then 'Medium' when '5-LOW' then 'Low' else 'Other' end as o_clerk from orders) group by 1,2)
    qualify row_number() over (partition by o_custkey order by c desc, f)=1""")
def _(i):
    word = F.regexp_extract("o_orderpriority", r"^\d-([A-Z]+)$", 1)
    name = F.concat(F.lit("Person "), F.when(word == "", "Other").otherwise(F.initcap(word)))
    mentions = i.table("orders").select("o_custkey", F.col("o_orderkey").alias("pos"), name.alias("name"))
    return x.most_common_name(mentions, ["o_custkey"]).select("o_custkey", "name")


# --- results -----------------------------------------------------------------


def companies(i: Inputs) -> DataFrame:
    key = F.col("k").cast("string")
    return i.view("v_signers").select(
        F.concat(F.lit("P-"), key).alias("ticker"), F.when(F.col("k") % 11 != 0, key).alias("cik"),
        F.concat("n1", F.lit(" Works")).alias("company_name"), "k",
    )


def filed(i: Inputs) -> DataFrame:
    date = F.concat(F.lit("2024-02-0"), (F.col("k") % 9 + 1).cast("string"))
    known = companies(i).filter("cik is not null and k % 13 <> 0")
    return known.select("ticker", "company_name", date.alias("filing_date"), F.concat(F.lit(BASE), "cik").alias("filing_url"))


def relationships(i: Inputs) -> DataFrame:
    signed = x.extract_filings(documents(i), signature_only=True)
    return signed.withColumn("doc_id", F.concat(F.lit("P-"), F.col("doc_id").cast("string")))


EDGE_SQL = """
    select 'person:'||lower(replace(name,' ','_'))||':'||substr(sha1(lower(replace(name,' ',''))),1,10) as source_node_id, 'company:'||ticker as target_node_id,
      relationship_type, name as source_person, company_name as target_company, ticker, filing_date, 'https://filings.example.com/data/'||cik as filing_url, source as relationship_source
    from o_signed join o_filed on doc_id=k where filing_date is not null"""


def edges(i: Inputs) -> DataFrame:
    return fl.unique_edges(x.gate_edges(fl.filing_edges(filed(i), relationships(i))))


@query("filing_edges", EDGE_SQL)
def _(i):
    return edges(i)


@query("filing_company_nodes", "select 'company:'||ticker as node_id, 'Company' as node_type, ticker, cik, company_name from o_filed")
def _(i):
    return fl.filing_company_nodes(companies(i))


@query("filing_person_nodes", f"select source_node_id as node_id, 'Person' as node_type, max(source_person) as name, lower(replace(max(source_person),' ','')) as normalized_name from ({EDGE_SQL}) group by 1")
def _(i):
    return fl.filing_person_nodes(edges(i))


def log(i: Inputs) -> DataFrame:
    found = stage(relationships(i), "relationships")
    nothing = found.filter("source = 'item_10'")
    return fl.parse_log(companies(i), companies(i), filed(i), fl.source_counts(found, found, nothing))


_LOG = """
    select ticker, coalesce(cik,'') as cik, case when cik is null then '' else company_name end as company_name, case when reason='' then 'success' else 'failed' end as status, reason,
      coalesce(filing_date,'') as filing_date, case when filing_date is null then '' else 'https://filings.example.com/data/'||cik end as filing_url,
      case when filing_date is null then '0' else cast(coalesce(c,0) as varchar) end as relationships_found,
      case when filing_date is not null then cast(coalesce(c,0) as varchar) end as signature_relationships_found,
      case when filing_date is not null then case when c>0 then 'yes' else 'no' end end as signature_success,
      case when filing_date is not null then '0' end as item_10_relationships_found, case when filing_date is not null then 'no' end as item_10_success
    from (select *, case when cik is null then 'cik_not_found' when filing_date is null then '10k_not_found' when c is null then 'no_relationships_extracted' else '' end as reason
      from o_filed left join (select doc_id, count(*) as c from o_signed group by 1) on doc_id=k)"""


@query("parse_log", _LOG)
def _(i):
    return log(i)


@query("failure_counts", f"select reason, count(*) as failures from ({_LOG}) where reason<>'' group by 1")
def _(i):
    return fl.failure_counts(log(i))


@query("extraction_rates", f"""
    select count(*) as companies_processed, count(*) filter (signature_success is not null) as filings_found, count(*) filter (status='success') as parsed_successfully,
      count(*) filter (signature_success='yes') as signature_successes, cast(0 as bigint) as item_10_successes,
      round(100.0*count(*) filter (signature_success='yes')/count(*) filter (signature_success is not null),6) as signature_rate, cast(0 as double) as item_10_rate from ({_LOG})""")
def _(i):
    return fl.extraction_rates(log(i)).withColumn("signature_rate", F.round("signature_rate", 6))


_COVER = f"""
    select o.ticker, o.company_name, coalesce(total,0) as total_relationships, coalesce(ceo,0) as ceo_count, coalesce(cfo,0) as cfo_count, coalesce(board,0) as board_count,
      case when coalesce(total,0)<5 then 'yes' else 'no' end as low_coverage, case when coalesce(ceo,0)=0 then 'yes' else 'no' end as ceo_missing,
      case when coalesce(cfo,0)=0 then 'yes' else 'no' end as cfo_missing, case when coalesce(board,0)<5 then 'yes' else 'no' end as board_count_below_5
    from o_filed o left join (select ticker, count(*) as total, count(*) filter (relationship_type='CEO_OF') as ceo,
      count(*) filter (relationship_type='CFO_OF') as cfo, count(*) filter (relationship_type='BOARD_OF') as board from ({EDGE_SQL}) group by 1) e using (ticker)"""


@query("low_coverage", _COVER)
def _(i):
    return fl.low_coverage(companies(i), edges(i))


@query("edge_coverage", """
    select ticker, ticker as company_name, count(*) as total_relationships, count(*) filter (role='CEO') as ceo_count, count(*) filter (role='CFO') as cfo_count,
      count(*) filter (role_category='BOARD') as board_count, case when count(*)<5 then 'yes' else 'no' end as low_coverage,
      case when count(*) filter (role='CEO')=0 then 'yes' else 'no' end as ceo_missing, case when count(*) filter (role='CFO')=0 then 'yes' else 'no' end as cfo_missing,
      case when count(*) filter (role_category='BOARD')<5 then 'yes' else 'no' end as board_count_below_5 from o_canon group by 1
    having count(*)<5 or count(*) filter (role='CEO')=0 or count(*) filter (role='CFO')=0 or count(*) filter (role_category='BOARD')<5""")
def _(i):
    kind = F.when(F.col("role") == "CEO", "CEO_OF").when(F.col("role") == "CFO", "CFO_OF").when(F.col("role_category") == "BOARD", "BOARD_OF").otherwise("OTHER")
    rel = stored_relationships(i)
    return fl.low_coverage(rel.select("ticker", F.col("ticker").alias("company_name")).distinct(), rel.select("ticker", kind.alias("relationship_type")))


@query("qa_summary", f"""
    select unnest(['total_companies','total_people','total_relationships','CEO_OF_count','CFO_OF_count','BOARD_OF_count','low_coverage_companies',
        'CEO_missing_companies','CFO_missing_companies','board_count_below_5_companies']) as metric,
      unnest([(select cast(count(*) as varchar) from o_filed),(select cast(count(distinct source_node_id) as varchar) from ({EDGE_SQL})),
        (select cast(count(*) as varchar) from ({EDGE_SQL})),(select cast(count(*) as varchar) from ({EDGE_SQL}) where relationship_type='CEO_OF'),
        (select cast(count(*) as varchar) from ({EDGE_SQL}) where relationship_type='CFO_OF'),(select cast(count(*) as varchar) from ({EDGE_SQL}) where relationship_type='BOARD_OF'),
        (select cast(count(*) as varchar) from ({_COVER}) where low_coverage='yes'),(select cast(count(*) as varchar) from ({_COVER}) where ceo_missing='yes'),
        (select cast(count(*) as varchar) from ({_COVER}) where cfo_missing='yes'),(select cast(count(*) as varchar) from ({_COVER}) where board_count_below_5='yes')]) as value""")
def _(i):
    found = stage(edges(i), "edges")
    return fl.qa_summary(companies(i), fl.filing_person_nodes(found), found)
