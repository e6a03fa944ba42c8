"""Queries over answer documents and the raw-relationship ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.functions.numbers import cost_usd
from ledgermesh.operators import answers as a
from ledgermesh.plans.bindings import Inputs
from ledgermesh.plans.registry import query
from ledgermesh.session import stage

STAMP = "2024-01-01"


def answers(i: Inputs) -> DataFrame:
    """Stored answers with the tickers asked for."""
    view = i.view("v_answers").select("batch_id", "k", F.array("t1", "t2").alias("tickers"), "raw_response")
    return stage(view, "answers")


def raw_table(i: Inputs) -> DataFrame:
    """Stored raw relationships with unique keys."""
    rows = a.parse_answers(answers(i)).filter("role_category = 'BOARD'")
    return rows.groupBy(*a.RAW_KEY).agg(
        F.max("person_name").alias("person_name"), F.min("batch_id").alias("batch_id"),
    ).select(
        F.xxhash64(*a.RAW_KEY).alias("id"), "ticker", "person_name", "person_key", "role", "role_category",
        F.lit("old").alias("company_name"), "batch_id", F.lit("2023").alias("created_at"), F.lit("2023").alias("updated_at"),
    )


def arrivals(i: Inputs) -> DataFrame:
    """New raw relationships in batch order, some keys several times."""
    rows = a.parse_answers(answers(i)).withColumn("k", F.substring("batch_id", 2, 20).cast("long"))
    return rows.select(
        F.lit(-1).cast("long").alias("id"), "ticker", "person_name", "person_key", "role", "role_category",
        F.lit("new").alias("company_name"), "batch_id", F.lit(STAMP).alias("created_at"), F.lit(STAMP).alias("updated_at"),
        (F.col("k") * 1000 + F.col("company_pos") * 100 + F.col("person_pos")).alias("seq"),
    )


@query("unwrapped_answers", "select batch_id, body from o_body")
def _(i):
    return answers(i).select("batch_id", t.unwrap_fence(F.col("raw_response")).alias("body"))


@query("answer_rows", "select batch_id, ticker, person_name, role, role_category, person_key from o_answer_rows")
def _(i):
    return a.parse_answers(answers(i)).drop("company_pos", "person_pos")


@query("returned_tickers", "select * from o_returned")
def _(i):
    return a.returned_tickers(answers(i))


@query("answer_status", "select batch_id, status, reason, array_to_string(missing,',') as missing from o_status")
def _(i):
    return a.answer_status(answers(i)).withColumn("missing", F.array_join("missing", ","))


@query("missing_answer_rows", "select unnest(missing) as ticker, batch_id, 'missing_from_response' as reason, '2024-01-01' as created_at from o_status where status='partial'")
def _(i):
    return a.missing_rows(a.answer_status(answers(i)), STAMP)


@query("missing_answers", """select batch_id, ticker from (select batch_id, t1 as ticker from v_answers union select batch_id, t2 from v_answers)
    where (batch_id,ticker) not in (select batch_id, ticker from o_returned)""")
def _(i):
    asked = answers(i).select("batch_id", F.explode("tickers").alias("ticker"))
    return a.missing_answers(asked, a.returned_tickers(answers(i)))


@query("retry_ledger", """select ticker, batch_id, reason from (
    select ticker, batch_id, reason, row_number() over (partition by ticker order by k desc) as rn from (
      select unnest(case when status='failed' then [t1,t2] else missing end) as ticker, batch_id, reason, k from o_status where status<>'success'))
    where rn=1""")
def _(i):
    asked = answers(i).withColumn("seq", F.col("k"))
    events = a.retry_events(asked.select("batch_id", "tickers", "seq"), a.answer_status(answers(i)))
    return a.merge_retry(events).select("ticker", "batch_id", "reason")


@query("answer_company_names", """select batch_id, r.ticker, person_name, role, coalesce(s_name,'') as company_name from o_answer_rows r
    left join supplier on 'S'||lpad(cast(s_suppkey as varchar),6,'0')=r.ticker""")
def _(i):
    names = i.table("supplier").select(
        F.concat(F.lit("S"), F.lpad(F.col("s_suppkey").cast("string"), 6, "0")).alias("ticker"), F.col("s_name").alias("company_name")
    )
    return a.add_company_names(a.parse_answers(answers(i)), names).select("batch_id", "ticker", "person_name", "role", "company_name")


@query("upsert_raw", """
    with fresh as (select *, cast(substr(batch_id,2,20) as bigint) as k from o_answer_rows),
      new as (select * from fresh qualify row_number() over (partition by ticker, person_key, role, role_category order by k desc)=1),
      old as (select ticker, person_key, role, role_category, max(person_name) as person_name, min(batch_id) as batch_id
        from o_answer_rows where role_category='BOARD' group by 1,2,3,4)
    select n.ticker, n.person_key, n.role, n.role_category, n.person_name, n.batch_id, 'new' as company_name,
      case when o.ticker is null then '2024-01-01' else '2023' end as created_at, '2024-01-01' as updated_at, o.ticker is not null as kept_id
    from new n left join old o using (ticker, person_key, role, role_category)""")
def _(i):
    return a.upsert_raw(raw_table(i), arrivals(i)).withColumn("kept_id", F.col("id") != -1).drop("id")


@query("raw_export_order", "select ticker, person_key, role_category, role from (select distinct ticker, person_key, role_category, role from o_answer_rows where role_category='BOARD') order by 1,2,3,4")
def _(i):
    return a.raw_export(raw_table(i)).select("ticker", "person_key", "role_category", "role")


@query("upsert_batches", """select batch_id, case when status='failed' then status else 'success' end as status,
    case when k%2=0 then '2023' else '2024-01-01' end as created_at from o_status""")
def _(i):
    asked = answers(i)
    status = stage(a.answer_status(asked).join(asked.select("batch_id", "k"), "batch_id"), "answer-status")
    old = status.filter("k % 2 = 0").select("batch_id", F.lit("running").alias("status"), F.lit("2023").alias("created_at"))
    first = status.select("batch_id", F.lit("failed").alias("status"), F.lit(STAMP).alias("created_at"), F.lit(1).alias("seq"))
    final = F.when(F.col("status") == "failed", "failed").otherwise("success")
    last = status.select("batch_id", final.alias("status"), F.lit("2024-09-09").alias("created_at"), F.lit(2).alias("seq"))
    return a.upsert_batches(old, first.unionByName(last))


@query("pending_batches", "select batch_id from o_status where status<>'success'")
def _(i):
    return a.pending_batches(answers(i).select("batch_id"), a.answer_status(answers(i)))


def ledger(i: Inputs) -> DataFrame:
    status = a.answer_status(answers(i))
    found = a.parse_answers(answers(i)).groupBy("batch_id").agg(F.count("*").alias("relationships"))
    k = F.substring("batch_id", 2, 20).cast("long")
    tokens = F.when(k % 6 != 0, k % 1000)
    return status.join(found, "batch_id", "left").select(
        "batch_id", "status", F.lit(2).alias("company_count"), F.size("missing").alias("missing_count"), "relationships",
        tokens.alias("input_tokens"), (k % 77).alias("output_tokens"), (tokens + k % 77).alias("total_tokens"),
    )


@query("batch_totals", """
    select count(*) filter (status='success') as successful_batches, count(*) filter (status='partial') as partial_batches,
      count(*) filter (status='failed') as failed_batches, cast(2*count(*) filter (status='failed') as bigint) as failed_company_count,
      cast(sum(len(missing)) filter (status='partial') as bigint) as missing_ticker_count,
      (select count(*) from o_answer_rows) as total_relationships,
      cast(sum(case when k%6<>0 then k%1000 end) as bigint) as total_input_tokens, cast(sum(k%77) as bigint) as total_output_tokens,
      cast(sum(case when k%6<>0 then k%1000+k%77 end) as bigint) as total_tokens,
      round(sum(case when k%6<>0 then (k%1000)*1.25/1000000+(k%77)*2.5/1000000 end),6) as total_cost_usd
    from o_status""")
def _(i):
    return a.batch_totals(ledger(i)).withColumn("total_cost_usd", F.round("total_cost_usd", 6))


@query("token_costs", "select event_id, round(user_id*1.25/1000000+event_id*2.5/1000000,9) as cost from events")
def _(i):
    return i.table("events").select("event_id", F.round(cost_usd(F.col("user_id"), F.col("event_id")), 9).alias("cost"))


_TEXT = """case event_id%5 when 0 then 'direct '||event_type when 2 then null when 3 then null
    else event_type||chr(10)||'user '||cast(user_id as varchar) end"""


@query("final_texts", f"select 'r'||cast(event_id as varchar) as batch_id, {_TEXT} as final_text from events")
def _(i):
    return i.view("v_responses").select("batch_id", a.final_text(F.col("response")).alias("final_text"))


@query("response_usage", f"""
    select 'r'||cast(event_id as varchar) as batch_id, 'resp_'||cast(event_id as varchar) as response_id,
      case when event_id%3=0 then 'model-a' else 'model-b' end as model, user_id as input_tokens,
      case event_id%4 when 0 then 7 when 1 then null else 9 end as output_tokens, case when event_id%4>1 then user_id+9 end as total_tokens,
      case when event_id%4>1 then 3 end as cached_input_tokens,
      case event_id%5 when 0 then 'output_text' when 2 then null when 3 then null else 'output_fallback' end as extraction_method,
      length({_TEXT}) as extracted_text_len from events""")
def _(i):
    columns = [
        "batch_id", "response_id", "model", "input_tokens", "output_tokens", "total_tokens", "cached_input_tokens",
        "extraction_method", "extracted_text_len",
    ]
    return a.usage(i.view("v_responses"), "model-a").select(*columns)


@query("batch_ids", """select o_orderkey, 'grok_rel_'||substr(sha256('{"model":"m","tickers":["S'||cast(o_custkey as varchar)||'","T'||cast(o_orderkey as varchar)||'"]}'),1,16) as batch_id from orders""")
def _(i):
    tickers = F.array(F.concat(F.lit("S"), F.col("o_custkey").cast("string")), F.concat(F.lit("T"), F.col("o_orderkey").cast("string")))
    return i.table("orders").select("o_orderkey", t.batch_id(F.lit("m"), tickers).alias("batch_id"))
