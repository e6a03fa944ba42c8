"""Answer documents: parsing, outcomes, and the raw-relationship ledgers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.numbers import cost_usd
from ledgermesh.functions.text import (
    blank_to_null, exploded, let, person_key, py_strip, text_or_empty, unwrap_fence, upper_key,
)
from ledgermesh.operators.merge import latest_per_key, update_by_key
from ledgermesh.schemas import ANSWER_PAYLOAD

RAW_KEY = ["ticker", "person_key", "role", "role_category"]
RESPONSE = (
    "struct<id:string,response_id:string,model:string,status:string,output_text:string,"
    "output:array<struct<type:string,role:string,content:array<struct<type:string,text:string>>>>>"
)


def _payload(df: DataFrame) -> DataFrame:
    """Answers with their text parsed once, and the payload read from the parsed text."""
    body = df.withColumn("_body", unwrap_fence(text_or_empty(F.col("raw_response"))))
    json = body.withColumn("_json", F.try_parse_json("_body"))
    return json.withColumn("_payload", F.try_variant_get("_json", "$", ANSWER_PAYLOAD))


def _wrong_shape() -> Column:
    """Whether the payload is no object, or its companies or relationships are there but no lists of objects.

    A part of the wrong kind reads as null, so only answers with a null in them are looked at again.
    """
    rows = "^ARRAY<(?:OBJECT<|VOID>)"
    companies = F.try_variant_get("_json", "$.companies", "variant")
    related = F.transform(
        F.try_variant_get("_json", "$.companies", "array<variant>"),
        lambda c: F.schema_of_variant(F.try_variant_get(c, "$.relationships", "variant")),
    )
    wrong = (
        F.col("_payload").isNull() | F.coalesce(~F.schema_of_variant(companies).rlike(rows), F.lit(False))
        | F.coalesce(F.exists(related, lambda shape: shape.isNotNull() & ~shape.rlike(rows)), F.lit(False))
    )

    def doubtful(company: Column) -> Column:
        people = company["relationships"]
        return company.isNull() | people.isNull() | F.exists(people, lambda person: person.isNull())

    listed = F.col("_payload.companies")
    return F.when(listed.isNull() | F.exists(listed, doubtful), wrong).otherwise(False)


def _outcome() -> Column:
    """Why an answer cannot be read, or null."""
    return (
        F.when(py_strip(text_or_empty(F.col("raw_response"))) == "", "no_final_text")
        .when(F.col("_json").isNull(), "invalid_json")
        .when(_wrong_shape(), "parse_exception")
    )


def _companies(df: DataFrame) -> DataFrame:
    """Answers with the companies they hold, none where they cannot be read.

    An empty array rather than a filter keeps the parsed text from being
    evaluated again for every condition.
    """
    read = F.when(_outcome().isNull(), F.col("_payload.companies"))
    return _payload(df).withColumn("_companies", F.coalesce(read, F.array()))


def parse_answers(df: DataFrame) -> DataFrame:
    """Relationship rows of the readable answers, invalid ones left out."""
    companies = exploded(_companies(df), ["batch_id"], F.col("_companies"), "company_pos", "company")
    ticker = upper_key(F.col("company.ticker")).alias("ticker")
    people = exploded(companies, ["batch_id", "company_pos", ticker], F.col("company.relationships"), "person_pos", "person")
    rows = people.select(
        "batch_id", "company_pos", "person_pos", "ticker",
        py_strip(text_or_empty(F.col("person.person_name"))).alias("person_name"),
        py_strip(text_or_empty(F.col("person.role"))).alias("role"),
        upper_key(F.col("person.role_category")).alias("role_category"),
    )
    return valid_answer_rows(rows).withColumn("person_key", person_key(F.col("person_name")))


def valid_answer_rows(rows: DataFrame) -> DataFrame:
    """Rows with a ticker, a name, a role and a known category."""
    return rows.filter(
        (F.col("ticker") != "") & (F.col("person_name") != "") & (F.col("role") != "")
        & F.col("role_category").isin(fixed.ROLE_CATEGORIES)
    )


def returned_tickers(df: DataFrame) -> DataFrame:
    """Distinct (batch, ticker) answered, with or without relationships."""
    tickers = F.array_distinct(F.transform("_companies", lambda c: upper_key(c["ticker"])))
    rows = exploded(_companies(df), ["batch_id"], tickers, "pos", "ticker")
    return rows.filter("ticker <> ''").drop("pos")


def answer_status(df: DataFrame) -> DataFrame:
    """Outcome and missing tickers of every batch (batch_id, tickers, raw_response).

    A batch is judged on its own row, so a malformed answer stops no other.
    """
    returned = F.transform(
        F.coalesce("_payload.companies", F.array()), lambda c: upper_key(c["ticker"])
    )
    judged = _payload(df).withColumn("_failed", _outcome())
    missing = F.when(F.col("_failed").isNull(), F.sort_array(F.array_except("tickers", returned)))
    rows = judged.withColumn("missing", F.coalesce(missing, F.array().cast("array<string>")))
    reason = F.coalesce("_failed", F.when(F.size("missing") > 0, F.lit("missing_from_response")))
    status = F.when(F.col("_failed").isNotNull(), "failed").when(F.size("missing") > 0, "partial").otherwise("success")
    return rows.select("batch_id", status.alias("status"), reason.alias("reason"), "missing")


def missing_rows(status: DataFrame, created_at: str) -> DataFrame:
    """One row per ticker a readable answer left out."""
    wanted = F.when(F.col("status") == "partial", F.col("missing"))
    return exploded(status, ["batch_id"], wanted, "pos", "ticker").select(
        "ticker", "batch_id", F.lit("missing_from_response").alias("reason"), F.lit(created_at).alias("created_at")
    )


def retry_events(requests: DataFrame, status: DataFrame) -> DataFrame:
    """Tickers to ask again: all of a failed batch, the missing of a partial one."""
    joined = requests.join(status, "batch_id")
    again = F.when(F.col("status") == "failed", F.col("tickers")).when(F.col("status") == "partial", F.col("missing"))
    return exploded(joined, ["batch_id", "seq", "reason"], again, "pos", "ticker").drop("pos")


def merge_retry(events: DataFrame) -> DataFrame:
    """One row per ticker, the last event wins."""
    keyed = events.withColumn("ticker", upper_key(F.col("ticker")))
    return latest_per_key(keyed, ["ticker"], F.desc("seq")).drop("seq")


def add_company_names(rows: DataFrame, companies: DataFrame) -> DataFrame:
    """Rows with the company name of their ticker, blank when unknown."""
    names = companies.select("ticker", F.col("company_name").alias("_name"))
    joined = rows.join(names, "ticker", "left")
    return joined.withColumn("company_name", F.coalesce("_name", F.lit(""))).drop("_name")


def upsert_raw(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Raw relationships with the new rows over them; id and created_at stay."""
    return update_by_key(old, new, RAW_KEY, seq, ["id", "created_at"])


def upsert_batches(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Batch ledger with the new rows over it; created_at stays."""
    return update_by_key(old, new, ["batch_id"], seq, ["created_at"])


def raw_export(df: DataFrame) -> DataFrame:
    return df.orderBy("ticker", "person_key", "role_category", "role")


def pending_batches(batches: DataFrame, ledger: DataFrame) -> DataFrame:
    """Planned batches that have not succeeded yet."""
    done = ledger.filter("status = 'success'").select("batch_id")
    return batches.join(done, "batch_id", "left_anti")


def missing_answers(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """Requested (batch, ticker) that no answer returned."""
    return requested.select("batch_id", "ticker").distinct().join(returned, ["batch_id", "ticker"], "left_anti")


def batch_totals(ledger: DataFrame) -> DataFrame:
    """Totals of a run: outcomes, tokens, cost, relationships and missing tickers."""
    zero = F.lit(0)
    return ledger.agg(
        F.count_if(F.col("status") == "success").alias("successful_batches"),
        F.count_if(F.col("status") == "partial").alias("partial_batches"),
        F.count_if(F.col("status") == "failed").alias("failed_batches"),
        F.coalesce(F.sum(F.when(F.col("status") == "failed", F.col("company_count"))), zero).alias("failed_company_count"),
        F.coalesce(F.sum(F.when(F.col("status") == "partial", F.col("missing_count"))), zero).alias("missing_ticker_count"),
        F.coalesce(F.sum("relationships"), zero).alias("total_relationships"),
        F.coalesce(F.sum("input_tokens"), zero).alias("total_input_tokens"),
        F.coalesce(F.sum("output_tokens"), zero).alias("total_output_tokens"),
        F.coalesce(F.sum("total_tokens"), zero).alias("total_tokens"),
        F.coalesce(F.sum(cost_usd(F.col("input_tokens"), F.col("output_tokens"))), F.lit(0.0)).alias("total_cost_usd"),
    )


def _filled(c: Column) -> Column:
    return py_strip(text_or_empty(c)) != ""


def _items(array: Column) -> Column:
    return F.coalesce(array, F.array())


def final_text(response: Column) -> Column:
    """Text of a response: its own output text, else the assistant message parts."""
    doc = F.from_json(response, RESPONSE)
    messages = F.filter(
        _items(doc["output"]), lambda m: (m["type"] == "message") & F.coalesce(m["role"] == "assistant", F.lit(True))
    )
    parts = F.flatten(F.transform(messages, lambda m: _items(m["content"])))
    filled = F.filter(parts, lambda p: (p["type"] == "output_text") & _filled(p["text"]))
    texts = F.transform(filled, lambda p: p["text"])
    fallback = F.when(F.size(texts) > 0, F.array_join(texts, "\n"))
    return F.when(_filled(doc["output_text"]), doc["output_text"]).otherwise(fallback)


def _whole(c: Column) -> Column:
    """Whole number of a JSON value: digits as they are, fractions cut, else null."""
    digits = F.regexp_extract(c, r"^\s*([+-]?[0-9]+)(?:\.[0-9]+)?\s*$", 1)
    return blank_to_null(digits).try_cast("long")


def _first_of(response: Column, *paths: str) -> Column:
    return F.coalesce(*[F.get_json_object(response, path) for path in paths])


def _merged(own: Column, more: Column) -> Column:
    """Two maps as one with its keys in order; an entry of ``more`` wins."""
    none = F.create_map().cast("map<string,variant>")

    def merge(maps: Column) -> Column:
        keys = F.array_sort(F.array_union(F.map_keys(maps["own"]), F.map_keys(maps["more"])))
        values = F.transform(keys, lambda k: F.coalesce(F.try_element_at(maps["more"], k), F.try_element_at(maps["own"], k)))
        return F.map_from_arrays(keys, values)

    return let(F.struct(F.coalesce(own, none).alias("own"), F.coalesce(more, none).alias("more")), merge)


def usage(df: DataFrame, default_model: str) -> DataFrame:
    """Token counts and diagnostics of every response (batch_id, response).

    ``usage_json`` is the whole usage object of the response with the diagnostics that are
    not null, keys in order, as compact JSON.
    """
    r = F.col("response")
    doc = F.from_json(r, RESPONSE)
    text = final_text(r)
    method = F.when(text.isNull(), F.lit(None)).when(_filled(doc["output_text"]), "output_text").otherwise("output_fallback")
    tokens = {
        "input_tokens": ("$.usage.input_tokens", "$.usage.prompt_tokens"),
        "output_tokens": ("$.usage.output_tokens", "$.usage.completion_tokens"),
        "total_tokens": ("$.usage.total_tokens",),
        "cached_input_tokens": (
            "$.usage.input_tokens_details.cached_tokens", "$.usage.input_tokens_details.cached_input_tokens",
            "$.usage.prompt_tokens_details.cached_tokens", "$.usage.prompt_tokens_details.cached_input_tokens",
        ),
    }
    types = F.filter(F.transform(_items(doc["output"]), lambda o: o["type"]), lambda t: t.isNotNull())
    rows = df.select(
        "batch_id",
        F.coalesce(doc["id"], doc["response_id"]).alias("response_id"),
        F.coalesce(blank_to_null(doc["model"]), F.lit(default_model)).alias("model"),
        *[_whole(_first_of(r, *paths)).alias(name) for name, paths in tokens.items()],
        method.alias("extraction_method"),
        F.length(text).alias("extracted_text_len"),
        doc["status"].alias("response_status"),
        types.alias("output_item_types"),
        r.alias("_response"),
    )
    told = F.try_parse_json(F.to_json(F.struct("extracted_text_len", "extraction_method", "output_item_types", "response_status")))
    own = F.try_variant_get(F.try_parse_json(F.get_json_object("_response", "$.usage")), "$", "map<string,variant>")
    extended = _merged(own, F.try_variant_get(told, "$", "map<string,variant>"))
    return rows.withColumn("usage_json", F.to_json(extended)).drop("_response").withColumn(
        "cost_usd", cost_usd(F.col("input_tokens"), F.col("output_tokens"))
    )
