"""Declared schemas of the tables the engine reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "string": T.StringType(), "long": T.LongType(), "double": T.DoubleType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
}


def _table(columns: str) -> T.StructType:
    fields = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in fields])


COMPANIES = _table(
    "ticker string, company_name string, universe string, sector string, industry string,"
    " description string, description_short string, updated_at string"
)
EXCLUDED_COMPANIES = _table("ticker string, universe string, reason string, updated_at string")
UNIVERSE_AUDIT = _table(
    "universe string, provider string, method string, source_url string, resolved_url string,"
    " status string, count long, fetched_at string, error string, notes string"
)
RELATIONSHIPS_RAW = _table(
    "id long, ticker string, person_name string, person_key string, role string,"
    " role_category string, company_name string, batch_id string, extraction_method string,"
    " created_at string, updated_at string"
)
RELATIONSHIP_BATCHES = _table(
    "batch_id string, tickers string, status string, raw_request string, raw_response string,"
    " error_message string, response_id string, model string, input_tokens long,"
    " output_tokens long, total_tokens long, cached_input_tokens long, cost_usd double,"
    " usage_json string, created_at string, updated_at string"
)
MISSING_COMPANIES = _table("ticker string, batch_id string, reason string, created_at string")
RETRY_COMPANIES = _table(
    "ticker string, company_name string, batch_id string, reason string, created_at string"
)
RELATIONSHIPS = _table(
    "ticker string, company_name string, person_id string, person_name string, role string,"
    " role_category string, extraction_time string"
)
PEOPLE = _table("person_id string, person_name string")
EDGES = _table(
    "person_id string, ticker string, relationship_type string, role string,"
    " role_category string, extraction_time string"
)
MARKET_PRICES = _table(
    "ticker string, trade_date date, close double, adjusted_close double, volume long,"
    " data_source string, updated_at timestamp"
)
MARKET_SNAPSHOT = _table(
    "ticker string, as_of_date date, close double, market_cap double, return_1d double,"
    " return_5d double, return_30d double, avg_volume_30d double, avg_dollar_volume_30d double,"
    " price_data_source string, market_cap_data_source string, price_updated_at timestamp,"
    " market_cap_updated_at timestamp, updated_at timestamp"
)
FAILURES = _table(
    "ticker string, stage string, reason string, attempt_count string, created_at string"
)
ANSWER_PAYLOAD = (
    "struct<companies:array<struct<ticker:string,relationships:"
    "array<struct<person_name:string,role:string,role_category:string>>>>>"
)
FILING_COMPANY_NODES = ["node_id", "node_type", "ticker", "cik", "company_name"]
FILING_PERSON_NODES = ["node_id", "node_type", "name", "normalized_name"]
FILING_EDGES = [
    "source_node_id", "target_node_id", "relationship_type", "source_person", "target_company",
    "ticker", "filing_date", "filing_url", "relationship_source",
]
PARSE_LOG = [
    "ticker", "cik", "company_name", "status", "reason", "filing_date", "filing_url",
    "relationships_found", "signature_relationships_found", "signature_success",
    "item_10_relationships_found", "item_10_success",
]
