"""Filing results: edges, nodes, parse log and coverage checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions.names import canonical_name, person_node_id
from ledgermesh.functions.text import company_node_id
from ledgermesh.operators.canonical import beside
from ledgermesh.operators.extraction import gate_edges
from ledgermesh.operators.merge import latest_per_key
from ledgermesh.schemas import FILING_EDGES, PARSE_LOG

QA_TYPES = ["CEO_OF", "CFO_OF", "BOARD_OF"]
BOARD_MINIMUM = 5
COVERAGE_MINIMUM = 5


def filing_edges(filings: DataFrame, relationships: DataFrame) -> DataFrame:
    """Edges of the extracted relationships.

    ``filings`` has (ticker, company_name, filing_date, filing_url);
    ``relationships`` carries the ticker as its document id.
    """
    named = relationships.withColumnRenamed("doc_id", "ticker").join(filings, "ticker")
    return named.select(
        person_node_id(F.col("name")).alias("source_node_id"),
        company_node_id(F.col("ticker")).alias("target_node_id"),
        "relationship_type", F.col("name").alias("source_person"), F.col("company_name").alias("target_company"),
        "ticker", "filing_date", "filing_url", F.col("source").alias("relationship_source"), "pos",
    )


def unique_edges(edges: DataFrame, seq: str = "pos") -> DataFrame:
    """One edge per (source, target, type), the last found."""
    keys = ["source_node_id", "target_node_id", "relationship_type"]
    return latest_per_key(edges, keys, F.desc(seq)).select(*FILING_EDGES)


def filing_company_nodes(companies: DataFrame) -> DataFrame:
    return companies.select(
        company_node_id(F.col("ticker")).alias("node_id"), F.lit("Company").alias("node_type"), "ticker", "cik", "company_name"
    )


def filing_person_nodes(edges: DataFrame) -> DataFrame:
    """People of the edges that still pass as person names; the last spelling counts."""
    order = F.struct("ticker", "relationship_type", "source_person")
    people = gate_edges(edges).groupBy(F.col("source_node_id").alias("node_id")).agg(
        F.max_by("source_person", order).alias("name")
    )
    return people.select(
        "node_id", F.lit("Person").alias("node_type"), "name", canonical_name(F.col("name")).alias("normalized_name")
    )


def source_counts(relationships: DataFrame, signatures: DataFrame, item_10: DataFrame) -> DataFrame:
    """Relationships found per document, in total and by source."""

    def counted(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("doc_id").agg(F.count("*").alias(name))

    total = counted(relationships, "relationships_found")
    return total.join(counted(signatures, "signature_relationships_found"), "doc_id", "full_outer").join(
        counted(item_10, "item_10_relationships_found"), "doc_id", "full_outer"
    )


def parse_log(tickers: DataFrame, companies: DataFrame, filings: DataFrame, counts: DataFrame) -> DataFrame:
    """One row per ticker: how far it got and what was found.

    A ticker without a company has no CIK, one without an annual report no
    filing, and one whose filing yields nothing is a failure too.
    """
    known = companies.filter("cik is not null").select("ticker", "cik", "company_name")
    listed = tickers.select("ticker").join(known, "ticker", "left").join(
        filings.select("ticker", "filing_date", "filing_url"), "ticker", "left"
    ).join(counts.withColumnRenamed("doc_id", "ticker"), "ticker", "left")
    zero = F.lit(0)
    found = F.coalesce("relationships_found", zero)
    reason = (
        F.when(F.col("cik").isNull(), "cik_not_found").when(F.col("filing_date").isNull(), "10k_not_found")
        .when(found == 0, "no_relationships_extracted").otherwise("")
    )
    filed = F.col("cik").isNotNull() & F.col("filing_date").isNotNull()
    rows = listed.withColumn("reason", reason).withColumn("status", F.when(F.col("reason") == "", "success").otherwise("failed"))

    def by_source(name: str):
        return F.when(filed, F.coalesce(name, zero).cast("string"))

    def success(name: str):
        return F.when(filed, F.when(F.coalesce(name, zero) > 0, "yes").otherwise("no"))

    text = {c: F.coalesce(F.when(F.col("cik").isNotNull(), F.col(c)), F.lit("")) for c in ("cik", "company_name", "filing_date", "filing_url")}
    columns = {
        **text,
        "relationships_found": F.when(filed, found).otherwise(zero).cast("string"),
        "signature_relationships_found": by_source("signature_relationships_found"),
        "signature_success": success("signature_relationships_found"),
        "item_10_relationships_found": by_source("item_10_relationships_found"),
        "item_10_success": success("item_10_relationships_found"),
    }
    return rows.select(*[columns[c].alias(c) if c in columns else F.col(c) for c in PARSE_LOG])


def coverage(companies: DataFrame, edges: DataFrame) -> DataFrame:
    """Edge counts of every company and the four coverage flags."""
    kind = F.col("relationship_type")
    counts = edges.groupBy("ticker").agg(
        F.count("*").alias("total"), *[F.count_if(kind == t).alias(t) for t in QA_TYPES]
    )
    zero = F.lit(0)
    rows = companies.join(counts, "ticker", "left").select(
        "ticker", "company_name", F.coalesce("total", zero).alias("total_relationships"),
        F.coalesce("CEO_OF", zero).alias("ceo_count"), F.coalesce("CFO_OF", zero).alias("cfo_count"),
        F.coalesce("BOARD_OF", zero).alias("board_count"),
    )

    def flag(test):
        return F.when(test, "yes").otherwise("no")

    return rows.select(
        "*",
        flag(F.col("total_relationships") < COVERAGE_MINIMUM).alias("low_coverage"),
        flag(F.col("ceo_count") == 0).alias("ceo_missing"),
        flag(F.col("cfo_count") == 0).alias("cfo_missing"),
        flag(F.col("board_count") < BOARD_MINIMUM).alias("board_count_below_5"),
    )


def low_coverage(companies: DataFrame, edges: DataFrame) -> DataFrame:
    """Companies with any coverage flag set."""
    flags = ["low_coverage", "ceo_missing", "cfo_missing", "board_count_below_5"]
    return coverage(companies, edges).filter(F.array_contains(F.array(*flags), "yes"))


def qa_summary(companies: DataFrame, people: DataFrame, edges: DataFrame) -> DataFrame:
    """Ten coverage figures as (metric, value)."""
    low = low_coverage(companies, edges)
    kind = F.col("relationship_type")
    row = beside([
        companies.agg(F.count("*").alias("total_companies")),
        people.agg(F.count("*").alias("total_people")),
        edges.agg(F.count("*").alias("total_relationships"), *[F.count_if(kind == t).alias(f"{t}_count") for t in QA_TYPES]),
        low.agg(
            F.count_if(F.col("low_coverage") == "yes").alias("low_coverage_companies"),
            F.count_if(F.col("ceo_missing") == "yes").alias("CEO_missing_companies"),
            F.count_if(F.col("cfo_missing") == "yes").alias("CFO_missing_companies"),
            F.count_if(F.col("board_count_below_5") == "yes").alias("board_count_below_5_companies"),
        ),
    ])
    entries = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.inline(entries))


def failure_counts(log: DataFrame) -> DataFrame:
    return log.filter("reason <> ''").groupBy("reason").agg(F.count("*").alias("failures"))


def extraction_rates(log: DataFrame) -> DataFrame:
    """Success rates of both sources over the filings found, in percent."""
    filed = F.col("signature_success").isNotNull()
    row = log.agg(
        F.count("*").alias("companies_processed"), F.count_if(filed).alias("filings_found"),
        F.count_if(F.col("status") == "success").alias("parsed_successfully"),
        F.count_if(F.col("signature_success") == "yes").alias("signature_successes"),
        F.count_if(F.col("item_10_success") == "yes").alias("item_10_successes"),
    )

    def rate(name: str):
        return F.coalesce(F.try_divide(F.col(name) * 100.0, F.col("filings_found")), F.lit(0.0))

    return row.select("*", rate("signature_successes").alias("signature_rate"), rate("item_10_successes").alias("item_10_rate"))
