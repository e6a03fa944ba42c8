"""Readers and clean-up of tabular inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.functions.text import (
    clean_text, normalize_ticker_basic, py_strip, text_or_empty, upper_key,
)
from ledgermesh.operators.merge import latest_per_key
from ledgermesh.schemas import RELATIONSHIPS


def require_columns(df: DataFrame, required: list[str]) -> DataFrame:
    """Return ``df``; an error names the required columns it lacks, sorted."""
    missing = sorted(set(required) - set(df.columns))
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    return df


def read_csv_table(spark: SparkSession, path: str, required: list[str], one_line_records: bool = False) -> DataFrame:
    """CSV with a header; blanks are empty text, extra columns are allowed.

    Cells may hold line breaks, as ``export_csv`` writes them. A file is then read by one
    task; ``one_line_records`` says that no cell holds one, so that files can be split.
    """
    df = spark.read.csv(path, header=True, multiLine=not one_line_records, escape='"')
    return require_columns(df, required).na.fill("")


def canonical_tickers(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Distinct upper-case tickers with the index of their first appearance."""
    keyed = df.select(upper_key(F.col("ticker")).alias("ticker"), F.col(idx).alias("idx"))
    return keyed.filter("ticker <> ''").groupBy("ticker").agg(F.min("idx").alias("first_idx"))


def retry_tickers(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Tickers of a retry list, first appearance kept."""
    return canonical_tickers(df, idx)


def head_tickers(df: DataFrame, n: int, idx: str = "idx") -> DataFrame:
    """First ``n`` tickers in order of appearance; 0 means all of them."""
    ordered = canonical_tickers(df, idx)
    return ordered.orderBy("first_idx").limit(n) if n else ordered


def master_tickers(df: DataFrame) -> DataFrame:
    """Ticker set of the company master."""
    require_columns(df, ["ticker"])
    return df.select(upper_key(F.col("ticker")).alias("ticker")).filter("ticker <> ''").distinct()


def read_relationships(df: DataFrame) -> DataFrame:
    """The seven relationship columns, stripped, null as empty text."""
    require_columns(df, RELATIONSHIPS.names)
    return df.select(*[py_strip(text_or_empty(F.col(c))).alias(c) for c in RELATIONSHIPS.names])


def read_retry_list(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Retry rows in order; a blank ticker or name fails with its file row.

    ``idx`` counts data rows from 0, so the first one is file row 2.
    """
    require_columns(df, ["company_name", "ticker"])
    ticker = upper_key(F.col("ticker"))
    name = py_strip(text_or_empty(F.col("company_name")))
    message = F.concat(
        F.lit("row "), (F.col(idx) + 2).cast("string"), F.lit(" must have a ticker and a company_name")
    )
    checked = F.when((ticker == "") | (name == ""), F.raise_error(message)).otherwise(ticker)
    return df.select(F.col(idx).alias("idx"), checked.alias("ticker"), name.alias("company_name"))


def read_universe(df: DataFrame, idx: str = "idx") -> DataFrame:
    """Explicit universe rows: first row of a ticker wins, blanks are skipped."""
    require_columns(df, ["ticker", "company_name", "cik"])
    rows = df.select(
        F.col(idx).alias("idx"),
        normalize_ticker_basic(text_or_empty(F.col("ticker"))).alias("ticker"),
        py_strip(text_or_empty(F.col("cik"))).alias("cik"),
        clean_text(text_or_empty(F.col("company_name"))).alias("company_name"),
    )
    return latest_per_key(rows.filter("ticker <> ''"), ["ticker"], F.asc("idx"))


def restrict(df: DataFrame, tickers: DataFrame) -> DataFrame:
    """Rows whose ticker is in a ticker list."""
    return df.join(tickers.select("ticker").distinct(), "ticker", "left_semi")
