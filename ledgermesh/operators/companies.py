"""Company master: memberships, metadata, exclusions and audits."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.text import (
    any_word, blank_to_null, description_short, is_placeholder, py_strip, text_or_empty,
)
from ledgermesh.operators.canonical import beside
from ledgermesh.operators.merge import duplicate_keys, numbered
from ledgermesh.schemas import COMPANIES

METADATA = ["company_name", "sector", "industry", "description"]


def union_universes(sets: dict[str, DataFrame]) -> DataFrame:
    """(ticker, universe) of every provider's ticker set."""
    tagged = [df.select("ticker", F.lit(name).alias("universe")) for name, df in sets.items()]
    return reduce(DataFrame.unionByName, tagged).distinct()


def membership(df: DataFrame) -> DataFrame:
    """Universes of each ticker, sorted and joined by ``;``."""
    return df.groupBy("ticker").agg(F.array_join(F.sort_array(F.collect_set("universe")), ";").alias("universe"))


def _excluded(df: DataFrame, reason: str, updated_at: str) -> DataFrame:
    return df.select("ticker", "universe", F.lit(reason).alias("reason"), F.lit(updated_at).alias("updated_at"))


def split_placeholders(members: DataFrame, updated_at: str) -> tuple[DataFrame, DataFrame]:
    """Real tickers, and the placeholders as exclusions."""
    bad = is_placeholder(F.col("ticker"))
    return members.filter(~bad), _excluded(members.filter(bad), "invalid_placeholder_ticker", updated_at)


def with_metadata(members: DataFrame, meta: DataFrame) -> DataFrame:
    """Memberships with their metadata, blanks as null."""
    return members.join(meta, "ticker", "left").select(
        "ticker", "universe", *[blank_to_null(F.col(c)).alias(c) for c in METADATA]
    )


def split_identity(rows: DataFrame, updated_at: str) -> tuple[DataFrame, DataFrame]:
    """Companies with at least one metadata field, and the others as exclusions."""
    known = F.coalesce(*[F.col(c) for c in METADATA]).isNotNull()
    return rows.filter(known), _excluded(rows.filter(~known), "metadata_not_found_empty_company", updated_at)


def company_rows(members: DataFrame, meta: DataFrame, updated_at: str) -> DataFrame:
    """Company master rows of the memberships that have an identity."""
    known, _ = split_identity(with_metadata(members, meta), updated_at)
    rows = known.withColumn("description_short", description_short(F.col("description"))).withColumn(
        "updated_at", F.lit(updated_at)
    )
    return rows.select(*COMPANIES.names)


def all_exclusions(placeholders: DataFrame, unknown: DataFrame) -> DataFrame:
    return placeholders.unionByName(unknown)


def reason_counts(excluded: DataFrame) -> DataFrame:
    return excluded.groupBy("reason").agg(F.count("*").alias("excluded_count"))


def universe_audit(providers: DataFrame, members: DataFrame, fetched_at: str) -> DataFrame:
    """Ticker count and status of every provider; one without tickers is skipped."""
    counts = members.select("universe", "ticker").distinct().groupBy("universe").agg(F.count("*").alias("n"))
    count = F.coalesce("n", F.lit(0))
    return providers.join(counts, "universe", "left").select(
        *providers.columns,
        F.when(count > 0, "fetched").otherwise("skipped").alias("status"),
        count.alias("count"),
        F.lit(fetched_at).alias("fetched_at"),
        F.when(count == 0, F.concat(F.lit("No tickers fetched for "), "universe")).alias("error"),
    )


def audit_summary(audit: DataFrame, excluded: DataFrame) -> DataFrame:
    """Counts of the master build in one row."""
    return beside([
        audit.agg(
            F.count_if(F.col("status") == "fetched").alias("fetched_universes"),
            F.count_if(F.col("status") == "skipped").alias("skipped_universes"),
        ),
        excluded.agg(F.count("*").alias("excluded_company_count")),
    ])


def missing_metadata(companies: DataFrame) -> DataFrame:
    lacking = reduce(lambda a, b: a | b, [text_or_empty(F.col(c)) == "" for c in METADATA])
    return companies.agg(F.count_if(lacking).alias("missing_metadata_count"))


def check_companies(companies: DataFrame) -> DataFrame:
    """Bad rows per check of the written master: columns, blanks, repeats."""
    wrong = 0 if companies.columns == COMPANIES.names else 1
    row = beside([
        companies.agg(
            F.count_if(py_strip(text_or_empty(F.col("ticker"))) == "").alias("empty_ticker"),
            F.count_if(py_strip(text_or_empty(F.col("universe"))) == "").alias("empty_universe"),
        ),
        duplicate_keys(companies, ["ticker"]).agg(F.count("*").alias("duplicate_ticker")),
    ]).withColumn("unexpected_columns", F.lit(wrong).cast("long"))
    checks = ["unexpected_columns", "empty_ticker", "duplicate_ticker", "empty_universe"]
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("check"), F.col(c).alias("bad_count")) for c in checks])))


def unsorted_rows(export: DataFrame, idx: str = "idx") -> DataFrame:
    """Exported rows that are not at their sorted place."""
    return numbered(export, ["ticker", idx], "_place").filter(F.col("_place") != F.col(idx)).drop("_place")


def select_companies(
    df: DataFrame, universe: str | None = None, ticker: str | None = None, any_universe: bool = False
) -> DataFrame:
    """Distinct (ticker, name) of a universe or a ticker.

    The universe text is compared as a whole, so a company in two universes
    does not match one of them unless ``any_universe`` is set.
    """
    chosen = df
    if universe:
        wanted = universe.upper()
        member = F.array_contains(F.split("universe", ";"), wanted) if any_universe else F.col("universe") == wanted
        chosen = chosen.filter(member)
    if ticker:
        chosen = chosen.filter(F.col("ticker") == ticker.upper())
    return chosen.select("ticker", "company_name").distinct()


def page(df: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """A page of companies in ticker order."""
    ordered = df.orderBy("ticker", "company_name").offset(offset)
    return ordered if limit is None else ordered.limit(limit)


def assign_batches(df: DataFrame, n: int, order: list[str]) -> DataFrame:
    """Consecutive groups of ``n`` rows in a global order, counted from 0."""
    placed = numbered(df, order, "row_index")
    return placed.withColumn("batch_index", F.floor(F.col("row_index") / n).cast("long"))


def _field(df: DataFrame, label: str) -> Column:
    """Column whose header is ``label``, whatever its case; blank if absent."""
    found = [c for c in df.columns if c.strip().lower() == label]
    return py_strip(text_or_empty(F.col(f"`{found[-1]}`"))) if found else F.lit("")


def is_equity(df: DataFrame) -> DataFrame:
    """Holdings of an equity class whose row names no excluded instrument.

    Terms match anywhere in the row text, inside words too.
    """
    asset = F.lower(_field(df, "asset class"))
    text = F.lower(F.concat_ws(" ", *[py_strip(text_or_empty(F.col(f"`{c}`").cast("string"))) for c in df.columns]))
    allowed = (asset == "") | asset.isin(fixed.EQUITY_ASSET_CLASSES)
    return df.filter(allowed & ~text.rlike(any_word(fixed.EXCLUDED_HOLDING_TERMS)))


def is_equity_legacy(df: DataFrame) -> DataFrame:
    """Older rule: equity in the class if given, no cash in the name, a real ticker."""
    asset, name, ticker = (F.lower(_field(df, f)) for f in ("asset class", "name", "ticker"))
    return df.filter(
        (ticker != "") & (ticker != "-")
        & ((asset == "") | asset.contains("equity"))
        & ~name.contains("cash") & ~name.contains("collateral")
    )
