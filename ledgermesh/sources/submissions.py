"""Filing indexes: ticker maps, filing lists, and the latest annual report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions.text import blank_to_null, is_10k, normalize_ticker_basic
from ledgermesh.operators.merge import latest_per_key

FILING_FIELDS = ["form", "filingDate", "accessionNumber", "primaryDocument"]


def flatten_filings(df: DataFrame, older: DataFrame | None = None) -> DataFrame:
    """Rows of parallel arrays: recent filings first, then older files."""

    def rows(frame: DataFrame, part: int) -> DataFrame:
        zipped = F.arrays_zip(*[F.col(f) for f in FILING_FIELDS])
        return frame.select("cik", F.lit(part).alias("part"), F.posexplode(zipped).alias("pos", "_row")).select(
            "cik", "part", "pos", *[F.col(f"_row.{f}").alias(f) for f in FILING_FIELDS]
        )

    recent = rows(df, 0)
    return recent if older is None else recent.unionByName(rows(older, 1))


def latest_filing(filings: DataFrame) -> DataFrame:
    """Latest annual report of each company; the first listed wins a tie."""
    annual = filings.filter(is_10k(F.col("form")))
    return latest_per_key(annual, ["cik"], F.desc("filingDate"), F.asc("part"), F.asc("pos"))


def ticker_map(df: DataFrame, idx: str = "idx") -> DataFrame:
    """(ticker, cik, name) of a keyed JSON object; the last duplicate wins.

    ``entries`` holds the JSON text; keys count as the order of entries.
    """
    shape = "map<string,struct<cik_str:string,ticker:string,title:string>>"
    entries = df.select(idx, F.posexplode(F.map_values(F.from_json("entries", shape))).alias("pos", "_e"))
    rows = entries.select(
        idx, "pos", normalize_ticker_basic(F.col("_e.ticker")).alias("ticker"),
        F.col("_e.cik_str").alias("cik"), F.col("_e.title").alias("company_name"),
    )
    return latest_per_key(rows, ["ticker"], F.desc(idx), F.desc("pos")).select("ticker", "cik", "company_name")


def resolve_companies(universe: DataFrame, reference: DataFrame) -> DataFrame:
    """Universe rows with the CIK and name to use.

    A universe row with a CIK stands as it is; otherwise the reference row
    counts. Tickers known to neither keep a null CIK.
    """
    known = reference.select("ticker", F.col("cik").alias("_cik"), F.col("company_name").alias("_name"))
    own = blank_to_null(F.col("cik"))
    return universe.join(known, "ticker", "left").select(
        "ticker",
        F.coalesce(own, F.col("_cik")).alias("cik"),
        F.when(own.isNotNull(), F.col("company_name")).otherwise(F.col("_name")).alias("company_name"),
    )
