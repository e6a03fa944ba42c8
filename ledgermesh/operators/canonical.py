"""Raw relationships to the canonical snapshot, and the people in it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions.text import (
    blank_to_null, collapse_spaces, normalized_role, person_id_for, py_strip, text_or_empty, upper_key,
)
from ledgermesh.operators.merge import latest_per_key
from ledgermesh.schemas import RELATIONSHIPS
from ledgermesh.session import stage
from ledgermesh.sources.tables import require_columns


def latest_snapshot(raw: DataFrame) -> DataFrame:
    """Rows of each ticker's latest snapshot; ties are all kept.

    A ticker with any update stamp is cut at its latest one, the others at
    their latest creation stamp. The times are aggregated first and joined
    back, so no ticker's rows have to meet in one task. Rows share few stamps,
    so distinct stamps are hashed out before the maximum, which has to sort.
    """
    keyed = raw.withColumn("_ticker", upper_key(F.col("ticker"))).filter("_ticker <> ''")
    stamps = keyed.select("_ticker", "updated_at", "created_at").distinct()
    times = stamps.groupBy("_ticker").agg(
        F.max(blank_to_null(F.col("updated_at"))).alias("_updated"),
        F.max(text_or_empty(F.col("created_at"))).alias("_created"),
    )
    current = F.when(
        F.col("_updated").isNotNull(), F.col("updated_at") == F.col("_updated")
    ).otherwise(text_or_empty(F.col("created_at")) == F.col("_created"))
    return keyed.join(times, "_ticker").filter(current).drop("_ticker", "_updated", "_created")


def blank_ticker_rows(raw: DataFrame) -> DataFrame:
    """Rows the snapshot skips because they carry no ticker."""
    return raw.filter(upper_key(F.col("ticker")) == "")


def filter_to_master(df: DataFrame, master: DataFrame) -> DataFrame:
    """Rows whose ticker is in the company master."""
    keyed = df.withColumn("_ticker", upper_key(F.col("ticker")))
    wanted = master.select(F.col("ticker").alias("_ticker"))
    return keyed.join(wanted, "_ticker", "left_semi").drop("_ticker")


def snapshot_tickers(df: DataFrame) -> DataFrame:
    return df.select(upper_key(F.col("ticker")).alias("ticker")).filter("ticker <> ''").distinct()


def excluded_tickers(df: DataFrame, master: DataFrame) -> DataFrame:
    """Snapshot tickers the master does not have."""
    return snapshot_tickers(df).join(master.select("ticker"), "ticker", "left_anti")


def _cleaned(df: DataFrame) -> DataFrame:
    return df.select(
        F.col("id"),
        upper_key(F.col("ticker")).alias("ticker"),
        py_strip(text_or_empty(F.col("company_name"))).alias("company_name"),
        collapse_spaces(text_or_empty(F.col("person_name"))).alias("person_name"),
        py_strip(text_or_empty(F.col("role"))).alias("role"),
        py_strip(text_or_empty(F.col("role_category"))).alias("role_category"),
        F.coalesce(
            blank_to_null(F.col("updated_at")), blank_to_null(F.col("created_at")), F.lit("")
        ).alias("extraction_time"),
    )


def is_complete() -> Column:
    filled = [py_strip(text_or_empty(F.col(c))) != "" for c in ("ticker", "person_name", "role", "role_category")]
    return filled[0] & filled[1] & filled[2] & filled[3]


def split_incomplete(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Cleaned rows that have all four key fields, and those that do not.

    The test needs no more than a trim, so it is cheap where the optimizer
    runs it early, on rows that later joins drop.
    """
    return _cleaned(df.filter(is_complete())), _cleaned(df.filter(~is_complete()))


def dedupe_latest(df: DataFrame) -> DataFrame:
    """Newest row per (ticker, person, role, category)."""
    keys = ["ticker", "person_id", "role", "role_category"]
    return latest_per_key(df, keys, F.desc("extraction_time"), F.desc(F.coalesce("id", F.lit(0))))


def canonicalize(df: DataFrame) -> DataFrame:
    """Cleaned, keyed and deduplicated relationships."""
    complete, _ = split_incomplete(df)
    keyed = complete.select(
        "id", "ticker", "company_name",
        person_id_for(F.col("person_name")).alias("person_id"),
        "person_name",
        normalized_role(F.col("role"), F.col("role_category")).alias("role"),
        "role_category", "extraction_time",
    )
    return dedupe_latest(keyed).select(*RELATIONSHIPS.names)


def canonical_order(df: DataFrame) -> DataFrame:
    return df.orderBy(*RELATIONSHIPS.names)


def normalize(raw: DataFrame, master: DataFrame, snapshot: DataFrame | None = None) -> DataFrame:
    """Canonical relationships of the companies in the master.

    The complete rows kept are written before names and roles are cleaned: a filter on a
    cleaned column would else be run early by the optimizer, with its patterns, on every raw row.
    ``snapshot`` is the latest snapshot of ``raw`` where it has been written already.
    """
    latest = latest_snapshot(raw) if snapshot is None else snapshot
    return canonicalize(stage(filter_to_master(latest, master).filter(is_complete()), "kept"))


def normalize_summary(
    raw: DataFrame, master: DataFrame, canonical: DataFrame, snapshot: DataFrame | None = None
) -> DataFrame:
    """One row of counts; ``canonical`` is the written result of ``normalize``.

    The snapshot (``snapshot`` where it has been written already) is reduced to its
    tickers once, and the master joined to those.
    """
    wanted = stage(master.select("ticker"), "master")
    latest = latest_snapshot(raw) if snapshot is None else snapshot
    kept = latest.select(upper_key(F.col("ticker")).alias("_ticker"), is_complete().alias("_complete"))
    tickers = kept.groupBy("_ticker").agg(F.count("*").alias("_rows"), F.count_if(~F.col("_complete")).alias("_incomplete"))
    known = tickers.join(wanted.select(F.col("ticker").alias("_known")).distinct(), F.col("_ticker") == F.col("_known"), "left")
    row = beside([
        raw.agg(
            F.count("*").alias("source_row_count"), F.count_if(upper_key(F.col("ticker")) == "").alias("_blank"),
        ),
        known.agg(
            F.coalesce(F.sum("_rows"), F.lit(0)).alias("selected_latest_snapshot_row_count"),
            F.count("*").alias("raw_snapshot_distinct_ticker_count"),
            F.count_if(F.col("_known").isNull()).alias("excluded_ticker_count"),
            F.coalesce(F.sum(F.when(F.col("_known").isNotNull(), F.col("_incomplete"))), F.lit(0)).alias("_left_out"),
        ),
        wanted.agg(F.count("*").alias("company_master_ticker_count")),
        canonical.agg(
            F.count_distinct("ticker").alias("canonical_ticker_count"),
            F.count("*").alias("canonical_relationship_count"),
        ),
    ])
    return row.withColumn("skipped_row_count", F.col("_blank") + F.col("_left_out")).drop("_blank", "_left_out")


def beside(one_row_frames: list[DataFrame]) -> DataFrame:
    """One-row frames side by side, by union and a second aggregate."""
    names = [name for frame in one_row_frames for name in frame.columns]
    stacked = None
    for frame in one_row_frames:
        stacked = frame if stacked is None else stacked.unionByName(frame, allowMissingColumns=True)
    return stacked.agg(*[F.max(name).alias(name) for name in names])


def derive_people(df: DataFrame) -> DataFrame:
    """One row per person id with its smallest non-blank name."""
    require_columns(df, ["person_id", "person_name"])
    named = df.filter(text_or_empty(F.col("person_id")) != "").select("person_id", "person_name").distinct()
    return named.groupBy("person_id").agg(
        text_or_empty(F.min(blank_to_null(F.col("person_name")))).alias("person_name")
    )


def blank_person_rows(df: DataFrame) -> DataFrame:
    return df.filter(text_or_empty(F.col("person_id")) == "")


def people_summary(df: DataFrame, people: DataFrame) -> DataFrame:
    """Rows read, people written and rows skipped for a blank id."""
    return beside([
        df.agg(
            F.count("*").alias("relationship_rows_read"),
            F.count_if(text_or_empty(F.col("person_id")) == "").alias("skipped_blank_person_id_rows"),
        ),
        people.agg(F.count("*").alias("unique_people_rows_written")),
    ])
