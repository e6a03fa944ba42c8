from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import text as t
from ledgermesh.operators import canonical as c
from ledgermesh.schemas import RELATIONSHIPS_RAW

DEFAULT = {
    "id": 1, "ticker": "NVDA", "person_name": "Jensen Huang", "person_key": "JENSEN_HUANG",
    "role": "President and Chief Executive Officer", "role_category": "EXECUTIVE",
    "company_name": "NVIDIA Corporation", "batch_id": "batch_1", "extraction_method": "api",
    "created_at": "2026-01-01T00:00:00+00:00", "updated_at": None,
}


def raw(spark, *changes):
    rows = [{**DEFAULT, "id": n, **change} for n, change in enumerate(changes, 1)]
    return spark.createDataFrame([tuple(r[k] for k in RELATIONSHIPS_RAW.names) for r in rows], RELATIONSHIPS_RAW)


def master(spark, *tickers):
    return spark.createDataFrame([(x.strip(),) for x in tickers], "ticker string")


def one(spark, fn, *values):
    df = spark.createDataFrame([tuple(values)], [f"c{n}" for n in range(len(values))])
    return df.select(fn(*[F.col(f"c{n}") for n in range(len(values))])).first()[0]


@pytest.mark.parametrize("name, expected", [
    ("Jensen Huang", "JENSEN_HUANG"), ("Colette M. Kress", "COLETTE_M_KRESS"), ("A. Brooke Seawell", "A_BROOKE_SEAWELL"),
    ("Dr. Lisa T. Su", "LISA_T_SU"), ("Mr. Mark A. Stevens", "MARK_A_STEVENS"), ("John Smith, Jr.", "JOHN_SMITH"),
    ("Jane Doe III", "JANE_DOE"), ("Dr. Mr.", ""), ("  Ann\t Lee ", "ANN_LEE"),
])
def test_person_id(spark, name, expected):
    assert one(spark, t.person_id_for, name) == expected


@pytest.mark.parametrize("role, category, expected", [
    ("CEO", "EXECUTIVE", "CEO"), ("Group CEO", "EXECUTIVE", "CEO"), ("Co-CEO", "EXECUTIVE", "CEO"),
    ("CEO, Schwab Asset Management", "EXECUTIVE", "CEO"), ("Executive Chair and Chief Executive Officer", "EXECUTIVE", "CEO"),
    ("  President   and   CEO.  ", "EXECUTIVE", "CEO"), ("CFO of Subsidiary", "EXECUTIVE", "CFO"),
    ("Chief Financial Officer - Americas", "EXECUTIVE", "CFO"), ("  EVP   and   CFO;  ", "EXECUTIVE", "CFO"),
    ("Chief Executive Officer", "BOARD", "Chief Executive Officer"), ("Chief Financial Officer", "BOARD", "Chief Financial Officer"),
    ("Independent Chair of the Board", "BOARD", "Chairman"), (" Counsel ", "EXECUTIVE", "Counsel"),
])
def test_role(spark, role, category, expected):
    assert one(spark, t.normalized_role, role, category) == expected


def test_snapshot_by_update_time(spark):
    rows = raw(
        spark,
        {"person_name": "Old Person", "updated_at": "2026-06-30T12"},
        {"person_name": "New CEO", "updated_at": "2026-07-01T12"},
        {"person_name": "New CFO", "updated_at": "2026-07-01T12", "batch_id": "batch_2"},
        {"ticker": "AAPL", "person_name": "Apple CEO", "updated_at": "2026-01-15T12"},
        {"ticker": "  "},
    )
    kept = c.latest_snapshot(rows)
    assert sorted(r.person_name for r in kept.collect()) == ["Apple CEO", "New CEO", "New CFO"]
    assert c.blank_ticker_rows(rows).count() == 1


def test_snapshot_falls_back_to_creation(spark):
    rows = raw(
        spark,
        {"ticker": "MSFT", "person_name": "Old Person", "created_at": "2026-06-30"},
        {"ticker": "MSFT", "person_name": "New CEO", "created_at": "2026-07-01"},
        {"ticker": "MSFT", "person_name": "New CFO", "role": "CFO", "created_at": "2026-07-01"},
    )
    result = c.canonicalize(c.latest_snapshot(rows)).collect()
    assert sorted(r.person_name for r in result) == ["New CEO", "New CFO"]
    assert {r.extraction_time for r in result} == {"2026-07-01"}


def test_newest_row_of_a_key(spark):
    rows = raw(
        spark,
        {"person_name": "Dr. Lisa T. Su", "role": "CEO"},
        {"person_name": "Lisa T Su", "role": "CEO", "updated_at": "2026-01-02"},
    )
    (row,) = c.canonicalize(rows).collect()
    assert (row.person_name, row.extraction_time) == ("Lisa T Su", "2026-01-02")


def test_several_ceos_stay(spark):
    rows = raw(spark, {"person_name": "CEO One"}, {"person_name": "CEO Two"})
    assert c.canonicalize(rows).count() == 2


def test_master_filter_and_counts(spark):
    rows = raw(spark, {"ticker": "nvda "}, {"ticker": "MSFT", "person_name": "A B"}, {"ticker": " AISP "}, {"role": " "})
    known = master(spark, "NVDA", "MSFT")
    canonical = c.normalize(rows, known)
    summary = c.normalize_summary(rows, known, canonical).first().asDict()
    assert summary == {
        "source_row_count": 4, "selected_latest_snapshot_row_count": 4, "company_master_ticker_count": 2,
        "raw_snapshot_distinct_ticker_count": 3, "excluded_ticker_count": 1, "canonical_ticker_count": 2,
        "canonical_relationship_count": 2, "skipped_row_count": 1,
    }
    assert [r.ticker for r in c.excluded_tickers(rows, known).collect()] == ["AISP"]


def test_people(spark):
    df = spark.createDataFrame(
        [("LISA_SU", "Lisa T. Su"), ("LISA_SU", ""), ("LISA_SU", "Dr. Lisa T. Su"), ("UNKNOWN", None), ("", "x"), (None, "y")],
        "person_id string, person_name string",
    )
    assert sorted(map(tuple, c.derive_people(df).collect())) == [("LISA_SU", "Dr. Lisa T. Su"), ("UNKNOWN", "")]
    assert c.blank_person_rows(df).count() == 2


def test_people_need_a_name_column(spark):
    with pytest.raises(ValueError, match="person_name"):
        c.derive_people(spark.createDataFrame([("a",)], "person_id string"))
