from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from ledgermesh.functions import names as n
from ledgermesh.operators import extraction as x
from ledgermesh.operators import filings as fl
from ledgermesh.plans import catalog
from ledgermesh.sources import html as w
from ledgermesh.sources import submissions as s

ANCHOR = (
    "<h1>SIGNATURES</h1><p>Pursuant to the requirements of the Securities Exchange Act of 1934,\n"
    "        this report has been signed below by the following persons.</p>"
)


def table(*rows):
    return "<table>" + "".join("<tr>" + "".join(f"<td>{c}</td>" for c in row) + "</tr>" for row in rows) + "</table>"


def signed(name):
    return f"/s/ {name}<br>{name}"


SIGNATURE_PAGES = {
    "lines_without_table": (
        "<h1>SIGNATURES</h1><p>/s/ Executive Compensation Plan</p><p>Chief Executive Officer</p>"
        "<p>/s/ Orla Finch</p><p>Chief Executive Officer and Director</p>",
        [("Orla Finch", "CEO_OF"), ("Orla Finch", "BOARD_OF")],
    ),
    "dated_table": (
        ANCHOR + table(
            ("Signature", "Title", "Date"), (signed("Tomas Lindqvist"), "Chief Executive Officer and Director", "May 4, 2031"),
            (signed("Priya Raman"), "Principal Financial Officer", "May 5, 2031"), (signed("Greta Olsen"), "Director", "May 6, 2031"),
        ),
        [("Tomas Lindqvist", "CEO_OF"), ("Tomas Lindqvist", "BOARD_OF"), ("Priya Raman", "CFO_OF"), ("Greta Olsen", "BOARD_OF")],
    ),
    "hyphenated": (
        ANCHOR + table(("Signature", "Title"), (signed("Mei-Lin Castro"), "Director and Chief Executive Officer")),
        [("Mei-Lin Castro", "CEO_OF"), ("Mei-Lin Castro", "BOARD_OF")],
    ),
    "two_pairs_in_a_row": (
        ANCHOR + table(
            ("Signature", "Title", "Signature", "Title"),
            (signed("Edgar P. Novak"), "Chief Financial Officer", signed("Ines Duarte"), "Director"),
        ),
        [("Edgar P Novak", "CFO_OF"), ("Ines Duarte", "BOARD_OF")],
    ),
    "pairs_without_header": (
        ANCHOR + table((signed("Lars U. Beck"), "Chief Financial Officer", signed("Hana Sato"), "Director")),
        [("Lars U Beck", "CFO_OF"), ("Hana Sato", "BOARD_OF")],
    ),
    "signed_by_power_of_attorney": (
        ANCHOR + table(("Attorney-in-fact<br>Officer Pursuant", "Director", signed("Nora Jean Pike"), "Chief Executive Officer"), (signed("T. Wilder"), "Director", "", "")),
        [("Nora Jean Pike", "CEO_OF"), ("T Wilder", "BOARD_OF")],
    ),
    "title_behind_the_name": (
        "<h1>SIGNATURES</h1><p>/s/ T. Wilder T. Wilder Director Principal Financial Officer</p>", [("T Wilder", "BOARD_OF")],
    ),
    "column_of_names": (
        ANCHOR + table(
            ("Signature", "Name", "Title"), ("/s/", "Edgar P. Novak", "Chief Financial Officer"), ("/s/", "Ines Duarte", "Chief Executive Officer and Director"),
        ),
        [("Edgar P Novak", "CFO_OF"), ("Ines Duarte", "CEO_OF"), ("Ines Duarte", "BOARD_OF")],
    ),
    "titles_of_the_other_signer": (
        ANCHOR + table(("Hana Sato", "Lars Beck Chief Financial Officer"), ("Lars Beck", "Hana Sato Chief Executive Officer")), [],
    ),
}


def docs(spark, pages):
    return spark.createDataFrame(list(pages.items()), "doc_id string, html string")


def test_signature_pages(spark):
    found = x.extract_filings(docs(spark, {k: page for k, (page, _) in SIGNATURE_PAGES.items()}), signature_only=True)
    got: dict[str, list] = {k: [] for k in SIGNATURE_PAGES}
    for row in found.orderBy("doc_id", "pos").collect():
        got[row.doc_id].append((row.name, row.relationship_type))
    assert got == {k: expected for k, (_, expected) in SIGNATURE_PAGES.items()}


@pytest.mark.parametrize("text, reason", [
    ("Deferred Restricted Stock Unit Agreement", "document_name_phrase"), ("Securities Exchange Act", "document_name_phrase"),
    ("Executive Compensation Plan", "document_name_term"), ("Exhibit Schedule", "document_name_term"),
    ("Executive Vice President", "title_only_phrase"), ("Chief Financial Officer", "sec_section_or_stopword"),
    ("President", "too_few_tokens"), ("Officer Pursuant", "legal_boilerplate_phrase"), ("12 --", "empty_after_normalization"),
    ("A B C D E F", "too_many_tokens"), ("Anna -", "too_few_alpha_tokens"), ("Vice Chair", "all_title_words"),
    ("Jane of Doe", "blocked_connector_token"), ("Doe Holdings", "organization_term"), ("jane doe", "invalid_name_casing_or_characters"),
    ("Legal Proceedings Business", "all_filing_vocabulary"), ("Jane Doe", None), ("John Q. Public", None), ("Mary Anne Smith", None),
])
def test_rejection_reasons(spark, text, reason):
    df = spark.createDataFrame([(text,)], "c string")
    assert df.select(n.name_rejection_reason(F.col("c"))).first()[0] == reason


def test_signature_candidates(spark):
    cases = {
        "Wanda K. Merrill Title": "Wanda K Merrill", "Edgar P. Novak Title": "Edgar P Novak", "Title": "",
        "Chief Financial Officer Title": "", "JEN-HSUN O'NEIL": "Jen-Hsun O'Neil", "Title Jane Doe": "",
    }
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r.c: r.s for r in df.select("c", n.signature_candidate(F.col("c")).alias("s")).collect()} == cases


def test_item_10_falls_behind_signatures(spark):
    page = (
        "<p>Item 10. Directors</p><p>In charge is Ann Stone, Chief Financial Officer since 2001; and Mia Reed, Director; the directors are "
        "Mia Reed and Paul Gray.</p>" + "<p>filler words.</p>" * 60 + "<p>Item 11. Pay</p><p>Zed Young, Director</p>" + ANCHOR
        + table(("Ann Stone", "Chief Financial Officer"))
    )
    rows = x.extract_filings(docs(spark, {"d": page})).collect()
    assert {(r.name, r.relationship_type, r.source) for r in rows} == {
        ("Ann Stone", "CFO_OF", "signature_table"), ("Mia Reed", "BOARD_OF", "item_10"), ("Paul Gray", "BOARD_OF", "item_10"),
    }


def test_short_item_mentions_are_passed_over(spark):
    text = "Item 10. Directors 7 Item 11. Pay 9 " + "Item 10. Directors " + "body " * 120 + "Item 12. End"
    df = spark.createDataFrame([(text,)], "t string")
    section = df.select(x.item_section(F.col("t"), "10")).first()[0]
    assert section.startswith("Item 10. Directors body") and section.endswith("body ")
    assert df.select(x.item_section(F.col("t"), "14")).first()[0] == ""


def test_tables_and_text(spark):
    page = (
        "<html><head><style>p{}</style><script>var t='</p>';</script></head><!-- <table><tr><td>no</td></tr></table> -->"
        "<TABLE><tr><th> Name </th><td>A&amp;B&nbsp;&#8217;s<br>line&#x20;two</td><td> </td></tr><tr><td></td></tr></TABLE>tail"
    )
    df = docs(spark, {"d": page})
    assert [r.cells for r in w.html_table_rows(df).collect()] == [["Name", "A&B ’s line two"]]
    assert [r.cells for r in w.html_table_cell_lines(df).collect()] == [[["Name"], ["A&B ’s", "line two"]]]
    assert df.select(w.html_text(F.col("html"))).first()[0] == "Name A&B ’s line two tail"


def test_name_counts_and_ties(spark):
    df = spark.createDataFrame([("d", 0, "Ann Lee"), ("d", 1, "Bo Ray"), ("d", 2, "Bo Ray"), ("e", 0, "X Y"), ("e", 1, "Z W")], "doc_id string, pos int, name string")
    assert {r.doc_id: r.name for r in x.most_common_name(df, ["doc_id"]).collect()} == {"d": "Bo Ray", "e": "X Y"}


def test_latest_filing_and_map(spark):
    rows = spark.createDataFrame(
        [("1", ["10-K", "8-K", "10-K/A"], ["2024-02-01", "2024-05-01", "2024-06-01"], ["a", "b", "c"], ["x", "y", "z"])],
        "cik string, form array<string>, filingDate array<string>, accessionNumber array<string>, primaryDocument array<string>",
    )
    older = rows.withColumn("accessionNumber", F.array(F.lit("old"), F.lit("o2"), F.lit("o3")))
    assert s.latest_filing(s.flatten_filings(rows, older)).first().accessionNumber == "a"
    text = '{"0":{"cik_str":1,"ticker":"brk.b","title":"One"},"1":{"cik_str":2,"ticker":"BRK-B","title":"Two"}}'
    (row,) = s.ticker_map(spark.createDataFrame([(0, text)], "idx int, entries string")).collect()
    assert tuple(row) == ("BRK-B", "2", "Two")


def test_coverage_flags(spark):
    companies = spark.createDataFrame([("A", "a"), ("B", "b")], "ticker string, company_name string")
    kinds = ["CEO_OF", "CFO_OF"] + ["BOARD_OF"] * 5
    edges = spark.createDataFrame([("A", k) for k in kinds], "ticker string, relationship_type string")
    (row,) = fl.low_coverage(companies, edges).collect()
    assert (row.ticker, row.total_relationships, row.ceo_missing, row.board_count_below_5) == ("B", 0, "yes", "yes")


def test_executive_officers_reads_tables_and_text(spark, tmp_path):
    """The name of the second part is no name in a table cell; only the text around it tells the person and the title."""
    names = [(1, "red blue"), (2, "x y; Anna Bell, Chief Executive Officer of all")]
    spark.createDataFrame([(k, name, "B", "STEEL") for k, name in names], "p_partkey int, p_name string, p_brand string, p_type string").write.parquet(
        f"{tmp_path}/part.parquet"
    )
    found = catalog.queries()["executive_officers"](spark, str(tmp_path))
    rows = {tuple(row) for row in found.collect()}
    assert rows >= {(1, "Red Blue", "CFO_OF"), (1, "Red Blue", "EXECUTIVE_OFFICER_OF"), (1, "Steel Blueson", "EXECUTIVE_OFFICER_OF")}
    assert rows >= {(2, "Anna Bell", kind) for kind in ("CEO_OF", "CFO_OF", "EXECUTIVE_OFFICER_OF")}
    assert len(rows) == found.count()
