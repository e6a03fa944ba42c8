"""Officers and directors from filing documents.

Documents are rows of (doc_id, html). Candidates become rows with a position,
and the first of equal candidates is kept by a window, so the work is spread
over documents. Positions are arrays and order like the text they come from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.names import (
    NAMES, canonical_name, is_person_name, name_candidates, name_rejection_reason, normalize_name, signature_candidate,
    signer_title_edges,
)
from ledgermesh.functions.text import any_word, char_slice, clean_text, exploded, let, match_spans, title_relationships
from ledgermesh.operators.merge import latest_per_key
from ledgermesh.session import stage
from ledgermesh.sources.html import cell_text, html_tables, html_text, line_cells, text_cells, with_tables

EDGE_COLUMNS = ["doc_id", "name", "relationship_type", "source", "pos"]
_ANCHOR = fixed.EXCHANGE_ACT_ANCHOR.replace(r"\s+", r"(?:\s|\xa0|&nbsp;|&#160;)+")
_PAIRS = "array<struct<signer:int,title:int>>"


# --- candidates --------------------------------------------------------------


def split_candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Candidates (name, context) that are person names, and the rejected with the reason."""
    judged = df.withColumn("reason", name_rejection_reason(F.col("name")))
    rejected = judged.filter("reason is not null").withColumn("name", clean_text(F.col("name"))).filter("name <> ''")
    return judged.filter("reason is null").drop("reason"), rejected


def valid_relationship(df: DataFrame) -> DataFrame:
    """Rows of a known filing edge type with a plausible person name."""
    return df.filter(F.col("relationship_type").isin(fixed.FILING_EDGE_TYPES) & is_person_name(F.col("name")))


def gate_edges(edges: DataFrame) -> DataFrame:
    """Edges whose person still passes as a person name."""
    return edges.filter(is_person_name(F.col("source_person")))


def dedupe_relationships(df: DataFrame) -> DataFrame:
    """First valid row per document, canonical name and type; names normalised."""
    keyed = valid_relationship(df).withColumn("name", normalize_name(F.col("name"))).withColumn(
        "_key", canonical_name(F.col("name"))
    )
    return latest_per_key(keyed.filter("_key <> ''"), ["doc_id", "_key", "relationship_type"], F.asc("pos")).drop("_key")


def merge_sources(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """Primary rows first, then the fallback rows they do not cover."""
    ranked = primary.withColumn("pos", F.concat(F.array(F.lit(0)), "pos")).unionByName(
        fallback.withColumn("pos", F.concat(F.array(F.lit(1)), "pos"))
    )
    return dedupe_relationships(ranked)


def most_common_name(df: DataFrame, keys: list[str]) -> DataFrame:
    """Most frequent canonical name per key in its first spelling; ties go to the first seen."""
    counted = df.groupBy(*keys, canonical_name(F.col("name")).alias("canonical")).agg(
        F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.min_by("name", "pos").alias("name")
    )
    return latest_per_key(counted, keys, F.desc("n"), F.asc("first_pos")).select(*keys, "canonical", "name")


# --- text sections -----------------------------------------------------------


def filing_texts(docs: DataFrame) -> DataFrame:
    return docs.withColumn("text", html_text(F.col("html")))


def item_section(text: Column, number: str) -> Column:
    """Section of an item up to the next closing item; short mentions are passed over."""
    wanted = number.upper()

    def numbered(span: Column) -> Column:
        return F.struct(
            span["start"].alias("start"), F.upper(F.regexp_extract(span["text"], fixed.ITEM_HEADING, 1)).alias("item")
        )

    def sections(heads: Column) -> Column:
        def cut(head: Column) -> Column:
            closing = F.filter(heads, lambda h: (h["start"] > head["start"]) & h["item"].isin(fixed.ITEM_SECTION_ENDS))
            return char_slice(text, head["start"], F.coalesce(F.get(closing, F.lit(0))["start"], F.length(text)))

        return F.transform(F.filter(heads, lambda h: h["item"] == wanted), cut)

    cuts = let(F.transform(match_spans(text, fixed.ITEM_HEADING), numbered), sections)
    long_enough = F.filter(cuts, lambda s: F.length(s) >= fixed.MIN_ITEM_SECTION_CHARS)
    return F.coalesce(F.get(long_enough, F.lit(0)), F.lit(""))


def context_windows(text: Column, pattern: str, window: int) -> Column:
    """Text around every match, a quarter window before and a full one after."""

    def around(span: Column) -> Column:
        start = F.greatest(span["start"] - window // 4, F.lit(0))
        return char_slice(text, start, F.least(span["end"] + window, F.length(text)))

    return F.array_join(F.transform(match_spans(text, pattern), around), " ")


def signature_section(text: Column, chars: int | None = fixed.SIGNATURE_SECTION_CHARS) -> Column:
    """Text from the last SIGNATURES heading on, its first ``chars`` characters (None: all of it)."""
    tail = F.regexp_extract(text, r"(?is)\A.*\b(SIGNATURES\b.*)\z", 1)
    return tail if chars is None else F.substring(tail, 1, chars)


# --- signature tables --------------------------------------------------------


def _line_rows(rows: Column) -> Column:
    """Non-empty rows of non-empty cells, each cell an array of lines."""
    return F.filter(F.transform(rows, line_cells), lambda row: F.size(row) > 0)


def _text_rows(rows: Column) -> Column:
    """Non-empty rows of non-empty cell texts."""
    return F.filter(F.transform(rows, text_cells), lambda row: F.size(row) > 0)


def _flat(lines: Column) -> Column:
    return clean_text(F.array_join(lines, " "))


def _places(values: Column, test) -> Column:
    """Indexes, from 0, of the values that pass a test."""
    marked = F.transform(values, lambda v, i: F.when(test(v), i.cast("int")))
    return F.array_compact(marked)


def signature_tables(docs: DataFrame) -> DataFrame:
    """Candidate signature tables of every document, in one array.

    Tables below the Exchange Act sentence count; without any, those with
    ``/s/`` or "signature" in their text. ``has_evidence`` tells whether a
    candidate names a signer title.
    """
    spans = with_tables(docs).select(
        "doc_id", F.regexp_instr("visible", F.lit(f"({_ANCHOR})")).alias("anchor"),
        F.transform(
            "tables",
            lambda t, i: F.struct(
                i.cast("int").alias("table_no"), t["start"].alias("start"), t["rows"].alias("rows"), cell_text(t["markup"]).alias("text"),
            ),
        ).alias("tables"),
    )
    below = F.filter("tables", lambda t: t["start"] >= F.col("anchor"))
    marked = F.filter("tables", lambda t: t["text"].contains("/s/") | F.lower(t["text"]).contains("signature"))
    anchored = (F.col("anchor") > 0) & (F.size(below) > 0)
    chosen = spans.select("doc_id", F.when(anchored, below).otherwise(marked).alias("tables"))
    return chosen.withColumn("has_evidence", F.exists("tables", lambda t: t["text"].rlike(fixed.SIGNER_TITLE)))


def signature_pairs(row: Column) -> Column:
    """(signer, title) column pairs a header row sets up.

    Each signer column takes the nearest title column not yet taken, columns
    to its right first; a plain "name" column goes before the others.
    """
    labels = F.transform(row, lambda cell: F.lower(_flat(cell)))

    def pairs(l: Column) -> Column:
        signers = F.transform(
            F.array_sort(
                F.transform(
                    _places(l, lambda v: v.contains("signature") | v.isin("name", "signer")),
                    lambda i: F.struct((F.get(l, i) != "name").cast("int").alias("late"), i.alias("at")),
                )
            ),
            lambda s: s["at"],
        )
        titles = _places(l, lambda v: v.contains("title") | v.contains("capacity"))

        def take(acc: Column, signer: Column) -> Column:
            free = F.filter(
                titles, lambda t: (t != signer) & ~F.exists(acc, lambda p: p["title"] == t)
            )
            nearest = F.array_min(
                F.transform(
                    free,
                    lambda t: F.struct((t < signer).cast("int").alias("left"), F.abs(t - signer).alias("gap"), t.alias("at")),
                )
            )
            pair = F.array(F.struct(signer.alias("signer"), nearest["at"].alias("title")))
            return F.when(F.size(free) > 0, F.concat(acc, pair)).otherwise(acc)

        return F.aggregate(signers, F.array().cast(_PAIRS), take)

    return let(labels, pairs)


def inferred_pairs(names: Column, titles: Column) -> Column:
    """(signer, title) pairs of a row without a header: nearest unused name to the left."""
    named = _places(names, lambda n: n != "")

    def take(acc: Column, title: Column) -> Column:
        free = F.filter(named, lambda n: (n < title) & ~F.exists(acc, lambda p: p["signer"] == n))
        pair = F.array(F.struct(F.array_max(free).alias("signer"), title.alias("title")))
        return F.when(F.size(free) > 0, F.concat(acc, pair)).otherwise(acc)

    return F.aggregate(_places(titles, lambda t: t.rlike(fixed.SIGNER_TITLE)), F.array().cast(_PAIRS), take)


#: What a text that may hold a name stands for.
_TYPED, _SIGNED, _TITLE = 0, 1, 2
_CANDIDATES = "array<struct<cell:int,kind:int,at:int,text:string>>"
_FOUND = "array<struct<cell:int,kind:int,at:int,name:string,canonical:string>>"


def _candidates(texts: Column, cell, kind: int) -> Column:
    return F.transform(
        texts, lambda t, at: F.struct(F.lit(cell).cast("int").alias("cell"), F.lit(kind).alias("kind"), at.cast("int").alias("at"), t.alias("text"))
    ).cast(_CANDIDATES)


def judged(rows: DataFrame, candidates: Column) -> DataFrame:
    """``rows`` with ``found``: those of their candidates that are names, as (cell, kind, at, name, canonical).

    Every distinct text is judged once, however many rows bring it up, by plain columns
    over a table of texts; the verdicts are joined back. Rows are written first, as they are
    read twice.
    """
    held = stage(rows.withColumn("_row", F.monotonically_increasing_id()).withColumn("_candidates", candidates), "name-candidates")
    each = exploded(held, ["_row"], F.col("_candidates"), "_pos", "_c").select("_row", "_c.*")
    texts = each.select("text").distinct()
    names = exploded(texts, ["text"], F.array_compact(F.array(F.nullif(signature_candidate(F.col("text")), F.lit("")))), "_pos", "name")
    known = names.select("text", "name", canonical_name(F.col("name")).alias("canonical"))
    hits = each.join(known, "text").groupBy("_row").agg(F.collect_list(F.struct("cell", "kind", "at", "name", "canonical")).alias("found"))
    joined = held.drop("_candidates").join(hits, "_row", "left").drop("_row")
    return joined.withColumn("found", F.coalesce("found", F.array().cast(_FOUND)))


def cell_candidates(lines: Column, cell: Column) -> Column:
    """Texts of a cell that may name its signer: typed lines, lines after ``/s/``, and its names where it holds a title."""
    slash = r"(?i)^\s*/s/\s*"
    usable = F.filter(lines, lambda line: ~line.rlike(r"(?iU)\bsignature\b"))

    def texts(chosen: Column) -> Column:
        return F.flatten(F.transform(chosen, lambda x: F.concat(F.array(x), F.regexp_extract_all(x, F.lit(NAMES), F.lit(1)))))

    typed = texts(F.filter(usable, lambda line: ~line.rlike(slash)))
    signed = texts(F.transform(F.filter(usable, lambda line: line.rlike(slash)), lambda line: F.regexp_replace(line, slash, "")))
    titled = let(_flat(lines), lambda t: F.when(t.rlike(fixed.SIGNER_TITLE), name_candidates(t)).otherwise(F.array().cast("array<string>")))
    return F.concat(_candidates(typed, cell, _TYPED), _candidates(signed, cell, _SIGNED), _candidates(titled, cell, _TITLE))


def signer_of_cell(found: Column, cell: Column) -> Column:
    """Signer named in a cell: the last valid name, typed lines before ``/s/`` lines."""
    own = F.filter(found, lambda f: (f["cell"] == cell) & (f["kind"] != _TITLE))
    ranked = F.transform(own, lambda f: F.struct((f["kind"] == _TYPED).alias("typed"), f["at"].alias("at"), f["name"].alias("name"), f["canonical"].alias("canonical")))
    return F.array_max(ranked)


def signature_table_edges(tables: DataFrame) -> DataFrame:
    """Signers of the candidate tables with the edge types of their own row's title."""
    one = exploded(tables, ["doc_id"], F.col("tables"), "pos", "t").filter(F.col("t.text").rlike(fixed.SIGNER_TITLE))
    rows = one.select("doc_id", F.col("t.table_no").alias("table_no"), _line_rows(F.col("t.rows")).alias("rows"))
    heads = rows.withColumn("heads", F.transform(F.slice("rows", 1, 3), signature_pairs))
    first = F.get(_places(F.col("heads"), lambda p: F.size(p) > 0), F.lit(0))
    headed = heads.select(
        "doc_id", "table_no", "rows", F.coalesce(first + 1, F.lit(0)).alias("first_row"),
        F.get("heads", first).alias("header_pairs"),
    )
    data = exploded(headed, ["doc_id", "table_no", "first_row", "header_pairs"], F.col("rows"), "row_no", "cells").filter(
        "row_no >= first_row"
    )
    read = data.select("doc_id", "table_no", "row_no", "header_pairs", "cells", F.transform("cells", _flat).alias("titles"))
    read = judged(read, F.flatten(F.transform("cells", cell_candidates)))
    read = read.withColumn("signers", F.transform("cells", lambda c, i: signer_of_cell(F.col("found"), i)))
    names = F.transform("signers", lambda s: F.coalesce(s["name"], F.lit("")))
    pairs = F.coalesce("header_pairs", inferred_pairs(names, F.col("titles")))
    read = exploded(read, ["doc_id", "table_no", "row_no", "signers", "titles", "found"], pairs, "pair_no", "pair")
    signers = read.select(
        "doc_id", "table_no", "row_no", "pair_no", F.get("signers", F.col("pair.signer")).alias("signer"),
        F.get("titles", F.col("pair.title")).alias("title"),
        F.filter("found", lambda f: (f["cell"] == F.col("pair.title")) & (f["kind"] == _TITLE)).alias("named"),
    )
    other = F.exists("named", lambda f: f["canonical"] != F.col("signer.canonical"))
    clear = F.col("title").rlike(fixed.SIGNER_TITLE) & F.col("signer").isNotNull()
    kinds = F.when(clear & ~other, signer_title_edges(F.col("title")))
    places = ["table_no", "row_no", "pair_no"]
    edges = exploded(signers, ["doc_id", F.col("signer.name").alias("name"), *places], kinds, "edge_no", "relationship_type")
    return edges.select(
        "doc_id", "name", "relationship_type", F.lit("signature_table").alias("source"),
        F.array("table_no", "row_no", "pair_no", "edge_no").alias("pos"),
    )


# --- signature free text -----------------------------------------------------


def _placed_name(found: Column) -> Column:
    return F.struct(found["at"].alias("at"), found["name"].alias("name"))


def signature_text_edges(sections: DataFrame) -> DataFrame:
    """Signers in free text: the nearest name before each title, else after it.

    ``sections`` is (doc_id, section). The look back stops at ``/s/`` and does
    not cross another title; the title ends where the next signer's begins.
    """
    spans = sections.withColumn("spans", match_spans(F.col("section"), fixed.SIGNER_TITLE))
    titles = exploded(spans, ["doc_id", "section", "spans"], F.col("spans"), "title_no", "span")
    text, start, end = F.col("section"), F.col("span.start"), F.col("span.end")
    until = F.least(end + fixed.SIGNER_LOOKAHEAD_CHARS, F.length(text))
    following = F.get("spans", F.col("title_no") + 1)["start"]
    between = F.lower(clean_text(char_slice(text, end, following)))
    linked = between.rlike(r"^(?:,|and|/|&|\s)+$")
    context_end = F.when(following.isNull() | linked, until).otherwise(F.least(until, following))
    back = char_slice(text, F.greatest(start - fixed.SIGNER_LOOKBACK_CHARS, F.lit(0)), start)
    near = titles.select(
        "doc_id", "title_no",
        F.regexp_replace(back, r"(?s)^.*(?=/s/)", "").alias("before"),
        char_slice(text, end, until).alias("after"),
        char_slice(text, start, context_end).alias("title"),
    )
    texts = F.concat(_candidates(name_candidates(F.col("before")), 0, _TYPED), _candidates(name_candidates(F.col("after")), 1, _TYPED))
    named = judged(near, texts).select(
        "doc_id", "title_no", "before", "title",
        F.array_max(F.transform(F.filter("found", lambda f: f["cell"] == 0), _placed_name))["name"].alias("behind"),
        F.array_min(F.transform(F.filter("found", lambda f: f["cell"] == 1), _placed_name))["name"].alias("ahead"),
    )
    crossed = F.expr("substring_index(before, behind, -1)")
    chosen = F.when(F.col("behind").isNotNull() & ~crossed.rlike(fixed.SIGNER_TITLE), F.col("behind")).otherwise(F.col("ahead"))
    signers = named.select("doc_id", "title_no", chosen.alias("name"), "title")
    kinds = F.when(F.col("name").isNotNull(), signer_title_edges(F.col("title")))
    edges = exploded(signers, ["doc_id", "name", "title_no"], kinds, "edge_no", "relationship_type")
    return edges.select(
        "doc_id", "name", "relationship_type", F.lit("signature_free_text").alias("source"),
        F.array("title_no", "edge_no").alias("pos"),
    )


def signature_edges(texts: DataFrame) -> DataFrame:
    """Signers from tables; free text only for documents whose tables name none.

    ``texts`` is (doc_id, html, text). Tables are written once, as they are read twice.
    """
    tables = stage(signature_tables(texts), "signature-tables")
    from_tables = dedupe_relationships(signature_table_edges(tables))
    without = tables.filter(~F.col("has_evidence")).select("doc_id")
    sections = texts.join(without, "doc_id", "left_semi").select("doc_id", signature_section(F.col("text")).alias("section"))
    return from_tables.unionByName(dedupe_relationships(signature_text_edges(sections)))


# --- item 10 -----------------------------------------------------------------


def names_near_title(text: Column, title: str) -> Column:
    """Valid names before a title, then those after it, in text order."""
    before = (
        rf"({fixed.NAME_CAPTURE})\s*(?:,|–|-|—|\(|\sis\s|\sserves\sas\s|\swas\s)?\s*(?:our\s+|the\s+|as\s+)?(?i:{title})"
    )
    after = rf"(?i:{title})\s*(?:is|was|:|,|-|–|—)?\s*({fixed.NAME_CAPTURE})"
    found = F.concat(
        F.regexp_extract_all(text, F.lit(before), F.lit(1)), F.regexp_extract_all(text, F.lit(after), F.lit(1))
    )
    return F.filter(F.transform(found, normalize_name), is_person_name)


def officers(texts: DataFrame, source: str = "item_10") -> DataFrame:
    """CEO and CFO by majority of mentions; one person is not both.

    The two are compared by a window over the documents, so the text is searched once.
    """
    kinds = F.array(
        F.struct(F.lit("CEO_OF").alias("kind"), names_near_title(F.col("text"), fixed.CEO_TITLE).alias("names")),
        F.struct(F.lit("CFO_OF").alias("kind"), names_near_title(F.col("text"), fixed.CFO_TITLE).alias("names")),
    )
    kinds = exploded(texts, ["doc_id"], kinds, "kind_no", "k")
    mentions = exploded(kinds, ["doc_id", F.col("k.kind").alias("kind")], F.col("k.names"), "pos", "name")
    best = most_common_name(mentions, ["doc_id", "kind"])
    ceo = F.max(F.when(F.col("kind") == "CEO_OF", F.col("canonical"))).over(Window.partitionBy("doc_id"))
    both = F.col("doc_id").isNotNull() & (F.col("kind") == "CFO_OF") & F.col("_ceo").eqNullSafe(F.col("canonical"))
    kept = best.withColumn("_ceo", ceo).filter(~both)
    return kept.select(
        "doc_id", "name", F.col("kind").alias("relationship_type"), F.lit(source).alias("source"),
        F.array(F.when(F.col("kind") == "CEO_OF", 0).otherwise(1)).alias("pos"),
    )


def _tables_with_rows(docs: DataFrame) -> DataFrame:
    tables = html_tables(docs)
    return tables.select("doc_id", "table_no", cell_text(F.col("markup")).alias("table_text"), _text_rows(F.col("rows")).alias("rows"))


def _named_rows(tables: DataFrame, header_test, last: bool) -> DataFrame:
    """Rows below the header with the name column's cell, or the second cell if that is no name."""
    places = _places(F.transform(F.get("rows", F.lit(0)), F.lower), header_test)
    at = F.try_element_at(places, F.lit(-1 if last else 1))
    headed = tables.withColumn("at", F.coalesce(at, F.lit(0)))
    body = F.slice("rows", F.lit(2), F.greatest(F.size("rows") - 1, F.lit(0)))
    rows = exploded(headed, ["doc_id", "table_no", "at"], body, "row_no", "cells").filter("at < size(cells)")
    tried = F.transform(F.array(F.get("cells", F.col("at")), F.get("cells", F.lit(1))), lambda c: normalize_name(F.coalesce(c, F.lit(""))))
    names = F.slice(F.filter(tried, is_person_name), 1, 1)
    return exploded(rows, ["doc_id", "table_no", "row_no", "at", "cells"], names, "_pos", "name").drop("_pos")


def executives_from_tables(docs: DataFrame, source: str = "item_10") -> DataFrame:
    tables = _tables_with_rows(docs).filter(F.col("table_text").rlike(fixed.EXECUTIVE_CONTEXT))
    rows = _named_rows(tables, lambda c: c.contains("name") | c.contains("executive officer"), last=True)
    others = F.filter("cells", lambda c, i: i != F.col("at"))
    title = F.concat(F.array_join(others, " "), F.lit(" executive officer"))
    edges = exploded(rows, ["doc_id", "name", "table_no", "row_no"], title_relationships(title), "edge_no", "relationship_type")
    return edges.select(
        "doc_id", "name", "relationship_type", F.lit(source).alias("source"),
        F.array("table_no", "row_no", "edge_no").alias("pos"),
    )


def executives_from_text(texts: DataFrame, source: str = "item_10") -> DataFrame:
    near = texts.select("doc_id", context_windows(F.col("text"), fixed.EXECUTIVE_CONTEXT, fixed.EXECUTIVE_WINDOW_CHARS).alias("near"))
    pattern = (
        rf"({fixed.NAME_CAPTURE})\s*(?:,|–|-|—|\()\s*"
        rf"(?i:([^.;]{{0,220}}?(?:{fixed.OFFICER_TITLE_MARKS})[^.;]{{0,220}}))"
    )
    found = F.arrays_zip(
        F.regexp_extract_all("near", F.lit(pattern), F.lit(1)).alias("name"),
        F.regexp_extract_all("near", F.lit(pattern), F.lit(2)).alias("title"),
    )
    cleaned = F.transform(
        found, lambda h: F.struct(normalize_name(h["name"]).alias("name"), clean_text(h["title"]).alias("title"))
    )
    rows = exploded(near, ["doc_id"], F.filter(cleaned, lambda h: is_person_name(h["name"])), "row_no", "hit")
    kinds = title_relationships(F.col("hit.title"))
    edges = exploded(rows, ["doc_id", F.col("hit.name").alias("name"), "row_no"], kinds, "edge_no", "relationship_type")
    return edges.select(
        "doc_id", "name", "relationship_type", F.lit(source).alias("source"), F.array("row_no", "edge_no").alias("pos")
    )


def _staged(frames: list[DataFrame]) -> DataFrame:
    """Union in which earlier frames come first."""
    merged = None
    for turn, frame in enumerate(frames):
        placed = frame.select(*EDGE_COLUMNS).withColumn("pos", F.concat(F.array(F.lit(turn)), "pos"))
        merged = placed if merged is None else merged.unionByName(placed)
    return merged


def executive_officers(texts: DataFrame, source: str = "item_10") -> DataFrame:
    """Executives from tables first, then from text around "executive officers"."""
    return dedupe_relationships(_staged([executives_from_tables(texts, source), executives_from_text(texts, source)]))


def _board(df: DataFrame, *pos: str) -> DataFrame:
    return df.select(
        "doc_id", "name", F.lit("BOARD_OF").alias("relationship_type"), F.lit("item_10").alias("source"),
        F.array(*[F.col(p) for p in pos]).alias("pos"),
    )


def board_from_tables(docs: DataFrame) -> DataFrame:
    lowered = F.lower("table_text")
    tables = _tables_with_rows(docs).filter(lowered.contains("director") & lowered.rlike(any_word(fixed.BOARD_TABLE_MARKS)))
    rows = _named_rows(
        tables, lambda c: c.contains("name") | c.contains("nominee") | (clean_text(c) == "director"), last=False
    )
    return _board(rows, "table_no", "row_no")


def board_from_text(texts: DataFrame) -> DataFrame:
    """Names on director lines, then names in sentences that list nominees or directors."""
    line = rf"({fixed.NAME_CAPTURE})\s*(?:,|–|-|—)?\s*(?i:(?:Independent\s+)?Director\b)"
    sentence = r"(?i)(?:nominees?|directors?)\s+(?:are|include|were)\s+(.{20,500}?)(?:\.|;)"
    phrases = F.regexp_extract_all("text", F.lit(sentence), F.lit(1))
    listed = F.flatten(F.transform(phrases, lambda p: F.regexp_extract_all(p, F.lit(NAMES), F.lit(1))))
    found = F.concat(F.regexp_extract_all("text", F.lit(line), F.lit(1)), listed)
    names = F.filter(F.transform(found, normalize_name), is_person_name)
    return _board(exploded(texts, ["doc_id"], names, "name_no", "name"), "name_no")


def board_members(texts: DataFrame) -> DataFrame:
    """Directors from tables, then from text; ``texts`` is (doc_id, html, text)."""
    return dedupe_relationships(_staged([board_from_tables(texts), board_from_text(texts)]))


def item10_edges(texts: DataFrame) -> DataFrame:
    """Officers, executives and directors of the governance item or the whole filing.

    ``texts`` is (doc_id, html, text). An item section is plain text, so board
    tables count only without one. Sections are cut out and written once, as three passes read them.
    """
    texts = texts.withColumn("section", item_section(F.col("text"), "10"))
    part = F.when(F.col("section") != "", F.col("section")).otherwise(F.col("text"))
    scoped = texts.select("doc_id", F.when(F.col("section") == "", F.col("html")).otherwise("").alias("html"), part.alias("text"))
    scoped = stage(scoped, "item10-scope")
    return dedupe_relationships(_staged([officers(scoped), executive_officers(texts.drop("section")), board_members(scoped)]))


def extract_filings(docs: DataFrame, signature_only: bool = False) -> DataFrame:
    """Relationships of every document: signature pages first, item 10 as fallback.

    The flat text is written once, as several passes read it.
    """
    texts = stage(filing_texts(docs.select("doc_id", "html")), "filing-texts")
    signatures = signature_edges(texts)
    return signatures if signature_only else merge_sources(signatures, item10_edges(texts))
