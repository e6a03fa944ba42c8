"""String expressions: tickers, person ids, roles, ids, and text clean-up.

Every function takes and returns a ``Column`` and stays inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed

# Whitespace as Unicode text handling sees it; Spark's trim knows only blanks.
SPACE = r"[\s\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OTHER_SPACE = SPACE.replace(r"[\s", r"[\t\n\x0b\f\r")
# The look-ahead rejects printable ASCII at once, before the long class is tried.
_UNEVEN = f"(?=[^!-~])(?:{SPACE}{{2,}}|{_OTHER_SPACE})"
_SPACE_CHARS = "".join(
    chr(code) for code in
    [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
)
_LINE_BREAK = r"\r\n|[\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def any_word(words: list[str]) -> str:
    """Alternation of literal words for a regular expression."""
    return "|".join(word.replace(".", r"\.") for word in words)


def py_strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_SPACE_CHARS))


def collapse_spaces(c: Column) -> Column:
    """Whitespace runs as one blank, none at the ends; even text is left as it is."""
    return F.btrim(F.regexp_replace(c, _UNEVEN, " "))


def clean_text(c: Column) -> Column:
    """Whitespace runs, hard spaces included, become one blank."""
    return collapse_spaces(c)


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def text_or_empty(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def upper_key(c: Column) -> Column:
    """Trimmed upper-case key, ``""`` for null."""
    return F.upper(py_strip(text_or_empty(c)))


def normalize_ticker(c: Column) -> Column:
    bare = F.regexp_replace(F.upper(text_or_empty(c)), f"{SPACE}+", "")
    ticker = F.replace(bare, F.lit("."), F.lit("-"))
    return F.when(ticker.isin(fixed.PLACEHOLDER_TICKERS + fixed.CASH_TICKERS), "").otherwise(ticker)


def normalize_ticker_basic(c: Column) -> Column:
    return F.replace(F.upper(py_strip(c)), F.lit("."), F.lit("-"))


def is_placeholder(c: Column) -> Column:
    return F.upper(py_strip(c)).isin(fixed.PLACEHOLDER_TICKERS)


def _spelled(words: list[str]) -> str:
    """Tokens whose letters alone spell one of ``words``, whatever is between."""
    other = "[^A-Za-z ]*"
    return "|".join(other + other.join(word) + other for word in words)


# Repeated groups are possessive throughout: the others recurse once per repetition on the task's stack.
_ID_PREFIX = f"(?i)^(?:(?:{_spelled(fixed.ID_PREFIXES)})(?: |$))++"
_ID_SUFFIX = f"(?i)(?:(?:^| )(?:{_spelled(fixed.ID_SUFFIXES)})(?= |$))++$"


def person_id_for(c: Column) -> Column:
    """Key of a person: honorifics and suffixes dropped, words joined by ``_``."""
    name = collapse_spaces(c)
    name = F.regexp_replace(name, _ID_PREFIX, "")
    name = F.regexp_replace(name, _ID_SUFFIX, "")
    name = collapse_spaces(F.regexp_replace(name, r"[^A-Za-z0-9\s]", ""))
    return F.replace(F.upper(name), F.lit(" "), F.lit("_"))


def person_key(c: Column) -> Column:
    """Key of a person as answered; honorifics stay."""
    letters = F.regexp_replace(F.upper(c), r"[^A-Z0-9\s]", "")
    return F.regexp_replace(py_strip(letters), r"\s+", "_")


def normalized_role(role: Column, category: Column) -> Column:
    category = py_strip(category)
    executive = category == "EXECUTIVE"
    return (
        F.when(executive & role.rlike(r"(?iU)\bCEO\b|Chief Executive Officer"), "CEO")
        .when(executive & role.rlike(r"(?iU)\bCFO\b|Chief Financial Officer"), "CFO")
        .when((category == "BOARD") & role.rlike("(?i)chair"), "Chairman")
        .otherwise(py_strip(role))
    )


def relationship_type(role: Column, category: Column) -> Column:
    """Edge type, or null where the category is not supported."""
    board = category == "BOARD"
    return (
        F.when(role == "CEO", "CEO_OF")
        .when(role == "CFO", "CFO_OF")
        .when(board & F.lower(role).contains("chairman"), "CHAIRMAN_OF")
        .when(board, "BOARD_OF")
        .when(category == "EXECUTIVE", "EXECUTIVE_OF")
    )


def has_relationship_type(role: Column, category: Column) -> Column:
    """Whether ``relationship_type`` gives a type, told by the category first.

    The role of a supported category is not looked at, so the test is cheap where
    the optimizer runs it early, with the patterns that make the role.
    """
    return category.isin("BOARD", "EXECUTIVE") | role.isin("CEO", "CFO")


def title_relationships(c: Column) -> Column:
    """Array of edge types a job title stands for."""
    title = F.lower(c)
    marks = any_word(fixed.EXECUTIVE_TITLE_MARKS)
    return F.array_compact(
        F.array(
            F.when(title.rlike(r"chief executive officer|(?U)\bceo\b"), "CEO_OF"),
            F.when(title.rlike(r"chief financial officer|(?U)\bcfo\b"), "CFO_OF"),
            F.when(title.rlike(marks), "EXECUTIVE_OFFICER_OF"),
        )
    )


def description_short(c: Column) -> Column:
    """At most 300 characters, cut at a sentence end where there is a late one."""
    text = collapse_spaces(c)
    late = F.regexp_extract(text, r"(?s)^(.{198,298}[.!?]) ", 1)
    early = F.regexp_extract(text, r"(?s)^(.{118,197}[.!?]) ", 1)
    head = F.regexp_replace(F.substring(text, 1, 300), r"\s+$", "")
    words = F.regexp_replace(head, r"(?s) [^ ]*$", "")
    return (
        F.when(text_or_empty(c) == "", F.lit(None).cast("string"))
        .when(F.length(text) <= 300, text)
        .when(late != "", late)
        .when(early != "", early)
        .otherwise(F.concat(F.regexp_replace(words, "[.,;:]+$", ""), F.lit("...")))
    )


def header_label(c: Column) -> Column:
    lowered = F.lower(collapse_spaces(text_or_empty(c)))
    return F.btrim(F.regexp_replace(lowered, "[^a-z0-9]+", " "))


def last_updated(c: Column) -> Column:
    found = F.regexp_extract(c, r"(?i)Last\s+updated[^<\n\r]*", 0)
    return blank_to_null(collapse_spaces(found))


def unwrap_fence(c: Column) -> Column:
    """Content of a text that is one fenced block, else the stripped text."""
    text = py_strip(c)
    lines = F.regexp_replace(text, _LINE_BREAK, "\n")
    fence = r"(?s)\A```[^\S\n]*(?i:json)?[^\S\n]*\n(.*)\n[^\S\n]*```\z"
    fenced = text.startswith("```") & lines.rlike(fence)  # the rest needs no pattern
    return F.when(fenced, py_strip(F.regexp_extract(lines, fence, 1))).otherwise(text)


def edge_id(person_id: Column, ticker: Column, kind: Column, role: Column, category: Column) -> Column:
    parts = [text_or_empty(c) for c in (person_id, ticker, kind, role, category)]
    return F.concat(F.lit("edge:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def batch_id(model: Column, tickers: Column, prefix: str = fixed.BATCH_ID_PREFIX) -> Column:
    payload = F.to_json(F.struct(model.alias("model"), tickers.alias("tickers")))
    return F.concat(F.lit(prefix), F.substring(F.sha2(payload, 256), 1, 16))


def company_node_id(ticker: Column) -> Column:
    return F.concat(F.lit("company:"), ticker)


def graph_person_id(person_id: Column) -> Column:
    return F.concat(F.lit("person:"), person_id)


def person_label(name: Column, person_id: Column) -> Column:
    return F.coalesce(blank_to_null(name), person_id)


def extract_urls(c: Column, base_url: str) -> Column:
    """URLs inside the string values of a JSON text, in order, without repeats.

    Relative spreadsheet links are resolved against ``base_url``.
    """
    literals = F.regexp_extract_all(c, F.lit(r'("[^"\\]*+(?:\\.[^"\\]*+)*+"\s*:?)'), F.lit(1))
    values = F.filter(literals, lambda s: ~s.endswith(":"))
    strings = F.from_json(
        F.concat(F.lit("["), F.array_join(values, ","), F.lit("]")), "array<string>"
    )

    def links(s: Column) -> Column:
        absolute = F.regexp_extract_all(s, F.lit(r"""(https?://[^\s"'<>]+)"""), F.lit(1))
        sheet = s.rlike(r"(?i)\.(csv|xls|xlsx)(?:\?|$)") | s.contains("fileType=")
        joined = (
            F.when(s.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), s)
            .when(s.startswith("//"), F.concat(F.lit("https:"), s))
            .when(s.startswith("/"), F.concat(F.lit(base_url), s))
            .otherwise(F.concat(F.lit(base_url + "/"), s))
        )
        return F.concat(absolute, F.array_compact(F.array(F.when(sheet, joined))))

    return F.array_distinct(F.flatten(F.transform(strings, links)))


def holdings_url(urls: Column) -> Column:
    """The first URL that looks like a holdings download, else the first."""
    likely = F.filter(urls, lambda u: u.rlike("(?i)(holdings|fund|download|csv|xls|xlsx|fileType=)"))
    return F.coalesce(F.get(likely, F.lit(0)), F.get(urls, F.lit(0)))


def padded_cik(cik: Column) -> Column:
    return F.lpad(cik, 10, "0")


def filing_url(cik: Column, accession: Column, document: Column, base_url: str) -> Column:
    number = F.regexp_replace(cik, "^0+(?=[0-9])", "")
    return F.concat(
        F.lit(base_url), number, F.lit("/"), F.replace(accession, F.lit("-"), F.lit("")), F.lit("/"), document
    )


def is_10k(form: Column) -> Column:
    return F.regexp_replace(F.upper(form), "[^A-Z0-9]", "") == "10K"


def exploded(df: DataFrame, columns: list, array: Column, pos: str, value: str) -> DataFrame:
    """One row per array element, with its place.

    An outer explode and a filter on the place: a plain explode would push
    a size test of the array, and with it the whole expression, down to the
    scan, and evaluate it once more there.
    """
    rows = df.select(*columns, F.posexplode_outer(array).alias(pos, value))
    return rows.filter(F.col(pos).isNotNull())


def match_spans(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) for every match; offsets count from 0."""
    found = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1))
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    pieces = F.zip_with(gaps, found, lambda gap, hit: F.struct(F.length(gap).alias("gap"), hit.alias("hit")))
    none = F.lit([]).cast("array<struct<start:int,end:int,text:string>>")

    def add(acc: Column, piece: Column) -> Column:
        start = acc["at"] + piece["gap"]
        end = start + F.length(piece["hit"])
        span = F.struct(start.alias("start"), end.alias("end"), piece["hit"].alias("text"))
        return F.struct(end.alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), none.alias("spans"))
    return F.aggregate(pieces, start, add, lambda acc: acc["spans"])


def char_slice(text: Column, start: Column, end: Column) -> Column:
    """Characters from offset ``start`` up to, not including, ``end``."""
    return text.substr(start + 1, F.greatest(end - start, F.lit(0)))
