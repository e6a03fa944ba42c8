"""HTML documents to text, tables and rows, as column expressions and explodes."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from html.entities import name2codepoint

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ledgermesh.functions.text import clean_text, exploded, header_label, normalize_ticker
from ledgermesh.session import stage

HIDDEN = r"(?is)<!--.*?-->|<(script|style)\b.*?</\1\s*>|<!doctype[^>]*>"
#: A tag; a quoted attribute value may hold ">".
TAG = r"""(?s)<(?:[a-zA-Z/!?](?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*>)"""
#: Named entities by the code point they stand for, the standard set of Python's library.
ENTITIES = {name: chr(code) for name, code in sorted(name2codepoint.items())} | {"apos": "'", "nbsp": " "}
_REST_OF_TAG = r"""\b(?:(?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+>)"""


def decode_entities(c: Column) -> Column:
    """Named and numeric entities as characters; unknown names and codes beyond Unicode stay as they are."""
    named = F.create_map(*[F.lit(part) for entity in ENTITIES.items() for part in entity])

    def decode(piece: Column) -> Column:
        digits = F.regexp_extract(piece, r"^&#0*+([0-9]{1,7});", 1)
        hexed = F.regexp_extract(piece, r"(?i)^&#x0*+([0-9a-f]{1,6});", 1)
        number = F.when(digits != "", digits.try_cast("int")).when(hexed != "", F.conv(hexed, 16, 10).try_cast("int"))
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        code = F.when(valid, F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        char = F.coalesce(code, F.try_element_at(named, F.regexp_extract(piece, "^&([A-Za-z][A-Za-z0-9]*+);", 1)))
        return F.coalesce(F.concat(char, F.regexp_replace(piece, "^&[^;]*;", "")), piece)

    return F.when(c.contains("&"), F.array_join(F.transform(F.split(c, "(?=&)"), decode), "")).otherwise(c)


def html_text(c: Column) -> Column:
    """Visible text with single blanks between the pieces."""
    return clean_text(decode_entities(F.regexp_replace(F.regexp_replace(c, HIDDEN, " "), TAG, " ")))


def cell_text(cell: Column) -> Column:
    return clean_text(decode_entities(F.regexp_replace(cell, TAG, " ")))


def cell_lines(cell: Column) -> Column:
    """Non-empty lines of a cell; every tag ends a line."""
    text = decode_entities(F.regexp_replace(cell, TAG, "\n"))
    return F.filter(F.transform(F.split(text, r"\r\n|[\r\n]"), clean_text), lambda line: line != "")


#: An opening tag as a whole, and the level that a tag carries in levelled markup.
_WHOLE_TAG = re.compile(r"<[^#>]*#\d+" + _REST_OF_TAG, re.ASCII)
_STRUCTURE_TAG = re.compile(r"(</?)(table|tr|t[hd])\b", re.ASCII | re.IGNORECASE)
_TABLE_END = re.compile(r"</table#\d+\s*>", re.ASCII | re.IGNORECASE)
TABLE = StructType([
    StructField("start", IntegerType()), StructField("markup", StringType()), StructField("rows", ArrayType(ArrayType(StringType()))),
])
_TABLE_ARROW = pa.struct([("start", pa.int32()), ("markup", pa.string()), ("rows", pa.list_(pa.list_(pa.string())))])


def _levelled(visible: str) -> tuple[str, list[tuple[int, str, bool, int]]]:
    """Markup whose table, row and cell tags tell how many tables they are in, and these tags: (place, kind, closing, level)."""
    parts, tags, level, at, size = [], [], 0, 0, 0
    for found in _STRUCTURE_TAG.finditer(visible):
        closing, kind = found[1] == "</", found[2].lower()[:2]
        if kind == "ta":
            level = max(level + (-1 if closing else 1), 0)
        own = level + (kind == "ta" and closing)
        before, mark = visible[at : found.end()], f"#{own}"
        tags.append((size + len(before) - len(found[0]), kind, closing, own))
        parts += [before, mark]
        size += len(before) + len(mark)
        at = found.end()
    return "".join([*parts, visible[at:]]), tags


def _tables(markup: str, tags: list[tuple[int, str, bool, int]]) -> list[dict]:
    """Every table with the cells of its rows, in one pass over the tags with the elements that are open at each level.

    A table ends at its own closing tag. A row or cell ends at the next tag of a row (or
    cell) of its own level, and with its table. Rows of nested tables are rows of the outer
    one too, and so are cells: what is returned grows with the depth of nesting, as asked,
    while the tags are read once.
    """
    whole: dict[str, list[list[int]]] = {"ta": [], "tr": [], "tc": []}
    open_: dict[tuple[str, int], list[int]] = {}

    def end(kind: str, level: int, at: int) -> None:
        element = open_.pop((kind, level), None)
        if element:
            element[1] = at

    for at, tag, closing, level in tags:
        kind = "tc" if tag in ("td", "th") else tag
        if kind == "ta" and closing:
            ended = _TABLE_END.match(markup, at)
            if ended:
                end("ta", level, ended.end())
        if kind != "ta" or closing:
            end("tc", level, at)
            if kind != "tc":
                end("tr", level, at)
        if not closing and (kind, level) not in open_:
            open_[kind, level] = element = [at, len(markup)]
            whole[kind].append(element)
    row_starts, cell_starts = ([e[0] for e in whole[k]] for k in ("tr", "tc"))

    def inside(elements: list[list[int]], starts: list[int], low: int, high: int) -> Iterator[tuple[int, int]]:
        """Content of the elements that begin between two places; a tag that is cut off begins none."""
        for start, stop in elements[bisect_left(starts, low) : bisect_left(starts, high)]:
            stop = min(stop, high)
            tag = _WHOLE_TAG.match(markup, start, stop)
            if tag:
                yield tag.end(), stop

    return [
        {"start": start, "markup": markup[start:stop], "rows": [
            [markup[a:b] for a, b in inside(whole["tc"], cell_starts, low, high)]
            for low, high in inside(whole["tr"], row_starts, start, stop)
        ]}
        for start, stop in whole["ta"]
    ]


def _visible(html: Column) -> Column:
    return F.regexp_replace(html, HIDDEN, " ")


@F.arrow_udf(StringType())
def _marked(visible: pa.Array) -> pa.Array:
    return pa.array([None if v is None else _levelled(v)[0] if "<table" in v.lower() else v for v in visible.to_pylist()], pa.string())


def with_levels(html: Column) -> Column:
    """Visible markup whose table, row and cell tags tell how many tables they are in, as in ``<tr#2>``.

    With the level in the tag, an element ends at its own closing tag, whatever it holds.
    """
    return _marked(_visible(html))


def with_tables(df: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """One row per document: (doc, visible, tables), visible as by ``with_levels``.

    ``tables`` has (start, markup, rows) of every table, nested ones after the table they
    are in; rows hold the markup of their cells. The nesting of tags needs a stack, which
    no built-in expression has, so the tags are read once in Arrow batches; what the cells
    say is worked out by column expressions.
    """
    schema = StructType([StructField(doc, df.schema[doc].dataType), StructField("visible", StringType()), StructField("tables", ArrayType(TABLE))])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                texts, tables = [], []
                for visible in some.column(1).to_pylist():
                    visible = visible or ""
                    markup, tags = _levelled(visible) if "<table" in visible.lower() else (visible, [])
                    texts.append(markup)
                    tables.append(_tables(markup, tags))
                columns = [some.column(0), pa.array(texts, pa.string()), pa.array(tables, pa.list_(_TABLE_ARROW))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(doc, _visible(F.col(html)).alias("visible")).mapInArrow(read, schema)


def html_tables(df: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """One row per table: (doc, table_no, start, markup, rows); comments are dropped."""
    spans = exploded(with_tables(df, doc, html), [doc], F.col("tables"), "table_no", "_table")
    return spans.select(doc, "table_no", *[F.col(f"_table.{f}").alias(f) for f in TABLE.names])


def text_cells(row: Column) -> Column:
    """Cleaned, non-empty cells of a row."""
    return F.filter(F.transform(row, cell_text), lambda c: c != "")


def line_cells(row: Column) -> Column:
    """Cells of a row as arrays of lines, empty cells left out."""
    return F.filter(F.transform(row, cell_lines), lambda c: F.size(c) > 0)


def _rows(tables: DataFrame, doc: str) -> DataFrame:
    return exploded(tables, [doc, "table_no"], F.col("rows"), "row_no", "_row")


def _filled(rows: DataFrame, doc: str, cells: Column) -> DataFrame:
    """Rows with at least one cell."""
    kept = F.array_compact(F.array(F.when(F.size(cells) > 0, cells)))
    return exploded(rows, [doc, "table_no", "row_no"], kept, "_pos", "cells").drop("_pos")


def table_rows(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows of cleaned, non-empty cells; rows without any are left out."""
    return _filled(_rows(tables, doc), doc, text_cells(F.col("_row")))


def html_table_rows(df: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    return table_rows(html_tables(df, doc, html), doc)


def table_cell_lines(tables: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Rows whose cells are arrays of lines; empty cells and rows are left out."""
    return _filled(_rows(tables, doc), doc, line_cells(F.col("_row")))


def html_table_cell_lines(df: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    return table_cell_lines(html_tables(df, doc, html), doc)


def all_table_rows(df: DataFrame, doc: str = "doc_id", html: str = "html") -> DataFrame:
    """Rows with every cell in place, empty ones included."""
    return _rows(html_tables(df, doc, html), doc).select(doc, "table_no", "row_no", F.transform("_row", cell_text).alias("cells"))


def constituents_from_html(
    df: DataFrame, label: str = "symbol", also: list[str] | None = None, doc: str = "doc_id", html: str = "html"
) -> DataFrame:
    """Tickers of the first table whose first row has the wanted headers.

    A table without any ticker does not count; the next one is taken. Rows and tickers are
    written once each, as both are read twice and parsing the tables is the costly part.
    """
    rows = stage(all_table_rows(df, doc, html), "table-rows")
    headers = rows.filter("row_no = 0").select(doc, "table_no", F.transform("cells", header_label).alias("labels"))
    wanted = [label, *(also or [])]
    fits = headers.filter(F.size(F.array_intersect("labels", F.array(*[F.lit(w) for w in wanted]))) == len(wanted))
    placed = fits.select(doc, "table_no", (F.array_position("labels", label) - 1).cast("int").alias("at"))
    cells = rows.filter("row_no > 0").join(placed, [doc, "table_no"])
    tickers = cells.select(doc, "table_no", normalize_ticker(F.get("cells", F.col("at"))).alias("ticker")).filter("ticker <> ''")
    tickers = stage(tickers, "table-tickers")
    first = tickers.groupBy(doc).agg(F.min("table_no").alias("table_no"))
    return tickers.join(first, [doc, "table_no"], "left_semi").select(doc, "ticker").distinct()
