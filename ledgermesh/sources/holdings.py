"""Holdings files: preambles, header search, spreadsheet XML, equity tickers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgermesh.functions import fixed_values as fixed
from ledgermesh.functions.text import any_word, collapse_spaces, exploded, header_label, normalize_ticker, py_strip
from ledgermesh.session import stage
from ledgermesh.sources.html import decode_entities

HEADER_ROWS = 20


#: A quoted part of a cell. Possessive, so that a long one does not recurse on the task's stack.
QUOTED = r'"[^"]*+(?:""[^"]*+)*+"'


def _literal(separator: str) -> str:
    if len(separator) != 1 or separator in '"\r\n':
        raise ValueError("a separator is one character, neither a quote nor a line break")
    return f"\\x{{{ord(separator):x}}}"


def csv_records(text: Column, separator: str = ",") -> Column:
    """Records of a CSV text: its lines, but a line break inside a quoted cell does not end one."""
    mark = _literal(separator)
    cell = rf"(?:{QUOTED})?+[^{mark}\r\n]*+"
    found = F.regexp_extract_all(text, F.lit(rf"({cell}(?:{mark}{cell})*+)(?:\r\n|[\r\n]|\z)"), F.lit(1))
    ended = text.rlike(r"[\r\n]\z") | (text == "")
    return F.when(ended, found).otherwise(F.slice(found, 1, F.size(found) - 1))  # the empty match behind the last record


def text_lines(spark: SparkSession, path: str, separator: str = ",") -> DataFrame:
    """Records of delimited text files with their place in the file: (file, idx, line).

    A file is one row here; quotes cannot be followed across splits of a file.
    """
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), "value")
    text = F.regexp_replace("value", "^\\x{feff}", "")
    return files.select("file", F.posexplode(csv_records(text, separator)).alias("idx", "line"))


def csv_cells(line: Column, separator: str = ",") -> Column:
    """Cells of one record; quotes may hold separators, line breaks and doubled quotes."""
    mark = _literal(separator)
    whole = F.regexp_extract_all(
        F.concat(F.lit(separator), line), F.lit(rf"{mark}((?:{QUOTED})?+[^{mark}]*+)"), F.lit(1)
    )
    quoted = f"(?s)^({QUOTED})(.*)$"

    def bare(cell: Column) -> Column:
        inner = F.regexp_replace(F.regexp_extract(cell, quoted, 1), '^"|"$', "")
        return F.when(
            cell.rlike(quoted), F.concat(F.replace(inner, F.lit('""'), F.lit('"')), F.regexp_extract(cell, quoted, 2))
        ).otherwise(cell)

    return F.transform(whole, bare)


def read_preamble_csv(lines: DataFrame, column: str, separator: str = ",") -> DataFrame:
    """Cells from the first line with the wanted column on; all lines if none has it."""
    cells = lines.filter(py_strip(F.col("line")) != "").select(
        "file", "idx", csv_cells(F.col("line"), separator).alias("cells")
    )
    named = F.exists("cells", lambda c: F.lower(py_strip(c)) == column.lower())
    starts = cells.filter(named).groupBy("file").agg(F.min("idx").alias("start"))
    joined = cells.join(starts, "file", "left").filter("start is null or idx >= start")
    return joined.select("file", "idx", "cells")


def promote_header(
    rows: DataFrame, labels: list[str], file: str = "file", idx: str = "idx", header_rows: int | None = HEADER_ROWS
) -> DataFrame:
    """Rows after the best header among the first ``header_rows`` (20; None: all rows), with that header.

    The best header has the most accepted labels; the first one wins a tie.
    All-empty rows are dropped. Columns: (file, idx, header, header_idx, cells).
    Headers are as many as files, and sizes that Spark estimates from compressed
    input are far too small for them, so the join is kept from sending them to every task.
    """
    wanted = F.array(*[F.lit(label) for label in labels])
    score = F.size(F.array_intersect(wanted, F.transform("cells", header_label)))
    first = rows if header_rows is None else rows.filter(F.col(idx) < header_rows)
    tried = first.withColumn("_score", score).filter("_score > 0")
    best = tried.groupBy(file).agg(
        F.max_by(F.struct(F.col(idx).alias("at"), F.col("cells").alias("names")), F.struct("_score", -F.col(idx))).alias("_best")
    )
    header = best.select(
        file, F.col("_best.at").alias("header_idx"), F.transform("_best.names", collapse_spaces).alias("header")
    )
    filled = F.exists("cells", lambda c: py_strip(F.coalesce(c, F.lit(""))) != "")
    return rows.join(header.hint("merge"), file).filter((F.col(idx) > F.col("header_idx")) & filled).select(
        file, idx, "header_idx", "header", "cells"
    )


def holdings_tickers(
    rows: DataFrame, labels: list[str], preferred: list[str], file: str = "file", idx: str = "idx"
) -> DataFrame:
    """Distinct equity tickers per file; the ticker column follows the preference."""
    data = promote_header(rows, labels, file, idx)
    names = F.transform("header", header_label)
    places = [F.nullif(F.array_position("_names", label), F.lit(0).cast("long")) for label in preferred]
    asset_at = F.array_position(F.transform("header", lambda h: F.lower(py_strip(h))), "asset class")
    placed = data.withColumn("_names", names).select(
        file, "cells", (F.coalesce(*places) - 1).cast("int").alias("_ticker_at"), (asset_at - 1).cast("int").alias("_asset_at")
    )
    asset = F.lower(py_strip(F.coalesce(F.get("cells", F.col("_asset_at")), F.lit(""))))
    text = F.lower(F.array_join(F.transform("cells", lambda c: py_strip(F.coalesce(c, F.lit("")))), " "))
    equity = ((asset == "") | asset.isin(fixed.EQUITY_ASSET_CLASSES)) & ~text.rlike(any_word(fixed.EXCLUDED_HOLDING_TERMS))
    chosen = placed.filter(equity & F.col("_ticker_at").isNotNull())
    return chosen.select(file, normalize_ticker(F.get("cells", F.col("_ticker_at"))).alias("ticker")).filter(
        "ticker <> ''"
    ).distinct()


def require_tickers(tickers: DataFrame) -> DataFrame:
    """The tickers; an empty set is an error."""
    if tickers.isEmpty():
        raise ValueError("no equity tickers found")
    return tickers


def sanitize_xml(c: Column) -> Column:
    """XML text without control characters and with bare ampersands escaped."""
    clean = F.regexp_replace(c, r"[\x00-\x08\x0B\x0C\x0E-\x1F]", "")
    return F.regexp_replace(clean, "&(?!#[0-9]+;|#x[0-9A-Fa-f]+;|[A-Za-z_:][A-Za-z0-9_.:-]*;)", "&amp;")


def read_sheet_rows(df: DataFrame, file: str = "file", xml: str = "xml") -> DataFrame:
    """Rows of the holdings sheet of spreadsheet XML: (file, idx, cells).

    The sheet named "holdings" is taken, else the first with a ticker header.
    A cell index leaves blank cells before it; short rows are padded. Rows are written once,
    as they are read twice: to find the sheet, and to return its rows.
    """
    sheet = r"(?s)<(?:\w+:)?Worksheet\b.*?(?:</(?:\w+:)?Worksheet>|\z)"
    row = r"(?s)(<(?:\w+:)?Row\b(?:[^>]*/>|.*?</(?:\w+:)?Row>))"
    cell = r"(?s)(<(?:\w+:)?Cell\b(?:[^>]*/>|.*?</(?:\w+:)?Cell>))"
    found = F.regexp_extract_all(sanitize_xml(F.col(xml)), F.lit(f"({sheet})"), F.lit(1))
    sheets = exploded(df, [file], found, "sheet_no", "_sheet")
    named = sheets.withColumn("_name", F.lower(decode_entities(F.regexp_extract("_sheet", r'^<[^>]*?:Name="([^"]*)"', 1))))

    def add(acc: Column, markup: Column) -> Column:
        index = F.regexp_extract(markup, r'^<[^>]*?:Index="([0-9]+)"', 1).try_cast("int")
        gap = F.greatest(F.coalesce(index - 1 - F.size(acc), F.lit(0)), F.lit(0))
        value = py_strip(decode_entities(F.regexp_replace(markup, "(?s)<[^>]*>", "")))
        return F.concat(acc, F.array_repeat(F.lit(""), gap), F.array(value))

    markup = F.regexp_extract_all("_sheet", F.lit(row), F.lit(1))
    rows = exploded(named, [file, "sheet_no", "_name"], markup, "idx", "_row").withColumn(
        "cells", F.aggregate(F.regexp_extract_all("_row", F.lit(cell), F.lit(1)), F.array().cast("array<string>"), add)
    )
    rows = stage(rows.select(file, "sheet_no", "_name", "idx", "cells"), "sheet-rows")
    has_ticker = F.exists("cells", lambda c: header_label(c) == "ticker") & (F.col("idx") < HEADER_ROWS)
    sheets_found = rows.groupBy(file, "sheet_no", "_name").agg(
        F.max(F.size("cells")).alias("width"), F.max(has_ticker).alias("has_ticker")
    )
    usable = sheets_found.filter("_name = 'holdings' or has_ticker")
    best = usable.groupBy(file).agg(
        F.min(F.struct((F.col("_name") != "holdings").alias("other"), "sheet_no", "width")).alias("_best")
    ).select(file, F.col("_best.sheet_no").alias("sheet_no"), F.col("_best.width").alias("width"))
    padded = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    return rows.join(best, [file, "sheet_no"]).select(file, "idx", padded.alias("cells"))


def latest_available(arrivals: DataFrame, today: Column, days: int = 8) -> DataFrame:
    """Latest trade date with an arrival among the last ``days`` calendar days."""
    near = F.col("trade_date").between(F.date_sub(today, days - 1), today)
    return arrivals.filter(near).agg(F.max("trade_date").alias("trade_date"))
