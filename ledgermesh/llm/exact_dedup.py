"""Exact dedup by content-defined chunk recipes, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import BLANK, stage, text_of

#: A chunk ends at the first punctuation mark before a space once it has ``least`` characters,
#: and at ``most`` characters where the text offers no such place.
CHUNK = r"(?s).{{{least},{most}}}?(?:\p{{P}}(?= )|\z)|(?s).{{1,{most}}}"


def normalised(name: str = "text") -> Column:
    return F.regexp_replace(text_of(name), BLANK, " ")


def chunks(text: Column, least: int = 512, most: int = 4096) -> Column:
    """Content-defined pieces of a text, in order; together they are the text."""
    return F.regexp_extract_all(text, F.lit(CHUNK.format(least=least, most=most)), F.lit(0))


def identifier(chunk: Column, bits: int = 64) -> Column:
    return F.xxhash64(chunk) if bits == 64 else F.xxhash64(chunk).bitwiseAND(F.lit((1 << bits) - 1))


def unverified(texts: DataFrame, column: str, bits: int = 64) -> DataFrame:
    """Identifiers that stand for more than one chunk text: (chunk_id).

    Every distinct chunk moves once, after the copies within a task are folded; its
    smallest and largest text under one identifier are compared byte by byte.
    """
    piece = texts.select(F.explode(chunks(F.col(column))).alias("chunk"))
    held = piece.groupBy(identifier(F.col("chunk"), bits).alias("chunk_id")).agg(
        F.min("chunk").alias("low"), F.max("chunk").alias("high")
    )
    return held.filter("low <> high").select("chunk_id")


def groups_of_equal_texts(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per input row: (doc_id, keep_id, group_size, kept, text_sha256).

    Texts are equal when identical after each run of white space became one space; a null
    text is empty, and empty texts are equal to each other. A document's recipe is the
    ordered list of its chunks' identifiers. An identifier is verified by comparing all
    chunk texts that carry it; should two texts share one, which 64 bits make a rare event
    (``bits`` shortens them for tests), these chunks stand in the recipes by their full
    text instead. Groups are rows with equal recipes. The row with the smallest doc_id
    stays; rows without doc_id stay only where no row of the group has one. Repeated rows
    (same doc_id, same text) get the same answer each. Other columns are ignored.

    Recipes (8 bytes per chunk) are what is grouped and joined; long documents move only
    as distinct chunks. A group with a third of all rows is folded before the shuffle; the
    groups are written, so that adaptive execution can split the join back to their rows.
    """
    texts = docs.select("doc_id", normalised().alias("norm"))
    clashes = [r.chunk_id for r in unverified(texts, "norm", bits).collect()]  # none, or n * n / 2^65 of them

    def name(chunk: Column) -> Column:
        if not clashes:
            return identifier(chunk, bits)
        code = identifier(chunk, bits)
        return F.when(code.isin(clashes), F.concat(F.lit("="), chunk)).otherwise(code.cast("string"))

    recipes = stage(
        texts.select(
            "doc_id", F.sha2(F.col("norm"), 256).alias("text_sha256"), F.transform(chunks(F.col("norm")), name).alias("recipe")
        ),
        "recipes",
    )
    groups = recipes.groupBy("recipe").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    repeated = stage(groups.filter("group_size > 1"), "recipe-groups")
    joined = recipes.join(repeated, "recipe", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return joined.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256",
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns; of repeated rows, one."""
    kept = groups_of_equal_texts(docs).filter("kept").select(
        F.col("doc_id").alias("_keep_id"), F.col("text_sha256").alias("_keep_sha")
    ).distinct()
    marked = docs.withColumn("_sha", F.sha2(normalised(), 256))
    rows = marked.join(
        kept, F.col("doc_id").eqNullSafe(F.col("_keep_id")) & (F.col("_sha") == F.col("_keep_sha")), "left_semi"
    )
    return rows.dropDuplicates(["doc_id", "_sha"]).select(*docs.columns)
