"""Quality rules: base counts of a text, and tokeniser fertility against bands per language or script."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import WORD, batches_of_rows, stage, text_of
from ledgermesh.llm.tokens import encoder

MEASURES = (
    "doc_id long, lang string, script string, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
    "n_repeat_words long, chars_per_token double, chars_per_token_bytes double, byte_share double, token_entropy double"
)
MEASURES_ARROW = pa.schema([
    ("doc_id", pa.int64()), ("lang", pa.string()), ("script", pa.string()), ("n_words", pa.int64()), ("word_chars", pa.int64()),
    ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("chars_per_token", pa.float64()),
    ("chars_per_token_bytes", pa.float64()), ("byte_share", pa.float64()), ("token_entropy", pa.float64()),
])
BANDED = ("chars_per_token", "chars_per_token_bytes", "byte_share", "token_entropy")
_WORD, _SYMBOL = re.compile(WORD), re.compile(r"[#*$%&|<>]")
_KEPT, _LONGEST = 300_000, 256


class _Vocabulary:
    """Piece ids of single words by a sentencepiece vocabulary with byte fallback, remembered per worker."""

    def __init__(self, pieces: str, byte_level: str) -> None:
        import sentencepiece

        self.pieces = sentencepiece.SentencePieceProcessor(model_file=pieces)
        n = self.pieces.get_piece_size()
        self.is_byte = np.fromiter((self.pieces.is_byte(i) or self.pieces.is_unknown(i) for i in range(n)), bool, n)
        self.byte_level = encoder(byte_level)
        self.known: dict[str, tuple[bytes, int]] = {}

    def words(self, words: list[str]) -> dict[str, tuple[bytes, int]]:
        """Word to (its piece ids, its number of byte-level tokens)."""
        if len(self.known) > _KEPT:
            self.known.clear()
        fresh = [w for w in dict.fromkeys(words) if w not in self.known]
        found = self.known
        for at in range(0, len(fresh), 8192):
            some = fresh[at : at + 8192]
            ids = self.pieces.encode(some, num_threads=1)
            others = self.byte_level.library.encode_batch_fast([" " + w for w in some], add_special_tokens=False)
            for w, i, o in zip(some, ids, others, strict=True):
                found[w] = (np.array(i, "<u4").tobytes(), len(o.ids))
        self.long = [w for w in fresh if len(w) > _LONGEST]
        return found

    def forget_long(self) -> None:
        for w in self.long:
            self.known.pop(w, None)


@lru_cache(maxsize=2)
def _vocabulary(pieces: str, byte_level: str) -> _Vocabulary:
    return _Vocabulary(pieces, byte_level)


@lru_cache(maxsize=65536)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "NONE").split(" ")[0].split("-")[0]


@lru_cache(maxsize=1)
def _script_numbers() -> tuple[np.ndarray, list[str]]:
    """Number of the script of every code point (0: not known yet, 1: no letter), and the names by number, both filled as they are met."""
    return np.zeros(0x110000, np.uint16), ["", ""]


def main_script(text: str) -> str:
    """The script of most letters of the text, the first by name of equals; NONE without letters."""
    if text.isascii():
        return "LATIN" if any(map(str.isalpha, text)) else "NONE"
    numbers, names = _script_numbers()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    own = numbers[codes]
    if not own.all():
        for code in np.unique(codes[own == 0]).tolist():
            name = _script(chr(code)) if chr(code).isalpha() else ""
            if name and name not in names:
                names.append(name)
            numbers[code] = names.index(name, 2) if name else 1
        own = numbers[codes]
    counts = np.bincount(own, minlength=3)[2:]
    most = counts.max()
    return min(names[k + 2] for k in np.flatnonzero(counts == most).tolist()) if most else "NONE"


def repeat_words(words: list[str]) -> int:
    """Words inside 3-word windows that occur twice or more in the text."""
    n = len(words)
    if n < 4:
        return 0
    code: dict[str, int] = {}
    ids = np.fromiter((code.setdefault(w, len(code)) for w in words), np.int64, n)
    two = np.unique(ids[:-1] * len(code) + ids[1:], return_inverse=True)[1].astype(np.int64)
    three = np.unique(two[:-1] * len(code) + ids[2:], return_inverse=True)[1]
    often = np.bincount(three)[three] > 1
    covered = np.zeros(n, bool)
    for k in range(3):
        covered[k : n - 2 + k] |= often
    return int(covered.sum())


def duplicate_lines(text: str) -> int:
    """Lines that hold a word and equal an earlier line."""
    seen: set[str] = set()
    n = 0
    for line in text.split("\n"):
        if line in seen:
            n += 1
        elif _WORD.search(line):
            seen.add(line)
    return n


def _measures(doc: int | None, lang: str | None, text: str, words: list[str], known: dict[str, tuple[bytes, int]], is_byte) -> tuple:
    parts = [known[w] for w in words]
    ids = np.frombuffer(b"".join([p[0] for p in parts]), "<u4")
    chars, tokens = sum(map(len, words)), max(1, len(ids))
    counts = np.bincount(ids) if len(ids) else np.zeros(1, np.int64)
    p = counts[counts > 0] / tokens
    spread = float(-(p * np.log2(p)).sum()) / float(np.log2(tokens)) if tokens > 1 else 0.0
    return (
        doc, lang, main_script(text), len(words), chars, len(_SYMBOL.findall(text)), duplicate_lines(text),
        repeat_words(words), chars / tokens, chars / max(1, sum(p[1] for p in parts)),
        float(is_byte[ids].sum()) / tokens if len(ids) else 0.0, spread,
    )


def measure(docs: DataFrame, pieces: str, byte_level: str) -> DataFrame:
    """Base counts and fertility of every whole text, one row per input row.

    ``pieces`` is a sentencepiece vocabulary with byte fallback, ``byte_level`` a byte-level
    one. Words are encoded one by one. chars_per_token is code points of words per piece
    (``_bytes``: per byte-level token), byte_share the share of pieces that are single bytes
    or unknown, token_entropy the entropy of the pieces over its largest value for so many.
    script is that of most letters of the whole text. A null text has no words; without
    words all measures are 0.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _vocabulary(pieces, byte_level)

        def each() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, 512):
                    ids, langs, texts = (c.to_pylist() for c in batch.slice(at, 512).columns)
                    words = [_WORD.findall(t) for t in texts]
                    known = vocabulary.words([w for own in words for w in own])
                    for d, lang, t, w in zip(ids, langs, texts, words, strict=True):
                        yield _measures(d, lang, t, w, known, vocabulary.is_byte)
                    vocabulary.forget_long()

        yield from batches_of_rows(each(), MEASURES_ARROW)

    return docs.select("doc_id", F.col("lang"), text_of().alias("text")).mapInArrow(rows, MEASURES)


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: How many quartile distances beyond the quartiles a measure may lie.
FENCES = {"chars_per_token": 4.0, "chars_per_token_bytes": 4.0, "byte_share": 4.0, "token_entropy": 1.6}


#: The sets of documents a band may come from, nearest first: whose documents, and how many length classes to either side (None: all).
REACH = (
    ("band", 0), ("band", 1), ("band", 2), ("band", None), ("script", 1), ("script", 2), ("script", None),
    ("corpus", 1), ("corpus", 2), ("corpus", None),
)
CELL = ("band", "script", "length_class")


def _sets(reached: bool) -> Column:
    """One row per set of documents a cell may take its band from, or (``reached``) that its own documents belong to."""
    names = {"band": F.col("band"), "script": F.col("script"), "corpus": F.lit("")}
    out = []
    for rank, (kind, wide) in enumerate(REACH):
        places = [F.lit(-1)] if wide is None else [F.col("length_class") + k for k in (range(-wide, wide + 1) if reached else (0,))]
        out += [F.struct(F.lit(rank).alias("rank"), names[kind].alias("name"), p.cast("int").alias("place")) for p in places]
    return F.explode(F.array(*out)).alias("of")


def bands(
    measured: DataFrame, fences: dict[str, float] | None = None, least_spread: float = 0.04, least_documents: int = 20
) -> DataFrame:
    """Lowest and highest value kept of each measure, per cell: language (or script), script and length class.

    The band is the quartiles widened by a measure's number of ``fences`` times their
    distance, which counts as ``least_spread`` of the median (of a half, if that is more)
    at least. Token entropy falls as texts grow, so bands are taken per power of two of
    characters in words. Quartiles are taken over all documents that pass the base rules;
    they are sketches that merge, so a language with most of the documents is no bottleneck.

    The quartiles of a few documents span them all. So they come from the first of these
    with ``least_documents`` documents that pass the base rules: the language's length class,
    with one and with two classes to either side, the whole language; the same of all
    documents of the script, then of the corpus. A corpus with fewer is one set as it is.
    """
    cells = stage(measured.groupBy(*CELL).agg(F.count_if(~base_failed()).alias("n")), "band-cells")
    reached = cells.select(*CELL, "n", _sets(True))
    sizes = reached.groupBy("of").agg(F.sum("n").alias("size"))
    enough = (F.col("size") >= least_documents) | (F.col("of.rank") == len(REACH) - 1)
    wanted = stage(cells.select(*CELL, _sets(False)).join(sizes, "of").filter(enough).groupBy(*CELL).agg(F.min("of").alias("of")), "band-sets")
    members = stage(reached.drop("n").join(wanted.select("of").distinct(), "of", "left_semi"), "band-members")
    held = measured.filter(~base_failed()).join(members, [*CELL]).groupBy("of").agg(
        *[F.percentile_approx(m, [0.25, 0.5, 0.75], 10_000).alias(m) for m in BANDED]
    )
    out = [F.col(c).alias(f"of_{c}") for c in CELL]
    for m, fence in (fences or FENCES).items():
        wide = fence * F.greatest(F.col(m)[2] - F.col(m)[0], least_spread * F.greatest(F.col(m)[1], F.lit(0.5)))
        out += [(F.col(m)[0] - wide).alias(f"low_{m}"), (F.col(m)[2] + wide).alias(f"high_{m}")]
    return wanted.join(held, "of", "left").select(*out)


def judge(docs: DataFrame, pieces: str, byte_level: str, **settings) -> DataFrame:
    """One row per input row: the measures, base_failed, failed_measure and kept.

    A document is kept if it passes the base rules and every measure lies in the band of
    its language (its script where lang is null) and length class, which ``bands`` takes from
    more documents where these are few. ``failed_measure`` names the first measure outside. Null texts fail the base rules. Repeated rows are judged alike; an empty table
    gives no rows. Other columns are ignored.
    """
    key = F.coalesce(F.concat(F.lit("lang "), F.col("lang")), F.concat(F.lit("script "), F.col("script")))
    length = F.floor(F.log2(F.greatest(F.col("word_chars"), F.lit(1)))).cast("int")
    measured = stage(measure(docs, pieces, byte_level).withColumn("band", key).withColumn("length_class", length), "fertility")
    limits = stage(bands(measured, **settings), "bands")
    own = measured.join(limits, [F.col(c) == F.col(f"of_{c}") for c in CELL], "left")
    outside = [
        F.when((F.col(m) < F.col(f"low_{m}")) | (F.col(m) > F.col(f"high_{m}")), F.lit(m)) for m in BANDED
    ]
    judged = own.withColumn("base_failed", base_failed()).withColumn("failed_measure", F.coalesce(*outside))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_measure").isNull()).drop(*[f"of_{c}" for c in CELL])
