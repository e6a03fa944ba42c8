"""Toxicity by a weighted lexicon matched with an Aho-Corasick automaton over folded text."""

from __future__ import annotations

import math
import unicodedata
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, text_of

# Letters of other scripts that look like Latin ones, and digits and signs written for letters.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "е": "e", "н": "h", "і": "i", "ј": "j", "к": "k", "м": "m", "о": "o", "р": "p", "ѕ": "s",
    "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ſ": "s",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
INVISIBLE = "­​‌‍⁠﻿"


def _table() -> dict[int, str | None]:
    table: dict[int, str | None] = {c: " " for c in range(128) if not chr(c).isalnum()}
    table |= {c: " " for c in (*range(0x2010, 0x2028), 0x2030, 0x2039, 0x203A, 0xA1, 0xAB, 0xB7, 0xBB, 0xBF, 0xA0, 0x2026)}
    table |= {ord(k): v for k, v in (HOMOGLYPHS | SUBSTITUTES).items()}
    return table | {ord(c): None for c in INVISIBLE}


_FOLD = _table()


def fold(text: str) -> str:
    """Lower case, compatibility forms composed, look-alikes and digit substitutions read as letters, one space at both ends."""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    return f" {text.lower().translate(_FOLD)} "


def terms_of(folded: str, shortest: int, longest: int) -> set[str]:
    """Whole words (space on both sides) and beginnings of words (space in front)."""
    words = set(folded.split())
    found = {f" {w} " for w in words if len(w) >= 3}
    for n in range(shortest, longest + 1):
        found.update(f" {w[:n]}" for w in words if len(w) > n)
    return found


@dataclass(frozen=True)
class Lexicon:
    """Weighted terms, phrases that excuse the terms in them, and the weights that turn matches into a score."""

    terms: tuple[tuple[str, float], ...]
    exceptions: tuple[str, ...] = ()
    coefficients: tuple[float, ...] = field(default=(-2.0, 0.0, 0.0, 0.0))


@lru_cache(maxsize=4)
def _automaton(lexicon: Lexicon):
    import ahocorasick

    automaton = ahocorasick.Automaton()
    for term, weight in lexicon.terms:
        automaton.add_word(term, (len(term), weight, term))
    for phrase in lexicon.exceptions:
        automaton.add_word(phrase, (len(phrase), 0.0, ""))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def matches(lexicon: Lexicon, folded: str) -> list[tuple[int, int, float, str]]:
    """(start, end, weight, term) of terms outside exception phrases; of terms at one place, the heaviest."""
    automaton = _automaton(lexicon)
    if not len(automaton):
        return []
    at: dict[int, tuple[int, int, float, str]] = {}
    excused: list[tuple[int, int]] = []
    for end, (n, weight, term) in automaton.iter(folded):
        start = end - n + 1
        if not term:
            excused.append((start, end))
        elif start not in at or weight > at[start][2]:
            at[start] = (start, end, weight, term)
    found = list(at.values())
    if excused:  # the farthest end of the phrases that begin up to a match tells whether one of them holds it
        excused.sort()
        starts, ends = [s for s, _ in excused], list(accumulate((e for _, e in excused), max))
        found = [m for m in found if not (k := bisect_right(starts, m[0])) or ends[k - 1] < m[1]]
    return found


def features(lexicon: Lexicon, text: str) -> tuple[float, float, float]:
    """Total weight, weight per hundred words, and number of different terms, the first two on a log scale."""
    folded = fold(text)
    found = matches(lexicon, folded)
    total = sum(m[2] for m in found)
    words = max(1, folded.count(" ") - 1)
    return math.log1p(total), math.log1p(100 * total / words), float(len({m[3] for m in found}))


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 50) -> np.ndarray:
    """Weights of a ridge logistic regression by Newton's method; x has a leading column of ones."""
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(x.shape[1])
    keep[0, 0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def held_out(doc_id: Column | str = "doc_id") -> Column:
    """Rows that no label is learned from; a row without doc_id is not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def learn(
    docs: DataFrame, labels: DataFrame, max_labelled: int = 20_000, max_terms: int = 2_000, min_toxic: int = 4,
    min_z: float = 3.2, shortest: int = 4, longest: int = 8, exceptions: tuple[str, ...] = (),
) -> Lexicon:
    """Learns a lexicon from labelled rows that are not held out.

    At most ``max_labelled`` labelled rows are used, those with the smallest hash of
    doc_id; the rest of the labels is not needed for so few weights. Terms are whole words
    and beginnings of words of ``shortest`` to ``longest`` letters, weighed by the log odds
    of being in a toxic document; kept are those in ``min_toxic`` toxic documents at least
    and ``min_z`` standard errors above even odds, at most ``max_terms``. Exception phrases
    are two-word phrases around a term found in five clean documents or more and in no
    toxic one, with the given ``exceptions``. Without both labels the lexicon is empty.
    Only doc_id, text and toxic are read, and doc_id only to pick rows.
    """
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "toxic")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    sample = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id")  # at most max_labelled rows
    counts = sample.select("text", "toxic").mapInArrow(_count_terms(shortest, longest), "term string, toxic long, clean long")
    sizes = {r.toxic: r.n for r in chosen.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return Lexicon(())
    n_toxic, n_clean = float(sizes[1]), float(sizes[0])
    totals = counts.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter(F.col("t") >= min_toxic)
    odds = F.log((F.col("t") + 0.5) / (n_toxic + 1)) - F.log((F.col("c") + 0.5) / (n_clean + 1))
    error = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("c") + 0.5))
    best = totals.select("term", odds.alias("weight"), (odds / error).alias("z")).filter(F.col("z") >= min_z)
    rows = best.orderBy(F.desc("z"), "term").limit(max_terms).collect()
    terms = tuple((r.term, round(r.weight, 6)) for r in rows)
    first = Lexicon(terms)
    phrases = sample.select("text", "toxic").mapInArrow(_count_phrases(first), "term string, toxic long, clean long")
    excused = phrases.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).filter("t = 0 and c >= 5")
    learned = [r.term for r in excused.orderBy(F.desc("c"), "term").limit(max_terms).collect()]
    lexicon = Lexicon(terms, (*learned, *(fold(e) for e in exceptions)))
    found = sample.select(_features(lexicon)(F.col("text")).alias("x"), "toxic").collect()  # at most max_labelled rows
    x = np.array([[1.0, *r.x] for r in found])
    weights = _logistic(x, np.array([float(r.toxic) for r in found]))
    return Lexicon(lexicon.terms, lexicon.exceptions, tuple(float(w) for w in weights))


_COUNTS = pa.schema([("term", pa.string()), ("toxic", pa.int64()), ("clean", pa.int64())])


def _counted(tally, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 1024):
            some = batch.slice(at, 1024)
            held: tuple[Counter, Counter] = (Counter(), Counter())
            for text, toxic in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
                held[1 if toxic else 0].update(tally(text))
            rows = ((t, held[1][t], held[0][t]) for t in {**held[0], **held[1]})
            yield from batches_of_rows(rows, _COUNTS, 65536)


def _count_terms(shortest: int, longest: int):
    return lambda batches: _counted(lambda text: terms_of(fold(text), shortest, longest), batches)


def _phrases_of(lexicon: Lexicon, text: str) -> set[str]:
    """Two-word phrases around the matches of a text; only the words next to a match are looked at."""
    folded, found = fold(text), set()
    for start, end, _, _ in matches(lexicon, folded):
        end = folded.index(" ", max(end, start + 1))
        low, high = start, end
        while low and folded[low - 1].isspace():
            low -= 1
        while high < len(folded) and folded[high].isspace():
            high += 1
        if low:
            found.add(f" {folded[folded.rfind(' ', 0, low) + 1 : low]}{folded[start : end + 1]}")
        if high < len(folded):
            stop = folded.find(" ", high)
            found.add(f"{folded[start : end + 1]}{folded[high : stop if stop >= 0 else len(folded)]} ")
    return found


def _count_phrases(lexicon: Lexicon):
    return lambda batches: _counted(lambda text: _phrases_of(lexicon, text), batches)


def _features(lexicon: Lexicon):
    @F.pandas_udf("array<double>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: list(features(lexicon, t)))

    return of


def score(lexicon: Lexicon, name: str = "text") -> Column:
    """Toxicity of a text between 0 and 1; a null text counts as empty."""

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        w = lexicon.coefficients
        held = [features(lexicon, t) for t in texts]
        x = np.array(held, float).reshape(-1, 3)
        return pd.Series(1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30))))

    return of(text_of(name))


def scored(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """One row per input row: (doc_id, held_out, score, predicted).

    Null and empty texts get the score of a text without matches. A row without doc_id is
    scored and not held out. Repeated rows are scored alike; without usable labels every
    score is that of no matches. Columns other than doc_id and text are ignored.
    """
    lexicon = learn(docs, labels, **settings)
    held = docs.select("doc_id", held_out().alias("held_out"), score(lexicon).alias("score"))
    return held.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def without_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of ``docs`` predicted clean, with its columns."""
    lexicon = learn(docs, labels, **settings)
    marked = docs.select(*[F.col(c) for c in docs.columns], score(lexicon).alias("_toxicity"))
    return marked.filter("_toxicity < 0.5").select(*docs.columns)
