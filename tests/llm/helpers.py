"""Small tables with the hard cases, and brute-force versions of the operators."""

from __future__ import annotations

import random
import re

from pyspark.sql import DataFrame, SparkSession

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHES = ("size", "bytes", "row", "start", "score", "n", "target", "rate", "set_id", "chunk", "norm", "one", "place", "mix_size")


def prose(seed: int, words: int, vocabulary: int = 400) -> str:
    draw = random.Random(seed)
    return " ".join(f"w{draw.randrange(vocabulary)}{'.' if draw.random() < 0.1 else ''}" for _ in range(words))


def hard_rows() -> list[tuple]:
    base = prose(1, 120)
    near = base.split(" ")
    near[7] = "changed"
    return [
        (1, base, "en", "a", None), (2, base, "en", "a", 5), (2, base, "en", "a", 5), (3, base.replace(" ", " \n\t"), None, "b", 1),
        (4, " ".join(near), "de", None, 1), (5, None, None, None, None), (6, "", "en", "b", 0), (7, " \t\n ", "en", "b", 3),
        (None, prose(2, 80), None, "a", 1), (None, None, None, None, None), (8, prose(3, 6000), "en", "a", 1),
        (9, "x" * 20_000, "en", "c", 1), (10, "one two", "fr", "c", 1), (11, "naïve 漢字 \U0001F600 #$%", "fr", "c", 1),
        (12, prose(4, 300) + " " + base, "en", "a", 1), (13, prose(5, 90), "en", "a", 1),
    ]


def table(spark: SparkSession, rows: list[tuple], clashes: bool = True) -> DataFrame:
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES if clashes else ():
        df = df.selectExpr("*", f"'clash' as {name}")
    return df


def shingle_sets(rows: list[tuple], size: int = 5) -> list[frozenset]:
    sets = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        n = min(size, len(words))
        sets.append(frozenset(tuple(words[k : k + n]) for k in range(len(words) - n + 1)) if n else frozenset())
    return sets


def brute_classes(rows: list[tuple], similarity: float = 0.8) -> list[tuple]:
    sets = shingle_sets(rows)
    n = len(rows)
    root, links = list(range(n)), [0] * n

    def find(k: int) -> int:
        while root[k] != k:
            k = root[k]
        return k

    for a in range(n):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= similarity * len(sets[a] | sets[b]) - 1e-9:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    least: dict[int, int | None] = {}
    for k, r in enumerate(rows):
        known = least.get(find(k))
        least[find(k)] = r[0] if known is None else known if r[0] is None else min(known, r[0])
    return [(r[0], least[find(k)], links[k]) for k, r in enumerate(rows)]


def brute_removed(texts: list[bytes], window: int) -> list[tuple[int, int, bytes]]:
    """(removed bytes, runs, rest) of each text."""
    seen: dict[bytes, int] = {}
    for t in texts:
        for k in range(len(t) - window + 1):
            seen[t[k : k + window]] = seen.get(t[k : k + window], 0) + 1
    out = []
    for t in texts:
        gone = [False] * len(t)
        for k in range(len(t) - window + 1):
            if seen[t[k : k + window]] > 1:
                gone[k : k + window] = [True] * window
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((sum(gone), runs, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


def by_row(rows) -> list:
    return sorted(map(tuple, rows), key=lambda r: tuple((v is not None, v) for v in r))
