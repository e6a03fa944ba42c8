from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermesh.llm import line_dedup, merkle, periodic_runs
from tests.llm.helpers import SCHEMA, WORD, by_row, hard_rows, prose, table


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


# Periodic runs


def brute_runs(words: list, least: int, power: int) -> list[tuple[int, int, int]]:
    n, found = len(words), {}
    for q in range(1, n // power + 1):
        at = 0
        while at + q < n:
            end = at
            while end + q < n and words[end] == words[end + q]:
                end += 1
            if end > at and end - at + q >= max(least, power * q):
                found.setdefault((at, end - at + q), q)  # smaller periods came before
            at = end + 1
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def test_the_cover_has_every_difference():
    assert {(a - b) % periodic_runs.PERIOD for a in periodic_runs.COVER for b in periodic_runs.COVER} == set(range(periodic_runs.PERIOD))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), max_size=12), st.integers(1, 30)), min_size=1, max_size=6),
       st.sampled_from([(24, 3), (4, 3), (1, 3), (9, 4)]))
def test_runs_are_those_of_brute_force(parts, sizes):
    texts = [np.array((part * times)[:200], np.int64) for part, times in parts]
    texts.append(np.concatenate(texts))
    assert periodic_runs.runs_of(texts, *sizes) == [brute_runs(t.tolist(), *sizes) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1), min_size=2, max_size=300), st.integers(1, 40))
def test_extensions(symbols, times):
    symbols = np.array((symbols * times)[:900], np.int64)
    pairs = [(a, b) for a in range(0, len(symbols), 37) for b in range(a + 1, len(symbols), 41)]
    expected = []
    for a, b in pairs:
        k = 0
        while b + k < len(symbols) and symbols[a + k] == symbols[b + k]:
            k += 1
        expected.append(k)
    a, b = np.array(pairs, np.int64).reshape(-1, 2).T
    assert periodic_runs.Extensions(symbols)(a, b).tolist() == expected


def periodic_rows() -> list[tuple]:
    rows = hard_rows() + [(k, prose(7000 + k, 40 + 7 * k), "en", "a", 1) for k in range(20, 80)]
    rows += [(90, " ".join(["same"] * 500), "en", "a", 1), (91, "\n".join(["a b\tc"] * 30 + ["x"] + ["a b c"] * 9), "en", "a", 1)]
    return rows + [(92, (prose(1, 40) + " ") * 3, "en", "a", 1), (93, (prose(2, 7) + " ") * 3, "en", "a", 1)] * 2


def test_periodic_runs(spark):
    rows = periodic_rows()
    got = periodic_runs.digests(periodic_runs.periodic_runs(periodic_runs.with_periodic_tails(table(spark, rows)))).collect()
    expected, planted = [], 0
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        h = zlib.crc32(str(doc).encode())
        if doc is not None and h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = brute_runs(words, 24, 3)
        gone = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = None
        for s, length, q in runs:
            if best is None or (length * best[2], -s, -q) > (best[1] * q, -best[0], -best[2]):
                best = (s, length, q)
        expected.append((
            doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
            sha("".join(f"{s},{length},{q}\n" for s, length, q in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)),
        ))
    assert planted > 3 and sum(e[1] for e in expected) > 5
    assert by_row(got) == by_row(expected)


def test_runs_of_long_texts_and_of_nothing(spark):
    rows = [(1, "word " * 300_000, "en", "a", 1), (2, prose(8, 1000) * 150, "en", "a", 1)]
    got = {r.doc_id: r for r in periodic_runs.periodic_runs(table(spark, rows)).collect()}
    assert [tuple(r) for r in got[1].runs] == [(0, 300_000, 1)] and got[1].collapsed == "word"
    assert len(got[2].runs) == 1
    assert got[2].runs[0].period == 999
    assert periodic_runs.periodic_runs(table(spark, [])).count() == 0
    with pytest.raises(ValueError, match="three times"):
        periodic_runs.periodic_runs(table(spark, []), power=2)


# Merkle manifest


def brute_manifest(rows: list[tuple]) -> list[tuple]:
    def coded(*values) -> str:
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
        return out

    def others(tree: list[list[str]], at: int) -> list[tuple[list[str], list[str]]]:
        found = []
        for nodes in tree[:-1]:
            low = at // 8 * 8
            found.append((nodes[low:at], nodes[at + 1 : low + 8]))
            at //= 8
        return found

    leaves: dict = {}
    for doc, text, lang, source, n in rows:
        leaf = coded(doc, source, lang, n, text)
        shown = leaf
        if doc is not None and zlib.crc32(str(doc).encode()) % 3 == 0 and text is not None:
            shown = coded(doc, source, lang, n, "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
        leaves.setdefault(lang, []).append((doc is not None, doc or 0, leaf, doc, shown))
    order = sorted(leaves, key=lambda g: (g is not None, (g or "").encode()))
    trees = [levels([x[2] for x in sorted(leaves[g])]) for g in order]
    top = levels([t[-1][0] for t in trees])
    out = []
    for k, g in enumerate(order):
        for rank, (_, _, leaf, doc, shown) in enumerate(sorted(leaves[g])):
            path = others(trees[k], rank) + others(top, k)
            fold = shown
            for before, after in path:
                fold = sha("".join([*before, fold, *after]))
            proof = sha("".join(x for before, after in path for x in [*before, *after]))
            out.append((doc, leaf, trees[k][-1][0], top[-1][0], proof, fold, fold == top[-1][0]))
    return out


def manifest_rows() -> list[tuple]:
    rows = hard_rows() + [(k, f"Text {k} ÄÖ" if k % 5 else None, ["en", "de", "", None, "日本"][k % 3 if k < 200 else 0], "b", k) for k in range(100, 400)]
    return rows + [(500 + k, "Of its OWN", f"lang{k}", None, None) for k in range(20)]


@pytest.mark.parametrize("rows", [manifest_rows(), hard_rows(), [(1, "A", "en", "a", 1)], [(k, "B", "en", "a", 1) for k in range(9)], []])
def test_manifest(spark, rows):
    assert by_row(merkle.verification(table(spark, rows)).collect()) == by_row(brute_manifest(rows))


def test_proofs_of_some_leaves(spark):
    manifest = merkle.build(table(spark, manifest_rows()), ["doc_id", "text"], "doc_id", "lang")
    every = {(r.tree, r.rank): r for r in merkle.prove(manifest).collect()}
    some = [k for k in every if k[1] % 7 == 0 and k[0] % 2 == 0]
    got = merkle.prove(manifest, spark.createDataFrame(some, "tree long, rank long")).collect()
    assert {(r.tree, r.rank) for r in got} == set(some) and all(every[r.tree, r.rank] == r for r in got)
    assert merkle.prove(manifest, spark.createDataFrame([(99, 0)], "tree long, rank long")).count() == 0


# Line dedup


def brute_lines(rows: list[tuple]) -> list[tuple]:
    def key(line: str) -> str:
        return "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))

    holders: dict[str, set] = {}
    for doc, text, *_ in rows:
        for line in (text or "").split("\n"):
            holders.setdefault(key(line), set()).add(doc)
    out = []
    for doc, text, *_ in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            own = holders[key(line)]
            first = min(own, key=lambda d: (d is None, d or 0))
            if len(key(line)) < 10 or len(own) < 2 or doc == first:
                kept.append(line)
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def lined_rows() -> list[tuple]:
    head, foot = "All rights RESERVED by us", "\tall rights reserved by us \x0b"
    rows = hard_rows()
    for k in range(30, 60):
        rows.append((k, f"{prose(k, 9)}\n{head if k % 2 else foot}\n{prose(k % 4, 5)}\nshort\n\n{foot}\n漢字漢字漢字漢字漢", "en", "a", 1))
    rows += [(61, "ninechars\nTEN chars!", "en", "a", 1), (62, "ten chars!\nninechars\nÉTÉ À LA MER", "en", "a", 1), (63, "été à la mer\r\nÉTÉ À LA MER", "en", "a", 1)]
    rows += [(64, "twice here it is\ntwice here it is", "en", "a", 1)] * 2 + [(64, "twice here it is\nother text of 64", "en", "a", 1)]
    rows += [(65, "漢字漢字漢字漢字漢字", "en", "a", 1), (66, "漢字漢字漢字漢字漢字", "en", "a", 1), (67, f"{head}\n{head}", "en", "a", 1)]
    return rows + [(None, f"of no one, twice\n{head}", "en", "a", 1), (None, "of no one, twice\nmore of it here", "en", "a", 1)]


def test_line_dedup(spark):
    rows = lined_rows()
    got = line_dedup.without_shared_lines(table(spark, rows)).collect()
    assert by_row(got) == by_row(brute_lines(rows))
    assert line_dedup.without_shared_lines(table(spark, [])).count() == 0


def test_lines_of_three_documents(spark):
    rows = [(k, f"in all of them\n{'in two of them' if k < 2 else f'own line of {k}'}", "en", "a", 1) for k in range(4)] * 2
    got = line_dedup.without_shared_lines(table(spark, rows), documents=3).collect()
    expected = [(d, 2, int(d > 0), t if d == 0 else t.split("\n")[1]) for d, t, *_ in rows]
    assert by_row(got) == by_row(expected)


def test_very_long_texts_of_lines(spark):
    text = "\n".join(f"line number {k % 1000}" for k in range(200_000))
    rows = [(1, text, "en", "a", 1), (2, text + "\nend", "en", "a", 1), (3, "y" * 3_000_000, "en", "a", 1)]
    got = {r.doc_id: r for r in line_dedup.without_shared_lines(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[1].n_dropped == 0 and got[2].n_dropped == 200_000 and got[2].kept_text == "end" and got[3].kept_text == rows[2][1]
