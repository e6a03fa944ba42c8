from __future__ import annotations

import hashlib
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermesh.llm import exact_dedup, near_duplicates, repeats
from tests.llm.helpers import brute_classes, brute_removed, by_row, hard_rows, prose, table


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_groups(spark, bits):
    rows = hard_rows()
    norm = [re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows]
    expected = []
    for r, t in zip(rows, norm, strict=True):
        ids = [o[0] for o, u in zip(rows, norm, strict=True) if u == t]
        keep = min((i for i in ids if i is not None), default=None)
        expected.append((r[0], keep, len(ids), r[0] == keep, hashlib.sha256(t.encode()).hexdigest()))
    got = exact_dedup.groups_of_equal_texts(table(spark, rows), bits).collect()
    assert by_row(got) == by_row(expected)


def test_chunks_are_the_text_and_follow_its_content(spark):
    long = " ".join(f"{prose(k, 30)}." for k in range(60))
    cuts = spark.createDataFrame([(long,), ("shift " + long,), ("y" * 9000,), ("",)], "t string").select(
        exact_dedup.chunks(exact_dedup.F.col("t")).alias("c"), "t").collect()
    assert all("".join(r.c) == r.t for r in cuts)
    assert len(set(cuts[0].c) & set(cuts[1].c)) >= len(cuts[0].c) - 2
    assert max(map(len, cuts[2].c)) <= 4096 and cuts[3].c == []


def test_without_copies(spark):
    rows = hard_rows()
    got = exact_dedup.without_copies(table(spark, rows))
    assert got.columns == table(spark, rows).columns
    assert sorted(r.doc_id or 0 for r in got.collect()) == [0, 1, 4, 5, 7, 8, 9, 10, 11, 12, 13]
    assert exact_dedup.without_copies(table(spark, [])).count() == 0


def near_copies() -> list[tuple]:
    draw = random.Random(3)
    rows = []
    for group in range(3):
        base = prose(100 + group, 100 + 60 * group, 5000).split(" ")
        for _ in range(25):
            own = list(base)
            for _ in range(draw.randrange(6)):
                own[draw.randrange(len(own))] = f"edit{draw.randrange(10**6)}"
            rows.append((len(rows) + 20, " ".join(own), "en", "a", 1))
    return rows


@pytest.mark.parametrize("bucket,cluster", [(256, 128), (4, 3), (12, 100)])
def test_near_duplicate_classes(spark, bucket, cluster):
    rows = [r for r in hard_rows() if r[0] is not None or r[1]] + near_copies()
    got = near_duplicates.classes(table(spark, rows), bucket=bucket, cluster=cluster).collect()
    assert by_row(got) == by_row(brute_classes(rows))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=1), st.integers(0, 3)), min_size=2, max_size=12), st.integers(1, 8), st.integers(1, 12))
def test_tries_join_what_agrees(labels, depth, least):
    """Of sets that share a prefix, those that agree in enough places end up in one part, whatever the depth at which they meet."""
    import pyarrow as pa

    draw = random.Random(len(labels))
    label = [b[:1] * k + bytes(draw.randrange(2) for _ in range(near_duplicates.DEPTH - k)) for b, k in labels]
    sig = [bytes(draw.randrange(2) for _ in range(12)) for _ in labels]
    order = sorted(range(len(labels)), key=lambda k: (label[k][:depth], label[k]))
    batch = pa.RecordBatch.from_pylist([
        {"bucket": hash(label[k][:depth]), "block": 0, "label": label[k], "set_id": bytes([k]), "signature": sig[k]} for k in order
    ])
    edges = [(r["a"][0], r["b"][0]) for out in near_duplicates._trie(least, depth)(iter([batch])) for r in out.to_pylist()]
    assert all(sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) >= least and label[a][:depth] == label[b][:depth] for a, b in edges)

    def parts(pairs):
        root = list(range(len(labels)))
        for a, b in pairs:
            root = [root[a] if r == root[b] else r for r in root]
        return {frozenset(k for k in range(len(root)) if root[k] == r) for r in root}

    every = [(a, b) for a in range(len(labels)) for b in range(a) if label[a][:depth] == label[b][:depth]
             and sum(x == y for x, y in zip(sig[a], sig[b], strict=True)) >= least]
    assert parts(edges) == parts(every) and len(edges) == len(labels) - len(parts(every))


def test_near_duplicate_edges(spark):
    assert near_duplicates.classes(table(spark, [])).count() == 0
    rows = hard_rows()
    kept = near_duplicates.one_of_each_class(table(spark, rows))
    assert kept.columns == table(spark, rows).columns
    ids = [r.doc_id for r in kept.collect()]
    # The row without doc_id and text is a copy of 5, 6 and 7; of the rows that repeat 2 none is left, 1 stands for them.
    assert ids.count(None) == 1 and {1, 5, 8, 9, 10, 11, 12, 13} <= set(ids) and not {2, 3, 4, 6, 7} & set(ids) and len(ids) == len(set(ids))


def test_one_of_each_class_with_repeated_ids(spark):
    """Of near copies under one doc_id one stays; other texts under it stand for their own class."""
    base, other = prose(60, 200, 5000), prose(61, 200, 5000)
    near = base.split(" ")
    near[50] = "edit"
    rows = [(1, base, "en", "a", 1), (1, " ".join(near), "en", "a", 1), (1, other, "en", "a", 1), (2, base, "en", "a", 1), (3, other, "en", "a", 1)]
    rows += [(1, other, "en", "a", 1), (1, other, "de", "b", 2)]  # one of equal rows stays
    rows += [(None, "of no one", "en", "a", 1), (None, "of no one", "fr", "a", 1)]
    got = [(r.doc_id, r.text == other) for r in near_duplicates.one_of_each_class(table(spark, rows)).collect()]
    assert sorted(got, key=str) == [(1, False), (1, True), (None, False)]


def test_depth_reaches_the_recall():
    d = near_duplicates.matched_depth(0.8, 0.9999)
    assert 1 - (1 - 0.8**d) ** near_duplicates.TREES >= 0.9999 > 1 - (1 - 0.8 ** (d + 1)) ** near_duplicates.TREES


def test_a_recall_that_no_depth_reaches_is_an_error():
    assert near_duplicates.matched_depth(0.4, 0.9999) == 1
    with pytest.raises(ValueError, match="recall"):
        near_duplicates.matched_depth(0.2, 0.9999)


def shared_passages() -> list[tuple]:
    draw = random.Random(5)
    passages = [prose(200 + k, 30) for k in range(4)]
    rows = [(k, " ".join(draw.choice([prose(300 + 7 * k + j, 12), draw.choice(passages), "aaaa" * 20]) for j in range(4)), "en", "a", 1)
            for k in range(40)]
    return rows + [r for r in hard_rows() if r[0] != 8]


@pytest.mark.parametrize("bucket", [1000, 2])
@pytest.mark.parametrize("batch", [1 << 20, 300])
def test_repeats_against_brute_force(spark, monkeypatch, bucket, batch):
    rows = shared_passages()
    if batch != 1 << 20:  # the hashing of long texts in parts, in this process
        monkeypatch.setattr(repeats, "_BATCH", batch)
        texts = [(r[1] or "").encode() for r in rows]
        parts = list(repeats._stretches(texts, 40, 12))
        monkeypatch.setattr(repeats, "_BATCH", 1 << 20)
        assert sorted(parts) == sorted(repeats._stretches(texts, 40, 12))
        return
    got = repeats.without_repeats(table(spark, rows), 40, 12, bucket).collect()
    texts = [(r[1] or "").encode() for r in rows]
    expected = [
        (r[0], len(t), n, runs, hashlib.sha256(rest).hexdigest(), rest)
        for r, t, (n, runs, rest) in zip(rows, texts, brute_removed(texts, 40), strict=True)
    ]
    assert by_row([(*r[:5], bytes(r[5])) for r in got]) == by_row(expected)


def test_repeat_groups_hold_all_occurrences(spark):
    passage = prose(400, 30)
    rows = [(k, f"{prose(500 + k, 20)} {passage} {prose(600 + k, 20)}", "en", "a", 1) for k in range(5)]
    groups: dict[int, list] = {}
    for r in repeats.repeats(table(spark, rows), 60, 16).collect():
        text = rows[r.doc_id][1].encode()[r.start : r.start + r.length]
        groups.setdefault(r.repeat_id, []).append((r.doc_id, text))
    assert all(len({t for _, t in g}) == 1 and len(g) >= 2 for g in groups.values())
    assert any({d for d, _ in g} == set(range(5)) for g in groups.values())
    assert repeats.without_repeats(table(spark, [])).count() == 0


def brute_maximal(texts: list[bytes], window: int) -> set[tuple[bytes, tuple]]:
    """(string, its places) of the maximal repeats of ``window`` bytes or more."""
    found, length = set(), window
    places = [(k, at) for k, t in enumerate(texts) for at in range(len(t) - window + 1)]
    while places:
        held: dict[bytes, list] = {}
        for k, at in places:
            if at + length <= len(texts[k]):
                held.setdefault(texts[k][at : at + length], []).append((k, at))
        held = {s: p for s, p in held.items() if len(p) > 1}
        for string, own in held.items():
            left = [texts[k][at - 1] if at else None for k, at in own]
            right = [texts[k][at + length] if at + length < len(texts[k]) else None for k, at in own]
            if all(None in side or len(set(side)) > 1 for side in (left, right)):
                found.add((string, tuple(sorted(own))))
        places, length = [p for own in held.values() for p in own], length + 1
    return found


@pytest.mark.parametrize("bucket", [1000, 1])
def test_maximal_repeats_of_any_length(spark, bucket):
    window, passage = 24, prose(410, 180)
    near = passage[:300] + "changed" + passage[300:]
    texts = [f"{prose(700 + k, 15)} {passage} {prose(720 + k, 15)}" for k in range(3)]
    texts += [passage, passage, f"{near} {passage[:100]}", "ab" * 20 + near, "z" * 60, prose(740, 30), prose(740, 30) + " more"]
    rows = [(k, t, "en", "a", 1) for k, t in enumerate(texts)]
    rows += [(20, passage, "en", "a", 1)] * 2 + [(None, passage[:200], None, None, None), (21, None, None, None, None)]
    coded = [(r[1] or "").encode() for r in rows]
    groups: dict[int, list] = {}
    for r in repeats.repeats(table(spark, rows), window, 8, bucket).collect():
        groups.setdefault(r.repeat_id, []).append((r.doc_id, r.start, r.length))
    got = []
    for own in groups.values():
        (length,) = {n for *_, n in own}
        string = {next(t for r, t in zip(rows, coded, strict=True) if r[0] == d)[at : at + length] for d, at, _ in own}
        assert len(string) == 1
        got.append((string.pop(), by_row([(d, at) for d, at, _ in own])))
    expected = [(s, by_row([(rows[k][0], at) for k, at in own])) for s, own in brute_maximal(coded, window)]
    assert max(len(s) for s, _ in expected) > 2 * window + 256
    assert sorted(got, key=repr) == sorted(expected, key=repr)
    assert repeats.repeats(table(spark, [])).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=3, max_size=9).map(str.encode), min_size=2, max_size=6))
def test_intervals_are_the_maximal_repeats(texts):
    suffixes = [t[k:] for t in texts for k in range(len(t) - 2)]
    leads = [t[k - 1] if k else -1 for t in texts for k in range(len(t) - 2)]
    got = {(n, tuple(sorted(m))) for n, m in repeats.intervals(suffixes, leads, 3)}
    expected = set()
    for prefix in {s[:n] for s in suffixes for n in range(3, len(s) + 1)}:
        held = tuple(k for k, s in enumerate(suffixes) if s.startswith(prefix))
        longest = min(len(suffixes[k]) for k in held)
        right = any(len(suffixes[k]) == len(prefix) for k in held) or len({suffixes[k][: len(prefix) + 1] for k in held}) > 1
        left = len({leads[k] for k in held}) > 1 or -1 in {leads[k] for k in held}
        if len(held) > 1 and right and left and longest >= len(prefix):
            expected.add((len(prefix), held))
    assert got == expected
