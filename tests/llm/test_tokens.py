from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from ledgermesh.llm import packing, quality, token_files
from ledgermesh.llm.tokens import encoder, public_path
from tests.llm.helpers import WORD, by_row, hard_rows, prose, table

BYTES, WORDS, PIECES = (public_path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))


@pytest.mark.parametrize("path", [BYTES, WORDS])
@settings(max_examples=150, deadline=None)
@given(text=st.text(st.one_of(st.sampled_from("ab .,'s\n\t\r 1é\x1c\xa0 Σ漢"), st.characters(exclude_categories=["Cs"])), max_size=40))
@example(text="a  b\n \n c\n\n  d 'll  <|endoftext|> e ")
@example(text=" lead  and trail  ")
def test_cut_texts_encode_as_whole_ones(path, text):
    e = encoder(path)
    assert e.mode != "whole"
    whole = e.library.encode(text, add_special_tokens=False).ids
    assert np.frombuffer(e.encode(pa.array(["a b", text, "a b"]))[1], "<u4").tolist() == whole


@settings(max_examples=80, deadline=None)
@given(bits=st.integers(1, 32), data=st.data())
def test_bits_round_trip(bits, data):
    ids = np.array(data.draw(st.lists(st.integers(0, (1 << bits) - 1), max_size=50)), "<u4")
    packed = token_files.pack(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    a = data.draw(st.integers(0, len(ids)))
    b = data.draw(st.integers(a, len(ids)))
    assert token_files.unpack(packed, bits, a, b).tolist() == ids[a:b].tolist()


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_whole_bytes_are_not_unfolded(bits, monkeypatch):
    ids = np.array([0, 1, 255, (1 << bits) - 1, 7], "<u4")
    unfolded = np.unpackbits(ids.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :bits]
    monkeypatch.delattr(np, "unpackbits")
    packed = token_files.pack(ids, bits)
    assert packed == np.packbits(unfolded.reshape(-1), bitorder="little").tobytes()
    assert [token_files.unpack(packed, bits, a, b).tolist() for a, b in ((0, 5), (1, 3), (4, 4))] == [ids.tolist(), [1, 255], []]


def test_widths():
    assert [token_files.width(n) for n in (1, 2, 3, 32000, 49408, 50257, 65537)] == [1, 1, 2, 15, 16, 16, 17]


def expected_ids(rows, path, end):
    e = encoder(path)
    return [[*e.library.encode(r[1] or "", add_special_tokens=False).ids, end] for r in rows]


def test_token_files_order_rows_of_one_id(spark, tmp_path):
    """Different texts under one doc_id, or under none, stand in one order whatever that of the input."""
    rows = [(d, f"text {n} " * (n % 5 + 1), "en", "web", 0) for d in (None, 3) for n in range(40)] + [(5, "text 1 ", "en", "web", 0)] * 3
    random.Random(2).shuffle(rows)
    found = []
    for n, order in enumerate((rows, rows[::-1])):
        path = str(tmp_path / f"ids{n}")
        token_files.write_token_files(table(spark, order).repartition(n + 1), path, BYTES, block_ids=16)
        read = token_files.read_token_files(token_files.token_blocks(spark, path)).collect()
        found.append(sorted((r.start, -1 if r.doc_id is None else r.doc_id, bytes(r.ids)) for r in read))
    assert found[0] == found[1]
    assert [d for _, d, _ in found[0]] == [-1] * 40 + [3] * 40 + [5] * 3


def test_token_files(spark, tmp_path):
    rows = hard_rows()
    path = str(tmp_path / "ids")
    token_files.write_token_files(table(spark, rows), path, BYTES, block_ids=64)
    blocks = token_files.token_blocks(spark, path)
    assert blocks.filter("n_ids >= 64").count() > 1
    got = token_files.read_token_files(blocks).collect()
    assert sorted((r.doc_id is not None, r.doc_id, tuple(np.frombuffer(r.ids, "<u4"))) for r in got if r.doc_id) == sorted(
        (True, r[0], tuple(i)) for r, i in zip(rows, expected_ids(rows, BYTES, 0), strict=True) if r[0])
    order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in order] == np.cumsum([0, *[len(r.ids) // 4 for r in order[:-1]]]).tolist()
    assert [r.doc_id for r in order] == sorted((r.doc_id for r in order), key=lambda d: (d is not None, d or 0))
    stream = np.concatenate([np.frombuffer(r.ids, "<u4") for r in order])
    for a, b in ((0, 5), (60, 70), (100, 700), (len(stream) - 3, len(stream)), (7, 7)):
        assert token_files.ids_between(spark, path, a, b).tolist() == stream[a:b].tolist()
    empty = str(tmp_path / "none")
    token_files.write_token_files(table(spark, []), empty, BYTES)
    assert token_files.read_token_files(token_files.token_blocks(spark, empty)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 30), min_size=1, max_size=20))
def test_bins_hold_everything_once(counts):
    bins = packing.plan_bins(dict(counts), 64)
    held: dict[int, int] = {}
    for times, own in bins:
        assert sum(own) <= 64 and times > 0
        for length in own:
            held[length] = held.get(length, 0) + times
    assert held == counts
    used, total = sum(t for t, _ in bins), sum(k * n for k, n in counts.items())
    assert used <= 2 * total / 64 + 1


def test_two_small_ones_take_the_place_of_one():
    # 60 + 30 leaves 10; 30 gives way to 25 + 15, which fill the bin
    assert (1, [60, 25, 15]) in packing.plan_bins({60: 1, 30: 1, 25: 1, 15: 1}, 100)


def test_packed_sequences(spark):
    rows = hard_rows() + [(100 + k, prose(700 + k, 3 + k % 40), "en", "a", 1) for k in range(60)]
    got = packing.pack_sequences(table(spark, rows), WORDS, limit=64).collect()
    expected = []
    for r, ids in zip(rows, expected_ids(rows, WORDS, 1), strict=True):
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            expected.append((r[0], k // 64, k, len(part), zlib.crc32(part.tobytes())))
    assert by_row([r[:5] for r in got]) == by_row(expected)
    bins: dict[int, list] = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *[n for _, n in own[:-1]]]).tolist() and sum(n for _, n in own) <= 64
    assert len(bins) <= 1.02 * sum(r.length for r in got) / 64 + 1
    assert packing.pack_sequences(table(spark, []), WORDS).count() == 0


def brute_repeat_words(words):
    windows = [tuple(words[k : k + 3]) for k in range(len(words) - 2)]
    return len({k + j for k, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=14))
def test_repeat_words(words):
    assert quality.repeat_words(words) == brute_repeat_words(words)


def test_quality(spark):
    rows = [*hard_rows(), (14, "same line\nsame line\n\n\nother #%\n same line\nother #%", "en", "a", 1)]
    rows += [(200 + k, prose(800 + k, 200 + 6 * k), "en", "a", 1) for k in range(40)]
    rows += [(300, " ".join(f"{w}###" for w in prose(900, 220).split(" ")), "en", "a", 1), (301, "漢字 \U00013000" * 300, "en", "a", 1)]
    got = quality.judge(table(spark, rows), PIECES, BYTES).collect()
    assert len(got) == len(rows)
    for r in got:
        text = next(x[1] or "" for x in rows if x[0] == r.doc_id and (x[0] is not None or len(WORD.findall(x[1] or "")) == r.n_words))
        words = WORD.findall(text)
        lines = text.split("\n")
        dup = sum(bool(WORD.search(x)) and x in lines[:k] for k, x in enumerate(lines))
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert r.n_dup_lines == dup and (len(words) > 400 or r.n_repeat_words == brute_repeat_words(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in got}
    assert all(kept[200 + k] for k in range(40)) and not kept[300] and not kept[301]
    assert quality.judge(table(spark, []), PIECES, BYTES).count() == 0


def test_few_documents_are_judged_against_more(spark):
    """A class or language with a document or two takes its band from its neighbours."""
    odd = " ".join(f"{w}###" for w in prose(910, 6000).split(" "))
    rows = [(k, prose(1000 + k, 200 + 6 * k), "en", "a", 1) for k in range(60)]
    rows += [(100, odd, "en", "a", 1), (101, prose(911, 6000), "en", "a", 1)]  # the only long ones
    rows += [(102, " ".join(odd.split(" ")[:300]), "xx", "a", 1), (103, prose(912, 300), "yy", "a", 1)]  # languages of one document
    rows += [(104, " ".join(odd.split(" ")[300:600]), None, "a", 1)]
    got = {r.doc_id: r for r in quality.judge(table(spark, rows), PIECES, BYTES).collect()}
    assert not any(r.base_failed for r in got.values())
    assert all(got[k].kept for k in range(60)) and got[103].kept
    assert {k: got[k].kept for k in (100, 102, 104)} == {100: False, 102: False, 104: False}


@pytest.mark.parametrize("text,script", [
    ("http://example.com " + "Привет, мир " * 9, "CYRILLIC"), ("Heading\n" + "漢字漢字" * 9, "CJK"), ("Ж and more words", "LATIN"),
    ("plain", "LATIN"), ("12 #", "NONE"), ("١ \u2028 \U0001F600", "NONE"), ("", "NONE"), ("aaжж", "CYRILLIC"),
])
def test_script_is_that_of_most_letters(text, script):
    assert quality.main_script(text) == script


def test_null_lang_is_judged_by_the_whole_text(spark):
    rows = [(1, "Intro http://a.b " + "слово речь " * 40, None, "a", 1)]
    assert [r.script for r in quality.measure(table(spark, rows), PIECES, BYTES).collect()] == ["CYRILLIC"]
