"""Very long texts and damaged archives in seconds, and brute-force versions of the matcher and the fertility bands."""

from __future__ import annotations

import gzip
import math
import time
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ledgermesh.llm import mixing, near_duplicates, quality, toxicity, warc
from ledgermesh.llm.tokens import public_path, word_pieces
from tests.llm.helpers import WORD, brute_classes, by_row, hard_rows, prose, table
from tests.llm.test_archives import SCHEMA, pages, rows_read, written

LIMIT = 10.0  # seconds for 5 MB


def seconds(work) -> float:
    began = time.perf_counter()
    work()
    return time.perf_counter() - began


# Toxicity

LEXICON = toxicity.Lexicon(((" trash ", 2.0), (" tras", 1.0), (" scum ", 3.0), (" sc", 0.5)), (" trash can ", " the trash can man ", " scum bag "))


def brute_matches(lexicon: toxicity.Lexicon, folded: str) -> list[tuple]:
    def places(term: str) -> list[int]:
        return [k for k in range(len(folded)) if folded.startswith(term, k)]

    best: dict[int, tuple] = {}
    for term, weight in lexicon.terms:
        for k in places(term):
            if k not in best or weight > best[k][2]:
                best[k] = (k, k + len(term) - 1, weight, term)
    spans = [(k, k + len(e) - 1) for e in lexicon.exceptions for k in places(e)]
    return sorted(m for m in best.values() if not any(s <= m[0] and m[1] <= e for s, e in spans))


def brute_phrases(lexicon: toxicity.Lexicon, folded: str) -> set[str]:
    found = set()
    for start, end, *_ in brute_matches(lexicon, folded):
        end = folded.index(" ", max(end, start + 1))
        before, after = folded[:start].split(), folded[end:].split()
        if before:
            found.add(f" {before[-1]}{folded[start:end + 1]}")
        if after:
            found.add(f"{folded[start:end + 1]}{after[0]} ")
    return found


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["trash", "tr4sh", "trashy", "can", "the", "man", "scum", "sсum", "bag", "scan", "-", "fine"]), max_size=30))
def test_matcher_is_brute_force(words):
    folded = toxicity.fold(" ".join(words))
    assert sorted(toxicity.matches(LEXICON, folded)) == brute_matches(LEXICON, folded)
    assert toxicity._phrases_of(LEXICON, " ".join(words)) == brute_phrases(LEXICON, folded)
    total = sum(m[2] for m in brute_matches(LEXICON, folded))
    terms = {m[3] for m in brute_matches(LEXICON, folded)}
    n = max(1, folded.count(" ") - 1)
    assert toxicity.features(LEXICON, " ".join(words)) == (math.log1p(total), math.log1p(100 * total / n), float(len(terms)))


@pytest.mark.parametrize("unit", ["trash can and scum of the trash can man ", "scum ", "trash can ", "trash -- !! "])
def test_toxicity_of_long_texts(unit):
    text = unit * (5_000_000 // len(unit))
    assert seconds(lambda: toxicity.features(LEXICON, text)) < LIMIT
    assert seconds(lambda: toxicity._phrases_of(LEXICON, text)) < 2 * LIMIT


# Archives


@pytest.mark.parametrize("junk", [b"WARC/1.1\r\n", b"\x1f\x8b\x08 no member ", b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab", b"x"])
def test_salvage_of_much_damage(spark, tmp_path, junk):
    (path,) = [p for p in map(str, (tmp_path / "w").glob("*.txt"))] or [_one_file(spark, tmp_path)]
    good = open(path, "rb").read()
    data = junk * (5_000_000 // len(junk)) + b"\r\n" + good
    began = time.perf_counter()
    found = list(warc.salvage(data))
    assert time.perf_counter() - began < LIMIT
    assert b"".join(data[f[0] : f[0] + f[1]] for f in found) == data
    assert [f[5] for f in found if f[2] == "record"][-2:] == [f[5] for f in warc.salvage(good)][-2:]


def _one_file(spark, folder) -> str:
    warc.write_archives(spark.createDataFrame([(1, "u", "one", "c"), (2, "u", "two", "c")], SCHEMA).coalesce(1), str(folder / "w"))
    return str(next(p for p in (folder / "w").glob("*.txt")))


def test_many_members(spark, tmp_path):
    good = open(_one_file(spark, tmp_path), "rb").read()
    records = [good[f[0] : f[0] + f[1]] for f in warc.salvage(good)]
    data = b"".join(gzip.compress(records[k % 2] if k % 2 else records[0], 1) for k in range(12_000))
    began = time.perf_counter()
    found = list(warc.salvage(data))
    assert time.perf_counter() - began < LIMIT and [f[2] for f in found] == ["record"] * 12_000
    assert found[-1][0] + found[-1][1] == len(data)


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rows = [*pages(), *[(100 + k, "u", f"{k} " * 3000, "c") for k in range(20)], (500, "u", "long " * 20_000, "c")]
    path = written(spark, tmp_path / "w", rows, file_bytes=40_000, file_records=20)
    plain = written(spark, tmp_path / "plain", rows)

    def columns(found):
        return by_row((r.page, r.payload_digest, r.warc_type, r.to) for r in found)

    assert columns(rows_read(spark, path)) == columns(rows_read(spark, plain))
    sizes = [p.stat().st_size for p in (tmp_path / "w").glob("*.txt")]
    assert sum(s > 60_000 for s in sizes) == sum(len((r[2] or "").encode()) > 60_000 for r in rows)


# Near duplicates


def test_long_near_copies(spark):
    base = prose(90, 60_000, 50_000).split(" ")
    rows = hard_rows()[:4]
    for k in range(6):
        own = list(base)
        own[1000 * k] = f"edit{k}"
        rows.append((100 + k, " ".join(own), "en", "a", 1))
    got = near_duplicates.classes(table(spark, rows)).collect()
    assert by_row(got) == by_row(brute_classes(rows))


# Mixing


def test_many_sources(spark):
    sizes = {f"s{k:04d}": 1 + k * k % 97 for k in range(3000)} | {None: 50}
    frame = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    from tests.llm.test_scores_and_mixes import brute_targets

    expected = brute_targets(sizes)
    got = {r.source: r.target for r in mixing.source_targets(frame, (3, 1, 2), 1.5, 2.0).collect()}
    assert got.keys() == expected.keys() and all(got[s] == pytest.approx(expected[s], rel=1e-6) for s in got)


def test_a_dual_that_is_not_found_is_an_error(spark):
    bins = spark.createDataFrame([("a", 3, 10), ("a", 7, 10)], "source string, size long, n long")
    known = spark.createDataFrame([("a", 100, 20, 130.0)], "source string, source_size long, n_docs long, target double")
    with pytest.raises(ValueError, match="rounds"):
        mixing.solve_dual(bins, known, 2.0, rounds=1)


# Fertility


def fertility_rows() -> list[tuple]:
    rows = hard_rows() + [(100 + k, prose(8000 + k, 60 + k), ["en", "de", None][k % 3], "a", 1) for k in range(60)]
    rows += [(300 + k, " ".join(["漢字"] * 60 + [f"字{j}" for j in range(k)]), None, "a", 1) for k in range(4)]
    return rows + [(400, " ".join(f"qzx{k}jkv{k * k}" for k in range(90)), "en", "a", 1), (401, " ".join(["same"] * 30 + ["word"] * 40), "en", "a", 1)]


def test_measures_are_brute_force(spark):
    rows = fertility_rows()
    pieces, byte_level = public_path("piece_bpe_32k.model"), public_path("byte_bpe_50k.json")
    import tokenizers

    library, level = word_pieces(pieces), tokenizers.Tokenizer.from_file(byte_level)
    got = {(r.doc_id, r.n_words, r.word_chars): r for r in quality.measure(table(spark, rows), pieces, byte_level).collect()}
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        ids = [i for own in library.library.encode(words) for i in own]
        counts, n = Counter(ids), max(1, len(ids))
        entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) / math.log2(n) if n > 1 else 0.0
        in_bytes = sum(len(level.encode(w, add_special_tokens=False).ids) for w in words)
        chars = sum(map(len, words))
        row = got[doc, len(words), chars]
        assert row.chars_per_token == pytest.approx(chars / n) and row.token_entropy == pytest.approx(entropy, abs=1e-9)
        assert row.chars_per_token_bytes == pytest.approx(chars / max(1, in_bytes), rel=0.05)


def test_bands_are_brute_force(spark):
    """Every cell takes its quartiles from the first set in reach that has enough documents; kept follows from them."""
    rows = fertility_rows()
    pieces, byte_level = public_path("piece_bpe_32k.model"), public_path("byte_bpe_50k.json")
    judged = [r.asDict() for r in quality.judge(table(spark, rows), pieces, byte_level).collect()]
    good = [r for r in judged if not r["base_failed"]]

    def members(cell: dict, kind: str, wide: int | None) -> list[dict]:
        return [r for r in good if (kind == "corpus" or r[kind] == cell[kind]) and (wide is None or abs(r["length_class"] - cell["length_class"]) <= wide)]

    for r in judged:
        held = next((m for kind, wide in quality.REACH if len(m := members(r, kind, wide)) >= 20), members(r, "corpus", None))
        outside = None
        for name, fence in quality.FENCES.items():
            values = sorted(m[name] for m in held)
            low, middle, high = (values[max(0, math.ceil(q * len(values)) - 1)] for q in (0.25, 0.5, 0.75))
            wide = fence * max(high - low, 0.04 * max(middle, 0.5))
            if outside is None and not low - wide <= r[name] <= high + wide:
                outside = name
        assert (r["failed_measure"], r["kept"]) == (outside, not r["base_failed"] and outside is None), r
    assert any(r["failed_measure"] for r in judged if not r["base_failed"])
