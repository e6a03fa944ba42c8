from __future__ import annotations

import math
import zlib
from collections import Counter

import pytest

from ledgermesh.llm import language_model, mixing, toxicity
from ledgermesh.llm.tokens import public_path, word_pieces
from tests.llm.helpers import WORD, by_row, hard_rows, prose, table

PIECES = public_path("piece_bpe_32k.model")


def brute_targets(sizes: dict, weights=(3, 1, 2), share=1.5, cap=2.0) -> dict:
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    fixed: dict = {}
    while True:
        free = [s for s in order if s not in fixed]
        left = share * sum(sizes.values()) - sum(fixed.values())
        goal = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if goal[s] > cap * sizes[s]]
        if not over:
            return fixed | goal
        fixed |= {s: cap * sizes[s] for s in over}


def sources() -> list[tuple]:
    rows = [(1000 + k, prose(2000 + k, 5 + k * k % 90), "en", f"s{k % 5}", 1) for k in range(150)]
    return rows + [(2000 + k, prose(9, 10), "en", "s0", 1) for k in range(120)] + [r for r in hard_rows() if r[0] not in (8,)]


def test_mix_meets_its_targets(spark):
    rows = sources()
    docs = table(spark, rows)
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows)
    sizes: Counter = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    goal = brute_targets(sizes)
    taken: Counter = Counter()
    for r in got:
        assert r.mix_size == len(WORD.findall(r.text or "")) and r.mix_source_size == sizes[r.source]
        assert r.mix_target == pytest.approx(goal[r.source]) and 0 <= r.mix_copies <= 2
        taken[r.source] += r.mix_copies * r.mix_size
    for s, size in sizes.items():
        longest = max((r.mix_size for r in got if r.source == s), default=0)
        assert abs(taken[s] - goal[s]) <= max(1, 0.5 * longest)
    again = mixing.mix(docs.repartition(3)).collect()
    assert by_row([(r.doc_id, r.mix_copies) for r in got]) == by_row([(r.doc_id, r.mix_copies) for r in again])
    repeated = mixing.mixed_documents(docs)
    assert repeated.columns == docs.columns and repeated.count() == sum(r.mix_copies for r in got)


def test_rates_are_tilted_by_size(spark):
    bins = spark.createDataFrame([("a", k, 3) for k in range(1, 40)], "source string, size long, n long")
    total = sum(3 * k for k in range(1, 40))
    known = spark.createDataFrame([("a", total, 117, 0.7 * total)], "source string, source_size long, n_docs long, target double")
    dual = mixing.solve_dual(bins, known, 2.0).collect()[0].dual
    given = sum(3 * k * 2 / (1 + math.exp(-dual * k / (total / 117))) for k in range(1, 40))
    assert dual < 0 and given == pytest.approx(0.7 * total, rel=1e-6)


def test_mix_of_nothing(spark):
    assert mixing.mix(table(spark, [])).count() == 0
    assert [r.mix_copies for r in mixing.mix(table(spark, [(1, None, None, None, None)])).collect()] in ([1], [2])


def brute_losses(rows: list[tuple], target: set, strength: float) -> list[tuple]:
    pieces = word_pieces(PIECES)
    texts = [[i for w in pieces.library.encode(WORD.findall(r[1] or "")) for i in w] for r in rows]
    models = []
    for chosen in (lambda r: r[0] in target, lambda r: True):
        pairs, tokens, contexts = Counter(), Counter(), Counter()
        for r, t in zip(rows, texts, strict=True):
            if chosen(r):
                tokens.update(t)
                before = [pieces.size, *t[:-1]]
                contexts.update(before[: len(t)])
                pairs.update(zip(before, t, strict=False))
        models.append((pairs, tokens, contexts, sum(tokens.values())))
    out = []
    for r, t in zip(rows, texts, strict=True):
        losses = []
        for pairs, tokens, contexts, n in models:
            total = 0.0
            for v, w in zip([pieces.size, *t[:-1]], t, strict=False):
                base = (tokens[w] + 1) / (n + pieces.size)
                total -= math.log((pairs[v, w] + strength * base) / (contexts[v] + strength))
            losses.append(total / len(t) if t else None)
        out.append((r[0], len(t), *losses))
    return out


@pytest.mark.parametrize("shared", [1 << 20, 40])
def test_cross_entropy_difference(spark, shared):
    rows = [r for r in hard_rows() if r[0] != 2] + [(50 + k, prose(3000 + k, 40, 60), "en", "a", 1) for k in range(20)]
    target = {50, 51, 52, 53, 54, 4}
    ids = spark.createDataFrame([(i, "clash") for i in [*target, 50]] + [(None, "x")], "doc_id long, text string")
    got = language_model.cross_entropy_difference(table(spark, rows), ids, PIECES, 10.0, shared).collect()
    expected = brute_losses(rows, target, 10.0)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    for g, e in zip(sorted(map(tuple, got), key=key), sorted(expected, key=key), strict=True):
        assert g[:2] == e[:2]
        if e[1]:
            assert g[2:4] == pytest.approx(e[2:4], rel=1e-9) and g[4] == pytest.approx(e[2] - e[3], abs=1e-9)
        else:
            assert g[2:] == (None, None, None)


def test_cross_entropy_without_rows(spark):
    none = spark.createDataFrame([], "doc_id long")
    assert language_model.cross_entropy_difference(table(spark, []), none, PIECES).count() == 0


def test_folding():
    assert toxicity.fold("Ｔrаsh, 1D10T!") == " trash  idiot  "
    assert toxicity.fold("sc​um") == " scum "
    assert toxicity.fold("") == "  "


def test_matches_and_exceptions():
    lexicon = toxicity.Lexicon(((" trash ", 2.0), (" tras", 1.0), (" scum ", 3.0)), (" trash can ",))
    assert [m[3] for m in toxicity.matches(lexicon, toxicity.fold("trash can and trash"))] == [" trash "]
    assert [m[2] for m in toxicity.matches(lexicon, toxicity.fold("TR4SHY scum."))] == [1.0, 3.0]
    assert toxicity.matches(toxicity.Lexicon(()), " trash ") == []
    short, long = toxicity.features(lexicon, "scum a"), toxicity.features(lexicon, "scum" + " a" * 500)
    assert short[0] == long[0] and short[1] > long[1]


def labelled(n: int) -> tuple[list[tuple], list[tuple]]:
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        text = prose(4000 + k, 40) + (" you are scum and " + ("tr4sh" if k % 8 else "trаsh") if toxic else " trash can" if k % 20 == 1 else "")
        docs.append((k, text, "en", "a", 1))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_is_learned_from_rows_not_held_out(spark):
    docs, labels = labelled(400)
    told = [(i, q, t if zlib.crc32(str(i).encode()) % 5 else 1 - t) for i, q, t in labels]  # held-out labels are wrong
    rows = docs + [(900 + k, *r[1:]) for k, r in enumerate(hard_rows())] + [(None, "you are scum", None, None, None)]
    marked = spark.createDataFrame([*told, (None, 1, 1), (5000, None, None)], "doc_id long, quality int, toxic int")
    lexicon = toxicity.learn(table(spark, rows), marked)
    assert any("trash can " in e for e in lexicon.exceptions)
    got = {r.doc_id: r for r in toxicity.scored(table(spark, rows), marked).collect()}
    assert all(got[i].predicted == t for i, _, t in labels)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, _ in labels)
    assert all(0 <= r.score <= 1 for r in got.values()) and got[None].predicted == 1 and not got[None].held_out
    assert got[905].score == got[906].score < 0.5
    kept = toxicity.without_toxic(table(spark, rows), marked)
    assert kept.columns == table(spark, rows).columns and kept.filter("doc_id < 400").count() == 300


def test_toxicity_without_labels_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.scored(table(spark, hard_rows()), none).collect()} == {0}
    assert toxicity.scored(table(spark, []), none).count() == 0
