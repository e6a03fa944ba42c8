"""Cross-entropy difference of two n-gram models that share one vocabulary."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgermesh.llm.common import batches_of_rows, stage, text_of
from ledgermesh.llm.tokens import joined, slices, word_pieces

COUNT_ARROW = pa.schema([("pair", pa.int64()), ("background", pa.int64()), ("target", pa.int64())])
COUNT = "pair long, background long, target long"
LOSS_ARROW = pa.schema([("pair", pa.int64()), ("background", pa.float64()), ("target", pa.float64())])
LOSS = "pair long, background double, target double"
LOCAL_ARROW = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("background", pa.float64()), ("target", pa.float64()),
    ("rest", pa.list_(pa.struct([("pair", pa.int64()), ("n", pa.int32())]))),
])
LOCAL = "row long, doc_id long, n_tokens long, background double, target double, rest array<struct<pair: long, n: int>>"
_LOW = 0xFFFFFFFF


@dataclass(frozen=True)
class Unigrams:
    """What is bounded by the vocabulary: counts of tokens and of contexts, per model (background, target)."""

    tokens: np.ndarray  # (2, vocabulary)
    contexts: np.ndarray  # (2, vocabulary + 1), the last is the beginning of a text
    strength: float

    def losses(self, pairs: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Negative log probabilities (2, n) of token pairs; without counts those of pairs never seen."""
        before, token = pairs >> 32, pairs & _LOW
        size = self.tokens.shape[1]
        base = (self.tokens[:, token] + 1.0) / (self.tokens.sum(1, keepdims=True) + size)
        seen = 0.0 if counts is None else counts
        return -np.log((seen + self.strength * base) / (self.contexts[:, before] + self.strength))


def _pairs(texts: pa.Array, pieces) -> tuple[np.ndarray, np.ndarray]:
    """Token pairs of some texts, each beginning after a mark of its own, and the number of pairs of each."""
    lists = pc.ascii_split_whitespace(texts)
    bounds = lists.offsets.to_numpy().astype(np.int64)
    coded = pc.dictionary_encode(lists.flatten())
    ids, sizes = joined(pieces.ids(coded.dictionary.to_pylist()), coded.indices.to_numpy().astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(sizes)])[bounds - bounds[0]]
    ids = ids.astype(np.int64)
    before = np.empty_like(ids)
    before[1:] = ids[:-1]
    lengths = np.diff(ends)
    before[ends[:-1][lengths > 0]] = pieces.size
    return (before << 32) | ids, lengths


def _counted(vocabulary: str, flush: int = 4_000_000):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = word_pieces(vocabulary)
        held: tuple[list[np.ndarray], list[np.ndarray]] = ([], [])
        total = 0

        def table() -> pa.RecordBatch:
            every, n = np.unique(np.concatenate(held[0]), return_counts=True)
            target = np.zeros(len(every), np.int64)
            if held[1]:
                own, m = np.unique(np.concatenate(held[1]), return_counts=True)
                target[np.searchsorted(every, own)] = m
            return pa.RecordBatch.from_arrays([pa.array(every), pa.array(n.astype(np.int64)), pa.array(target)], schema=COUNT_ARROW)

        for batch in batches:
            for at, n in slices(batch.column(0)):
                some = batch.slice(at, n)
                pairs, lengths = _pairs(some.column(0), pieces)
                held[0].append(pairs)
                held[1].append(pairs[np.repeat(some.column(1).to_numpy(zero_copy_only=False).astype(bool), lengths)])
                total += len(pairs)
                if total >= flush:
                    yield table()
                    held, total = ([], []), 0
        if total:
            yield table()

    return rows


def _with_losses(unigrams: Unigrams):
    """Losses of seen pairs, less those of the same pair unseen."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs, background, target = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            gain = unigrams.losses(pairs, np.stack([background, target])) - unigrams.losses(pairs)
            yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(gain[0]), pa.array(gain[1])], schema=LOSS_ARROW)

    return rows


def _local(vocabulary: str, unigrams: Unigrams, frequent: np.ndarray, gains: np.ndarray):
    """Per text: summed losses as far as the frequent pairs tell, and its other pairs."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, first = word_pieces(vocabulary), TaskContext.get().partitionId() << 40

        def each() -> Iterator[tuple]:
            row = first
            for batch in batches:
                for at, n in slices(batch.column(1)):
                    some = batch.slice(at, n)
                    pairs, lengths = _pairs(some.column(1), pieces)
                    kinds, own = np.unique(pairs, return_inverse=True)
                    loss = unigrams.losses(kinds)
                    known = np.zeros(len(kinds), bool)
                    if len(frequent) and len(kinds):
                        place = np.minimum(np.searchsorted(frequent, kinds), len(frequent) - 1)
                        known = frequent[place] == kinds
                        loss[:, known] += gains[:, place[known]]
                    doc = np.repeat(np.arange(n), lengths)
                    totals = [np.bincount(doc, weights=loss[m][own], minlength=n).tolist() for m in (0, 1)]
                    open_ = ~known[own]
                    size = max(1, len(kinds))
                    rest, times = np.unique(doc[open_] * size + own[open_], return_counts=True)
                    cuts = np.searchsorted(rest // size, np.arange(n + 1)).tolist()
                    found, times = kinds[rest % size].tolist() if len(rest) else [], times.tolist()
                    for k, doc_id in enumerate(some.column(0).to_pylist()):
                        own_rest = [{"pair": p, "n": t} for p, t in zip(found[cuts[k] : cuts[k + 1]], times[cuts[k] : cuts[k + 1]], strict=True)]
                        yield row, doc_id, int(lengths[k]), totals[0][k], totals[1][k], own_rest or None
                        row += 1

        yield from batches_of_rows(each(), LOCAL_ARROW, 1024)

    return rows


def cross_entropy_difference(
    docs: DataFrame, target_ids: DataFrame, vocabulary: str, strength: float = 50.0, shared_pairs: int = 1 << 20,
) -> DataFrame:
    """One row per input row: (doc_id, n_tokens, target_loss, background_loss, difference).

    Two bigram models over the tokens of one public ``vocabulary`` (a sentencepiece file,
    applied to words) are alike in order and smoothing (Dirichlet, ``strength`` pseudo
    counts spread as the unigrams are); they differ in what is counted: the background
    counts all of ``docs``, the target the rows whose doc_id is in ``target_ids``. Losses
    are nats per token, ``difference`` is target less background: the lower, the more a
    text is like the target. Texts of the target are part of what its model counted.

    All pairs of all texts are counted, folded per task and summed across the cluster; the
    table of pairs grows with the corpus and stays distributed. Pairs that make up one in
    ``shared_pairs`` of all tokens or more, of which there can be no more than
    ``shared_pairs``, are sent to every task; the other pairs of each text meet their
    counts in a join, where no key has more rows than that share. Only counts per token of
    the vocabulary pass the driver besides.

    Null texts and texts without a word have no tokens and null losses. Rows without doc_id
    are scored and never part of the target. Repeated rows are counted and scored each; an
    empty target leaves its model to its pseudo counts; an empty table gives no rows. Other
    columns are ignored.
    """
    texts = docs.select("doc_id", text_of().alias("text"))
    chosen = target_ids.select(F.col("doc_id").alias("_target")).distinct()
    marked = texts.join(chosen.hint("merge"), F.col("doc_id") == F.col("_target"), "left").select("text", F.col("_target").isNotNull())
    counts = marked.mapInArrow(_counted(vocabulary), COUNT).groupBy("pair").agg(
        F.sum("background").alias("background"), F.sum("target").alias("target")
    )
    pairs = stage(counts, "token-pairs")
    size = word_pieces(vocabulary).size

    def totals(key) -> np.ndarray:
        out = np.zeros((2, size + 1))
        summed = pairs.groupBy(key.alias("id")).agg(F.sum("background").alias("b"), F.sum("target").alias("t"))
        for r in summed.collect():  # no more rows than the vocabulary has tokens
            out[:, r.id] = r.b, r.t
        return out

    unigrams = Unigrams(totals(F.col("pair").bitwiseAND(_LOW))[:, :size], totals(F.shiftright("pair", 32)), strength)
    least = unigrams.tokens[0].sum() / shared_pairs
    often = pairs.filter(F.col("background") >= least).mapInArrow(_with_losses(unigrams), LOSS).toArrow()  # shared_pairs rows at most
    order = np.argsort(often["pair"].to_numpy())
    frequent = often["pair"].to_numpy()[order]
    gains = np.stack([often[c].to_numpy()[order] for c in ("background", "target")])
    local = stage(texts.mapInArrow(_local(vocabulary, unigrams, frequent, gains), LOCAL), "local-losses")
    seldom = pairs.filter(F.col("background") < least).mapInArrow(_with_losses(unigrams), LOSS)
    rest = local.select("row", F.explode("rest").alias("own")).select("row", "own.pair", "own.n")
    found = rest.join(stage(seldom, "seldom-pairs"), "pair").groupBy("row").agg(
        F.sum(F.col("n") * F.col("background")).alias("more_background"), F.sum(F.col("n") * F.col("target")).alias("more_target")
    )
    joined = local.drop("rest").join(found, "row", "left")
    n = F.when(F.col("n_tokens") > 0, F.col("n_tokens"))
    of = {m: (F.col(m) + F.coalesce(f"more_{m}", F.lit(0.0))) / n for m in ("background", "target")}
    return joined.select(
        "doc_id", "n_tokens", of["target"].alias("target_loss"), of["background"].alias("background_loss"),
        (of["target"] - of["background"]).alias("difference"),
    )
