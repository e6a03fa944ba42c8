"""Token ids of whole texts by public tokenizers, each distinct stretch encoded once per worker."""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space between two other characters.
_LONE = re.compile(r"(?<=\S) (?=\S)")
#: White space in RE2's notation, and two such characters in a row of which one is a space.
_SPACE = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_RUN = f"{_SPACE} | {_SPACE}"
#: A control character that parts words, and marks that close a word.
_PART, _CLOSING = "\x1e", ".,;:!?"
_KEPT, _LONGEST, _SLICE = 250_000, 256, 4 << 20


def slices(texts: pa.Array, size: int = _SLICE) -> Iterator[tuple[int, int]]:
    """(first, number) of runs of texts that hold about ``size`` bytes together, one text at least."""
    ends = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(ends):
        past = ends[at - 1] if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, past + size, "right")))
        yield at, stop - at
        at = stop


def joined(parts: list[bytes], codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the coded parts one after another, and how many each contributes."""
    flat = np.frombuffer(b"".join(parts), "<u4")
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
    begins = np.cumsum(sizes) - sizes
    own = sizes[codes]
    ends = np.cumsum(own)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(begins[codes] - (ends - own), own) + np.arange(total)], own


class Encoder:
    """Encodes texts with the tokenizers library, without special tokens.

    A text is cut where the tokenizer's own rules always begin a new piece, so the ids of
    the cuts joined are the ids of the text; each distinct cut of a batch is looked up once,
    and encoded once per worker. Byte-level tokenizers attach one space to the word after
    it: the cut is before a space that stands between two other characters. Tokenizers that
    drop white space are cut at it. Any other tokenizer, and a text that may hold a special
    token, is encoded whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.size = self.library.get_vocab_size()
        self.special = [t["content"] for t in spec.get("added_tokens") or []]
        cut = spec.get("pre_tokenizer") or {}
        parts = cut.get("pretokenizers") or [cut]
        first = parts[0]
        self.mode = "whole"
        if first.get("type") == "ByteLevel" and first.get("use_regex") and not first.get("add_prefix_space") and not spec.get("normalizer"):
            self.mode = "attached"
        elif first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert") and "\\s" in str(first.get("pattern")):
            self.mode = "dropped"
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}  # what was known before, given up when the next ones are as many
        self.lead = " " if self.mode == "attached" else ""
        self.tails: dict[str, bytes] = {}
        if self.mode == "attached":
            vocabulary = self.library.get_vocab()
            self.begins = np.zeros(max(vocabulary.values()) + 1, bool)
            self.begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True
        elif self.mode == "dropped":
            part = self.library.encode(_PART, add_special_tokens=False).ids
            self.part = part[0] if len(part) == 1 else -1
            self.mode = "dropped" if len(part) == 1 else "whole"

    def _ids(self, cuts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.library.encode_batch_fast(cuts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with their lead, sixty-four words to a text.

        Where words take a space before them, exactly the first token of a word begins with
        one. Elsewhere a control character stands between the words, and its token parts them.
        """
        attached = self.mode == "attached"
        if attached:
            plain = [k for k, w in enumerate(words) if w and " " not in w and not w[0].isspace() and not w[-1].isspace()]
        else:
            plain = [k for k, w in enumerate(words) if w and _PART not in w]
        out = [b""] * len(words)
        rest = sorted(set(range(len(words))) - set(plain))
        for k, b in zip(rest, self._ids([self.lead + words[k] for k in rest]), strict=True):
            out[k] = b
        groups = [plain[at : at + 64] for at in range(0, len(plain), 64)]
        texts = [("" if attached else f" {_PART}") + "".join([f" {words[k]}" if attached else f" {words[k]} {_PART}" for k in g]) for g in groups]
        for g, e in zip(groups, self.library.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            data = ids.tobytes()
            if attached:
                ends = (4 * np.flatnonzero(self.begins[ids])).tolist() + [len(data)]
                parts = [data[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            else:
                ends = (4 * np.flatnonzero(ids == self.part)).tolist()
                parts = [data[a + 4 : b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            for k, p in zip(g, parts, strict=True):
                out[k] = p
        return out

    def _remembered(self, words: list[str]) -> list[bytes]:
        """Ids of each word, with a space before it where the mode is to attach one.

        Letters with closing marks behind them are two pieces; the letters are looked up by themselves.
        """
        if len(self.known) > _KEPT:
            self.older, self.known = self.known, {}
        known = self.known
        found = list(map(known.get, words))
        missing = [k for k, b in enumerate(found) if b is None]
        for k, b in zip(missing, list(map(self.older.get, [words[k] for k in missing])), strict=True):
            if b is not None:
                found[k] = known[words[k]] = b
        new = [words[k] for k in missing if found[k] is None]
        if not new:
            return found
        stems = [w.rstrip(_CLOSING) for w in new]
        stems = [s if s.isalpha() else w for s, w in zip(stems, new, strict=True)]
        fresh = [s for s in dict.fromkeys(stems) if s not in known]
        for at in range(0, len(fresh), 8192):
            some = fresh[at : at + 8192]
            known.update(zip(some, self._ids_of_words(some), strict=True))
        for s, w in zip(stems, new, strict=True):
            if len(s) < len(w):
                tail = w[len(s) :]
                if tail not in self.tails:
                    self.tails[tail] = self._ids([tail])[0]
                known[w] = known[s] + self.tails[tail]
        found = [known[w] if b is None else b for w, b in zip(words, found, strict=True)]
        for w in (*fresh, *new):
            if len(w) > _LONGEST:
                known.pop(w, None)
        if len(self.tails) > 4096:
            self.tails.clear()
        return found

    def _apart(self, text: str) -> bytes:
        if self.mode == "whole" or any(s in text for s in self.special):
            return self._ids([text])[0]
        first, *rest = _LONE.split(text)
        return self._ids([first])[0] + b"".join(self._remembered(rest))

    def _together(self, texts: pa.Array) -> list[bytes]:
        attached = self.mode == "attached"
        lists = pc.split_pattern(texts, " ") if attached else pc.ascii_split_whitespace(texts)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        coded = pc.dictionary_encode(lists.flatten())
        codes = coded.indices.to_numpy().astype(np.int64)
        bounds -= bounds[0]
        parts = self._remembered(coded.dictionary.to_pylist())
        if attached:  # the first cut of a text has no space before it
            firsts, own = np.unique(codes[bounds[:-1]], return_inverse=True)
            codes[bounds[:-1]] = len(parts) + own
            parts += self._ids(coded.dictionary.take(pa.array(firsts)).to_pylist())
        ids, sizes = joined(parts, codes)
        ends = np.concatenate([[0], np.cumsum(sizes)])[bounds].tolist()
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        out: list[bytes] = []
        for at, n in slices(texts):
            some = texts.slice(at, n)
            apart = np.full(n, self.mode == "whole")
            for s in self.special:
                apart |= pc.match_substring(some, s).to_numpy(zero_copy_only=False)
            if self.mode == "attached":
                apart |= pc.match_substring_regex(some, _RUN).to_numpy(zero_copy_only=False)
            found = iter(self._together(some.filter(pa.array(~apart))) if not apart.all() else ())
            out += [self._apart(some[k].as_py()) if alone else next(found) for k, alone in enumerate(apart.tolist())]
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """The worker's own encoder for a tokenizer file."""
    return Encoder(path)


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordPieces:
    """Piece ids of single words by a sentencepiece vocabulary, remembered per worker."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.size = self.library.get_piece_size()
        self.known: dict[str, bytes] = {}

    def ids(self, words: list[str]) -> list[bytes]:
        """Ids of each word as little-endian unsigned 32-bit integers."""
        if len(self.known) > _KEPT:
            self.known.clear()
        known = self.known
        fresh = [w for w in dict.fromkeys(words) if w not in known]
        for at in range(0, len(fresh), 8192):
            some = fresh[at : at + 8192]
            for w, i in zip(some, self.library.encode(some, num_threads=1), strict=True):
                known[w] = np.array(i, "<u4").tobytes()
        found = [known[w] for w in words]
        for w in fresh:
            if len(w) > _LONGEST:
                del known[w]
        return found


@lru_cache(maxsize=2)
def word_pieces(path: str) -> WordPieces:
    return WordPieces(path)
