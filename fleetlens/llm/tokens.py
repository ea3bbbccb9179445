"""Whole-text encoding with the `tokenizers` library, cached per word.

Byte-pair merges never cross the pre-tokenizer's borders, so the ids of a text
are the ids of its words one after another.  A worker keeps the ids of the words
it has met (bounded) and asks the library only for new ones: one lookup a word.
A text whose white space the simple split can't prove safe goes to the library
whole, so ids always equal ``Tokenizer.encode(text, add_special_tokens=False)``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np

#: Words kept per worker and vocabulary; what is met after that is encoded each time.
MAX_CACHED_WORDS = 1_200_000

#: White space other than blank and line feed, and the four separators that Python alone counts as white space.
_RARE_SPACE = re.compile("[\t\x0b\x0c\r\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
_SEPARATORS = re.compile("[\x1c-\x1f]")


class WordCache(dict):
    """word -> ids as little-endian bytes, filled by a bulk encoder.

    When it is full, words met later are encoded for their slice and not kept: the
    words met first are the frequent ones.
    """

    def __init__(self, encode: Callable[[list[str]], list[bytes]], limit: int = MAX_CACHED_WORDS):
        super().__init__()
        self.encode, self.limit = encode, limit

    def bulk(self, texts: list[list[str]]) -> list[bytes]:
        found = [list(map(self.get, words)) for words in texts]
        gaps = [[i for i, x in enumerate(ids) if x is None] for ids in found]
        todo = list({words[i] for words, at in zip(texts, gaps) for i in at})
        if todo:
            new = dict(zip(todo, self.encode(todo)))
            for words, ids, at in zip(texts, found, gaps):
                for i in at:
                    ids[i] = new[words[i]]
            if len(self) + len(new) <= self.limit:
                self.update(new)
        return [b"".join(ids) for ids in found]


#: Marks the first word of a text, which has no blank before it.
FIRST = "\x1c"
#: Stands between words that are encoded in one call; no word with it is ever joined.
BETWEEN = "\x1d"


def blank_words(text: str) -> list[str] | None:
    """Words of a vocabulary that joins one blank to the word after it; None if some white space run needs the whole text.

    With every blank standing alone between two other characters, each piece from
    one blank to the next is pre-tokenized by itself (a leading apostrophe could bind
    to the mark between words).  The blank is left out here
    and put back when a word is encoded.
    """
    if "  " in text or "\n " in text or " \n" in text or text[-1:].isspace() or text[:1] == "'" or _RARE_SPACE.search(text):
        return None
    words = text.split(" ")
    words[0] = FIRST + words[0]
    return words


def spaced_words(text: str) -> list[str] | None:
    """Words of a vocabulary that drops white space; None if Python and the library disagree on what that is."""
    return None if _SEPARATORS.search(text) else text.split()


class Encoder:
    """Encodes texts to id bytes (``dtype``); one per worker and file, see ``encoder``."""

    def __init__(self, path: str, split: Callable[[str], list[str] | None]):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.split = split
        # white space drops more from the words of one vocabulary, so fewer are met
        self.cache = WordCache(self._words, MAX_CACHED_WORDS if split is blank_words else MAX_CACHED_WORDS // 2)
        self.joint = f" {BETWEEN} " if split is spaced_words else BETWEEN
        mark = self.library.encode(BETWEEN, add_special_tokens=False)
        alone = [t for t in self.library.get_vocab() if mark.tokens[0].removesuffix("</w>") in t.removesuffix("</w>")]
        #: Words can share a call only if the mark is one token that no merge takes up.
        self.mark = mark.ids[0] if len(mark.ids) == 1 and len({t.removesuffix("</w>") for t in alone}) == 1 else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype)

    def _words(self, words: list[str], at_once: int = 2000) -> list[bytes]:
        real = words if self.split is spaced_words else [w[1:] if w[:1] == FIRST else " " + w for w in words]
        out: list[bytes] = []
        for i in range(0, len(real), at_once):
            some = real[i : i + at_once]
            ids = None
            if self.mark is not None:
                ids = self._ids(self.joint.join(some))
                cuts = np.flatnonzero(ids == self.mark)
            if ids is None or len(cuts) != len(some) - 1:
                out += [self._ids(w).tobytes() for w in some]
                continue
            raw, n = ids.tobytes(), self.dtype.itemsize
            begin = np.r_[0, cuts + 1] * n
            end = np.r_[cuts, len(ids)] * n
            out += [raw[a:b] for a, b in zip(begin.tolist(), end.tolist())]
        return out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        words = [self.split(t) for t in texts]
        out = self.cache.bulk([w if w is not None else [] for w in words])
        return [np.frombuffer(x, self.dtype) if w is not None else self._ids(t) for x, w, t in zip(out, words, texts)]


_ENCODERS: dict[tuple, Encoder] = {}


def encoder(path: str, split: Callable[[str], list[str] | None]) -> Encoder:
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    key = (path, split.__name__)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, split)
    return _ENCODERS[key]


def encode_slices(batches: Iterable, path: str, split: Callable[[str], list[str] | None], end_id: int = 0) -> Iterator[tuple[list, list[np.ndarray]]]:
    """(doc_ids, ids with the end id) per slice of the incoming batches."""
    from fleetlens.llm.common import slices

    enc = encoder(path, split)
    end = np.array([end_id], enc.dtype)
    for b in slices(batches):
        yield b.column(0).to_pylist(), [np.concatenate([ids, end]) for ids in enc.encode(b.column(1).to_pylist())]


def crc32_u32(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    import zlib

    return zlib.crc32(ids.astype("<u4").tobytes())
