"""Language by hyperdimensional profiles (operator 11).

Every letter has a random vector of ``DIMENSIONS`` signs, drawn from its code point.  A
run of three letters a, b, c is bound into one vector by permuting (rolling) and
multiplying: ``roll(a, 2) * roll(b, 1) * c``.  A text's vector is the sum (bundle) of its
runs' vectors, a language's prototype the sum over all its training texts, and the answer
is the language whose prototype has the largest cosine with the text's vector.

Letters are what Unicode calls letters, lower-cased; everything else between two letters
is one border, which has a vector too, and a text starts and ends with a border.

Training uses every row with a text and a lang that isn't held out.  Bundling is a sum, so
tasks count the runs per language, Spark adds the counts by (language, run), and each run
is bound once per task for the whole corpus; only the prototypes (languages x dimensions,
at most ``MAX_LANGUAGES``) reach the driver.  Scoring happens where rows are read.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so is every
text where nothing was learned; a null doc_id counts as held out; a null lang is not
learned; equal cosines go to the first language in code-point order; a negative cosine
scores 0; repeated rows are learned and answered once each; long texts are counted in
pieces of ``PIECE`` characters with two symbols carried over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, slices, text_rows

DIMENSIONS = 1024
#: Bound of the prototypes that are sent to the tasks (32 MB).
MAX_LANGUAGES = 8_192
#: Bound vectors a worker keeps (32 MB); runs met after that are bound each time.
MAX_CACHED_RUNS = 32_768
PIECE = 1 << 20
UNKNOWN = "und"

_BORDER, _SHIFT = 0, 21


def held_out(doc_id) -> F.Column:
    """Rows whose crc32 of doc_id as text leaves 2 by four; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(True))


class Letters:
    """code point -> lower-cased letter (0: no letter), for whole arrays."""

    table: np.ndarray | None = None

    @classmethod
    def of(cls, points: np.ndarray) -> np.ndarray:
        if cls.table is None:
            cls.table = np.array([ord(c.lower()[0]) if (c := chr(p)).isalpha() else 0 for p in range(0x110000)], np.int64)
        return cls.table[points]


def run_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(runs of three symbols as one number each, how often), no runs for a text without a letter."""
    codes, counts, carry = [], [], np.array([_BORDER], np.int64)
    for at in range(0, len(text), PIECE):
        got = Letters.of(np.frombuffer(text[at : at + PIECE].encode("utf-32-le", "surrogatepass"), "<u4"))
        last = at + PIECE >= len(text)
        got = np.concatenate([carry, got, [_BORDER]] if last else [carry, got])
        got = got[np.r_[True, (got[1:] != _BORDER) | (got[:-1] != _BORDER)]]
        if len(got) > 2:
            some, n = np.unique(got[:-2] << 2 * _SHIFT | got[1:-1] << _SHIFT | got[2:], return_counts=True)
            codes.append(some)
            counts.append(n)
        carry = got[-2:]
    return merged(codes, counts)


def merged(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of equal codes added up."""
    if not codes:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(codes) == 1:
        return codes[0], counts[0]
    some, place = np.unique(np.concatenate(codes), return_inverse=True)
    total = np.zeros(len(some), np.int64)
    np.add.at(total, place, np.concatenate(counts))
    return some, total


def letter_vector(point: int, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signs of a letter: the same on every machine."""
    bits = np.random.PCG64(point).random_raw(dimensions // 64).astype("<u8")
    return (np.unpackbits(bits.view(np.uint8)).astype(np.int8) << 1) - 1


class Binder:
    """Bound vectors of runs, kept per worker."""

    def __init__(self, dimensions: int = DIMENSIONS, most: int = MAX_CACHED_RUNS):
        self.dimensions, self.most = dimensions, most
        self.letters: dict[int, int] = {}
        self.plain = np.zeros((0, dimensions), np.int8)
        self.places: dict[int, int] = {}
        self.kept = np.zeros((0, dimensions), np.int8)

    def _letters(self, points: np.ndarray) -> np.ndarray:
        """Vectors of letters; code points are at most 0x110000, a text's letters far fewer."""
        new = [p for p in np.unique(points).tolist() if p not in self.letters]
        if new:
            if len(self.letters) + len(new) > self.most:
                self.letters, self.plain, new = {}, self.plain[:0], np.unique(points).tolist()
            self.letters |= {p: len(self.letters) + k for k, p in enumerate(new)}
            self.plain = np.concatenate([self.plain, np.stack([letter_vector(p, self.dimensions) for p in new])])
        return self.plain[list(map(self.letters.__getitem__, points.tolist()))]

    def bind(self, codes: np.ndarray) -> np.ndarray:
        mask = (1 << _SHIFT) - 1
        a, b, c = (self._letters(codes >> s & mask) for s in (2 * _SHIFT, _SHIFT, 0))
        return np.roll(a, 2, 1) * np.roll(b, 1, 1) * c

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        at = [self.places.get(c, -1) for c in codes.tolist()]
        gaps = [k for k, p in enumerate(at) if p < 0]
        if not gaps:
            return self.kept[at]
        new = self.bind(codes[gaps])
        if len(self.places) + len(gaps) <= self.most:
            first = len(self.places)
            self.places |= {c: first + k for k, c in enumerate(codes[gaps].tolist())}
            if first + len(gaps) > len(self.kept):
                grown = np.zeros((min(self.most, max(1024, 2 * (first + len(gaps)))), self.dimensions), np.int8)
                grown[:first] = self.kept[:first]
                self.kept = grown
            self.kept[first : first + len(gaps)] = new
            return self.kept[list(map(self.places.__getitem__, codes.tolist()))]
        out = self.kept[[max(p, 0) for p in at]] if len(self.kept) else np.zeros((len(codes), self.dimensions), np.int8)
        out[gaps] = new
        return out

    def bundle(self, codes: np.ndarray, counts: np.ndarray, at_once: int = 2048) -> np.ndarray:
        """Sum of the runs' vectors; whole numbers, so exact in any order (float32 below 2**24 runs)."""
        kind = np.float32 if counts.sum() < 1 << 24 else np.float64
        out = np.zeros(self.dimensions, np.float64)
        for i in range(0, len(codes), at_once):
            out += counts[i : i + at_once].astype(kind) @ self.vectors(codes[i : i + at_once]).astype(kind)
        return out


_BINDERS: dict[int, Binder] = {}


def binder(dimensions: int = DIMENSIONS) -> Binder:
    return _BINDERS.setdefault(dimensions, Binder(dimensions))


def _count_rows(batches: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """(lang, run, n) of a task's training texts, added up before anything moves."""

    def rows() -> Iterator[pa.RecordBatch]:
        for lang, (codes, counts) in held.items():
            for i in range(0, len(codes), 100_000):
                n = len(codes[i : i + 100_000])
                yield pa.RecordBatch.from_arrays([pa.array([lang] * n, pa.string()), pa.array(codes[i : i + 100_000]), pa.array(counts[i : i + 100_000])], names=["lang", "run", "n"])

    held: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    for b in slices(batches, "text"):
        found: dict[str, tuple[list, list]] = {k: ([c], [n]) for k, (c, n) in held.items()}
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            codes, counts = run_counts(text)
            some = found.setdefault(lang, ([], []))
            some[0].append(codes)
            some[1].append(counts)
        held = {k: merged(*v) for k, v in found.items()}
        if sum(len(c) for c, _ in held.values()) > most:
            yield from rows()
            held = {}
    yield from rows()


def _sum_rows(dimensions: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(lang, place, value) of a task's part of each prototype."""
        total: dict[str, np.ndarray] = {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            codes, counts = b.column(1).to_numpy(), b.column(2).to_numpy()
            for lang in set(langs.tolist()):
                own = langs == lang
                total[lang] = total.get(lang, 0) + binder(dimensions).bundle(codes[own], counts[own])
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dimensions, pa.string()), pa.array(np.arange(dimensions, dtype=np.int32)), pa.array(v)], names=["lang", "place", "value"])

    return run


def prototypes(docs: DataFrame, dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    """Languages in order and one row of unit length each, learned from the rows that aren't held out."""
    rows = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").cast("string").alias("lang"), "text")
    counts = materialise(rows.mapInArrow(_count_rows, "lang string, run long, n long").groupBy("lang", "run").agg(F.sum("n").alias("n")), "language-runs")
    known = counts.select("lang").distinct().count()
    if known > MAX_LANGUAGES:
        raise ValueError(f"lang has {known} values; prototypes are sent to every task for {MAX_LANGUAGES} at most")
    got = counts.mapInArrow(_sum_rows(dimensions), "lang string, place int, value double").groupBy("lang", "place").agg(F.sum("value").alias("value")).collect()
    langs = sorted({r.lang for r in got})
    where = {lang: k for k, lang in enumerate(langs)}
    out = np.zeros((len(langs), dimensions))
    for r in got:
        out[where[r.lang], r.place] = r.value
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def answer(text: str | None, langs: list[str], table: np.ndarray) -> tuple[str, float]:
    """Language of the largest cosine and that cosine."""
    codes, counts = run_counts(text or "")
    if not len(codes) or not langs:
        return UNKNOWN, 0.0
    v = binder(table.shape[1]).bundle(codes, counts)
    near = table @ v / max(np.linalg.norm(v), 1e-300)
    best = int(np.argmax(near))
    return langs[best], float(np.clip(near[best], 0.0, 1.0))


def languages(docs: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every document."""
    langs, table = prototypes(docs, dimensions)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            got = [answer(t, langs, table) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=["doc_id", "lang_pred", "score"])

    found = text_rows(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
