"""Toxicity by a factorization machine over hashed terms (operator 1).

Terms of a text are its distinct lower-cased words and the words' first four to six
letters (compound and inflected forms share them), hashed to 64 bits.  A term becomes a
feature, with a linear weight and a short factor vector, if over the training rows

* it tells the classes apart by itself (chi-squared of its counts per class), or
* it tells them apart beside a chosen term, among the rows that hold that term (one in
  ``BESIDE_SHARE`` of the rows that raises or lowers the odds but doesn't decide alone) and
  nearly as well as the best such term, or
* it is common (``PAIR_SHARE`` of the rows) and a pair of common terms tells more than its
  two terms do (chi-squared of the pair's four cells less those of its terms).

Everything that passes is a feature; what can pass is bounded by the training rows.  The
score has a learned weight for every pair of features that meet in a text (an insult with a
group mention), which no sum of single weights can express:

    y(x) = w0 + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j

Training takes a bounded sample of labelled rows (``MAX_TRAINING_ROWS``, the first in the
order of a hash of doc_id); scoring takes every row and whole texts, in the tasks that read
them, without a shuffle.

Edge cases: null or empty text has no terms and gets the bias alone; a doc_id that is
labelled more than once counts as toxic if any label says so, one that has several texts is
learned from the first of them; null labels are left out; with no labelled rows, or one
class only, every score is the share of toxic labels (0 without labels); terms that tell
equally much are all chosen; repeated rows are scored once each.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetlens.llm.common import materialise, shuffle_width, slices, text_rows

#: Labelled rows the machine is trained on at most.
MAX_TRAINING_ROWS = 16_384
#: A term must be in this many training rows, and its chi-squared (one degree of freedom) be this large.
MIN_DOCUMENTS, MIN_CHI = 5, 15.0
#: The same beside another term and for a pair, of which there are many more to choose from by chance; there this many
#: rows of each class must be expected, below which chi-squared says nothing.
MIN_PAIR_CHI, MIN_EXPECTED = 35.0, 5.0
#: Share of the training rows that each term of a pair must be in where neither was chosen, and that a chosen term
#: must be in to be looked beside: pairs in fewer rows tell too little to be sure of.
PAIR_SHARE, BESIDE_SHARE = 0.1, 0.01
#: Of the terms that tell beside a chosen one, those count that tell this much of what the best of them does.
BESIDE_BEST = 0.5
#: A chosen term decides alone beyond this share of one class among its rows; it matters beside others if it raises
#: (or lowers) the odds this many times.
DECIDES, RAISES = 0.95, 3.0
FACTORS = 8

_WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id) -> F.Column:
    """Every fifth row by crc32 of doc_id as text; a null doc_id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


def terms(text: str) -> set[str]:
    """Distinct words and word beginnings (marked by a trailing hyphen)."""
    words = set(_WORD.findall(text.lower()))
    return words | {w[:k] + "-" for w in words for k in (4, 5, 6) if len(w) > k}


@dataclass
class Model:
    """Feature number by term hash, and the machine's weights."""

    features: dict[int, int]
    bias: float
    weights: np.ndarray
    factors: np.ndarray
    cache: dict[str, tuple[int, ...]] = field(default_factory=dict)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"cache": {}}

    def _of_word(self, word: str) -> tuple[int, ...]:
        """Features of a word and its beginnings (bounded memo; most words have none)."""
        forms = [word, *(word[:k] + "-" for k in (4, 5, 6) if len(word) > k)]
        found = tuple(i for i in (self.features.get(_hash(f)) for f in forms) if i is not None)
        if len(self.cache) > 200_000:
            self.cache.clear()
        self.cache[word] = found
        return found

    def active(self, text: str) -> list[int]:
        """Numbers of the features a text has, ascending."""
        get, out = self.cache.get, set()
        for w in set(_WORD.findall(text.lower())):
            got = get(w)
            if got is None:
                got = self._of_word(w)
            if got:
                out.update(got)
        return sorted(out)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-self.raw(self.active(text)))))

    def raw(self, active: list[int]) -> float:
        if not active:
            return self.bias
        v = self.factors[active]
        total = v.sum(0)
        pairs = 0.5 * float(total @ total - (v * v).sum())
        return float(np.clip(self.bias + self.weights[active].sum() + pairs, -30, 30))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """doc_id, toxic, text of a bounded sample of the rows that aren't held out: one text a doc_id."""
    labelled = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max((F.col("toxic") != 0).cast("int")).alias("toxic"))
    sample = labelled.where(~held_out(F.col("doc_id"))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    joined = text_rows(docs).join(F.broadcast(sample), "doc_id")  # at most `most` rows of two numbers
    one = joined.groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    return one.repartition(shuffle_width(docs.sparkSession), "doc_id")  # few bytes, but each is read often: as many tasks as there may be


def _counted(counts: Counter, clean_and_toxic: Counter) -> pa.RecordBatch:
    keys = list(counts)
    n = [counts[k] for k in keys]
    t = [clean_and_toxic[k] for k in keys]
    first, second = zip(*keys) if keys else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(first, pa.int64()), pa.array(second, pa.int64()), pa.array(n, pa.int64()), pa.array(t, pa.int64())], names=["beside", "term", "n", "toxic"])


COUNTS = "beside long, term long, n long, toxic long"


def _term_rows(beside: frozenset[int] | None):
    """(beside, term, rows, toxic rows), counted over a task's rows before anything moves: of every term (beside null),
    or of the terms in rows that hold one of ``beside``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            counts, toxic = Counter(), Counter()
            for text, bad in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                own = {_hash(t) for t in terms(text)}
                keys = [(None, t) for t in own] if beside is None else [(a, t) for a in own & beside for t in own if t != a]
                counts.update(keys)
                if bad:
                    toxic.update(keys)
            yield _counted(counts, toxic)

    return run


def _chi(n, t, rows, toxic) -> F.Column:
    """Chi-squared (one degree of freedom) of ``t`` toxic among ``n`` rows against ``toxic`` among ``rows``."""
    n, t, rows, toxic = (c.cast("double") for c in (n, t, rows, toxic))
    off = t * (rows - toxic - (n - t)) - (n - t) * (toxic - t)
    return F.try_divide(rows * off * off, n * (rows - n) * toxic * (rows - toxic))


def _pair_tables(common: list[int]):
    """(term, packed rows and packed toxic rows of it with each common term) of a task's rows: one row per common term."""
    place = {h: i for i, h in enumerate(common)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        every, bad = (np.zeros((len(common), len(common)), np.float32) for _ in range(2))
        for b in slices(batches):
            x = np.zeros((b.num_rows, len(common)), np.float32)
            for r, text in enumerate(b.column(1).to_pylist()):
                x[r, [i for t in terms(text) if (i := place.get(_hash(t))) is not None]] = 1
            y = x[b.column(2).to_numpy() == 1]
            every += x.T @ x  # below 2**24 rows, so whole numbers stay exact
            bad += y.T @ y
        packed = lambda m: pa.array([row.astype("<u4").tobytes() for row in m], pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(range(len(common)), pa.int32()), packed(every), packed(bad)], names=["term", "every", "bad"])

    return run


def _telling_pairs(common: list[int], rows: int, toxic: int, alone: np.ndarray):
    """Places of the common terms that tell the classes apart in a pair and not by themselves (``alone``: their own chi-squared, n, toxic n)."""

    def chi_of(n, t):
        expected = n * toxic / rows
        return np.where(n > 0, (t - expected) ** 2 / np.maximum(expected * (1 - toxic / rows), 1e-9), 0.0)

    def run(table: pa.Table) -> pa.Table:
        every, bad = (sum(np.frombuffer(x, "<u4").astype(np.float64) for x in table.column(c).to_pylist()) for c in ("every", "bad"))
        i = table.column("term")[0].as_py()
        n, t = alone[:, 1], alone[:, 2]
        cells = chi_of(every, bad) + chi_of(n[i] - every, t[i] - bad) + chi_of(n - every, t - bad) + chi_of(rows - n[i] - n + every, toxic - t[i] - t + bad)
        more = cells - alone[i, 0] - alone[:, 0]
        more[i] = 0
        told = np.flatnonzero((more >= MIN_PAIR_CHI) & (every * min(toxic, rows - toxic) >= MIN_EXPECTED * rows))
        return pa.table({"term": pa.array([common[k] for k in ([i, *told] if len(told) else [])], pa.int64())})

    return run


def choose_features(rows: DataFrame, clean: int, toxic: int) -> list[int]:
    """Hashes of the terms that tell the classes apart, alone or beside another (see the module)."""
    texts, total = rows.select("doc_id", "text", "toxic"), clean + toxic
    lit = lambda x: F.lit(float(x))
    counts = materialise(texts.mapInArrow(_term_rows(None), COUNTS).groupBy("term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t"))
                         .where((F.col("n") >= MIN_DOCUMENTS) & (F.col("n") < total))
                         .withColumn("chi", F.coalesce(_chi(F.col("n"), F.col("t"), lit(total), lit(toxic)), F.lit(0.0))), "toxicity-terms")
    chosen = {r.term: r for r in counts.where(F.col("chi") >= MIN_CHI).collect()}  # bounded by the training rows' terms
    open_ = frozenset(h for h, r in chosen.items() if min(r.t, r.n - r.t) > (1 - DECIDES) * r.n and r.n >= BESIDE_SHARE * total
                      and not 1 / RAISES < r.t * clean / ((r.n - r.t) * toxic) < RAISES)
    if open_:
        near = texts.mapInArrow(_term_rows(open_), COUNTS).groupBy("beside", "term").agg(F.sum("n").alias("n"), F.sum("toxic").alias("t")).where(F.col("n") >= MIN_DOCUMENTS)
        held = rows.sparkSession.createDataFrame([(h, chosen[h].n, chosen[h].t) for h in sorted(open_)], "beside long, held long, held_toxic long")
        share = F.col("held_toxic") / F.col("held")
        expected = F.col("n") * F.least(share, 1 - share)
        told = near.join(F.broadcast(held), "beside").where(expected >= MIN_EXPECTED).withColumn("chi", _chi(F.col("n"), F.col("t"), F.col("held"), F.col("held_toxic")))
        told = materialise(told.where(F.col("chi") >= MIN_PAIR_CHI).select("beside", "term", "chi"), "toxicity-beside")
        best = told.groupBy("beside").agg(F.max("chi").alias("best"))
        chosen |= dict.fromkeys(r.term for r in told.join(best, "beside").where(F.col("chi") >= BESIDE_BEST * F.col("best")).select("term").distinct().collect())
    frequent = counts.where((F.col("n") >= PAIR_SHARE * total) & (F.col("n") <= (1 - PAIR_SHARE) * total)).orderBy("term").collect()  # texts' length / PAIR_SHARE
    if len(frequent) > 1:
        common, alone = [r.term for r in frequent], np.array([(r.chi, r.n, r.t) for r in frequent], float)
        tables = texts.mapInArrow(_pair_tables(common), "term int, every binary, bad binary")
        told = tables.groupBy("term").applyInArrow(_telling_pairs(common, total, toxic, alone), "term long").distinct()
        chosen |= dict.fromkeys(r.term for r in told.collect())
    return sorted(chosen)


def fit(active: list[list[int]], toxic: np.ndarray, n_features: int, epochs: int = 12, seed: int = 7) -> tuple[float, np.ndarray, np.ndarray]:
    """AdaGrad on the logistic loss; a fixed seed and order, so equal inputs give equal weights."""
    rng = np.random.default_rng(seed)
    share = toxic.mean()
    bias, w, v = float(np.log(share / (1 - share))), np.zeros(n_features), rng.normal(0, 0.01, (n_features, FACTORS))
    bias_g, w_g, v_g = 1e-6, np.full(n_features, 1e-6), np.full((n_features, FACTORS), 1e-2)
    rate, decay = 0.2, 1e-3
    for _ in range(epochs):
        for i in rng.permutation(len(active)).tolist():
            a = active[i]
            if a:
                va = v[a]
                total = va.sum(0)
                y = bias + w[a].sum() + 0.5 * float(total @ total - (va * va).sum())
            else:
                y = bias
            g = 1 / (1 + np.exp(-np.clip(y, -30, 30))) - toxic[i]
            bias_g += g * g
            bias -= 0.05 * g / np.sqrt(bias_g)
            if a:
                gw = g + decay * w[a]
                w_g[a] += gw * gw
                w[a] -= rate * gw / np.sqrt(w_g[a])
                gv = g * (total - va) + decay * va
                v_g[a] += gv * gv
                v[a] -= 0.02 * gv / np.sqrt(v_g[a])
    return bias, w, v


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAINING_ROWS) -> Model:
    """The model from at most ``most`` labelled rows; the driver gets their feature numbers and labels, no texts."""
    rows = materialise(training_rows(docs, labels, most), "toxicity-training")
    n = {r.toxic: r.n for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    clean, toxic = sum(c for k, c in n.items() if k != 1), n.get(1, 0)
    share = toxic / max(1, clean + toxic)
    if not clean or not toxic:
        limit = float(np.clip(np.log(max(share, 1e-9) / max(1 - share, 1e-9)), -30, 30))
        return Model({}, limit, np.zeros(0), np.zeros((0, FACTORS)))
    model = Model({h: i for i, h in enumerate(choose_features(rows, clean, toxic))}, 0.0, np.zeros(0), np.zeros((0, FACTORS)))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([model.active(t) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))], names=["doc_id", "toxic", "active"])

    got = rows.select("doc_id", "text", "toxic").mapInArrow(features, "doc_id long, toxic int, active array<int>").orderBy("doc_id", "active").collect()
    model.bias, model.weights, model.factors = fit([r.active for r in got], np.array([float(r.toxic == 1) for r in got]), len(model.features))
    return model


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and toxic_score: computed where rows are read, a slice of a batch at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [model.score(t or "") for t in b.column(b.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.float64())], names=[*b.schema.names, "toxic_score"])

    kind = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType())])
    return docs.mapInArrow(run, kind)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document."""
    model = train(docs, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([model.score(t) for t in b.column(1).to_pylist()], pa.float64())], names=["doc_id", "score"])

    scored = text_rows(docs).mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
