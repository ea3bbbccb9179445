"""Operators 11 to 13 against plain versions, on odd rows and on the smallest tables."""

import hashlib
import math
import os
import re
import sys
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from fleetlens.checks.compare import compare, duck  # noqa: E402
from fleetlens.llm import language, queries, ranked, resampling  # noqa: E402
from fleetlens.session import ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def benchmark_rows(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


# op11 -----------------------------------------------------------------------------------------------


def plain_runs(text):
    s = re.sub(r"[\W\d_]+", "\0", (text or "").lower())
    s = "\0" + s.strip("\0") + "\0"
    return Counter(s[k : k + 3] for k in range(len(s) - 2)) if len(s) > 2 else Counter()


def plain_vector(runs, dimensions=language.DIMENSIONS):
    out = np.zeros(dimensions)
    for r, n in runs.items():
        a, b, c = (language.letter_vector(ord(x), dimensions).astype(int) for x in r)
        out += n * np.roll(a, 2) * np.roll(b, 1) * c
    return out


def test_languages_equal_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = docs.collect()
    held = {r.doc_id: zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in rows}
    langs = {}
    for r in rows:
        if not held[r.doc_id] and r.lang is not None and r.text is not None:
            langs.setdefault(r.lang, Counter()).update(plain_runs(r.text))
    names = sorted(langs)
    table = np.array([plain_vector(langs[k]) for k in names])
    table /= np.linalg.norm(table, axis=1, keepdims=True)
    got = {r.doc_id: r for r in queries.op11_language(spark, SF).collect()}
    assert len(got) == len(rows)
    right = total = 0
    for r in rows:
        runs, g = plain_runs(r.text), got[r.doc_id]
        assert g.held_out == held[r.doc_id]
        if not runs:
            assert (g.lang_pred, g.score) == ("und", 0.0)
            continue
        near = table @ plain_vector(runs) / np.linalg.norm(plain_vector(runs))
        assert g.lang_pred == names[int(near.argmax())] and abs(g.score - max(0, near.max())) < 1e-9
        right += held[r.doc_id] and g.lang_pred == r.lang
        total += held[r.doc_id]
    assert right >= 0.95 * total > 0


def test_run_counts_in_pieces_and_odd_letters(monkeypatch):
    for text in ("", "123 -- !", "a", "Été à l'école", "İstanbul straße", "日本語 テキスト", "x" * 1000, "ab\ud800cd", "a 1 b 2 c", " lead and trail "):
        want = {tuple(map(ord, k)): n for k, n in plain_runs(text).items()}
        for piece in (1 << 20, 1, 2, 3):
            monkeypatch.setattr(language, "PIECE", piece)
            codes, counts = language.run_counts(text)
            mask = (1 << 21) - 1
            got = {(c >> 42, c >> 21 & mask, c & mask): n for c, n in zip(codes.tolist(), counts.tolist())}
            if "İ" not in text:  # lower-cased to two code points, of which the first counts here
                assert got == want, (text, piece)


def test_binder_beyond_its_cache_gives_the_same_vectors():
    codes, _ = language.run_counts("the quick brown fox jumps over the lazy dog " * 3)
    small, large = language.Binder(most=8), language.Binder()
    for some in (codes[:4], codes, codes[2:30]):
        assert (small.vectors(some) == large.vectors(some)).all()


def test_languages_of_odd_rows(spark):
    got = language.languages(brute.odd_docs(spark)).collect()
    assert len(got) == 19
    for r in got:
        assert 0 <= r.score <= 1 and r.lang_pred in ("en", "und")
        if r.doc_id is None:
            assert r.held_out
    assert {r.lang_pred for r in got if r.doc_id in (3, 4, 5)} == {"und"}
    assert language.languages(brute.odd_docs(spark, [])).count() == 0
    unlabelled = brute.odd_docs(spark).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in language.languages(unlabelled).collect()} == {("und", 0.0)}


# op12 -----------------------------------------------------------------------------------------------


def plain_features(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(brute.LOWER))
    return [zlib.crc32(f.encode()) % 10000 for f in w + [f"{a} {b}" for a, b in zip(w, w[1:])]]


def plain_resample(docs, items):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(plain_features(text))
    for _, text in items:
        t.update(plain_features(text))
    big_s, big_t = sum(s.values()) + 10000, sum(t.values()) + 10000
    out = []
    for doc_id, text in docs:
        f = plain_features(text)
        gain = sum(math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t))) for b in f)
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = gain // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= 39), key=lambda r: (-r[3], r[0] is None, r[0]))
    rank = {}
    for k, r in enumerate(able[: 25 * len(able) // 100]):
        rank.setdefault(id(r), k + 1)
    return sorted((*r, rank.get(id(r))) for r in out if r[0] is not None), sorted(r[1:] for r in out if r[0] is None)


@pytest.mark.parametrize("words", [20, 2])
def test_resampling_of_odd_rows(spark, words):
    docs = brute.odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    items = [(0, "the insult stood on a long line"), (1, None), (None, "w1 w2 w3\nw4"), (1, "one two")]
    got = [tuple(r) for r in resampling.resample(docs, benchmark_rows(spark, items), least=words).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    named, nulls = plain_resample(rows, items)
    assert sorted(r[:4] for r in got if r[0] is not None) == [r[:4] for r in named]
    assert sorted(list(r[1:4]) for r in got if r[0] is None) == nulls
    able = sorted((r for r in got if r[1] >= 2 * words - 1), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = sorted((r[4], r[3], r[0]) for r in got if r[4] is not None)
    assert [d[0] for d in drawn] == list(range(1, 25 * len(able) // 100 + 1))
    assert [d[1] for d in drawn] == [r[3] for r in able[: len(drawn)]]


def test_features_over_lines_equal_features_of_the_text():
    texts = [b"one two\nthree\n\n  \nfour five six\n", b"", b"\n\n", b"a" * 200 + b" " + b"b" * 70 + b"\n" + b"c" * 65 + b" d", "É é\nÀ-b 9z".encode(), b"last"]
    for t in texts:
        lines = t.split(b"\n")
        got = Counter(resampling.line_features(lines)[0].tolist()) + Counter(resampling.crossing_features([t])[0].tolist())
        assert got == Counter(plain_features(t.decode()))
        per_line = resampling.line_features(lines)[1].tolist()
        assert per_line == [len(plain_features(x.decode())) for x in lines]


def test_resampling_ranks_many_copies(spark):
    line = "some words that stand in every one of these rows and are more than twenty in all so that they can be drawn here by rank"
    rows = [(None, line)] * 9000 + [(k, f"{line}\nnumber {k}") for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = resampling.resample(docs, benchmark_rows(spark, [(0, "some words")])).collect()
    ranks = sorted(r["rank"] for r in got if r["rank"] is not None)
    assert len(got) == 9200 and ranks == list(range(1, 2301))
    assert resampling.resample(docs.limit(0), benchmark_rows(spark, [])).count() == 0


# op13 -----------------------------------------------------------------------------------------------


def plain_search(docs, items, most=50):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(brute.LOWER))
    rows = [(i, Counter(cut(t))) for i, t in docs]
    n_docs, length, df = sum(1 for _, c in rows if c), sum(sum(c.values()) for _, c in rows), Counter()
    for _, c in rows:
        df.update(c.keys())
    own = {}
    for item, text in items:
        own.setdefault(item, set()).update(cut(text))
    out = []
    for item, some in own.items():
        found = []
        for i, c in rows:
            m = 50 + (50 * sum(c.values()) * n_docs) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 20 * m)) for t in some if t in c)
            if score > 0:
                found.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(found)[:most])]
    return sorted(out, key=str)


@pytest.mark.parametrize("most, shard, block", [(50, 1 << 20, 100_000), (2, 7, 3), (3, 1, 1)])
def test_search_of_odd_rows_shards_and_blocks(spark, most, shard, block):
    docs = brute.odd_docs(spark).repartition(3)
    items = [(0, "the insult stood on a long line"), (1, None), (None, "one two"), (1, "One, w17 w29999"), (2, "nowhere"), (3, "don t stop é x"), (4, "extra end of the passage more than fifty")]
    got = [tuple(r) for r in ranked.search(docs, benchmark_rows(spark, items), most, block, shard).collect()]
    assert sorted(got, key=str) == plain_search([(r.doc_id, r.text) for r in docs.collect()], items, most)


def test_search_of_empty_tables(spark):
    docs = brute.odd_docs(spark)
    assert ranked.search(docs, benchmark_rows(spark, [])).count() == 0
    assert ranked.search(docs.limit(0), benchmark_rows(spark, [(1, "one")])).count() == 0


def test_bounds_settle_members_and_ties():
    """Random impacts: the answer equals a full sort, also among many ties."""
    rng = np.random.default_rng(3)
    n, size = 5000, 8
    doc, term, impact = [], [], []
    for t in range(size):
        some = rng.permutation(n)[: n // 2]
        doc.append(some)
        term.append(np.full(len(some), t))
        impact.append(np.ceil(1e6 / rng.integers(1, 400, len(some))).astype(np.int64))
    doc, term, impact = map(np.concatenate, (doc, term, impact))
    shard = ranked.Shard(np.arange(n) * 3, doc, term, impact, size)
    total = np.zeros(n, np.int64)
    np.add.at(total, doc, impact)
    ids, scores = shard.best(np.arange(size), 50)
    want = sorted(zip((-total).tolist(), (np.arange(n) * 3).tolist()))[:50]
    assert list(zip((-scores).tolist(), ids.tolist())) == want


@pytest.mark.parametrize("name", ["op12_resampling", "op13_ranked_search"])
def test_matches_oracle(spark, name):
    r = compare(spark, name, queries.queries()[name], queries.oracle_sql()[name], SF, duck(SF))
    assert r["cols"] and r["values"] and r["rows"][0] == r["rows"][1], r["detail"]


# op1: pairs -------------------------------------------------------------------------------------------


@pytest.mark.parametrize("rule", ["both", "one of two"])
def test_toxicity_of_pairs_alone(spark, rule):
    """Only the combination of two words decides; of `one of two` neither word tells anything by itself."""
    import random

    from fleetlens.llm import toxicity

    rng = random.Random(4)
    plain = [f"plain{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(200)]
    docs, labels = [], []
    for i in range(2400):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        words = rng.choices(plain, k=30) + ["insult"] * a + ["folk"] * b
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, int(a and b) if rule == "both" else int(a != b)))
    got = toxicity.toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).collect()
    want = dict(labels)
    held = [r for r in got if r.held_out]
    assert sum(r.predicted == want[r.doc_id] for r in held) >= 0.9 * len(held) > 0


def test_toxicity_sample_is_bounded_when_an_id_repeats(spark):
    from fleetlens.llm import toxicity

    docs = spark.createDataFrame([(1, f"text {k}") for k in range(500)] + [(2, "b"), (None, "c")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.training_rows(docs, labels).collect()
    assert len(rows) == sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in (1, 2)) and all(r.text in ("text 0", "b") for r in rows)
