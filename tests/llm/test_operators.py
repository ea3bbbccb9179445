"""Each operator against a plain version, on odd rows and on the smallest tables."""

import hashlib
import os
import random
import re
import sys
import zlib

import duckdb
import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402

from fleetlens.llm import components, hnsw, jaccard_join, licences, packing, pieces, queries, spotsigs, suffix_dedup, token_files, tokens, toxicity, urls  # noqa: E402
from fleetlens.session import ship_package  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def rows_of(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str)


def texts_of(docs):
    return [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]


# op1 ------------------------------------------------------------------------------------------------


def labelled(spark, n=400):
    rng = random.Random(1)
    plain = [f"word{i}" for i in range(200)]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(plain, k=30)
        bad = i % 5 == 0
        if bad:
            w[rng.randrange(30)] = rng.choice(["idiotic", "idiots", "idiotisch"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_toxicity_learns_held_out_rows(spark):
    docs, labels = labelled(spark)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    want = {r.doc_id: r.toxic for r in labels.collect()}
    held = [i for i in got if got[i].held_out]
    assert held == [i for i in got if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum(got[i].predicted == want[i] for i in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())


def test_toxicity_pairs_carry_weight():
    """Neither term alone is toxic, both together are: linear weights can't tell, factors can."""
    rng = np.random.default_rng(0)
    active = [sorted(set(np.flatnonzero(rng.random(2) < 0.5).tolist())) for _ in range(3000)]
    toxic = np.array([float(len(a) == 2) for a in active])
    model = toxicity.Model({}, *toxicity.fit(active, toxic, 2, epochs=30))
    assert model.raw([0, 1]) > 0 > max(model.raw([0]), model.raw([1]), model.raw([]))


def test_toxicity_odd_rows(spark):
    docs = brute.odd_docs(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (None, 1), (3, None), (6, 0)], "doc_id long, toxic int")
    for given in (labels, labels.limit(0), labels.where("toxic = 1")):
        got = toxicity.toxicity(docs, given).collect()
        assert len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    assert toxicity.toxicity(docs.limit(0), labels).count() == 0


# op2 ------------------------------------------------------------------------------------------------


def verdict_of(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host, path = rest[:cut].translate(brute.LOWER), rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
    fits = [r for r in rules if r.host is not None and host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    if best:
        return host, path, best.name, best.action
    hit = any(re.search(r.regex, host + path) for r in rules if r.host is None)
    return host, path, None, "block" if hit else "allow"


def test_urls_equal_brute_force(spark):
    given = [None, "", "no scheme", "http://", "http://NET/", "http://net", "http://net?x=/", "http://a.NET/en/", "https://example.net/en/1#t", "https://example.net/en", "http://xexample.com/de/", "http://w.example.com/de/x?y", "ftp://org/fr/", "http://fr.org/fr", "http://u://v/w", "http://spam-farm.example.org/", "http://x.org/casino/y", "http://x.org/\nnet/", "http://cheap-pills.net/", "http://cheap-pills.net/"]
    rules = urls.HOST_RULES + urls.PATTERN_RULES + (urls.Rule("block", pattern="/a*z"), urls.Rule("block", "com", "/a"))
    pages = spark.createDataFrame([(i, u, "x", "y", "z") for i, u in enumerate([*given, "http://q.org/abz", "http://q.com/abc"])], "page_id long, url string, host string, token string, rule string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages, rules).collect()}
    assert got == {r.page_id: verdict_of(r.url, rules) for r in pages.collect()}
    assert urls.judge_urls(pages.limit(0)).count() == 0


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(queries.oracle_sql()[name])
    cols = sorted(want.columns)
    assert rows_of(queries.queries()[name](spark, SF), *cols) == sorted((tuple(r) for r in want.select(*cols).fetchall()), key=str)


# op3, op8, op10: tokenizers -------------------------------------------------------------------------


def test_token_files(spark):
    docs = brute.odd_docs(spark)
    folder, parts = token_files.write_token_files(docs, P.path("byte_bpe_50k.json"), length=64)
    got = sorted(token_files.read_token_files(folder, parts).collect(), key=lambda r: (r.doc_id is not None, r.start))
    library = __import__("tokenizers").Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = sorted(((d, t or "") for d, t in texts_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    for (d, t), r in zip(rows, got, strict=True):
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), brute.crc_u32(ids))
        at += len(ids)
    for r in parts.collect():
        f = token_files.SequenceFile(f"{folder}/part-{r.part:06d}.arrow")
        assert all(len(f.sequence(i)) == 64 == len(f.mask(i)) for i in range(len(f)))
        assert sum(pa.compute.sum(f.mask(i)).as_py() for i in range(len(f))) == r.n_tokens
        assert not len(f) or not f.sequence(0).flags.owndata
    empty, none = token_files.write_token_files(docs.limit(0), P.path("byte_bpe_50k.json"))
    assert token_files.read_token_files(empty, none).count() == 0


@pytest.mark.parametrize(("file", "split"), [("byte_bpe_50k.json", tokens.blank_words), ("word_bpe_49k.json", tokens.spaced_words)])
def test_cached_encoding_equals_the_library(file, split):
    enc = tokens.Encoder(P.path(file), split)
    rng = random.Random(2)
    given = ["", " ", "a", " a", "a ", "'s it's", "a  b\n c", "x\u00a0y", "\x1d a \x1c", "<|endoftext|> a", "don't-stop?!  ", "a\n\n", "\n\na\n\n\n", *("".join(rng.choices("ab e'\n.,!1é🙂\t", k=rng.randint(1, 40))) for _ in range(1500))]
    assert [x.tolist() for x in enc.encode(given)] == [enc.library.encode(t, add_special_tokens=False).ids for t in given]
    enc.cache.limit = 3  # a full cache changes nothing
    assert [x.tolist() for x in enc.encode(given[::-1])] == [enc.library.encode(t, add_special_tokens=False).ids for t in given[::-1]]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    path = P.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    enc = pieces.PrefixEncoder(path)
    rng = random.Random(3)
    given = ["", " ", "  a", "▁x ▁▁", "a" * 60, "日本 x", "\x00", "<s>", *("".join(rng.choices("ab erthino ▁\n\té日🙂1.,", k=rng.randint(1, 50))) for _ in range(1500))]
    for t, ids in zip(given, enc.encode(given)):
        assert ids.tolist() == model.encode(t, add_bos=True, add_eos=True)
        assert enc.decode(ids).decode() == model.decode(ids.tolist())
    bad = [enc.begin, enc.bytes[0xE6], enc.ids["▁a"], enc.bytes[0xFF], enc.end]
    assert enc.decode(np.array(bad)).decode() == model.decode(bad)
    docs = brute.odd_docs(spark)
    want = sorted(((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(model.decode(ids).encode())) for d, t in texts_of(docs) for ids in [model.encode(t or "", add_bos=True, add_eos=True)]), key=str)
    assert rows_of(pieces.encode_decode(docs, path), "doc_id", "n_tokens", "ids_sha256", "decoded_sha256") == want
    assert pieces.piece_ids(docs.limit(0), path).count() == 0


def test_packing(spark):
    docs = brute.odd_docs(spark)
    got = packing.best_fit_pack(docs, P.path("word_bpe_49k.json"), group=7).collect()
    library = __import__("tokenizers").Tokenizer.from_file(P.path("word_bpe_49k.json"))
    want = []
    for d, t in texts_of(docs):
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        want += [(d, k, a, len(ids[a : a + 2048]), brute.crc_u32(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == sorted(want, key=str)
    bins = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == bins.get(r.sequence_id, 0)
        bins[r.sequence_id] = r.offset + r.length
    assert max(bins.values()) <= 2048
    assert packing.best_fit_pack(docs.limit(0), P.path("word_bpe_49k.json")).count() == 0


def test_packing_follows_the_rule_and_packs_tightly():
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 60, 400)
    bins, offsets = packing.pack(lengths, 64)
    fill = {}
    for s, b, o in zip(lengths.tolist(), bins.tolist(), offsets.tolist()):
        gaps = np.bincount([64 - f for f in fill.values() if f < 64], minlength=65)
        costs = {}
        for g in {64 - f for f in fill.values() if f < 64 and 64 - f >= s} or {64}:
            after = gaps.copy()
            after[g] -= g < 64
            after[g - s] += g > s
            after[0] = 0
            costs[g] = int((after**2).sum())
        assert costs[64 - o] == min(costs.values()) and fill.get(b, 0) == o
        fill[b] = o + s
    big = rng.integers(1, 2000, 20_000)
    bins, _ = packing.pack(np.sort(big)[::-1], 2048)
    assert bins.max() + 1 <= 1.01 * -(-big.sum() // 2048)


# op4 ------------------------------------------------------------------------------------------------


def test_spotsigs_odd_rows(spark):
    docs = brute.odd_docs(spark)
    got = spotsigs.fingerprints(docs).collect()
    rows = sorted(((d, t or "") for d, t in texts_of(docs)), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    want = []
    for k, (d, t) in enumerate(rows):
        after, half = rows[(k + 1) % len(rows)][1], len(t) // 2
        want.append((d, len(t), brute.sha((t[: len(t) - half] + after[:half]).encode())))
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(want, key=str)
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in got)
    by_text = {}
    for r, (d, t) in zip(sorted(got, key=lambda r: str((r.doc_id, r.n_chars, r.edited_sha256))), sorted(rows, key=str)):
        by_text.setdefault(r.n_chars, set()).add(r.fingerprint)
    assert len(by_text[len(rows[1][1])]) >= 1
    assert spotsigs.fingerprints(docs.limit(0)).count() == 0


def test_spotsigs_pairs_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sets = docs.select("doc_id", spotsigs.fingerprint(F.col("text")).alias("s")).collect()
    first = {}
    for r in sorted(sets, key=lambda r: r.doc_id):
        if r.s:
            first.setdefault(tuple(r.s), r.doc_id)
    classes = [(i, set(s)) for s, i in first.items()]
    want = {(min(a, b), max(a, b)) for k, (a, x) in enumerate(classes) for b, y in classes[:k] if len(x & y) >= 0.6 * len(x | y)}
    assert {(r.left_id, r.right_id) for r in spotsigs.near_pairs(docs, 0.6).collect()} == want


# op5 ------------------------------------------------------------------------------------------------


def test_two_stage_suffix_sort():
    rng = random.Random(4)
    for alphabet in (b"a", b"ab", b"\x00\x01", b"abcdefgh", bytes(range(200))):
        for n in (1, 2, 50, 700):
            t = bytes(rng.choice(alphabet) for _ in range(n))
            t += t[: n // 2]
            order = suffix_dedup.suffix_array(np.frombuffer(t, np.uint8), 64).tolist()
            assert sorted(order) == list(range(len(t)))
            assert all(t[a : a + 64] <= t[b : b + 64] for a, b in zip(order, order[1:]))


@pytest.mark.parametrize("hot", [suffix_dedup.HOT_SLICES, 1])
def test_repeats_equal_brute_force(spark, hot):
    rng = random.Random(5)
    shared = ["".join(rng.choices("abcdefghij é", k=k)) for k in (199, 200, 201, 260, 500)]
    noise = lambda: "".join(rng.choices("klmnopqrst ", k=rng.randint(0, 300)))
    rows = [(i, noise() + rng.choice(shared) + noise() + (rng.choice(shared) if i % 3 else "z" * 350)) for i in range(60)]
    docs = brute.odd_docs(spark, rows + [(60, None), (61, ""), (62, rows[0][1]), (62, rows[0][1]), (None, rows[3][1]), (63, "q" * 201)])
    given = texts_of(docs)
    want = sorted(((d, len((t or "").encode()), n, s, brute.sha(k)) for (d, t), (n, s, k) in zip(given, brute.repeats([t for _, t in given]))), key=str)
    ranges = suffix_dedup.repeated_ranges(docs, hot=hot, shard_bytes=4096)
    got = suffix_dedup._dealt(docs).groupBy("grp").cogroup(ranges.groupBy("grp")).applyInArrow(suffix_dedup._digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    assert rows_of(got, "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    if hot > 1:
        assert rows_of(suffix_dedup.repeat_digests(brute.odd_docs(spark)), "doc_id", "n_removed") == sorted(((d, n) for (d, _), (n, _, _) in zip(texts_of(brute.odd_docs(spark)), brute.repeats([t for _, t in texts_of(brute.odd_docs(spark))]))), key=str)
        assert suffix_dedup.repeat_digests(docs.limit(0)).count() == 0


def test_lacking_grams_send_all_bytes(spark):
    """The resend path gives the same runs, with bytes for every slice."""
    docs = brute.odd_docs(spark)
    table = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow()
    counted = suffix_dedup._bucket_counts(2)((pa.scalar(0),), table)
    totals = pa.concat_tables([suffix_dedup._bucket_totals((pa.scalar(k),), counted.filter(pa.compute.equal(counted["bucket"], k))) for k in (0, 1)])
    some, all_ = (suffix_dedup._shared_runs(x)((pa.scalar(0),), table, totals) for x in (frozenset(), None))
    assert some.drop(["bytes"]) == all_.drop(["bytes"]) and all_["bytes"].null_count < some["bytes"].null_count


# op6 ------------------------------------------------------------------------------------------------


def test_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(30, 16))
    x = np.concatenate([np.repeat(centres, 8, 0) + rng.normal(scale=0.12, size=(240, 16)), rng.normal(size=(300, 16)), np.tile(centres[:1], (50, 1))])
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(9000, None), (9001, [0.0] * 16), (9002, [None] + [1.0] * 15), (9003, [float("nan")] * 16), (9004, [float("inf")] * 16), (9005, [1.0, 0.0]), (9006, [2.0, 0.0]), (9007, []), (9008, (x[0] * 1e20).tolist())]
    table = spark.createDataFrame([(i, v, 0, "x", "y") for i, v in rows], "vec_id long, embedding array<float>, label int, digest string, shard string")
    good = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)]
    unit = {i: v / np.abs(v).max() / np.linalg.norm(v / np.abs(v).max()) for i, v in good}
    links = [(a, b) for a in unit for b in unit if a < b and len(unit[a]) == len(unit[b]) and unit[a] @ unit[b] >= 0.9]
    comp, count = brute.components([i for i, _ in rows], links), {i: 0 for i, _ in rows}
    for a, b in links:
        count[a] += 1
        count[b] += 1
    got = {r.vec_id: r for r in hnsw.near_vectors(table, shards=3, block=200).collect()}
    assert sorted(got) == sorted(count)
    assert all(r.n_links <= count[i] and r.kept == (r.component_id == i) for i, r in got.items())
    assert sum(r.n_links for r in got.values()) >= 0.98 * 2 * len(links)
    assert sum(got[i].component_id == comp[i] for i in got) >= 0.98 * len(got)
    assert hnsw.near_vectors(table.limit(0)).count() == 0


def test_beams_widen_until_the_audit_passes():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1, 32)) + rng.normal(scale=0.05, size=(600, 32))  # all within the threshold of each other
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    graph = hnsw.Graph.from_bytes(hnsw.Graph.build(x).to_bytes())
    found, recall, _ = hnsw.audited(graph, x[:40], 0.9, beam=2)
    assert recall >= 0.99 and all(len(f) == 600 for f in found)


def unit(x):
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_small_groups_are_found_beside_a_large_one():
    rng, group, pairs = np.random.default_rng(8), 1000, 300
    ends = rng.normal(size=(pairs, 64))
    near = rng.normal(size=(1, 64)) + rng.normal(scale=0.15, size=(group, 64))
    x = unit(np.concatenate([near, ends, rng.normal(size=(2000, 64))]))
    partners = unit(ends + rng.normal(scale=0.4, size=ends.shape))
    row = np.random.default_rng(1).permutation(np.concatenate([np.arange(160), group + np.arange(pairs)]))  # of the query or its partner
    queries = np.array([x[r] if r < group else partners[r - group] for r in row])
    found, recall, _ = hnsw.audited(hnsw.Graph.build(x), queries, 0.9, beam=2, own=np.where(row < group, row, -1))
    wanted = [(r, f) for r, f, q in zip(row, found, queries) if r >= group and x[r] @ q >= 0.9]
    assert len(wanted) > 250 and recall >= hnsw.AUDIT_RECALL
    assert sum(r in f for r, f in wanted) >= 0.98 * len(wanted)


@pytest.mark.parametrize("given", [True, False])
def test_audit_is_not_passed_by_one_large_group_and_self_hits(given):
    class Blind:
        """Finds all of a group of 500, but of pairs only the query itself below a beam of 8."""

        vectors = unit(np.concatenate([np.eye(128)[:1] + 0.001 * np.eye(128)[np.arange(500) % 128], np.repeat(np.eye(128)[1:121], 2, 0)]) + 1e-5 * np.random.default_rng(2).normal(size=(740, 128)))

        def near(self, queries, least, beam):
            full = [np.flatnonzero(s >= least) for s in queries @ self.vectors.T]
            return full if beam >= 8 else [f if len(f) > 2 else f[[(self.vectors[r] == q).all() for r in f]] for q, f in zip(queries, full)]

    found, recall, beam = hnsw.audited(Blind(), Blind.vectors, 0.9, 2, *([np.arange(740)] if given else []))
    assert (recall, beam) == (1.0, 8) and all(len(f) == (500 if i < 500 else 2) for i, f in enumerate(found))


def test_full_lists_keep_links_out_of_their_group():
    x = unit(np.concatenate([np.eye(32)[:1], np.eye(32)[1:5], np.eye(32)[:1] + np.random.default_rng(3).normal(scale=0.02, size=(60, 32))]))
    layer = hnsw.Layer(np.arange(65), 32, 65)
    layer._add(x, np.zeros(4, np.int64), np.arange(1, 5))
    for i in range(5, 65, 20):
        layer._add(x, np.zeros(20, np.int64), np.arange(i, i + 20))
    assert set(range(1, 5)) <= set(layer.near[0].tolist()) and (layer.near[0] >= 5).sum() == 28


def test_no_row_holds_a_shard(spark, monkeypatch):
    """Graphs and vectors stay in files: no written row grows with its shard, long vectors make more shards, results are the same."""
    x = np.random.default_rng(9).normal(size=(40, 16)).repeat(15, 0) + np.random.default_rng(10).normal(scale=0.1, size=(600, 16))
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    longest, rows = {}, {}

    def written(df, name):
        out = materialise(df, name)
        longest[name], rows[name] = out.agg(F.max(F.length(F.to_json(F.struct(*out.columns)))), F.count("*")).first()
        return out

    materialise = hnsw.materialise
    monkeypatch.setattr(hnsw, "materialise", written)
    got = hnsw.near_vectors(table, shards=2, block=50).collect()
    assert rows["hnsw"] == 2 and all(n < 1000 for n in longest.values()), longest
    monkeypatch.setattr(hnsw, "SHARD_BYTES", 100 * 16 * 4)
    assert sorted(hnsw.near_vectors(table, shards=2, block=50).collect()) == sorted(got)
    assert rows["hnsw"] == 6


def test_links_of_a_large_group_leave_a_few_at_a_time(tmp_path, monkeypatch):
    x = np.random.default_rng(11).normal(size=(1, 16)) + np.random.default_rng(12).normal(scale=0.05, size=(400, 16))
    rows = pa.table({"class_id": pa.array(np.arange(400)[::-1]), "embedding": pa.array(x.tolist(), pa.list_(pa.float32()))})
    monkeypatch.setattr(hnsw, "LINKS_AT_ONCE", 1000)
    monkeypatch.setattr(hnsw, "SEARCH_AT_ONCE", 64)
    hnsw._build(tmp_path.as_uri())((pa.scalar(16), pa.scalar(0)), rows)
    found = [b for first in range(0, 400, 150) for b in hnsw._linked(tmp_path.as_uri(), 16, 0, first, 150, 0)]
    assert max(b.num_rows for b in found) <= 1400 and len(found) > 50
    assert sum(b.num_rows for b in found) == 400 * 399 and len(set(zip(*pa.Table.from_batches(found).to_pydict().values()))) == 400 * 399 // 2


# op7 ------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("cell", [jaccard_join.CELL, 8])
def test_jaccard_join_equals_brute_force(spark, cell):
    rng = random.Random(8)
    words = [f"v{i}" for i in range(500)]
    rows = []
    for g in range(6):
        base = rng.choices(words, k=120)
        for _ in range(14):
            w = list(base)
            for _ in range(rng.randint(0, 7)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append((len(rows), " ".join(w)))
    rows += [(len(rows) + k, " ".join(rng.choices(words, k=80))) for k in range(20)]
    docs = brute.odd_docs(spark, rows).unionByName(brute.odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    want = brute.near_copies(texts_of(docs))
    got = jaccard_join.shingle_components(docs, cell=cell).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == want
    sizes = sorted((str(d), len(brute.shingle_set(t))) for d, t in texts_of(docs))
    assert sorted((str(r.doc_id), r.n_shingles) for r in got) == sizes
    if cell > 8:
        assert jaccard_join.shingle_components(docs.limit(0)).count() == 0


def test_components(spark):
    rng = random.Random(9)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(230)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (None, 3)]
    got = {r.id: r.component for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    real = [(a, b) for a, b in edges if a is not None and a != b]
    assert got == brute.components({x for e in real for x in e}, real)


# op9 ------------------------------------------------------------------------------------------------


def test_licences_on_held_out_notices(spark):
    lines = ["plain words that name nothing in particular here", "der Text ist nur ein Beispiel ohne weiteren Inhalt"] * 20
    model = licences.train(lines)
    rng = np.random.default_rng(99)
    filler = [w for p in lines for w in licences.words(p)]
    tried = [(f, v) for f in licences.TEMPLATES for t in licences.TEMPLATES[f] for v in licences.variants(rng, t, filler, 5)]
    right = sum(model.scan(v)[0] == f for f, v in tried)
    wrong = sum(model.scan(v)[0] not in (f, licences.UNKNOWN) for f, v in tried)
    assert right >= 0.85 * len(tried) and wrong <= 0.05 * len(tried)
    assert all(model.scan(p)[0] == licences.UNKNOWN for p in [*lines, "The license plate of the car was lost.", "", "Version 2.0 of the text"])


def test_licences_of_documents(spark):
    notices = [(i, "some text\n" + licences.TEMPLATES[f][0] + "\nmore text") for i, f in enumerate(sorted(licences.TEMPLATES))]
    docs = brute.odd_docs(spark, notices).unionByName(brute.odd_docs(spark).withColumn("doc_id", F.col("doc_id") + 1000))
    got = {r.doc_id: r for r in licences.scan_documents(docs).collect() if r.doc_id is not None}
    assert [got[i].families for i in range(len(notices))] == sorted(licences.TEMPLATES)
    assert all(got[i].n_licensed == 0 for i in got if i >= 1000)
    assert licences.scan_documents(docs.limit(0)).count() == 0


WRAPPED = {
    "apache": "# Copyright 2031 Some Body\n# Licensed under the Apache License, Version 2.0 (the\n# \"License\"); you may not use this file except in\n# compliance with the License. You may obtain a copy",
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:\n1. Redistributions of source code must retain the notice",
    "gpl": " * Foo is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as\n * published by the Free Software Foundation, either version 2 of\n * the License, or any later version",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation; either\nversion 2.1 of the License",
    "mit": "// Permission is hereby granted, free of charge, to any\n// person obtaining a copy of this software and associated\n// documentation files (the Software), to deal in the Software",
    "mpl": "This Source Code Form is subject to the terms of the Mozilla\nPublic License, v. 2.0. If a copy of the MPL was not\ndistributed with this file, You can obtain one at here",
    "cc0": "To the extent possible under law, Some Body has\nwaived all copyright and related or neighboring rights\nto this work",
}
HEADINGS = {"mit": ("The MIT License (MIT)", "MIT License"), "apache": ("Apache License 2.0", "Apache License\n  Version 2.0, January 2004"), "gpl": ("GNU GENERAL PUBLIC LICENSE",), "lgpl": ("GNU LESSER GENERAL PUBLIC LICENSE",), "mpl": ("Mozilla Public License 2.0", "Mozilla Public License\nVersion 2.0"), "bsd": ("BSD 2-Clause License",), "cc_by_nc": ("Creative Commons Attribution-NonCommercial\n4.0 International",), "cc_by": ("Creative Commons\nAttribution 4.0 International",)}


def test_licences_of_wrapped_notices_and_headings(spark):
    prose = "\n".join(["plain words of the text that are free to read by all"] * 300)
    texts = [(f, t) for f, t in WRAPPED.items()] + [(f, t) for f, ts in HEADINGS.items() for t in ts]
    rows = [(i, around[0] + t + around[1]) for i, (_, t) in enumerate(texts) for around in [[("", ""), (prose + "\n", "\n" + prose), ("\r\n\r\n", "\n \n" + prose)][i % 3]]]
    rows += [(100, prose + "\nMIT License\n" + prose + "\n" + WRAPPED["gpl"] + "\n\n" + WRAPPED["bsd"]), (101, prose + "\n\n" + prose), (102, "SPDX-License-Identifier: ISC")]
    got = {r.doc_id: r for r in licences.scan_documents(brute.odd_docs(spark, rows)).collect()}
    assert [got[i].families for i in range(len(texts))] == [f for f, _ in texts]
    assert (got[100].families, got[100].n_paragraphs, got[100].n_licensed) == ("bsd,gpl,mit", 2, 2)
    assert got[101].n_licensed == got[102].n_licensed == 0 and got[101].n_paragraphs == 2


def test_licence_seeds_lose_no_match():
    templates = [licences.Template(0, t) for ts in licences.TEMPLATES.values() for t in ts]
    assert all(t.without_seeds() < licences.MIN_TEMPLATE_COSINE or len(t.counts) == 3 for t in templates)


def test_registered():
    assert [n for n in range(1, 11) if any(q.startswith(f"op{n}_") for q in queries.queries())] == list(range(1, 11))
