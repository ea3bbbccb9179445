"""run() against a plain version, stage by stage, on the smallest tables."""

import os
import sys

import public_tokenizers as P

sys.path.insert(0, os.path.dirname(__file__))
import brute  # noqa: E402
import corpus_pipeline  # noqa: E402

from fleetlens.llm import toxicity  # noqa: E402
from fleetlens.llm.common import table  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages_equal_plain_versions(spark):
    docs = table(spark, SF, "documents")
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["toxicity"](spark, docs, SF)
    assert clean.columns == docs.columns
    model = toxicity.train(docs, table(spark, SF, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}
    kept = sorted(i for i, t in rows.items() if model.score(t or "") < 0.5)
    assert sorted(r.doc_id for r in clean.collect()) == kept

    single = stages["jaccard_join"](spark, clean, SF)
    assert single.columns == docs.columns
    group = brute.near_copies([(i, rows[i]) for i in kept])
    firsts = sorted(i for i in kept if group[i] == i)
    assert sorted(r.doc_id for r in single.collect()) == firsts

    cut = stages["suffix_dedup"](spark, single, SF)
    assert cut.columns == docs.columns and cut.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = {i: k.decode("utf-8", "ignore") for i, (_, _, k) in zip(firsts, brute.repeats([rows[i] for i in firsts]))}
    got = {r.doc_id: r for r in cut.collect()}
    assert {i: r.text for i, r in got.items()} == want
    assert all(r.n_chars == len(r.text) for r in got.values())

    library = __import__("tokenizers").Tokenizer.from_file(P.path("word_bpe_49k.json"))
    pieces = []
    for i, t in want.items():
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        pieces += [(i, k, a, brute.crc_u32(ids[a : a + 2048])) for k, a in enumerate(range(0, len(ids), 2048))]
    packed = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.ids_crc32) for r in packed) == sorted(pieces)


def test_near_copies_of_repeated_and_null_ids(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(60))
    rows = [
        (1, text("a")), (2, text("a") + " end"), (2, text("b")),  # one row of 2 is a copy of 1, the other is clean
        (3, text("c")), (3, text("c") + " end"),  # near copies of one id
        (4, text("d")), (4, text("d")),  # equal rows
        (None, text("e")), (None, text("e")), (5, None), (5, ""), (6, text("f")),
    ]
    docs = brute.odd_docs(spark, rows)
    out = dict(corpus_pipeline.STAGES)["jaccard_join"](spark, docs, SF)
    got = sorted((r.doc_id or 0, (r.text or "")[:1]) for r in out.collect())
    assert out.columns == docs.columns
    assert got == [(0, "e"), (0, "e"), (1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, ""), (6, "f")]


def test_odd_rows_pass_all_stages(spark):
    docs = brute.odd_docs(spark)
    for empty in (False, True):
        now = docs.limit(0) if empty else docs
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, now, SF)
            rows = out.count()
            assert (rows == 0) == empty
            if name != "packing":
                assert out.columns == docs.columns
                now = out
