"""URL rules over every control character, and piece encoding of long runs of blanks and broken bytes."""

import re

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece

from fleetlens.llm import pieces, urls

MODEL = P.path("piece_bpe_32k.model")


def plain_verdict(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (m[1].translate({k: k + 32 for k in range(65, 91)}), m[2]) if m else ("", "")
    fits = [r for r in urls.HOST_RULES if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.name))
        return host, path, best.name, best.action
    text = (host + path)
    return host, path, None, "block" if any(r.pattern in text for r in urls.PATTERN_RULES) else "allow"


def test_every_control_character_in_host_and_path(spark):
    odd = [chr(c) for c in [*range(1, 33), 127, 133, 0x2028, 0x2029]]
    rows = [f"http://a{c}b.net/x" for c in odd] + [f"http://{c}net/en/" for c in odd] + [f"http://.{c}.example.net/en/{c}" for c in odd]
    rows += [f"http://www.org/fr/{c}a" for c in odd] + [f"http://www.org/fr{c}/a" for c in odd] + [f"http://x.com{c}/poker/{c}" for c in odd]
    rows += [f"{c}://example.com/de/{c}" for c in odd] + [None, "", "://", "http://net", "http://net/", "http://net?x/", "http://net#/", "HTTP://A.NET/", "http:///net/", "x://http://net/",
                                                         "http://.net/", "http://xnet/", "http://example.net/en", "http://a.example.net/en/", "http://example.net/de/", "http://example.com/de/?q", "http://org/fr/x", "http://a-casino-b.com/"]
    pages = spark.createDataFrame(list(enumerate(rows)), "page_id long, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(pages).collect()}
    for i, url in enumerate(rows):
        assert got[i] == plain_verdict(url), repr(url)


@pytest.mark.parametrize("text", [" " * 100_000, "a" + " " * 60_001 + "b", (" " * 33 + "é") * 2_000, "\n" * 5_000 + " " * 5_000, "x" * 20_000])
def test_long_runs_equal_the_library(text):
    enc, library = pieces.prefix_encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    ids = enc.encode([text])[0].tolist()
    assert ids == [enc.begin, *library.encode(text), enc.end]
    assert enc.decode(np.array(ids)).decode() == library.decode(ids)


def test_merging_with_and_without_a_heap_agree():
    enc, rng = pieces.prefix_encoder(MODEL), np.random.default_rng(5)
    for _ in range(300):
        text = "".join(rng.choice(list("▁▁▁aeintr"), int(rng.integers(25, 200))))
        assert enc.merged(text) == enc._merged_short(list(text))


def test_bytes_that_are_no_text_decode_as_the_library_does():
    enc, library = pieces.prefix_encoder(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rng = np.random.default_rng(6)
    loose = list(enc.bytes.values())
    for _ in range(200):
        ids = [enc.begin, *rng.choice([*loose, 500, 600, 700], int(rng.integers(1, 12))).tolist(), enc.end]
        assert enc.decode(np.array(ids)).decode() == library.decode(ids)
    many = [enc.begin, *[enc.bytes[0xFF]] * 50_000, enc.end]
    assert enc.decode(np.array(many)).decode() == "�" * 50_000
