"""Plain versions of the operators, and a small table with every odd row, for the tests."""

import hashlib
import re
import zlib

import numpy as np

LOWER = {k: k + 32 for k in range(65, 91)}

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, grp string, bucket string, score string, digest string, block string, length string, token string, cell string"


def odd_docs(spark, rows=None):
    """Documents with nulls, empty and very long texts, repeated rows and clashing extra columns."""
    base = "the insult stood on a long line of plain words that were written for this test alone and nothing else besides them "
    passage = "this passage of more than fifty words " * 9
    rows = rows if rows is not None else [
        (0, base * 4),
        (1, base * 4),
        (2, base * 4 + "extra end"),
        (3, None),
        (4, ""),
        (5, "   \n\n  "),
        (6, "one two"),
        (7, "One Two"),
        (8, " ".join(f"w{i}" for i in range(30_000))),
        (9, passage + " ".join(f"a{i}" for i in range(80))),
        (10, passage + " ".join(f"b{i}" for i in range(80))),
        (11, "é" * 700 + "🙂" * 30),
        (12, "x" * 900),
        (13, "don't  stop\tnow \x1d   end "),
        (13, "don't  stop\tnow \x1d   end "),
        (14, "another text under the same number"),
        (14, "a different text under the same number"),
        (None, base * 4),
        (None, None),
    ]
    return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), *["x"] * 8) for i, t in rows], SCHEMA)


def shingle_set(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else (frozenset([tuple(w)]) if w else frozenset())


def components(ids, links):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def near_copies(rows):
    """doc_id -> smallest doc_id reachable by links of Jaccard 0.75 or more."""
    sets = [(i, shingle_set(t)) for i, t in rows if i is not None]
    links = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x and y and min(len(x), len(y)) * 4 >= 3 * max(len(x), len(y)):
                m = len(x & y)
                if 100 * m >= 75 * (len(x) + len(y) - m):
                    links.append((a, b))
    return components({i for i, _ in sets}, links)


def repeats(texts, length=200):
    """Per text: bytes removed, maximal runs, bytes kept."""
    raw = [(t or "").encode() for t in texts]
    count = {}
    for b in raw:
        for s in range(len(b) - length + 1):
            count[b[s : s + length]] = count.get(b[s : s + length], 0) + 1
    out = []
    for b in raw:
        cover = np.zeros(len(b) + 1, int)
        for s in range(len(b) - length + 1):
            if count[b[s : s + length]] > 1:
                cover[s] += 1
                cover[s + length] -= 1
        gone = np.cumsum(cover)[: len(b)] > 0
        runs = int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum())
        out.append((int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return out


def crc_u32(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def sha(raw):
    return hashlib.sha256(raw).hexdigest()
