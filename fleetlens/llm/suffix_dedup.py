"""Removal of long repeated byte strings by sharded suffix arrays (operator 5).

Every 200-byte window (a suffix start with 200 bytes left) picks the smallest hash
among its 48-byte grams.  Equal windows pick equal grams, so windows can be dealt by
that hash and all repeats of a window meet:

1. Consecutive windows with one gram form a run, and the bytes they cover a slice.
   Packed counts of gram and slice hashes (as sorted arrays per document group and hash
   bucket) tell which grams occur twice; the windows of all others are unique.
2. Slices are identified by a 128-bit digest.  A slice that occurs twice is repeated as
   a whole.  Where a gram has several different slices, these go to a shard by the
   gram's hash; there a two-stage suffix sort puts equal windows side by side and the
   common prefixes of neighbours tell which windows repeat.
3. Repeated windows return to their documents as byte ranges; each document's bytes
   outside of them are kept.

Two-stage sort: suffixes smaller than their successor are sorted directly (by 200
bytes, all that is asked for); the rest are induced in one scan over the buckets of
first bytes, each bucket's predecessors dealt to the buckets of their own first byte.
The direct sort copies the windows of one first byte at a time, so that a shard's memory
is a part of LENGTH times its bytes.

A gram with more than ``HOT_SLICES`` different slices is split by the place of the gram
in the window, which equal windows share, so no shard grows with a hot passage.

Edge cases: null text is empty; documents under 200 bytes lose nothing; repeated rows
are copies of each other; null doc_ids are kept; documents are told apart by their
rank in a group (doc_id, text), so equal doc_ids do no harm; an empty table gives no
rows; extra columns are ignored (or kept, by ``without_repeats``).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, shuffle_width

LENGTH = 200
GRAM = 48
SPAN = LENGTH - GRAM + 1
#: Bytes a suffix sort works on at once.
SHARD_BYTES = 512 << 10
HOT_SLICES = 8_192
#: Grams that are named one by one to tasks; beyond that all bytes are sent.
MAX_NAMED = 100_000
#: Groups of documents per shuffle partition; a worker and its JVM hold one group at once.
GROUPS = 2
#: Bytes hashed at once, and of one document at once (windows overlap by LENGTH - 1).
BUFFER, STRETCH = 128 << 10, 1 << 20

_BASE = 0x9E3779B97F4A7C15


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def _hashes(buffer: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Polynomial hashes of all GRAM-byte and LENGTH-byte strings of a buffer, by doubling."""
    power = lambda n: np.uint64(pow(_BASE, n, 1 << 64))
    h = {1: _mixed(buffer.astype(np.uint64) + np.uint64(1))}

    def joined(a: int, b: int) -> np.ndarray:
        x, y = h[a], h[b]
        n = len(buffer) - a - b + 1
        return x[:n] * power(b) + y[a : a + n]

    for k in (1, 2, 4, 8, 16, 32, 64):
        h[2 * k] = joined(k, k)
    gram = joined(32, 16)
    h[192] = joined(128, 64)
    return _mixed(gram), joined(192, 8)


def _window_minimum(x: np.ndarray, n: int) -> np.ndarray:
    width, got = 1, x
    while 2 * width <= n:
        got = np.minimum(got[: len(got) - width], got[width:])
        width *= 2
    rest = n - width
    return np.minimum(got[: len(got) - rest], got[rest:]) if rest else got


def runs_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one chosen gram, for documents numbered by their place in ``texts``.

    Columns: doc, lo and hi (first and last window start), at (the gram's place), gram
    (hash) and slice (hash of the bytes lo .. hi + LENGTH: its first and last window and
    its length determine it).
    """
    out: list[tuple] = []
    stretches = [(d, a, t[a : a + STRETCH + LENGTH - 1]) for d, t in enumerate(texts) if len(t) >= LENGTH for a in range(0, len(t) - LENGTH + 1, STRETCH)]
    i = 0
    while i < len(stretches):
        some, size = [], 0
        while i < len(stretches) and (not some or size + len(stretches[i][2]) <= BUFFER):
            some.append(stretches[i])
            size += len(stretches[i][2])
            i += 1
        buffer = np.frombuffer(b"".join(s[2] for s in some), np.uint8)
        gram, whole = _hashes(buffer)
        # the leftmost of the smallest: 40 bits of hash above 24 bits of place
        place = (_window_minimum((gram & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(gram), dtype=np.uint64), SPAN) & np.uint64(0xFFFFFF)).astype(np.int64)
        sizes = np.array([len(s[2]) for s in some])
        begins = np.cumsum(sizes) - sizes
        starts = np.concatenate([np.arange(b, b + n - LENGTH + 1) for b, n in zip(begins.tolist(), sizes.tolist())])
        owner = np.repeat(np.arange(len(some)), sizes - LENGTH + 1)
        chosen = place[starts]
        first = np.flatnonzero(np.r_[True, (chosen[1:] != chosen[:-1]) | (owner[1:] != owner[:-1])])
        last = np.r_[first[1:], len(starts)] - 1
        shift = np.array([s[1] for s in some])[owner[first]] - begins[owner[first]]
        lo, hi = starts[first], starts[last]
        sl = _mixed(whole[lo] ^ _mixed(whole[hi] + (hi - lo).astype(np.uint64)))
        out.append((np.array([s[0] for s in some])[owner[first]], lo + shift, hi + shift, chosen[first] + shift, gram[chosen[first]], sl))
    cols = [np.concatenate(c) for c in zip(*out)] if out else [np.empty(0, np.int64)] * 4 + [np.empty(0, np.uint64)] * 2
    return dict(zip(("doc", "lo", "hi", "at", "gram", "slice"), cols))


def _group(docs: pa.Table) -> tuple[pa.Table, list[bytes]]:
    """A group's documents in a fixed order, and their bytes."""
    docs = docs.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    return docs, [t.as_buffer().to_pybytes() for t in docs.column("text")]


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Places in a sorted array where each bucket (by the leading bits) begins, and its length."""
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    return np.r_[0, np.searchsorted(values, np.array(edges, np.uint64)), len(values)]


def _keys(runs: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([runs["gram"], runs["slice"]])


def _bucket_counts(buckets: int) -> Callable:
    """Group -> per hash bucket: sorted distinct gram and slice hashes and their counts."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        values, counts = np.unique(_keys(runs_of(_group(docs)[1])), return_counts=True)
        at, n = _cuts(values, buckets), counts.astype("<u4")
        rows = [(k, key[0].as_py(), values[a:b].tobytes(), n[a:b].tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "grp", "hashes", "counts"])

    return run


def _bucket_totals(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's counts -> per group, the totals of its hashes."""
    hashes = [np.frombuffer(x, "<u8") for x in rows.column("hashes").to_pylist()]
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "<u4")
    _, inverse = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.minimum(np.bincount(inverse, weights=counts), 0xFFFFFFFF).astype("<u4")[inverse]
    at = np.r_[0, np.cumsum([len(x) for x in hashes])]
    return pa.table([pa.array([key[0].as_py()] * len(hashes), pa.int32()), rows.column("grp"), pa.array([total[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["bucket", "grp", "totals"])


RUNS = "grp int, doc int, lo long, n long, at int, gram long, digest binary, bytes binary"


def _shared_runs(lacking: set[int] | None = frozenset()) -> Callable:
    """Group and its totals -> the runs whose gram occurs twice; bytes once per slice of a gram that has other slices too.

    ``lacking`` names grams whose bytes are sent in any case (None: all).
    """

    def run(key: tuple, docs: pa.Table, totals: pa.Table) -> pa.Table:
        _, texts = _group(docs)
        runs = runs_of(texts)
        keys = _keys(runs)
        values, inverse = np.unique(keys, return_inverse=True)
        parts = totals.column("totals").to_pylist()
        total = np.frombuffer(b"".join(parts[i] for i in np.argsort(totals.column("bucket").to_numpy())), "<u4")[inverse]
        of_gram, of_slice = total[: len(keys) // 2], total[len(keys) // 2 :]
        pick = np.flatnonzero(of_gram >= 2)
        mixed = (of_slice[pick] < of_gram[pick]) | (np.isin(runs["gram"][pick].view(np.int64), list(lacking)) if lacking is not None else True)
        lo, hi, doc = runs["lo"][pick], runs["hi"][pick], runs["doc"][pick]
        digests, sent, seen = [], [], set()
        for d, a, b, m in zip(doc.tolist(), lo.tolist(), (hi + LENGTH).tolist(), mixed.tolist()):
            piece = texts[d][a:b]
            digest = hashlib.blake2b(piece, digest_size=16).digest()
            digests.append(digest)
            sent.append(piece if m and digest not in seen else None)
            if m:
                seen.add(digest)
        cols = [pa.array([key[0].as_py()] * len(pick), pa.int32()), pa.array(doc, pa.int32()), pa.array(lo, pa.int64()), pa.array(hi - lo + 1, pa.int64()), pa.array(runs["at"][pick] - lo, pa.int32()), pa.array(runs["gram"][pick].view(np.int64)), pa.array(digests, pa.binary()), pa.array(sent, pa.binary())]
        return pa.table(cols, names=["grp", "doc", "lo", "n", "at", "gram", "digest", "bytes"])

    return run


def suffix_array(text: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """Suffixes of a byte array in order of their first ``depth`` bytes, by two-stage sorting."""
    n = len(text)
    if not n:
        return np.empty(0, np.int64)
    used = np.bincount(text, minlength=256) > 0
    if used.all():
        raise ValueError("UTF-8 leaves some byte values free; one is needed below all others")
    text = np.cumsum(used).astype(np.uint8)[text]  # ranks from 1 on: the end, padded with 0, is smallest
    # smaller than the successor: the first byte unlike this one that follows is larger; the end counts as smallest
    changes = np.flatnonzero(text[1:] != text[:-1])
    run_end = np.append(changes, n - 1)
    which = np.searchsorted(run_end, np.arange(n))
    grows = np.append(text[changes + 1] > text[changes], False)[which]
    direct = np.flatnonzero(grows)
    del changes, run_end, which, grows
    padded = np.concatenate([text, np.zeros(depth, np.uint8)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, depth)
    direct = direct[np.argsort(text[direct], kind="stable")]
    by_byte = np.searchsorted(text[direct], np.arange(257))
    for a, b in zip(by_byte[:-1].tolist(), by_byte[1:].tolist()):  # a first byte at a time: the windows copied are its own
        if b - a > 1:
            direct[a:b] = direct[a:b][np.argsort(windows[direct[a:b]].view(f"S{depth}").ravel(), kind="stable")]
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    waiting[int(text[-1])].append(np.array([n - 1]))  # induced by the end of the text
    order = []
    for c in range(256):
        induced = waiting[c]
        wave = np.concatenate(induced) if induced else np.empty(0, np.int64)
        induced = [wave]
        while len(wave):  # predecessors with the same byte follow in the same bucket
            wave = wave[wave > 0] - 1
            wave = wave[text[wave] == c]
            induced.append(wave)
        bucket = np.concatenate([*induced, direct[by_byte[c] : by_byte[c + 1]]])
        order.append(bucket)
        before = bucket[bucket > 0] - 1
        first = text[before]
        before, first = before[first > c], first[first > c]
        before = before[np.argsort(first, kind="stable")]
        cut = np.cumsum(np.bincount(first, minlength=256))
        for b in np.unique(first).tolist():
            waiting[b].append(before[cut[b - 1] : cut[b]])
    return np.concatenate(order)


def repeated_starts(pieces: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """Per piece, the starts of the ``length``-byte strings that start elsewhere in the pieces too."""
    text = np.frombuffer(b"".join(pieces), np.uint8)
    sizes = np.array([len(p) for p in pieces], np.int64)
    begin = np.cumsum(sizes) - sizes
    order = suffix_array(text, length)
    valid = np.zeros(len(text) + 1, bool)
    for b, n in zip(begin.tolist(), sizes.tolist()):
        valid[b : b + max(0, n - length + 1)] = True
    order = order[valid[order]]
    windows = np.lib.stride_tricks.sliding_window_view(text, length) if len(text) >= length else None
    twice = np.zeros(len(text) + 1, bool)
    for k in range(0, len(order) - 1, 50_000):  # neighbours with a common prefix of the whole length
        a, b = order[k : k + 50_000], order[k + 1 : k + 50_001]
        a = a[: len(b)]
        same = (windows[a] == windows[b]).all(1)
        twice[a[same]] = True
        twice[b[same]] = True
    return [np.flatnonzero(twice[b : b + n]) for b, n in zip(begin.tolist(), sizes.tolist())]


def _sorted_shard(key: tuple, rows: pa.Table) -> pa.Table:
    """A shard's different slices -> (digest, first and last start) of the repeated windows."""
    first: dict[tuple, bytes] = {}
    for digest, off, piece in zip(*(rows.column(c).to_pylist() for c in ("digest", "off", "bytes"))):
        first.setdefault((digest, off), piece)
    keys = sorted(first)
    out: list[tuple] = []
    for (digest, off), starts in zip(keys, repeated_starts([first[k] for k in keys])):
        if len(starts):
            cut = np.flatnonzero(np.diff(starts) > 1)
            out += zip([digest] * (len(cut) + 1), (starts[np.r_[0, cut + 1]] + off).tolist(), (starts[np.r_[cut, len(starts) - 1]] + off).tolist())
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 3, (pa.binary(), pa.int64(), pa.int64()))], names=["digest", "a", "b"])


def _dealt(docs: DataFrame, *more: str) -> DataFrame:
    width = shuffle_width(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), *more)
    return rows.withColumn("grp", F.pmod(F.xxhash64("doc_id"), F.lit(GROUPS * width)).cast("int")).repartition(width, "grp")


def repeated_ranges(docs: DataFrame, hot: int = HOT_SLICES, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(grp, doc, a, b): byte ranges a .. b - 1 of repeated windows, per document (by its rank in its group)."""
    width = shuffle_width(docs.sparkSession)
    dealt = _dealt(docs)
    counts = dealt.groupBy("grp").applyInArrow(_bucket_counts(width), "bucket int, grp int, hashes binary, counts binary")
    totals = counts.groupBy("bucket").applyInArrow(_bucket_totals, "bucket int, grp int, totals binary")
    both = dealt.groupBy("grp").cogroup(totals.groupBy("grp"))
    runs = materialise(both.applyInArrow(_shared_runs(), RUNS), "repeat-runs")
    slices_of = materialise(runs.groupBy("gram", "digest").agg(F.count("*").alias("occurs"), F.max(F.col("bytes").isNotNull()).alias("sent")), "repeat-slices")
    grams = slices_of.groupBy("gram").agg(F.count("*").alias("slices"), F.min("sent").alias("sent"), F.max("occurs").alias("occurs"))
    lacking, most = grams.where("slices > 1").agg(F.count(F.when(~F.col("sent"), 1)), F.max("slices")).first()
    if lacking:  # two hashes met and a count was too high: send the bytes of these grams after all
        named = {r.gram for r in grams.where("slices > 1 and not sent").select("gram").collect()} if lacking <= MAX_NAMED else None
        runs = materialise(both.applyInArrow(_shared_runs(named), RUNS), "repeat-runs")
    sent = runs.where(F.col("bytes").isNotNull()).select("gram", "digest", "at", "bytes")
    if (most or 0) > hot:
        asked = sent.join(grams.select("gram", "slices"), "gram").withColumn("parts", F.least(F.ceil(F.col("slices") / hot), F.lit(SPAN)).cast("int"))
        asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        low, high = F.floor(F.col("part") * SPAN / F.col("parts")), F.floor((F.col("part") + 1) * SPAN / F.col("parts"))
        asked = asked.withColumn("off", F.greatest(F.lit(0), F.col("at") - high + 1).cast("int")).withColumn("to", F.least(F.length("bytes") - LENGTH, F.col("at") - low).cast("int")).where("off <= to")
        asked = asked.withColumn("bytes", F.substring(F.col("bytes"), F.col("off") + 1, F.col("to") - F.col("off") + LENGTH))
    else:
        asked = sent.withColumn("off", F.lit(0)).withColumn("part", F.lit(0))
    volume = asked.agg(F.sum(F.length("bytes"))).first()[0] or 0
    shards = max(1, -(-volume // shard_bytes))
    sharded = asked.select(F.pmod(F.xxhash64("gram", "part"), F.lit(shards)).alias("shard"), "digest", "off", "bytes")
    parts = sharded.groupBy("shard").applyInArrow(_sorted_shard, "digest binary, a long, b long")
    whole = slices_of.where("occurs > 1").select("digest", F.lit(0).cast("long").alias("a"), F.lit(None).cast("long").alias("b"))
    single = parts.join(slices_of.where("occurs = 1").select("digest"), "digest", "left_semi")
    found = runs.select("grp", "doc", "lo", "n", "digest").join(whole.unionByName(single), "digest")
    return found.select("grp", "doc", (F.col("lo") + F.col("a")).alias("a"), (F.col("lo") + F.coalesce("b", F.col("n") - 1) + LENGTH).alias("b"))


def _kept(docs: pa.Table, ranges: pa.Table) -> tuple[pa.Table, list[tuple[bytes, bytes, int]]]:
    """Per document of a group: its bytes, the bytes left, and the number of maximal removed runs."""
    docs, texts = _group(docs)
    doc, a, b = (ranges.column(c).to_numpy() for c in ("doc", "a", "b"))
    order = np.lexsort((a, doc))
    doc, a, b = doc[order], a[order], b[order]
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for k, text in enumerate(texts):
        x, y = a[at[k] : at[k + 1]], np.maximum.accumulate(b[at[k] : at[k + 1]]) if at[k] < at[k + 1] else ()
        if not len(x):
            out.append((text, text, 0))
            continue
        new = np.r_[True, x[1:] > y[:-1]]
        froms, tos = x[new].tolist(), y[np.r_[np.flatnonzero(new)[1:] - 1, len(x) - 1]].tolist()
        out.append((text, b"".join(text[i:j] for i, j in zip([0, *tos], [*froms, len(text)])), len(froms)))
    return docs, out


def _digests(key: tuple, docs: pa.Table, ranges: pa.Table) -> pa.Table:
    docs, kept = _kept(docs, ranges)
    cols = [[len(t) for t, _, _ in kept], [len(t) - len(k) for t, k, _ in kept], [s for _, _, s in kept]]
    return pa.table([docs.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols), pa.array([hashlib.sha256(k).hexdigest() for _, k, _ in kept], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    ranges = repeated_ranges(docs)
    return _dealt(docs).groupBy("grp").cogroup(ranges.groupBy("grp")).applyInArrow(_digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with its columns, text reduced to the bytes kept (characters cut apart are dropped) and n_chars counted anew."""
    ranges = repeated_ranges(docs)
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    inner = [f"other_{i}" for i in range(len(others))]  # names that clash with none in here
    chars = inner[others.index("n_chars")] if "n_chars" in others else None

    def run(key: tuple, rows: pa.Table, spans: pa.Table) -> pa.Table:
        rows, kept = _kept(rows, spans)
        texts = [k.decode("utf-8", "ignore") for _, k, _ in kept]
        cols = {n: rows.column(n) for n in inner}
        if chars:
            cols[chars] = pa.array([len(t) for t in texts], rows.schema.field(chars).type)
        return pa.table({"doc_id": rows.column("doc_id"), "text": pa.array(texts, pa.string()), **cols})

    dealt = _dealt(docs, *(F.col(c).alias(n) for c, n in zip(others, inner)))
    cut = dealt.groupBy("grp").cogroup(ranges.groupBy("grp")).applyInArrow(run, dealt.drop("grp").schema)
    return cut.select("doc_id", "text", *(F.col(n).alias(c) for c, n in zip(others, inner))).select(docs.columns)
