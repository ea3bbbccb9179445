"""Importance resampling towards a target distribution, over distinct lines (operator 12).

Features of a text are its words and the pairs of consecutive words, hashed into
``BUCKETS``.  A bucket's gain says how much more often the target has it than the corpus;
a document's weight is the mean gain of its features, and documents are drawn by weight
plus Gumbel noise (the largest scores without replacement).

Words never hold a line feed, so a text is cut at line feeds and equal lines, wherever
they stand, share their features:

* distinct lines are found by Spark (partial counts first, so a line that a third of the
  corpus repeats moves once per task) and hashed once; corpus counts add a line's buckets
  times its occurrences;
* pairs that cross a line feed (last word of a line, first word of the next line that has
  one) belong to no line and are added per document;
* a line's summed gain is computed once and joined to the documents that hold it by a
  128-bit digest.  Lines that are more than 1/2,048 of all lines are at most 2,048 rows and
  are broadcast; no other line can be a hot key.

Edge cases: null and empty texts, and texts without a word, have no features and weight 0;
a null doc_id takes the noise of the empty id and sorts last among ties; rows that repeat a
doc_id and text give one result row each, with the same score and neighbouring ranks; an
empty target has no counts, which leaves the smoothing; very long words are hashed outside
the tables.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, shuffle_width, slices, text_rows

BUCKETS = 10_000
MIN_WORDS, DRAWN_PERCENT = 20, 25
#: Lines with at least this share of all lines are joined by broadcast: at most so many rows.
HOT_SHARE = 2_048
_TABLE_LENGTHS = 64

#: A-Z lower-cased; every byte outside words becomes a blank (line feeds stay in the second table).
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LINES = _WORDS[:10] + b"\n" + _WORDS[11:]


def _shift_tables() -> np.ndarray:
    """[length][byte place][byte]: what crc32 becomes when `length` bytes follow (without those bytes' own crc32)."""
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, step >> 1 ^ np.uint32(0xEDB88320), step >> 1)
    out = np.empty((_TABLE_LENGTHS + 1, 4, 256), np.uint32)
    out[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(_TABLE_LENGTHS):
        out[k + 1] = out[k] >> 8 ^ step[out[k] & 255]
    return out


class Words(dict):
    """word -> number, with crc32, crc32 with a blank behind, and length by number."""

    shifts: np.ndarray | None = None

    def __init__(self) -> None:
        super().__init__()
        self.raw: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self.raw)
        self.raw.append(word)
        return n

    def crcs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = np.fromiter(map(zlib.crc32, self.raw), np.uint32, len(self.raw))
        spaced = np.fromiter((zlib.crc32(b" ", c) for c in plain.tolist()), np.uint32, len(self.raw))
        return plain, spaced, np.fromiter(map(len, self.raw), np.int64, len(self.raw))

    def pairs(self, first: np.ndarray, second: np.ndarray, crcs: tuple[np.ndarray, np.ndarray, np.ndarray]) -> np.ndarray:
        """crc32 of `first second` for arrays of word numbers."""
        if Words.shifts is None:
            Words.shifts = _shift_tables()
        plain, spaced, lengths = crcs
        head, length = spaced[first], lengths[second]
        short = np.minimum(length, _TABLE_LENGTHS)
        out = plain[second]
        for k in range(4):
            out = out ^ Words.shifts[short, k, head >> np.uint32(8 * k) & 255]
        for i in np.flatnonzero(length > _TABLE_LENGTHS).tolist():
            out[i] = zlib.crc32(self.raw[second[i]], int(head[i]))
        return out


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all features one text after another, number of features per text) of texts taken as one line each."""
    words, numbers, n = Words(), [], []
    for t in texts:
        before = len(numbers)
        numbers.extend(map(words.__getitem__, t.translate(_WORDS).split()))
        n.append(len(numbers) - before)
    count, ids = np.array(n, np.int64), np.array(numbers, np.int64)
    if not len(ids):
        return np.zeros(0, np.uint16), np.zeros(len(texts), np.int64)
    crcs = words.crcs()
    row = np.repeat(np.arange(len(texts)), count)
    # of w words there are 2w - 1 features: a word, the pair that it begins, the next word, ...
    place = 2 * np.arange(len(ids)) - (np.cumsum(count > 0) - 1)[row]
    out = np.zeros(2 * len(ids) - int((count > 0).sum()), np.uint16)
    out[place] = crcs[0][ids] % BUCKETS
    joined = np.flatnonzero(row[1:] == row[:-1])
    out[place[joined] + 1] = words.pairs(ids[joined], ids[joined + 1], crcs) % BUCKETS
    return out, np.maximum(2 * count - 1, 0)


def crossing_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The same of the pairs that cross a line feed."""
    words, first, second, n = Words(), [], [], []
    for t in texts:
        before, last = len(first), None
        for line in t.translate(_LINES).split(b"\n"):
            head = line.split(None, 1)
            if head:
                if last is not None:
                    first.append(words[last])
                    second.append(words[head[0]])
                last = line.rsplit(None, 1)[-1]
        n.append(len(first) - before)
    if not first:
        return np.zeros(0, np.uint16), np.array(n, np.int64)
    got = words.pairs(np.array(first), np.array(second), words.crcs()) % BUCKETS
    return got.astype(np.uint16), np.array(n, np.int64)


def _packed(buckets: np.ndarray, n: np.ndarray) -> pa.Array:
    """One binary value (16-bit buckets) per row."""
    ends = np.r_[0, np.cumsum(n) * 2].astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(buckets.astype("<u2").tobytes())])


def _feature_rows(of, *kept: str):
    """Rows of the kept columns with their features, `of` being applied to the column named text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            found = _packed(*of(b.column(b.schema.get_field_index("text")).cast(pa.binary()).to_pylist()))
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), found], names=[*kept, "buckets"])

    return run


def _count_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(bucket, n) of a task's rows (buckets, times): at most BUCKETS rows a task."""
    total = np.zeros(BUCKETS, np.int64)
    for b in batches:
        times = b.column(1).to_numpy()
        for k in np.unique(times).tolist():
            rows = pa.RecordBatch.from_arrays([b.column(0)], names=["b"]).filter(pa.array(times == k)).column(0)
            total += k * np.bincount(_flat(rows), minlength=BUCKETS)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int64)), pa.array(total[some])], names=["bucket", "n"])


def _flat(column: pa.Array) -> np.ndarray:
    """The 16-bit numbers of a binary column, one row after another."""
    return np.frombuffer(b"".join(column.to_pylist()), "<u2")


def bucket_counts(rows: DataFrame) -> DataFrame:
    """bucket, n over rows of (buckets, times)."""
    return rows.mapInArrow(_count_rows, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def _gain_rows(gains: np.ndarray, kept: list[str]):
    """Kept columns, number of features and summed gain of rows with buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = b.column(b.schema.get_field_index("buckets"))
            n = np.array([len(x) // 2 for x in column.to_pylist()], np.int64)
            upto = np.r_[0, np.cumsum(gains[_flat(column)])]
            ends = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(k)) for k in kept), pa.array(n), pa.array(upto[ends] - upto[ends - n])], names=[*kept, "features", "gain"])

    return run


def _digest(column) -> F.Column:
    return F.unhex(F.substring(F.sha2(column, 256), 1, 32))


def gains_of(source: DataFrame, target: DataFrame) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + B) / ((s + 1)(T + B)))) per bucket, from (bucket, n) of corpus and target."""
    sums = {k: int(d.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) for k, d in (("s", source), ("t", target))}
    every = source.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"))
    both = every.join(source.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)
    ratio = ((F.col("t") + 1).cast("double") * float(sums["s"] + BUCKETS)) / ((F.col("s") + 1).cast("double") * float(sums["t"] + BUCKETS))
    out = np.zeros(BUCKETS, np.int64)
    for r in both.select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain")).collect():  # BUCKETS rows
        out[r.bucket] = r.gain
    return out


def weights(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, digest (of the text), copies (rows that repeat both), features, gain: sums over one copy."""
    rows = text_rows(docs).withColumn("digest", _digest(F.col("text")))
    lines = rows.select("doc_id", "digest", F.explode(F.split("text", "\n")).alias("text")).where("text <> ''")
    distinct = lines.groupBy("text").agg(F.count("*").alias("times")).withColumn("line", _digest(F.col("text")))
    held = materialise(distinct.mapInArrow(_feature_rows(line_features, "line", "times"), "line binary, times long, buckets binary").where("length(buckets) > 0"), "resampling-lines")
    crossing = materialise(rows.mapInArrow(_feature_rows(crossing_features, "doc_id", "digest"), "doc_id long, digest binary, buckets binary"), "resampling-crossings")
    source = bucket_counts(held.select("buckets", "times").union(crossing.select("buckets", F.lit(1).cast("long"))))
    aimed = text_rows(target.select(F.lit(0).alias("doc_id"), "text")).mapInArrow(_feature_rows(line_features, "doc_id"), "doc_id long, buckets binary")
    gains = gains_of(materialise(source, "resampling-source"), materialise(bucket_counts(aimed.select("buckets", F.lit(1).cast("long").alias("times"))), "resampling-target"))

    total = held.agg(F.coalesce(F.sum("times"), F.lit(0))).first()[0]
    known = materialise(held.mapInArrow(_gain_rows(gains, ["line", "times"]), "line binary, times long, features long, gain long"), "resampling-gains")
    hot = F.broadcast(known.where(F.col("times") * HOT_SHARE >= total).drop("times"))  # at most HOT_SHARE rows
    named = lines.select("doc_id", "digest", _digest(F.col("text")).alias("line"))
    often = named.join(hot, "line")
    seldom = named.join(hot.select("line"), "line", "left_anti").join(known.where(F.col("times") * HOT_SHARE < total).drop("times"), "line")
    across = crossing.mapInArrow(_gain_rows(gains, ["doc_id", "digest"]), "doc_id long, digest binary, features long, gain long").withColumn("copies", F.lit(1))
    parts = [d.select("doc_id", "digest", "features", "gain", F.lit(0).alias("copies")) for d in (often, seldom)] + [across]
    sums = parts[0].union(parts[1]).unionByName(parts[2]).groupBy("doc_id", "digest").agg(*(F.sum(c).alias(c) for c in ("features", "gain", "copies")))
    return sums.selectExpr("doc_id", "digest", "cast(copies as long) copies", "features div copies features", "gain div copies gain")


def noise(doc_id, seed: int = 7) -> F.Column:
    """floor(-1000 ln(-ln((h + 0.5) / 2**32))), h from the sha256 of `seed:doc_id`."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0))).cast("long")


def resample(docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, least: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_features, weight, score, rank (null: not drawn) of every document."""
    found = weights(docs, target)
    mean = F.expr("case when features > 0 then (gain - pmod(gain, features)) div features else 0 end")
    scored = found.select("doc_id", "digest", "copies", F.col("features").alias("n_features"), mean.alias("weight")).withColumn("score", F.col("weight") + noise(F.col("doc_id")))
    # a row that repeats very often is dealt in runs of copies, each its own row from here on
    runs = scored.withColumn("run", F.explode(F.expr("sequence(0L, (copies - 1) div 4096)"))).withColumn("copies", F.expr("least(4096, copies - 4096 * run)"))
    width = shuffle_width(docs.sparkSession)
    dealt = runs.repartitionByRange(width, F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("digest"), F.asc("run"))
    one = dealt.withColumn("copy", F.explode(F.expr("sequence(1L, copies)"))).select("doc_id", "digest", "run", "copy", "n_features", "weight", "score", F.spark_partition_id().alias("part"))
    rows = materialise(one, "resampling-scores")
    able = F.col("n_features") >= 2 * least - 1  # w words have 2w - 1 features
    sizes = rows.where(able).groupBy("part").agg(F.count("*").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))  # one row per partition
    drawn = percent * (sizes.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]) // 100
    inside = Window.partitionBy("part").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "digest", "run", "copy")
    placed = rows.where(able).withColumn("place", F.row_number().over(inside)).join(F.broadcast(before), "part").withColumn("place", (F.col("place") + F.col("before")).cast("long"))
    ranked = placed.select("doc_id", "n_features", "weight", "score", F.when(F.col("place") <= drawn, F.col("place")).alias("rank"))
    return ranked.union(rows.where(~able).select("doc_id", "n_features", "weight", "score", F.lit(None).cast("long")))


ORACLE = r"""
WITH RECURSIVE step AS (
  SELECT i::BIGINT AS i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i)
), texts AS (
  SELECT 'd' AS side, doc_id AS id, row_number() OVER () AS row, text FROM documents
  UNION ALL SELECT 'b', item_id, row_number() OVER (), text FROM benchmark
), words AS (
  SELECT side, id, row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM texts
), features AS (
  SELECT side, row, unnest(w) AS f FROM words
  UNION ALL SELECT side, row, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM words WHERE len(w) > 1
), spelled AS (
  SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM features)
), run(f, h, k, c) AS (
  SELECT f, h, 0, 4294967295::BIGINT FROM spelled
  UNION ALL
  SELECT r.f, r.h, k + 1, xor(c >> 8, s.v) FROM run r
  JOIN step s ON s.i = xor(c & 255, ('0x' || substr(r.h, 2 * k + 1, 2))::BIGINT) WHERE 2 * k < length(r.h)
), hashed AS (
  SELECT f, xor(c, 4294967295) % 10000 AS bucket FROM run WHERE 2 * k = length(h)
), counted AS (
  SELECT bucket, count(*) FILTER (WHERE side = 'd') AS s, count(*) FILTER (WHERE side = 'b') AS t FROM features JOIN hashed USING (f) GROUP BY 1
), gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM counted
), weighed AS (
  SELECT row, count(*) AS n, floor(sum(gain)::DOUBLE / count(*))::BIGINT AS weight FROM features JOIN hashed USING (f) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY 1
), scored AS (
  SELECT w.id AS doc_id, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight, len(w.w) AS words,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(w.id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM words w LEFT JOIN weighed USING (row) WHERE w.side = 'd'
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS able FROM scored
)
SELECT doc_id, n_features::BIGINT AS n_features, weight, score, CASE WHEN words >= 20 AND place <= 25 * able // 100 THEN place END AS rank FROM placed
"""
