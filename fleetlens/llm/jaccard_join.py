"""Exact n-gram Jaccard join in the metric space of shingle sets (operator 7).

Jaccard distance d is a metric, so for a pivot p two sets with d(x, y) <= eps have
|d(x, p) - d(y, p)| <= eps.  Far from a pivot all distances are 1 and say nothing, so
the space is first cut to where they do:

1. Document frequencies.  A set that links with another shares 3/4 of its shingles
   with it, so a document with more than a quarter of shingles that no other document
   has links with nothing.  Shingle hashes are counted in packed arrays: each document
   group sends one sorted array per hash bucket, each bucket returns frequency classes
   for the same array, so hot shingles move once per group.
2. Documents with equal sets are one class.  Classes that share one of the rare
   shingles that any partner must share (the first n - ceil(3n/4) + 1 in order of
   frequency class and hash) are put in one cell; links never leave a cell.
3. In a cell, pivots create Voronoi regions: each set belongs to its nearest pivot and
   is replicated to the regions whose pivot is at most 2 eps farther (no other region
   can hold a partner).  Regions join recursively; what doesn't shrink is swept with the
   triangle windows of all pivots.  Sets that are already connected aren't compared.
4. A cell with more than ``CELL`` classes is cut before it reaches a task: blocks of
   equal rank of the distance to its pivot, and a task per pair of blocks whose
   distances come within eps; blocks inside the pivot's eps-ball need no pair.

Edge cases: null text is empty; a document without words has no shingles and links
with nothing; with fewer than five words the whole sequence is its one shingle;
repeated rows are one class and come back once each; rows with a null doc_id link
nothing, and have a component only through named rows of the same set; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, shuffle_width, slices, text_rows
from fleetlens.llm.components import components

WORDS = 5
#: Link when SHARE_OF * shared >= SHARE * union.
SHARE, SHARE_OF = 75, 100
EPS = 1 - SHARE / SHARE_OF
#: Classes per cell that one task joins.
CELL = 1_024
PIVOTS = 6
#: Word hashes kept while a table of texts is read (about 40 MB); a worker keeps none between tasks.
MAX_CACHED_WORDS = 200_000
#: Regions up to this size are compared directly.
SMALL = 48

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


class _WordHashes(dict):
    """word -> 8 bytes of its hash (bounded)."""

    def __missing__(self, word: bytes) -> bytes:
        import xxhash

        got = xxhash.xxh3_64_digest(word)
        if len(self) < MAX_CACHED_WORDS:
            self[word] = got
        return got


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(text: str, n: int = WORDS, hashes: _WordHashes | None = None) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams of a text; ``hashes`` may be shared by several texts."""
    words = text.encode().translate(_LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.frombuffer(b"".join(map((_WordHashes() if hashes is None else hashes).__getitem__, words)), "<u8")
    n = min(n, len(h))
    s = np.full(len(h) - n + 1, n, np.uint64)
    for k in range(n):
        s = _mixed(s + h[k : len(h) - n + 1 + k] * _MIX[k % len(_MIX)])
    return np.unique(s)


def _sets(texts: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of several texts end to end, and the size of each set."""
    hashes = _WordHashes()
    found = [shingles(t, hashes=hashes) for part in ([texts] if isinstance(texts, pa.Array) else texts.chunks) for i in range(0, len(part), 500) for t in part.slice(i, 500).to_pylist()]
    sizes = np.array([len(s) for s in found], np.int64)
    return (np.concatenate(found) if found else np.empty(0, np.uint64)), sizes


def _cuts(values: np.ndarray, buckets: int) -> np.ndarray:
    """Places in a sorted array where each bucket (by the leading bits) begins, and its length."""
    edges = [(k << 64) // buckets for k in range(1, buckets)]
    return np.r_[0, np.searchsorted(values, np.array(edges, np.uint64)), len(values)]


def _bucket_arrays(buckets: int):
    """Group of documents -> one row per hash bucket: sorted low halves of its distinct hashes and their counts."""

    def run(key: tuple, docs: pa.Table) -> pa.Table:
        flat, _ = _sets(docs.column("text"))
        values, counts = np.unique(flat, return_counts=True)
        at = _cuts(values, buckets)
        low, few = values.astype("<u4"), np.minimum(counts, 255).astype("u1")
        rows = [(k, key[0].as_py(), low[a:b].tobytes(), few[a:b].tobytes()) for k, (a, b) in enumerate(zip(at[:-1], at[1:])) if b > a]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 4, (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], names=["bucket", "grp", "low", "counts"])

    return run


def _frequency_classes(key: tuple, rows: pa.Table) -> pa.Table:
    """A bucket's arrays -> per group, the class of each hash: 0 in one document, else the bits of (documents - 1), 9 at most.

    Halves of different hashes may meet; that can only raise a class.
    """
    lows = [np.frombuffer(x, "<u4") for x in rows.column("low").to_pylist()]
    counts = np.frombuffer(b"".join(rows.column("counts").to_pylist()), "u1")
    _, inverse = np.unique(np.concatenate(lows), return_inverse=True)
    total = np.bincount(inverse, weights=counts)
    klass = np.minimum(np.ceil(np.log2(np.maximum(total, 1))), 9).astype("u1")[inverse]
    at = np.r_[0, np.cumsum([len(x) for x in lows])]
    return pa.table([pa.array([key[0].as_py()] * len(lows), pa.int32()), rows.column("grp"), pa.array([klass[a:b].tobytes() for a, b in zip(at[:-1], at[1:])], pa.binary())], names=["bucket", "grp", "classes"])


def _surviving_sets(key: tuple, docs: pa.Table, masks: pa.Table) -> pa.Table:
    """doc_id, size, and for a document that may link: digest, set ordered by frequency class, length of its indexed part.

    ``rare`` is how many leading shingles a partner must share one of; ``alone`` of them
    are in this document only.
    """
    flat, sizes = _sets(docs.column("text"))
    values, inverse = np.unique(flat, return_inverse=True)
    order = np.argsort(masks.column("bucket").to_numpy())
    parts = masks.column("classes").to_pylist()
    klass = np.frombuffer(b"".join(parts[i] for i in order), "u1")[inverse]
    ends = np.cumsum(sizes)
    cols: list[list] = [[], [], [], []]
    for end, n in zip(ends.tolist(), sizes.tolist()):
        k, need = klass[end - n : end], -(-SHARE * n // SHARE_OF)
        alone = int((k == 0).sum())
        if not n or n - alone < need:
            row = (None, None, None, None)
        else:
            own = flat[end - n : end]  # ascending, so a stable sort by class is by class and hash
            row = (hashlib.blake2b(own.tobytes(), digest_size=16).digest(), own[np.argsort(k, kind="stable")].tobytes(), n - need + 1, alone)
        for c, x in zip(cols, row):
            c.append(x)
    return pa.table([docs.column("doc_id"), pa.array(sizes), *(pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.int32(), pa.int32())))], names=["doc_id", "n", "digest", "shingles", "rare", "alone"])


def candidate_sets(docs: DataFrame) -> DataFrame:
    """Sets of all documents (step 1).  Texts move once: both uses of ``dealt`` read one exchange."""
    width = shuffle_width(docs.sparkSession)
    dealt = text_rows(docs, F.pmod(F.xxhash64("doc_id"), F.lit(width)).cast("int").alias("grp")).repartition(width, "grp")
    arrays = dealt.groupBy("grp").applyInArrow(_bucket_arrays(width), "bucket int, grp int, low binary, counts binary")
    masks = arrays.groupBy("bucket").applyInArrow(_frequency_classes, "bucket int, grp int, classes binary")
    both = dealt.groupBy("grp").cogroup(masks.groupBy("grp"))
    return both.applyInArrow(_surviving_sets, "doc_id long, n long, digest binary, shingles binary, rare int, alone int")


def _indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, class_id) of the shingles of which any partner shares one, without those no partner has."""
    for b in slices(batches, "shingles"):
        ids, out = b.column(0).to_numpy(zero_copy_only=False), []
        for blob, rare, alone in zip(*(b.column(i).to_pylist() for i in (1, 2, 3))):
            out.append(np.frombuffer(blob, "<i8")[min(alone, rare) : rare])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out)), pa.array(np.repeat(ids, [len(x) for x in out]))], names=["shingle", "class_id"])


class Cell:
    """Sets of one cell as rows of a sparse matrix, and the union-find of what is linked."""

    def __init__(self, ids: np.ndarray, blobs: list[bytes]):
        self.ids = ids
        sets = [np.frombuffer(x, "<u8") for x in blobs]
        self.n = np.array([len(s) for s in sets], np.int64)
        self.begin = np.cumsum(self.n) - self.n
        values, self.cols = np.unique(np.concatenate(sets), return_inverse=True)
        self.flag = np.zeros(len(values), bool)
        self.root = np.arange(len(ids))

    def _row(self, i: int) -> np.ndarray:
        return self.cols[self.begin[i] : self.begin[i] + self.n[i]]

    def shared(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Shingles that set i shares with each of ``rows``."""
        own = self._row(i)
        self.flag[own] = True
        sizes = self.n[rows]
        starts = np.cumsum(sizes) - sizes
        at = np.repeat(self.begin[rows] - starts, sizes) + np.arange(int(sizes.sum()))
        out = np.add.reduceat(self.flag[self.cols[at]].astype(np.int64), starts)
        self.flag[own] = False
        return out

    def compare(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Distances from set i to ``rows``; links what is near enough (decided in whole numbers)."""
        if not len(rows):
            return np.empty(0)
        shared = self.shared(i, rows)
        union = self.n[i] + self.n[rows] - shared
        for j in rows[SHARE_OF * shared >= SHARE * union].tolist():
            self.link(i, j)
        return 1 - shared / union

    def link(self, i: int, j: int) -> None:
        a, b = self.root[i], self.root[j]
        if a != b:  # the root is the row with the smallest id; rows are in order of id
            self.root[self.root == max(a, b)] = min(a, b)

    def join(self, rows: np.ndarray) -> None:
        """Link all near pairs among ``rows`` (recursive Voronoi regions)."""
        if len(rows) <= SMALL:
            self.sweep(rows, np.zeros((len(rows), 0)))
            return
        pivots = rows[np.linspace(0, len(rows) - 1, PIVOTS).astype(int)]
        d = np.stack([self.compare(int(p), rows) for p in pivots], 1)
        if len(np.unique(self.root[rows])) == 1:
            return
        home = d.argmin(1)
        nearest = d[np.arange(len(rows)), home]
        inside = d <= nearest[:, None] + 2 * EPS + 1e-9
        if inside.sum(0).max() > 0.8 * len(rows):
            self.sweep(rows, d)
            return
        for k in range(PIVOTS):
            self.join(rows[inside[:, k]])

    def sweep(self, rows: np.ndarray, d: np.ndarray) -> None:
        """Compare each row with the later ones it isn't connected to and whose pivot distances are within eps."""
        for k in range(len(rows) - 1):
            later = self.root[rows[k + 1 :]] != self.root[rows[k]]
            if d.shape[1] and later.any():
                later &= (np.abs(d[k + 1 :] - d[k]) <= EPS + 1e-9).all(1)
            if later.any():
                small = np.minimum(self.n[rows[k + 1 :]], self.n[rows[k]]) * SHARE_OF >= np.maximum(self.n[rows[k + 1 :]], self.n[rows[k]]) * SHARE
                self.compare(int(rows[k]), rows[k + 1 :][later & small])


def _join_cell(key: tuple, rows: pa.Table) -> pa.Table:
    """Edges from each class of a cell to the smallest class it is connected to."""
    rows = rows.sort_by("class_id")
    cell = Cell(rows.column("class_id").to_numpy(), rows.column("shingles").to_pylist())
    cell.join(np.arange(len(cell.ids)))
    linked = np.flatnonzero(cell.root != np.arange(len(cell.ids)))
    return pa.table([pa.array(cell.ids[linked]), pa.array(cell.ids[cell.root[linked]])], names=["a", "b"])


def _distances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches, "shingles"):
        out = []
        for own, pivot in zip(b.column(3).to_pylist(), b.column(5).to_pylist()):
            x, p = np.frombuffer(own, "<u8"), np.frombuffer(pivot, "<u8")
            s = len(np.intersect1d(x, p, assume_unique=True))
            out.append(((len(x) + len(p) - 2 * s) / (len(x) + len(p) - s), SHARE_OF * s >= SHARE * (len(x) + len(p) - s)))
        yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array([x[0] for x in out], pa.float64()), pa.array([x[1] for x in out], pa.bool_())], names=["cell", "class_id", "key", "shingles", "pivot_id", "d", "near"])


def split_cells(members: DataFrame, sizes: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Cells over ``limit`` (step 4): edges to their pivots, and the block pairs that remain as cells of their own."""
    large = members.join(sizes.where(F.col("size") > limit), "cell")
    pivot = large.groupBy("cell").agg(F.min(F.struct("class_id", "shingles")).alias("p")).select("cell", F.col("p.class_id").alias("pivot_id"), F.col("p.shingles").alias("pivot"))
    asked = large.select("cell", "class_id", (F.pmod(F.xxhash64("class_id"), F.lit(1 << 20)) / float(1 << 40)).alias("key"), "shingles", "size").join(pivot, "cell")
    measured = materialise(asked.select("cell", "class_id", "key", "shingles", "pivot_id", "pivot").mapInArrow(_distances, "cell long, class_id long, key double, shingles binary, pivot_id long, d double, near boolean"), "pivot-distances")
    ranked = measured.withColumn("key", F.col("d") + F.col("key"))  # ties are cut by a hash
    counts = ranked.groupBy("cell").agg(F.count("*").alias("size")).withColumn("blocks", F.ceil(2 * F.col("size") / limit).cast("int"))
    most = counts.agg(F.max("blocks")).first()[0]
    shares = [k / most for k in range(1, most)] or [0.5]
    bounds = ranked.groupBy("cell").agg(F.percentile_approx("key", shares, 10_000).alias("bounds"))
    blocks = ranked.join(bounds, "cell").withColumn("block", F.size(F.filter("bounds", lambda x: x < F.col("key")))).drop("bounds", "key")
    spans = blocks.groupBy("cell", "block").agg(F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("near").alias("core"))
    a, b = spans.alias("a"), spans.alias("b")
    pairs = a.join(b, (F.col("a.cell") == F.col("b.cell")) & (F.col("a.block") <= F.col("b.block")) & (F.col("b.lo") - F.col("a.hi") <= EPS + 1e-9) & ~(F.col("a.core") & F.col("b.core")))
    sub = F.xxhash64(F.col("a.cell"), F.col("a.block"), F.col("b.block")).alias("sub")
    wanted = pairs.select(F.col("a.cell").alias("cell"), F.explode(F.array_distinct(F.array("a.block", "b.block"))).alias("block"), sub)
    parts = blocks.join(wanted, ["cell", "block"]).select(F.col("sub").alias("cell"), "class_id", "shingles")
    return measured.where("near").select(F.col("class_id").alias("a"), F.col("pivot_id").alias("b")), parts


def shingle_components(docs: DataFrame, cell: int = CELL) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document."""
    sets = materialise(candidate_sets(docs), "shingle-sets")
    kept = sets.where(F.col("digest").isNotNull() & F.col("doc_id").isNotNull())
    classes = materialise(kept.groupBy("digest").agg(F.min("doc_id").alias("class_id"), F.first("shingles").alias("shingles"), F.first("rare").alias("rare"), F.first("alone").alias("alone")), "shingle-classes")
    index = materialise(classes.select("class_id", "shingles", "rare", "alone").mapInArrow(_indexed, "shingle long, class_id long"), "shingle-index")
    heads = index.groupBy("shingle").agg(F.min("class_id").alias("head"), F.max("class_id").alias("last")).where("head < last").select("shingle", "head")
    cells = components(index.join(heads, "shingle").where("class_id <> head").select(F.col("class_id").alias("a"), F.col("head").alias("b")).distinct())
    members = materialise(classes.select("class_id", "shingles").join(cells.select(F.col("id").alias("class_id"), F.col("component").alias("cell")), "class_id"), "cells")
    sizes = members.groupBy("cell").agg(F.count("*").alias("size"))
    edges = members.join(sizes.where(F.col("size") <= cell), "cell").select("cell", "class_id", "shingles").groupBy("cell").applyInArrow(_join_cell, "a long, b long")
    largest = sizes.agg(F.max("size")).first()[0] or 0
    if largest > cell:
        to_pivots, parts = split_cells(members, sizes, cell)
        edges = edges.unionByName(to_pivots).unionByName(parts.groupBy("cell").applyInArrow(_join_cell, "a long, b long"))
    linked = components(edges).select(F.col("id").alias("class_id"), F.col("component"))
    of_class = classes.select("digest", "class_id").join(linked, "class_id", "left").select("digest", F.coalesce("component", "class_id").alias("component"))
    return sets.select("doc_id", "n", "digest").join(of_class, "digest", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))
