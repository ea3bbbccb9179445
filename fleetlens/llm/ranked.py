"""Ranked lexical search by sequential reads of impact-sorted lists, NRA (operator 13).

Every item (row group of ``item_id``) is a query against all documents.  What a term adds to
a document's score, its impact, needs counts over the whole corpus, so there are two passes:

1. texts are cut into terms where they are read; per document its length and its postings
   of query terms go to the shared folder, and Spark adds up documents, terms and document
   frequencies;
2. a task reads its documents' postings in shards of at most ``SHARD_POSTINGS``, sorts each
   term's list by impact and answers each item by NRA: blocks of every list are read from
   the top, a document's lower bound is what was read of it, its upper bound adds the next
   unread impact of every list it wasn't met in.  Reading goes on until no unread or
   contending document can reach the 50th lower bound and every document that can tie or
   pass it has equal bounds, so members, ties and scores are final.  The task's 50th score
   so far is the bar for its next shard.

The first 50 of all documents are among the first 50 of their task; a salted two-stage top-k
joins the tasks' lists.  Documents never move: shards are what a task reads.

Items are taken in blocks of about ``BLOCK_TERMS`` (item, term) rows, whose vocabulary is sent
to the tasks: bounded whatever the number of items, each block against all documents.

Edge cases: null and empty texts have no terms, count in no statistic and are never found;
items without terms, or whose terms no document has, return nothing; texts that share an
item_id are one item (null is an id of its own); rows that repeat a doc_id are ranked each; a
null doc_id comes after all others in a tie; a term in all documents may weigh 0 and then
finds nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, slices, text_rows
from fleetlens.operators.topk import top_k

BEST = 50
BLOCK_TERMS = 100_000
SHARD_POSTINGS = 1 << 20
FIRST_READ = 64

#: A-Z lower-cased; every byte outside terms becomes a blank.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LAST = np.iinfo(np.int64).max


def terms(raw: bytes) -> list[bytes]:
    return raw.translate(_TERMS).split()


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in slices(batches):
        for item, raw in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist()):
            own = sorted(set(terms(raw)))
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(own), pa.int64()), pa.array(own, pa.binary())], names=["item_id", "term"])


def _posting_rows(vocabulary: dict[bytes, int]):
    """doc_id, n, and the document's query terms and their occurrences as packed numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, width = vocabulary.get, max(1, len(vocabulary))
        for b in slices(batches, "text", 2 << 20):
            n, key = [], []
            for row, raw in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                words = terms(raw)
                n.append(len(words))
                base = row * width
                key.extend([base + t for t in map(known, words) if t is not None])
            some, times = np.unique(np.array(key, np.int64), return_counts=True)
            ends = np.searchsorted(some, np.arange(b.num_rows + 1) * width).astype(np.int32) * 4
            packed = [pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(x.astype("<u4").tobytes())]) for x in (some % width, times)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *packed], names=["doc_id", "n", "terms", "times"])

    return run


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(all numbers, how many per row) of a packed column."""
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<u4").astype(np.int64), np.array([len(x) // 4 for x in rows], np.int64)


def _frequency_rows(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            total += np.bincount(_numbers(b.column(0))[0], minlength=size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["term", "df"])

    return run


class Shard:
    """Impact-sorted lists of some documents."""

    def __init__(self, doc_ids: np.ndarray, doc: np.ndarray, term: np.ndarray, impact: np.ndarray, size: int):
        self.doc_ids = doc_ids
        order = np.lexsort((doc, -impact, term))
        self.doc, self.impact = doc[order], impact[order]
        self.start = np.searchsorted(term[order], np.arange(size + 1))

    def best(self, item: np.ndarray, most: int, bar: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(doc_ids, final scores) of the first documents for an item's terms, none below ``bar`` (of a bar, ties stay)."""
        lists = [(s, e) for s, e in zip(self.start[item].tolist(), self.start[item + 1].tolist()) if e > s]
        lower = np.zeros(len(self.doc_ids), np.int64)
        read, depth = 0, FIRST_READ
        while True:
            front = []
            for s, e in lists:
                a, b = s + read, min(s + depth, e)
                if a < e:
                    lower[self.doc[a:b]] += self.impact[a:b]  # a document stands once in a list
                front.append(int(self.impact[b]) if b < e else 0)
            unread, kth = sum(front), bar
            if len(lower) >= most:
                kth = max(bar, int(np.partition(lower, len(lower) - most)[len(lower) - most]))
            kth = max(kth, 1)  # scores must be above 0
            if unread < kth or not unread:
                near = np.flatnonzero(lower + unread >= kth)
                open_ = np.full(len(lower), unread, np.int64)  # what the unread parts can still add
                for (s, e), f in zip(lists, front):
                    if f:
                        open_[self.doc[s : min(s + depth, e)]] -= f
                near = near[lower[near] + open_[near] >= kth]
                if not unread or not open_[near].any():
                    break
            read, depth = depth, depth * 2
        near = near[np.lexsort((self.doc_ids[near], -lower[near]))][:most]
        return self.doc_ids[near], lower[near]


def _found_rows(items: list[tuple[int | None, np.ndarray]], weight: np.ndarray, documents: int, length: int, most: int, shard_postings: int):
    """item_id, doc_id, score: a task's first ``most`` documents per item."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in items]

        def answer(rows: list[tuple]) -> None:
            ids, n, count, term, times = (np.concatenate(x) for x in zip(*rows))
            doc = np.repeat(np.arange(len(ids)), count)
            mass = 50 + 50 * n * documents // length
            impact = weight[term] * (1_000_000_000 * times // (1000 * times + 20 * mass[doc]))
            real = impact > 0
            shard = Shard(ids, doc[real], term[real], impact[real], len(weight))
            for k, (_, own) in enumerate(items):
                bar = int(best[k][1][-1]) if len(best[k][1]) == most else 0
                i, s = (np.concatenate(x) for x in zip(best[k], shard.best(own, most, bar)))
                first = np.lexsort((i, -s))[:most]
                best[k] = i[first], s[first]

        held, postings = [], 0
        for b in batches:
            ids = b.column(0).fill_null(_LAST).to_numpy()
            n = b.column(1).to_numpy()
            term, count = _numbers(b.column(2))
            times, _ = _numbers(b.column(3))
            ends, i = np.cumsum(count), 0
            while i < len(ids):  # a shard ends at the first document that fills it
                begin = int(ends[i] - count[i])
                j = max(i + 1, int(np.searchsorted(ends, begin + shard_postings - postings, "right")))
                held.append((ids[i:j], n[i:j], count[i:j], term[begin : ends[j - 1]], times[begin : ends[j - 1]]))
                postings += int(ends[j - 1]) - begin
                if postings >= shard_postings or j < len(ids):
                    answer(held)
                    held, postings = [], 0
                i = j
        if held:
            answer(held)
        for (item, _), (i, s) in zip(items, best):
            yield pa.RecordBatch.from_arrays([pa.array([item] * len(i), pa.int64()), pa.array(i, mask=i == _LAST), pa.array(s)], names=["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, most: int = BEST, block_terms: int = BLOCK_TERMS, shard_postings: int = SHARD_POSTINGS) -> DataFrame:
    """item_id, rank, doc_id, score: the ``most`` best documents of every item, equal scores by doc_id."""
    spark = docs.sparkSession
    own = items.select(F.col("item_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    rows = materialise(own.mapInArrow(_item_rows, "item_id long, term binary").distinct(), "search-items")
    blocks = max(1, -(-rows.count() // block_terms))
    out = None
    for k in range(blocks):
        got: dict[int | None, list[bytes]] = {}
        for r in rows.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k).collect():  # about block_terms rows
            got.setdefault(r.item_id, []).append(bytes(r.term))
        vocabulary = {t: i for i, t in enumerate(sorted({t for x in got.values() for t in x}))}
        found = materialise(_search_block(docs, got, vocabulary, most, shard_postings), "search-found")
        out = found if out is None else out.union(found)
    if out is None:
        out = spark.createDataFrame([], "item_id long, doc_id long, score long")
    ranked = top_k(out, ["item_id"], [F.desc("score"), F.asc_nulls_last("doc_id")], most)
    return ranked.select("item_id", "rank", "doc_id", "score")


def _search_block(docs: DataFrame, items: dict[int | None, list[bytes]], vocabulary: dict[bytes, int], most: int, shard_postings: int) -> DataFrame:
    spark, size = docs.sparkSession, len(vocabulary)
    empty = spark.createDataFrame([], "item_id long, doc_id long, score long")
    postings = materialise(text_rows(docs).mapInArrow(_posting_rows(vocabulary), "doc_id long, n long, terms binary, times binary"), "search-postings")
    documents, length = postings.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not documents or not size:
        return empty
    frequency = postings.select("terms").mapInArrow(_frequency_rows(size), "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    weight = np.zeros(size, np.int64)
    for r in frequency.select("term", F.floor(1000 * F.log(F.lit(2.0 * documents + 2) / (2 * F.col("df") + 1).cast("double"))).cast("long").alias("w")).collect():  # the block's vocabulary
        weight[r.term] = r.w
    numbered = [(item, np.array(sorted(vocabulary[t] for t in own), np.int64)) for item, own in items.items()]
    return postings.where("length(terms) > 0").mapInArrow(_found_rows(numbered, weight, documents, length, most, shard_postings), "item_id long, doc_id long, score long")


ORACLE = r"""
WITH words AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents
), sizes AS (
  SELECT count(*) FILTER (WHERE len(w) > 0) AS documents, sum(len(w))::BIGINT AS length FROM words
), postings AS (
  SELECT row, doc_id, len(w) AS n, t, count(*) AS tf FROM (SELECT row, doc_id, w, unnest(w) AS t FROM words) GROUP BY row, doc_id, n, t
), weights AS (
  SELECT t, floor(1000 * ln((2 * documents + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM postings, sizes GROUP BY t, documents
), items AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS t FROM benchmark
), scored AS (
  SELECT item_id, row, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * documents) // length))))::BIGINT AS score
  FROM items JOIN postings USING (t) JOIN weights USING (t), sizes GROUP BY item_id, row, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""
