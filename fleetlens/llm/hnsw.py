"""Embedding near-duplicates by hierarchical navigable small-world graphs (operator 6).

Equal vectors are one class.  Classes are dealt to shards of a bounded size; each
shard's graph is built by one task and kept as a file in the shared folder, beside its
vectors.  Every class queries every shard, in blocks: a task names a block of one shard
and another shard (or the same), and reads both files, so that no vector or graph goes
through a shuffle or a JVM row for it.  A block's beam starts at ``BEAM`` and doubles
until an audit passes: for some queries the true partners in the shard (not the query
itself) are counted by brute force, and the search must have found ``AUDIT_RECALL`` of
them, on average over the queries and on average over the groups, so that one large
group of near vectors can't hide the loss of small ones.  A query whose
whole beam is near enough could have more partners, so its own beam doubles too, until
it reaches farther than the threshold (a beam of the shard's size is exhaustive).
What is found is verified by cosine in double precision, a link found from either end
counts for both, and links are joined to components.

All vectors are indexed and all are queries; memory is one shard, bounded by classes and
by bytes, and one block, whose links leave a few at a time.

Edge cases: null and zero vectors and those with null or non-finite components link
with nothing; vectors of different lengths are never compared; repeated rows are copies
of each other; a null vec_id takes part in no link; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetlens.llm.common import materialise, shared_folder
from fleetlens.llm.components import components

THRESHOLD = 0.9
#: At least so many shards (they work side by side), and at most so many classes in one.
SHARDS, SHARD_CLASSES = 8, 32_768
#: Bytes of a shard's vectors in single precision: long vectors make more shards.
SHARD_BYTES = 32 << 20
QUERY_BLOCK = 16_384
#: Queries of a block, and links found, that are held at once; tasks of a search at most.
SEARCH_AT_ONCE, LINKS_AT_ONCE, SEARCH_TASKS = 1024, 1 << 18, 20_000
LINKS, BASE_LINKS = 16, 32
BUILD_BEAM, BEAM = 48, 32
#: One query in so many is audited; the share of true partners that must be found.
AUDIT_EVERY, AUDIT_RECALL = 16, 0.99
#: Share of a full list that is kept for links out of the near group.
LONG = 0.25
AT_ONCE = 256
#: Bytes of gathered vectors at once.
DOT_BYTES = 1 << 20
#: Single precision may fall this far short of the double-precision cosine.
SLACK = 1e-4


def _dots(x: np.ndarray, i: np.ndarray, y: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Products of the rows ``i`` of x with the rows ``j`` of y, gathered a few at a time."""
    out, step = np.empty(len(i), np.result_type(x, y)), max(1, DOT_BYTES // max(1, x.itemsize * x.shape[1]))
    for k in range(0, len(i), step):
        np.einsum("md,md->m", x.take(i[k : k + step], 0), y.take(j[k : k + step], 0), out=out[k : k + step])
    return out


class Layer:
    """One layer of a graph: its nodes (rows of the shard) and their neighbours (-1: none)."""

    def __init__(self, nodes: np.ndarray, links: int, total: int):
        self.nodes, self.links = nodes, links
        self.near = np.full((len(nodes), links), -1, np.int32)
        self.place = np.full(total, -1, np.int32)
        self.place[nodes] = np.arange(len(nodes))
        self.held: np.ndarray | None = None

    def own(self, vectors: np.ndarray) -> np.ndarray:
        """The vectors of the nodes, gathered once."""
        if self.held is None:
            self.held = vectors[self.nodes]
        return self.held

    def search(self, vectors: np.ndarray, queries: np.ndarray, entries: np.ndarray, beam: int, step: int = 4) -> tuple[np.ndarray, np.ndarray]:
        """Places and similarities of the ``beam`` best found per query, best first (-1: none)."""
        n, total, own = len(queries), len(self.nodes), self.own(vectors)
        seen = np.zeros(n * total, bool)
        ids = np.full((n, beam), -1, np.int64)
        sims = np.full((n, beam), -np.inf, np.float32)
        done = np.ones((n, beam), bool)
        q, fresh = np.repeat(np.arange(n), entries.shape[1]), entries.ravel()
        while True:
            keys = np.sort((q * total + fresh)[fresh >= 0])  # each query's places side by side
            keys = keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]
            keys = keys[~seen[keys]]
            seen[keys] = True
            q, at = np.divmod(keys, total)
            got = _dots(queries, q, own, at)
            better = got > sims.min(1)[q]
            q, at, got = q[better], at[better], got[better]
            if len(q):
                first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
                rows, counts = q[first], np.diff(np.append(first, len(q)))
                row, slot = np.repeat(np.arange(len(rows)), counts), beam + np.arange(len(q)) - np.repeat(first, counts)
                wide = (len(rows), beam + int(counts.max()))
                new_ids, new_sims, new_done = np.full(wide, -1, np.int64), np.full(wide, -np.inf, np.float32), np.ones(wide, bool)
                new_ids[:, :beam], new_sims[:, :beam], new_done[:, :beam] = ids[rows], sims[rows], done[rows]
                new_ids[row, slot], new_sims[row, slot], new_done[row, slot] = at, got, False
                keep = np.argpartition(-new_sims, beam - 1, 1)[:, :beam]
                ids[rows], sims[rows], done[rows] = (np.take_along_axis(x, keep, 1) for x in (new_ids, new_sims, new_done))
            live = np.flatnonzero(~done.all(1))  # queries that have come to an end cost nothing more
            if not len(live):
                break
            open_sims = np.where(done[live], -np.inf, sims[live])
            take = np.argpartition(-open_sims, min(step, beam) - 1, 1)[:, : min(step, beam)]
            row, col = np.nonzero(np.isfinite(np.take_along_axis(open_sims, take, 1)))
            q, col = live[row], take[row, col]
            done[q, col] = True
            q, fresh = np.repeat(q, self.links), self.near[ids[q, col]].ravel()
        order = np.argsort(-sims, 1)
        ids = np.take_along_axis(ids, order, 1)
        sims = np.take_along_axis(sims, order, 1)
        ids[~np.isfinite(sims)] = -1
        return ids, sims

    def connect(self, vectors: np.ndarray, places: np.ndarray, found: np.ndarray) -> None:
        """Link new ``places`` to a spread choice of what was found for them, and back."""
        own = self.own(vectors)
        sims = np.full(found.shape, -np.inf, np.float32)
        row, col = np.nonzero((found >= 0) & (found != places[:, None]))
        sims[row, col] = _dots(own, places[row], own, found[row, col])
        order = np.argsort(-sims, 1)[:, : min(found.shape[1], BUILD_BEAM)]
        found, sims = np.take_along_axis(found, order, 1), np.take_along_axis(sims, order, 1)
        each = own.take(found, 0)
        among = each @ each.transpose(0, 2, 1)
        kept = np.zeros(found.shape, bool)
        for c in range(found.shape[1]):  # a candidate nearer to a kept one than to the node adds no new direction
            covered = (np.where(kept, among[:, c], -np.inf) > sims[:, c : c + 1]).any(1)
            same = (kept & (found == found[:, c : c + 1])).any(1)
            kept[:, c] = np.isfinite(sims[:, c]) & ~covered & ~same & (kept.sum(1) < self.links)
        for c in range(found.shape[1]):  # fill what is left with the nearest
            same = (kept & (found == found[:, c : c + 1])).any(1)
            kept[:, c] |= np.isfinite(sims[:, c]) & ~same & (kept.sum(1) < self.links // 2)
        q, c = np.nonzero(kept)
        a, b = places[q], found[q, c]
        self._add(own, a, b)
        self._add(own, b, a)

    def _add(self, own: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
        """Add b to the lists of a.  A full list keeps the nearest, and in ``LONG`` of its places links that leave the near group, no two in one direction."""
        nodes, inverse = np.unique(a, return_inverse=True)
        order = np.argsort(inverse, kind="stable")
        counts = np.bincount(inverse)
        slot = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
        new = np.full((len(nodes), int(counts.max(initial=0))), -1, np.int64)
        new[inverse[order], slot] = b[order]
        lists = np.concatenate([self.near[nodes].astype(np.int64), new], 1)
        lists = np.sort(lists, 1)
        lists[:, 1:][lists[:, 1:] == lists[:, :-1]] = -1
        for i in range(0, len(nodes), 1024):
            some = lists[i : i + 1024]
            sims = np.full(some.shape, -np.inf, np.float32)
            row, col = np.nonzero(some >= 0)
            sims[row, col] = _dots(own, nodes[i + row], own, some[row, col])
            order = np.argsort(-sims, 1)
            some, sims = np.take_along_axis(some, order, 1), np.take_along_axis(sims, order, 1)
            full = np.flatnonzero(some[:, self.links :].max(1, initial=-1) >= 0)
            if len(full):
                long = self._leaving(own, some[full], sims[full])
                some[full] = np.take_along_axis(some[full], np.argsort(~long, 1, kind="stable"), 1)
            self.near[nodes[i : i + 1024]] = some[:, : self.links]

    def _leaving(self, own: np.ndarray, lists: np.ndarray, sims: np.ndarray) -> np.ndarray:
        """Which links (nearest first) are kept as long ones: below the threshold, and nearer to the node than to a long one kept before."""
        most = int(self.links * LONG)
        kept = np.full((len(lists), most), -1, np.int64)
        count, out = np.zeros(len(lists), int), np.zeros(lists.shape, bool)
        for c in range(lists.shape[1]):
            rows = np.flatnonzero((lists[:, c] >= 0) & (sims[:, c] < THRESHOLD) & (count < most))
            among = np.full((len(rows), most), -np.inf, np.float32)
            row, col = np.nonzero(kept[rows] >= 0)
            among[row, col] = _dots(own, kept[rows[row], col], own, lists[rows[row], c])
            rows = rows[among.max(1, initial=-np.inf) <= sims[rows, c]]
            kept[rows, count[rows]] = lists[rows, c]
            count[rows] += 1
            out[rows, c] = True
        return out


class Graph:
    """Layers from the sparsest to the base over unit vectors in single precision."""

    def __init__(self, vectors: np.ndarray, layers: list[Layer]):
        self.vectors, self.layers = vectors, layers

    @classmethod
    def build(cls, vectors: np.ndarray, seed: int = 3) -> Graph:
        n = len(vectors)
        levels = np.floor(-np.log(np.random.default_rng(seed).random(n)) / np.log(LINKS)).astype(int)
        graph = cls(vectors, [])
        for level in range(levels.max(initial=0), -1, -1):
            nodes = np.flatnonzero(levels >= level).astype(np.int32)
            nodes = nodes[np.argsort(-levels[nodes], kind="stable")]  # those of the layers above come first
            layer = Layer(nodes, LINKS if level else BASE_LINKS, n)
            above, start = (len(graph.layers[-1].nodes) if graph.layers else 0), min(len(nodes), AT_ONCE)
            layer.connect(vectors, np.arange(start), np.tile(np.arange(start), (start, 1)))
            at = start
            while at < len(nodes):
                new = np.arange(at, min(len(nodes), at + AT_ONCE))
                queries = vectors[nodes[new]]
                entries = layer.place[graph.entries(queries)] if at >= above > 0 else np.tile(np.linspace(0, at - 1, 8).astype(np.int64), (len(new), 1))
                found, _ = layer.search(vectors, queries, entries.astype(np.int64), BUILD_BEAM)
                mates = queries @ queries.T
                np.fill_diagonal(mates, -np.inf)
                nearest = new[np.argsort(-mates, 1)[:, : min(8, len(new) - 1)]]
                layer.connect(vectors, new, np.concatenate([found, nearest], 1))
                at += len(new)
            graph.layers.append(layer)
        return graph

    def entries(self, queries: np.ndarray, beam: int = 4) -> np.ndarray:
        """Rows nearest to each query, found from the top layer down through all layers there are."""
        rows = None
        for layer in self.layers:
            start = np.tile(np.arange(min(8, len(layer.nodes))), (len(queries), 1)) if rows is None else layer.place[rows]
            found, _ = layer.search(self.vectors, queries, start.astype(np.int64), max(beam, 1))
            found = np.where(found < 0, found[:, :1], found)
            rows = layer.nodes[found]
        return rows

    def query(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows (-1: none) and similarities of the best ``beam`` of the base layer."""
        base = self.layers[-1]
        upper = Graph(self.vectors, self.layers[:-1])
        entries = base.place[upper.entries(queries)] if upper.layers else np.tile(np.arange(min(8, len(base.nodes))), (len(queries), 1))
        found, sims = base.search(self.vectors, queries, entries.astype(np.int64), beam)
        return np.where(found < 0, -1, base.nodes[found]), sims

    def near(self, queries: np.ndarray, least: float, beam: int) -> list[np.ndarray]:
        """Per query the rows found with a similarity of ``least`` or more; a beam that is near all through is doubled."""
        n = len(self.vectors)
        out: list[np.ndarray] = [np.empty(0, np.int64)] * len(queries)
        todo = np.arange(len(queries))
        while len(todo):
            wide = min(beam, n)
            again = []
            at_once = max(1, AT_ONCE * BEAM // max(wide, BEAM))
            for i in range(0, len(todo), at_once):
                some = todo[i : i + at_once]
                if wide >= n:
                    sims = queries[some] @ self.vectors.T
                    rows = np.tile(np.arange(n), (len(some), 1))
                else:
                    rows, sims = self.query(queries[some], wide)
                good = (sims >= least) & (rows >= 0)
                for q, r, g in zip(some.tolist(), rows, good):
                    out[q] = r[g]
                if wide < n:
                    again += some[good.all(1)].tolist()
            todo, beam = np.array(again, np.int64), beam * 2
        return out

    def to_bytes(self) -> bytes:
        held = io.BytesIO()
        np.savez(held, vectors=self.vectors, **self.links())
        return held.getvalue()

    def links(self) -> dict[str, np.ndarray]:
        """The layers' arrays by name."""
        return {f"{kind}{i}": x for i, layer in enumerate(self.layers) for kind, x in (("nodes", layer.nodes), ("near", layer.near))}

    @classmethod
    def from_bytes(cls, raw: bytes) -> Graph:
        held = np.load(io.BytesIO(raw))
        return cls.of(held["vectors"], held)

    @classmethod
    def of(cls, vectors: np.ndarray, held: dict[str, np.ndarray]) -> Graph:
        layers: list[Layer] = []
        while f"nodes{len(layers)}" in held:
            i = len(layers)
            near = held[f"near{i}"]
            layers.append(Layer(held[f"nodes{i}"], near.shape[1], len(vectors)))
            layers[-1].near = near
        return cls(vectors, layers)


def audited_beam(graph: Graph, queries: np.ndarray, least: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[float, int]:
    """The audited recall and the beam it took.

    ``own`` is each query's row in the graph (-1: none; not given: the rows equal to it), which
    is no partner.  The recall is the smaller of two means over the audited queries that have
    partners: each query alike, and each weighed by 1 / size of its group, so each group alike.
    """
    sample = np.arange(0, len(queries), AUDIT_EVERY)
    truth = []
    for i in range(0, len(sample), AT_ONCE):
        for q, sims in zip(sample[i : i + AT_ONCE], queries[sample[i : i + AT_ONCE]] @ graph.vectors.T):
            rows = np.flatnonzero(sims >= least).astype(np.int32)
            truth.append(rows[rows != own[q]] if own is not None else rows[(graph.vectors[rows] != queries[q]).any(1)])
    asked = [k for k, t in enumerate(truth) if len(t)]
    weight = 1 / (1 + np.array([len(truth[k]) for k in asked]))
    while True:
        trial = graph.near(queries[sample[asked]], least, beam)
        found = np.array([len(np.intersect1d(truth[k], f)) / len(truth[k]) for k, f in zip(asked, trial)])
        recall = float(min(found.mean(), np.average(found, weights=weight))) if asked else 1.0
        if recall >= AUDIT_RECALL or beam >= len(graph.vectors):
            return recall, beam
        beam *= 2


def audited(graph: Graph, queries: np.ndarray, least: float, beam: int = BEAM, own: np.ndarray | None = None) -> tuple[list[np.ndarray], float, int]:
    """Rows near each query, the audited recall and the beam it took."""
    recall, beam = audited_beam(graph, queries, least, beam, own)
    return graph.near(queries, least, beam), recall, beam


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = pa.concat_arrays(column.combine_chunks().chunks if isinstance(column.combine_chunks(), pa.ChunkedArray) else [column.combine_chunks()]).flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that very large and very small components neither overflow nor vanish."""
    out, step = np.empty(x.shape), max(1, DOT_BYTES // max(1, 8 * x.shape[1]))
    for i in range(0, len(x), step):
        some = x[i : i + step].astype(np.float64)
        some /= np.abs(some).max(1, keepdims=True)
        out[i : i + step] = some / np.linalg.norm(some, axis=1, keepdims=True)
    return out


def _place(folder: str, dim: int, shard: int) -> tuple[pafs.FileSystem, str]:
    fs, root = pafs.FileSystem.from_uri(folder)
    return fs, f"{root}/{dim}-{shard}.arrow"


def _store(folder: str, dim: int, shard: int, arrays: dict[str, np.ndarray]) -> None:
    """One file of one row, a column of bytes for each array; written under the attempt's name and moved."""
    (fs, path), task = _place(folder, dim, shard), TaskContext.get()
    draft = f"{path}.{task.taskAttemptId() if task else 0}.tmp"
    schema = pa.schema([pa.field(k, pa.large_binary(), metadata={"dtype": x.dtype.str, "width": str(x.shape[1] if x.ndim > 1 else 0)}) for k, x in arrays.items()])
    columns = [pa.Array.from_buffers(pa.large_binary(), 1, [None, pa.py_buffer(np.array([0, x.nbytes])), pa.py_buffer(np.ascontiguousarray(x))]) for x in arrays.values()]
    with fs.open_output_stream(draft) as out, pa.ipc.new_file(out, schema) as file:
        file.write_batch(pa.RecordBatch.from_arrays(columns, schema=schema))
    fs.move(draft, path)


def _stored(folder: str, dim: int, shard: int) -> dict[str, np.ndarray]:
    """The arrays of a shard's file, views of it; local files are memory-mapped."""
    fs, path = _place(folder, dim, shard)
    batch = pa.ipc.open_file(pa.memory_map(path) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(path)).get_batch(0)
    arrays = {}
    for field, column in zip(batch.schema, batch.columns):
        flat, width = np.frombuffer(column.buffers()[2], field.metadata[b"dtype"].decode()), int(field.metadata[b"width"])
        arrays[field.name] = flat.reshape(-1, width) if width else flat
    return arrays


def _build(folder: str) -> Callable[[tuple, pa.Table], pa.Table]:
    def build(key: tuple, rows: pa.Table) -> pa.Table:
        rows, (dim, shard) = rows.sort_by("class_id"), (k.as_py() for k in key)
        exact = _matrix(rows.column("embedding"))
        graph = Graph.build(_unit(exact).astype(np.float32))
        _store(folder, dim, shard, {"ids": rows.column("class_id").to_numpy(), "exact": exact} | graph.links())
        return pa.table([pa.array([dim], pa.int32()), pa.array([shard], pa.int32()), pa.array([rows.num_rows], pa.int64())], names=["dim", "shard", "n_rows"])

    return build


PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _linked(folder: str, dim: int, shard: int, first: int, block: int, other: int) -> Iterator[pa.RecordBatch]:
    """Links from a block of one shard's classes to those of another shard, or its own."""
    mine, its = _stored(folder, dim, shard), _stored(folder, dim, other)
    ids, asked, exact = mine["ids"][first : first + block], _unit(mine["exact"][first : first + block]), _unit(its["exact"])
    graph, queries = Graph.of(exact.astype(np.float32), its), asked.astype(np.float32)
    _, beam = audited_beam(graph, queries, THRESHOLD - SLACK, own=np.arange(first, first + len(ids)) if shard == other else np.full(len(ids), -1))
    for i in range(0, len(ids), SEARCH_AT_ONCE):
        found = graph.near(queries[i : i + SEARCH_AT_ONCE], THRESHOLD - SLACK, beam)
        sizes = np.array([len(f) for f in found])
        for part in np.split(np.arange(len(found)), np.flatnonzero(np.diff(np.cumsum(sizes) // LINKS_AT_ONCE)) + 1):
            q, r = np.repeat(i + part, sizes[part]), np.concatenate([found[k] for k in part])
            ok = _dots(asked, q, exact, r) >= THRESHOLD
            a, b = ids[q[ok]], its["ids"][r[ok]]
            a, b = a[a != b], b[a != b]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], schema=PAIRS)


def _search(folder: str, block: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.to_pylist():
                yield from _linked(folder, x["dim"], x["shard"], x["first"], block, x["other"])

    return search


def near_vectors(vectors: DataFrame, shards: int = SHARDS, shard_classes: int = SHARD_CLASSES, block: int = QUERY_BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    spark = vectors.sparkSession
    kind = "float" if vectors.schema["embedding"].dataType.simpleString() == "array<float>" else "double"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(f"array<{kind}>").alias("embedding"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = F.coalesce(F.forall("embedding", finite) & F.exists("embedding", lambda x: x != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    digest = F.sha2(F.to_json("embedding"), 256)  # 0.0 and -0.0 differ: such copies still meet in the search
    marked = materialise(rows.withColumn("digest", F.when(sound, digest)).withColumn("dim", F.when(sound, F.size("embedding"))), "vectors")
    classes = materialise(marked.where("digest is not null").groupBy("digest").agg(F.min("vec_id").alias("class_id"), F.count("*").alias("copies"), F.first("embedding").alias("embedding"), F.first("dim").alias("dim")), "vector-classes")
    n, floats = classes.agg(F.count("*"), F.coalesce(F.sum("dim"), F.lit(0))).first()
    shards = max(shards, -(-n // shard_classes), -(-floats * 4 // SHARD_BYTES))
    dealt = classes.select("dim", F.pmod(F.xxhash64("class_id"), F.lit(shards)).cast("int").alias("shard"), "class_id", "embedding")
    folder = shared_folder(spark, "hnsw-graphs")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jpath)
    # a shard is a long task: by their size alone AQE would put several into one
    index = materialise(dealt.repartition(8 * shards, "dim", "shard").groupBy("dim", "shard").applyInArrow(_build(folder), "dim int, shard int, n_rows long"), "hnsw")
    asked = index.select("dim", "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_rows") - 1, F.lit(block).cast("long"))).alias("first"))
    tasks = asked.join(index.select("dim", F.col("shard").alias("other")), "dim")
    met = tasks.repartition(min(max(tasks.count(), 1), SEARCH_TASKS)).mapInArrow(_search(folder, block), "a long, b long")
    pairs = materialise(met.distinct(), "vector-pairs")
    both = pairs.union(pairs.select("b", "a"))
    links = both.join(classes.select(F.col("class_id").alias("b"), "copies"), "b").groupBy(F.col("a").alias("class_id")).agg(F.sum("copies").alias("others"))
    grouped = components(pairs).select(F.col("id").alias("class_id"), "component")
    of_class = classes.select("digest", "class_id", "copies").join(links, "class_id", "left").join(grouped, "class_id", "left")
    joined = marked.select("vec_id", "digest").join(of_class.select("digest", (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "class_id").alias("component")), "digest", "left")
    out = joined.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
