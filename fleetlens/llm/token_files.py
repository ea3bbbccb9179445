"""Token ids as Arrow files of fixed-size-list batches (operator 3).

Documents are range-partitioned by doc_id.  Each task encodes its texts and
writes one Arrow IPC file whose record batches hold ``fixed_size_list`` columns:
``ids`` (equal-length sequences cut from the concatenated documents) and ``mask``
(false where the last sequence of a file is padded).  Equal-length sequences sit
at fixed places, so a memory-mapped file gives any of them without a copy.  A
second small Arrow file lists each document's place.  Files are written under an
attempt's own name and moved into place, so a task that runs twice leaves the
same file.

Edge cases: null or empty text is the end id alone; repeated rows are written
once each, in order of text; null doc_ids come first; an empty table gives no
rows (and empty files).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fleetlens.llm import tokens
from fleetlens.llm.common import materialise, shared_folder, shuffle_width, text_rows

SEQUENCE_LENGTH = 2048
#: Sequences per record batch (2 MB of 16-bit ids).
BATCH_SEQUENCES = 512

INDEX = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64())])


def _schema(dtype: np.dtype, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(pa.from_numpy_dtype(dtype), length)), ("mask", pa.list_(pa.bool_(), length))])


class SequenceFile:
    """Random access to one file's sequences, masks and token stream; local files are memory-mapped."""

    def __init__(self, uri: str):
        fs, path = pafs.FileSystem.from_uri(uri)
        local = isinstance(fs, pafs.LocalFileSystem)
        self.reader = pa.ipc.open_file(pa.memory_map(path) if local else fs.open_input_file(path))
        self.length = self.reader.schema.field("ids").type.list_size
        self.batches = [self.reader.get_batch(i) for i in range(self.reader.num_record_batches)] if local else None
        self.first = np.cumsum([0, *(self._batch(i).num_rows for i in range(self.reader.num_record_batches))])

    def _batch(self, i: int) -> pa.RecordBatch:
        return self.batches[i] if self.batches is not None else self.reader.get_batch(i)

    def __len__(self) -> int:
        return int(self.first[-1])

    def _place(self, i: int) -> tuple[pa.RecordBatch, int]:
        k = int(np.searchsorted(self.first, i, "right")) - 1
        return self._batch(k), i - int(self.first[k])

    def sequence(self, i: int) -> np.ndarray:
        """Sequence ``i`` as a view of the file."""
        batch, row = self._place(i)
        return batch.column(0).flatten().to_numpy(zero_copy_only=True)[row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> pa.BooleanArray:
        """Mask of sequence ``i`` as a slice of the file's bits."""
        batch, row = self._place(i)
        return batch.column(1).flatten().slice(row * self.length, self.length)

    def stream(self, start: int, n: int) -> np.ndarray:
        """``n`` ids of the token stream from ``start`` on; a view if they lie in one batch."""
        parts = []
        while n:
            k = int(np.searchsorted(self.first, start // self.length, "right")) - 1
            values = self._batch(k).column(0).flatten().to_numpy(zero_copy_only=True)
            at = start - int(self.first[k]) * self.length
            parts.append(values[at : at + n])
            start, n = start + len(parts[-1]), n - len(parts[-1])
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _write(batches: Iterator[pa.RecordBatch], folder: str, vocabulary: str, length: int) -> Iterator[pa.RecordBatch]:
    task = TaskContext.get()
    part, fs_path = task.partitionId(), pafs.FileSystem.from_uri(folder)
    fs, root = fs_path
    dtype = tokens.encoder(vocabulary, tokens.blank_words).dtype
    names = [f"{root}/part-{part:06d}.arrow", f"{root}/part-{part:06d}.index.arrow"]
    drafts = [f"{n}.{task.taskAttemptId()}.tmp" for n in names]
    total = 0
    with fs.open_output_stream(drafts[0]) as data, fs.open_output_stream(drafts[1]) as places:
        with pa.ipc.new_file(data, schema := _schema(dtype, length)) as out, pa.ipc.new_file(places, INDEX) as index:
            held: list[np.ndarray] = []
            n_held = 0

            def flush(last: bool) -> None:
                nonlocal held, n_held
                flat = np.concatenate(held) if held else np.empty(0, dtype)
                whole = len(flat) // length * length
                held, n_held = [flat[whole:]], len(flat) - whole
                body, mask = flat[:whole], np.ones(whole, bool)
                if last and n_held:
                    pad = length - n_held
                    body = np.concatenate([flat, np.zeros(pad, dtype)])
                    mask = np.concatenate([np.ones(len(flat), bool), np.zeros(pad, bool)])
                for i in range(0, len(body), BATCH_SEQUENCES * length):
                    some = slice(i, i + BATCH_SEQUENCES * length)
                    out.write_batch(pa.RecordBatch.from_arrays([pa.FixedSizeListArray.from_arrays(pa.array(body[some]), length), pa.FixedSizeListArray.from_arrays(pa.array(mask[some]), length)], schema=schema))

            for ids, arrays in tokens.encode_slices(batches, vocabulary, tokens.blank_words):
                sizes = np.array([len(a) for a in arrays], np.int64)
                starts = total + np.cumsum(sizes) - sizes
                index.write_batch(pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts), pa.array(sizes)], schema=INDEX))
                total += int(sizes.sum())
                held += arrays
                n_held += int(sizes.sum())
                if n_held >= BATCH_SEQUENCES * length:
                    flush(False)
            flush(True)
    for draft, name in zip(drafts, names):
        fs.move(draft, name)
    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n_tokens": pa.array([total], pa.int64())})


def write_token_files(docs: DataFrame, vocabulary: str, length: int = SEQUENCE_LENGTH) -> tuple[str, DataFrame]:
    """Write all documents; returns the folder's URI and one row per file (part, n_tokens, first: tokens in earlier files)."""
    spark = docs.sparkSession
    folder = shared_folder(spark, "token-files")
    jpath = spark._jvm.org.apache.hadoop.fs.Path(folder)
    jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(jpath)
    ordered = text_rows(docs).repartitionByRange(shuffle_width(spark), "doc_id").sortWithinPartitions("doc_id", "text")
    parts = materialise(ordered.mapInArrow(lambda b: _write(b, folder, vocabulary, length), "part int, n_tokens long"), "token-parts")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return folder, parts.withColumn("first", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(folder: str, parts: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, first in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = SequenceFile(f"{folder}/part-{part:06d}.arrow")
                fs, path = pafs.FileSystem.from_uri(f"{folder}/part-{part:06d}.index.arrow")
                with fs.open_input_file(path) as source:
                    reader = pa.ipc.open_file(source)
                    for i in range(reader.num_record_batches):
                        rows = reader.get_batch(i)
                        starts, sizes = rows.column(1).to_numpy(), rows.column(2).to_numpy()
                        crcs = [tokens.crc32_u32(ids.stream(a, n)) for a, n in zip(starts.tolist(), sizes.tolist())]
                        yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(starts + first), rows.column(2), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    spread = parts.select("part", "first").repartition(shuffle_width(parts.sparkSession), "part")
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
