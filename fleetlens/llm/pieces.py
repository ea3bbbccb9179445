"""SentencePiece encoding and decoding by a prefix table (operator 8).

For a merge-type (BPE) model the encoding of a text's prefix ends in exactly one
token, and a sequence of tokens is an encoding when each neighbouring pair is
one: encoding the pair's text gives the pair back.  So for every prefix the table
stores its last token: of the tokens that an Aho-Corasick automaton finds ending
there, the one that is compatible with the last token of the prefix before it.
Reading the table backwards gives the ids.

The models handled here have no piece that goes on after a blank, so an encoding
splits before each blank that follows another character; a worker keeps the ids
of the words it has met (bounded).  Runs of blanks all have one score, for which
pair compatibility isn't unique; such words are merged directly.

Edge cases: null or empty text is begin and end id alone; characters without a
piece become byte pieces; repeated rows are encoded once each; a null doc_id is
kept; an empty table gives no rows.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fleetlens.llm.common import slices, text_rows
from fleetlens.llm.tokens import WordCache

BLANK = "▁"
#: Words up to this length are merged without a heap.
SHORT = 24
BYTE_BY_BYTE = "one replacement a byte"
codecs.register_error(BYTE_BY_BYTE, lambda bad: ("\ufffd", bad.start + 1))
OUT = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])


class PrefixEncoder:
    """Encoder and decoder of one merge-type model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(n)]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        plain = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        if any(BLANK in names[i].lstrip(BLANK) for i in plain):
            raise ValueError("the model has pieces that go on after a blank; words can't be encoded by themselves")
        self.ids = {names[i]: i for i in plain}
        self.rank = {names[i]: -model.get_score(i) for i in plain}
        self.bytes = {int(names[i][3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.surface = [b"" if model.is_control(i) else names[i].replace(BLANK, " ").encode() for i in range(n)]
        self.byte_of = {i: b for b, i in self.bytes.items()}
        for i, b in self.byte_of.items():
            self.surface[i] = bytes([b])
        self.surface[self.unknown] = " ⁇ ".encode()
        self.automaton = ahocorasick.Automaton()
        for name in self.ids:
            self.automaton.add_word(name, name)
        self.automaton.make_automaton()
        self.pairs: dict[tuple[str, str], bool] = {}
        self.cache = WordCache(lambda words: [np.array(self.word(w), "<u4").tobytes() for w in words], limit=800_000)

    def merged(self, text: str) -> list[str]:
        """Merge neighbours whose joint piece has the best score, leftmost first, until none is left.

        Candidate merges wait in a heap; one is passed over if either side has changed since.
        """
        parts, rank = list(text), self.rank
        if len(parts) <= SHORT:
            return self._merged_short(parts)
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, a, b) for i, (a, b) in enumerate(zip(parts, parts[1:])) if (r := rank.get(a + b)) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j == len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, ""
            k = after[i] = after[j]
            if k < len(parts):
                before[k] = i
                if (r := rank.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            h = before[i]
            if h >= 0 and (r := rank.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [p for p in parts if p]

    def _merged_short(self, parts: list[str]) -> list[str]:
        """The same by looking at every neighbour again after each merge."""
        rank = self.rank
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                r = rank.get(parts[i] + parts[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def compatible(self, left: str, right: str) -> bool:
        """Is [left, right] the encoding of its text?  An empty ``left`` asks about ``right`` alone."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(left + right) == ([left, right] if left else [right])
        return known

    def tokens(self, word: str) -> list[str]:
        """Pieces (or single characters without a piece) of a word, by the prefix table."""
        n = len(word)
        last: list[str] = [""] * (n + 1)
        ending: list[list[str]] = [[] for _ in range(n)]
        for at, piece in self.automaton.iter(word):
            ending[at].append(piece)
        for at in range(n):
            found = ending[at]
            if not found:
                last[at + 1] = word[at]  # no piece: it stands alone and nothing merges across it
                continue
            if len(found) == 1:
                last[at + 1] = found[0]
                continue
            for piece in found:
                before = last[at + 1 - len(piece)]
                if before and before not in self.ids:
                    before = ""
                if self.compatible(before, piece):
                    last[at + 1] = piece
                    break
        out, at = [], n
        while at:
            out.append(last[at])
            at -= len(last[at])
        return out[::-1]

    def word(self, word: str) -> list[int]:
        found = self.merged(word) if BLANK * 2 in word else self.tokens(word)
        out: list[int] = []
        for t in found:
            i = self.ids.get(t)
            if i is not None:
                out.append(i)
            elif self.bytes:
                out += [self.bytes[b] for b in t.encode()]
            else:
                out.append(self.unknown)
        return out

    @staticmethod
    def words(text: str) -> list[str]:
        """Split before each blank that follows another character; the model puts one blank in front of a text."""
        if not text:
            return []
        parts = text.replace(" ", BLANK).split(BLANK)
        # parts[i] is what follows blank i (the model's own blank is the first); empty parts join the run before the next one
        if "" not in parts:
            return [BLANK + p for p in parts]
        out, run = [], ""
        for p in parts:
            run += BLANK
            if p:
                out.append(run + p)
                run = ""
        return [*out, run] if run else out

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids with begin and end ids."""
        b, e = np.array([self.begin], "<u4").tobytes(), np.array([self.end], "<u4").tobytes()
        return [np.frombuffer(b + x + e, "<u4") for x in self.cache.bulk([self.words(t) for t in texts])]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the text: pieces joined, the model's own blank dropped, bytes that aren't UTF-8 replaced one by one."""
        ids = ids.tolist()
        at = next((k for k, i in enumerate(ids) if self.surface[i]), None)
        raw = b"".join(map(self.surface.__getitem__, ids))
        if at is not None and ids[at] not in self.byte_of and raw[:1] == b" ":
            raw = raw[1:]
        return raw.decode(errors=BYTE_BY_BYTE).encode()


_ENCODERS: dict[str, PrefixEncoder] = {}


def prefix_encoder(path: str) -> PrefixEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = PrefixEncoder(path)
    return _ENCODERS[path]


def piece_ids(docs: DataFrame, model: str) -> DataFrame:
    """doc_id and the ids (array) of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = prefix_encoder(model)
        for b in slices(batches):
            ids = enc.encode(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))], names=["doc_id", "ids"])

    return text_rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def encode_decode(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, number of ids, digest of the ids and of the text decoded from them; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = prefix_encoder(model)
        for b in slices(batches):
            ids = enc.encode(b.column(1).to_pylist())
            cols = [b.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in ids]), pa.array([hashlib.sha256(enc.decode(x)).hexdigest() for x in ids])]
            yield pa.RecordBatch.from_arrays(cols, schema=OUT)

    return text_rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
