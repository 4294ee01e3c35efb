"""SentencePiece encoding by suffix-array matching, and decoding.

The new segments of a batch (a run of word marks with what follows, or a line end
with what follows) are concatenated; the suffixes of that text are sorted, every
piece of the vocabulary is binary-searched for its range of occurrences, and the
occurrences become edges sorted by position.  Relaxing then joins, in each
segment, the two neighbours whose edge scores best, until no edge joins
neighbours: for a BPE vocabulary this is the tokenizer's own result, which a
best path over the edges would not be.  Short segments are relaxed side by side, a join
each at a time; one of more than ``LONG_SEGMENT`` bytes takes its joins from a heap, in the same order, so that
a text without spaces costs n log n.  Characters without a piece fall back to
bytes.  A worker keeps the ids of segments it has met, up to a bound.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded

MARK = "▁"
CACHED_SEGMENTS = 1_000_000
LONGEST_CACHED = 64
LONG_SEGMENT = 512
MATCH_BYTES = 1 << 20
_SEGMENT = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n[^{MARK}\n]*")


class PieceLattice:
    _known: dict[str | None, "PieceLattice"] = {}

    @classmethod
    def of(cls, path: str | None) -> "PieceLattice":
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        kind, normaliser = model_settings(model.serialized_model_proto())
        if kind != "bpe" or normaliser != "identity":
            raise ValueError(f"only BPE models without normalisation are supported, not {kind} with {normaliser!r}")
        size = model.get_piece_size()
        self.bytes_of = [b""] * size
        self.byte_ids = np.zeros(256, np.int32)
        pieces = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes_of[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                pieces.append((piece.encode(), i, model.get_score(i)))
                self.bytes_of[i] = piece.replace(MARK, " ").encode()
        if any(re.search(f"[^{MARK}]{MARK}|\n", p.decode()) for p, _, _ in pieces):
            raise ValueError("pieces that cross words or hold line ends are not supported")
        self.pieces = [p for p, _, _ in pieces]
        self.ids = np.array([i for _, i, _ in pieces], np.int32)
        self.scores = np.array([s for _, _, s in pieces])
        self.sizes = np.array([len(p) for p in self.pieces])
        self.low = [_word(self.pieces, at, b"\0") for at in (0, 8)]
        self.high = [_word(self.pieces, at, b"\xff") for at in (0, 8)]
        self.cache: dict[str, bytes] = {}
        self.most_segments = CACHED_SEGMENTS

    # Matching

    def edges(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(position * 256 + length, piece number) of every occurrence of a piece, sorted."""
        padded = np.frombuffer(text + bytes(16), np.uint8)
        starts = np.flatnonzero((padded[: len(text)] & 0xC0) != 0x80)  # of characters
        words = np.lib.stride_tricks.sliding_window_view(padded, 8)
        first = np.ascontiguousarray(words[starts]).view(">u8").ravel().astype(np.uint64)
        second = np.ascontiguousarray(words[starts + 8]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((second, first))
        first, second = first[order], second[order]
        begin = np.searchsorted(first, self.low[0], "left")
        end = np.searchsorted(first, self.high[0], "right")
        for k in np.flatnonzero((self.sizes > 8) & (end > begin)):
            a, b = begin[k], end[k]
            begin[k] = a + np.searchsorted(second[a:b], self.low[1][k], "left")
            end[k] = a + np.searchsorted(second[a:b], self.high[1][k], "right")
        count = np.maximum(end - begin, 0)
        piece = np.repeat(np.arange(len(count)), count)
        within = np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count)
        position = starts[order[begin[piece] + within]]
        long = np.flatnonzero(self.sizes[piece] > 16)
        bad = [k for k in long if text[position[k] : position[k] + self.sizes[piece[k]]] != self.pieces[piece[k]]]
        keys = position * 256 + self.sizes[piece]
        if bad:
            keys, piece = np.delete(keys, bad), np.delete(piece, bad)
        by_place = np.argsort(keys, kind="stable")
        return keys[by_place], piece[by_place]

    # Relaxing

    def encode_segments(self, segments: list[str]) -> list[bytes]:
        """Ids of each segment, as little-endian 32-bit integers."""
        data = [s.encode() for s in segments]
        long = {i: d for i, d in enumerate(data) if len(d) > LONG_SEGMENT}
        if long:
            rest = iter(self._relax([d for i, d in enumerate(data) if i not in long]))
            return [self._relax_long(long[i]) if i in long else next(rest) for i in range(len(data))]
        return self._relax(data)

    def _relax_long(self, text: bytes) -> bytes:
        """The same joins for one segment: the best-scoring, of equals the first, from a heap."""
        keys, piece = self.edges(text)
        places, numbers = array("q", keys.astype(np.int64).tobytes()), array("i", piece.astype(np.int32).tobytes())
        raw = np.frombuffer(text, np.uint8)
        start = np.flatnonzero((raw & 0xC0) != 0x80).tolist()
        end = [*start[1:], len(text)]
        before, after = list(range(-1, len(start) - 1)), [*range(1, len(start)), -1]
        scores = self.scores.tolist()

        def find(a: int, b: int) -> int:
            if b - a > 255:
                return -1
            k = bisect_left(places, a * 256 + b - a)
            return numbers[k] if k < len(places) and places[k] == a * 256 + b - a else -1

        heap = []
        for i in range(len(start) - 1):
            if (n := find(start[i], end[i + 1])) >= 0:
                heap.append((-scores[n], start[i], i, end[i + 1]))
        heapify(heap)
        while heap:
            _, _, i, stop = heappop(heap)
            j = after[i]
            if end[i] < 0 or j < 0 or end[j] != stop:
                continue  # one of the two has been joined since
            end[i], end[j] = stop, -1
            after[i] = after[j]
            if after[i] >= 0:
                before[after[i]] = i
                if (n := find(start[i], end[after[i]])) >= 0:
                    heappush(heap, (-scores[n], start[i], i, end[after[i]]))
            h = before[i]
            if h >= 0 and (n := find(start[h], stop)) >= 0:
                heappush(heap, (-scores[n], start[h], h, stop))
        ids = array("i")
        for a, b in zip(start, end):
            if b >= 0:
                n = find(a, b)
                if n >= 0:
                    ids.append(int(self.ids[n]))
                else:
                    ids.extend(self.byte_ids[raw[a:b]].tolist())
        return np.array(ids, "<i4").tobytes()

    def _relax(self, data: list[bytes]) -> list[bytes]:
        text = b"".join(data)
        keys, piece = self.edges(text)
        raw = np.frombuffer(text, np.uint8)
        start = np.flatnonzero((raw & 0xC0) != 0x80)
        end = np.append(start[1:], len(text))
        owner = np.repeat(np.arange(len(data)), [len(d) for d in data])[start]
        done: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        scores = np.append(self.scores, -np.inf)

        def find(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Piece number of the text from a to b, or -1."""
            want = a * 256 + np.minimum(b - a, 255)
            at = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            return np.where((keys[at] == want) & (b - a < 256), piece[at], -1) if len(keys) else np.full(len(a), -1)

        while len(start):
            joined = np.full(len(start), -1)
            pair = np.flatnonzero(owner[:-1] == owner[1:])
            joined[pair] = find(start[pair], end[pair + 1])
            value = scores[joined]
            heads = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.repeat(np.maximum.reduceat(value, heads), np.diff(np.append(heads, len(start))))
            active = best > -np.inf
            if not active.all():
                done.append((owner[~active], start[~active], end[~active]))
            top = np.flatnonzero((value == best) & active)
            top = top[np.append(True, owner[top[1:]] != owner[top[:-1]])] if len(top) else top  # the first of equals
            end[top] = end[top + 1]
            active[top + 1] = False
            start, end, owner = start[active], end[active], owner[active]

        owner, start, end = (np.concatenate(c) for c in zip(*done)) if done else (np.zeros(0, int),) * 3
        order = np.argsort(start, kind="stable")
        owner, start, end = owner[order], start[order], end[order]
        found = find(start, end)
        width = np.where(found >= 0, 1, end - start)  # a byte each without a piece
        ids = np.repeat(np.where(found >= 0, self.ids[found], -1), width).astype("<i4")
        missing = np.flatnonzero(ids < 0)
        begin = np.cumsum(width) - width
        symbol = np.repeat(np.arange(len(width)), width)
        ids[missing] = self.byte_ids[raw[start[symbol[missing]] + missing - begin[symbol[missing]]]]
        cuts = np.searchsorted(np.repeat(owner, width), np.arange(len(data) + 1)) * 4
        packed = ids.tobytes()
        return [packed[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist())]

    # Texts

    def segments(self, text: str) -> list[str]:
        if not text:
            return []
        if "  " in text or " \n" in text or text[0] in " \n" or MARK in text:
            return _SEGMENT.findall(MARK + text.replace(" ", MARK))
        return [p if p[:1] == "\n" else MARK + p for p in text.replace("\n", " \n").split(" ")]

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [self.segments(t) for t in texts]
        met = [list(map(self.cache.get, segments)) for segments in cut]
        partly = [k for k, ids in enumerate(met) if None in ids]
        new = list({s for k in partly for s, ids in zip(cut[k], met[k]) if ids is None})
        fresh: dict[str, bytes] = {}
        at = 0
        while at < len(new):
            stop, size = at, 0
            while stop < len(new) and (size < MATCH_BYTES or stop == at):
                size += len(new[stop])
                stop += 1
            fresh.update(zip(new[at:stop], self.encode_segments(new[at:stop])))
            at = stop
        for k in partly:
            met[k] = [ids or fresh[s] for s, ids in zip(cut[k], met[k])]
        out = [b"".join(ids) for ids in met]
        for s, ids in fresh.items():
            if len(self.cache) >= self.most_segments:
                break
            if len(s) <= LONGEST_CACHED:
                self.cache[s] = ids
        return out

    def decode(self, ids) -> str:
        text = b"".join([self.bytes_of[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text[:1] == " " else text


def _fields(message: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message; fixed-width values as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = message[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(message):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
            continue
        size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
        yield number, message[at : at + size]
        at += size


def model_settings(proto: bytes) -> tuple[str, str]:
    """(kind, name of the normaliser) of a SentencePiece model."""
    top = {n: v for n, v in _fields(proto) if n in (2, 3)}  # the trainer's and the normaliser's settings
    kind = dict(_fields(top.get(2, b""))).get(3, 1)
    rule = dict(_fields(top.get(3, b""))).get(1, b"")
    return {1: "unigram", 2: "bpe", 3: "word", 4: "char"}.get(kind, str(kind)), rule.decode()


def _word(pieces: list[bytes], at: int, fill: bytes) -> np.ndarray:
    return np.array([int.from_bytes(p[at : at + 8].ljust(8, fill), "big") for p in pieces], np.uint64)


def encode_texts(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids) of every row; ``model`` is the path of a SentencePiece BPE model.

    Defined results: null and empty texts have no ids; a word mark (U+2581) in a text
    counts as a space; repeated rows give a row each; null ids are carried through;
    an empty table gives no rows; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice.of(model)
        for batch in batches:
            ids = [np.frombuffer(x, "<i4") for x in lattice.encode(pc.fill_null(batch.column(1), "").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "ids"])

    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return bounded(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)


def decode_ids(df: DataFrame, model: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of every row of ids; null or no ids give the empty text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice.of(model)
        for batch in batches:
            texts = [lattice.decode(ids or ()) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType), T.StructField("text", T.StringType())])
    return bounded(df).select(F.col(id_col).alias("doc_id"), F.col(ids_col).alias("ids")).mapInArrow(run, schema)


def encoding_digests(df: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_ids, ids_crc32 (little-endian 32-bit ids), and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice.of(model)
        for batch in batches:
            texts = pc.fill_null(batch.column(1), "").to_pylist()
            packed = lattice.encode(texts)
            same = [lattice.decode(np.frombuffer(x, "<i4").tolist()) == t for x, t in zip(packed, texts)]
            columns = [pa.array([len(x) // 4 for x in packed], pa.int64()), pa.array([zlib.crc32(x) for x in packed], pa.int64()), pa.array(same, pa.bool_())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["doc_id", "n_ids", "ids_crc32", "round_trip"])

    schema = T.StructType([T.StructField("doc_id", df.schema[id_col].dataType)]).add("n_ids", "long").add("ids_crc32", "long").add("round_trip", "boolean")
    return bounded(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, schema)
