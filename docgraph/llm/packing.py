"""Packing documents into token windows by the sum-of-squares rule.

Each task tokenises its own documents and packs them on-line: a document's full
windows are cut off, and the remainder goes to the fill level that minimises the
sum of squares of the counts of partially filled windows, which a level array
tracks.  When a task's input ends, its emptiest open windows are cut up to
fill its fullest, so that a task leaves at most one padded window.

Nothing is shuffled: memory is one Arrow batch and the open windows, and a lost
task is simply run again on its own input split.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import ByteBpe
from .shared import bounded

CAPACITY = 1024
SEPARATOR = 0


class SumOfSquares:
    """Open windows by fill level; ``place`` and ``finish`` return windows that are done."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.counts = np.zeros(capacity + 1, np.int64)  # of windows at each level; level 0 stands for a new one
        self.open: list[list[list]] = [[] for _ in range(capacity)]

    def level_for(self, size: int) -> int:
        """The fill level that leaves the least sum of squared counts; the fullest of equals."""
        levels = self.capacity - size + 1
        after = self.counts[size:].copy()
        after[-1] = 0  # a full window is no longer counted
        cost = 2 * (after - self.counts[:levels])
        cost[1:] += 1
        cost[-1] -= 1
        usable = self.counts[:levels] > 0
        usable[0] = True
        cost[~usable] = np.iinfo(np.int64).max
        return levels - 1 - int(np.argmin(cost[::-1]))

    def place(self, piece: tuple) -> list | None:
        size = len(piece[1])
        level = self.level_for(size)
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + size == self.capacity:
            return window
        self.counts[level + size] += 1
        self.open[level + size].append(window)
        return None

    def finish(self) -> Iterator[list]:
        """Close every open window, cutting the emptiest to fill the fullest."""
        left = [w for level in reversed(self.open) for w in level]
        a, b = 0, len(left) - 1
        while a < b:
            room = self.capacity - sum(len(p[1]) for p in left[a])
            start, ids, *rest = left[b].pop()
            if len(ids) > room:
                left[b].append((start + room, ids[room:], *rest))
                ids = ids[:room]
            left[a].append((start, ids, *rest))
            if len(ids) == room:
                yield left[a]
                a += 1
            if not left[b]:
                b -= 1
        if a <= b and left:
            yield left[a]


def _packer(tokenizer: str | None, capacity: int, separator: int, with_ids: bool):
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = ByteBpe.of(tokenizer)
        sequence = TaskContext.get().partitionId() << 40
        packer = SumOfSquares(capacity)
        end = np.array([separator], "<u4").tobytes()
        out: list[tuple] = []
        id_type = None

        def close(window: list) -> None:
            nonlocal sequence
            offset = 0
            for start, ids, key, total in window:
                row = (key, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset)
                out.append((*row, ids) if with_ids else row)
                offset += len(ids)
            sequence += 1

        def flush() -> pa.RecordBatch:
            kinds = [id_type, *[pa.int64()] * 6] + [pa.list_(pa.int32())] * with_ids
            batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)
            out.clear()
            return batch

        for batch in batches:
            id_type = batch.column(0).type
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = np.frombuffer(encoder.encode(text or "") + end, "<u4")
                whole = len(ids) - len(ids) % capacity
                for start in range(0, whole, capacity):
                    close([(start, ids[start : start + capacity], key, len(ids))])
                if whole < len(ids):
                    done = packer.place((whole, ids[whole:].copy(), key, len(ids)))
                    if done:
                        close(done)
                if len(out) >= 20_000:
                    yield flush()
        for window in packer.finish():
            close(window)
        if out:
            yield flush()

    return run


def pack_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                   capacity: int = CAPACITY, separator: int = SEPARATOR, with_ids: bool = False) -> DataFrame:
    """Pieces of ``df``'s documents with the window each lies in.

    ``tokenizer`` is the path of a byte-level BPE in the ``tokenizers`` JSON
    format; by default that of the public 50k vocabulary.  ``with_ids`` adds the
    token ids of each piece.

    Defined results: a null or empty text is the separator alone; documents of
    any length are tokenised whole; repeated rows are packed once each; a null
    id is carried through; an empty table gives no rows; other columns of
    ``df`` are not read.
    """
    fields = [T.StructField("doc_id", df.schema[id_col].dataType)]
    fields += [T.StructField(c, T.LongType()) for c in ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")]
    if with_ids:
        fields.append(T.StructField("ids", T.ArrayType(T.IntegerType())))
    source = bounded(df).select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(_packer(tokenizer, capacity, separator, with_ids), T.StructType(fields))
