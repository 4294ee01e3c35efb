"""Near-dedup by circulant MinHash, banding and exact Jaccard verification.

Two permutations make a whole signature.  The first gives each shingle a place on a circle; the second is a
table of the circle, and coordinate k of a signature is the least value of the table, shifted by k places, over a set's
places.  A shingle's values for all coordinates are therefore one window of the table.  ``BANDS`` bands of ``BAND_ROWS`` coordinates give the
keys: two sets of Jaccard similarity 0.8 share one with probability 1 - (1 - 0.8^5)^40, all but 1.3e-7.

Candidates are confirmed on the full sets of 64-bit shingle hashes (see ``similarity``, which loses no pair that shares a key).
Equal sets are one node, however many documents have them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, discard, number_rows, save
from .similarity import similar_components

WORDS = 2
PERCENT = 80
BANDS, BAND_ROWS = 40, 5
CIRCLE_BITS = 20
SEED = 42
CACHED_WORDS = 500_000
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_HALF = np.uint64(32)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _HALF)) * _MIX
    x = (x ^ (x >> _HALF)) * _MIX
    return x ^ (x >> _HALF)


class Shingles:
    """Sets of word-shingle hashes, with the hashes of words kept."""

    def __init__(self, words: int):
        self.words = words
        self.known: dict[bytes, int] = {}

    def of(self, text: bytes) -> np.ndarray:
        """The distinct hashes, ascending; a shorter text is one shingle, and one without words has none."""
        import xxhash

        parts = text.lower().split()
        if not parts:
            return np.zeros(0, np.uint64)
        if len(self.known) > CACHED_WORDS:
            self.known.clear()
        known, digest = self.known, xxhash.xxh64_intdigest
        hashes = np.array([known[w] if w in known else known.setdefault(w, digest(w, SEED)) for w in parts], np.uint64)
        width = min(self.words, len(hashes))
        runs = np.full(len(hashes) - width + 1, width, np.uint64)
        for k in range(width):
            runs = _mixed(runs * _ODD + hashes[k : len(hashes) - width + 1 + k])
        return np.unique(runs)


@lru_cache(maxsize=1)
def _windows() -> np.ndarray:
    """Row p: the values of place p for all coordinates, a window of the second permutation."""
    size, span = 1 << CIRCLE_BITS, BANDS * BAND_ROWS
    table = np.random.default_rng(SEED).permutation(size).astype(np.uint32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([table, table[:span]]), span)


@lru_cache(maxsize=1)
def _places() -> np.ndarray:
    """The first permutation: the place on the circle of each value of a hash's top bits."""
    return np.random.default_rng(SEED + 1).permutation(1 << CIRCLE_BITS).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    windows, places = _windows(), _places()[(hashes >> np.uint64(64 - CIRCLE_BITS)).astype(np.int64)]
    least = np.full(windows.shape[1], 2**32 - 1, np.uint32)
    for at in range(0, len(places), 1024):
        np.minimum(least, windows[places[at : at + 1024]].min(axis=0), out=least)
    return least


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """(sets, bands): a key for each band of each row of ``signatures``, of its number and its coordinates."""
    bands = signatures.reshape(len(signatures), BANDS, BAND_ROWS).astype(np.uint64)
    keys = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), bands.shape[:2])
    for k in range(BAND_ROWS):
        keys = _mixed(keys * _ODD + bands[:, :, k])
    return keys.view(np.int64)


def _signatures(words: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            first: dict[bytes, int] = {}
            sets, of_row, own = [], [], []
            for row, text in enumerate(batch.column(2).cast(pa.binary()).to_pylist()):
                text = text or b""
                at = first.setdefault(text, len(sets))
                if at == len(sets):
                    hashes = shingles.of(text)
                    sets.append((len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), signature(hashes) if len(hashes) else None))
                    own.append(row)
                of_row.append(at)
            keys = [None] * len(of_row)
            full = [k for k, s in enumerate(sets) if s[0]]
            if full:
                for k, row_keys in zip(full, band_keys(np.stack([sets[k][2] for k in full]))):
                    keys[own[k]] = row_keys  # repeated texts of a batch have none
            columns = [pa.array([sets[k][0] for k in of_row], pa.int64()), pa.array([sets[k][1] for k in of_row], pa.binary()), pa.array(keys, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["row", "doc_id", "n", "digest", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(words)
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                sets = [shingles.of(t or b"").view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def minhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``df``.

    Defined results: null texts, empty texts and texts without words have no shingles and are linked with nothing; a text of
    fewer than ``words`` words is one shingle; equal sets are linked; component_id is the smallest non-null id reachable (null if there is
    none), and kept is whether it is the row's own id; repeated rows give a row each; an empty table gives no rows; other
    columns are not read.
    """
    source = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    texts = number_rows(source, "minhash-texts", "row")
    fields = [("row", T.LongType()), ("doc_id", source.schema["doc_id"].dataType), ("n", T.LongType()), ("digest", T.BinaryType()), ("keys", T.ArrayType(T.LongType()))]
    schema = T.StructType([T.StructField(n, t) for n, t in fields])
    rows = save(bounded(texts).select("row", "doc_id", "text").mapInArrow(_signatures(words), schema), "minhash-rows")
    nodes = save(rows.where("n > 0").groupBy("digest").agg(F.min("row").alias("node"), F.min("doc_id").alias("least")), "minhash-nodes")
    keyed = rows.where("keys IS NOT NULL").join(nodes.select(F.col("node").alias("row")), "row", "left_semi").select(F.explode("keys").alias("key"), F.col("row").alias("node"), "n")
    shared = save(keyed.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "minhash-shared")
    meeting = save(keyed.join(shared, "key", "left_semi"), "minhash-meeting")
    wanted = save(meeting.select(F.col("node").alias("row")).distinct(), "minhash-wanted")
    sets = save(bounded(texts.join(wanted, "row", "left_semi").select("row", "text")).mapInArrow(_sets(words), "node long, shingles array<long>"), "minhash-sets")
    discard(texts, shared, wanted)
    roots = similar_components(meeting, sets, percent)
    discard(meeting, sets)
    grouped = save(nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "minhash-groups")
    least = save(grouped.groupBy("root").agg(F.min("least").alias("component")), "minhash-least")
    of_set = save(grouped.join(least, "root").select("digest", "component"), "minhash-components")
    discard(nodes, roots, grouped, least)
    out = rows.select("doc_id", "n", "digest").join(of_set, "digest", "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))
