"""Near-dedup by exact shingle similarity, with SimHash and MinHash candidates.

Two documents are linked where the Jaccard similarity of their sets of word
shingles reaches the threshold, and only there.  Candidate pairs come from fingerprints within a
few bits (Golay keys, see ``simhash``) and, as a 64-bit fingerprint misses many similar pairs, from
circulant MinHash bands (see ``minhash``), of which two documents of similarity 0.8 share one but for a chance of 1.3e-7.
Texts of the same words are one node.  Buckets are worked off by ``similarity``, which lists no bucket's pairs and loses none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .minhash import band_keys, signature
from .shared import bounded, discard, free_name, number_rows, save
from .similarity import similar_components
from .simhash import fingerprint_links, majority, shingle_hashes

WORDS = 5
PERCENT = 80


def _signatures(words: int):
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            first: dict[bytes, int] = {}
            of_row, digests, sizes, prints, bands = [], [], [], [], []
            for text in batch.column(2).cast(pa.binary()).to_pylist():
                words_of = b" ".join((text or b"").lower().split())
                at = first.setdefault(words_of, len(digests))
                fresh = at == len(digests)
                if fresh:
                    hashes = shingle_hashes(words_of, words)
                    distinct = np.unique(hashes)
                    digests.append(xxhash.xxh3_128_digest(words_of))
                    sizes.append(len(distinct))
                    prints.append(majority(hashes))
                of_row.append(at)
                bands.append(band_keys(signature(distinct)[None])[0] if fresh and len(distinct) else None)  # repeated texts of a batch have none
            columns = [pa.array(np.array(x)[of_row]) if of_row else pa.array([], pa.int64()) for x in (np.array(sizes, np.int64), np.array(prints, np.uint64).view(np.int64))]
            columns = [pa.array([digests[k] for k in of_row], pa.binary()), *columns, pa.array(bands, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *columns], names=["id", "row", "digest", "n", "fp", "bands"])

    return run


def _shingle_sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                sets = [np.unique(shingle_hashes(t or b"", words)).view(np.int64) for t in part.column(1).cast(pa.binary()).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    return run


def _meeting(nodes: DataFrame, max_bits: int) -> DataFrame:
    """(key, node, n) of the keys that two nodes of ``nodes`` (node, n, fp, bands) or more have."""
    # Fingerprints are linked by their own least node: equal ones form a bucket, near ones a bucket of two.
    prints = save(nodes.groupBy("fp").agg(F.min("node").alias("node")), "near-prints")
    links = fingerprint_links(prints.select("fp"), max_bits).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    ends = links.select(F.explode(F.array("a", "b")).alias("fp"), F.xxhash64(F.lit("near"), "a", "b").alias("key"))
    near = ends.join(prints, "fp").select("key", "node").join(nodes.select("node", "n"), "node").select("key", "node", "n")
    equal = nodes.select(F.xxhash64(F.lit("fp"), "fp").alias("key"), "node", "n")
    every = nodes.select(F.explode("bands").alias("key"), "node", "n").unionByName(equal)
    shared = save(every.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "near-shared")
    meeting = save(every.join(shared, "key", "left_semi").unionByName(near), "near-meeting")
    discard(prints, shared)
    return meeting


def drop_similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT, max_bits: int = 2) -> DataFrame:
    """Rows of ``df``, one of each component of similar texts: the smallest id (nulls last), then the earliest row.

    A null text counts as empty; texts without words are alike, and similar to no others; repeated rows are alike; an
    empty table gives no rows; every column of ``df`` comes back, whatever its name.
    """
    row = free_name(df)
    numbered = number_rows(df, "near-rows", row)
    texts = numbered.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{row}`").alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    fields = [("id", texts.schema["id"].dataType), ("row", T.LongType()), ("digest", T.BinaryType()), ("n", T.LongType()), ("fp", T.LongType()), ("bands", T.ArrayType(T.LongType()))]
    rows = save(bounded(texts).mapInArrow(_signatures(words), T.StructType([T.StructField(n, t) for n, t in fields])), "near-signatures")
    best = F.min(F.struct(F.col("id").isNull().alias("none"), F.col("id"), F.col("row"))).alias("best")
    groups = save(rows.groupBy("digest").agg(F.min("row").alias("node"), best).select("node", "best"), "near-groups")
    nodes = rows.where("bands IS NOT NULL").join(groups.select(F.col("node").alias("row")), "row", "left_semi")
    nodes = save(nodes.select(F.col("row").alias("node"), "n", "fp", "bands"), "near-nodes")
    discard(rows)
    meeting = _meeting(nodes, max_bits)
    wanted = save(meeting.select(F.col("node").alias("row")).distinct(), "near-wanted")
    sets = save(bounded(texts.join(wanted, "row", "left_semi").select("row", "text")).mapInArrow(_shingle_sets(words), "node long, shingles array<long>"), "near-sets")
    roots = similar_components(meeting, sets, percent)
    linked = groups.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    kept = save(linked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row)), "near-kept")
    discard(nodes, meeting, wanted, sets, roots, groups)
    return numbered.join(kept, row, "left_semi").drop(row)
