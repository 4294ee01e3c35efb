"""SimHash near-dedup with Golay-code fuzzy hashing.

A fingerprint's 64 bits are cut into segments of 22, 21 and 21 bits.  Two
fingerprints that differ in at most two bits agree wholly on one segment
(pigeonhole), and differ in at most two bits on the segment after it.  The perfect
[23, 12] Golay code gives a segment a few 12-bit codeword indices: those that
the segment and each word one bit away decode to.  Two words at most two bits
apart have a word between them that is one bit from either, so they share an
index.  A key is therefore (which segment, its bits, an index of the next segment),
some 16 keys of 33 bits for a fingerprint.  For three to five differing bits, at
least two segments differ in at most two (pigeonhole again), and a key is (which
two segments, an index of either): some 84 keys of 24 bits.

Keys are joined in sorted partitions and verified on all 64 bits; of each key's
links only a spanning forest is emitted, so output grows with the rows, not with
their pairs.  Equal fingerprints are one node throughout, however many copies.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .shared import bounded, free_name, number_rows, save

SHINGLE_WORDS = 3
MAX_BITS = 2
SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # (lowest bit, bits)
GOLAY_GENERATOR = 0xC75  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1
SMALL_BUCKET = 64
HELD_PRINTS = 1 << 16  # of one key, held by a task before it hands them on


# Fingerprints


def shingle_hashes(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """XXH64 of every run of ``words`` words; a shorter text is one shingle, and one without words has none."""
    import xxhash

    parts = text.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    joined = b" ".join(parts)
    if len(parts) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes)[: len(parts) - words + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends[words - 1 :].tolist())), np.uint64, len(starts))


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """Bit i is set where more than half of the shingles' XXH64 values have it set."""
    return majority(shingle_hashes(text, words))


def majority(hashes: np.ndarray) -> int:
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 255 * 256):
        bits = np.unpackbits(hashes[at : at + 255 * 256].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        even = len(bits) // 255 * 255
        counts += bits[:even].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[even:].sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def _fingerprints(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(batch.column(batch.num_columns - 1), "").cast(pa.binary()).to_pylist()
            known: dict[bytes, int] = {}
            prints = np.array([known[t] if t in known else known.setdefault(t, fingerprint(t, words)) for t in texts], np.uint64)
            columns = [*batch.columns[:-1], pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names[:-1], "fp"])

    return run


def fingerprints(df: DataFrame, carry: dict[str, str], text_col: str = "text", words: int = SHINGLE_WORDS) -> DataFrame:
    """(carried columns, fp) of every row; ``carry`` maps output names to columns of ``df``."""
    source = bounded(df).select(*[F.col(f"`{c}`").alias(n) for n, c in carry.items()], F.col(text_col).cast("string").alias("__text"))
    fields = [T.StructField(f.name, f.dataType) for f in source.schema.fields[:-1]]
    return source.mapInArrow(_fingerprints(words), T.StructType([*fields, T.StructField("fp", T.LongType())]))


# Golay keys


@lru_cache(maxsize=1)
def _golay() -> tuple[np.ndarray, np.ndarray]:
    """(parity bits of each 12-bit word, least error pattern of each 11-bit syndrome)."""
    parity = np.arange(4096, dtype=np.int64) << 11
    for bit in range(22, 10, -1):
        parity = np.where(parity >> bit & 1, parity ^ (GOLAY_GENERATOR << (bit - 11)), parity)
    single = 1 << np.arange(23, dtype=np.int64)
    errors = {0}
    for _ in range(3):
        errors |= {e ^ int(s) for e in errors for s in single}
    patterns = np.array(sorted(errors), np.int64)
    leaders = np.zeros(2048, np.int64)
    leaders[parity[patterns >> 11] ^ (patterns & 0x7FF)] = patterns
    return parity, leaders


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the one Golay codeword within three bits of each 23-bit word."""
    parity, leaders = _golay()
    return (words ^ leaders[parity[words >> 11] ^ (words & 0x7FF)]) >> 11


def _indices(words: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, codeword index) of every index of every segment value."""
    flips = np.array([0, *(1 << k for k in range(bits))], np.int64)
    near = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    first = np.ones(near.shape, bool)
    first[:, 1:] = near[:, 1:] != near[:, :-1]
    rows, cols = np.nonzero(first)
    return rows, near[rows, cols]


def golay_keys(prints: np.ndarray, max_bits: int = MAX_BITS) -> tuple[np.ndarray, np.ndarray]:
    """(position of the fingerprint, key) of every key of every fingerprint."""
    segments = [((prints >> np.uint64(low)) & np.uint64((1 << bits) - 1)).astype(np.int64) for low, bits in SEGMENTS]
    indices = [_indices(words, bits) for words, (_, bits) in zip(segments, SEGMENTS)]
    at, keys = [], []
    for one in range(len(SEGMENTS)):
        other = (one + 1) % len(SEGMENTS)
        rows, near = indices[other]
        if max_bits <= 2:
            at.append(rows)
            keys.append((one << 34) | (segments[one][rows] << 12) | near)
            continue
        own_rows, own = indices[one]
        count = np.bincount(own_rows, minlength=len(prints))
        begin = np.cumsum(count) - count
        repeat = count[rows]  # each index of the other segment meets every index of this one
        place = np.repeat(begin[rows] - np.cumsum(repeat) + repeat, repeat) + np.arange(repeat.sum())
        at.append(np.repeat(rows, repeat))
        keys.append((one << 34) | (own[place] << 12) | np.repeat(near, repeat))
    return np.concatenate(at), np.concatenate(keys)


def _keys(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for start in range(0, len(prints), 4096):
                block = prints[start : start + 4096]
                at, keys = golay_keys(block, max_bits)
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(block[at].view(np.int64))], names=["key", "fp"])

    return run


# Verification


def _forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints at most ``max_bits`` apart."""
    size = len(prints)
    if max_bits > 2:
        return _spread(prints, max_bits)
    if size <= SMALL_BUCKET or max_bits != 2:
        a, b = np.nonzero(np.triu(np.bitwise_count(prints[:, None] ^ prints) <= max_bits, 1))
    else:  # two words at most two bits apart are both within one bit of some word, and the converse
        differing = np.bitwise_or.reduce(prints ^ prints[0])
        flips = np.array([0, *(1 << k for k in range(64) if int(differing) >> k & 1)], np.uint64)
        near = (prints[:, None] ^ flips).ravel()
        order = np.argsort(near, kind="stable")
        same = near[order[1:]] == near[order[:-1]]
        pairs = np.unique(np.stack([order[:-1][same] // len(flips), order[1:][same] // len(flips)], 1), axis=0)
        a, b = pairs[:, 0], pairs[:, 1]
    parent = list(range(size))
    edges = []
    for x, y in zip(a.tolist(), b.tolist()):
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        while parent[y] != y:
            parent[y] = y = parent[parent[y]]
        if x != y:
            parent[max(x, y)] = min(x, y)
            edges.append((x, y))
    return edges


def _spread(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """The forest, found from one fingerprint to all near it that are not reached yet, and on from those."""
    left, edges, reached = np.arange(len(prints)), [], []
    while len(left):
        if not reached:
            reached.append(int(left[0]))
            left = left[1:]
        node = reached.pop()
        near = np.bitwise_count(prints[left] ^ prints[node]) <= max_bits
        new = left[near].tolist()
        edges += [(node, x) for x in new]
        reached += new
        left = left[~near]
    return edges


def _verify(max_bits: int):
    def links(keys: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        cut = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(keys)]])
        two = starts[ends - starts == 2]
        close = two[np.bitwise_count(prints[two] ^ prints[two + 1]) <= max_bits]
        a, b = [prints[close]], [prints[close + 1]]
        for s, e in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist()):
            group = prints[s:e]
            edges = np.array(_forest(group, max_bits), np.int64).reshape(-1, 2)
            a.append(group[edges[:, 0]])
            b.append(group[edges[:, 1]])
        return np.concatenate(a), np.concatenate(b)

    names = ["a", "b", "is_link"]

    def batch_of(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(np.ones(len(a), bool))], names=names)

    def handed_on(prints: np.ndarray) -> Iterator[pa.RecordBatch]:
        for start in range(0, len(prints), 4096):
            block = prints[start : start + 4096]
            words = (block[:, None] ^ np.array([0, *(1 << k for k in range(64))], np.uint64)).ravel()
            columns = [pa.array(words.view(np.int64)), pa.array(np.repeat(block, 65).view(np.int64)), pa.array(np.zeros(len(words), bool))]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # rows of the last key so far
        count, hot = 0, None  # hot: a key whose rows are handed on as they come
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            prints = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
            if hot is not None:
                more = int(np.searchsorted(keys, hot, "right"))
                yield from handed_on(prints[:more])
                keys, prints = keys[more:], prints[more:]
                hot = None if len(keys) else hot
            if not len(keys):
                continue
            if not (held and keys[-1] == held[0][0][0]):
                last = int(np.searchsorted(keys, keys[-1]))
                whole = [*held, (keys[:last], prints[:last])]
                held, count = [], 0
                k, p = np.concatenate([x for x, _ in whole]), np.concatenate([x for _, x in whole])
                if len(k):
                    yield batch_of(*links(k, p))
                keys, prints = keys[last:].copy(), prints[last:].copy()
            held.append((keys, prints))
            count += len(keys)
            if count > HELD_PRINTS and max_bits == 2:
                hot = keys[-1]
                for _, p in held:
                    yield from handed_on(p)
                held, count = [], 0
        if held:
            yield batch_of(*links(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held])))

    return run


def fingerprint_links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect exactly what lies within ``max_bits``.

    A key of very many fingerprints is not held by its task: at two bits they are handed on once for each word one
    bit away, and those that share such a word, at most 65, are within two bits of each other.  (At three to five
    bits, which no query uses, a task holds all fingerprints of a key.)
    """
    if not 0 <= max_bits <= 5:
        raise ValueError("the Golay keys find fingerprints at most five bits apart")
    keyed = prints.select("fp").mapInArrow(_keys(max_bits), "key long, fp long")
    parts = int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_keys = keyed.repartition(parts, "key").sortWithinPartitions("key")
    found = save(sorted_keys.mapInArrow(_verify(max_bits), "a long, b long, is_link boolean"), "fingerprint-links")
    least = found.where("NOT is_link").groupBy("a").agg(F.min("b").alias("least"), F.collect_set("b").alias("all"))
    through_words = least.where(F.size("all") > 1).select(F.col("least").alias("a"), F.explode("all").alias("b")).where("a <> b")
    return found.where("is_link").select("a", "b").unionByName(through_words)


def components(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, root) of each distinct fingerprint that has a link."""
    return connected_components(fingerprint_links(prints, max_bits)).select(F.col("node").alias("fp"), "root")


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of ``df``.

    Defined results: a null text counts as empty; texts without words have
    fingerprint zero and are linked like any other; equal fingerprints are one
    component; component_id is the smallest non-null id reachable (null if there
    is none); repeated rows give a row each; an empty table gives no rows; other
    columns are not read.
    """
    rows = save(fingerprints(df, {"doc_id": id_col}, text_col, words), "fingerprints")
    nodes = save(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-nodes")
    linked = nodes.join(components(nodes, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = linked.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = linked.select("fp", "root").join(least, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """Rows of ``df``, one of each component: the smallest id (nulls last), then the earliest row.

    Null texts, texts without words, repeated rows and empty tables as in ``simhash_components``; every column of
    ``df`` comes back, whatever its name.
    """
    row = free_name(df)
    numbered = number_rows(df, "near-rows", row)
    rows = save(fingerprints(numbered, {"id": id_col, "row": row}, text_col, words), "fingerprints")
    best = F.min(F.struct(F.col("id").isNull().alias("n"), F.col("id"), F.col("row"))).alias("best")
    nodes = save(rows.groupBy("fp").agg(best), "fingerprint-nodes")
    linked = nodes.join(components(nodes, max_bits), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    kept = linked.groupBy("root").agg(F.min("best").alias("best")).select(F.col("best.row").alias(row))
    return numbered.join(kept, row, "left_semi").drop(row)
