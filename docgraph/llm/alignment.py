"""Cross-tokenizer alignment by byte labels.

Both tokenizers cut the same bytes.  Each byte has a label: 0 where no token ends, 1 where one of A ends, 2 where one of B does, 3 where
both do.  A regular expression scans the labels for spans up to each both-label; the labels in a span count the tokens of its
group.  Between two neighbouring ends lies one pair of overlapping tokens, so a label that is not 0 is a link, whose
tokens are the ones open at it.

How many documents link a pair of ids is counted over the corpus.  Tasks write their documents in blocks of a bounded size: the
distinct pairs of a block with the documents that hold each, and each document's links as places in that list.  Pairs are summed by
key, compared with the highest of their A id, joined back to the blocks that use them, and each block adds up its documents' links.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .byte_bpe import ByteBpe
from .piece_lattice import PieceLattice
from .shared import bounded, save

A_END, B_END, BOTH = 1, 2, 3
BLOCK_BYTES = 4 << 20
CACHED = 500_000
GROUP_BYTES = 1 << 20  # of texts aligned side by side
GROUP_ROWS = 1  # blocks that a reader of the stored blocks decodes at once
_SPAN = re.compile(rb"[^\x03]*\x03")


class Side:
    """One tokenizer: the ids of texts, the bytes of ids, and the names of ids before a comma or a group's end."""

    def __init__(self, encode, bytes_of: dict[int, bytes], last: str):
        size = max(bytes_of) + 1
        self.encode = encode
        self.bytes_of = [bytes_of.get(i, b"") for i in range(size)]
        self.lengths = np.array([len(b) for b in self.bytes_of], np.int64)
        self.names = [f"{i}{end}" for i in range(size) for end in (",", last)]


@lru_cache(maxsize=4)
def sides(a_path: str | None, b_path: str | None) -> tuple[Side, Side]:
    bpe, lattice = ByteBpe(a_path), PieceLattice(b_path)
    bpe.most_parts = lattice.most_segments = CACHED  # a worker holds both
    pieces = lattice.bytes_of
    pieces = dict(enumerate(pieces)) if isinstance(pieces, list) else dict(pieces)
    return Side(lambda texts: [bpe.encode_plain(" " + t) for t in texts], bpe.bytes_of, "|"), Side(lattice.encode, pieces, ";")


def byte_labels(a_ends: np.ndarray, b_ends: np.ndarray, size: int) -> np.ndarray:
    labels = np.zeros(size, np.uint8)
    labels[a_ends - 1] |= A_END
    labels[b_ends - 1] |= B_END
    return labels


def spans(labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, tokens of A, tokens of B) of each span up to a both-label."""
    found = _SPAN.findall(labels)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)))
    if not len(ends):
        return ends, ends, ends
    starts = np.append(0, ends[:-1])
    return ends, np.add.reduceat(labels & A_END, starts, dtype=np.int64), np.add.reduceat(labels >> 1, starts, dtype=np.int64)


class Alignment:
    """Documents of the same bytes on both sides, end to end: tokens, groups and links of all of them."""

    def __init__(self, a: list[bytes], b: list[bytes], sizes: list[int], side_a: Side, side_b: Side):
        self.sides = side_a, side_b
        self.a, self.b = (np.frombuffer(b"".join(x), "<u4").astype(np.int64) for x in (a, b))
        self.bounds = np.cumsum([0, *sizes])
        a_ends, b_ends = np.cumsum(side_a.lengths[self.a]), np.cumsum(side_b.lengths[self.b])
        labels = byte_labels(a_ends, b_ends, int(self.bounds[-1]))
        self.ends, self.in_a, self.in_b = spans(labels)
        at = np.flatnonzero(labels)
        kinds = labels[at]
        self.link_a = self.a[np.cumsum(kinds & A_END) - (kinds & A_END)]
        self.link_b = self.b[np.cumsum(kinds >> 1) - (kinds >> 1)]
        cuts = lambda ends: np.searchsorted(ends, self.bounds, "right")
        self.a_cuts, self.b_cuts, self.group_cuts, self.link_cuts = cuts(a_ends), cuts(b_ends), cuts(self.ends), cuts(at + 1)

    def group_texts(self) -> list[str]:
        """``a1,a2|b1;a3|b2,b3`` of each document."""
        side_a, side_b = self.sides
        before_a, before_b = np.cumsum(self.in_a), np.cumsum(self.in_b)
        codes = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[before_a - 1] = 1
        last_b[before_b - 1] = 1
        codes[np.arange(len(self.a)) + np.repeat(before_b - self.in_b, self.in_a)] = 2 * self.a + last_a
        codes[np.arange(len(self.b)) + np.repeat(before_a, self.in_b)] = 2 * self.b + last_b + len(side_a.names)
        name = (side_a.names + side_b.names).__getitem__
        cuts = (self.a_cuts + self.b_cuts).tolist()
        return ["".join(map(name, codes[x:y].tolist()))[:-1] for x, y in zip(cuts, cuts[1:])]


def align(texts: list[str | None], side_a: Side, side_b: Side) -> tuple[list[int], Alignment]:
    """(places of the texts that have tokens, their alignment); texts whose bytes a side does not give back have none."""
    found = [(k, t, (" " + t).encode()) for k, t in enumerate(texts) if t]
    both = list(zip(*(side.encode([t for _, t, _ in found]) for side in (side_a, side_b))))
    joined = lambda side, ids: b"".join(map(side.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))
    kept = [(k, raw, a, b) for (k, _, raw), (a, b) in zip(found, both) if joined(side_a, a) == raw and joined(side_b, b) == raw]
    return [k for k, *_ in kept], Alignment([a for *_, a, _ in kept], [b for *_, b in kept], [len(raw) for _, raw, *_ in kept], side_a, side_b)


def _grouped(ids: list, texts: list) -> Iterator[tuple[list, list]]:
    """Runs of documents of a bounded size; a longer text is one alone."""
    at = 0
    while at < len(texts):
        stop, size = at, 0
        while stop < len(texts) and (size < GROUP_BYTES or stop == at):
            size += len(texts[stop] or "")
            stop += 1
        yield ids[at:stop], texts[at:stop]
        at = stop


_LISTS = [("pairs", pa.int64()), ("holders", pa.int32()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("groups_sha256", pa.string()), ("n_distinct", pa.int64()), ("place", pa.int32()), ("times", pa.int32())]
_BLOCK = "block long, pairs array<long>, holders array<int>, n_a array<long>, n_b array<long>, n_groups array<long>, groups_sha256 array<string>, n_distinct array<long>, place array<int>, times array<int>"


def _blocks(a_path: str | None, b_path: str | None, id_type: pa.DataType):
    schema = pa.schema([("block", pa.int64()), *((n, pa.list_(t)) for n, t in _LISTS), ("doc_ids", pa.list_(id_type))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(a_path, b_path)
        part, count, size = TaskContext.get().partitionId(), 0, 0
        ids: list = []
        stats: list[np.ndarray] = []  # n_a, n_b, n_groups of the documents
        digests: list[str] = []
        links: list[tuple[np.ndarray, np.ndarray]] = []  # (document of the block, pair)

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal count, size
            owner, pair = (np.concatenate([x[k] for x in links]) if links else np.zeros(0, np.int64) for k in (0, 1))
            place, pairs = pd.factorize(pair)
            order = np.argsort(pairs)
            rank = np.empty_like(order)
            rank[order] = np.arange(len(order))
            each, key = pd.factorize(owner * max(1, len(pairs)) + rank[place])  # in order of documents
            pairs, times = pairs[order], np.bincount(each, minlength=len(key))
            owner, place = key // max(1, len(pairs)), key % max(1, len(pairs))
            n_a, n_b, n_groups = np.concatenate(stats).T
            columns = [pairs, np.bincount(place, minlength=len(pairs)), n_a, n_b, n_groups, digests, np.bincount(owner, minlength=len(ids)), place, times]
            lists = [pa.array([c], pa.list_(t)) for c, (_, t) in zip(columns, _LISTS)]
            yield pa.RecordBatch.from_arrays([pa.array([(part << 32) + count], pa.int64()), *lists, pa.array([ids], pa.list_(id_type))], schema=schema)
            count, size = count + 1, 0
            for held in (ids, stats, digests, links):
                held.clear()

        for batch in batches:
            for some, texts in _grouped(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, found = align(texts, side_a, side_b)
                n = np.zeros((len(texts), 3), np.int64)
                n[kept] = np.stack([np.diff(found.a_cuts), np.diff(found.b_cuts), np.diff(found.group_cuts)], 1)
                hashes = [""] * len(texts)
                for k, text in zip(kept, found.group_texts()):
                    hashes[k] = hashlib.sha256(text.encode()).hexdigest()
                owner = np.repeat(np.array(kept, np.int64), np.diff(found.link_cuts)) + len(ids)
                links.append((owner, found.link_a << 32 | found.link_b))
                ids += some
                stats.append(n)
                digests += hashes
                size += sum(len(t or "") for t in texts)
                if size >= BLOCK_BYTES:
                    yield from close()
        if ids:
            yield from close()

    return run


def _answers(out_schema: pa.Schema):
    def run(key: tuple, blocks: pa.Table, told: pa.Table) -> pa.Table:
        """The documents of a block, with what its pairs were ``told``: documents that hold them, and if that is the most of their A id."""
        row = {n: blocks[n].combine_chunks().flatten() for n in blocks.column_names if n != "block"}
        numbers = {n: row[n].to_numpy(zero_copy_only=False).astype(np.int64) for n in ("pairs", "n_distinct", "place", "times")}
        at = np.searchsorted(numbers["pairs"], told["pair"].to_numpy())
        holders, best = np.zeros(len(numbers["pairs"]), np.int64), np.zeros(len(numbers["pairs"]), np.int64)
        holders[at], best[at] = told["total"].to_numpy(), told["is_best"].to_numpy(zero_copy_only=False)
        times, place = numbers["times"], numbers["place"]
        cuts = np.append(0, np.cumsum(numbers["n_distinct"]))
        per_doc = lambda values: np.diff(np.append(0, np.cumsum(values))[cuts])
        columns = [row["doc_ids"], row["n_a"], row["n_b"], row["n_groups"], *map(pa.array, (per_doc(times), per_doc(times * best[place]), per_doc(times * holders[place]))), row["groups_sha256"]]
        return pa.Table.from_arrays(columns, schema=out_schema)

    return run


def aligned(df: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, groups) of every row; a group is (a: ids of A, b: ids of B) between two places where tokens of both end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side_a, side_b = sides(a_path, b_path)
        for batch in batches:
            for ids, texts in _grouped(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                kept, found = align(texts, side_a, side_b)
                groups: list[list] = [[] for _ in texts]
                a_at, b_at = np.append(0, np.cumsum(found.in_a)).tolist(), np.append(0, np.cumsum(found.in_b)).tolist()
                a, b = found.a.tolist(), found.b.tolist()
                for k, first, stop in zip(kept, found.group_cuts.tolist(), found.group_cuts[1:].tolist()):
                    groups[k] = [{"a": a[a_at[g] : a_at[g + 1]], "b": b[b_at[g] : b_at[g + 1]]} for g in range(first, stop)]
                kind = pa.list_(pa.struct([("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.types[0]), pa.array(groups, kind)], names=["doc_id", "groups"])

    source = _source(df, id_col, text_col)
    ids_of = T.ArrayType(T.IntegerType())
    schema = T.StructType([source.schema["doc_id"]]).add("groups", T.ArrayType(T.StructType().add("a", ids_of).add("b", ids_of)))
    return source.mapInArrow(run, schema)


def _source(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return bounded(df).select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))


def alignment_counts(df: DataFrame, a_path: str | None = None, b_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of ``df``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256.

    ``a_path`` is a byte-level BPE file and ``b_path`` a SentencePiece BPE model.  Defined results: null and empty
    texts, and those whose bytes a side does not give back (a word mark U+2581), have no tokens: zeros and an empty digest;
    special tokens' strings in a text are ordinary text; repeated rows are documents of their own; null ids are carried
    through; an empty table gives no rows; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    source = _source(df, id_col, text_col)
    id_type = source.schema["doc_id"].dataType
    arrow_id = to_arrow_type(id_type)
    schema = T.StructType([*T._parse_datatype_string(_BLOCK).fields, T.StructField("doc_ids", T.ArrayType(id_type))])
    blocks = save(source.mapInArrow(_blocks(a_path, b_path, arrow_id), schema), "alignment-blocks", GROUP_ROWS)
    uses = blocks.select("block", F.explode(F.arrays_zip("pairs", "holders")).alias("u")).select("block", F.col("u.pairs").alias("pair"), F.col("u.holders").alias("n"))
    totals = save(uses.groupBy("pair").agg(F.sum("n").alias("total")), "alignment-pairs")
    a_id = F.shiftright("pair", 32).alias("a")
    most = save(totals.groupBy(a_id).agg(F.max("total").alias("most")), "alignment-most")
    known = totals.select(a_id, "pair", "total").join(most, "a").select("pair", "total", (F.col("total") == F.col("most")).alias("is_best"))
    told = uses.select(F.col("block").alias("of"), "pair").join(known, "pair").select("of", "pair", "total", "is_best")
    fields = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    out = pa.schema([("doc_id", arrow_id), *((n, pa.int64()) for n in fields), ("groups_sha256", pa.string())])
    result = T.StructType([T.StructField("doc_id", id_type), *(T.StructField(n, T.LongType()) for n in fields), T.StructField("groups_sha256", T.StringType())])
    inner = blocks.drop("holders")
    return inner.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_answers(out), result)
