"""Removing repeated passages by prefix-free parsing and suffix order.

A byte string of ``length`` (200) bytes is repeated when it starts anywhere else
in the corpus.  The corpus is parsed into phrases by rolling-hash triggers: each
string's trigger is the ``TRIGGER`` (32) bytes inside it whose rolling hash is
least (the first of equals), so equal strings have equal triggers at equal places.
Strings that share a trigger position follow each other; the bytes they cover are
one phrase.  Phrases overlap by ``length - 1`` bytes, and every string starts in
exactly one of them.

* The dictionary is the set of distinct phrases of a trigger, told apart by 64-bit BLAKE2 digests of
  their bytes under a key drawn for each run; a polynomial hash, for which equal-hashing strings
  are known, decides nothing.  A phrase that occurs twice
  in the parse repeats all of its strings; a phrase whose trigger no other
  phrase has repeats none.  Counts decide these, without any text moved.  Of a phrase's
  places in one block of texts, two stand for all: the others are repeated whatever
  the rest of the corpus holds, and leave as spans (a run of one letter is one span).
* The rest are few: distinct phrases that share a trigger.  Their suffixes from the
  trigger on and their reversed prefixes are sorted, with common-prefix lengths;
  the two orders together place every string of the bucket in corpus order, and
  neighbours that agree on ``length`` bytes are repeated.
* A bucket of more than ``HOT_BUCKET`` phrases is not brought to one task: its
  strings are counted by the bytes themselves, spread over the cluster.

Texts are stored once, bucketed by row; later joins on the row move only spans.
"""

from __future__ import annotations

import hashlib
import secrets
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import bounded, discard, free_name, new_path, save

LENGTH = 200
TRIGGER = 32
HOT_BUCKET = 20_000
BLOCK_BYTES = 1 << 18
LONGEST_CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15  # odd multiplier of the rolling hash, which chooses triggers and decides nothing else


# Parsing


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Rolling:
    """Rolling hashes of any substring of a buffer, modulo 2^64.

    Equal bytes hash alike, which is all that triggers need: others that do so by chance share a bucket, where bytes decide.
    """

    def __init__(self, base: int):
        self.base, self.powers = np.uint64(base), np.ones(1, np.uint64)
        self.letters = _mix(np.arange(1, 257, dtype=np.uint64) * self.base)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self.powers) <= len(data):
            size = 1 << (len(data) + 1).bit_length()
            self.powers = np.cumprod(np.full(size, self.base), dtype=np.uint64)
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.letters[data] * self.powers[: len(data)], out=sums[1:])
        return sums

    def digest(self, sums: np.ndarray, start, end) -> np.ndarray:
        """Equal for equal bytes wherever they stand in buffers of any size up to ``LONGEST_CHUNK``."""
        return _mix((sums[end] - sums[start]) * self._inverse(start))

    def _inverse(self, start) -> np.ndarray:
        if not hasattr(self, "inverses") or len(self.inverses) < len(self.powers):
            inverse = pow(int(self.base), -1, 1 << 64)
            self.inverses = np.cumprod(np.full(len(self.powers), np.uint64(inverse)), dtype=np.uint64)
        return self.inverses[start]


def _window_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have * 2 <= width:
        out = np.minimum(out[:-have], out[have:])
        have *= 2
    rest = width - have
    return np.minimum(out[:-rest], out[rest:]) if rest else out


class Parser:
    """Phrases of texts: trigger digest, phrase digest, first string, number of strings, trigger's distance."""

    def __init__(self, length: int = LENGTH, key: bytes = b""):
        self.key = key
        self.length, self.trigger = length, min(TRIGGER, max(1, length // 4))
        self.a = _Rolling(_BASE)

    def parse(self, texts: list[bytes]) -> tuple[np.ndarray, ...]:
        """(text number, trigger, digest, first, strings, distance) of all phrases of ``texts``."""
        size = len(b"".join(texts))
        if size < self.length:
            return tuple(np.zeros(0, k) for k in (np.int64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
        data = np.frombuffer(b"".join(texts), np.uint8)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        begins = np.cumsum(sizes) - sizes
        a = self.a.prefix(data)
        at = np.arange(size - self.trigger + 1)
        grams = self.a.digest(a, at, at + self.trigger)
        ranked = (grams & np.uint64(0xFFFFFFFFFF000000)) | at.astype(np.uint64)
        least = _window_least(ranked, self.length - self.trigger + 1)
        place = (least & np.uint64(0xFFFFFF)).astype(np.int64)
        count = np.maximum(sizes - self.length + 1, 0)
        owner = np.repeat(np.arange(len(texts)), count)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
        starts = begins[owner] + within
        place = place[starts]
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(new)
        strings = np.diff(np.append(first, len(starts)))
        low, spot = starts[first], place[first]
        end = low + strings - 1 + self.length
        whole, short = data.tobytes(), (spot - low).astype("<u2").tobytes()
        digests = b"".join(
            hashlib.blake2b(whole[x:y], digest_size=8, key=self.key, salt=short[2 * k : 2 * k + 2]).digest() for k, (x, y) in enumerate(zip(low.tolist(), end.tolist()))
        )
        return owner[first], grams[spot], np.frombuffer(digests, np.uint64), within[first], strings, spot - low


def _beyond_two(trig: np.ndarray, digest: np.ndarray) -> np.ndarray:
    """Whether a phrase has stood at two places before."""
    order = np.lexsort((trig, digest))
    same = (trig[order[1:]] == trig[order[:-1]]) & (digest[order[1:]] == digest[order[:-1]])
    beyond = np.zeros(len(trig), bool)
    beyond[order[2:]] = same[1:] & same[:-1]
    return beyond


def _phrases(length: int, key: bytes = b""):
    """Rows of texts to phrases; a row without a trigger is a span of ``n`` strings that are known to be repeated."""
    names = ["rid", "trig", "digest", "lo", "n", "dist"]

    def known(rows: np.ndarray, low: np.ndarray, strings: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(rows), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(rows), none, none, pa.array(low), pa.array(strings.astype(np.int32)), pa.array(np.zeros(len(rows), np.int32))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = Parser(length, key)

        def block(rids: list[int], shifts: list[int], texts: list[bytes]) -> Iterator[pa.RecordBatch]:
            owner, trig, digest, low, strings, distance = parser.parse(texts)
            rows = np.array(rids, np.int64)[owner]
            low = low + np.array(shifts, np.int64)[owner]
            beyond = _beyond_two(trig, digest)
            columns = [rows, trig.view(np.int64), digest.view(np.int64), low, strings.astype(np.int32), distance.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c[~beyond]) for c in columns], names=names)
            rows, low, stop = rows[beyond], low[beyond], (low + strings)[beyond]
            if len(rows):
                first = np.flatnonzero(np.append(True, (rows[1:] != rows[:-1]) | (low[1:] != stop[:-1])))
                last = np.append(first[1:], len(rows)) - 1
                yield known(rows[first], low[first], stop[last] - low[first])

        for batch in batches:
            rids, shifts, texts, total = [], [], [], 0
            copies: dict[bytes, int] = {}
            whole: list[tuple[int, int]] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if len(text) < length:
                    continue
                copies[text] = copies.get(text, 0) + 1
                if copies[text] > 2:  # its strings are repeated all; two copies stand for the rest
                    whole.append((rid, len(text) - length + 1))
                    continue
                for shift in range(0, len(text) - length + 1, LONGEST_CHUNK):
                    rids.append(rid)
                    shifts.append(shift)
                    texts.append(text[shift : shift + LONGEST_CHUNK + length - 1])
                    total += len(texts[-1])
                    if total >= BLOCK_BYTES:
                        yield from block(rids, shifts, texts)
                        rids, shifts, texts, total = [], [], [], 0
            if texts:
                yield from block(rids, shifts, texts)
            if whole:
                rows, strings = np.array(whole, np.int64).T
                yield known(rows, np.zeros(len(rows), np.int64), strings)

    return run


# Suffix order inside trigger buckets


def _order(buckets: np.ndarray, parts: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted order, common-prefix length of each with the one before; -1 across buckets)."""
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    text = np.frombuffer(b"".join(p.ljust(width, b"\xff") for p in parts), np.uint8).reshape(len(parts), width)
    keys = np.concatenate([buckets.astype(">i8").view(np.uint8).reshape(-1, 8) ^ np.uint8([128, 0, 0, 0, 0, 0, 0, 0]), text], axis=1)
    by_size = np.argsort(-sizes, kind="stable")
    order = by_size[np.argsort(np.ascontiguousarray(keys[by_size]).view(f"S{width + 8}").ravel(), kind="stable")]
    sorted_text = text[order]
    differ = sorted_text[1:] != sorted_text[:-1]
    common = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
    common = np.minimum(common, np.minimum(sizes[order[1:]], sizes[order[:-1]]))
    common[buckets[order[1:]] != buckets[order[:-1]]] = -1
    return order, np.concatenate([[-1], common])


def repeated_strings(buckets: np.ndarray, phrases: list[bytes], strings: np.ndarray, distance: np.ndarray, length: int) -> np.ndarray:
    """[phrase, string] where the phrase's string also starts in another phrase of its bucket."""
    right, right_common = _order(buckets, [p[d : d + length] for p, d in zip(phrases, distance.tolist())], length)
    left, left_common = _order(buckets, [p[:d][::-1] for p, d in zip(phrases, distance.tolist())], length)
    found = np.zeros((len(phrases), int(strings.max(initial=1))), bool)
    for before in range(int(distance.max(initial=0)) + 1):  # bytes of the string before its trigger
        has = (before <= distance) & (before > distance - strings)
        if has.sum() < 2:
            continue
        classes = np.empty((2, len(phrases)), np.int64)
        classes[0, left] = np.cumsum(left_common < before)
        classes[1, right] = np.cumsum(right_common < length - before)
        rows = np.flatnonzero(has)
        both = classes[0, rows] * (len(phrases) + 1) + classes[1, rows]
        order = np.argsort(both, kind="stable")
        same = both[order[1:]] == both[order[:-1]]
        twice = np.zeros(len(rows), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        found[rows[twice], distance[rows[twice]] - before] = True
    return found


def _suffix_order(length: int):
    def spans(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rows)
        number = lambda name: table.column(name).to_numpy().astype(np.int64)
        low, strings = number("lo"), number("n")
        found = repeated_strings(number("trig"), table.column("bytes").to_pylist(), strings, number("dist"), length)
        found[~table.column("once").to_numpy().astype(bool)] = False
        edges = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
        row, start = np.nonzero(edges == 1)
        _, stop = np.nonzero(edges == -1)
        columns = [pa.array(number("rid")[row]), pa.array(low[row] + start), pa.array(low[row] + stop - 1)]
        return pa.RecordBatch.from_arrays(columns, names=["rid", "first", "last"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            count += batch.num_rows
            triggers = batch.column("trig").to_numpy()
            cut = int(np.searchsorted(triggers, triggers[-1]))  # the last bucket may go on
            if count >= 4000 and (cut or held[0].column("trig")[0].as_py() != triggers[-1]):
                whole = [*held[:-1], batch.slice(0, cut)]
                if not cut:  # the bucket began in earlier batches
                    earlier = pa.Table.from_batches(held[:-1]).combine_chunks().to_batches()[0]
                    begin = int(np.searchsorted(earlier.column("trig").to_numpy(), triggers[-1]))
                    whole, held = [earlier.slice(0, begin)], [b for b in (earlier.slice(begin), batch) if b.num_rows]
                else:
                    held = [batch.slice(cut)]
                count = sum(b.num_rows for b in held)
                yield spans([b for b in whole if b.num_rows])
        if held:
            yield spans(held)

    return run


# Corpus level


@dataclass
class RepeatedSpans:
    """``texts``: (rid, id, bytes[, payload]) bucketed by rid; ``spans``: (rid, first, last) of repeated strings."""

    texts: DataFrame
    spans: DataFrame
    length: int

    def _with_spans(self) -> DataFrame:
        per_row = self.spans.groupBy("rid").agg(F.collect_list(F.struct("first", "last")).alias("spans"))
        return self.texts.join(per_row.hint("shuffle_hash"), "rid", "left")

    def digests(self, id_col: str = "doc_id") -> DataFrame:
        """Per row: id, n_bytes, n_removed, n_spans, kept_sha256."""
        source = self._with_spans().select("id", "bytes", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
        id_type = self.texts.schema["id"].dataType
        schema = T.StructType([T.StructField(id_col, id_type), *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")], T.StructField("kept_sha256", T.StringType())])
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for text, first, last in zip(*(c.to_pylist() for c in batch.columns[1:])):
                    kept, removed, runs = cut(text, first, last, length)
                    out.append((len(text), removed, runs, hashlib.sha256(kept).hexdigest()))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
                columns = [batch.column(0), *[pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 4, kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

        return source.mapInArrow(run, schema)

    def kept_texts(self) -> DataFrame:
        """(payload, kept): the rows with what is left of their texts; a character cut in two goes whole."""
        source = self._with_spans().select("payload", "bytes", F.col("spans.first").alias("first"), F.col("spans.last").alias("last"))
        schema = T.StructType([T.StructField("payload", self.texts.schema["payload"].dataType), T.StructField("kept", T.StringType())])
        length = self.length

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                kept = [cut(*row, length)[0].decode("utf-8", "ignore") for row in zip(*(c.to_pylist() for c in batch.columns[1:]))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(kept, pa.string())], names=["payload", "kept"])

        return source.mapInArrow(run, schema)


def cut(text: bytes, first: list[int] | None, last: list[int] | None, length: int) -> tuple[bytes, int, int]:
    """(remaining bytes, bytes removed, maximal runs removed) for repeated strings that start at first..last."""
    if not first:
        return text, 0, 0
    kept, at, runs = [], 0, 0
    for start, stop in sorted(zip(first, last)):
        if start > at or not runs:
            kept.append(text[at:start])
            runs += 1
        at = max(at, stop + length)
    kept.append(text[at:])
    left = b"".join(kept)
    return left, len(text) - len(left), runs


def _stored_texts(df: DataFrame, id_col: str, text_col: str, payload: list[str] | None) -> DataFrame:
    """The texts, bucketed by row in an external table of the shared folder, whose name leaves the catalog again."""
    spark = bounded(df).sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    columns = [F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), text.alias("bytes")]
    if payload is not None:
        columns.append(F.struct(F.lit(True).alias(free_name(df)), *[F.col(f"`{c}`") for c in payload]).alias("payload"))
    name = f"docgraph_texts_{uuid.uuid4().hex}"
    writer = df.select(*columns).repartition(parts, "rid").write.format("parquet").option("compression", "zstd")
    writer.bucketBy(parts, "rid").option("path", new_path(spark, "texts")).saveAsTable(name)
    table = spark.table(name)
    table.schema  # noqa: B018 - resolved while the name is known; the files stay
    spark.sql(f"DROP TABLE {name}")
    return table


def repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, payload: list[str] | None = None) -> RepeatedSpans:
    """Where the texts of ``df`` hold strings of ``length`` bytes that start elsewhere too.

    Defined results: a null text counts as empty; a text shorter than ``length``
    keeps every byte; strings never cross texts; overlapping occurrences
    count, also within one text; repeated rows are repetitions; null ids are carried
    through; an empty table gives no rows; other columns are not read unless named
    in ``payload``.
    """
    texts = _stored_texts(df, id_col, text_col, payload)
    phrases = save(
        texts.select("rid", "bytes").mapInArrow(_phrases(length, secrets.token_bytes(32)), "rid long, trig long, digest long, lo long, n int, dist int"), "phrases"
    )
    known = save(phrases.where("trig IS NULL").select("rid", F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last")), "known-spans")
    parse = phrases.where("trig IS NOT NULL")
    dictionary = parse.groupBy("trig", "digest").agg(F.count("*").alias("times"), F.min("rid").alias("rep"))
    per_trigger = dictionary.groupBy("trig").agg(F.count("*").alias("distinct_phrases"), F.max("times").alias("most"))
    # Stored, so that the join has plain exchanges on both sides and a trigger of very many phrases may be split.
    per_trigger = save(per_trigger.where("distinct_phrases > 1 OR most > 1").drop("most"), "triggers")
    entries = save(dictionary.join(per_trigger, "trig"), "dictionary")

    seen = save(
        parse.join(entries, ["trig", "digest"]).select(
            "rid", "lo", "n", "dist", "trig", "distinct_phrases", (F.col("times") == 1).alias("once"), (F.col("rep") == F.col("rid")).alias("is_rep")
        ),
        "parse",
    )
    discard(phrases, per_trigger, entries)
    full = seen.where("not once").select("rid", F.col("lo").alias("first"), (F.col("lo") + F.col("n") - 1).alias("last"))
    open_phrases = seen.where("distinct_phrases > 1 AND is_rep").select("rid", "lo", "n", "dist", "trig", "once", (F.col("distinct_phrases") > HOT_BUCKET).alias("hot"))
    with_bytes = save(
        texts.select("rid", "bytes").join(open_phrases.hint("shuffle_hash"), "rid").select(
            "rid", "lo", "n", "dist", "trig", "once", "hot", F.expr(f"substring(bytes, int(lo) + 1, n + {length - 1})").alias("bytes")
        ),
        "open-phrases",
    )
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    small = with_bytes.where("not hot").drop("hot").repartition(parts, "trig").sortWithinPartitions("trig")
    spans = known.unionByName(full).unionByName(small.mapInArrow(_suffix_order(length), "rid long, first long, last long"))
    if not with_bytes.where("hot").isEmpty():
        strings = with_bytes.where("hot").select("rid", "once", "lo", "bytes", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("i"))
        strings = strings.select("rid", "once", (F.col("lo") + F.col("i")).alias("first"), F.expr(f"substring(bytes, i + 1, {length})").alias("string"))
        twice = strings.groupBy("string").agg(F.count("*").alias("times")).where("times > 1").select("string")
        spans = spans.unionByName(strings.where("once").join(twice, "string").select("rid", "first", F.col("first").alias("last")))
    spans = save(spans, "repeated-spans")
    discard(known, seen, with_bytes)
    return RepeatedSpans(texts, spans, length)


def remove_repeated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """``df`` with its repeated strings cut out of ``text_col``; every row stays, with every column, whatever its name.

    A null text becomes empty; repeated rows are repetitions and lose what they share; null ids are carried through;
    an empty table gives no rows.
    """
    others = [c for c in df.columns if c != text_col]
    kept = repeated_spans(df, id_col, text_col, length, payload=others).kept_texts()
    return kept.select(*[F.col("kept").alias(text_col) if c == text_col else F.col(f"payload.`{c}`").alias(c) for c in df.columns])
