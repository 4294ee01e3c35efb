"""Phrase collocation mining with word-id suffix arrays.

Each task packs its texts into shards of one language and a bounded size: the word list, and the word ids with a zero after
each piece.  A shard's suffixes are ordered by numpy prefix doubling (one word, two, four), the words that
neighbours share give the LCP array, and the suffixes between two falls of the LCP below n are one n-gram, so
an interval's length is its count.  Counts of one and two words are merged by key; a shard is then told which of its own
word pairs reach the floor, and counts three and four words only where every pair in them does, as a phrase is never more
frequent than its parts.  What is told is joined by key, shard by shard, never broadcast.

Splitting, scores and containment are joins of the frequent phrases with themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_rows, bounded, discard, save

LONGEST = 4
FLOOR = 30
TOP = 2000
CONTAINED_PERCENT = 80
SCORE_UNIT = 2_000_000
SHARD_BYTES = 16 << 20
SHARDS_HELD = 4  # in one Arrow batch
# What ends a piece, and what ends a word besides.
PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_PLAIN = bytes(10 if c in PIECE_ENDS else c + 32 if 65 <= c <= 90 else c for c in range(256))


class Words(dict):
    """Ids from 1 in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self) + 1
        return number


def word_ids(text: bytes, words: Words) -> list[int]:
    """The ids of the words of ``text``, with a 0 after each piece that has any."""
    ids: list[int] = []
    for piece in text.translate(_PLAIN).split(b"\n"):
        found = piece.split()
        if found:
            ids.extend(map(words.__getitem__, found))
            ids.append(0)
    return ids


def _ranks(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order, dense rank of each position) of pairs of ranks."""
    key = first.astype(np.int64) << 32 | second
    order = np.argsort(key, kind="stable")
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(len(key), np.int64)
    rank[order] = np.cumsum(new) - 1
    return order, rank


def _ahead(values: np.ndarray, by: int) -> np.ndarray:
    return np.concatenate([values[by:], np.zeros(min(by, len(values)), values.dtype)])


def doubled(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(suffixes ordered by two words, rank by two words, words to the end of the piece capped at ``LONGEST``)."""
    left = np.zeros(len(ids), np.int8)
    alive = np.ones(len(ids), bool)
    for by in range(LONGEST):
        alive &= _ahead(ids, by) != 0
        left += alive
    order, rank = _ranks(ids, np.where(left > 1, _ahead(ids, 1), 0))
    return order, rank, left


def common_words(ids: np.ndarray, order: np.ndarray, left: np.ndarray, depth: int) -> np.ndarray:
    """The LCP array to ``depth`` words: how many each suffix shares with the one before it in the order."""
    lcp = np.zeros(len(order), np.int8)
    if len(order) > 1:
        a, b = order[:-1], order[1:]
        same = np.ones(len(a), bool)
        for by in range(depth):
            same &= (left[a] > by) & (left[b] > by)
            same[same] = ids[a[same] + by] == ids[b[same] + by]
            lcp[1:] += same
    return lcp


def intervals(lcp: np.ndarray, length: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(first place, size) of each LCP interval of ``words`` words; ``length`` is each suffix's own, in order."""
    places = np.flatnonzero(length >= words)  # suffixes that share an n-gram are neighbours, and all have its length
    heads = np.flatnonzero(lcp[places] < words)
    return places[heads], np.diff(np.append(heads, len(places)))


_KEYED = pa.schema([("key", pa.string()), ("shard", pa.int64()), ("place", pa.int32()), ("a", pa.int64())])
_COUNTED = "key string, shard long, place int, a long"
_SHARD = pa.schema([("shard", pa.int64()), ("lang", pa.string()), ("n", pa.int64()), ("vocabulary", pa.list_(pa.binary())), ("ids", pa.binary())])
_SHARDS = "shard long, lang string, n long, vocabulary array<binary>, ids binary"


def _counts(shard: int, lang: str, words: pa.Array, ids: np.ndarray, starts: np.ndarray, counts: np.ndarray, length: int) -> Iterator[pa.RecordBatch]:
    """A row for each interval of ``length`` words: the phrase, a line end (which no phrase has) and the language; the
    interval's number in the shard's order; its size."""
    ending, space, newline = pa.scalar(lang.encode()), pa.scalar(b" "), pa.scalar(b"\n")
    for at in range(0, len(starts), 1 << 16):
        some = starts[at : at + (1 << 16)]
        taken = [words.take(pa.array(ids[some + k] - 1)) for k in range(length)]
        phrase = taken[0] if length == 1 else pc.binary_join_element_wise(*taken, space)
        key = pc.binary_join_element_wise(phrase, ending, newline).cast(pa.string())
        columns = [key, pa.array(np.full(len(some), shard)), pa.array(np.arange(at, at + len(some), dtype=np.int32)), pa.array(counts[at : at + len(some)].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(columns, schema=_KEYED)


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    part, count, size = TaskContext.get().partitionId(), 0, 0
    open_: dict[str, tuple[Words, list[np.ndarray]]] = {}

    def close() -> Iterator[pa.RecordBatch]:
        nonlocal count, size
        for lang, (words, parts) in open_.items():
            ids = np.concatenate(parts)
            columns = [[(part << 32) + count], [lang], [int(np.count_nonzero(ids))], [list(words)], [ids.tobytes()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SHARD)], schema=_SHARD)
            count += 1
        open_.clear()
        size = 0

    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
            words, parts = open_.setdefault(lang, (Words(), []))
            parts.append(np.array(word_ids(text, words), np.int32))
            size += len(text)
            if size >= SHARD_BYTES:
                yield from close()
    yield from close()


def _short_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of one and two words of each shard."""
    for batch in batches:
        for k in range(batch.num_rows):
            shard, lang, words, ids = batch["shard"][k].as_py(), batch["lang"][k].as_py(), batch["vocabulary"][k].values, np.frombuffer(batch["ids"][k].as_py(), np.int32)
            order, _, left = doubled(ids)
            lcp = common_words(ids, order, left, 2)
            for length in (1, 2):
                heads, counts = intervals(lcp, left[order], length)
                yield from _counts(shard, lang, words, ids, order[heads], counts, length)


def _long_counts(key: tuple, shards: pa.Table, told: pa.Table) -> pa.Table:
    """Counts of three and four words of a shard, where every pair is one of those ``told`` by place."""
    if not (shards.num_rows and told.num_rows):
        return _KEYED.empty_table()
    row = shards.combine_chunks()
    ids = np.frombuffer(row["ids"][0].as_py(), np.int32)
    order, rank, left = doubled(ids)
    heads, counts = intervals(common_words(ids, order, left, 2), left[order], 2)
    frequent = np.zeros(len(heads), bool)
    frequent[told["place"].to_numpy()] = True
    pair = np.zeros(len(ids), bool)
    pair[order[left[order] >= 2]] = np.repeat(frequent, counts)
    three = pair & _ahead(pair, 1)
    four = three & _ahead(pair, 2)
    at = np.flatnonzero(three)
    order = at[_ranks(rank[at], rank[at + 2])[0]]
    lcp = common_words(ids, order, left, LONGEST)
    out = []
    for length in (3, 4):
        heads, counts = intervals(lcp, left[order], length)
        if length == 4:
            whole = four[order[heads]]
            heads, counts = heads[whole], counts[whole]
        out += _counts(row["shard"][0].as_py(), row["lang"][0].as_py(), row["vocabulary"][0].values, ids, order[heads], counts, length)
    return pa.Table.from_batches(out, _KEYED)


def phrase_counts(df: DataFrame, lang_col: str = "lang", text_col: str = "text", floor: int = FLOOR) -> tuple[DataFrame, DataFrame]:
    """(lang, words, phrase, a) of all phrases of one to four words met ``floor`` times or more, and (lang, n) of every language."""
    source = df.select(F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    shards = save(bounded(source).mapInArrow(_shards, _SHARDS), "phrase-shards")
    totals = save(shards.groupBy("lang").agg(F.sum("n").alias("n")), "phrase-totals")
    # One exchange tells a phrase's total to every shard that has it, which is at most a row of each shard.
    everywhere = F.sum("a").over(Window.partitionBy("key"))
    with arrow_rows(df.sparkSession, SHARDS_HELD):
        counted = shards.mapInArrow(_short_counts, _COUNTED).withColumn("total", everywhere)
        kept = save(counted.where(F.col("total") >= floor).select("key", "shard", "place", "total"), "phrase-kept")
    short = kept.groupBy("key").agg(F.first("total").alias("a"))
    told = kept.where(F.instr("key", " ") > 0).where(F.instr("key", " ") < F.instr("key", "\n")).select(F.col("shard").alias("of"), "place")
    longer = shards.groupBy("shard").cogroup(told.groupBy("of")).applyInArrow(_long_counts, _COUNTED)
    long = longer.groupBy("key").agg(F.sum("a").alias("a")).where(F.col("a") >= floor)
    phrase = F.substring_index("key", "\n", 1)
    named = short.unionByName(long).select(F.expr("substring(key, instr(key, '\n') + 1)").alias("lang"), phrase.alias("phrase"), "a")
    frequent = save(named.select("lang", (F.size(F.split("phrase", " ", -1))).alias("words"), "phrase", "a"), "phrases")
    discard(shards, kept)
    return frequent, totals


def _part(start, length) -> F.Column:
    return F.array_join(F.slice("w", start, length), " ")


def collocations(
    df: DataFrame, lang_col: str = "lang", text_col: str = "text", floor: int = FLOOR, top: int = TOP, contained_percent: int = CONTAINED_PERCENT
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``top`` phrases of two to four words of each language.

    A phrase met ``floor`` times scores by its worst cut.  One whose words lie in a longer candidate that is met at least ``contained_percent``
    as often is left out.

    Defined results: a null text counts as empty, a null language as ``und``; texts without words count nothing;
    repeated rows count each; phrases end with their piece and their text; ties go to the more frequent and then to the
    lesser phrase in byte order; an empty table gives no rows; other columns are not read.
    """
    frequent, totals = phrase_counts(df, lang_col, text_col, floor)
    candidates = frequent.where("words > 1").withColumn("w", F.split("phrase", " ", -1))
    big = "decimal(38,0)"

    cuts = candidates.select("lang", "phrase", "w", "words", "a", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", _part(1, F.col("k")).alias("first"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    known = frequent.select("lang", "phrase", "a")
    scored = cuts.join(known.toDF("lang", "first", "l"), ["lang", "first"]).join(known.toDF("lang", "rest", "r"), ["lang", "rest"])
    score = F.expr(f"CAST({SCORE_UNIT} AS {big}) * CAST(a AS decimal(19,0)) div (CAST(l AS {big}) + CAST(r AS {big}))")
    worst = scored.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    longer = candidates.where("words > 2").select("lang", "w", "words", "a", F.explode(F.sequence(F.lit(2), F.col("words") - 1)).alias("length"))
    longer = longer.select("lang", "w", "a", "length", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("length") + 1)).alias("start"))
    inner = longer.groupBy("lang", _part(F.col("start"), F.col("length")).alias("phrase")).agg(F.max("a").alias("outer"))
    free = worst.join(inner, ["lang", "phrase"], "left").where(
        F.col("outer").isNull() | (F.col("outer").cast(big) * 100 < F.col("a").cast(big) * contained_percent)
    )
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase"))
    best = free.withColumn("rank", place).where(F.col("rank") <= top).join(totals, "lang")
    return best.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))
