"""Greedy, order-dependent cuts of a document stream into batches and parts, found in parallel.

Both rules reset when they cut, so a running sum cannot express them.  The rows are stored once in ranges of their order, and each range
is summed up by what it does to an open batch: an open batch of b bytes and d documents is first cut at some row near the
range's start, and from a fresh start at a row everything up to the range's end follows, so a range is a table of its possible first
cuts with the state it ends in and the number of cuts.  Tables of ``FAN`` neighbours compose to one of the same kind, level by level,
until few are left; then the true states go back down the same levels, and every range labels its own rows.  No task
holds more than one range's lengths or ``FAN`` tables of at most a batch's rows each.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..options import check_batching
from ..scratch import discard, stored

MAX_BYTES = 4 << 20
MAX_DOCS = 100_000
IN_FLIGHT_BYTES = 256 << 20
PART_BYTES = 64 << 20
FAN = 32
_NO_LIMIT = 1 << 62


@dataclass(frozen=True)
class Rule:
    """When a row starts anew: ``before`` it would overflow the limit (batches), or once what is open has reached it (parts)."""

    limit: int
    max_docs: int
    framing: int  # bytes that a fresh start opens with
    before: bool

    def marks(self, sums: np.ndarray) -> np.ndarray:
        """What is compared with the limit at each row, of the sums before each row and after the last."""
        return sums[1:] if self.before else sums[:-1]

    def first(self, marks: np.ndarray, docs: np.ndarray, size: np.ndarray, open_docs: np.ndarray) -> np.ndarray:
        """The first row that starts anew where ``size`` bytes of ``open_docs`` documents are open; one alone is never cut."""
        at = np.searchsorted(marks, self.limit - size, "right" if self.before else "left")
        at = np.minimum(at, np.searchsorted(docs, self.max_docs - open_docs, "left"))
        return np.maximum(at, np.searchsorted(docs, 1 - open_docs, "left"))


def import_batches(max_bytes: int, max_docs: int) -> Rule:
    """Cuts before a batch would overflow; an oversized document travels alone."""
    return Rule(max_bytes, max_docs, 0, True)


def export_parts(threshold: int, framing: int = 0) -> Rule:
    """Cuts after a part has reached its size; ``framing`` is what a part opens with."""
    return Rule(max(1, threshold), _NO_LIMIT, framing, False)


@dataclass
class Summary:
    """What a run of rows does to an open batch.  The entries are the rows that may be cut first."""

    docs: int
    size: int
    forced: bool  # the last entry is cut in any case: a stream begins there
    marks: np.ndarray
    before: np.ndarray  # documents before each entry
    end_size: np.ndarray  # open at the end of the run, after a cut at the entry
    end_docs: np.ndarray
    cuts: np.ndarray

    def through(self, rule: Rule, size: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(bytes open, documents open, cuts made) after the run, for each of many open batches before it."""
        at = rule.first(self.marks, self.before, size, docs)
        if self.forced:
            at = np.minimum(at, len(self.marks) - 1)
        cut = at < len(self.marks)
        at = np.where(cut, at, 0)
        pick = lambda values, other: np.where(cut, values[at], other) if len(values) else other + np.zeros(len(at), np.int64)
        return pick(self.end_size, size + self.size), pick(self.end_docs, docs + self.docs), pick(self.cuts, 0)


def _following(rule: Rule, lengths: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of bytes, for each row the row that starts anew after a fresh start at it; the number of rows if none does)."""
    rows = np.arange(len(lengths))
    sums = np.append(0, np.cumsum(lengths + 1))
    after = rule.first(rule.marks(sums), rows, rule.framing - sums[:-1], -rows)
    forced = np.append(np.flatnonzero(starts), len(rows))
    return sums, np.minimum(after, forced[np.searchsorted(forced, rows, "right")])


def summarise(rule: Rule, lengths: np.ndarray, starts: np.ndarray) -> Summary:
    n = len(lengths)
    sums, jump = _following(rule, lengths, starts)
    jump, cuts, last = np.append(jump, n), np.append(np.ones(n, np.int64), 0), np.append(np.arange(n), n)
    while (jump < n).any():
        cuts, last, jump = cuts + cuts[jump], np.where(jump < n, last[jump], last), jump[jump]
    fresh = int(rule.first(rule.marks(sums), np.arange(n), np.array([rule.framing]), np.array([0]))[0])
    forced = int(np.argmax(starts)) if starts.any() else n
    entries = min(n, fresh + 1, forced + 1)
    last = last[:entries]
    return Summary(n, int(sums[-1]), forced < entries, rule.marks(sums)[:entries], np.arange(entries), rule.framing + sums[-1] - sums[last], n - last, cuts[:entries])


def compose(rule: Rule, runs: list[Summary]) -> Summary:
    docs = size = 0
    open_, forced, columns = True, False, []
    for k, run in enumerate(runs):
        if open_ and len(run.marks):
            entries = int(rule.first(run.marks, run.before, np.array([rule.framing + size]), np.array([docs]))[0]) + 1
            entries = min(entries, len(run.marks))
            end_size, end_docs, cuts = (x[:entries] for x in (run.end_size, run.end_docs, run.cuts))
            for later in runs[k + 1 :]:
                end_size, end_docs, more = later.through(rule, end_size, end_docs)
                cuts = cuts + more
            columns.append((run.marks[:entries] + size, run.before[:entries] + docs, end_size, end_docs, cuts))
            forced = run.forced and entries == len(run.marks)
            _, _, made = run.through(rule, np.array([rule.framing + size]), np.array([docs]))
            open_ = not made[0]
        docs, size = docs + run.docs, size + run.size
    joined = [np.concatenate(c) for c in zip(*columns)] if columns else [np.zeros(0, np.int64)] * 5
    return Summary(docs, size, forced, *joined)


_ARRAYS = ("marks", "before", "end_size", "end_docs", "cuts")
_SUMMARY = "node long, docs long, size long, forced boolean, " + ", ".join(f"{n} array<long>" for n in _ARRAYS)
_SUMMARY_ARROW = pa.schema([("node", pa.int64()), ("docs", pa.int64()), ("size", pa.int64()), ("forced", pa.bool_()), *((n, pa.list_(pa.int64())) for n in _ARRAYS)])
_STATE = pa.schema([("node", pa.int64()), ("size", pa.int64()), ("docs", pa.int64()), ("cuts", pa.int64())])
_STATES = "node long, size long, docs long, cuts long"


def _row(node: int, s: Summary) -> pa.Table:
    columns = [[node], [s.docs], [s.size], [s.forced], *([getattr(s, n)] for n in _ARRAYS)]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SUMMARY_ARROW)], schema=_SUMMARY_ARROW)


def _summaries(table: pa.Table) -> list[tuple[int, Summary]]:
    found = []
    for r in table.sort_by("node").to_batches():
        for k in range(r.num_rows):
            arrays = [r[n][k].values.to_numpy(zero_copy_only=False).astype(np.int64) for n in _ARRAYS]
            found.append((r["node"][k].as_py(), Summary(r["docs"][k].as_py(), r["size"][k].as_py(), r["forced"][k].as_py(), *arrays)))
    return found


def _leaf(rule: Rule):
    def run(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("__place")
        return _row(key[0].as_py(), summarise(rule, rows["__length"].to_numpy(), rows["__start"].to_numpy()))

    return run


def _parent(rule: Rule):
    def run(key: tuple, nodes: pa.Table) -> pa.Table:
        return _row(key[0].as_py(), compose(rule, [s for _, s in _summaries(nodes)]))

    return run


def _down(rule: Rule):
    """The states in which the children of a node begin, from the state in which it begins itself."""

    def run(key: tuple, nodes: pa.Table, state: pa.Table) -> pa.Table:
        if not nodes.num_rows:
            return _STATE.empty_table()
        size, docs, cuts = (np.array([state[n][0].as_py()]) for n in ("size", "docs", "cuts"))
        out = []
        for node, summary in _summaries(nodes):
            out.append((node, int(size[0]), int(docs[0]), int(cuts[0])))
            size, docs, made = summary.through(rule, size, docs)
            cuts = cuts + made
        return pa.Table.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], schema=_STATE)

    return run


def _label(rule: Rule):
    def run(key: tuple, rows: pa.Table, state: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.schema([(c, pa.int64()) for c in ("__range", "__place", "__label")]).empty_table()
        rows = rows.sort_by("__place")
        starts = rows["__start"].to_numpy()
        sums, after = _following(rule, rows["__length"].to_numpy(), starts)
        size, docs, cuts = (state[n][0].as_py() for n in ("size", "docs", "cuts"))
        n = rows.num_rows
        at = int(rule.first(rule.marks(sums), np.arange(n), np.array([size]), np.array([docs]))[0])
        at = min(at, int(np.argmax(starts)) if starts.any() else n)
        places = []
        while at < n:
            places.append(at)
            at = int(after[at])
        labels = cuts + np.searchsorted(np.array(places, np.int64), np.arange(n), "right")
        return pa.table({"__range": rows["__range"], "__place": rows["__place"], "__label": pa.array(labels, pa.int64())})

    return run


def ranged(df: DataFrame, order: list[str]) -> DataFrame:
    """``df`` stored in its order, once, with ``__range`` and ``__place`` in it: both are the same for every later read."""
    parts = df.repartitionByRange(*[F.col(f"`{c}`") for c in order]).sortWithinPartitions(*[F.col(f"`{c}`") for c in order])
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return stored(parts.withColumn("__range", F.spark_partition_id().cast("long")).withColumn("__place", place), "ranges")


def _labels(rows: DataFrame, rule: Rule, first: int) -> DataFrame:
    """(__range, __place, __label) of ``rows`` (the same, __length, __start); labels count cuts from ``first``."""
    levels = [stored(rows.groupBy("__range").applyInArrow(_leaf(rule), _SUMMARY), "cuts")]
    while levels[-1].count() > FAN:
        levels.append(stored(levels[-1].groupBy(F.expr(f"node div {FAN}").alias("parent")).applyInArrow(_parent(rule), _SUMMARY), "cuts"))
    states = rows.sparkSession.createDataFrame([(0, rule.framing, 0, first)], _STATES)
    top = True
    for level in reversed(levels):
        parent = F.lit(0).cast("long") if top else F.expr(f"node div {FAN}")
        below = level.withColumn("parent", parent).groupBy("parent").cogroup(states.withColumnRenamed("node", "above").groupBy("above"))
        states, top = stored(below.applyInArrow(_down(rule), _STATES), "states"), False
    labels = stored(rows.groupBy("__range").cogroup(states.groupBy("node")).applyInArrow(_label(rule), "__range long, __place long, __label long"), "labels")
    discard(*levels, states)
    return labels


def _assign(df: DataFrame, order: str | list[str], stream: str | None, name: str, rule: Rule, first: int) -> DataFrame:
    orders = [order] if isinstance(order, str) else list(order)
    rows = ranged(df, [stream, *orders] if stream else orders)
    length = F.coalesce(F.octet_length("doc"), F.lit(0)).cast("long").alias("__length")
    if not stream:
        labels = _labels(rows.select("__range", "__place", length, F.lit(False).alias("__start")), rule, first)
        return rows.join(labels, ["__range", "__place"]).withColumnRenamed("__label", name).drop("__range", "__place")
    heads = rows.groupBy(F.col(f"`{stream}`").alias("__stream")).agg(F.min(F.struct("__range", "__place")).alias("__head"))
    heads = heads.select(F.col("__head.__range").alias("__range"), F.col("__head.__place").alias("__place"), F.lit(True).alias("__start"))
    marked = stored(rows.select("__range", "__place", length).join(heads, ["__range", "__place"], "left").withColumn("__start", F.coalesce("__start", F.lit(False))), "lengths")
    labels = _labels(marked, rule, first - 1)
    begins = rows.select("__range", "__place", F.col(f"`{stream}`").alias("__stream")).join(labels, ["__range", "__place"])
    begins = begins.groupBy("__stream").agg(F.min("__label").alias("__least"))
    labelled = rows.join(labels, ["__range", "__place"]).join(begins, F.col(f"`{stream}`").eqNullSafe(F.col("__stream")))
    return labelled.withColumn(name, F.col("__label") - F.col("__least") + F.lit(first)).drop("__range", "__place", "__label", "__stream", "__least")


def assign_batches(df: DataFrame, order: str | list[str] = "ordinal", max_bytes: int = MAX_BYTES, max_docs: int = MAX_DOCS, stream: str | None = None) -> DataFrame:
    """Adds ``batch_index``, from 1, to rows (doc, order, ...); with ``stream``, each value of that column is cut by itself.

    Rows of equal order come in some fixed order; a null document counts as empty.
    """
    check_batching(max_bytes, max(max_bytes, IN_FLIGHT_BYTES), 1)
    return _assign(df, order, stream, "batch_index", import_batches(max_bytes, max_docs), 1)


def assign_parts(df: DataFrame, order: str | list[str] = "ordinal", part_bytes: int = PART_BYTES, framing: int = 0, stream: str | None = None) -> DataFrame:
    """Adds ``part``, from 0; ``framing`` counts the bytes that open a part, such as a CSV header."""
    return _assign(df, order, stream, "part", export_parts(part_bytes, framing), 0)


def docs_only_batches(df: DataFrame, order: str = "ordinal", max_docs: int = MAX_DOCS) -> DataFrame:
    """``batch_index`` where only the number of documents limits a batch: a rank, from the sizes of stored ranges."""
    rows = ranged(df, [order])
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each range
    starts = rows.groupBy("__range").agg(F.count("*").alias("__n")).select("__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__begin"))
    index = (F.floor((F.col("__begin") + F.col("__place")) / max_docs) + 1).cast("long")
    return rows.join(starts, "__range").withColumn("batch_index", index).drop("__range", "__place", "__begin")


def skip_committed(df: DataFrame, committed_batches: int) -> DataFrame:
    return df.where(F.col("batch_index") > committed_batches)
