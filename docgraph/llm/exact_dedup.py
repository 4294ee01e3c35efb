"""Exact dedup by distributed most-significant-byte-first radix partitioning.

Texts are equal when they are identical after every character of
``[\\x20\\x09-\\x0D]`` is deleted.  Documents are split by successive runs of
bytes (64, 256, 1024, ... bytes, each four times the last) until a group is a
singleton or its bytes have ended.  Groups are compared by their bytes; no
digest decides equality.

* Each Arrow batch first collapses its own equal texts into one representative
  (a local sort), so a text that makes up a third of the corpus reaches the
  shuffle once per batch and not once per row.
* A radix level is a partial aggregation on (group, next bytes), stored, and a
  join back of the groups of two or more.  Both sides of a join are stored tables, so
  adaptive execution may split a hot prefix or a hot text over many tasks.  What grows with the
  corpus is merged and not broadcast, at any size.
* Every level is written to the shared folder; a lost executor costs one level.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import discard, free_name, number_rows, save

WHITESPACE = b" \t\n\x0b\x0c\r"
FIRST_WIDTH = 64
WIDTH_FACTOR = 4


def _collapse(numbered: bool):
    """Per batch: one row for each distinct normalised text, with its members and its best row.

    Rows carry their numbers (``numbered``), or are numbered by task and place.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        number = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, texts = batch.column(0), pc.fill_null(batch.column(1), "")
            points = pc.utf8_length(texts).to_pylist()
            norm = [b.translate(None, WHITESPACE) for b in texts.cast(pa.binary()).to_pylist()]
            known = ids.to_pylist()
            numbers = batch.column(2).to_pylist() if numbered else range(number, number + len(norm))
            order = sorted(range(len(norm)), key=norm.__getitem__)
            starts, best = [], []
            for place, i in enumerate(order):
                if place and norm[i] == norm[order[place - 1]]:
                    j = best[-1]
                    if _rank(points[i], known[i], i) < _rank(points[j], known[j], j):
                        best[-1] = i
                else:
                    starts.append(place)
                    best.append(i)
            offsets = pa.array([*starts, len(order)], pa.int32())
            rows = pa.array([numbers[i] for i in order], pa.int64())
            members = pa.StructArray.from_arrays([ids.take(pa.array(order)), rows], ["id", "row"])
            at = pa.array(best, pa.int64())
            sizes = [b - a for a, b in zip(starts, [*starts[1:], len(order)])]
            columns = [
                pa.array([numbers[i] for i in best], pa.int64()),
                pa.array([norm[i] for i in best], pa.binary()),
                pa.array([points[i] for i in best], pa.int64()),
                ids.take(at),
                pa.array(sizes, pa.int64()),
                pa.array([hashlib.sha256(norm[i]).hexdigest() for i in best], pa.string()),
                pa.ListArray.from_arrays(offsets, members),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["rid", "rest", "points", "id", "size", "sha", "members"])
            number += len(order)

    return run


def _rank(points: int, key, row: int) -> tuple:
    return (-points, key is None, key if key is not None else 0, row)


@dataclass
class ExactGroups:
    """``representatives``: one row per batch and text; ``classes``: (rid, cls) where two or more meet."""

    representatives: DataFrame
    classes: DataFrame

    def _with_class(self) -> DataFrame:
        return self.representatives.join(self.classes.hint("merge"), "rid", "left").withColumn("cls", F.coalesce("cls", "rid"))

    def _best(self, reps: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("points")).alias("p"), F.col("id").isNull().alias("n"), F.col("id").alias("id"), F.col("rid").alias("row")))
        return reps.groupBy("cls").agg(best.alias("best"), F.sum("size").alias("group_size"))

    def assignments(self, id_col: str = "doc_id") -> DataFrame:
        """One row per input row: id, keep_id, group_size, kept, text_sha256."""
        reps = self._with_class().select("cls", "rid", "points", "id", "size", "sha", "members")
        best = save(self._best(reps), "exact-best")
        joined = reps.join(best.hint("merge"), "cls").select("best", "group_size", "sha", F.explode("members").alias("m"))
        return joined.select(
            F.col("m.id").alias(id_col), F.col("best.id").alias("keep_id"), "group_size",
            (F.col("m.row") == F.col("best.row")).alias("kept"), F.col("sha").alias("text_sha256"),
        )

    def kept_rows(self) -> DataFrame:
        """(row): the number of the row that stays, of each group."""
        return self._best(self._with_class().select("cls", "rid", "points", "id", "size")).select(F.col("best.row").alias("row"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The kept rows themselves, with every column of ``df``, whatever its name; see ``exact_groups``."""
    row = free_name(df)
    numbered = number_rows(df, "exact-rows", row)
    groups = exact_groups(numbered, id_col, text_col, row_col=row)
    kept = save(groups.kept_rows().withColumnRenamed("row", row), "exact-kept")
    discard(groups.representatives, groups.classes)
    return numbered.join(kept.hint("merge"), row, "left_semi").drop(row)


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> ExactGroups:
    """Group the rows of ``df`` by their normalised text.

    Defined results: a null text counts as empty, and all empty texts form one
    group; of a group, the row with most code points in the original text,
    then the smallest id (null ids last), then the earliest row stays; repeated
    rows are rows of their own and only one of them is kept; an empty table gives an
    empty result; other columns are not read.  ``row_col`` names unique row numbers, if
    there are any.
    """
    id_type = df.schema[id_col].dataType
    cols = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")]
    if row_col:
        cols.append(F.col(row_col).alias("row"))
    source = df.select(*cols)
    fields = [
        T.StructField("rid", T.LongType()), T.StructField("rest", T.BinaryType()), T.StructField("points", T.LongType()),
        T.StructField("id", id_type), T.StructField("size", T.LongType()), T.StructField("sha", T.StringType()),
        T.StructField("members", T.ArrayType(T.StructType([T.StructField("id", id_type), T.StructField("row", T.LongType())]))),
    ]
    reps = save(source.mapInArrow(_collapse(row_col is not None), T.StructType(fields)), "exact-reps")

    active = reps.select("rid", F.lit(0).cast("long").alias("grp"), "rest")
    width, levels = FIRST_WIDTH, []
    while True:
        levels.append(_split(active, width))
        active = levels[-1].where("not done").select("rid", "grp", "rest")
        if active.isEmpty():
            break
        width *= WIDTH_FACTOR
    ended = [level.where("done").select("rid", F.col("grp").alias("cls")) for level in levels]
    classes = save(reduce(DataFrame.unionByName, ended), "exact-classes")
    discard(*levels)
    return ExactGroups(reps, classes)


def _split(active: DataFrame, width: int) -> DataFrame:
    """One radix level: rows whose (group, next bytes) occur again, with their new group and remaining bytes."""
    digits = active.select(
        "rid", "grp", F.substring("rest", 1, width).alias("digit"),
        F.expr(f"substring(rest, {width + 1})").alias("rest"), (F.octet_length("rest") < width).alias("done"),
    )
    again = digits.groupBy("grp", "digit").agg(F.count("*").alias("n"), F.min("rid").alias("first")).where("n > 1").drop("n")
    again = save(again, f"exact-again-{width}")
    split = digits.join(again.hint("merge"), ["grp", "digit"]).select(
        "rid", F.col("first").alias("grp"), F.when(~F.col("done"), F.col("rest")).alias("rest"), "done"
    )
    level = save(split, f"exact-level-{width}")
    discard(again)
    return level
