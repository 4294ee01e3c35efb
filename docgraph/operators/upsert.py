"""Loading rows into a keyed collection: what a duplicate key does, and what a load leaves behind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from ..functions.cells import json_string
from ..functions.members import exploded_members

MODES = ("error", "ignore", "replace", "update")


def _ranked(df: DataFrame, key: list[str], order: list[str], last: bool) -> DataFrame:
    """The first (or last) row of each key; an aggregation, so that a key with very many rows is combined map-side."""
    fields = [F.col(c) for c in order] + [F.col(c) for c in df.columns if c not in order]
    pick = (F.max if last else F.min)(F.struct(*fields)).alias("__row")
    return df.groupBy(*key).agg(pick).select(*[F.col(f"__row.{c}").alias(c) for c in df.columns])


def first_of_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, key, order, last=False)


def last_of_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    return _ranked(df, key, order, last=True)


def patch_of_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Each attribute's last value that is present, in ``order``."""
    at = F.struct(*order)
    attributes = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(*[F.max_by(F.col(c), F.when(F.col(c).isNotNull(), at)).alias(c) for c in attributes])


def upsert(stored: DataFrame, incoming: DataFrame, key: list[str], order: list[str], mode: str = "error") -> DataFrame:
    """The collection after the load.  ``order`` must order the incoming rows of a key totally.

    error and ignore keep stored rows and the first of new keys; replace takes the
    last incoming row; update patches attribute by attribute (shallow).
    """
    if mode not in MODES:
        raise ValueError(f"unknown duplicate mode '{mode}'; known: {', '.join(MODES)}")
    incoming = incoming.select(*stored.columns, *[c for c in order if c not in stored.columns])
    if mode in ("error", "ignore"):
        new = first_of_key(incoming.join(stored.select(*key), key, "left_anti"), key, order)
        return stored.unionByName(new.select(*stored.columns))
    if mode == "replace":
        new = last_of_key(incoming, key, order).select(*stored.columns)
        return stored.join(new, key, "left_anti").unionByName(new)
    patch = patch_of_key(incoming, key, order)
    attributes = [c for c in stored.columns if c not in key]
    joined = stored.alias("s").join(patch.alias("p"), key, "full")
    return joined.select(*key, *[F.coalesce(F.col(f"p.{c}"), F.col(f"s.{c}")).alias(c) for c in attributes]).select(*stored.columns)


def patched_keys(stored: DataFrame, incoming: DataFrame, order: list[str]) -> DataFrame:
    """The documents (``_key``, ``doc``, and ends for edges) of all incoming keys, patched attribute by attribute.

    Of every attribute the last incoming value holds, an explicit null too; attributes that no incoming row has stay.
    Documents are taken apart into raw members, so a key with very many rows is combined map-side, member by member.
    """
    ends = [c for c in stored.columns if c not in ("_key", "doc")]
    patch = incoming.select("_key", "doc", F.struct(F.lit(1).alias("late"), *order).alias("at"), *ends)
    met = stored.join(patch.select("_key").distinct(), "_key", "left_semi")
    no_order = F.lit(None).cast(patch.schema["at"].dataType)
    base = met.select("_key", "doc", no_order.alias("at"), *ends)  # null comes before every order
    every = base.unionByName(patch)
    first = F.struct(F.coalesce(F.col("at.late"), F.lit(0)).alias("late"), F.col("at"), F.col("position"))
    members = exploded_members(every.select("_key", "at", "doc")).groupBy("_key", "name").agg(
        F.max_by("value", F.struct(F.coalesce(F.col("at.late"), F.lit(0)).alias("late"), "at")).alias("value"), F.min(first).alias("first")
    )
    text = F.concat(json_string(F.col("name")), F.lit(":"), F.col("value"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("first", text.alias("text")))), lambda m: m["text"])
    docs = members.groupBy("_key").agg(F.concat(F.lit("{"), F.array_join(listed, ","), F.lit("}")).alias("doc"))
    late = F.struct(F.coalesce(F.col("at.late"), F.lit(0)).alias("late"), "at")
    keys = every.groupBy("_key").agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), late)).alias(c) for c in ends]) if ends else every.select("_key").distinct()
    return keys.join(docs, "_key", "left").withColumn("doc", F.coalesce("doc", F.lit("{}"))).select(*stored.columns)


def load_counts(stored: DataFrame, incoming: DataFrame, key: list[str], mode: str) -> DataFrame:
    """One row: created, updated, ignored, errors of a load, without running it."""
    counts = incoming.groupBy(*key).agg(F.count("*").alias("n"))
    flagged = counts.join(stored.select(*key, F.lit(True).alias("old")), key, "left").select("n", F.coalesce("old", F.lit(False)).alias("old"))
    created = F.count_if(~F.col("old"))
    repeats = F.coalesce(F.sum(F.col("n") - F.when(F.col("old"), 0).otherwise(1)), F.lit(0))
    zero = F.lit(0).cast("long")
    return flagged.agg(
        created.alias("created"),
        (repeats if mode in ("replace", "update") else zero).alias("updated"),
        (repeats if mode == "ignore" else zero).alias("ignored"),
        (repeats if mode == "error" else zero).alias("errors"),
    )


def contiguous_prefix(committed: DataFrame) -> DataFrame:
    """One row, ``committed_batches``: the highest n with all of the batches 1..n in ``batch_index``."""
    numbered = committed.select("batch_index").distinct()
    gap = numbered.withColumn("rank", F.row_number().over(Window.orderBy("batch_index"))).where("batch_index = rank")
    return gap.agg(F.coalesce(F.max("batch_index"), F.lit(0)).cast("long").alias("committed_batches"))
