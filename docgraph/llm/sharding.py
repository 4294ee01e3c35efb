"""Sharding through fixed virtual slots, with DataFrame functions only.

Records are hashed into thousands of virtual slots.  Bytes are aggregated per
slot, and a stored, versioned map gives every slot its shard; later versions
edit the map and move only the slots that restore the balance.  A record's
shard follows from its slot, so moving data means moving whole slots.

The only tables that are brought together have one row per slot, a number that
is a parameter and not a property of the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from .shared import new_path, save

SLOTS = 8192
ROW_OVERHEAD = 16
#: Equal rows that are numbered together.
REPEATS = 65_536


def record_table(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Narrow rows (doc_id, size, text_crc32, virtual_slot), stored once; texts are read a single time.

    A slot follows from the record alone: its id, checksum, size, and its number among the rows that are equal in these, so that a
    row that is repeated very often fills no slot.  Equal rows are counted, with partial counts before the
    exchange, and written out again by number, in blocks that tasks of their own take; which of them gets which number makes no difference.
    """
    text = F.col(text_col).cast("string")
    narrow = df.select(
        F.col(id_col).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_OVERHEAD).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
    )
    record = ("doc_id", "size", "text_crc32")
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1, F.lit(REPEATS).cast("long"))).alias("block")
    spread = narrow.groupBy(*record).agg(F.count("*").alias("n")).select(*record, "n", blocks).repartition(*record, "block")
    number = F.explode(F.sequence("block", F.least(F.col("block") + REPEATS, "n") - 1)).alias("number")
    slot = F.pmod(F.xxhash64(*record, "number"), F.lit(slots)).cast("int").alias("virtual_slot")
    return save(spread.select(*record, number).select(*record, slot), "shard-records")


def slot_bytes(records: DataFrame, slots: int = SLOTS) -> DataFrame:
    """(virtual_slot, bytes, rows) of all slots, empty ones too: ``slots`` rows."""
    got = records.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    every = records.sparkSession.range(slots).select(F.col("id").cast("int").alias("virtual_slot"))
    return every.join(got, "virtual_slot", "left").select(
        "virtual_slot", F.coalesce("bytes", F.lit(0)).alias("bytes"), F.coalesce("rows", F.lit(0)).alias("rows")
    )


_MAP = "array<struct<virtual_slot:int,shard:int>>"
_BLOCK = 128


def _once(value: Column, use) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _lightest(loads: Column) -> Column:
    return F.array_position(loads, F.array_min(loads)).cast("int") - 1


def new_map(sizes: DataFrame, shards: int) -> DataFrame:
    """Version 1: slots, heaviest first, each to the shard with the fewest bytes so far."""
    slots = F.array_sort(F.collect_list(F.struct((-F.col("bytes")).alias("negative"), "virtual_slot")))
    blocks = F.transform(
        F.sequence(F.lit(0), F.floor((F.size("slots") - 1) / _BLOCK).cast("int")), lambda b: F.slice("slots", b * _BLOCK + 1, _BLOCK)
    )
    no_loads, no_map = F.array_repeat(F.lit(0).cast("long"), shards), F.array().cast(_MAP)

    def put(state: Column, slot: Column) -> Column:
        def into(to: Column) -> Column:
            loads = F.transform(state["loads"], lambda x, i: F.when(i == to, x - slot["negative"]).otherwise(x))
            entry = F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"))
            return F.struct(loads.alias("loads"), F.concat(state["map"], F.array(entry)).alias("map"))

        return _once(_lightest(state["loads"]), into)

    def put_block(state: Column, block: Column) -> Column:  # so that only short maps are copied slot by slot
        own = F.aggregate(block, F.struct(state["loads"].alias("loads"), no_map.alias("map")), put)
        return _once(own, lambda s: F.struct(s["loads"].alias("loads"), F.concat(state["map"], s["map"]).alias("map")))

    start = F.struct(no_loads.alias("loads"), no_map.alias("map"))
    placed = sizes.agg(slots.alias("slots")).select(F.aggregate(blocks, start, put_block)["map"].alias("map"))
    return placed.select(F.inline("map")).withColumn("version", F.lit(1))


def rebalanced_map(old: DataFrame, sizes: DataFrame, shards: int, tolerance: float = 0.02) -> DataFrame:
    """The next version: slots leave shards that are over the mean by more than ``tolerance``, and no others.

    From each such shard the heaviest slots move that keep the lightest shard within
    bounds, until the shard is within bounds itself.  ``shards`` may be larger than before;
    slots of shards beyond ``shards`` all move.
    """
    now = old.select("virtual_slot", "shard", "version").join(sizes, "virtual_slot")
    state = now.agg(
        F.max("version").alias("version"), (F.sum("bytes") / F.lit(shards) * F.lit(1 + tolerance)).alias("target"),
        F.sort_array(F.collect_list(F.struct("bytes", "virtual_slot", "shard")), asc=False).alias("slots"),
    )
    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("slots", lambda x: x["shard"] == s), F.lit(0).cast("long"), lambda a, x: a + x["bytes"]),
    )
    start = F.struct(loads.alias("loads"), F.array().cast(_MAP).alias("moves"))

    def move(acc: Column, slot: Column) -> Column:
        own = F.get(acc["loads"], slot["shard"])  # null for a shard that is gone
        lightest = F.array_min(acc["loads"])
        to = _lightest(acc["loads"])
        fits = (lightest + slot["bytes"] <= F.col("target")) & (slot["bytes"] > 0)
        moves = (slot["shard"] >= shards) | F.coalesce((own > F.col("target")) & fits, F.lit(False))
        after = F.transform(
            acc["loads"], lambda x, i: F.when(i == to, x + slot["bytes"]).when(i == slot["shard"], x - slot["bytes"]).otherwise(x)
        )
        entry = F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"))
        changed = F.struct(after.alias("loads"), F.concat(acc["moves"], F.array(entry)).alias("moves"))
        return F.when(moves, changed).otherwise(acc)

    moved = state.select("version", F.aggregate("slots", start, move)["moves"].alias("moves")).select("version", F.inline_outer("moves"))
    moved = moved.select("version", "virtual_slot", F.col("shard").alias("to"))
    newest = F.max("version").alias("newest")
    return (
        old.select("virtual_slot", "shard")
        .join(F.broadcast(moved.where("virtual_slot IS NOT NULL").select("virtual_slot", "to")), "virtual_slot", "left")
        .crossJoin(F.broadcast(old.agg(newest)))
        .select("virtual_slot", F.coalesce("to", "shard").alias("shard"), (F.col("newest") + 1).alias("version"))
    )


class SlotMap:
    """A slot-to-shard map in a folder, one subfolder per version; readers take the newest."""

    SCHEMA = T.StructType([T.StructField("virtual_slot", T.IntegerType()), T.StructField("shard", T.IntegerType())])

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or new_path(spark, "slot-map")

    def store(self, table: DataFrame) -> DataFrame:
        """Store the next version; of two writers of one version the second fails, and no version is written over."""
        number = table.agg(F.max("version")).first()[0]
        table.where(F.col("version") == number).drop("version").coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/version={number}")
        return self.version(number)

    def exists(self) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def newest(self) -> int:
        return self._all().agg(F.max("version")).first()[0]

    def version(self, number: int) -> DataFrame:
        return self._all().where(F.col("version") == number)

    def _all(self) -> DataFrame:
        schema = T.StructType([*self.SCHEMA, T.StructField("version", T.IntegerType())])
        return self.spark.read.schema(schema).parquet(self.path)


def assign(records: DataFrame, sizes: DataFrame, slot_map: DataFrame) -> DataFrame:
    """Each record's shard, and its place in the shard: gapless from 0.

    A place is the rank inside the virtual slot plus the rows of the shard's
    earlier slots, so no window spans more than one virtual slot's rows.
    """
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    starts = slot_map.join(sizes, "virtual_slot").select(
        "virtual_slot", "shard", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("start")
    )
    inside = Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size")
    ranked = records.withColumn("rank", F.row_number().over(inside) - 1)
    return ranked.join(F.broadcast(starts), "virtual_slot").select(
        "doc_id", "size", "text_crc32", "shard", (F.col("start") + F.col("rank")).cast("long").alias("slot"), "virtual_slot"
    )


def shard_documents(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """All rows of ``df`` in shards 0 to ``shards`` - 1 of nearly equal bytes (law ``bytes``).

    Defined results: a null text has no bytes beyond the fixed 16 of a row and
    the checksum of the empty text; a null id is hashed like any value; equal rows, and the
    rows of a group of equal texts, are spread over slots and shards like any others (the law asks for
    equal bytes, and one group may hold a third of them), and get places of their own; an empty table
    gives no rows; other columns are not read.  However the table is partitioned, a record keeps its slot.

    Where ``path`` holds a map, its newest version is edited for the present bytes and ``shards``, and stored as the next
    one: only slots move that restore the balance.  Otherwise version 1 is stored there.
    """
    records = record_table(df, id_col, text_col, slots)
    sizes = save(slot_bytes(records, slots), "slot-bytes")
    stored = SlotMap(df.sparkSession, path)
    known = stored.exists()
    slot_map = stored.store(rebalanced_map(stored.version(stored.newest()), sizes, shards) if known else new_map(sizes, shards))
    return assign(records, sizes, slot_map).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "virtual_slot",
    )
