import zlib

from pyspark.sql import functions as F

from docgraph.llm import sharding
from docgraph.llm.sharding import SlotMap, new_map, rebalanced_map, record_table, shard_documents, slot_bytes


def texts(n=600):
    return [(i, "word é " * (i * 37 % 211) if i % 50 else None, "x") for i in range(n)] + [(5, "same", "y"), (5, "same", "z"), (None, "no id", None)]


def test_shards_are_near_equal_and_places_gapless(spark):
    data = texts()
    df = spark.createDataFrame(data, "doc_id long, text string, shard string").repartition(5)
    got = shard_documents(df, 7, slots=512).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.size, r.text_crc32) for r in got) == sorted(
        (i is None, i or 0, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, _ in data
    )
    places, sizes = {}, {}
    for r in got:
        assert r.law == "bytes" and 0 <= r.shard < 7 and r.grown_shard is None
        places.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert max(sizes.values()) - min(sizes.values()) < 0.03 * sum(sizes.values()) / 7


def test_rebalancing_moves_few_slots_into_new_shards(spark, tmp_path):
    df = spark.createDataFrame(texts(), "doc_id long, text string, shard string")
    sizes = slot_bytes(record_table(df, slots=512), 512)
    stored = SlotMap(spark, str(tmp_path / "map"))
    one = {r.virtual_slot: r.shard for r in stored.store(new_map(sizes, 7)).collect()}
    two = {r.virtual_slot: r.shard for r in stored.store(rebalanced_map(stored.version(1), sizes, 8)).collect()}
    assert stored.newest() == 2 and stored.version(1).count() == stored.version(2).count() == 512
    moved = [s for s in one if one[s] != two[s]]
    assert moved and all(two[s] == 7 for s in moved)
    load = {r.virtual_slot: r.bytes for r in sizes.collect()}
    total = sum(load.values())
    assert sum(load[s] for s in moved) < total / 7
    three = {r.virtual_slot: r.shard for r in stored.store(rebalanced_map(stored.version(2), sizes, 6)).collect()}
    assert set(three.values()) <= set(range(6)) and stored.newest() == 3


def test_empty_table_and_native_plan(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert shard_documents(df, 3, slots=64).count() == 0
    plan = shard_documents(spark.createDataFrame(texts(20), "doc_id long, text string, s string"), 3, slots=64)
    assert not any(w in plan._jdf.queryExecution().toString() for w in ("Python", "Pandas", "Arrow"))
    assert plan.agg(F.count("*")).first()[0] == 23


def test_slots_follow_from_records_alone(spark):
    data = texts() + [(9, "again and again", "x")] * 3000
    df = spark.createDataFrame(data, "doc_id long, text string, shard string")
    one, two = (sorted(map(repr, shard_documents(df.repartition(n), 7, slots=512).collect())) for n in (1, 5))
    assert one == two
    again = [r.virtual_slot for r in record_table(df, slots=512).where("doc_id = 9 AND size = 31").collect()]
    assert len(again) == 3000 and len(set(again)) > 450


def test_repeats_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(sharding, "REPEATS", 7)
    df = spark.createDataFrame([(1, "a", "x")] * 50 + [(2, None, "y")], "doc_id long, text string, number string")
    assert record_table(df, slots=64).count() == 51


def test_a_stored_map_is_edited(spark, tmp_path):
    df = spark.createDataFrame(texts(), "doc_id long, text string, shard string")
    path = str(tmp_path / "map")
    one = {r.virtual_slot: r.shard for r in shard_documents(df, 7, slots=512, path=path).collect()}
    two = {r.virtual_slot: r.shard for r in shard_documents(df.repartition(3), 8, slots=512, path=path).collect()}
    assert one.keys() == two.keys() and SlotMap(spark, path).newest() == 2
    moved = [s for s in one if one[s] != two[s]]
    assert moved and all(two[s] == 7 for s in moved)
