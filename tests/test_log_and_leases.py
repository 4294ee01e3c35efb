"""The catalog's log under crashes and races, and snapshots that outlive loads."""

import threading
import time

import pytest

from docgraph.operators.catalog import CatalogError, Database
from docgraph.operators.dump import dump, restore
from docgraph.operators.export import get, listed, publish, put


def rows(spark, pairs):
    return spark.createDataFrame([(i, k, '{"_key":"%s","v":%d}' % (k, v)) for i, (k, v) in enumerate(pairs)], "ordinal long, _key string, doc string")


def contents(df):
    return sorted(r.doc for r in df.collect())


def test_a_name_is_taken_once_and_whole(spark, tmp_path):
    path = f"{tmp_path}/x/entry.json"
    assert publish(spark, path, b"first") and not publish(spark, path, b"second")
    assert get(spark, path) == b"first" and [n for n in listed(spark, f"{tmp_path}/x") if "aside" in n] == []
    won = []
    threads = [threading.Thread(target=lambda k=k: won.append(k) if publish(spark, f"{tmp_path}/race", b"%d" % k) else None) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and get(spark, f"{tmp_path}/race") == b"%d" % won[0]


@pytest.mark.parametrize("torn", [b"", b'{"meta": {"collections": {"a"', b'{"meta": {"collections": {}}, "sha256": "0"}', b"[]"])
def test_a_torn_newest_entry_is_passed_over(spark, tmp_path, torn):
    db = Database(spark, str(tmp_path))
    db.ensure_collection("a")
    number, meta = db._read()
    put(spark, db._log(number + 1), torn)
    assert db._meta() == meta
    db.ensure_collection("b")
    assert set(db._meta()["collections"]) == {"a", "b"} and db._read()[0] == number + 2


def test_a_log_without_any_whole_entry_is_an_error(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    put(spark, db._log(1), b"")
    with pytest.raises(CatalogError):
        db._meta()


def test_writers_and_readers_at_once(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create()
    failed, stop = [], threading.Event()

    def read():
        while not stop.is_set():
            try:
                Database(spark, str(tmp_path))._meta()
            except Exception as error:
                failed.append(error)

    def write(who):
        for k in range(15):
            Database(spark, str(tmp_path)).ensure_collection(f"c{who}-{k}")

    reader, writers = threading.Thread(target=read), [threading.Thread(target=write, args=(w,)) for w in range(3)]
    for t in (reader, *writers):
        t.start()
    for t in writers:
        t.join()
    stop.set()
    reader.join()
    assert not failed and len(db._meta()["collections"]) == 45


def test_a_lease_outlives_loads_and_drops(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    for name in ("a", "gone"):
        db.ensure_collection(name, buckets=2)
        db.load(name, rows(spark, [("x", 0), ("y", 0)]))
    lease = db.lease()
    was = contents(db.read("a"))
    for k in range(1, 5):
        db.load("a", rows(spark, [("x", k), ("y", k)]), overwrite=True)
    db.drop_collection("gone")
    assert contents(db.read("a", lease.meta["collections"]["a"])) == was
    assert len(contents(db.read("gone", lease.meta["collections"]["gone"]))) == 2
    lease.renew()
    lease.release()
    lease.release()
    assert listed(spark, f"{db.folder}/gone/{next(iter(lease.meta['collections']['gone']['folders'].values()))[0][0]}") == [] or not db._meta()["dropped"]
    for _ in range(2):
        db.load("a", rows(spark, [("x", 9), ("y", 9)]), overwrite=True)
    with pytest.raises(Exception):
        contents(db.read("a", lease.meta["collections"]["a"]))
    with pytest.raises(CatalogError):
        lease.renew()


def test_an_expired_lease_frees_what_it_held(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.ensure_collection("a", buckets=1)
    db.load("a", rows(spark, [("x", 0)]))
    lease = db.lease(seconds=0.2)
    time.sleep(0.3)
    for k in (1, 2):
        db.load("a", rows(spark, [("x", k)]), overwrite=True)
    assert db._meta()["leases"] == {}
    with pytest.raises(Exception):
        contents(db.read("a", lease.meta["collections"]["a"]))


def test_a_dump_is_of_the_moment_it_began(spark, tmp_path, monkeypatch):
    db = Database(spark, f"{tmp_path}/db")
    for name in ("a", "b"):
        db.ensure_collection(name, buckets=1)
        db.load(name, rows(spark, [("x", 0), ("y", 0)]))
    from docgraph.operators import dump as dumps

    plain = dumps.encode_parts

    def slow(*args, **options):  # loads come in before every collection is encoded
        for k in range(3):
            db.load("b", rows(spark, [("x", k + 5), ("z", k)]), "replace")
        return plain(*args, **options)

    monkeypatch.setattr(dumps, "encode_parts", slow)
    dump([db], f"{tmp_path}/out", lease_seconds=0.5)
    restore(spark, f"{tmp_path}/again", f"{tmp_path}/out")
    assert contents(Database(spark, f"{tmp_path}/again").read("b")) == ['{"_key":"x","v":0}', '{"_key":"y","v":0}']
    assert db._meta()["leases"] == {}
