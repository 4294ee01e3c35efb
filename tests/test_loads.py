"""What a load does to stored documents, and where its rows come from."""

import io
import json
import sys

import pytest

from docgraph import cli
from docgraph.functions.members import object_members
from docgraph.operators import export
from docgraph.operators.catalog import CatalogError, Database
from docgraph.options import OptionError
from docgraph.sources.documents import first_bad_line, json_elements, read_delimited, read_json_array, read_jsonl
from docgraph.streaming.file_import import import_new_files


def database(spark, tmp_path, kind="document"):
    db = Database(spark, str(tmp_path / "catalog"))
    db.create()
    db.ensure_collection("c", kind)
    return db


def rows(spark, docs):
    df = spark.createDataFrame([(i, d) for i, d in enumerate(docs)], "ordinal long, doc string").repartition(3)
    return df.selectExpr("ordinal", "doc", "get_json_object(doc, '$._key') AS _key")


def stored(db):
    return {r._key: r.doc for r in db.read("c").collect()}


def test_members_are_raw_text():
    assert object_members(' { "a" : 1.0 ,"b":[1, {"c":2}],"a":1.0e10, "n":null}') == [("a", "1.0e10"), ("b", '[1, {"c":2}]'), ("n", "null")]
    assert object_members("{}") == []
    for bad in ("[1]", '{"a" 1}', '{"a":1', '{"a":1 "b":2}', "1", "{}{}", '{"a":1} x', '{"a":1,}'):
        with pytest.raises(ValueError):
            object_members(bad)


def test_update_patches_attribute_by_attribute(spark, tmp_path):
    db = database(spark, tmp_path)
    db.load("c", rows(spark, ['{"_key":"1","a":1.0,"b":2}', '{"_key":"2","x":"y"}']))
    counts = db.load("c", rows(spark, ['{"_key":"1","b":3}', '{"_key":"3","n":1}', '{"_key":"1","c":[1, 2],"b":4}', '{"_key":"3","n":null}']), "update")
    assert counts == {"created": 1, "updated": 3, "ignored": 0, "errors": 0}
    assert stored(db) == {"1": '{"_key":"1","a":1.0,"b":4,"c":[1, 2]}', "2": '{"_key":"2","x":"y"}', "3": '{"_key":"3","n":null}'}


def test_update_of_edges_keeps_their_ends(spark, tmp_path):
    db = database(spark, tmp_path, "edge")
    schema = "ordinal long, _key string, _from string, _to string, doc string"
    db.load("c", spark.createDataFrame([(0, "k", "p/1", "p/2", '{"w":1}')], schema))
    db.load("c", spark.createDataFrame([(0, "k", None, "p/3", '{"v":2}')], schema), "update")
    assert [tuple(r) for r in db.read("c").collect()] == [("k", "p/1", "p/3", '{"w":1,"v":2}')]


def test_rows_without_a_key_are_all_kept(spark, tmp_path):
    db = database(spark, tmp_path)
    assert db.load("c", rows(spark, ['{"a":1}'] * 3))["created"] == 3
    assert db.load("c", rows(spark, ['{"a":1}'] * 2))["created"] == 2
    assert db.count("c") == 5 and len(stored(db)) == 5
    assert db.load("c", rows(spark, ['{"a":1}']), load_id="same")["created"] == 1
    assert db.load("c", rows(spark, ['{"a":1}']), "ignore", load_id="same")["ignored"] == 1


def test_the_order_of_rows_is_asked_for_and_holds(spark, tmp_path):
    db = database(spark, tmp_path)
    docs = [f'{{"_key":"{i % 5}","v":{(i * 7919) % 1000}}}' for i in range(200)]
    with pytest.raises(CatalogError, match="needs its order"):
        db.load("c", rows(spark, docs).drop("ordinal"))
    db.load("c", rows(spark, docs), "replace")
    assert stored(db) == {str(i % 5): docs[i] for i in range(195, 200)}
    db.load("c", rows(spark, ['{"_key":"0","v":"new"}']), "replace")
    assert stored(db)["0"] == '{"_key":"0","v":"new"}' and db.count("c") == 5


def test_of_two_loads_at_once_the_second_fails(spark, tmp_path):
    db = database(spark, tmp_path)
    seen = db._entry("c")
    db.load("c", rows(spark, ['{"_key":"1"}']))
    late = Database(spark, db.root)
    late._entry = lambda name: seen
    with pytest.raises(CatalogError, match="another load"):
        late.load("c", rows(spark, ['{"_key":"2"}']))
    assert set(stored(db)) == {"1"}
    before = db._entry("c")
    db.load("c", rows(spark, ['{"_key":"3"}']))
    assert {r._key for r in db.read("c", before).collect()} == {"1"}  # a reader's snapshot outlives one load


def test_streamed_lines_without_keys(spark, tmp_path):
    db = database(spark, tmp_path)
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.jsonl").write_text('{"a":1}\n{"a":1}\n{"_key":"k","v":2}\n{"_key":"k","v":1}\n')
    import_new_files(spark, str(tmp_path / "in"), db, "c", str(tmp_path / "mark"), "replace")
    assert db.count("c") == 3 and stored(db)["k"] == '{"_key":"k","v":1}'


def test_long_arrays_are_scanned_in_pieces(spark, tmp_path):
    docs = [json.dumps({"i": i, "t": "x" * (i % 50)}) for i in range(5000)] + [json.dumps({"long": "y" * 3_000_000}), "12345678901234567890"]
    text = "[" + " ,\n".join(docs) + "]"
    source = io.StringIO(text)
    assert list(json_elements(lambda n: source.read(min(n, 997)))) == docs
    (tmp_path / "a.json").write_text(text)
    got = read_json_array(spark, str(tmp_path / "a.json"), place=True).orderBy("line").collect()
    assert [r.doc for r in got] == docs and got[-1].ordinal == len(docs)
    import gzip

    (tmp_path / "b.json.gz").write_bytes(gzip.compress(text.encode()))
    assert read_json_array(spark, str(tmp_path / "b.json.gz")).count() == len(docs)


def test_delimited_files_are_split_and_exact(spark, tmp_path):
    lines = [f'{i},"a,{i}",' if i % 3 else f"{i}" if i % 2 else f"{i},b,c,d" for i in range(60_000)]
    (tmp_path / "a.csv").write_text("k,v,w\n" + "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100k")
    try:
        df = read_delimited(spark, str(tmp_path / "a.csv"), place=True)
        assert df.rdd.getNumPartitions() > 4
        got = [tuple(r)[:3] for r in df.orderBy(*[f"`{df.columns[-1]}`.{c}" for c in ("file", "file_start", "line")]).collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert got == [(str(i), f"a,{i}", "") if i % 3 else (str(i), None, None) if i % 2 else (str(i), "b", "c") for i in range(60_000)]


def test_the_place_of_a_bad_line(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a":1}\n\n{"a":2}\n{"a": tru}\n{"a":3}\n')
    at = first_bad_line(spark, str(tmp_path / "a.jsonl"))
    assert (at["line"], at["column"]) == (4, 7)
    assert first_bad_line(spark, str(tmp_path / "none.jsonl")) is None if (tmp_path / "none.jsonl").write_text("{}") else True
    with pytest.raises(Exception, match="not a JSON value"):
        read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()


@pytest.mark.parametrize("kind", ["jsonl", "json", "csv"])
def test_single_objects(spark, tmp_path, kind):
    df = spark.createDataFrame([(i, f'{{"i":{i}}}') for i in range(100)], "ordinal long, doc string").repartition(5)
    path = str(tmp_path / f"one.{kind}")
    size = export.write_single(df, path, kind, fields=["i"])
    text = open(path).read()
    assert size == len(text) and export.head(spark, path) == size and f"one.{kind}" in export.listed(spark, str(tmp_path)) and export.head(spark, path + "x") is None
    values = [x["i"] for x in json.loads(text)] if kind == "json" else [int(x) for x in text.split()[1:]] if kind == "csv" else [json.loads(x)["i"] for x in text.splitlines()]
    assert values == list(range(100)) and export.get(spark, path, 1, 4) == text[1:4].encode()
    export.write_single(df.limit(0), path, kind, fields=["i"])
    assert open(path).read() == {"jsonl": "", "json": "[]", "csv": "i\n"}[kind]
    with pytest.raises(OptionError):
        export.write_single(df, path, kind, fields=["i"], codec="zstd")


def test_standard_input_and_all_databases(spark, tmp_path, capsys, monkeypatch):
    catalog = str(tmp_path / "catalog")

    def call(*args):
        code = cli.main(["--catalog", catalog, *args])
        return code, json.loads(capsys.readouterr().out.splitlines()[-1])

    monkeypatch.setattr(sys, "stdin", type("In", (), {"buffer": io.BytesIO(b'{"_key":"a"}\n{"b":1}\n{"b":1}\n')}))
    code, out = call("--database", "one", "import", "-", "--format", "jsonl", "--collection", "c")
    assert code == 0 and out["created"] == 3
    (tmp_path / "bad.jsonl").write_text('{"a":1}\n{"a":}\n')
    code, out = call("--database", "two", "import", str(tmp_path / "bad.jsonl"), "--collection", "c")
    assert code == 2 and "line 2, column 6" in out["error"]
    (tmp_path / "good.json").write_text('[{"_key":"x"},{"_key":"y"}]')
    assert call("--database", "two", "import", str(tmp_path / "good.json"), "--collection", "d")[0] == 0
    code, out = call("dump", str(tmp_path / "dump"), "--all-databases")
    manifest = json.loads((tmp_path / "dump" / "dump.manifest.json").read_text())
    assert code == 0 and {a.get("database") for a in manifest["artifacts"]} == {"one", "two"}
    code, out = call("--database", "two", "export", str(tmp_path / "out"), "--name", "d.json", "--collection", "d", "--format", "json", "--single")
    assert code == 0 and sorted(x["_key"] for x in json.loads((tmp_path / "out" / "d.json").read_text())) == ["x", "y"]


@pytest.mark.parametrize("mode", ["error", "ignore", "replace", "update"])
def test_layers_read_like_a_rewrite(spark, tmp_path, mode):
    import random

    r = random.Random(mode)
    db = database(spark, tmp_path)
    want: dict[str, dict] = {}
    for _ in range(11):  # enough for a merge
        new = [(str(r.randrange(12)), {r.choice("abc"): r.randrange(100) for _ in range(2)}) for _ in range(r.randrange(1, 5))]
        counts = db.load("c", rows(spark, [json.dumps({"_key": k, **d}) for k, d in new]), mode)
        told = {"created": 0, "updated": 0, "ignored": 0, "errors": 0}
        for k, d in new:
            if k not in want:
                told["created"] += 1
                want[k] = {"_key": k, **d}
                continue
            told[{"error": "errors", "ignore": "ignored"}.get(mode, "updated")] += 1
            if mode == "replace":
                want[k] = {"_key": k, **d}
            elif mode == "update":
                want[k].update(d)
        assert counts == told
    assert {k: json.loads(d) for k, d in stored(db).items()} == want and db.count("c") == len(want)
    layers = [len(x) for x in db._entry("c")["folders"].values()]
    assert max(layers) <= 8


def test_a_small_load_writes_its_own_rows_only(spark, tmp_path):
    db = database(spark, tmp_path)
    many = spark.range(20_000).selectExpr("id AS ordinal", "cast(id AS string) AS _key", """concat('{"_key":"', id, '","v":1}') AS doc""")
    db.load("c", many)
    db.load("c", rows(spark, ['{"_key":"17","v":2}', '{"_key":"new","v":3}']), "replace")
    (folder,) = {f for layers in db._entry("c")["folders"].values() for f, _ in layers if f.startswith("v2-")}
    assert spark.read.parquet(f"{db.folder}/c/{folder}").count() == 2
    assert db.count("c") == 20_001 and stored(db)["17"] == '{"_key":"17","v":2}'


def test_refused_rows_are_listed(spark, tmp_path):
    db = database(spark, tmp_path)
    db.load("c", rows(spark, ['{"_key":"a"}']))
    counts = db.load("c", rows(spark, ['{"_key":"b"}', '{"_key":"a"}', '{"_key":"b","v":2}', '{"_key":"c"}']), details=True)
    refused = sorted(map(tuple, spark.read.parquet(counts["refused"]).select("ordinal", "_key", "reason").collect()))
    assert refused == [(1, "a", "the collection has the key"), (2, "b", "an earlier row has the key")] and counts["errors"] == 2


def test_loads_that_change_nothing_are_counted(spark, tmp_path):
    db = database(spark, tmp_path)
    docs = [f'{{"_key":"{k}"}}' for k in range(30)]
    db.load("c", rows(spark, docs))
    assert db.load("c", rows(spark, docs)) == {"created": 0, "updated": 0, "ignored": 0, "errors": 30}
    for mode in ("error", "ignore", "replace", "update"):
        assert set(db.load("c", rows(spark, docs).limit(0), mode).values()) == {0}
    assert db.count("c") == 30
