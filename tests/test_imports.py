"""Resumed imports, loads of many collections, zstd exports, and what the command line tells."""

import json

import pytest
import zstandard

from docgraph import cli
from docgraph.operators import export
from docgraph.operators.catalog import CatalogError, Database
from docgraph.operators.resume import load_in_steps


def rows(spark, count, value=0):
    return spark.range(count).selectExpr("id AS ordinal", "cast(id % 40 AS string) AS _key", f"""concat('{{"_key":"', id % 40, '","v":', id + {value}, '}}') AS doc""").repartition(3)


def contents(db, name):
    return {r._key: r.doc for r in db.read(name).collect()}


@pytest.mark.parametrize("mode", ["error", "update"])
def test_an_import_that_was_killed_goes_on(spark, tmp_path, mode):
    whole = Database(spark, f"{tmp_path}/whole")
    whole.ensure_collection("c", buckets=1)
    whole.load("c", rows(spark, 100), mode)
    db = Database(spark, f"{tmp_path}/stopped")
    db.ensure_collection("c", buckets=1)
    load, calls = db.load, []

    def dies(*args, **options):
        if len(calls) == 2:
            raise RuntimeError("killed")
        calls.append(1)
        return load(*args, **options)

    db.load = dies
    with pytest.raises(RuntimeError):
        load_in_steps(db, "c", rows(spark, 100), "nightly", mode, max_docs=10, batches_per_load=2)
    again = Database(spark, f"{tmp_path}/stopped")
    assert again.progress("c", "nightly") == 4
    counts = load_in_steps(again, "c", rows(spark, 100), "nightly", mode, max_docs=10, batches_per_load=2)
    assert counts["skipped_batches"] == 4 and counts["batches"] == 10 and counts["created"] == 0
    assert contents(again, "c") == contents(whole, "c")
    assert load_in_steps(again, "c", rows(spark, 100), "nightly", mode, max_docs=10)["skipped_batches"] == 10
    with pytest.raises(CatalogError, match="others"):
        load_in_steps(again, "c", rows(spark, 20), "nightly", mode, max_docs=10)


def test_many_collections_are_one_change(spark, tmp_path):
    db = Database(spark, str(tmp_path))
    db.create()
    many = spark.range(300).selectExpr("concat('g', id % 30) AS collection", "cast(id div 30 AS string) AS _key", "concat('{\"n\":', id, '}') AS doc")
    before = db._read()[0]
    assert db.load_many(many, "document") == {"created": 300, "updated": 0, "ignored": 0, "errors": 0}
    assert db._read()[0] == before + 2 and len(db._meta()["collections"]) == 30
    assert db.load_many(many.unionByName(many.limit(1).selectExpr("collection", "'new' AS _key", "'{}' AS doc")), "document")["ignored"] == 300
    assert db.count("g7") == 10 and sum(db.count(f"g{k}") for k in range(30)) == 301
    changed = many.where("collection = 'g3'").selectExpr("collection", "_key", "'{\"n\":-1}' AS doc")
    assert db.load_many(changed, "document", "replace")["updated"] == 10
    assert set(contents(db, "g3").values()) - {"{}"} == {'{"n":-1}'}
    with pytest.raises(CatalogError):
        db.load_many(many.selectExpr("collection", "_key", "'a' AS _from", "'b' AS _to", "doc"), "edge")
    assert db.load_many(many.limit(0), "document")["created"] == 0


@pytest.mark.parametrize("kind", ["jsonl", "json", "csv"])
def test_a_single_zstd_object_is_of_many_frames(spark, tmp_path, monkeypatch, kind):
    monkeypatch.setattr(export, "FRAME_BYTES", 200)
    docs = spark.range(100).selectExpr("99 - id AS ordinal", "concat('{\"a\":', id, ',\"s\":\"é\"}') AS doc").repartition(4)
    plain, packed = f"{tmp_path}/plain.{kind}", f"{tmp_path}/packed.{kind}.zst"
    options = {"kind": kind, "fields": ["a", "s"] if kind == "csv" else None}
    export.write_single(docs, plain, **options)
    assert export.write_single(docs, packed, codec="zstd", **options) == export.head(spark, packed)
    text = export.decompressed(export.get(spark, packed), "zstd")
    same = json.loads if kind == "json" else (lambda x: x)
    assert same(text) == same(export.get(spark, plain)) and export.get(spark, packed).count(zstandard.FRAME_HEADER) > 1
    empty = f"{tmp_path}/empty.zst"
    export.write_single(docs.limit(0), empty, codec="zstd", **options)
    export.write_single(docs.limit(0), plain, **options)
    assert export.decompressed(export.get(spark, empty), "zstd") == export.get(spark, plain)


def test_a_folder_of_zstd_lines(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "FRAME_DOCS", 7)
    docs = spark.range(50).selectExpr("concat('{\"a\":', id, '}') AS doc").repartition(4)
    export.write_jsonl(docs, f"{tmp_path}/out", "zstd")
    files = [n for n in export.listed(spark, f"{tmp_path}/out") if n.endswith(".zst")]
    lines = [x for n in files for x in export.decompressed(export.get(spark, f"{tmp_path}/out/{n}"), "zstd").decode().split()]
    assert sorted(lines) == sorted(r.doc for r in docs.collect()) and export.exists(spark, f"{tmp_path}/out/_SUCCESS")


def call(capsys, *args):
    code = cli.main([*args])
    out = capsys.readouterr()
    return code, json.loads(out.out.splitlines()[-1]), [json.loads(x) for x in out.err.splitlines() if x.startswith("{")]


def test_progress_warnings_details_and_checkpoints(spark, tmp_path, capsys):
    catalog, lines = f"{tmp_path}/catalog", tmp_path / "in.jsonl"
    lines.write_text("".join(f'{{"_key":"{k % 8}","v":{k}}}\n' for k in range(12)))
    code, out, events = call(capsys, "--catalog", catalog, "--progress-seconds", "0.2", "import", str(lines), "--collection", "c", "--details")
    assert code == 1 and out["created"] == 8 and out["errors"] == 4
    refused = [e for e in events if e["event"] == "refused"]
    assert sorted(e["key"] for e in refused) == ["0", "1", "2", "3"] and {e["reason"] for e in refused} == {"an earlier row has the key"}
    told = [e for e in events if e["event"] == "progress"]
    assert len(told) > 1 and [e["tasks"] for e in told] == sorted(e["tasks"] for e in told) and told[-1]["tasks"] > 0
    for skipped in (0, 6):
        code, out, _ = call(capsys, "--catalog", catalog, "import", str(lines), "--collection", "d", "--checkpoint", "x", "--batch-docs", "2", "--on-duplicate", "replace")
        assert code == 0 and out["skipped_batches"] == skipped and out["batches"] == 6
    assert call(capsys, "--catalog", catalog, "import", str(lines), "--collection", "d", "--checkpoint", "x", "--complete")[0] == 2
    links = tmp_path / "links.jsonl"
    links.write_text('{"_from":"c/1","_to":"c/2"}\n{"_from":"c/1","_to":""}\n')
    _, _, events = call(capsys, "--catalog", catalog, "import", str(links), "--collection", "e", "--edges")
    assert any(e["event"] == "warning" and "1 rows" in e["message"] for e in events)
    Database(spark, catalog).create_view("v", {"links": {"nowhere": {}}})
    _, _, events = call(capsys, "--catalog", catalog, "dump", f"{tmp_path}/dump")
    assert any(e["event"] == "warning" and "'v'" in e["message"] for e in events)
