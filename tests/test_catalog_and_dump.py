import gzip
import hashlib
import json

import pytest
from pyspark.errors import PySparkException

from docgraph.operators import dump as dumps
from docgraph.operators import export
from docgraph.operators.catalog import CatalogError, Database, complete_views, view_targets
from docgraph.options import OptionError, infer_codec, infer_document_format, infer_rdf_format, parse_edge_definition, spark_path
from docgraph.sources.documents import json_elements, read_delimited, read_json_array, read_jsonl
from docgraph.streaming.file_import import import_new_files

# Documents whose every detail must come back.
FIDELITY = [
    '{"_key":"00042","s":"007"}', '{"_key":"unicode","s":"café 中文 😀","q":"a,b \\"quoted\\" c","n":"l1\\nl2","t":"tab\\tand\\\\backslash"}',
    '{"_key":"nested","a":[1,2,[3]],"o":{"x":{"y":null}},"e":{},"l":[]}', '{"_key":"numeric","i":9007199254740991,"j":-9007199254740991,"f":0.1,"g":1.0e10,"h":1.0,"n":null}',
]


def frame(spark, docs):
    return spark.createDataFrame(list(enumerate(docs)), "ordinal long, doc string")


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_bytes(b'\n{"a":1}\r\n\n  \n {"a":1.0} ')
    assert [r.doc for r in read_jsonl(spark, str(tmp_path / "a.jsonl")).collect()] == ['{"a":1}', '{"a":1.0}']
    (tmp_path / "b.jsonl").write_text('{"a":1}\n{not json}\n')
    with pytest.raises(PySparkException, match="not a JSON value: {not json}"):
        read_jsonl(spark, str(tmp_path / "b.jsonl")).collect()


def test_json_arrays(spark, tmp_path):
    assert list(json_elements('[1, "two", true, null, {"k":[1,2]}, 1.0e10]')) == ["1", '"two"', "true", "null", '{"k":[1,2]}', "1.0e10"]
    assert list(json_elements('[{"s":"a,b]c"},{"s":"x\\"y"}]')) == ['{"s":"a,b]c"}', '{"s":"x\\"y"}']
    assert list(json_elements("  [  ]  ")) == [] and list(json_elements("[1,,2,]")) == ["1", "2"]
    for bad in ('{"a":1}', '[{"a":1},{"a":2}', "[1,2] junk", "", "[1 2]"):
        with pytest.raises(ValueError):
            list(json_elements(bad))
    (tmp_path / "a.json").write_text('[{"a":1},\n {"a":2}]')
    assert [tuple(r) for r in read_json_array(spark, str(tmp_path / "a.json")).orderBy("ordinal").collect()] == [(1, '{"a":1}'), (2, '{"a":2}')]


def test_delimited(spark, tmp_path):
    (tmp_path / "a.csv").write_text('name,note,name\n"a,b","line1\nline2",x\nq"q,,y,extra\nshort\n')
    got = [r.asDict() for r in read_delimited(spark, str(tmp_path / "a.csv")).collect()]
    assert got[0] == {"name": "x", "note": "line1\nline2"} and got[1]["note"] in ("", None) and len(got) == 3
    assert [tuple(r.asDict().values()) for r in read_delimited(spark, str(tmp_path / "a.csv")).collect()] == [tuple(r.values()) for r in got]
    exact = [r.asDict() for r in read_delimited(spark, str(tmp_path / "a.csv"), multi_line=True).collect()]
    assert exact == [{"name": "x", "note": "line1\nline2"}, {"name": "y", "note": ""}, {"name": None, "note": None}]
    (tmp_path / "a.tsv").write_text("a\tb\n1\t2\n")
    assert read_delimited(spark, str(tmp_path / "a.tsv"), "\t").first().asDict() == {"a": "1", "b": "2"}


def test_names(spark):
    assert [infer_document_format(x) for x in ("a.JSONL", "a.ndjson.gz", "b.json", "c.csv.zst", "d.TAB")] == ["jsonl", "jsonl", "json", "csv", "tsv"]
    assert [infer_rdf_format(x) for x in ("a.nt", "a.nq.gz", "a.ttl")] == ["ntriples", "nquads", "turtle"] and infer_codec("x.zstd") == "zstd" and infer_codec("x.csv") is None
    for bad, f in (("a.parquet", infer_document_format), ("x.nt.gzip", infer_rdf_format), ("ftp://x/y", spark_path)):
        with pytest.raises(OptionError):
            f(bad)
    assert spark_path("s3://b/k") == "s3a://b/k" and spark_path("/tmp/x") == "/tmp/x"
    assert parse_edge_definition(" rel : a , b -> c ") == {"collection": "rel", "from": ["a", "b"], "to": ["c"]}
    messages = set()
    for bad in ("knows", "knows:people", ":people->people", "knows:->people", "knows:people->"):
        with pytest.raises(OptionError) as e:
            parse_edge_definition(bad)
        messages.add(str(e.value).split(": ", 1)[1])
    assert len(messages) == 5
    for bad in ("../x", "/x", "a/../b"):
        with pytest.raises(OptionError):
            export.relative(bad)


@pytest.mark.parametrize("kind,codec", [("jsonl", None), ("jsonl", "gzip"), ("jsonl", "zstd"), ("json", None), ("csv", "gzip")])
def test_split_export(spark, tmp_path, kind, codec):
    docs = [f'{{"i":{i}}}' for i in range(10)]
    manifest = export.write_parts(frame(spark, docs), str(tmp_path), "e", kind=kind, codec=codec, fields=["i"], threshold=8 if kind == "csv" else 20)
    bodies = []
    for a in manifest["artifacts"]:
        stored = (tmp_path / a["path"]).read_bytes()
        assert hashlib.sha256(stored).hexdigest() == a["checksum"]["value"] and len(stored) == a["byte_size"]
        bodies.append(export.decompressed(stored, a["compression"]).decode())
    assert len(bodies) >= 3 and json.loads((tmp_path / "e.manifest.json").read_text()) == manifest
    if kind == "json":
        values = [x["i"] for b in bodies for x in json.loads(b)]
    elif kind == "csv":
        assert all(b.startswith("i\n") for b in bodies)
        values = [int(x) for b in bodies for x in b.split()[1:]]
    else:
        values = [json.loads(x)["i"] for b in bodies for x in b.splitlines()]
        assert [r.doc for r in export.read_parts(spark, str(tmp_path), manifest).orderBy("part", "ordinal").collect()] == docs
    assert values == list(range(10))


def test_empty_export_and_checks(spark, tmp_path):
    manifest = export.write_parts(frame(spark, ["x"]).limit(0), str(tmp_path), "e", codec="gzip")
    assert [a["path"] for a in manifest["artifacts"]] == ["e.part-00000.jsonl.gz"] and gzip.decompress((tmp_path / "e.part-00000.jsonl.gz").read_bytes()) == b""
    with pytest.raises(OptionError):
        export.csv_lines(frame(spark, ["{}"]), [])
    rows = export.csv_lines(frame(spark, ['{"name":"alice","age":30,"x":1}', '{"name":"=SUM(A1)","age":-5}', '{"name":{"a":[1]},"age":null}']), ["name", "age"], order="ordinal")
    assert [r.doc for r in rows.orderBy("ordinal").collect()] == ["alice,30", "'=SUM(A1),-5", '"{""a"":[1]}",']


def test_tampered_part_is_refused(spark, tmp_path):
    manifest = export.write_parts(frame(spark, ['{"a":1}']), str(tmp_path), "e")
    (tmp_path / manifest["artifacts"][0]["path"]).write_text('{"a":2}\n')
    with pytest.raises(PySparkException, match="checksum"):
        export.read_parts(spark, str(tmp_path), manifest).collect()


def database(spark, root):
    db = Database(spark, root, "db1")
    db.create()
    db.ensure_collection("docs")
    docs = frame(spark, FIDELITY).selectExpr("ordinal", "doc", "get_json_object(doc, '$._key') AS _key")
    assert db.load("docs", docs) == {"created": 4, "updated": 0, "ignored": 0, "errors": 0}
    db.create_graph("g", ["knows:docs->docs"])
    link = spark.createDataFrame([("k1", "docs/00042", "docs/nested", '{"w":1.0}')], "_key string, _from string, _to string, doc string")
    db.load("knows", link, order=["_key"])
    db.create_index("docs", {"type": "primary"})
    db.create_index("docs", {"type": "persistent", "fields": ["s"]})
    db.create_view("v", {"type": "search", "links": {"docs": {}}, "id": "1"})
    db.create_view("alias", {"type": "search-alias", "indexes": [{"collection": "docs"}]})
    db.create_view("orphan", {"type": "search", "links": {"gone": {}}})
    return db


def test_dump_restore_round_trip(spark, tmp_path):
    db = database(spark, str(tmp_path / "one"))
    folder = str(tmp_path / "dump")
    manifest = dumps.dump([db], folder, codec="zstd")
    assert [a.get("view") for a in manifest["artifacts"] if a["kind"] == "view"] == ["alias", "v"]
    with pytest.raises(dumps.DumpError, match="finished"):
        dumps.dump([db], folder)
    mark = str(tmp_path / "mark.json")
    done = dumps.restore(spark, str(tmp_path / "two"), folder, "db2", checkpoint=mark)
    assert done == ["db2::view::v", "db2::docs", "db2::knows", "db2::view::alias"]
    back = Database(spark, str(tmp_path / "two"), "db2")
    assert sorted(r.doc for r in back.read("docs").collect()) == sorted(FIDELITY)
    link = back.read("knows").first()
    assert (link._key, link._from, link._to) == ("k1", "docs/00042", "docs/nested") and '"w":1.0' in link.doc
    assert back._entry("docs")["indexes"] == [{"type": "persistent", "fields": ["s"]}]
    assert dumps.restore(spark, str(tmp_path / "two"), folder, "db2", checkpoint=mark) == []
    again = dumps.dump([db], folder, overwrite=True)
    with pytest.raises(dumps.DumpError, match="another dump"):
        dumps.restore(spark, str(tmp_path / "two"), folder, "db2", checkpoint=mark)
    for change in ({"encryption": "aes"}, {"format": "vpack"}):
        bad = {**again, "artifacts": [{**a, **change} for a in again["artifacts"]]}
        with pytest.raises(dumps.DumpError):
            dumps.check_manifest(bad)
    with pytest.raises(dumps.DumpError, match="version"):
        dumps.check_manifest({**again, "manifest_version": 99})


def test_claims_and_all_databases(spark, tmp_path):
    folder = str(tmp_path / "dump")
    dumps.claim(spark, folder)
    with pytest.raises(dumps.DumpError, match="in progress"):
        dumps.claim(spark, folder)
    dbs = [Database(spark, str(tmp_path / "root"), n) for n in ("db2", "db1")]
    for db in dbs:
        db.ensure_collection("users")
    manifest = dumps.dump(dbs, folder, overwrite=True, all_databases=True)
    assert manifest["database"] == "all" and [a["path"] for a in manifest["artifacts"]] == ["databases/db2/users.structure.json", "databases/db1/users.structure.json"]
    assert dumps.restore(spark, str(tmp_path / "other"), folder) == ["db2::users", "db1::users"]


def test_catalog(spark, tmp_path):
    db = database(spark, str(tmp_path / "c"))
    with pytest.raises(CatalogError, match="kind document"):
        db.ensure_collection("docs", "edge")
    with pytest.raises(CatalogError):
        db.read("docs; drop")
    for name in ("_sys", "col_1", "col_42", "col_users_tmp"):
        if name != "_sys":
            db.ensure_collection(name)
    names = lambda **f: sorted(r.name for r in db.inventory(**f).collect())
    assert names(include="^col_[0-9]+$") == ["col_1", "col_42"] and names(include="^col_", exclude="_tmp$") == ["col_1", "col_42"]
    new = spark.createDataFrame([("00042", "{}"), ("n", '{"_key":"n"}')], "_key string, doc string")
    with pytest.raises(CatalogError, match="nothing was loaded"):
        db.load("docs", new, order=["_key"], complete=True)
    assert db.load("docs", new, "ignore", order=["_key"]) == {"created": 1, "updated": 0, "ignored": 1, "errors": 0} and db.count("docs") == 5
    assert db.load("docs", new, "ignore", order=["_key"])["created"] == 0
    assert db.query("SELECT _key FROM docs WHERE _key = :k", {"k": "n"}).count() == 1
    db.load("docs", new, order=["_key"], overwrite=True)
    assert db.count("docs") == 2
    db.drop_graph("g", drop_collections=True)
    db.drop_graph("g")
    assert names(include="knows|docs") == []
    with pytest.raises(OptionError):
        db.create_graph("empty")


def test_views_and_streams(spark, tmp_path):
    views = spark.createDataFrame([("v1", '{"links":{"more":{},"docs":{}}}'), ("v2", '{"indexes":[{"collection":"docs"}]}'), ("v3", "{}")], "name string, doc string")
    assert view_targets(views).count() == 3
    assert sorted(r.name for r in complete_views(views, spark.createDataFrame([("docs",)], "name string")).collect()) == ["v2", "v3"]
    folder, mark = tmp_path / "in", str(tmp_path / "mark")
    folder.mkdir()
    db = Database(spark, str(tmp_path / "s"))
    db.ensure_collection("docs")
    (folder / "1.jsonl").write_text('{"_key":"a"}\n{"_key":"b"}\n')
    assert import_new_files(spark, str(folder), db, "docs", mark) == 1 and db.count("docs") == 2
    (folder / "2.jsonl").write_text('{"_key":"c"}\n')
    import_new_files(spark, str(folder), db, "docs", mark)
    assert db.count("docs") == 3


@pytest.mark.parametrize("codec", [None, "gzip", "zstd"])
def test_a_part_is_written_and_read_in_pieces(spark, tmp_path, codec):
    """No task holds a whole part's documents: they come to its writer as sorted rows, and leave its reader some at a time."""
    import pyarrow as pa

    docs = [f'{{"_key":"{i}","text":"{str(i) * 40}"}}' for i in range(20_000)]
    df = spark.createDataFrame(list(enumerate(docs)), "ordinal long, doc string").repartition(5)
    parts = export.encode_parts(df, "big", codec=codec)
    assert "InPandas" not in parts.rows._jdf.queryExecution().executedPlan().toString()
    (part,) = export.store_parts(parts, str(tmp_path))
    stored = export.get(spark, f"{tmp_path}/{part['path']}")
    assert len(stored) == part["byte_size"] and hashlib.sha256(stored).hexdigest() == part["sha256"]
    pieces = list(export._documents(pa.py_buffer(stored), codec or "none"))
    assert [d for p in pieces for d in p] == docs and len(pieces) > 2
    assert max(sum(map(len, p)) for p in pieces) <= export.READ_BYTES + max(map(len, docs))
