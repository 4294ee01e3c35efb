import json

from docgraph import cli
from docgraph.operators.catalog import Database


def call(capsys, catalog, *args):
    code = cli.main(["--catalog", catalog, "--database", "db", *args])
    out = capsys.readouterr()
    assert [json.loads(x)["event"] for x in out.err.splitlines() if x.startswith("{")][0] == "started"
    return code, json.loads(out.out.splitlines()[-1])


def test_import_export_rdf_dump_restore_graph(spark, tmp_path, capsys):
    catalog = str(tmp_path / "catalog")
    (tmp_path / "people.csv").write_text("id,name,zip\n1,alice,00123\n2,bob,5\n2,again,6\n")
    code, out = call(capsys, catalog, "import", str(tmp_path / "people.csv"), "--collection", "people", "--translate", "id=_key")
    assert code == 1 and out == {"ok": False, "created": 2, "updated": 0, "ignored": 0, "errors": 1}
    (tmp_path / "knows.jsonl").write_text('{"_from":"1","_to":"2"}\n{"_from":"1","_to":""}\n')
    code, out = call(capsys, catalog, "import", str(tmp_path / "knows.jsonl"), "--collection", "knows", "--edges", "--from-prefix", "people", "--to-prefix", "people")
    assert code == 0 and out["created"] == 1 and out["skipped_no_edge"] == 1
    code, out = call(capsys, catalog, "export", str(tmp_path / "out"), "--collection", "people", "--format", "csv", "--fields", "_key,zip")
    assert code == 0 and sorted((tmp_path / "out" / "export.part-00000.csv").read_text().split()) == ["1,00123", "2,5", "_key,zip"]
    (tmp_path / "g.nt").write_text('<http://a/alice> <http://a/knows> <http://a/bob> .\n<http://a/bob> <http://a/knows> <http://a/carol> .\n<http://a/alice> <http://a/name> "Alice" .\n')
    assert call(capsys, catalog, "rdf", str(tmp_path / "g.nt"))[1] == {"ok": True, "triples_read": 3, "vertices_built": 3, "edges_built": 2, "vertices_created": 3, "vertices_ignored": 0, "edges_created": 2, "edges_ignored": 0}
    assert call(capsys, catalog, "rdf", str(tmp_path / "g.nt"))[1]["vertices_created"] == 0
    assert call(capsys, catalog, "graph", "create", "g", "--edge", "knows:people->people")[0] == 0
    assert call(capsys, catalog, "dump", str(tmp_path / "dump"), "--compression", "gzip")[0] == 0
    code, out = call(capsys, str(tmp_path / "other"), "restore", str(tmp_path / "dump"))
    assert code == 0 and "db::people" in out["restored"] and Database(spark, str(tmp_path / "other"), "db").count("people") == 2
    assert call(capsys, catalog, "import", str(tmp_path / "x.parquet"), "--collection", "c")[0] == 2
