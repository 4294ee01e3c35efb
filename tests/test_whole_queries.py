"""The catalogue's queries over whole texts and all events: what the shorter inputs of their namesakes leave out."""

import pytest

from docgraph.plans.catalogue import ORACLE_SQL, QUERIES

LONG = "x" * 70 + ' "quoted" \\ back\nline\ttab\r' + "y" * 200_000
NAMES = ["csv_guard_whole", "rdf_ntriples_parse_whole", *(f"upsert_{m}_whole" for m in ("ignore", "error", "replace", "update"))]


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(k, LONG + str(k), "en", 200_096) for k in range(8)], "doc_id long, text string, lang string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_texts_are_guarded_and_parsed_to_their_end(spark, folder):
    cells = {r.doc_id: r.cell for r in QUERIES["csv_guard_whole"](spark, folder).collect()}
    assert all(cells[k].endswith(LONG + str(k)) for k in range(8))
    parsed = {r.s_value: r.o_value for r in QUERIES["rdf_ntriples_parse_whole"](spark, folder).where("s_kind = 'bnode'").collect()}
    assert parsed == {f"d{k}": LONG + str(k) for k in range(8)}


def test_every_event_enters_an_upsert(spark, tmp_path):
    rows = [(i, i, "click", float(i)) for i in range(12)]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    for mode in ("ignore", "error", "replace", "update"):
        assert {r.event_id for r in QUERIES[f"upsert_{mode}_whole"](spark, str(tmp_path)).collect()} == set(range(12))


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(compare, name):
    compare(QUERIES[name], ORACLE_SQL[name])
