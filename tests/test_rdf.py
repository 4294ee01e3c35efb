import hashlib

import pytest
from pyspark.errors import PySparkException

from docgraph.operators.rdf_graph import Fold, edges, new_only, summary, vertices
from docgraph.sources.rdf_lines import parse_statements
from docgraph.sources import turtle as turtle_source
from docgraph.sources.turtle import RDF, XSD, Turtle, TurtleError, parse_documents, read_turtle

A = "http://a/"


def parse(spark, *lines, quads=False):
    df = spark.createDataFrame(list(enumerate(lines, 1)), "n int, value string")
    return [tuple(r)[1:] for r in parse_statements(df, quads, ordinal_col="n").orderBy("ordinal").collect()]


def key(*parts):
    return hashlib.sha256("\0".join(parts).encode()).hexdigest()


def test_statements(spark):
    got = parse(
        spark, f"<{A}s> <{A}p> <{A}o> .", f'<{A}s> <{A}p> "ober"@de-AT .', f'<{A}s> <{A}p> "42"^^<{XSD}integer> .', f'_:b0 <{A}p> "up\\ndown \\"!\\"" .\r',
        "  # comment", "", f'<{A}s><{A}p>"".', f"<{A}s> <{A}p> _:x . trailing", f'<{A}s> <{A}p> "\\u00e9\\U0001F600" .',
    )
    s, p = A + "s", A + "p"
    assert got == [
        ("iri", s, p, "iri", A + "o", None, None, None), ("iri", s, p, "literal", "ober", None, "de-AT", None), ("iri", s, p, "literal", "42", XSD + "integer", None, None),
        ("bnode", "b0", p, "literal", 'up\ndown "!"', None, None, None), ("iri", s, p, "literal", "", None, None, None), ("iri", s, p, "bnode", "x", None, None, None),
        ("iri", s, p, "literal", "é😀", None, None, None),
    ]


def test_quads_and_errors(spark):
    line = f"<{A}s> <{A}p> <{A}o> <{A}g> ."
    assert parse(spark, line, f"<{A}s> <{A}p> <{A}o> _:g .", quads=True)[0][-1] == A + "g"
    assert parse(spark, line, f"<{A}s> <{A}p> <{A}o> _:g .", quads=True)[1][-1] == "_:g"
    for lines, what in (((line,), "fourth term"), ((f"<{A}s> <{A}p> <{A}o> .", "no statement here"), "line 2"), (("<s> <p> _:o.",), "not a statement"), (('<s> <p> "a" @en .',), "not a statement"), (('<s> <p> "\\q" .',), "escape")):
        with pytest.raises(PySparkException, match=what):
            parse(spark, *lines)


def turtle(text):
    return Turtle(text).statements()


def test_turtle():
    assert len(turtle("@prefix geo: <http://a/> . geo:rhine a geo:River ; geo:into geo:north_sea .")) == 2
    assert turtle("PREFIX geo: <http://a/>\ngeo:rhine geo:into geo:sea .") == [("iri", A + "rhine", A + "into", "iri", A + "sea", None, None)]
    assert len(turtle("@prefix geo: <http://a/> . geo:rhine geo:past geo:bonn , geo:mainz ; geo:from geo:alps .")) == 3
    got = turtle('@prefix geo: <http://a/> . geo:rhine geo:told "ober"@de-AT, 1233, -0.75, 2E3, false .')
    assert [x[4:] for x in got] == [("ober", None, "de-AT"), ("1233", XSD + "integer", None), ("-0.75", XSD + "decimal", None), ("2E3", XSD + "double", None), ("false", XSD + "boolean", None)]
    assert turtle('<r> <says> """low\n"water" """ .')[0][4] == 'low\n"water" '
    nested = turtle("@prefix geo: <http://a/> . geo:rhine geo:mouth [ geo:land geo:holland ] .")
    assert [x[2] for x in nested] == [A + "land", A + "mouth"] and nested[0][1] == nested[1][4]
    listed = turtle("@prefix geo: <http://a/> . geo:rhine geo:past ( geo:chur geo:basel ) .")
    assert [x[2] for x in listed] == [RDF + "first", RDF + "rest", RDF + "first", RDF + "rest", A + "past"] and listed[3][4] == RDF + "nil"
    assert turtle("<r> <past> () .")[0][4] == RDF + "nil"
    assert turtle("@base <http://a/> . <aare> <into> <rhine> . # end")[0][:2] == ("iri", A + "aare")
    assert turtle("_:w <depth> 7.")[0] == ("bnode", "u_w", "depth", "literal", "7", XSD + "integer", None)
    for bad in ("<r> <p> TRUE .", "@PREFIX geo: <http://a/> . <r> <p> <o> .", '<r> <p> "\\uD800" .', "none:r <p> <o> .", '[ <p> "x" ] .', "<r> <p> <o> ;; <q> <t> .", "<r> <p> <o>", '<r> <p> "open .', '<r> <p> """open" .', '# "a" .\n<r> <p> "open .'):
        with pytest.raises(TurtleError):
            turtle(bad)


STREAM = """@prefix geo: <http://a/> . # a comment with "quotes" and <angles>
geo:rhine geo:told "", '', \"\"\"a "" b\nc\"\"\", '''it's''', "x\\"y", 5, 5.25, 1.5e+3, -2.e4, true, false , "z"@de-AT, "1"^^geo:kind.
PREFIX sea: <http://b/>
geo:a.b.c a sea:T ; sea:in [ sea:p ( 1 2.5 geo:x ) ; sea:q _:lake ] , "\\u00e9".
_:lake sea:p geo:end...more , sea: .
@base <http://c/> .
<one> <two> <three> , 7.
"""


def test_turtle_reads_the_same_in_chunks_of_any_length(monkeypatch):
    whole = turtle(STREAM)
    assert len(whole) == 13 + 11 + 2 + 2
    assert [x[4] for x in whole[:13]] == ["", "", 'a "" b\nc', "it's", 'x"y', "5", "5.25", "1.5e+3", "-2.e4", "true", "false", "z", "1"] and whole[12][5] == A + "kind"
    for size in (1, 2, 3, 5, 17, 64):
        monkeypatch.setattr(turtle_source, "CHUNK", size)
        assert turtle(STREAM) == whole
        assert [r for b in Turtle(STREAM).batches(2) for r in b] == whole


def test_turtle_holds_a_chunk_and_a_batch():
    total, longest, read = 0, 0, (f"<http://a/s{i}> <http://a/p> {', '.join(map(str, range(200)))} .\n" for i in range(3000))
    parser = Turtle(lambda size: next(read, ""))
    for batch in parser.batches(500):
        total, longest = total + len(batch), max(longest, len(batch), len(parser.text) // 10)
    assert total == 600_000 and longest < 1000


def test_turtle_files(spark, tmp_path):
    import gzip

    (tmp_path / "a.ttl").write_text(STREAM)
    (tmp_path / "b.ttl.gz").write_bytes(gzip.compress(STREAM.encode()))
    (tmp_path / "c.ttl").write_text("")
    got = [tuple(r) for r in read_turtle(spark, str(tmp_path)).orderBy("ordinal").collect()]
    assert sorted(got, key=repr) == sorted([(i, *row, None) for i, row in enumerate(turtle(STREAM), 1)] * 2, key=repr)
    (tmp_path / "d.ttl").write_text("<s> <p> <o>")
    with pytest.raises(PySparkException, match="expected '.'"):
        read_turtle(spark, str(tmp_path)).count()


def triples(spark, text):
    return parse_documents(spark.createDataFrame([(text,)], "value string"))


def test_folding(spark):
    simple = parse_statements(spark.createDataFrame([(1, f"<{A}s> <{A}p> <{A}o> ."), (2, f"<{A}s> <{A}q> <{A}o> .")], "n int, value string"), False, ordinal_col="n")
    assert {r._key for r in vertices(simple).collect()} == {key("rdf:iri", A + "s"), key("rdf:iri", A + "o")}
    got = edges(simple).collect()
    f, t = "nodes/" + key("rdf:iri", A + "s"), "nodes/" + key("rdf:iri", A + "o")
    assert {r._key for r in got} == {key("rdf:edge", f, A + x, t) for x in "pq"}

    named = triples(spark, f'<{A}s> <{A}name> "Alice" .')
    assert vertices(named).count() == 1 and edges(named).count() == 0
    assert vertices(named, Fold(literals="vertex-property")).first().properties == {A + "name": "Alice"}
    both = Fold(literals="materialize")
    assert {r._key for r in vertices(named, both).collect()} == {key("rdf:iri", A + "s"), key("rdf:literal", "Alice", "", "")} and edges(named, both).count() == 1

    rpt = triples(spark, f'<{A}s> <{A}p> _:b1 ; <{A}name> "Alice" .')
    fold = Fold(topology="rpt", vertices="g")
    assert sorted(r.collection for r in vertices(rpt, fold).collect()) == ["g_BNode", "g_Literal", "g_URIRef"] and edges(rpt, fold).count() == 2


def test_scopes_graphs_and_reload(spark):
    blank = triples(spark, "_:b1 <p> <o> .")
    one, two = (vertices(blank, Fold(scope=s)).where("blank_node").first() for s in ("source-a.nq", None))
    assert one._key == key("rdf:bnode", "source-a.nq", "u_b1") and two._key == key("rdf:bnode", "u_b1") and (one.scope, two.scope) == ("source-a.nq", None)
    lines = [f"<{A}s> <{A}p> <{A}o> <{A}g1> .", f"<{A}s> <{A}p> <{A}o> <{A}g2> .", f"<{A}s> <{A}p> <{A}o> ."]
    quads = parse_statements(spark.createDataFrame(list(enumerate(lines)), "n int, value string"), True, ordinal_col="n")
    kept = edges(quads, Fold(graphs="property")).collect()
    assert len({r._key for r in kept}) == 3 and {r.collection for r in kept} == {"links"}
    routed = {r.collection for r in edges(quads, Fold(graphs="collection")).collect()}
    slug = lambda g: "links_" + "".join(c if c.isascii() and c.isalnum() else "_" for c in g)[:48] + "_" + key("rdf:graph", g)[:8]
    assert routed == {"links", slug(A + "g1"), slug(A + "g2")}
    assert edges(quads).count() == 1 and tuple(summary(quads).first()) == (3, 2, 3)
    assert new_only(vertices(quads), vertices(quads)).count() == 0
