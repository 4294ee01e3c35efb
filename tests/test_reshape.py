import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from docgraph.functions import cells
from docgraph.operators.reshape import refuse_reshape, to_documents, typed_cells
from docgraph.options import OptionError, Reshape, parse_datatype, parse_merge, parse_translate


def docs(spark, header, values, **options):
    df = spark.createDataFrame([values], ", ".join(f"`{h}` string" for h in header))
    return to_documents(typed_cells(df, Reshape(**options))).first().doc


CASES = [
    (("s", "i", "f", "b", "empty"), ("x", "42", "3.5", "true", ""), {}, {"s": "x", "i": 42, "f": 3.5, "b": True, "empty": None}),
    (("zip",), ("00123",), {}, {"zip": "00123"}),
    (("name", "note"), ("a,b", "line1\nline2"), {}, {"name": "a,b", "note": "line1\nline2"}),
    (("_key", "_from", "_to", "n"), ("12345", "100", "200", "7"), {}, {"_key": "12345", "_from": "100", "_to": "200", "n": 7}),
    (("id", "name"), ("12345", "alice"), {"translate": ("id=_key",)}, {"_key": "12345", "name": "alice"}),
    (("a", "b", "c"), ("42", "1", "x"), {"datatypes": ("a=string", "b=boolean")}, {"a": "42", "b": True, "c": "x"}),
    (("id", "fk"), ("1003", "00042"), {"datatypes": ("fk=number",)}, {"id": 1003, "fk": 42}),
    (("a", "b"), ("1", "2"), {"remove": ("b",)}, {"a": 1}),
    (("id", "name"), ("7", "alice"), {"translate": ("id=ident",), "merge": ("_key=[id]_[name]",)}, {"ident": 7, "name": "alice", "_key": "7_alice"}),
    (("a", "b"), ("12345", "alice"), {"merge": ("_key=x[a]_[b]y",), "remove": ("a", "b")}, {"_key": "x12345_alicey"}),
    (("a",), ("x",), {"merge": ("_key=[a][missing]",)}, {"a": "x", "_key": "x"}),
    (("id",), ("00789",), {"datatypes": ("id=string",), "merge": ("_key=[id]",)}, {"id": "00789", "_key": "00789"}),
    (("a",), (None,), {}, {}),
    (("q",), ('say "hi" \\ \t é😀',), {}, {"q": 'say "hi" \\ \t é😀'}),
]


@pytest.mark.parametrize("header,values,options,expected", CASES)
def test_rows(spark, header, values, options, expected):
    text = docs(spark, header, values, **options)
    assert json.loads(text) == expected and list(json.loads(text)) == sorted(expected)


def test_numbers_keep_their_kind(spark):
    tokens = ["42", "-0", "+7", "3.5", "1e5", "1e16", "1.5e300", "0.00001", "1e-7", "9223372036854775808", "5\n", " 5 ", "1d", "0x10", "Infinity", "007", "00.5", "-012", "0.5", "1e400"]
    df = spark.createDataFrame([(t,) for t in tokens], "v string")
    got = {r.v: (r.c.t, r.c.s) for r in df.select("v", cells.infer_cell(F.col("v")).alias("c")).collect()}
    assert got["42"] == ("int", "42") and got["+7"] == ("int", "7") and got["1e5"] == ("float", "100000.0")
    assert got["1e16"] == ("float", "1e16") and got["0.00001"] == ("float", "0.00001") and got["1e-7"] == ("float", "1e-7") and got["1.5e300"] == ("float", "1.5e300")
    assert got["9223372036854775808"] == ("float", "9.223372036854776e18")
    assert all(got[t] == ("str", t) for t in ("5\n", " 5 ", "1d", "0x10", "Infinity", "007", "00.5", "-012", "1e400"))


def test_bad_datatype_is_fatal(spark):
    with pytest.raises(PySparkException, match="column 'a' value 'not-a-number' is not a valid number.*--datatype a=number"):
        docs(spark, ("a",), ("not-a-number",), datatypes=("a=number",))
    assert json.loads(docs(spark, ("a", "b"), ("", ""), datatypes=("a=number", "b=string"))) == {"a": None, "b": ""}


@pytest.mark.parametrize("parse,spec", [
    (parse_datatype, "idstring"), (parse_datatype, "id=date"), (parse_translate, "id"), (parse_translate, "id="), (parse_merge, "_key=plain"), (parse_merge, "_key=[unclosed"), (parse_merge, "_key=[]"),
])
def test_bad_specs(parse, spec):
    with pytest.raises(OptionError):
        parse(spec)


def test_reshape_needs_a_delimited_format():
    with pytest.raises(OptionError):
        refuse_reshape("jsonl", Reshape(remove=("a",)))
    refuse_reshape("csv", Reshape(remove=("a",)))


def test_formula_guard(spark):
    df = spark.createDataFrame([(t,) for t in ("=SUM(A1)", "-5", "+x", "@x", "\tx", "\rx", "x=", "")], "v string")
    got = [r[0] for r in df.select(cells.guarded_csv(F.col("v"))).collect()]
    assert got == ["'=SUM(A1)", "'-5", "'+x", "'@x", "'\tx", "'\rx", "x=", ""]
