import itertools

import pyarrow as pa
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Observation

from docgraph.operators import batching, edges, upsert
from docgraph.options import OptionError

EDGE = "_from string, _to string"


def run(spark, rows, **prefixes):
    seen = Observation()
    out = edges.preflight(spark.createDataFrame(rows, EDGE), observation=seen, **prefixes).collect()
    return [(r._from, r._to) for r in out], seen.get["skipped_no_edge"]


def test_kept_and_skipped(spark):
    assert run(spark, [("orders/1", "customers/5"), ("orders/2", ""), ("orders/3", "customers/7")]) == ([("orders/1", "customers/5"), ("orders/3", "customers/7")], 1)
    assert run(spark, [("orders/1", None)]) == ([], 1)
    assert run(spark, [("alice", "bob")], from_prefix="people", to_prefix="people") == ([("people/alice", "people/bob")], 0)
    assert run(spark, [("a/1", "bob")], to_prefix="p") == ([("a/1", "p/bob")], 0)


def test_fatal(spark):
    for rows, prefixes, what in (([("alice", "bob")], {"from_prefix": "people"}, "_to"), ([("orders/1", "5")], {}, "_to"), ([("", "5")], {}, "_to"), ([("x", "")], {}, "_from")):
        with pytest.raises(PySparkException, match=f"{what}: is not a fully-qualified document id"):
            run(spark, rows, **prefixes)


def test_error_names_the_row(spark):
    df = spark.createDataFrame([(7, "bare", "a/1")], "ordinal int, _from string, _to string")
    with pytest.raises(PySparkException, match="row 7: _from"):
        edges.preflight(df).collect()


def test_json_documents(spark):
    docs = ['{"_from":"a/1","_to":"b/2"}', '{"_from":"a/1"}', '{"_from":"a/1","_to":null}', '{"_from":42,"_to":"b/1"}', "[1]", "nonsense", '{"_from":null,"_to":"bare"}']
    got = [r.edge_class for r in edges.classify_documents(spark.createDataFrame([(d,) for d in docs], "doc string")).collect()]
    assert got == ["present", "_to: edge document is missing '_to'", "skip", "_from: must be a string", "is not an object", "is not an object", "_to: is not a fully-qualified document id"]


def one_range(rule, lengths, first):
    """Labels of rows that are one range, from a fresh start."""
    n = len(lengths)
    rows = pa.table({"__range": [0] * n, "__place": list(range(n)), "__length": list(lengths), "__start": [False] * n})
    state = pa.table({"size": [rule.framing], "docs": [0], "cuts": [first]})
    return batching._label(rule)((0,), rows, state)["__label"].to_pylist()


def test_import_batches(spark):
    def indices(lengths, **limits):
        return one_range(batching.import_batches(**limits), lengths, 1)

    assert indices([7, 7, 7], max_bytes=1000, max_docs=2) == [1, 1, 2]
    assert indices([7, 7, 7], max_bytes=10, max_docs=100) == [1, 2, 3]
    assert indices([4, 1000], max_bytes=16, max_docs=100) == [1, 2]
    assert max(indices([9] * 100, max_bytes=1 << 20, max_docs=7)) == 15
    df = spark.createDataFrame([(i, "x" * (i % 5)) for i in range(40)], "ordinal long, doc string").repartition(3)
    got = {r.ordinal: r.batch_index for r in batching.assign_batches(df, max_bytes=12, max_docs=4).collect()}
    assert [got[i] for i in range(40)] == indices([i % 5 for i in range(40)], max_bytes=12, max_docs=4)
    with pytest.raises(OptionError):
        batching.check_batching(10, 5, 1)
    with pytest.raises(OptionError):
        batching.check_batching(1, 5, 0)


def test_export_parts_cut_after_the_threshold():
    assert one_range(batching.export_parts(10, framing=2), (3, 3, 20, 1, 1, 1), 0) == [0, 0, 1, 2, 2, 2]


def test_streams_are_cut_apart(spark):
    df = spark.createDataFrame([(s, i, "abcd") for s in "ab" for i in range(6)], "s string, ordinal long, doc string")
    got = {(r.s, r.ordinal): r.batch_index for r in batching.assign_batches(df, max_docs=4, stream="s").collect()}
    assert all(got[s, i] == i // 4 + 1 for s in "ab" for i in range(6))


def test_duplicate_modes(spark):
    stored = spark.createDataFrame([("a", 1, "old"), ("b", 2, "old")], "_key string, n int, t string")
    new = spark.createDataFrame([("b", 3, None), ("c", 4, "x"), ("c", 5, None)], "_key string, n int, t string")

    def after(mode):
        return {r._key: (r.n, r.t) for r in upsert.upsert(stored, new, ["_key"], ["n"], mode).collect()}

    assert after("ignore") == after("error") == {"a": (1, "old"), "b": (2, "old"), "c": (4, "x")}
    assert after("replace") == {"a": (1, "old"), "b": (3, None), "c": (5, None)}
    assert after("update") == {"a": (1, "old"), "b": (3, "old"), "c": (5, "x")}
    count = lambda mode: tuple(upsert.load_counts(stored, new, ["_key"], mode).first())
    assert count("error") == (1, 0, 0, 2) and count("ignore") == (1, 0, 2, 0) and count("replace") == (1, 2, 0, 0)
    with pytest.raises(ValueError):
        upsert.upsert(stored, new, ["_key"], ["n"], "other")


def test_checkpoint_is_the_contiguous_prefix(spark):
    for done in itertools.permutations(range(1, 4)):
        for k in range(4):
            finished = set(done[:k])
            expected = max((n for n in range(4) if set(range(1, n + 1)) <= finished), default=0)
            df = spark.createDataFrame([(x,) for x in finished], "batch_index long")
            assert upsert.contiguous_prefix(df).first()[0] == expected
