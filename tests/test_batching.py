"""Parallel cuts against one pass over the rows."""

import random

import pytest

from docgraph.operators import batching


def batches(lengths, max_bytes, max_docs):
    out, index, size, docs = [], 1, 0, 0
    for n in lengths:
        if docs and (size + n + 1 > max_bytes or docs >= max_docs):
            index, size, docs = index + 1, 0, 0
        size, docs = size + n + 1, docs + 1
        out.append(index)
    return out


def parts(lengths, threshold, framing):
    out, index, size = [], 0, framing
    for n in lengths:
        out.append(index)
        size += n + 1
        if size >= max(1, threshold):
            index, size = index + 1, framing
    return out


def frame(spark, lengths, ranges):
    rows = [(k, "x" * n if n else None, k % 7, k) for k, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "ordinal long, doc string, payload int, __label long").repartition(ranges)


@pytest.fixture
def many_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "23")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def shapes():
    r = random.Random(7)
    yield [r.choice((0, 1, 5, 30)) for _ in range(700)]
    yield [9] * 500  # never falls into step by itself
    yield [0] * 300 + [500] * 3 + [2] * 300
    yield [4]
    yield [300, 1, 1, 300, 300, 1]


def test_cuts_equal_one_pass(spark, many_ranges, monkeypatch):
    for k, lengths in enumerate(shapes()):
        monkeypatch.setattr(batching, "FAN", 4 if k < 2 else 32)
        df = frame(spark, lengths, 3).drop("__label")
        max_bytes, max_docs = ((100, 7), (60, 1000), (1 << 20, 11), (2, 1), (40, 3))[k]
        got = {x.ordinal: (x.batch_index, x.payload) for x in batching.assign_batches(df, max_bytes=max_bytes, max_docs=max_docs).collect()}
        assert got == {i: (b, i % 7) for i, b in enumerate(batches(lengths, max_bytes, max_docs))}
        threshold, framing = ((100, 0), (50, 13), (10, 10), (1, 40), (64, 5))[k]
        got = {x.ordinal: x.part for x in batching.assign_parts(df, part_bytes=threshold, framing=framing).collect()}
        assert got == dict(enumerate(parts(lengths, threshold, framing)))


def test_streams_are_cut_by_themselves(spark, many_ranges):
    r = random.Random(3)
    rows = [(s, k, "y" * r.choice((0, 3, 20))) for s, n in (("a", 200), ("b", 1), ("c", 90), (None, 40)) for k in range(n)]
    df = spark.createDataFrame(rows, "s string, ordinal long, doc string").repartition(4)
    got = {(x.s, x.ordinal): (x.batch_index, x.doc) for x in batching.assign_batches(df, max_bytes=60, max_docs=9, stream="s").collect()}
    want = {}
    for stream in ("a", "b", "c", None):
        own = [x for x in rows if x[0] == stream]
        want |= {x[:2]: (b, x[2]) for x, b in zip(own, batches([len(x[2]) for x in own], 60, 9))}
    assert got == want


def test_summaries_compose_to_the_summary_of_the_whole():
    import numpy as np

    r = random.Random(5)
    for rule in (batching.import_batches(50, 6), batching.export_parts(40, 5)):
        for _ in range(50):
            lengths = np.array([r.choice((0, 2, 9, 70)) for _ in range(r.randint(1, 60))])
            cuts = sorted({0, len(lengths), *(r.randrange(len(lengths)) for _ in range(4))})
            starts = np.zeros(len(lengths), bool)
            runs = [batching.summarise(rule, lengths[a:b], starts[a:b]) for a, b in zip(cuts, cuts[1:])]
            whole, joined = batching.summarise(rule, lengths, starts), batching.compose(rule, runs)
            for size, docs in ((rule.framing, 0), (rule.framing + 1, 1), (rule.framing + 30, 3)):
                a, b = (x.through(rule, np.array([size]), np.array([docs])) for x in (whole, joined))
                assert [int(x[0]) for x in a] == [int(x[0]) for x in b]


def test_no_rows(spark):
    df = spark.createDataFrame([], "ordinal long, doc string, payload int")
    assert batching.assign_batches(df).collect() == [] and batching.docs_only_batches(df).collect() == []


def test_batches_by_number_keep_every_row_with_its_payload(spark):
    old = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "16k")
    try:
        rows = spark.range(400_000).selectExpr("(id * 7919) % 400000 AS ordinal", "repeat('p', cast(id % 30 AS int)) AS doc", "id AS payload")
        got = batching.docs_only_batches(rows, max_docs=700)
        bad = got.where("batch_index <> ordinal div 700 + 1 OR (payload * 7919) % 400000 <> ordinal OR length(doc) <> payload % 30")
        assert got.selectExpr("count(doc) AS n", "count(DISTINCT ordinal) AS d").first().asDict() == {"n": 400_000, "d": 400_000}
        assert bad.isEmpty()
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", old)
