import hashlib
import random

import numpy as np

from docgraph.llm import suffix_dedup
from docgraph.llm.suffix_dedup import remove_repeated, repeated_spans

SCHEMA = "doc_id long, text string"


def brute(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = {}
    for t in data:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for t in data:
        gone = np.zeros(len(t) + 2, bool)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i + 1 : i + 1 + length] = True
        runs = int((np.diff(gone.astype(int)) == 1).sum())
        kept = bytes(b for b, g in zip(t, gone[1:]) if not g)
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, length):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdé") for _ in range(r.randint(1, 6)))
    base = [" ".join(word() for _ in range(r.randint(5, 300))) for _ in range(20)]
    texts = list(base) + base[:4] + base[:1] * 5
    for _ in range(25):
        a, b = r.choice(base), r.choice(base)
        i, j = r.randrange(len(a)), r.randrange(len(b))
        texts.append(a[i : i + r.randint(0, 2 * length)] + r.choice(["", "x", " "]) + b[j : j + r.randint(0, 2 * length)] + r.choice(["", a]))
    texts += [None, "", "a" * (3 * length), "ab" * (2 * length), "a" * (length + 7), "\0" * length + "q", "z" * length, "aé" * length, "b" * (length - 1)]
    return texts


def check(spark, texts, length):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(3)
    got = sorted(map(tuple, repeated_spans(df, length=length).digests().collect()))
    assert [g[1:] for g in got] == brute(texts, length)


def test_against_brute_force(spark):
    for seed, length in ((1, 200), (2, 40), (3, 16)):
        check(spark, corpus(seed, length), length)


def test_hot_buckets_are_counted_by_their_strings(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "HOT_BUCKET", 2)
    check(spark, corpus(4, 40), 40)


def test_long_texts_are_cut_into_overlapping_chunks(spark, monkeypatch):
    texts = corpus(5, 40)
    monkeypatch.setattr(suffix_dedup, "LONGEST_CHUNK", 64)
    parser = suffix_dedup._phrases(40)
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"rid": list(range(len(texts))), "bytes": [(t or "").encode() for t in texts]})
    strings = sum(sum(b.column("n").to_pylist()) for b in parser(iter([rows])))
    assert strings == sum(max(0, len((t or "").encode()) - 39) for t in texts)


def test_rows_keep_their_columns_and_clashing_names(spark):
    passage = "the same long passage of words " * 10
    rows = [(1, "alpha " + passage + " omega", "x", 5), (2, "beta " + passage + " psi", None, 6), (None, None, "y", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, rid string, bytes int")
    out = {r.doc_id: r for r in remove_repeated(df).collect()}
    assert out[1].text == "alphomega" and out[2].text == "betpsi"  # "a the same" is common to both
    assert out[2].rid is None and out[2].bytes == 6 and out[None].text == "" and out[None].rid == "y"
    assert remove_repeated(df.limit(0)).columns == df.columns and remove_repeated(df.limit(0)).count() == 0


def test_strings_that_polynomial_hashes_confuse(spark):
    """Thue-Morse words and their complements hash alike under any polynomial hash modulo 2^64."""
    import hashlib

    from docgraph.llm.suffix_dedup import repeated_spans

    word = "a"
    for _ in range(11):
        word += word.translate(str.maketrans("ab", "ba"))
    other = word.translate(str.maketrans("ab", "ba"))
    pad = ["".join(chr(97 + (i * i * k) % 23) for i in range(150)) for k in (3, 5, 7, 11)]
    texts = [pad[0] + word[:1024] + pad[1], pad[2] + other[:1024] + pad[3], word[:1024], "x" + other]
    data = [t.encode() for t in texts]
    seen = {}
    for d in data:
        for i in range(len(d) - 199):
            seen[d[i : i + 200]] = seen.get(d[i : i + 200], 0) + 1
    want = {}
    for k, d in enumerate(data):
        gone = bytearray(len(d))
        for i in range(len(d) - 199):
            if seen[d[i : i + 200]] > 1:
                gone[i : i + 200] = b"\1" * 200
        want[k] = hashlib.sha256(bytes(c for c, g in zip(d, gone) if not g)).hexdigest()
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    assert {r.doc_id: r.kept_sha256 for r in repeated_spans(df).digests().collect()} == want


def test_runs_of_one_letter_and_of_a_row(spark):
    """Every byte of a run opens a phrase of its own; the block keeps two of each and one span for the others."""
    row = "".join(chr(97 + (i * i) % 19) for i in range(50))
    check(spark, ["a" * 9000, "b" + "a" * 5000 + "c", "x" * 30 + "a" * 180, "a" * 39, row * 60, "q" + row * 40, row + "a" * 200], 200)
    check(spark, ["a" * 900, "b" + "a" * 500 + "c", "x" * 30 + "a" * 38, row * 9, "q" + row * 7, row + "a" * 41], 40)
    import pyarrow as pa

    rows = pa.RecordBatch.from_pydict({"rid": [1, 2], "bytes": [b"a" * 1_000_000, b"b" + row.encode() * 20_000]})
    out = list(suffix_dedup._phrases(200)(iter([rows])))
    assert sum(b.num_rows for b in out) < 1000
    assert sum(sum(b.column("n").to_pylist()) for b in out) == 1_000_000 - 199 + 1_000_001 - 199


def test_the_join_of_a_hot_trigger_is_split(spark, monkeypatch):
    """One passage of 40 bytes in many texts: its trigger has as many distinct phrases."""
    r = random.Random(3)
    passage = "the one passage that all these texts do hold"
    word = lambda n: "".join(r.choice("abcdefgh ") for _ in range(n))
    texts = [word(20) + passage + word(20) for _ in range(6000)] + [word(90) for _ in range(600)]
    settings = {
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "16",
    }
    plans, save = [], suffix_dedup.save

    def noted(df, name):
        if name == "dictionary":
            df.collect()
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return save(df, name)

    monkeypatch.setattr(suffix_dedup, "save", noted)
    before = {k: spark.conf.get(k, None) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    try:
        check(spark, texts, 40)
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "skew=true" in plans[0]


def test_no_table_stays_in_the_catalog(spark):
    df = spark.createDataFrame([(1, "abcdefgh" * 60), (2, "abcdefgh" * 60), (3, "x")], "doc_id long, text string")
    found = repeated_spans(df)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("docgraph_texts")]
    assert {r.doc_id: r.n_removed for r in found.digests().collect()} == {1: 480, 2: 480, 3: 0}
    assert "SelectedBucketsCount" in found.digests()._jdf.queryExecution().toString()


def test_a_bucket_may_begin_with_a_batch_and_fill_the_next():
    """Two whole batches of one trigger, behind a batch of others: the strings that the two share are found across them."""
    import pyarrow as pa

    def batch(first, triggers):
        texts = [b"%08d" % (first + k) for k in range(2000)]
        if first == 4000:
            texts[7] = b"%08d" % 2003
        columns = [range(first, first + 2000), [0] * 2000, [1] * 2000, [2] * 2000, triggers, [True] * 2000, texts]
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["rid", "lo", "n", "dist", "trig", "once", "bytes"])

    batches = [batch(0, list(range(2000))), batch(2000, [5000] * 2000), batch(4000, [5000] * 2000)]
    found = [r for b in suffix_dedup._suffix_order(8)(iter(batches)) for r in b.to_pylist()]
    assert sorted(r["rid"] for r in found) == [2003, 4007]
