"""Components of similar documents against comparing all pairs in plain Python."""

import random
import re

import numpy as np
import pytest

from docgraph.llm import minhash, similarity
from docgraph.llm.minhash import minhash_components
from docgraph.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, node int, key int, n int, row int"


def brute(rows, size=2, percent=80):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        sets.append({tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set())
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common and 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    out = []
    for k, (i, _) in enumerate(rows):
        least = min((rows[j][0] for j in range(len(rows)) if group[j] == group[k] and rows[j][0] is not None), default=None)
        out.append((i, len(sets[k]), least, i is not None and i == least))
    return sorted(out, key=repr)


def got(spark, rows, parts=3, **options):
    df = spark.createDataFrame([(*r, 0, 0, 0, 0) for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, minhash_components(df, **options).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def families(seed):
    r = random.Random(seed)
    words = ["w%d" % k for k in range(700)]
    docs = []
    for _ in range(25):
        text = [r.choice(words) for _ in range(r.choice((3, 9, 30, 90, 200)))]
        docs.append(" ".join(text))
        for _ in range(3):  # from one edit to so many that similarity falls well below 0.8
            copy = list(text)
            for _ in range(r.randint(1, max(1, len(text) // 16))):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append(" ".join(copy))
    for edits, with_hub in ((3, True), (8, True), (5, False)):  # hot groups around a hub, some of which is itself missing
        hub = [r.choice(words) for _ in range(100)]
        docs += [" ".join(hub)] * with_hub
        for k in range(30):
            copy = list(hub)
            for e in range(edits):
                copy[r.randrange(100)] = "x%d.%d" % (k, e)
            docs.append(" ".join(copy))
    chain = [r.choice(words) for _ in range(60)]
    for k in range(20):  # each is near the one before it alone
        chain = chain[2:] + ["c%d" % k, "d%d" % k]
        docs.append(" ".join(chain).upper())
    docs += ["", None, " \n", "one", "ONE", "one two", "one  two", "two one", "Éa b", "éa b", "a\x85b c"]
    return list(enumerate(docs)) + [(None, docs[0]), (7, docs[7]), (7, docs[7]), (None, "alone without an id")]


@pytest.mark.parametrize("rounds", [1, 4])
def test_components_equal_brute_force(spark, monkeypatch, rounds):
    monkeypatch.setattr(similarity, "ROUNDS", rounds)
    rows = families(rounds)
    assert got(spark, rows) == brute(rows)


def test_other_shingles_and_similarity(spark):
    rows = families(9)[:150]
    assert got(spark, rows, words=3, percent=90) == brute(rows, 3, 90)


def test_many_copies_one_long_text_and_no_rows(spark):
    r = random.Random(1)
    long = " ".join(r.choice("abcdefghij") + str(r.randrange(40)) for _ in range(100_000))
    rows = [(5, long), (6, long + " tail"), *[(100 + k, "the very same text in many rows") for k in range(3000)]]
    found = got(spark, rows)
    words = long.split()
    size = len(set(zip(words, words[1:])))
    assert {x for x in found if x[0] < 100} == {(5, size, 5, True), (6, size + 1, 5, False)}
    assert sum(x[3] for x in found) == 2 and {x[2] for x in found if x[0] >= 100} == {100}
    assert got(spark, []) == []


def test_a_signature_is_one_table_shifted():
    hashes = np.sort(np.random.default_rng(3).integers(0, 2**64, 3000, np.uint64))
    table = np.random.default_rng(minhash.SEED).permutation(1 << minhash.CIRCLE_BITS)
    places = minhash._places()[(hashes >> np.uint64(64 - minhash.CIRCLE_BITS)).astype(np.int64)]
    want = [table[(places + k) % len(table)].min() for k in range(minhash.BANDS * minhash.BAND_ROWS)]
    assert minhash.signature(hashes).tolist() == want


def test_agreement_of_signatures_estimates_similarity():
    r = np.random.default_rng(4)
    base = r.integers(0, 2**64, 1000, np.uint64)
    for share in (0.2, 0.5, 0.8):
        same = np.mean([
            np.mean(minhash.signature(np.unique(np.append(base[: int(2000 * share / (1 + share))], r.integers(0, 2**64, 1000 - int(2000 * share / (1 + share)), np.uint64)))) == minhash.signature(base))
            for _ in range(8)
        ])
        assert abs(same - share) < 0.08


def test_the_query_equals_brute_force_on_the_smallest_tables(spark):
    from conftest import DATA

    rows = [(r.doc_id, r.text) for r in spark.read.parquet(str(DATA / "documents.parquet")).collect()]
    found = QUERIES["op11_circulant_minhash"](spark, str(DATA)).select("doc_id", "n_shingles", "component_id", "kept")
    assert sorted(map(tuple, found.collect()), key=repr) == brute(rows)
