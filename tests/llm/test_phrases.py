"""Collocations against counting every phrase in plain Python."""

import random
import re
from collections import Counter, defaultdict

import numpy as np

from docgraph.llm import phrases
from docgraph.llm.phrases import collocations
from docgraph.llm.queries import QUERIES

SCHEMA = "doc_id long, lang string, text string, phrase int, shard int, a int"


def brute(rows, floor, top, percent=80):
    found = defaultdict(Counter)
    for lang, text in rows:
        low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            words = re.findall(r"[^\x20\x09]+", piece)
            for size in range(1, 5):
                for at in range(len(words) - size + 1):
                    found["und" if lang is None else lang][tuple(words[at : at + size])] += 1
    out = []
    for lang, f in found.items():
        n = sum(v for g, v in f.items() if len(g) == 1)
        candidates = {g: a for g, a in f.items() if len(g) > 1 and a >= floor}
        dropped = set()
        for g, a in candidates.items():
            for size in range(2, len(g)):
                dropped |= {s for at in range(len(g) - size + 1) if 100 * a >= percent * candidates[s := g[at : at + size]]}
        scored = []
        for g in candidates.keys() - dropped:
            score, _, left, right = min((2000000 * f[g] // (f[g[:k]] + f[g[k:]]), k, f[g[:k]], f[g[k:]]) for k in range(1, len(g)))
            scored.append((-score, -f[g], " ".join(g).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, le, r, n, -s) for i, (s, a, p, le, r) in enumerate(sorted(scored)[:top])]
    return sorted(out)


def got(df, **options):
    return sorted(tuple(r) for r in collocations(df, **options).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, size=400):
    r = random.Random(seed)
    words = ["a", "A", "b", "c", "de", "Éa", "éa", "x\x00y", "日本", "\x1c", "\x85", "_%", "\\"]
    ends = [" "] * 12 + [". ", ",", "\t", "\n", "  ", "?!", "\x0b", "\r\n", "; "]
    return [(r.choice(["en", "de", None, "", "und"]), "".join(r.choice(words) + r.choice(ends) for _ in range(r.randint(0, 40)))) for _ in range(size)]


def test_collocations_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(phrases, "SHARD_BYTES", 1500)  # in forked workers many shards; the result is the same anyhow
    rows = corpus(1) + [("en", None), ("en", ""), ("fr", " .,! "), ("en", "one two three four five. " * 40)] + [("de", "same same same same same")] * 50
    df = spark.createDataFrame([(i, *row, 0, 0, 0) for i, row in enumerate(rows)], SCHEMA)
    for floor, top in ((30, 2000), (2, 7)):
        for parts in (1, 5):
            assert got(df.repartition(parts), floor=floor, top=top) == brute(rows, floor, top)


def test_a_very_long_text_and_a_hot_language(spark):
    r = random.Random(2)
    long = " ".join(r.choice("abcdefgh") + r.choice("xyz") for _ in range(120_000))
    rows = [("en", long), *[("en", "the very same words again and again")] * 2000]
    df = spark.createDataFrame([(i, *row, 0, 0, 0) for i, row in enumerate(rows)], SCHEMA).repartition(3)
    assert got(df) == brute(rows, 30, 2000)


def test_no_rows(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert got(df) == [] and collocations(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]


def test_intervals_of_a_shard_are_all_its_phrases():
    words = phrases.Words()
    ids = np.array(phrases.word_ids(b"a b a b a. b a b, a", words), np.int32)
    order, rank, left = phrases.doubled(ids)
    heads, counts = phrases.intervals(phrases.common_words(ids, order, left, 2), left[order], 2)
    assert sorted(counts.tolist()) == [3, 3] and {tuple(ids[s : s + 2]) for s in order[heads]} == {(1, 2), (2, 1)}
    assert len(words) == 2 and rank.max() < len(ids)


def test_the_query_equals_brute_force_on_the_smallest_tables(spark):
    from conftest import DATA

    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    rows = [(r.lang, r.text) for r in docs.collect()]
    found = QUERIES["op13_phrase_collocations"](spark, str(DATA)).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, found.collect())) == brute(rows, 30, 2000)
