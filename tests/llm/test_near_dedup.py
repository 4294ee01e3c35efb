"""The stage's links against brute force on five-word shingles."""

import random

import corpus_pipeline


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_similar_pairs_are_dropped_and_others_stay(spark, tmp_path):
    r = random.Random(5)
    words = ["w%d" % k for k in range(900)]
    docs = []
    for base in range(60):
        text = [r.choice(words) for _ in range(r.choice((14, 40, 90, 300)))]
        docs.append(" ".join(text))
        for _ in range(3):  # from one edit to so many that similarity falls well below 0.8
            copy = list(text)
            for _ in range(r.randint(1, max(1, len(text) // 40))):
                copy[r.randrange(len(copy))] = r.choice(words)
            docs.append(" ".join(copy))
    hub = [r.choice(words) for _ in range(120)]
    for k in range(40):  # a hot group: all near the hub, many pairs under 0.8
        copy = list(hub)
        copy[r.randrange(120)] = "a%d" % k
        copy[r.randrange(120)] = "b%d" % k
        docs.append(" ".join(copy))
    docs += [" ".join(hub), "", None, " \n"]
    rows = list(enumerate(docs))
    sets = [shingles(t) for t in docs]
    group = list(range(len(docs)))
    for a in range(len(docs)):
        for b in range(a):
            either = sets[a] | sets[b]
            if (not either or len(sets[a] & sets[b]) >= 0.8 * len(either)) and group[a] != group[b]:
                old, new = group[a], group[b]
                group = [new if g == old else g for g in group]
    want = sorted({min(i for i, g in enumerate(group) if g == h) for h in group})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(x.doc_id for x in corpus_pipeline.simhash_near_dedup(spark, df, str(tmp_path)).collect())
    assert got == want and len(docs) - len(want) > 60
