import math
import random
import re
import zlib

import numpy as np
import time

from docgraph.llm.queries import op2_toxic_segments
from docgraph.llm.toxicity import drop_toxic, fit, maximal_segments, score_toxicity, toxic_passages


def brute_segments(scores):
    """Maximal segments by definition: best of the whole, then of what lies left and right of it."""
    out = []

    def split(a, b):
        best = None
        for i in range(a, b):
            total = 0
            for j in range(i, b):
                total += scores[j]
                if total > 1e-12 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and j - i < best[1] - best[0])):
                    best = (i, j, total)
        if best:
            split(a, best[0])
            out.append(best)
            split(best[1] + 1, b)

    split(0, len(scores))
    return out


def test_maximal_segments_against_their_definition():
    r = random.Random(1)
    for _ in range(200):
        hits = {i: r.choice([0.7, 1.3, 2.9]) + r.random() / 100 for i in range(40) if r.random() < 0.25}
        scores = [hits.get(i, -0.41) for i in range(40)]
        got = maximal_segments(sorted(hits.items()), -0.41)
        want = brute_segments(scores)
        assert [(a, b) for a, b, _ in got] == [(a, b) for a, b, _ in want]
        assert all(abs(x[2] - y[2]) < 1e-9 for x, y in zip(got, want))


def test_a_very_long_text_of_isolated_hits_is_scanned_once():
    hits = [(10 * k, 1.0 + (k % 7) / 10) for k in range(200_000)]
    began = time.time()
    found = maximal_segments(hits, -0.25)
    assert time.time() - began < 5 and len(found) == 200_000
    began = time.time()
    rising = maximal_segments([(10 * k, 2.4) for k in range(200_000)] + [(2_000_000, 1e7)], -0.25)
    assert time.time() - began < 5 and len(rising) == 1 and rising[0][:2] == (0, 2_000_000)  # the last hit outweighs all before it


def corpus(n=600):
    r = random.Random(8)
    words = ["w" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(800)]
    bad = ["vile", "rotten", "filthy", "nasty"]
    docs, labels = [], []
    for i in range(n):
        text = [r.choice(words) for _ in range(r.randint(20, 200))]
        toxic = int(i % 6 == 0)
        if toxic:
            for _ in range(4):
                text[r.randrange(len(text))] = r.choice(bad)
        docs.append((i, " ".join(text), "en"))
        labels.append((i, toxic))
    return docs, labels


def test_held_out_accuracy_passages_and_edges(spark):
    docs, labels = corpus()
    docs += [(9000, None, None), (9001, "", None), (None, "vile words", "x"), (9002, "a vile, rotten thing " * 3, "x"), (9002, "a vile, rotten thing " * 3, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score string")
    lab = spark.createDataFrame([(i, 1 if i is None else 0, t) for i, t in labels] + [(5, 0, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    model = fit(df, lab)
    truth = dict(labels)
    out = score_toxicity(df, model).collect()
    assert len(out) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in out)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert len(held) > 100 and sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    by_id = {r.doc_id: r for r in out}
    assert by_id[9000].predicted == by_id[9001].predicted == 0 and by_id[9002].predicted == 1
    found = [r for r in toxic_passages(df, model).collect() if r.doc_id == 9002]
    assert found and all("vile" in r.passage for r in found)
    kept = drop_toxic(df, model)
    assert kept.columns == df.columns and {9000, 9001} <= {r.doc_id for r in kept.collect()} and kept.where("doc_id = 9002").count() == 0


def plain_model(docs, labels):
    """The fit in plain Python, for labels of which each id bears one and texts of which none are near copies."""
    words = {i: re.findall(r"[^\W\d_]+", (t or "").lower()) for i, t in docs}
    train = {i: y for i, y in labels.items() if zlib.crc32(str(i).encode()) % 3 != 1 and i in words}
    of = [[set(words[i]) for i, y in train.items() if y == k] for k in (0, 1)]
    clean, toxic = map(len, of)
    held = {w: [sum(w in d for d in of[k]) for k in (0, 1)] for w in set().union(*of[1])}
    lead = {w: c for w, c in held.items() if c[1] >= 2 and c[1] / toxic > c[0] / clean}

    def ratio(c):
        both, total = c[0] + c[1], 0.0
        for seen, n in ((c[0], clean), (c[1], toxic)):
            for x, share in ((seen, both / (clean + toxic)), (n - seen, 1 - both / (clean + toxic))):
                total += x * math.log(x / (n * share)) if x else 0.0
        return math.sqrt(max(0.0, 2 * total))

    least = math.sqrt(2 * math.log(len(lead) + 2))
    every = {w: sum(w in set(d) for d in words.values()) for w in lead}
    clean_words = sum(len(words[i]) for i, y in train.items() if y == 0)
    scores, shares = {}, {}
    for w, c in lead.items():
        prior = toxic * every[w] / len(docs)
        a, b = c[1] + prior, c[0] + prior
        odds = math.log(a / (2 * toxic - a)) - math.log(b / (clean + toxic - b)) if a < 2 * toxic else 10.0
        if ratio(c) > least and odds >= 1:
            scores[w], shares[w] = odds, (c[0] + min(prior, 0.5)) / clean_words
    law = lambda x: sum(p * math.exp(x * scores[w]) for w, p in shares.items()) + (1 - sum(shares.values())) * math.exp(-0.25 * x) - 1
    low, high = 1e-6, 20.0
    for _ in range(200):
        low, high = (low, (low + high) / 2) if law((low + high) / 2) > 0 else ((low + high) / 2, high)

    def segments(i):
        return brute_segments([scores.get(w, -0.25) for w in words[i]]) if any(w in scores for w in words[i]) else []

    background = [i for i, y in train.items() if y == 0]
    rate = (sum(len(segments(i)) for i in background) + 0.5) / clean_words

    def log_evidence(i):
        found = [low * s - math.log(rate * len(words[i])) for _, _, s in segments(i)]
        return math.log1p(sum(x for x in found if x >= -math.log(0.1)))

    x = np.array([round(log_evidence(i) * 1000) / 1000 for i in train])
    y = np.array(list(train.values()), float)
    scale, w = x.std(), np.zeros(2)
    for _ in range(20_000):  # gradient ascent, where the model takes Newton's steps
        p = 1 / (1 + np.exp(-(w[0] * x / scale + w[1])))
        w += 2 * np.array([((y - p) * x / scale).mean() - 1e-4 * w[0], (y - p).mean() - 1e-4 * w[1]])
    return {i: 1 / (1 + math.exp(-(w[0] / scale * log_evidence(i) + w[1]))) for i in words}, scores


def test_the_fit_and_the_scores_against_plain_python(spark, tmp_path):
    docs, labels = corpus(240)
    docs = [(i, " ".join(t.split()[:60] + t.split()[-5:]), s) for i, t, s in docs]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want, scores = plain_model([(i, t) for i, t, _ in docs], dict(labels))
    assert {"vile", "rotten", "filthy", "nasty"} & scores.keys()
    got = {r.doc_id: r.score for r in op2_toxic_segments(spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in got) < 1e-3
    assert len({round(v, 3) for v in got.values()}) > 3


def test_no_labels_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert score_toxicity(docs, fit(docs, none)).first().predicted == 0
    assert score_toxicity(docs.limit(0), fit(docs.limit(0), none)).count() == 0
