"""The pipeline against brute force, stage by stage, on a small corpus."""

import random

import corpus_pipeline
from test_exact_dedup import SPACE
from test_near_dedup import shingles

BAD = ["vile", "rotten", "filthy", "nasty"]


def corpus(tmp_path, spark):
    r = random.Random(12)
    words = ["w" + "".join(r.choice("abcdefgh") for _ in range(4)) for _ in range(500)]
    text = lambda n: " ".join(r.choice(words) for _ in range(n))
    passage = text(60)
    docs, labels = [], []
    for i in range(240):
        t = text(r.randint(5, 150))
        if i % 6 == 0:
            t += " " + " ".join(r.choice(BAD) + " " + text(3) for _ in range(5))
        if i % 10 == 1:
            t += "\n" + passage
        docs.append((i, t, "en", "src0", len(t)))
        labels.append((i, 1, int(i % 6 == 0)))
    docs += [(300 + k, docs[k * 7 + 2][1] + " " * k, "en", "src1", 1) for k in range(20)]
    docs += [(400, None, None, None, None), (401, "", "en", "src1", 0), (402, " \n", "en", "src1", 2), (None, "no id here", "en", None, 10), (403, "no id  here", "en", "s", 11)]
    near = docs[3][1].split(" ")
    docs += [(500 + k, " ".join(near[:-1] + ["end%d" % k]), "en", "src2", 5) for k in range(5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(docs, schema).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return str(tmp_path)


def norm(t):
    return (t or "").translate({ord(c): None for c in SPACE})


def test_each_stage_works_on_what_the_one_before_kept(spark, tmp_path):
    folder = corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for number, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs.collect()
        out = stage(spark, docs, folder)
        if number < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
            out.write.parquet(f"{folder}/{number}")
            docs = spark.read.parquet(f"{folder}/{number}")
        after = (docs if number < 4 else out).collect()
        if name == "toxicity":
            toxic = {r for r in before if set((r.text or "").split()) & set(BAD)}
            assert set(before) - set(after) == toxic
        elif name == "exact_dedup":
            best = {}
            for r in before:
                rank = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
                best.setdefault(norm(r.text), []).append((rank, r))
            assert sorted(after, key=repr) == sorted((min(v, key=lambda x: x[0])[1] for v in best.values()), key=repr)
        elif name == "simhash_near_dedup":
            sets = [shingles(r.text) for r in before]
            group = list(range(len(before)))
            for a in range(len(before)):
                for b in range(a):
                    either = sets[a] | sets[b]
                    if (not either or len(sets[a] & sets[b]) >= 0.8 * len(either)) and group[a] != group[b]:
                        old, new = group[a], group[b]
                        group = [new if g == old else g for g in group]
            best = {}
            for g, r in zip(group, before):
                best.setdefault(g, []).append(((r.doc_id is None, r.doc_id or 0), r))
            assert sorted(after, key=repr) == sorted((min(v, key=lambda x: x[0])[1] for v in best.values()), key=repr)
        elif name == "suffix_dedup":
            seen = {}
            data = {r: (r.text or "").encode() for r in before}
            for t in data.values():
                for i in range(len(t) - 199):
                    seen[t[i : i + 200]] = seen.get(t[i : i + 200], 0) + 1
            want = []
            for r, t in data.items():
                gone = bytearray(len(t))
                for i in range(len(t) - 199):
                    if seen[t[i : i + 200]] > 1:
                        gone[i : i + 200] = b"\1" * 200
                want.append((r.doc_id, bytes(c for c, g in zip(t, gone) if not g).decode("utf-8", "ignore")))
            assert sorted(((r.doc_id, r.text) for r in after), key=repr) == sorted(want, key=repr)
            assert all(r.n_chars == len(r.text) for r in after) and len({t for _, t in want}) > 100
        else:
            assert {r.doc_id for r in after} == {r.doc_id for r in before}
            assert sum(r.length for r in after) == sum(r.doc_tokens for r in after if r.start == 0)
    lengths = sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in after if r.start == 0)
    whole = corpus_pipeline.run(spark, folder).where("start = 0").collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.doc_tokens) for r in whole) == lengths


def test_empty_documents(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
