import hashlib
import random

from docgraph.llm.exact_dedup import drop_exact_duplicates, exact_groups

SPACE = " \t\n\x0b\x0c\r"


def brute(rows):
    groups = {}
    for k, (i, t) in enumerate(rows):
        groups.setdefault((t or "").translate({ord(c): None for c in SPACE}), []).append((-len(t or ""), i is None, i or 0, k))
    out = []
    for norm, members in groups.items():
        best = min(m[:3] for m in members)
        keep = None if best[1] else best[2]
        sha = hashlib.sha256(norm.encode()).hexdigest()
        kept_one = False
        for m in sorted(members):
            kept = not kept_one and m[:3] == best
            kept_one |= kept
            out.append((None if m[1] else m[2], keep, len(members), kept, sha))
    return sorted(out, key=repr)


def rows(seed=4):
    r = random.Random(seed)
    base = ["".join(r.choice("ab é\n\t中") for _ in range(r.choice([0, 1, 5, 63, 64, 65, 256, 320, 321, 1500, 9000]))) for _ in range(40)]
    long = "x" * 7000
    out = []
    for t in base + [long, long + "y", long + "z", "", " ", None, "a\x00b"]:
        for _ in range(r.randint(1, 4)):
            spaced = t if t is None or r.random() < 0.5 else t + r.choice(SPACE) * r.randint(0, 3)
            out.append((r.randint(0, 500) if r.random() < 0.9 else None, spaced))
    return out + [(7, "same"), (7, "same"), (8, "sa me")]


def test_against_brute_force(spark):
    data = rows()
    df = spark.createDataFrame([(*x, 1) for x in data], "doc_id long, text string, rid int").repartition(4)
    assert sorted(map(tuple, exact_groups(df).assignments().collect()), key=repr) == brute(data)


def test_survivors_keep_every_column(spark):
    data = [(*x, str(k)) for k, x in enumerate(rows(5))]
    df = spark.createDataFrame(data, "doc_id long, text string, payload string").repartition(3)
    kept = drop_exact_duplicates(df)
    assert kept.columns == df.columns
    norm = lambda t: (t or "").translate({ord(c): None for c in SPACE})
    got = kept.collect()
    assert sorted(norm(x.text) for x in got) == sorted({norm(t) for _, t, _ in data})
    assert set(map(tuple, got)) <= set(data)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(df).assignments().count() == 0
    assert drop_exact_duplicates(df).count() == 0
