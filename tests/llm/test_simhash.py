import random

import numpy as np
import xxhash

from docgraph.llm.simhash import codeword_index, drop_near_duplicates, fingerprint, golay_keys, simhash_components


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute(rows, bits=2):
    prints = [(i, slow_fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= bits:
                parent[find(a)] = find(b)
    groups = {}
    for a in range(len(prints)):
        groups.setdefault(find(a), []).append(prints[a][0])
    least = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return sorted(((i, f"{p:016x}", least[find(k)]) for k, (i, p) in enumerate(prints)), key=repr)


def test_every_near_pair_shares_a_key():
    r = random.Random(5)
    for _ in range(600):
        bits = r.choice([2, 5])
        a = r.getrandbits(64)
        b = a
        for _ in range(r.randint(0, bits)):
            b ^= 1 << r.randrange(64)
        at, keys = golay_keys(np.array([a, r.getrandbits(64), b], np.uint64), bits)
        assert set(keys[at == 0]) & set(keys[at == 2])
        assert len(set(zip(at.tolist(), keys.tolist()))) == len(at) <= 3 * (18 if bits == 2 else 108)


def test_golay_code_is_perfect():
    index = codeword_index(np.arange(1 << 23, dtype=np.int64))
    assert (np.bincount(index, minlength=4096) == 2048).all()


def test_fingerprints():
    for text in ("", "one", "One two", "a b c", "A\tb\n c d \x0b e", "é ß " * 400, "x " * 2000):
        assert fingerprint(text.encode()) == slow_fingerprint(text)


def test_components_against_brute_force(spark):
    r = random.Random(9)
    words = ["w%d" % i for i in range(40)]
    rows, number = [], 0
    for _ in range(60):
        base = [r.choice(words) for _ in range(r.choice([1, 2, 3, 30, 300, 900]))]
        for _ in range(r.randint(1, 6)):
            text = list(base)
            if r.random() < 0.7:
                text[r.randrange(len(text))] = "edit%d" % number
            rows.append((number, " ".join(text)))
            number += 1
    rows += [(9001, None), (9002, ""), (9003, " \n"), (None, "same text here"), (9004, "Same  TEXT here"), (9004, "same text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for bits in (2, 5):
        got = sorted((tuple(x) for x in simhash_components(df, max_bits=bits).collect()), key=repr)
        assert got == brute(rows, bits)


def test_chains_and_large_buckets(spark):
    from docgraph.llm.simhash import components

    chain = [(1 << k) - 1 for k in range(60)]  # each one bit from the next
    r = random.Random(3)
    ball = list({0x5A5A5A5A00000000 ^ (1 << r.randrange(30)) ^ (1 << r.randrange(30)) for _ in range(400)})
    prints = spark.createDataFrame([(p if p < 1 << 63 else p - (1 << 64),) for p in chain + ball], "fp long")
    roots = {x.fp: x.root for x in components(prints).collect()}
    assert len({roots[p] for p in chain}) == 1 and len({roots[p if p < 1 << 63 else p - (1 << 64)] for p in ball}) == 1


def test_one_row_of_each_group_stays_with_its_columns(spark):
    rows = [(3, "a b c d", "k"), (1, "a b c d", None), (1, "a b c d", "r"), (None, "zz yy xx ww", "n")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    out = drop_near_duplicates(df)
    assert out.columns == df.columns
    assert sorted((r.doc_id or -1) for r in out.collect()) == [-1, 1]
    assert drop_near_duplicates(df.limit(0)).count() == 0 and simhash_components(df.limit(0)).count() == 0
