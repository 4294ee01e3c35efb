import random

import numpy as np
from pyspark.sql import functions as F

from docgraph.llm import topk_join
from docgraph.llm.shared import lowest_hashes, save
from docgraph.llm.topk_join import exact_top_k

SCHEMA = "vec_id long, embedding array<float>, score string"


def brute(rows, k):
    usable = [(i, [int(np.floor(1024.0 * float(np.float32(x)))) for x in v]) for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, (i, q) in enumerate(usable):
        if i is None or i % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(q, v)), j is None, j or 0) for b, (j, v) in enumerate(usable) if b != a]
        out += [(i, rank + 1, None if none else j, -s) for rank, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def vectors(n=300, dim=8):
    r = random.Random(6)
    centres = [[r.gauss(0, 1) for _ in range(dim)] for _ in range(6)]
    rows = [(i, [c + r.gauss(0, 0.2) for c in r.choice(centres)]) for i in range(n)]
    rows += [(1000 + i, [0.5] * dim) for i in range(25)]  # ties
    rows += [(2000, None), (2005, [float("nan")] * dim), (2010, [None] + [1.0] * (dim - 1)), (2015, [float("inf")] + [0.0] * (dim - 1)), (3000, [1.0, 2.0]), (3005, []), (None, [0.5] * dim), (5, [0.5] * dim)]
    return rows


def check(spark, rows, k=10):
    df = spark.createDataFrame([(i, v, "x") for i, v in rows], SCHEMA).repartition(4)
    got = sorted(map(tuple, exact_top_k(df, F.col("vec_id") % 5 == 0, k).collect()), key=repr)
    assert got == brute(rows, k)


def test_against_brute_force(spark):
    check(spark, vectors())


def test_many_groups_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(topk_join, "GROUP_QUERIES", 6)
    monkeypatch.setattr(topk_join, "BLOCK_VECTORS", 50)
    monkeypatch.setattr(topk_join, "SAMPLE", 40)
    monkeypatch.setattr(topk_join, "SAMPLE_PER_PIVOT", 2)
    check(spark, vectors(200), 3)


def test_few_candidates_and_empty(spark):
    check(spark, [(0, [1.0, 2.0]), (5, [2.0, 1.0])])
    df = spark.createDataFrame([], SCHEMA)
    assert exact_top_k(df, F.col("vec_id") % 5 == 0).count() == 0


def test_lowest_hashes(spark):
    df = spark.range(20000).repartition(4)
    got = [r.id for r in lowest_hashes(df, "id", 300, 20000).collect()]
    assert got == [r.id for r in df.orderBy(F.xxhash64("id"), "id").limit(300).collect()]
    assert lowest_hashes(df, "id", 30000, 20000).count() == 20000


def test_components_beyond_a_long_fail_the_job(spark):
    import pytest
    from pyspark.sql import functions as F

    from docgraph.llm.topk_join import exact_top_k

    df = spark.createDataFrame([(0, [1e17, 1.0]), (1, [1.0, 2.0])], "vec_id long, embedding array<double>")
    with pytest.raises(Exception, match="no long"):
        exact_top_k(df, F.col("vec_id") == 0).collect()


def test_near_vectors_only_are_replicated(spark, monkeypatch):
    """Of 40 clusters, a group of queries gets a part; results are those of brute force."""
    r = random.Random(3)
    centres = [[r.gauss(0, 1) for _ in range(16)] for _ in range(40)]
    rows = [(i, [x + r.gauss(0, 0.05) for x in centres[i % 40]]) for i in range(1200)]
    seen = {}

    def kept(df, name):
        seen[name] = save(df, name)
        return seen[name]

    monkeypatch.setattr(topk_join, "save", kept)
    monkeypatch.setattr(topk_join, "GROUP_QUERIES", 32)
    check(spark, rows)
    share = seen["cells"].join(seen["bounds"], "cell").where("far >= bound").count() / 1200 / seen["queries"].select("grp").distinct().count()
    assert share < 0.3
