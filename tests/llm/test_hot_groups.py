"""Hot groups, and columns that bear the operators' own names."""

import numpy as np
import pytest

from docgraph.llm import simhash
from docgraph.llm.components import connected_components
from docgraph.llm.exact_dedup import drop_exact_duplicates, exact_groups
from docgraph.llm.near_dedup import drop_similar
from docgraph.llm.shared import shared_dir
from docgraph.llm.simhash import drop_near_duplicates, fingerprint_links
from docgraph.llm.suffix_dedup import remove_repeated

SKEWED = {
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8k", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false",
}


@pytest.fixture
def skewed(spark):
    before = {k: spark.conf.get(k, None) for k in SKEWED}
    for k, v in SKEWED.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("operator", [drop_exact_duplicates, drop_near_duplicates, drop_similar, remove_repeated])
def test_clashing_names(spark, operator):
    names = ["__row", "__ROW_", "row", "rid", "payload", "key", "best", "cls", "node"]
    rows = [(i, f"text number {i % 3} " + "w" * i, *[f"{n}-{i}" for n in names]) for i in range(6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    out = operator(df)
    assert out.columns == df.columns
    assert sorted(tuple(r) for r in out.collect()) == sorted(rows)
    assert operator(df.limit(0)).collect() == []


def test_the_join_of_a_hot_text_is_split(skewed):
    # One text in every batch: 400 small files make 400 representatives of one class.
    texts = [(i, "the same text " * 40 if i % 3 else f"text {i}") for i in range(12_000)]
    skewed.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "30")
    try:
        out = exact_groups(skewed.createDataFrame(texts, "doc_id long, text string").repartition(4)).assignments()
        plan = final_plan(out)
        sizes = {r.group_size for r in out.select("group_size").distinct().collect()}
    finally:
        skewed.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "skew=true" in plan and sizes == {1, 8000}


def test_a_hub_of_very_many_edges(skewed):
    edges = [(0, k) for k in range(1, 30_000)] + [(100_000 + k, 100_001 + k) for k in range(0, 200, 2)]
    out = {r.node: r.root for r in connected_components(skewed.createDataFrame(edges, "a long, b long")).collect()}
    assert all(out[k] == 0 for k in range(30_000)) and out[100_001] == 100_000 and len(out) == 30_200


def test_fingerprints_of_a_hot_key_are_handed_on(spark, monkeypatch):
    r = np.random.default_rng(7)
    hub = int(r.integers(0, 2**62))
    flips = [hub ^ (1 << int(a)) ^ (1 << int(b)) for a, b in r.integers(0, 62, (300, 2))]
    prints = sorted({hub, *flips, *map(int, r.integers(0, 2**62, 200))})
    df = spark.createDataFrame([(p,) for p in prints], "fp long").repartition(3)

    def roots(links):
        root = {p: p for p in prints}
        for a, b in links:
            a, b = root[a], root[b]
            if a != b:
                root = {p: (min(a, b) if x in (a, b) else x) for p, x in root.items()}
        return root

    want = roots([(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 2])
    for held in (simhash.HELD_PRINTS, 5):
        monkeypatch.setattr(simhash, "HELD_PRINTS", held)
        assert roots([tuple(x) for x in fingerprint_links(df).collect()]) == want


def test_no_local_folder_on_a_cluster():
    class Session:
        conf = {}
        sparkContext = type("C", (), {"master": "spark://host:7077"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session())
