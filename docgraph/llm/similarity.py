"""Exact components of similar sets within candidate buckets.

No bucket's pairs are listed.  In a round, each bucket pairs one leader with its other nodes, which is linear in its rows: first the
node that meets most others over all its buckets, then the best node that no earlier leader of the bucket is linked to.  After
``ROUNDS`` rounds, whatever bucket still holds two components is finished exactly by prefixes: of two sets similar enough, ordered by
rarity, the first elements share one, so nodes are joined by those elements alone, and only where they lie in different
components.  Within an element, the nodes of its commonest component are not paired with each other.

Sizes travel with the nodes, so pairs whose sizes alone forbid the similarity go before any set is read.  A leader's
set meets its members in the last join, where it is one row and nothing is shuffled afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .shared import discard, save

ROUNDS = 4


def _sizes_allow(percent: int) -> F.Column:
    return F.least("n", "m") * 100 >= F.greatest("n", "m") * percent


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b, n, m) with 100 * intersection >= ``percent`` * union; ``sets`` is (node, shingles)."""
    members = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    leaders = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    both = pairs.join(members, "b").join(leaders, "a").withColumn("common", F.size(F.array_intersect("x", "y")).cast("long"))
    return both.where(F.col("common") * 100 >= (F.col("n") + F.col("m") - F.col("common")) * percent).select("a", "b")


def _rooted(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """``rows`` with the component each node is in now; a node without links is its own."""
    return rows.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))


def _joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots`` (node, root) after more ``links`` (a, b): components of the components."""
    ends = links
    for end in ("a", "b"):
        ends = ends.join(roots.select(F.col("node").alias(end), F.col("root").alias(f"r_{end}")), end, "left")
        ends = ends.withColumn(f"r_{end}", F.coalesce(f"r_{end}", end))
    moved = connected_components(ends.select(F.col("r_a").alias("a"), F.col("r_b").alias("b"))).select(F.col("node").alias("root"), F.col("root").alias("new"))
    old = roots.join(moved, "root", "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = moved.select(F.col("root").alias("node"), F.col("new").alias("root")).join(roots, "node", "left_anti")
    return save(old.unionByName(fresh), "similar-roots")


def _mixed(rows: DataFrame) -> DataFrame:
    """Keys whose nodes lie in two components or more."""
    return rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("key")


def _round(rows: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(leaders, pairs): of each mixed key, the waiting node that meets most others, and it with all of other components."""
    best = F.min(F.when(F.col("waiting"), F.struct((-F.col("degree")).alias("d"), F.col("node"), F.col("root"), F.col("n")))).alias("best")
    found = rows.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), best).where("low < high AND best IS NOT NULL")
    leaders = save(found.select("key", F.col("best.node").alias("a"), F.col("best.root").alias("a_root"), F.col("best.n").alias("m")), "similar-leaders")
    pairs = rows.join(leaders, "key").where("root <> a_root").select("a", F.col("node").alias("b"), "n", "m")
    return leaders, pairs.where(_sizes_allow(percent)).distinct()


def _by_prefix(rest: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b, n, m) of ``rest`` (node, n, root) in different components that share an element of their prefixes."""
    tokens = save(rest.join(sets, "node").select("node", "n", "root", F.explode("shingles").alias("t")), "similar-tokens")
    often = save(tokens.groupBy("t").agg(F.count("*").alias("df")).where("df > 1"), "similar-often")
    node = Window.partitionBy("node")
    place = F.row_number().over(node.orderBy("df", "t")) + F.col("n") - F.count("*").over(node)  # what no other has comes first
    longest = F.col("n") - F.floor((percent * F.col("n") + 99) / F.lit(100)) + 1
    prefix = save(tokens.join(often, "t").withColumn("place", place).where(F.col("place") <= longest).select("t", "node", "n", "root", "place"), "similar-prefixes")
    per_root = prefix.groupBy("t", "root").agg(F.count("*").alias("c"))
    common = save(per_root.groupBy("t").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("roots")).where("roots > 1").select("t", "most"), "similar-common")
    mixed = save(prefix.join(common, "t"), "similar-mixed")
    few = mixed.where("root <> most").select("t", F.col("node").alias("a"), F.col("n").alias("m"), F.col("root").alias("a_root"), F.col("place").alias("a_place"))
    # At the first element that two sets share, what follows in either must still be enough.
    enough = (F.least(F.col("n") - F.col("place"), F.col("m") - F.col("a_place")) + 1) * (100 + percent) >= (F.col("n") + F.col("m")) * percent
    met = few.join(mixed, "t").where("root <> a_root AND (root = most OR a < node)").where(enough)
    pairs = save(met.select("a", F.col("node").alias("b"), "n", "m").where(_sizes_allow(percent)).distinct(), "similar-pairs")
    discard(tokens, often, prefix, common, mixed)
    return pairs


def similar_components(meeting: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(node, root) of every node with a link; ``meeting`` is a saved (key, node, n) with the set sizes, ``sets`` a saved (node, shingles).

    Every pair of nodes that share a key and are similar lies in one component.  A node may appear once in a key.
    """
    counts = save(meeting.groupBy("key").agg(F.count("*").alias("c")), "similar-counts")
    degree = save(meeting.join(counts, "key").groupBy("node").agg(F.sum("c").alias("degree")), "similar-degree")
    open_ = save(meeting.join(degree, "node").select("key", "node", "n", "degree", F.col("node").alias("root"), F.lit(True).alias("waiting")), "similar-open")
    discard(counts, degree)
    roots = None
    for _ in range(ROUNDS):
        rows = save(_rooted(open_, roots), "similar-rows") if roots is not None else open_
        leaders, pairs = _round(rows, percent)
        links = save(linked(pairs, sets, percent), "similar-links")
        if roots is not None and links.isEmpty():
            discard(links, leaders, rows)
            break
        if roots is None:
            found = connected_components(links)
            before, roots = None, save(found, "similar-roots")
        else:
            before, roots = roots, _joined(roots, links)
        # A bucket stays open where its leader's component grew by nodes of it; those wait for no other leader.
        now = leaders.join(roots.select(F.col("node").alias("a"), F.col("root").alias("now")), "a").select("key", "a_root", "now")
        moved = _rooted(rows.withColumn("was", F.col("root")), roots).join(now, "key")
        won = F.max((F.col("was") != F.col("a_root")) & (F.col("root") == F.col("now")))
        going = save(moved.groupBy("key").agg(won.alias("won"), F.min("root").alias("low"), F.max("root").alias("high")).where("won AND low < high").select("key"), "similar-going")
        waiting = (F.col("waiting") & (F.col("root") != F.col("now"))).alias("waiting")
        new = save(moved.join(going, "key", "left_semi").select("key", "node", "n", "degree", "root", waiting), "similar-open")
        discard(*[t for t in (open_, rows, leaders, links, going, before) if t is not None])
        open_ = new
    ends = save(_rooted(meeting, roots), "similar-ends")
    rest = save(ends.join(_mixed(ends), "key", "left_semi").select("node", "n", "root").distinct(), "similar-rest")
    pairs = _by_prefix(rest, sets, percent)
    links = save(linked(pairs, sets, percent), "similar-links")
    last = _joined(roots, links)
    discard(open_, ends, rest, pairs, links, roots)
    return last
