"""RDF statements folded into vertices and edges with deterministic keys.

``triples``: ordinal, s_kind, s_value, predicate, o_kind, o_value, o_datatype,
o_language, graph.  Every step is a projection or an aggregation by key; a vertex
named in a third of all statements is combined map-side.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import keys

TOPOLOGIES = ("pgt", "rpt")
LITERALS = ("no-literals", "vertex-property", "materialize")
GRAPHS = ("ignore", "property", "collection")
VERTEX = ["collection", "_key", "iri", "blank_node", "label", "scope", "literal", "datatype", "language"]


@dataclass(frozen=True)
class Fold:
    """How statements become a graph.  ``rpt`` always materialises literals."""

    topology: str = "pgt"
    vertices: str = "nodes"
    edges: str = "links"
    literals: str = "no-literals"
    graphs: str = "ignore"
    scope: str | None = None

    def __post_init__(self):
        for value, known in ((self.topology, TOPOLOGIES), (self.literals, LITERALS), (self.graphs, GRAPHS)):
            if value not in known:
                raise ValueError(f"unknown option '{value}'; known: {', '.join(known)}")

    @property
    def materialises(self) -> bool:
        return self.topology == "rpt" or self.literals == "materialize"

    def collection(self, kind: Column) -> Column:
        if self.topology == "pgt":
            return F.lit(self.vertices)
        suffix = F.when(kind == "iri", "_URIRef").when(kind == "bnode", "_BNode").otherwise("_Literal")
        return F.concat(F.lit(self.vertices), suffix)

    def key(self, kind: Column, value: Column, datatype: Column, language: Column) -> Column:
        scope = F.lit(self.scope) if self.scope else None
        return (
            F.when(kind == "iri", keys.iri_key(value))
            .when(kind == "bnode", keys.blank_key(value, scope))
            .otherwise(keys.literal_key(value, datatype, language))
        )

    def id(self, kind: Column, value: Column, datatype: Column, language: Column) -> Column:
        return F.concat(self.collection(kind), F.lit("/"), self.key(kind, value, datatype, language))


def _terms(triples: DataFrame, fold: Fold) -> DataFrame:
    """(ordinal, kind, value, datatype, language) of every term that becomes a vertex."""
    none = F.lit(None).cast("string")
    subjects = triples.select("ordinal", F.col("s_kind").alias("kind"), F.col("s_value").alias("value"), none.alias("datatype"), none.alias("language"))
    objects = triples if fold.materialises else triples.where("o_kind <> 'literal'")
    return subjects.unionByName(
        objects.select("ordinal", F.col("o_kind").alias("kind"), F.col("o_value").alias("value"), F.col("o_datatype").alias("datatype"), F.col("o_language").alias("language"))
    )


def vertices(triples: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """One row per vertex, with ``properties`` (predicate to last literal) under ``vertex-property``."""
    kind, value = F.col("kind"), F.col("value")
    terms = _terms(triples, fold).groupBy("kind", "value", "datatype", "language").agg(F.min("ordinal").alias("ordinal"))
    rows = terms.select(
        fold.collection(kind).alias("collection"), fold.key(kind, value, F.col("datatype"), F.col("language")).alias("_key"),
        F.when(kind == "iri", value).alias("iri"), (kind == "bnode").alias("blank_node"), F.when(kind == "bnode", value).alias("label"),
        F.when(kind == "bnode", F.lit(fold.scope or None)).cast("string").alias("scope"), F.when(kind == "literal", value).alias("literal"),
        "datatype", "language",
    )
    if fold.materialises or fold.literals != "vertex-property":
        return rows.withColumn("properties", F.lit(None).cast("map<string,string>"))
    return rows.join(_properties(triples, fold), ["collection", "_key"], "left")


def _properties(triples: DataFrame, fold: Fold) -> DataFrame:
    none = F.lit(None).cast("string")
    held = triples.where("o_kind = 'literal'").select(
        fold.collection(F.col("s_kind")).alias("collection"), fold.key(F.col("s_kind"), F.col("s_value"), none, none).alias("_key"), "predicate", "o_value", "ordinal"
    )
    last = held.groupBy("collection", "_key", "predicate").agg(F.max_by("o_value", "ordinal").alias("value"))
    return last.groupBy("collection", "_key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("predicate", "value")))).alias("properties"))


def edges(triples: DataFrame, fold: Fold = Fold(), distinct: bool = True) -> DataFrame:
    """One row per edge: collection, _key, _from, _to, predicate, graph."""
    none = F.lit(None).cast("string")
    kept = triples if fold.materialises else triples.where("o_kind <> 'literal'")
    graph = none if fold.graphs == "ignore" else F.col("graph")
    ends = kept.select(
        fold.id(F.col("s_kind"), F.col("s_value"), none, none).alias("_from"),
        fold.id(F.col("o_kind"), F.col("o_value"), F.col("o_datatype"), F.col("o_language")).alias("_to"), "predicate", graph.alias("graph"),
    )
    collection = F.lit(fold.edges)
    if fold.graphs == "collection":
        collection = F.when(F.col("graph").isNull(), fold.edges).otherwise(F.concat(F.lit(f"{fold.edges}_"), keys.graph_slug(F.col("graph"))))
    in_key = F.col("graph") if fold.graphs == "property" else None
    rows = ends.select(
        collection.alias("collection"), keys.edge_key(F.col("_from"), F.col("predicate"), F.col("_to"), in_key).alias("_key"),
        "_from", "_to", "predicate", (F.col("graph") if fold.graphs == "property" else none).alias("graph"),
    )
    return rows.distinct() if distinct else rows


def new_only(rows: DataFrame, stored: DataFrame) -> DataFrame:
    """Rows whose (collection, _key) is not stored yet: loading twice changes nothing."""
    return rows.join(stored.select("collection", "_key"), ["collection", "_key"], "left_anti")


def summary(triples: DataFrame, fold: Fold = Fold()) -> DataFrame:
    """triples_read, vertices_built, edges_built (with repetitions)."""
    return (
        triples.agg(F.count("*").alias("triples_read"))
        .crossJoin(vertices(triples, fold).agg(F.count("*").alias("vertices_built")))
        .crossJoin(edges(triples, fold, distinct=False).agg(F.count("*").alias("edges_built")))
    )
