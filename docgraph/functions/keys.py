"""Deterministic keys: SHA-256 over a domain and parts that NUL characters separate."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(domain: str, *parts: Column) -> Column:
    """Null parts are left out."""
    return F.sha2(F.concat_ws("\0", F.lit(domain), *parts), 256)


def iri_key(iri: Column) -> Column:
    return hash_key("rdf:iri", iri)


def blank_key(label: Column, scope: Column | None = None) -> Column:
    return hash_key("rdf:bnode", *([] if scope is None else [scope]), label)


def literal_key(value: Column, datatype: Column, language: Column) -> Column:
    return hash_key("rdf:literal", value, F.coalesce(datatype, F.lit("")), F.coalesce(language, F.lit("")))


def edge_key(from_id: Column, predicate: Column, to_id: Column, graph: Column | None = None) -> Column:
    return hash_key("rdf:edge", from_id, predicate, to_id, *([] if graph is None else [graph]))


def graph_slug(graph: Column) -> Column:
    """A collection suffix for a graph: its readable start and eight digits of its key."""
    readable = F.regexp_replace(F.substring(graph, 1, 48), "[^A-Za-z0-9]", "_")
    return F.concat(readable, F.lit("_"), F.substring(hash_key("rdf:graph", graph), 1, 8))


def qualified(value: Column, prefix: str) -> Column:
    """``prefix/value`` for a bare key; a value with a slash stays."""
    return F.when(F.instr(value, "/") > 0, value).otherwise(F.concat(F.lit(f"{prefix}/"), value))
