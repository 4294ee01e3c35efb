"""Top-level members of JSON objects as raw text, so that values keep every detail of their writing."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_SPACE = " \t\r\n"


def object_members(text: str) -> list[tuple[str, str]]:
    """(name, raw value) of each member of one JSON object, in order; of a repeated name the last value holds."""
    decoder, found, at = json.JSONDecoder(), {}, _skip(text, 0)
    if text[at : at + 1] != "{":
        raise ValueError("a document is not an object")
    at = _skip(text, at + 1)
    open_ = text[at : at + 1] != "}"
    while open_:
        name, at = decoder.raw_decode(text, at)
        at = _skip(text, at)
        if not isinstance(name, str) or text[at : at + 1] != ":":
            raise ValueError("a document is not an object")
        start = _skip(text, at + 1)
        _, end = decoder.raw_decode(text, start)
        found[name] = text[start:end]
        at = _skip(text, end)
        open_ = text[at : at + 1] == ","
        if open_:
            at = _skip(text, at + 1)
        elif text[at : at + 1] != "}":
            raise ValueError("a document is not an object")
    if _skip(text, at + 1) != len(text):
        raise ValueError("something follows a document")
    return list(found.items())


def _skip(text: str, at: int) -> int:
    while text[at : at + 1] and text[at] in _SPACE:
        at += 1
    return at


def exploded_members(df: DataFrame, doc_col: str = "doc") -> DataFrame:
    """A row per member of each document: the other columns of ``df``, ``position``, ``name`` and raw ``value``."""
    others = [c for c in df.columns if c != doc_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = [object_members(text) for text in batch.column(len(others)).to_pylist()]
            at = pa.array([i for i, doc in enumerate(docs) for _ in doc], pa.int64())
            columns = [batch.column(i).take(at) for i in range(len(others))]
            columns.append(pa.array([p for doc in docs for p in range(len(doc))], pa.int32()))
            columns += [pa.array([m[k] for doc in docs for m in doc], pa.string()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "position", "name", "value"])

    fields = [df.schema[c] for c in others]
    schema = T.StructType([*fields, *(T.StructField(n, t) for n, t in (("position", T.IntegerType()), ("name", T.StringType()), ("value", T.StringType())))])
    return df.select(*others, F.col(doc_col)).mapInArrow(run, schema)


def patched(df: DataFrame, old_col: str, new_col: str, doc_col: str = "doc") -> DataFrame:
    """``df`` with ``doc_col``, the members of ``old_col`` with those of ``new_col`` over them; either may be null.

    Members keep their raw text and the place where they first appear.
    """
    others = [c for c in df.columns if c not in (old_col, new_col)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = []
            for old, new in zip(batch.column(len(others)).to_pylist(), batch.column(len(others) + 1).to_pylist()):
                members = dict(object_members(old)) if old is not None else {}
                if new is not None:
                    members.update(object_members(new))
                docs.append("{" + ",".join([f"{json.dumps(name, ensure_ascii=False)}:{value}" for name, value in members.items()]) + "}")
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(others)], pa.array(docs, pa.string())], names=[*others, doc_col])

    schema = T.StructType([*[df.schema[c] for c in others], T.StructField(doc_col, T.StringType())])
    return df.select(*others, old_col, new_col).mapInArrow(run, schema)
