"""Delimited rows to documents: typing, renaming, merging and removal of columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..options import RESERVED, OptionError, Reshape


def typed_cells(df: DataFrame, options: Reshape = Reshape(), carry: str | None = None) -> DataFrame:
    """One cell column per attribute of the result; ``df`` has text columns only, null where a row is short.

    Order of work: every source column becomes a cell (reserved targets keep their raw
    text, then asked-for types, then inference); removed columns go and others are
    renamed; merges, which see all source columns, are written on top.  The column ``carry`` comes along as it is.
    Numbers are read in projections of their own, once for each cell, and only where a cell is inferred and used.
    """
    types, renames = options.parsed["datatypes"], options.parsed["translate"]
    names = [c for c in df.columns if c != carry]
    merged = {x for _, parts in options.parsed["merge"] for kind, x in parts if kind == "column"}
    used = [c for c in names if c not in options.remove or c in merged]
    inferred = {c: i for i, c in enumerate(used) if renames.get(c, c) not in RESERVED and c not in types}
    staged = df.select("*", *[cells.plain_integer(F.col(f"`{c}`")).alias(f"\0int{i}") for c, i in inferred.items()])
    staged = staged.select("*", *[cells.plain_float(F.col(f"`{c}`"), F.col(f"\0int{i}")).alias(f"\0float{i}") for c, i in inferred.items()])
    cell = {c: _decode(F.col(f"`{c}`"), c, None if renames.get(c, c) in RESERVED else types.get(c), inferred.get(c)).alias(f"\0cell{k}") for k, c in enumerate(used)}
    staged = staged.select(*cell.values(), *([carry] if carry else []))
    source = {c: F.col(f"\0cell{k}") for k, c in enumerate(used)}
    out = {renames.get(c, c): column for c, column in source.items() if c not in options.remove}
    for target, parts in options.parsed["merge"]:
        texts = [F.lit(x) if kind == "text" else _merged(source.get(x)) for kind, x in parts]
        out[target] = cells.raw_cell(F.concat(*texts))
    return staged.select(*[column.alias(name) for name, column in out.items()], *([carry] if carry else []))


def _decode(v: Column, name: str, kind: str | None, inferred: int | None) -> Column:
    if inferred is not None:
        cell = cells.infer_cell(v, F.col(f"\0int{inferred}"), F.col(f"\0float{inferred}"))
    elif kind == "number":
        cell = cells.coerced_number(v, name)
    elif kind == "boolean":
        cell = cells.coerced_boolean(v, name)
    else:
        return cells.raw_cell(v)
    return F.when(v.isNotNull(), cell)


def _merged(cell: Column | None) -> Column:
    return F.lit("") if cell is None else F.coalesce(cell["s"], F.lit(""))


def to_documents(typed: DataFrame, carry: str | None = None) -> DataFrame:
    """``doc``: the JSON object of each row, keys in sorted order, absent cells left out."""
    names = sorted(c for c in typed.columns if c != carry)
    members = [
        F.when(F.col(f"`{c}`").isNotNull(), F.concat(cells.json_string(F.lit(c)), F.lit(":"), cells.cell_json(F.col(f"`{c}`")))) for c in names
    ]
    return typed.select(F.concat(F.lit("{"), F.concat_ws(",", *members), F.lit("}")).alias("doc"), *([carry] if carry else []))


def refuse_reshape(kind: str, options: Reshape) -> None:
    if kind in ("json", "jsonl") and options.any:
        raise OptionError("column options need a delimited format")
