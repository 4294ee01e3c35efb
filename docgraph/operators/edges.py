"""Edge preflight: every row is kept, skipped and counted, or fatal."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..functions.keys import qualified

ENDS = ("_from", "_to")
NOT_QUALIFIED = "is not a fully-qualified document id"


def endpoint_class(v: Column, prefix: str | None) -> Column:
    """empty, present or the reason a text endpoint is malformed."""
    return (
        F.when(v.isNull() | (v == ""), "empty")
        .when(F.lit(prefix is not None) | (F.instr(v, "/") > 0), "present")
        .otherwise(NOT_QUALIFIED)
    )


def json_endpoint_class(doc: Column, name: str, prefix: str | None) -> Column:
    """The same for a JSON document, where an end may also be absent or no string."""
    value = F.try_parse_json(doc)
    end = F.try_variant_get(value, f"$.{name}", "variant")
    text = F.try_variant_get(value, f"$.{name}", "string")
    return (
        F.when(end.isNull(), f"edge document is missing '{name}'")
        .when(F.is_variant_null(end), "empty")
        .when(F.schema_of_variant(end) != "STRING", "must be a string")
        .otherwise(endpoint_class(text, prefix))
    )


def classify(df: DataFrame, from_prefix: str | None = None, to_prefix: str | None = None) -> DataFrame:
    """Adds ``edge_class``: present, skip, or a reason; a reason of either end comes before a skip, ``_from`` first."""
    kinds = [endpoint_class(F.col(c), p) for c, p in zip(ENDS, (from_prefix, to_prefix))]
    return df.withColumn("edge_class", _verdict(kinds))


def classify_documents(df: DataFrame, from_prefix: str | None = None, to_prefix: str | None = None) -> DataFrame:
    kinds = [json_endpoint_class(F.col("doc"), c, p) for c, p in zip(ENDS, (from_prefix, to_prefix))]
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json("doc")).startswith("OBJECT"), F.lit(False))
    return df.withColumn("edge_class", F.when(~is_object, "is not an object").otherwise(_verdict(kinds)))


def _verdict(kinds: list[Column]) -> Column:
    bad = [F.when(~k.isin("empty", "present"), F.concat(F.lit(f"{name}: "), k)) for name, k in zip(ENDS, kinds)]
    return F.coalesce(*bad, F.when((kinds[0] == "empty") | (kinds[1] == "empty"), "skip"), F.lit("present"))


def preflight(df: DataFrame, from_prefix: str | None = None, to_prefix: str | None = None, observation: Observation | None = None) -> DataFrame:
    """Rows with both ends, qualified; skipped rows are counted by ``observation`` and a malformed row fails the job.

    With an ``ordinal`` column the error names the row.
    """
    at = F.concat(F.lit("row "), F.col("ordinal").cast("string"), F.lit(": ")) if "ordinal" in df.columns else F.lit("")
    ends = [F.coalesce(F.col(name), F.lit("")) for name in ENDS]
    verdict = (ends[0] != "") & (ends[1] != "")
    for name, end, prefix in reversed(list(zip(ENDS, ends, (from_prefix, to_prefix)))):
        if prefix is None:  # a bare key has no collection
            refused = F.raise_error(F.concat(at, F.lit(f"{name}: {NOT_QUALIFIED}"))).cast("boolean")
            verdict = F.when((end != "") & ~F.contains(end, F.lit("/")), refused).otherwise(verdict)
    if observation is None:
        kept = df.where(verdict)
    else:
        judged = df.withColumn("__kept", verdict).observe(observation, F.count("*").alias("read"), F.count_if(~F.col("__kept")).alias("skipped_no_edge"))
        kept = judged.where("__kept").drop("__kept")
    for name, prefix in zip(ENDS, (from_prefix, to_prefix)):
        if prefix is not None:
            kept = kept.withColumn(name, qualified(F.col(name), prefix))
    return kept
