"""N-Triples and N-Quads: one statement per line, parsed by one possessive pattern."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The line grammar.  Possessive, so that a label swallows what it may.
_IRI = r"<((?:[^>\\]|\\.)*+)>"
_BLANK = r'_:([^\s<"]++)'
_LITERAL = r'(")((?:[^"\\]|\\.)*+)"(?:\^\^<((?:[^>\\]|\\.)*+)>|@([A-Za-z0-9-]++))?'
STATEMENT = rf"(?Us)^[ \t]*(?:{_IRI}|{_BLANK})[ \t]*{_IRI}[ \t]*(?:{_IRI}|{_BLANK}|{_LITERAL})[ \t]*(?:(?:{_IRI}|{_BLANK})[ \t]*)?\..*$"
#: The groups of a statement, a line each; a term of a statement holds no line end.
GROUPS = "\n".join(f"${k}" for k in range(1, 12))
_ESCAPE = re.compile(r"\\(u[0-9A-Fa-f]{4}|U[0-9A-Fa-f]{8}|.?)", re.DOTALL)
_PLAIN = {"t": "\t", "b": "\b", "n": "\n", "r": "\r", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


@F.pandas_udf(T.ArrayType(T.StringType()))
def unescaped(groups: pd.Series) -> pd.Series:
    """The groups of statements with their escapes decoded; only lines with a backslash come here, once each."""

    def one(m: re.Match) -> str:
        code = m[1]
        if code[:1] in ("u", "U") and len(code) > 1:
            point = int(code[1:], 16)
            if 0xD800 <= point <= 0xDFFF or point > 0x10FFFF:
                raise ValueError(f"invalid code point in {m[0]}")
            return chr(point)
        if code not in _PLAIN:
            raise ValueError(f"unknown escape {m[0]}")
        return _PLAIN[code]

    return pd.Series([[_ESCAPE.sub(one, v) if "\\" in v else v for v in row] for row in groups], dtype=object)


def parse_statements(lines: DataFrame, quads: bool, line_col: str = "value", ordinal_col: str | None = None) -> DataFrame:
    """Rows of text lines to triples; blank lines and comments are skipped, any other line that is no statement fails.

    A line is matched once.  Only lines with a backslash go through Python, to have their escapes decoded.  An error
    names the line by ``ordinal_col``, where there is one, and by its text.
    """
    ordinal = F.col(ordinal_col) if ordinal_col else F.monotonically_increasing_id()
    line = F.regexp_replace(F.col(line_col), r"\r\z", "")
    rows = lines.select(ordinal.alias("ordinal"), line.alias("line")).where(r"NOT line RLIKE '(?U)\\A\\s*(#.*)?\\z'")
    escaped = F.contains("line", F.lit("\\"))
    return _parsed(rows.where(~escaped), quads, bool(ordinal_col), False).unionByName(_parsed(rows.where(escaped), quads, bool(ordinal_col), True))


def _parsed(rows: DataFrame, quads: bool, numbered: bool, escapes: bool) -> DataFrame:
    which = F.concat(F.lit("line "), F.col("ordinal").cast("string")) if numbered else F.concat(F.lit("line '"), F.substring("line", 1, 80), F.lit("'"))
    matched = F.when(~F.contains("line", F.lit("\n")), F.split(F.regexp_replace("line", STATEMENT, GROUPS), "\n"))
    rows = rows.select("ordinal", which.alias("which"), matched.alias("m"))
    refused = F.raise_error(F.concat("which", F.lit(": not a statement"))).cast("array<string>")
    rows = rows.select("ordinal", "which", F.when(F.size("m") == 11, F.col("m")).otherwise(refused).alias("m"))
    got = {n: F.col("m")[n - 1] for n in range(1, 12)}
    if escapes:
        rows = rows.withColumn("decoded", unescaped("m"))
        got = {n: F.col("decoded")[n - 1] for n in range(1, 12)}
    raw = {n: F.col("m")[n - 1] for n in range(1, 12)}
    literal = raw[6] != ""
    out = rows.select(
        "ordinal", "which",
        F.when(raw[2] != "", "bnode").otherwise("iri").alias("s_kind"),
        F.when(raw[2] != "", got[2]).otherwise(got[1]).alias("s_value"), got[3].alias("predicate"),
        F.when(literal, "literal").when(raw[5] != "", "bnode").otherwise("iri").alias("o_kind"),
        F.when(literal, got[7]).when(raw[5] != "", got[5]).otherwise(got[4]).alias("o_value"),
        F.when(literal & (raw[8] != ""), got[8]).alias("o_datatype"), F.when(literal & (raw[9] != ""), got[9]).alias("o_language"),
        F.when(raw[10] != "", got[10]).when(raw[11] != "", F.concat(F.lit("_:"), got[11])).alias("graph"),
    )
    if not quads:
        refuse = F.raise_error(F.concat("which", F.lit(": a fourth term needs N-Quads"))).cast("string")
        out = out.withColumn("graph", F.when(F.col("graph").isNotNull(), refuse))
    return out.drop("which")


def read_statements(spark: SparkSession, path: str, quads: bool) -> DataFrame:
    return parse_statements(spark.read.text(path, lineSep="\n"), quads)
