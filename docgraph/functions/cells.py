"""Typing of text cells, as Column expressions.

A cell is ``struct<t, s>``: ``t`` is null, bool, int, float or str, and ``s`` the
value's JSON text (for str the raw text).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The number grammar, and numbers with a leading zero that stay text.
INTEGER = r"\A[+-]?[0-9]+\z"
FLOAT = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
LEADING_ZERO = r"\A[+-]?0[^.eE]"
SHORT = r"\A[+-]?(?=[0-9.]{1,15}\z)[0-9]*\.?[0-9]*\z"  # so few digits are their double's shortest ones


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed a single time."""
    return F.element_at(F.transform(F.array(value), use), 1)


def json_number(x: Column, text: Column) -> Column:
    """A finite double as JSON text: its shortest digits, plain up to 16 places, ``1e16`` beyond; ``text`` is what it was read from."""
    negative = F.when(F.ltrim(text).startswith("-"), "-").otherwise("")
    long = F.concat(negative, _let(_digits(F.abs(x)), _written))
    return F.when(text.rlike(SHORT) & ((F.abs(x) >= 1e-5) | (x == 0)), _tidied(text)).when(x == 0, F.concat(negative, F.lit("0.0"))).otherwise(long)


def _tidied(text: Column) -> Column:
    """A plain decimal without needless zeros, and with a digit on either side of its point."""
    pointed = F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
    bare = F.regexp_replace(pointed, r"\A\+?(-?)0*([0-9]*)\.([0-9]*?)0*\z", "$1$2.$3")
    return F.regexp_replace(F.regexp_replace(bare, r"\A(-?)\.", "$10."), r"\.\z", ".0")


def _digits(x: Column) -> Column:
    """(d, p) of a positive double: 0.d times ten to the p, with the fewest digits that read back as ``x``."""

    def struct(digits: Column, point: Column) -> Column:
        return F.struct(F.regexp_replace(digits, "0+\\z", "").alias("d"), point.cast("int").alias("p"))

    def parsed(parts: Column) -> Column:
        every = F.concat(parts[0], parts[1])
        digits = F.ltrim(every, F.lit("0"))
        exponent = F.coalesce(F.get(parts, F.lit(2)).cast("int"), F.lit(0))
        return struct(digits, F.length(parts[0]) + exponent - F.length(every) + F.length(digits))

    def shortened(had: Column) -> Column:  # the runtime's own text can be a digit or two too long
        fewer = F.floor((had["d"].cast("decimal(20,0)") + 5) / 10).cast("decimal(20,0)").cast("string")
        point = had["p"] + F.length(fewer) - F.length(had["d"]) + 1
        same = F.concat(F.lit("0."), fewer, F.lit("E"), point.cast("string")).cast("double") == x
        return F.when((F.length(had["d"]) > 1) & same, struct(fewer, point)).otherwise(had)

    return _let(_let(_let(F.split(F.replace(x.cast("string"), F.lit("E"), F.lit(".")), r"\."), parsed), shortened), shortened)


def _written(had: Column) -> Column:
    d, p = had["d"], had["p"]
    n = F.length(d)
    power = F.concat(F.substring(d, 1, 1), F.when(n > 1, F.concat(F.lit("."), F.substring(d, 2, 20))).otherwise(""), F.lit("e"), (p - 1).cast("string"))
    return (
        F.when((n <= p) & (p <= 16), F.concat(d, F.repeat(F.lit("0"), p - n), F.lit(".0")))
        .when((p > 0) & (p <= 16), F.concat(d.substr(F.lit(1), p), F.lit("."), d.substr(p + 1, n)))
        .when((p > -5) & (p <= 0), F.concat(F.lit("0."), F.repeat(F.lit("0"), -p), d))
        .otherwise(power)
    )


def as_integer(v: Column) -> Column:
    return F.when(v.rlike(INTEGER), v.try_cast("bigint"))


def as_float(v: Column) -> Column:
    value = F.when(v.rlike(FLOAT), v.try_cast("double"))
    return F.when(F.abs(value) < F.lit(float("inf")), value)


def plain_integer(v: Column) -> Column:
    """The integer a cell is by its looks; one with a leading zero is text."""
    return F.when(~v.rlike(LEADING_ZERO), as_integer(v))


def plain_float(v: Column, integer: Column) -> Column:
    """The float a cell is by its looks, unless it is ``integer``."""
    return F.when(integer.isNull() & ~v.rlike(LEADING_ZERO), as_float(v))


def cell_tag(v: Column, integer: Column | None = None, number: Column | None = None) -> Column:
    """Type of one cell: null, bool, int, float or str; ``integer`` and ``number`` where they are known already."""
    integer = plain_integer(v) if integer is None else integer
    number = plain_float(v, integer) if number is None else number
    return (
        F.when(v.isNull() | (v == "") | (v == "null"), "null")
        .when(v.isin("true", "false"), "bool")
        .when(integer.isNotNull(), "int")
        .when(number.isNotNull(), "float")
        .otherwise("str")
    )


def _cell(tag: Column, v: Column, integer: Column, number: Column) -> Column:
    text = F.when(tag == "int", integer.cast("string")).when(tag == "float", json_number(number, v)).when(tag != "null", v)
    return F.struct(tag.alias("t"), text.alias("s"))


def infer_cell(v: Column, integer: Column | None = None, number: Column | None = None) -> Column:
    integer = plain_integer(v) if integer is None else integer
    number = plain_float(v, integer) if number is None else number
    return _cell(cell_tag(v, integer, number), v, integer, number)


def raw_cell(v: Column) -> Column:
    """A cell kept as text, whatever it looks like."""
    return F.when(v.isNotNull(), F.struct(F.lit("str").alias("t"), v.alias("s")))


def coerced_number(v: Column, column: str) -> Column:
    """The number a cell is asked to be, as a cell; a value that is none is an error that names column, value and option."""
    tag = F.when(v == "", "null").when(as_integer(v).isNotNull(), "int").when(as_float(v).isNotNull(), "float")
    return _cell(F.coalesce(tag, F.when(v.isNotNull(), _refuse(v, column, "number"))), v, as_integer(v), as_float(v))


def coerced_boolean(v: Column, column: str) -> Column:
    tag = F.when(v == "", "null").when(v.isin("true", "1", "false", "0"), "bool")
    text = F.when(v.isin("true", "1"), "true").when(v.isin("false", "0"), "false")
    return F.struct(F.coalesce(tag, F.when(v.isNotNull(), _refuse(v, column, "boolean"))).alias("t"), text.alias("s"))


def _refuse(v: Column, column: str, kind: str) -> Column:
    message = F.concat(F.lit(f"column '{column}' value '"), v, F.lit(f"' is not a valid {kind} (requested by --datatype {column}={kind})"))
    return F.raise_error(message).cast("string")


def json_string(v: Column) -> Column:
    """Text as a JSON string literal."""
    quoted = F.to_json(F.struct(v.alias("v")), {"ignoreNullFields": "false"})
    return F.substring(quoted, F.lit(6), F.length(quoted) - 6)  # without {"v": and }


def cell_json(cell: Column) -> Column:
    return F.when(cell["t"] == "str", json_string(cell["s"])).when(cell["t"] == "null", "null").otherwise(cell["s"])


def guarded_csv(text: Column) -> Column:
    """Text that a spreadsheet would read as a formula gets a leading apostrophe."""
    return F.when(text.rlike(r"\A[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)


def csv_cell(cell: Column) -> Column:
    """Cells on export: text is guarded, numbers and booleans stay bare, null and absent are empty."""
    return F.when(cell.isNull() | (cell["t"] == "null"), "").when(cell["t"] == "str", guarded_csv(cell["s"])).otherwise(cell["s"])
