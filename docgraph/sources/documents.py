"""Document sources: JSON lines, JSON arrays, and delimited files whose cells stay text.

Every reader can say where a row stands: ``file``, ``file_start`` (of the split) and ``line`` order the rows of a read.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window

from ..scratch import stored
from .ranges import bytes_of, chunks, opened, spread

_SPACE = " \t\r\n"
PLACE = ("file", "file_start", "line")
CHUNK = 1 << 20


def _place() -> list:
    return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("file_start"), F.monotonically_increasing_id().alias("line")]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = F.regexp_replace("value", r"\A[ \t\r\f\x0b]+|[ \t\r\f\x0b]+\z", "")
    return spark.read.text(path, lineSep="\n").select(F.trim(text).alias("doc"), *_place())


def read_jsonl(spark: SparkSession, path: str, strict: bool = True, place: bool = False) -> DataFrame:
    """(doc[, place]): each line's text, trimmed; blank lines are skipped, and a line that is no JSON fails the job."""
    lines = _lines(spark, path).where("doc <> ''").select("doc", *(PLACE if place else ()))
    if not strict:
        return lines
    bad = F.raise_error(F.concat(F.lit("not a JSON value: "), F.substring("doc", 1, 80))).cast("string")
    return lines.withColumn("doc", F.when(F.try_parse_json("doc").isNull(), bad).otherwise(F.col("doc")))


def first_bad_line(spark: SparkSession, path: str) -> dict | None:
    """Where the first line that is no JSON stands: file, line and column, counted from 1, and what is wrong."""
    lines = _lines(spark, path)
    bad = lines.where("doc <> ''").where(F.try_parse_json("doc").isNull()).orderBy(*PLACE).limit(1).collect()
    if not bad:
        return None
    at = bad[0]
    earlier = (F.col("file_start") < at.file_start) | ((F.col("file_start") == at.file_start) & (F.col("line") <= at.line))
    number = lines.where((F.col("file") == at.file) & earlier).count()
    try:
        json.loads(at.doc)
        column, message = 1, "not a JSON value"
    except ValueError as error:
        column, message = getattr(error, "pos", 0) + 1, getattr(error, "msg", str(error))
    return {"file": at.file, "line": number, "column": column, "message": message}


def json_elements(source: str | Callable[[int], str]) -> Iterator[str]:
    """The text of each element of one JSON array, as written; repeated and trailing commas are let pass.

    ``source`` is a text, or reads the next so many characters; no more is held than the longest element needs.
    """
    read = io.StringIO(source).read if isinstance(source, str) else source
    decoder, held, at, ended, size = json.JSONDecoder(), "", 0, False, CHUNK

    def more() -> bool:
        nonlocal held, at, ended
        chunk = read(size)
        ended = not chunk
        held, at = held[at:] + chunk, 0
        return not ended

    def skip(what: str) -> str:
        """The next character that is not of ``what``, or nothing at the end."""
        nonlocal at
        while True:
            while at < len(held) and held[at] in what:
                at += 1
            if at < len(held):
                return held[at]
            if not more():
                return ""

    if skip(_SPACE) != "[":
        raise ValueError("expected a JSON array")
    at += 1
    while (character := skip(_SPACE + ",")) != "]":
        if not character:
            raise ValueError("unterminated JSON array")
        while True:
            try:
                _, end = decoder.raw_decode(held, at)
            except ValueError:
                end = None
            if end is not None and (end < len(held) or ended):
                break
            if ended or (not more() and end is None):
                raise ValueError("unterminated JSON array, or an element that is no JSON")
            size *= 2  # a long element is tried a few times, not once for each chunk
        yield held[at:end]
        at, size = end, CHUNK
        if skip(_SPACE) not in (",", "]"):
            raise ValueError("unterminated JSON array" if at >= len(held) else "expected , or ] after an element")
    at += 1
    if skip(_SPACE):
        raise ValueError("data after the JSON array")


def opened_text(path: str, errors: str = "strict") -> io.TextIOWrapper:
    """A file's text, read as it is needed; the codec follows from the name."""
    import pyarrow as pa

    system, place = opened(path)
    codec = {"gz": "gzip", "gzip": "gzip", "zst": "zstd", "zstd": "zstd"}.get(place.lower().rpartition(".")[2])
    stream = system.open_input_stream(place, compression=None)
    return io.TextIOWrapper(pa.CompressedInputStream(stream, codec) if codec else stream, encoding="utf-8", errors=errors, newline="")


def _elements_of(path: str, start: int, stop: int, whole: bool, length_known: bool) -> Iterator[str]:
    if whole:
        with opened_text(path) as text:
            yield from json_elements(text.read)
        return
    text = bytes_of(path, start, stop).decode()
    ended = length_known  # the file's last chunk closes the array itself
    yield from json_elements("[" + text[1:] + ("" if ended else "]"))


def read_json_array(spark: SparkSession, path: str, place: bool = False) -> DataFrame:
    """(ordinal, doc[, place]) of the elements of each file.

    A large file is split among tasks between elements (see ``ranges``).  A compressed one, or one that is no whole array, is scanned by
    one task as a stream, which holds a chunk or the longest element.
    """
    parts = chunks(spark, path, json=True)
    last = parts.groupBy("path").agg(F.max("stop").alias("end"))

    def elements(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                found, first = _elements_of(row.path, row.start, row.stop, row.whole, row.stop == row.end), 1
                while docs := list(islice(found, 2000)):
                    yield pd.DataFrame({"file": row.path, "file_start": row.start, "line": range(first, first + len(docs)), "doc": docs})
                    first += len(docs)

    rows = spread(parts.join(last, "path")).mapInPandas(elements, "file string, file_start long, line long, doc string")
    if place or parts.where("NOT whole").isEmpty():
        return rows.select(F.col("line").alias("ordinal"), "doc", *(PLACE if place else []))
    rows = stored(rows, "elements")
    before = Window.partitionBy("file").orderBy("file_start").rowsBetween(Window.unboundedPreceding, -1)
    counts = rows.groupBy("file", "file_start").agg(F.count("*").alias("n")).select("file", "file_start", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    return rows.join(counts, ["file", "file_start"]).select((F.col("earlier") + F.col("line")).alias("ordinal"), "doc")


def _ragged(width: int, separator: str):
    names = [f"c{i}" for i in range(width)]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        csv.field_size_limit(sys.maxsize)
        for batch in batches:
            for row in batch.itertuples():
                text = opened_text(row.path) if row.whole else io.StringIO(bytes_of(row.path, row.start, row.stop).decode(), newline="")
                with text:
                    records, first = csv.reader(text, delimiter=separator), 1
                    if row.start == 0:
                        next(records, None)
                    while chunk := list(islice((r for r in records if r), 10_000)):
                        cells = [[*r[:width], *[None] * (width - len(r))] for r in chunk]
                        yield pd.DataFrame(cells, columns=names, dtype=object).assign(file=row.path, file_start=row.start, line=range(first, first + len(cells)))
                        first += len(cells)

    return run


def read_delimited(spark: SparkSession, path: str, separator: str = ",", multi_line: bool | None = None, place: bool = False) -> DataFrame:
    """Text columns named by the header line; duplicate header names keep the last column.

    Files of one read share their header.  An empty cell is empty text, a cell that a short row lacks is null, and
    what a long row has too much is left out.  Files are split among tasks, between records where those run over several
    lines (``multi_line``; by default that is found out, by lines with an odd number of quotes; see ``ranges``).
    """
    header = spark.read.csv(path, sep=separator, quote='"', escape='"', multiLine=True, header=False, inferSchema=False).limit(1).collect()
    if not header:
        return spark.createDataFrame([], T.StructType([]))
    names = [n or "" for n in header[0]]
    width = len(names)
    if multi_line is None:
        lines = spark.read.text(path, lineSep="\n")
        multi_line = not lines.where((F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))) % 2 == 1).isEmpty()
    text = [T.StructField(f"c{i}", T.StringType()) for i in range(width)]
    if multi_line:
        schema = T.StructType([*text, T.StructField("file", T.StringType()), T.StructField("file_start", T.LongType()), T.StructField("line", T.LongType())])
        rows = spread(chunks(spark, path, json=False, separator=separator)).mapInPandas(_ragged(width, separator), schema)
        cells = [F.col(f"c{i}") for i in range(width)]
    else:
        schema = T.StructType([*text, T.StructField("odd", T.StringType())])
        rows = spark.read.schema(schema).csv(
            path, sep=separator, quote='"', escape='"', header=True, enforceSchema=True, mode="PERMISSIVE", columnNameOfCorruptRecord="odd", nullValue="\0none", emptyValue="",
        ).select("*", *_place())
        bare = F.regexp_replace("odd", '"[^"]*"', "")
        found = F.when(F.col("odd").isNull(), width).otherwise(F.length(bare) - F.length(F.replace(bare, F.lit(separator), F.lit(""))) + 1)
        cells = [F.when(found > i, F.coalesce(F.col(f"c{i}"), F.lit(""))) for i in range(width)]
    last = {name: i for i, name in enumerate(names)}
    out = [cells[i].alias(name) for name, i in last.items()]
    return rows.select(*out, *([F.struct(*PLACE).alias(free_place(names))] if place else []))


def free_place(names: list[str]) -> str:
    """The name of the column that holds a row's place beside columns of these names."""
    name = "__place"
    while name in names:
        name += "_"
    return name
