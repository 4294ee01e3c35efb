"""One large JSON array or delimited file, with records over several lines, split among tasks.

Where a byte stands (in a string or cell, and how deep) depends on everything before it, so a byte range is first scanned for what it
does to either state it may begin in: how many quotes it has, and how the depth changes outside of them.  Summing that up in order
picks the true state of every range, from which its first boundary between records follows.  The chunks
between boundaries are then parsed by tasks of their own.  A file that is not of a regular form is left whole, for the
stream that reads it to say what is wrong; so are compressed files.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..scratch import discard, stored

RANGE_BYTES = 16 << 20
MOST_TASKS = 10_000
_CODECS = r"(?i)\.(gz|gzip|zst|zstd)$"
_CHUNK = "path string, start long, stop long, whole boolean"


def opened(path: str):
    """(file system, place) of a path as Spark names it."""
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if path.startswith("file:/") and not path.startswith("file://") else path)


def bytes_of(path: str, start: int, stop: int) -> bytes:
    system, place = opened(path)
    with system.open_input_file(place) as file:
        return file.read_at(stop - start, start)


def spread(df: DataFrame) -> DataFrame:
    """``df``, a small table of work, with its rows in tasks of their own as far as there are not too many."""
    return df.repartition(max(1, min(MOST_TASKS, df.count())), *[c for c in ("path", "start") if c in df.columns])


def _quotes(data: np.ndarray, path: str, start: int, escapes: bool) -> np.ndarray:
    """Places of the quotes that begin or end something; with ``escapes``, a backslash takes a quote's meaning."""
    at = np.flatnonzero(data == 34)
    if not escapes or not len(at):
        return at
    after = at[(at > 0) & (data[np.maximum(at - 1, 0)] == 92)]
    dropped = []
    for place in after.tolist():
        run = 1
        while place - run - 1 >= 0 and data[place - run - 1] == 92:
            run += 1
        if run == place:
            run += _backslashes_before(path, start)
        if run % 2:
            dropped.append(place)
    if at[0] == 0 and start and _backslashes_before(path, start) % 2:
        dropped.append(0)
    return np.setdiff1d(at, dropped, assume_unique=True)


def _backslashes_before(path: str, start: int) -> int:
    count, size = 0, 64
    while start - count > 0:
        back = bytes_of(path, max(0, start - count - size), start - count)
        run = len(back) - len(back.rstrip(b"\\"))
        count += run
        if run < len(back):
            break
    return count


_SIGNS = np.zeros(256, np.int8)
_SIGNS[[ord("["), ord("{")]] = 1
_SIGNS[[ord("]"), ord("}")]] = -1


def _effect(json: bool):
    """What each range does: the parity of its quotes, and the change of depth if it begins outside or inside a string."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, start, stop in zip(batch["path"], batch["start"], batch["stop"]):
                data = np.frombuffer(bytes_of(path, start, stop), np.uint8)
                quotes = _quotes(data, path, start, json)
                outside = inside = 0
                if json:
                    places = np.flatnonzero(_SIGNS[data])
                    odd = np.searchsorted(quotes, places) % 2 == 1
                    signs = _SIGNS[data[places]].astype(np.int64)
                    outside, inside = int(signs[~odd].sum()), int(signs[odd].sum())
                out.append((path, start, stop, len(quotes) % 2, outside, inside))
            yield pd.DataFrame(out, columns=["path", "start", "stop", "parity", "outside", "inside"])

    return run


def _first_element(data: np.ndarray, quotes: np.ndarray, start: int, within: int, depth: int) -> int:
    """The first comma between elements, or the array's opening; -1 if there is none, -2 if the text is no array."""
    if start == 0:
        text = data[:4096].tobytes().lstrip(b" \t\r\n")
        return len(data[:4096]) - len(text) if text[:1] == b"[" else -2
    places = np.flatnonzero((_SIGNS[data] != 0) | (data == 44))
    places = places[(np.searchsorted(quotes, places) + within) % 2 == 0]
    level = depth + np.cumsum(_SIGNS[data[places]].astype(np.int64))
    found = places[(data[places] == 44) & (level == 1)]
    return int(found[0]) if len(found) else -1


def _first_record(data: np.ndarray, quotes: np.ndarray, start: int, within: int, around: tuple[bytes, bytes], separator: int) -> int:
    """The first byte of a record that begins in the range, or -1; -2 where a quote stands elsewhere than at a cell's ends."""
    ends = np.array([separator, 10, 13], np.uint8)
    kinds = (np.arange(len(quotes)) + within) % 2  # 0: opens, 1: closes
    before = np.append(np.frombuffer(around[0] or b"\n", np.uint8)[-1:], data)[quotes]
    after = np.append(data, np.frombuffer(around[1] or b"\n", np.uint8)[:1])[quotes + 1]
    if not (np.isin(before[kinds == 0], ends) | (before[kinds == 0] == 34)).all() or not (np.isin(after[kinds == 1], ends) | (after[kinds == 1] == 34)).all():
        return -2
    if start == 0:
        return 0
    breaks = np.flatnonzero(data == 10)
    breaks = breaks[(np.searchsorted(quotes, breaks) + within) % 2 == 0]
    return int(breaks[0]) + 1 if len(breaks) else -1


def _boundaries(json: bool, separator: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.itertuples():
                data = np.frombuffer(bytes_of(row.path, row.start, row.stop), np.uint8)
                quotes = _quotes(data, row.path, row.start, json)
                if json:
                    first = _first_element(data, quotes, row.start, row.within, row.depth)
                else:
                    around = bytes_of(row.path, max(0, row.start - 1), row.start), bytes_of(row.path, row.stop, min(row.length, row.stop + 1))
                    first = _first_record(data, quotes, row.start, row.within, around, ord(separator))
                out.append((row.path, row.length, row.start + first if first >= 0 else None, first == -2))
            yield pd.DataFrame(out, columns=["path", "length", "start", "odd"]).astype({"start": "Int64"})

    return run


def chunks(spark: SparkSession, path: str, json: bool, separator: str = ",") -> DataFrame:
    """(path, start, stop, whole): byte ranges of whole records of the files of a read, or whole files that are not to be split."""
    files = stored(spark.read.format("binaryFile").load(path).select("path", "length"), "files")
    small = (F.col("length") <= RANGE_BYTES) | F.col("path").rlike(_CODECS)
    alone = files.where(small).select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"), F.lit(True).alias("whole"))
    large = files.where(~small)
    if large.isEmpty():
        return alone
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(RANGE_BYTES).cast("long")))
    ranges = large.select("path", "length", starts.alias("start")).withColumn("stop", F.least(F.col("start") + RANGE_BYTES, "length"))
    effects = stored(spread(ranges.select("path", "start", "stop")).mapInPandas(_effect(json), "path string, start long, stop long, parity long, outside long, inside long"), "effects")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    within = F.coalesce(F.sum("parity").over(before), F.lit(0)) % 2
    change = F.when(F.col("within") == 0, F.col("outside")).otherwise(F.col("inside"))
    known = effects.withColumn("within", within).withColumn("change", change).withColumn("depth", F.coalesce(F.sum("change").over(before), F.lit(0)))
    known = stored(known.join(large, "path").select("path", "length", "start", "stop", "within", "depth", "parity", "change"), "states")
    marks = stored(spread(known).mapInPandas(_boundaries(json, separator), "path string, length long, start long, odd boolean"), "boundaries")
    ends = known.groupBy("path").agg((F.sum("parity") % 2 == 1).alias("open"), F.sum("change").alias("rest"))
    regular = marks.groupBy("path").agg(F.max("odd").alias("odd")).join(ends, "path").where("NOT odd AND NOT open AND rest = 0").select("path")
    follows = F.lead("start").over(Window.partitionBy("path").orderBy("start"))
    cut = marks.where("start IS NOT NULL").select("path", "length", "start").distinct().join(regular, "path", "left_semi")
    cut = cut.select("path", "start", F.coalesce(follows, F.col("length")).alias("stop"), F.lit(False).alias("whole"))
    whole = large.join(regular, "path", "left_anti").select("path", F.lit(0).cast("long").alias("start"), F.col("length").alias("stop"), F.lit(True).alias("whole"))
    out = stored(alone.unionByName(cut).unionByName(whole), "chunks")
    discard(files, effects, known, marks)
    return out
