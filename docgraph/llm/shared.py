"""Tables that cut lineage, in the folder every executor can reach."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROW = "__row"
BATCH_ROWS = 2000
_fallback: dict[int, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; only where that is unset and the master is local, a new local folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _fallback.setdefault(os.getpid(), "")
        if not path:
            path = _fallback[os.getpid()] = tempfile.mkdtemp(prefix="spark-docgraph-")
    return path.rstrip("/")


def free_name(df: DataFrame, name: str = ROW) -> str:
    """``name``, with as many more underscores as keep it apart from the columns of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def bounded(df: DataFrame) -> DataFrame:
    """``df``, with the session's Arrow batches cut to ``BATCH_ROWS`` rows: whole texts are large rows."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)
    return df


@contextmanager
def arrow_rows(spark: SparkSession, rows: int):
    """Arrow batches of ``rows`` rows for what is run inside, where rows are large."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docgraph-{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, group_rows: int | None = None) -> DataFrame:
    """Write ``df`` once as Parquet under the shared folder and read it back.

    Readers decode up to 4096 rows at once, but never of two row groups: rows of megabytes want ``group_rows``.
    """
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    writer = bounded(df).write.option("compression", "zstd")
    if group_rows:
        writer = writer.option("parquet.block.row.count.limit", group_rows)
    writer.parquet(path)
    table = spark.read.schema(_nullable(df.schema)).parquet(path)
    table.docgraph_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete saved tables that nothing will read again."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.docgraph_path)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def lowest_hashes(df: DataFrame, key: str, count: int, total: int) -> DataFrame:
    """The ``count`` rows of lowest key hash, of ``total``; few others are sorted, however large ``df`` is."""
    hashed = F.xxhash64(key)
    share = (count + 10 * count**0.5 + 100) / max(1, total)
    if share < 1:
        df = df.where(hashed <= F.lit(int(-(2**63) + share * 2**64)))
    return df.orderBy(hashed, key).limit(count)


def number_rows(df: DataFrame, name: str = "rows", column: str = ROW) -> DataFrame:
    """``df`` with a unique long per row, stored so that every later read sees the same numbers."""
    return save(df.withColumn(column, F.monotonically_increasing_id()), name)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
