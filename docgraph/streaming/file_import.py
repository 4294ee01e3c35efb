"""Continuous import: new JSON-lines files are loaded into a collection, each once."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.catalog import Database
from ..operators.edges import preflight


#: Order of the lines of a batch: files by age, then by name, then by place.
ORDER = ["file_time", "file", "file_start", "line"]


def document_stream(spark: SparkSession, folder: str) -> DataFrame:
    lines = spark.readStream.format("text").option("lineSep", "\n").load(folder)
    place = ("modification_time", "path", "block_start")
    lines = lines.select(F.trim("value").alias("doc"), *[F.col(f"_metadata.file_{p}").alias(c) for p, c in zip(place, ORDER)])
    return lines.where("doc <> ''").withColumn("_key", F.get_json_object("doc", "$._key"))


def import_new_files(spark: SparkSession, folder: str, db: Database, collection: str, checkpoint: str, mode: str = "ignore", edges: tuple[str | None, str | None] | None = None) -> int:
    """Loads all files that earlier calls have not loaded, and returns how many batches that took.

    The stream's checkpoint remembers the files; keys of lines without one follow from the checkpoint's path, the
    batch's number and the line, and the load is idempotent under ignore, replace and update, so a batch that is run
    again after a failure does no harm.
    """

    def load(batch: DataFrame, number: int) -> None:
        batch = batch.withColumn("line", F.monotonically_increasing_id())
        if edges is not None:
            batch = preflight(batch.select("*", F.get_json_object("doc", "$._from").alias("_from"), F.get_json_object("doc", "$._to").alias("_to")), *edges)
        db.load(collection, batch, mode, order=ORDER, load_id=hashlib.sha256(f"{checkpoint}|{number}".encode()).hexdigest())

    query = document_stream(spark, folder).writeStream.foreachBatch(load).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return sum(1 for p in query.recentProgress if p["numInputRows"])
