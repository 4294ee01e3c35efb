"""Imports that go on where they were stopped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, stored
from .batching import MAX_BYTES, MAX_DOCS, assign_batches
from .catalog import CatalogError, Database

BATCHES_PER_LOAD = 64


def load_in_steps(
    db: Database, name: str, rows: DataFrame, mark: str, mode: str = "error", order: list[str] | None = None,
    max_bytes: int = MAX_BYTES, max_docs: int = MAX_DOCS, batches_per_load: int = BATCHES_PER_LOAD,
) -> dict:
    """Load rows (as ``Database.load`` takes them) in steps of whole batches, under the name ``mark``.

    A step's rows and the number of its last batch are published together or not at all, so an import of the same rows
    under the same name that is run again, after it was stopped at any point, skips the batches that are in, and loads the rest once.
    Returns the counts of this run, with ``batches`` and ``skipped_batches``.
    """
    order = order or ["ordinal"]
    batches = assign_batches(rows, order, max_bytes, max_docs)
    step = F.floor((F.col("batch_index") - 1) / batches_per_load).cast("int").alias("step")
    held = stored(batches.select("*", step).repartition("step"), "import")
    last = held.agg(F.max("batch_index")).first()[0] or 0
    done = db.progress(name, mark)
    if done > last:
        raise CatalogError(f"the import '{mark}' has loaded {done} batches, and these rows are {last}: they are others")
    counts = {"created": 0, "updated": 0, "ignored": 0, "errors": 0}
    for k in range(done // batches_per_load, -(-last // batches_per_load)):
        upto = min(last, (k + 1) * batches_per_load)
        if upto <= done:
            continue
        some = held.where((F.col("step") == k) & (F.col("batch_index") > done)).drop("step", "batch_index")
        for kind, n in db.load(name, some, mode, order=order, progress=(mark, upto)).items():
            counts[kind] += n
    discard(held)
    return {**counts, "batches": last, "skipped_batches": done}
