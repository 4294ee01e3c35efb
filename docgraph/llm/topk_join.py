"""Exact top-k inner products by a Voronoi kNN join.

Pivots, chosen from a bounded sample, divide the vectors into cells.  Summaries of
the cells (the least distances to the pivot) and the sample itself give every query a
score that at least k candidates are sure to reach, and with it, for every cell, the distance to the
pivot from which a vector has a chance of that score.  Queries of near cells form groups; a group's
bound is its lowest.  A vector is replicated to a group only if it lies beyond the group's bound for
its cell.  Each (group, piece of a cell) is solved locally, and the local winners are merged.

Vectors are whole numbers (floor(scale * x)); scores are exact integers.  The bounds
only prune, with slack for rounding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .shared import lowest_hashes, save

#: Bounds of what the driver holds: pivots are the root of the rows, within these, and the sample has some rows for each.
PIVOTS = (16, 4096)
SAMPLE_PER_PIVOT = 16
SAMPLE = 4096
GROUP_QUERIES = 256
BLOCK_VECTORS = 16_384
_NO_ID = (1 << 63) - 1  # stands for a null id while vectors are compared


def _quantise(scale: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, vectors = [], []
            for i, values in enumerate(batch.column(3).to_pylist()):
                if values is None or any(v is None for v in values):
                    continue
                whole = np.floor(np.array(values, np.float64) * scale)
                if not np.isfinite(np.array(values, np.float64)).all():
                    continue
                if not (np.abs(whole) < 2.0**62).all():
                    raise ValueError(f"a scaled component of {np.abs(whole).max():.3g} is no long, and so no score with it is")
                keep.append(i)
                vectors.append(whole.astype("<i8").tobytes())
            at = pa.array(keep, pa.int64())
            columns = [*(batch.column(k).take(at) for k in range(3)), pa.array(vectors, pa.binary()), pa.array([len(v) // 8 for v in vectors], pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "row", "query", "v", "dim"])

    return run


def _matrix(vectors, dim: int, dtype=np.float64) -> np.ndarray:
    """Rows of little-endian longs; shorter ones are filled with zeros."""
    vectors = list(vectors)
    data = b"".join(v if len(v) == dim * 8 else v.ljust(dim * 8, b"\0") for v in vectors)
    return np.frombuffer(data, "<i8").reshape(len(vectors), dim).astype(dtype)


def _pivots(sample: np.ndarray, count: int) -> np.ndarray:
    """Centres of a few rounds of k-means on the sample, from evenly spaced starts."""
    centres = sample[np.linspace(0, len(sample) - 1, min(count, len(sample))).astype(int)]
    for _ in range(8):
        cell, _ = _nearest(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, cell, sample)
        sizes = np.bincount(cell, minlength=len(centres))
        centres = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centres)
    return centres


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cell = np.argmin((centres**2).sum(1) - 2 * x @ centres.T, axis=1)
    return cell, np.sqrt(((x - centres[cell]) ** 2).sum(1))


def _cells(pivots: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(3).to_pylist(), pivots.shape[1])
            cell, far = _nearest(x, pivots) if len(x) else (np.zeros(0, int), np.zeros(0))
            norm = np.sqrt((x**2).sum(1)) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(cell.astype(np.int32)), pa.array(far), pa.array(norm)], names=["id", "row", "query", "v", "cell", "far", "norm"])

    return run


def _chain(pivots: np.ndarray) -> list[int]:
    """The cells in an order in which each is followed by the nearest of those left."""
    left, order = np.ones(len(pivots), bool), [0]
    left[0] = False
    while left.any():
        far = ((pivots - pivots[order[-1]]) ** 2).sum(1)
        order.append(int(np.argmin(np.where(left, far, np.inf))))
        left[order[-1]] = False
    return order


def _bounds(pivots: np.ndarray, sample: np.ndarray, least: pd.DataFrame, k: int):
    """Of a group of queries: for each cell, the distance to its pivot from which a vector may matter to one of them."""
    cell, far = least.cell.to_numpy(), least.far.to_numpy()
    farthest = far.max() if len(far) else 0.0

    def best(scores: np.ndarray) -> np.ndarray:
        """The score of place k + 1 in each line, since one of them may be the query itself."""
        return -np.partition(-scores, k, axis=1)[:, k] if scores.shape[1] > k else np.full(len(scores), -np.inf)

    def run(queries: pd.DataFrame) -> pd.DataFrame:
        q = _matrix(queries.v, pivots.shape[1])
        norm = np.sqrt((q**2).sum(1))[:, None]
        to_pivot, to_sample = q @ pivots.T, q @ sample.T
        reached = np.maximum(best(to_pivot[:, cell] - norm * far), best(to_sample))[:, None]
        slack = 1e-9 * (np.abs(to_pivot).max() + np.abs(to_sample).max() + norm * farthest + 1)
        with np.errstate(divide="ignore", invalid="ignore"):
            bound = np.where(norm > 0, (reached - to_pivot - slack) / norm, -np.inf)
        return pd.DataFrame({"grp": queries.grp.iat[0], "cell": np.arange(len(pivots)), "bound": bound.min(axis=0)})

    return run


def exact_top_k(df: DataFrame, is_query: Column, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = 1024.0) -> DataFrame:
    """The k highest inner products of each query row with every other row: query_id, rank, vec_id, score.

    Defined results: vectors that are null or hold null or non-finite components
    take no part; a shorter vector counts as filled with zeros; ties go to the smaller
    id (null ids last), then to the earlier row; repeated rows are candidates of each
    other; fewer candidates give fewer ranks; an empty table gives no rows; other
    columns are not read.  A finite component that is no long after scaling, or a score
    that is none, fails the job: no vector is left out for its size.
    """
    spark = df.sparkSession
    source = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("id"), F.monotonically_increasing_id().alias("row"), F.coalesce(is_query, F.lit(False)).alias("query"), F.col(vector_col).cast("array<double>").alias("v"))
    vectors = save(source.mapInArrow(_quantise(scale), "id long, row long, query boolean, v binary, dim int"), "vectors")
    result = "query_id long, rank int, vec_id long, score long"
    dim, total, queries = vectors.agg(F.max("dim"), F.count("*"), F.count_if("query")).first()
    if not queries:
        return spark.createDataFrame([], result)
    width = max(1, dim)
    count = int(min(max(total**0.5, PIVOTS[0]), PIVOTS[1]))
    sample = _matrix((r.v for r in lowest_hashes(vectors, "row", max(SAMPLE, SAMPLE_PER_PIVOT * count), total).select("v").collect()), width)
    pivots = _pivots(sample, count)
    placed = save(vectors.mapInArrow(_cells(pivots), "id long, row long, query boolean, v binary, cell int, far double, norm double"), "cells")

    nearest = Window.partitionBy("cell").orderBy("far")
    part = placed.select("cell", "far", F.spark_partition_id().alias("part"))
    few = part.withColumn("r", F.row_number().over(Window.partitionBy("part", "cell").orderBy("far"))).where(F.col("r") <= k + 1)
    least = few.withColumn("r", F.row_number().over(nearest)).where(F.col("r") <= k + 1).select("cell", "far").toPandas()

    # One row for each cell, of which there are at most PIVOTS[1]: its vectors' number and reach, and its queries' groups.
    cells = {r.cell: r for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.count_if("query").alias("queries"), F.max("far").alias("reach")).collect()}
    rows, at, held = [], 0, 0
    for cell in (c for c in _chain(pivots) if c in cells):
        n = cells[cell].queries
        split = max(1, -(-n // GROUP_QUERIES))
        if held and held + n > GROUP_QUERIES:
            at, held = at + 1, 0
        rows.append((cell, at, split, max(1, -(-cells[cell].n // BLOCK_VECTORS)), cells[cell].reach))
        at, held = (at + split, 0) if split > 1 else (at, held + n)
    layout = F.broadcast(spark.createDataFrame(rows, "cell int, first int, split int, pieces int, reach double"))
    drawn = F.xxhash64("row")
    grp = (F.col("first") + F.pmod(drawn, F.col("split"))).cast("int").alias("grp")
    queries_of = save(placed.where("query").join(layout, "cell").select(grp, "id", "row", "v"), "queries")
    bounds = queries_of.groupBy("grp").applyInPandas(_bounds(pivots, sample[:SAMPLE], least, k), "grp int, cell int, bound double")
    bounds = save(bounds.join(layout.select("cell", "pieces", "reach"), "cell").where("reach >= bound").drop("reach"), "bounds")
    needed = placed.join(bounds, "cell").where("far >= bound").select("grp", "cell", F.pmod(drawn, F.col("pieces")).cast("int").alias("piece"), "id", "row", "v")
    wanted = bounds.select("grp", "cell", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    asked = queries_of.join(wanted, "grp").select("grp", "cell", "piece", "id", "row", "v")

    def solve(q: pd.DataFrame, x: pd.DataFrame) -> pd.DataFrame:
        if not len(q) or not len(x):
            return pd.DataFrame({c: pd.Series(dtype="Int64") for c in ("row", "query_id", "vec_id", "score", "vec_row")})
        a, b = _matrix(q.v, width), _matrix(x.v, width)
        ids, rows = x.id.to_numpy(np.int64), x.row.to_numpy(np.int64)
        exact = np.abs(a).max() * np.abs(b).max() * width < 2.0**53
        if not exact:
            a, b = _matrix(q.v, width, object), _matrix(x.v, width, object)
        out = []
        for at in range(0, len(a), 256):
            scores = a[at : at + 256] @ b.T
            for i, line in enumerate(scores):
                own = q.row.iat[at + i]
                if exact and len(line) > k + 1:
                    floor = np.partition(line, len(line) - k - 1)[len(line) - k - 1]
                    near = np.flatnonzero(line >= floor)  # k + 1 at least, and every tie
                else:
                    near = np.arange(len(line))
                near = near[rows[near] != own]
                value = np.array([int(s) for s in line[near]], np.int64)
                order = np.lexsort((rows[near], ids[near], -value))[:k]
                out += [(own, q.id.iat[at + i], ids[near[o]], value[o], rows[near[o]]) for o in order]
        return pd.DataFrame(out, columns=["row", "query_id", "vec_id", "score", "vec_row"]).astype("Int64")

    by = ("grp", "cell", "piece")
    local = asked.groupBy(*by).cogroup(needed.groupBy(*by)).applyInPandas(solve, "row long, query_id long, vec_id long, score long, vec_row long")
    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = local.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    id_or_null = F.when(F.col("vec_id") != _NO_ID, F.col("vec_id"))
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), id_or_null.alias("vec_id"), "score")
