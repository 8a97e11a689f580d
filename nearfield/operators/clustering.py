"""k-means on DataFrames.

Centroids are few (k rows) and travel with the closure; the rows are assigned
where they are, and only k partial sums a task are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.vectors import pair_distances
from .knn import matrix

#: Bytes of centroids at most: they travel to every task.
CENTROID_BYTES = 64 << 20


def _near(x: np.ndarray, centroids: np.ndarray, s: int) -> tuple[np.ndarray, np.ndarray]:
    """The s nearest centroids of each row, nearest first, ties by number; and their distances."""
    d = np.stack([pair_distances("squared_euclidean", x, c[None, :]) for c in centroids], axis=1)
    order = np.argsort(d, axis=1, kind="stable")[:, :s]
    return order, np.sqrt(np.take_along_axis(d, order, 1))


def drawn(vectors: DataFrame, k: int, seed: int = 0) -> np.ndarray:
    """k rows to begin with, the first by a seeded hash of their ids."""
    rows = vectors.orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(k).select("vec").toArrow()
    return matrix(rows["vec"].combine_chunks())


def _checked(centroids: np.ndarray) -> np.ndarray:
    if centroids.nbytes > CENTROID_BYTES:
        raise ValueError(f"{centroids.nbytes} bytes of centroids; at most {CENTROID_BYTES} travel to every task")
    return centroids


def assigned(vectors: DataFrame, centroids: np.ndarray, s: int = 1) -> DataFrame:
    """id, cid, rank and dist of the ``s`` nearest centroids of each row, nearest first, ties by number."""
    _checked(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near, d = _near(matrix(b.column(1)), centroids, min(s, len(centroids)))
                m = near.shape[1]
                ids = np.repeat(b.column(0).to_numpy(zero_copy_only=False), m)
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(near.ravel()), pa.array(np.tile(np.arange(m, dtype=np.int32), b.num_rows)), pa.array(d.ravel())], ["id", "cid", "rank", "dist"])

    return vectors.select("id", "vec").mapInArrow(run, "id long, cid long, rank int, dist double")


def updated(vectors: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The means of the rows nearest to each centroid; a centroid without rows stays."""
    _checked(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros_like(centroids, dtype=float), np.zeros(len(centroids))
        for b in batches:
            if b.num_rows:
                x = matrix(b.column(1))
                own = _near(x, centroids, 1)[0][:, 0]
                np.add.at(total, own, x)
                n += np.bincount(own, minlength=len(n))
        at = np.flatnonzero(n)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(list(total[at]), pa.list_(pa.float64()))], ["cid", "n", "total"])

    parts = vectors.select("id", "vec").mapInArrow(run, "cid long, n double, total array<double>")
    summed = parts.select("cid", "n", F.posexplode("total").alias("pos", "x")).groupBy("cid", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
    out = centroids.astype(float).copy()
    for r in summed.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("pos", "x"))).alias("v")).collect():  # k rows
        out[r["cid"]] = [p["x"] for p in r["v"]]
    return out


def kmeans(vectors: DataFrame, k: int, max_iter: int = 10, epsilon: float = 0.0, init: np.ndarray | None = None, seed: int = 0) -> np.ndarray:
    """Lloyd's centroids: at most ``max_iter`` updates, fewer where no coordinate moves by epsilon or more.

    The first update is always made; 0 rounds return the initial rows.
    """
    centroids = np.asarray(init, float) if init is not None else drawn(vectors, k, seed)
    for _ in range(max_iter):
        new = updated(vectors, centroids)
        moved = np.abs(new - centroids).max(initial=0)
        centroids = new
        if moved <= epsilon:
            break
    return centroids
