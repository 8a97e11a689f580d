"""Near-duplicate vectors without comparing all pairs.

Exact copies are grouped first, so that a heap of them is one row.  The
distances of two rows to any pivot differ by no more than the rows' own
distance: only rows whose distances to every pivot differ by less than the
radius are compared.  Nothing is lost, whatever the pivots.  This pays where the
radius is small beside the spread of the rows; ``knn.within`` without pivots
compares everything.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import knn
from .edits import sampled
from .graphs import components


def _around(rows: DataFrame, radius: float, pivots: int, seed: int) -> list[np.ndarray]:
    """Vectors of a few rows, as pivots."""
    if not radius > 0:
        raise ValueError("the radius must be above 0")
    return [np.array(r["vec"], float) for r in sampled(rows, pivots, seed).collect()]


def near_pairs(vectors: DataFrame, radius: float, pivots: int = 3, seed: int = 0) -> DataFrame:
    """i < j and d of all pairs of rows (id, vec) strictly nearer than ``radius``.

    Null vectors are near nothing; vectors must be unlike each other, as copies
    of one would all meet.
    """
    rows = vectors.where("vec is not null").select("id", "vec")
    return knn.within(rows, radius, _around(rows, radius, pivots, seed))


def groups(vectors: DataFrame, radius: float = 1e-9, pivots: int = 3) -> DataFrame:
    """id, component (its smallest id) and size of every row that has one nearer than ``radius``, over any number of steps."""
    rows = vectors.where("vec is not null").select("id", "vec")
    kinds = rows.groupBy("vec").agg(F.min("id").alias("kind"))
    one = kinds.select(F.col("kind").alias("id"), "vec")
    label = components(one.select("id"), knn.linked(one, radius, _around(one, radius, pivots, 0))).withColumnRenamed("id", "kind")
    each = rows.join(kinds, "vec").select("id", "kind").join(label, "kind").select("id", "component")
    size = each.groupBy("component").agg(F.count("*").alias("size")).where("size > 1")
    return each.join(size, "component").select("id", "component", "size")


def totals(found: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: how many groups, the rows in them, and their share of all rows in percent (two decimals; 0 without rows)."""
    own = found.agg(F.countDistinct("component").alias("sets"), F.count("*").alias("members"))
    share = F.coalesce(F.round(100.0 * F.col("members") / F.nullif(F.col("n"), F.lit(0)), 2), F.lit(0.0))
    return own.crossJoin(F.broadcast(vectors.agg(F.count("*").alias("n")))).select("sets", "members", share.alias("percent"))
