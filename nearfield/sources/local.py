"""Data sets in folders, and rows exchanged with NumPy and lists; what comes to the driver must fit there."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from pathlib import Path

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.knn import matrix
from .binary import register


@dataclass(frozen=True)
class Paths:
    """The files of a data set."""

    base: str
    queries: str
    truth: str
    outputs: str


def paths_of(name: str, root: str = "data") -> Paths:
    """A folder that exists as it is, any other name below ``root``."""
    top = Path(name) if Path(name).exists() else Path(root) / name
    return Paths(*(str(top / f) for f in ("base.fbin", "query.fbin", "GT", "outputs")))


def data_sets(root: str = "data") -> Iterator[tuple[str, Paths]]:
    """Name and files of every folder below ``root`` that has base rows, by name."""
    for top in sorted(p for p in Path(root).iterdir() if p.is_dir()):
        if (top / "base.fbin").exists():
            yield top.name, paths_of(str(top))


def read_vectors(spark: SparkSession, path: str, element: str = "float") -> DataFrame:
    return register(spark).read.format("vectorfile").option("path", path).option("element", element).load()


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return register(spark).read.format("graphfile").option("path", path).load()


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    return register(spark).read.format("neighbourfile").option("path", path).load()


def from_numpy(spark: SparkSession, rows: np.ndarray) -> DataFrame:
    """id, the place from 0, and vec of the rows of a matrix."""
    if np.ndim(rows) != 2:
        raise ValueError("rows must form a matrix")
    return spark.createDataFrame([(i, r) for i, r in enumerate(np.asarray(rows, float).tolist())], "id long, vec array<float>")


def to_numpy(vectors: DataFrame) -> np.ndarray:
    """The vectors in the order of their ids, as a matrix of 4-byte numbers."""
    return matrix(vectors.orderBy("id").select("vec").toArrow()["vec"].combine_chunks()).astype(np.float32)


def neighbours_to_numpy(found: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids (4 bytes, signed, so that a padded one reads -1) and distances, one row a query in the order of qid."""
    lists = found.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", "nbr", "dist"))).alias("e")).orderBy("qid").select("e.nbr", "e.dist").toArrow()
    ids, dist = (np.array(lists[c].to_pylist()) for c in ("nbr", "dist"))
    return ids.astype(np.int64).astype(np.uint32).view(np.int32), dist.astype(np.float32)


def from_lists(spark: SparkSession, lists: Sequence[Sequence[int]]) -> DataFrame:
    """src and nbrs of a list of neighbours a node."""
    return spark.createDataFrame([(i, [int(n) for n in own]) for i, own in enumerate(lists)], "src long, nbrs array<long>")


def to_lists(adj: DataFrame) -> list[list[int]]:
    return [r["nbrs"] for r in adj.orderBy("src").collect()]


def _uniform(*key) -> Column:
    """A number from 0 up to 1, without 1, from a hash of the key; exact in 4 bytes."""
    return F.pmod(F.xxhash64(*key), F.lit(1 << 24)) / F.lit(float(1 << 24))


def random_vectors(spark: SparkSession, n: int, dim: int, seed: int = 42) -> DataFrame:
    """``n`` vectors of numbers spread evenly over 0 .. 1, the same on every cluster."""
    places = F.sequence(F.lit(0), F.lit(dim - 1))
    return spark.range(n).select("id", F.transform(places, lambda k: _uniform(F.col("id"), k, F.lit(seed))).cast("array<float>").alias("vec"))


def random_graph(spark: SparkSession, n: int, degree: int, seed: int = 42) -> DataFrame:
    """A graph of ``n`` nodes with ``degree`` neighbours each, give or take a fifth; none twice, no loops."""
    least, most = max(0, round(0.8 * degree)), round(1.2 * degree)
    own = F.lit(least) + F.floor(_uniform(F.col("id"), F.lit("degree"), F.lit(seed)) * (most - least + 1)).cast("int")
    # a few more are drawn than needed, as some meet
    drawn = F.transform(F.sequence(F.lit(0), F.lit(4 * most + 8)), lambda k: F.floor(_uniform(F.col("id"), k, F.lit(seed)) * n).cast("long"))
    others = F.array_distinct(F.filter(drawn, lambda x: x != F.col("id")))
    return spark.range(n).select(F.col("id").alias("src"), F.slice(others, F.lit(1), own).alias("nbrs"))
