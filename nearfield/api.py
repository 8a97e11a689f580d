"""Vector sets, subsets and graphs as objects, over the operators; edits return a new graph."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.vectors import pair_distances
from .operators import cliques, edits, graphs, knn, prune, search
from .sources.local import from_lists, from_numpy, read_graph, read_vectors


class VectorSet:
    """Rows (id, vec) with ids from 0 on, from a matrix, a file or a DataFrame."""

    def __init__(self, spark: SparkSession, rows: np.ndarray | str | DataFrame) -> None:
        self.spark = spark
        self.rows = rows if isinstance(rows, DataFrame) else read_vectors(spark, rows) if isinstance(rows, str) else from_numpy(spark, rows)
        self.n, self.dim = (x or 0 for x in self.rows.agg(F.count("*"), F.max(F.size("vec"))).first())

    def size(self) -> int:
        return self.n

    def _within(self, *ids: int) -> None:
        for i in ids:
            if not 0 <= i < self.n:
                raise IndexError(f"row {i} of {self.n}")

    def _query(self, q: Sequence[float]) -> DataFrame:
        if len(q) != self.dim:
            raise ValueError(f"a query of {len(q)} numbers; rows have {self.dim}")
        return self.spark.createDataFrame([(-1, [float(x) for x in q])], "qid long, qvec array<double>")

    def get_vector(self, i: int) -> np.ndarray:
        self._within(i)
        return np.array(self.rows.where(F.col("id") == i).first()["vec"], np.float32)

    def compare(self, q: Sequence[float], i: int) -> float:
        """The distance of a vector and a row."""
        self._query(q)
        return float(pair_distances("euclidean", np.asarray(q, float)[None], self.get_vector(i).astype(float)[None])[0])

    def compare_internal(self, i: int, j: int) -> float:
        self._within(i, j)
        return self.compare(self.get_vector(i).tolist(), j)

    def brute_force(self, q: Sequence[float], k: int | None = None) -> DataFrame:
        """rank, nbr and dist of the ``k`` nearest rows, or of all."""
        return knn.knn(self._query(q), self.rows, k or max(1, self.n)).select("rank", "nbr", "dist")

    def brute_force_internal(self, i: int, k: int | None = None) -> DataFrame:
        return self.brute_force(self.get_vector(i).tolist(), k)

    def brute_force_subset(self, q: Sequence[float], ids: Sequence[int], k: int | None = None) -> DataFrame:
        """As ``brute_force``, among the rows named."""
        self._within(*ids)
        chosen = self.spark.createDataFrame([(int(i),) for i in set(ids)], "id long")
        return knn.knn(self._query(q), self.rows.join(chosen, "id", "left_semi"), k or max(1, len(ids))).select("rank", "nbr", "dist")

    def brute_force_subset_internal(self, i: int, ids: Sequence[int], k: int | None = None) -> DataFrame:
        return self.brute_force_subset(self.get_vector(i).tolist(), ids, k)

    def build_global_local_graph(self, alpha: float = 1.0) -> VectorGraph:
        """Each row's neighbours chosen among all others as a cover of what they are nearer to."""
        return VectorGraph(self.spark, prune.global_local(self.rows, lambda c, x: prune.set_cover(c, x, alpha)))


class Subset(VectorSet):
    """The rows of another set that ``ids`` lists, numbered from 0; repeats are allowed."""

    def __init__(self, whole: VectorSet, ids: Sequence[int]) -> None:
        whole._within(*ids)
        self.whole, self.ids = whole, [int(i) for i in ids]
        chosen = whole.spark.createDataFrame(list(enumerate(self.ids)), "sub_id long, id long")
        super().__init__(whole.spark, knn.subset(whole.rows, chosen).select(F.col("sub_id").alias("id"), "vec"))

    def original(self, i: int) -> int:
        """The row's place in the whole set."""
        self._within(i)
        return self.ids[i]

    def further(self, places: Sequence[int]) -> Subset:
        """A subset of this subset, of the same whole."""
        self._within(*places)
        return Subset(self.whole, [self.ids[p] for p in places])


class VectorGraph:
    """Lists of neighbours (src, nbrs), from lists, a file or a DataFrame."""

    def __init__(self, spark: SparkSession, lists: Sequence[Sequence[int]] | str | DataFrame) -> None:
        self.spark = spark
        self.adj = lists if isinstance(lists, DataFrame) else read_graph(spark, lists) if isinstance(lists, str) else from_lists(spark, lists)

    @classmethod
    def empty(cls, spark: SparkSession, n: int) -> VectorGraph:
        return cls(spark, edits.empty_graph(spark.range(n)))

    @property
    def n(self) -> int:
        return self.adj.count()

    @property
    def edges(self) -> DataFrame:
        return graphs.edges_of(self.adj)

    def get_neighborhood(self, i: int) -> list[int]:
        row = self.adj.where(F.col("src") == i).first()
        if row is None:
            raise IndexError(f"no node {i}")
        return row["nbrs"]

    def total_edges(self) -> int:
        return graphs.statistics(self.adj).first()["edges"]

    def max_degree(self) -> int:
        return graphs.statistics(self.adj).first()["max_degree"]

    def _nodes(self) -> DataFrame:
        return self.adj.select(F.col("src").alias("id"))

    def maximal_cliques(self) -> DataFrame:
        """members of every maximal clique, an edge counting in both directions."""
        e = self.edges.select("src", "dst")
        return cliques.maximal(self._nodes(), e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())

    def maximal_bidirectional_cliques(self) -> DataFrame:
        """members of every maximal clique of mutual edges."""
        return cliques.maximal(self._nodes(), self.edges)

    def maximal_independent_cliques(self) -> DataFrame:
        return cliques.disjoint(self.maximal_cliques())

    def maximal_independent_bidirectional_cliques(self) -> DataFrame:
        return cliques.disjoint(self.maximal_bidirectional_cliques())

    def _known(self, *ids: int) -> None:
        have = {r["src"] for r in self.adj.where(F.col("src").isin([int(i) for i in ids])).select("src").collect()}
        for i in ids:
            if i not in have:
                raise IndexError(f"no node {i}")

    def set_neighborhood(self, i: int, nbrs: Sequence[int]) -> VectorGraph:
        self._known(i, *nbrs)
        new = self.spark.createDataFrame([(i, [int(n) for n in nbrs])], "src long, nbrs array<long>")
        return VectorGraph(self.spark, edits.set_neighbours(self.adj, new))

    def add_neighbor(self, i: int, j: int) -> VectorGraph:
        self._known(i, j)
        new = self.spark.createDataFrame([(i, [j])], "src long, nbrs array<long>")
        return VectorGraph(self.spark, edits.appended(self.adj, new))

    def transparent_beam_search(self, vectors: VectorSet, q: Sequence[float], start: int, width: int, limit: int | None = None) -> DataFrame:
        """beam, visited, steps and compared of one search from ``start``."""
        self._known(start)
        return search.from_adjacency(vectors.rows, self.adj).walks(vectors._query(q), width, limit, start).select("beam", "visited", "steps", "compared")
