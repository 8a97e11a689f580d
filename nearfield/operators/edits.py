"""Edits of graphs held as lists (src, nbrs), and rows picked, put in order and measured."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import metric as metric_of
from ..functions.vectors import recall
from . import knn


class Index(Protocol):
    """What every index offers: the ``k`` nearest (qid, rank, nbr, dist) of queries (qid, qvec)."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


def empty_graph(nodes: DataFrame) -> DataFrame:
    """Every node (id) without neighbours."""
    return nodes.select(F.col("id").alias("src"), F.array().cast("array<long>").alias("nbrs"))


def _bounded(adj: DataFrame, bound: int | None) -> DataFrame:
    """The graph; a longer list than ``bound`` is an error when it is computed."""
    if bound is None:
        return adj
    over = F.raise_error(F.concat(F.lit("too many neighbours of "), F.col("src").cast("string"))).cast("array<long>")
    return adj.select("src", F.when(F.size("nbrs") <= bound, F.col("nbrs")).otherwise(over).alias("nbrs"))


def set_neighbours(adj: DataFrame, new: DataFrame, bound: int | None = None) -> DataFrame:
    """The lists of ``new`` (src, nbrs, one row a node) in place of the old; nodes that the graph lacks are ignored."""
    new = new.select(F.col("src").alias("_src"), F.col("nbrs").alias("_nbrs"))
    return _bounded(adj.join(new, F.col("src") == F.col("_src"), "left").select("src", F.coalesce("_nbrs", "nbrs").alias("nbrs")), bound)


def cleared(adj: DataFrame, nodes: DataFrame) -> DataFrame:
    """The graph with the lists of these nodes (src) emptied."""
    return set_neighbours(adj, nodes.select("src", F.array().cast("array<long>").alias("nbrs")).dropDuplicates(["src"]))


def appended(adj: DataFrame, more: DataFrame, bound: int | None = None) -> DataFrame:
    """The lists of ``more`` (src, nbrs, one row a node) behind the old ones."""
    more = more.select(F.col("src").alias("_src"), F.col("nbrs").alias("_nbrs"))
    nbrs = F.concat("nbrs", F.coalesce("_nbrs", F.array().cast("array<long>")))
    return _bounded(adj.join(more, F.col("src") == F.col("_src"), "left").select("src", nbrs.alias("nbrs")), bound)


def mapped(adj: DataFrame, change: Callable[[Column, Column], Column]) -> DataFrame:
    """Every list as ``change`` makes it from the node and its list."""
    return adj.select("src", change(F.col("src"), F.col("nbrs")).alias("nbrs"))


def ordered(adj: DataFrame, compare: Callable[[Column, Column], Column]) -> DataFrame:
    """Every list sorted by a comparator: negative, zero or positive for two neighbours."""
    return mapped(adj, lambda _, nbrs: F.array_sort(nbrs, compare))


def by_metric(edges: DataFrame, vectors: DataFrame, metric: str = "inner_product") -> DataFrame:
    """Edges (src, pos, dst) with every node's neighbours put in the order of a metric, ties by id; the inner product counts negated."""
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    d = edges.select("src", "dst").join(a, "src").join(b, "dst").select("src", "dst", metric_of(metric)(F.col("_a"), F.col("_b")).alias("_d"))
    return d.select("src", (F.row_number().over(Window.partitionBy("src").orderBy("_d", "dst")) - 1).alias("pos"), "dst")


def closer_than(edges: DataFrame, radius: float) -> DataFrame:
    """Edges with d below the radius, strictly."""
    return edges.where(F.col("d") < radius)


def average_degree(adj: DataFrame) -> DataFrame:
    """One row: the mean degree as a whole number, rounded down; 0 without nodes."""
    return adj.agg(F.coalesce(F.expr("sum(size(nbrs)) div count(*)"), F.lit(0)).cast("long").alias("avg_degree"))


def sorted_lists(pairs: DataFrame) -> DataFrame:
    """i, pos, j and d: for every row all others of ``pairs`` (i < j, d), nearest first, null ones last, ties by id."""
    both = pairs.select("i", "j", "d").unionByName(pairs.select(F.col("j").alias("i"), F.col("i").alias("j"), "d"))
    return both.select("i", (F.row_number().over(Window.partitionBy("i").orderBy(F.asc_nulls_last("d"), "j")) - 1).alias("pos"), "j", "d")


def sorted_distances(vectors: DataFrame) -> DataFrame:
    """What ``sorted_lists`` gives for ``knn.distances``; where the vectors fit a task and no id comes twice, without a shuffle of distances."""
    there = knn.sorted_distances(vectors)
    return there if there is not None else sorted_lists(knn.distances(vectors))


def sorted_others(vectors: DataFrame) -> DataFrame:
    """What ``sorted_lists`` gives for the pairs at a finite distance, of vectors of one length; where the vectors fit a task, without a shuffle of distances."""
    there = knn.sorted_others(vectors)
    return there if there is not None else sorted_lists(knn.within(vectors, float("inf")))


def distance_of(pairs: DataFrame, asked: DataFrame) -> DataFrame:
    """i, j and d of the ``asked`` (i, j) in a matrix of pairs (i < j, d): symmetric, 0 of a row and itself, null where the matrix has none.

    The matrix is not broadcast, however small Spark takes it to be.
    """
    keys = asked.select("i", "j", F.least("i", "j").alias("_i"), F.greatest("i", "j").alias("_j"))
    have = pairs.select(F.col("i").alias("_i"), F.col("j").alias("_j"), "d").hint("merge")
    return keys.join(have, ["_i", "_j"], "left").select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(F.col("d")).alias("d"))


def distance_between(vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """What ``distance_of`` gives for the matrix of all rows (id, vec); only the entries asked for are computed."""
    a = vectors.select(F.col("id").alias("i"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("id").alias("j"), F.col("vec").alias("_b"))
    both = asked.select("i", "j").join(a, "i", "left").join(b, "j", "left")
    return both.select("i", "j", F.when(F.col("i") == F.col("j"), F.lit(0.0)).otherwise(metric_of("euclidean")(F.col("_a"), F.col("_b"))).alias("d"))


def permuted(vectors: DataFrame, order: DataFrame) -> DataFrame:
    """id and vec of the rows that ``order`` (new_id, old_id) lists, under their new ids; repeats are allowed."""
    return order.select("new_id", F.col("old_id").alias("id")).join(vectors, "id").select(F.col("new_id").alias("id"), "vec")


def strided(rows: DataFrame, step: int, key: str = "id") -> DataFrame:
    """Rows whose key is a multiple of ``step``."""
    return rows.where(F.col(key) % step == 0)


def sampled(rows: DataFrame, k: int, seed: int = 0, key: str = "id") -> DataFrame:
    """``k`` rows at random without replacement, the same in every run: the first by a hash of key and seed."""
    return rows.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(k)


def recalls(found: DataFrame, truth: DataFrame) -> DataFrame:
    """qid and recall of every query of the ground truth; both have qid, rank and nbr."""
    listed = lambda df, name: df.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "nbr"))), lambda x: x["nbr"]).alias(name))
    both = listed(truth, "truth").join(listed(found, "found"), "qid", "left")
    return both.select("qid", recall(F.coalesce("found", F.array().cast("array<long>")), F.col("truth")).alias("recall"))


def mean_recall(per_query: DataFrame) -> DataFrame:
    """One row: the mean of ``recall`` over all queries, to six decimals."""
    return per_query.agg(F.round(F.avg("recall"), 6).alias("mean_recall"))


def self_recall(found: DataFrame) -> DataFrame:
    """One row: the share of queries taken from the base that find themselves first."""
    return found.where("rank = 0").agg(F.avg((F.col("nbr") == F.col("qid")).cast("int")).alias("self_recall"))


def log_rank(rank: Column) -> Column:
    """The logarithm of a rank that starts at 0."""
    return F.log1p(rank)


def append_csv(rows: DataFrame, path: str) -> None:
    """Rows of a sweep added to a folder of CSV files, each with a header."""
    rows.write.mode("append").csv(path, header=True)
