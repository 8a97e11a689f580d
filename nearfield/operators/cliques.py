"""Cliques of mutual edges, and graphs compacted by them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoints
from .graphs import mutual
from .prune import pruned


def _extend(r: set[int], p: set[int], x: set[int], near: dict[int, set[int]]) -> Iterator[list[int]]:
    if not p and not x:
        yield sorted(r)
        return
    pivot = max(sorted(p | x), key=lambda v: len(near[v] & p))
    for v in sorted(p - near[pivot]):
        yield from _extend(r | {v}, p & near[v], x & near[v], near)
        p = p - {v}
        x = x | {v}


def maximal(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """members, sorted, of every maximal clique of the mutual edges; a node without any is a clique alone.

    A clique is found at its smallest member, from the edges among that node's
    neighbours: a task sees one neighbourhood at a time, never the graph.
    """
    m = mutual(edges.where("src <> dst")).select("src", "dst").distinct()
    lists = m.groupBy("src").agg(F.collect_set("dst").alias("near"))
    inner = m.join(lists.select(F.col("src").alias("dst"), F.col("near").alias("theirs")), "dst").groupBy("src").agg(F.collect_list(F.struct("dst", "theirs")).alias("around"))
    rows = nodes.select(F.col("id").alias("src")).join(lists, "src", "left").join(inner, "src", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for r in b.to_pylist():
                v, own = r["src"], set(r["near"] or ())
                near = {a["dst"]: set(a["theirs"]) & own for a in r["around"] or ()}
                out += list(_extend({v}, {n for n in own if n > v}, {n for n in own if n < v}, near))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], ["members"])

    return rows.mapInArrow(run, "members array<long>")


def disjoint(cliques: DataFrame) -> DataFrame:
    """The cliques that a pass from the largest keeps, ties by members: each that shares no node with one kept before.

    In rounds: a clique that comes first among all that touch its nodes is
    kept, and those that touch it go; the same result as one pass.
    """
    ensure_checkpoints(cliques.sparkSession)
    left = cliques.where(F.size("members") > 0).select("members", F.struct((-F.size("members")).alias("size"), "members").alias("order")).distinct().checkpoint()
    kept = None
    while left.limit(1).count():
        at = left.select("members", "order", F.explode("members").alias("v"))
        first = at.groupBy("v").agg(F.min("order").alias("lead"))
        won = at.join(first, "v").groupBy("members").agg(F.min((F.col("order") == F.col("lead")).cast("int")).alias("all"), F.first("order").alias("order")).where("all = 1").select("members", "order").checkpoint()
        kept = won if kept is None else kept.unionByName(won)
        taken = won.select(F.explode("members").alias("v"))
        hit = at.join(taken, "v", "left_semi").select("members").distinct()
        left = left.join(hit, "members", "left_anti").checkpoint()
    return kept.select("members") if kept is not None else cliques.select("members").limit(0)


def summary(cliques: DataFrame) -> DataFrame:
    """One row: cliques of two or more, their largest, smallest and mean size, what contraction saves, and the nodes they cover."""
    big = cliques.where(F.size("members") > 1)
    size = F.size("members")
    sizes = big.agg(F.count("*").alias("cliques"), F.max(size).alias("largest"), F.min(size).alias("smallest"), F.round(F.avg(size), 2).alias("mean"), F.coalesce(F.sum(size - 1), F.lit(0)).cast("long").alias("saved"))
    covered = big.select(F.explode("members").alias("v")).distinct().agg(F.count("*").alias("covered"))
    return sizes.crossJoin(F.broadcast(covered))


def sizes(cliques: DataFrame) -> DataFrame:
    """How many cliques have each size, and the places in them; a node counts in each of its cliques."""
    return cliques.groupBy(F.size("members").alias("size")).agg(F.count("*").alias("n")).withColumn("points", F.col("size") * F.col("n"))


def invalid(cliques: DataFrame, edges: DataFrame) -> DataFrame:
    """members, a and b: pairs of members that no mutual edge links."""
    m = mutual(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    pairs = cliques.select("members", F.explode("members").alias("a")).select("members", "a", F.explode("members").alias("b")).where("a < b")
    return pairs.join(m, ["a", "b"], "left_anti").select("members", "a", "b")


def posting(cliques: DataFrame) -> DataFrame:
    """rep, the smallest member, and member, every other one, of disjoint cliques."""
    rows = cliques.where(F.size("members") > 1).select(F.array_min("members").alias("rep"), F.explode("members").alias("member"))
    return rows.where("rep <> member")


def nearest_inside(cliques: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: the percentage (two decimals) of disjoint cliques that hold the nearest other (``nearest``: src, dst) of their smallest member.

    A clique of one has no nearest inside and counts among all.
    """
    own = cliques.where(F.size("members") > 0).select(F.array_min("members").alias("src"), "members")
    rows = own.join(nearest.select("src", "dst"), "src", "left")
    inside = (F.size("members") > 1) & F.coalesce(F.array_contains("members", F.col("dst")), F.lit(False))
    return rows.agg(F.round(F.coalesce(F.avg(inside.cast("int")) * 100.0, F.lit(0.0)), 2).alias("percent"))


def points(nodes: DataFrame, compact: DataFrame, lists: DataFrame) -> DataFrame:
    """One row: all nodes of a compacted graph, those that keep edges, and those in posting lists."""
    primary = compact.agg(F.countDistinct("src").alias("primary_points"))
    secondary = lists.agg(F.countDistinct("member").alias("secondary_points"))
    return nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(primary)).crossJoin(F.broadcast(secondary))


def compacted(edges: DataFrame, lists: DataFrame) -> DataFrame:
    """src and dst with every secondary node replaced by its representative; secondaries lose their own edges, loops go."""
    ends = edges.join(lists.select(F.col("member").alias("dst"), "rep"), "dst", "left").select("src", F.coalesce("rep", "dst").alias("dst"))
    own = ends.join(lists.select(F.col("member").alias("src")), "src", "left_anti")
    return own.where("src <> dst").distinct()


def compacted_pruned(edges: DataFrame, lists: DataFrame, vectors: DataFrame, alpha: float = 1.2) -> DataFrame:
    """As ``compacted``, but a representative inherits its secondaries' edges, pruned before they are replaced."""
    mine = edges.join(lists.select(F.col("member").alias("src"), "rep"), "src", "left").select(F.coalesce("rep", "src").alias("src"), "dst")
    kept = pruned(mine, vectors, alpha).select("src", F.explode("nbrs").alias("dst"))
    ends = kept.join(lists.select(F.col("member").alias("dst"), "rep"), "dst", "left").select("src", F.coalesce("rep", "dst").alias("dst"))
    return ends.where("src <> dst").distinct()


def expanded(hits: DataFrame, lists: DataFrame) -> DataFrame:
    """qid and id of hits (qid, nbr) with the posting lists of the hits."""
    more = hits.select("qid", "nbr").join(lists, F.col("nbr") == F.col("rep")).select("qid", F.col("member").alias("id"))
    return hits.select("qid", F.col("nbr").alias("id")).unionByName(more).distinct()
