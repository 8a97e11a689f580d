"""Graphs over vectors: edges (src, pos, dst), nodes in a list of their own so that empty ones survive."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import euclidean
from ..session import ensure_checkpoints


def adjacency(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """src and nbrs, in the order of pos, of every node (id)."""
    lists = edges.groupBy("src").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "dst"))), lambda e: e["dst"]).alias("nbrs"))
    return nodes.select(F.col("id").alias("src")).join(lists, "src", "left").select("src", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))


def edges_of(adj: DataFrame) -> DataFrame:
    return adj.select("src", F.posexplode("nbrs").alias("pos", "dst"))


def measured(edges: DataFrame, vectors: DataFrame) -> DataFrame:
    """Edges with their length d."""
    a = vectors.select(F.col("id").alias("src"), F.col("vec").alias("_a"))
    b = vectors.select(F.col("id").alias("dst"), F.col("vec").alias("_b"))
    return edges.join(a, "src").join(b, "dst").withColumn("d", euclidean(F.col("_a"), F.col("_b"))).select("src", "pos", "dst", "d")


def shorter_than(edges: DataFrame, epsilon: float) -> DataFrame:
    """Edges with d of at most epsilon."""
    return edges.where(F.col("d") <= epsilon)


def percentile(edges: DataFrame, p: float) -> DataFrame:
    """Edges at most as long as the order statistic floor(p / 100 * (n - 1)) of all; p is held to 0 .. 100.

    The statistic is found from counts of distinct lengths, in range partitions:
    no task sees all edges.
    """
    counts = edges.groupBy("d").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    if not total:
        return edges
    want = int(min(max(p, 0.0), 100.0) / 100 * (total - 1))
    spread_ = counts.repartitionByRange("d").select("d", "n", F.spark_partition_id().alias("part"))
    per = {r["part"]: r["n"] for r in spread_.groupBy("part").agg(F.sum("n").alias("n")).collect()}  # one row a partition
    before = 0
    for part in sorted(per):
        if before + per[part] > want:
            break
        before += per[part]
    own = Window.orderBy("d").rowsBetween(Window.unboundedPreceding, 0)
    at = spread_.where(F.col("part") == part).withColumn("upto", F.sum("n").over(own)).where(F.col("upto") > want - before).agg(F.min("d")).first()[0]
    return edges.where(F.col("d") <= at)


def shortest(edges: DataFrame, k: int) -> DataFrame:
    """The k shortest edges of each node, by length, ties by their old position; pos is new."""
    order = Window.partitionBy("src").orderBy("d", "pos")
    return edges.withColumn("new", F.row_number().over(order) - 1).where(F.col("new") < k).select("src", F.col("new").alias("pos"), "dst", "d")


def mutual(edges: DataFrame) -> DataFrame:
    """Edges whose reverse is there."""
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")).distinct()
    return edges.join(back, ["src", "dst"], "left_semi")


def nearest_linked(edges: DataFrame, nearest: DataFrame) -> DataFrame:
    """One row: how many nodes (src) have a nearest other (dst), an edge to it, and one from it."""
    have = edges.select("src", "dst").distinct()
    to = have.withColumn("_to", F.lit(True))
    back = have.select(F.col("dst").alias("src"), F.col("src").alias("dst"), F.lit(True).alias("_back"))
    rows = nearest.select("src", "dst").join(to, ["src", "dst"], "left").join(back, ["src", "dst"], "left")
    return rows.agg(F.count("*").alias("nodes"), F.count("_to").alias("linked"), F.count("_back").alias("linked_back"))


def statistics(adj: DataFrame) -> DataFrame:
    """One row: nodes, edges, mean (two decimals), least and largest degree, self loops."""
    size = F.size("nbrs")
    return adj.agg(
        F.count("*").alias("nodes"),
        F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("edges"),
        F.round(F.avg(size), 2).alias("avg_degree"),
        F.coalesce(F.min(size), F.lit(0)).alias("min_degree"),
        F.coalesce(F.max(size), F.lit(0)).alias("max_degree"),
        F.count_if(F.array_contains("nbrs", F.col("src"))).alias("self_loops"),
    )


def degrees(adj: DataFrame) -> DataFrame:
    """How many nodes have each degree, and their share in percent."""
    per = adj.groupBy(F.size("nbrs").alias("degree")).agg(F.count("*").alias("n"))
    return per.crossJoin(F.broadcast(adj.agg(F.count("*").alias("all")))).select("degree", "n", F.round(100.0 * F.col("n") / F.col("all"), 2).alias("percent"))


def with_edges(edges: DataFrame, pending: DataFrame, bound: int) -> tuple[DataFrame, DataFrame]:
    """Queued edges (src, dst) merged where a node's degree stays within ``bound``; the others are returned as the new queue."""
    have = edges.groupBy("src").agg(F.count("*").alias("have"))
    queued = pending.groupBy("src").agg(F.count("*").alias("more"))
    fits = queued.join(have, "src", "left").select("src", F.coalesce("have", F.lit(0)).alias("have"), ((F.coalesce("have", F.lit(0)) + F.col("more")) <= bound).alias("fits"))
    sorted_ = pending.join(fits, "src")
    pos = F.col("have") + F.row_number().over(Window.partitionBy("src").orderBy("dst")) - 1
    new = sorted_.where("fits").select("src", pos.cast("int").alias("pos"), "dst")
    return edges.select("src", "pos", "dst").unionByName(new), sorted_.where("not fits").select("src", "dst")


def differing(a: DataFrame, b: DataFrame) -> DataFrame:
    """Edges (src, pos, dst) that only one of two graphs has."""
    cols = ["src", "pos", "dst"]
    a, b = a.select(*cols), b.select(*cols)
    return a.exceptAll(b).unionAll(b.exceptAll(a))


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """id and component, the smallest id it reaches, by rounds of neighbour minima and pointer jumps.

    Each round is checkpointed in the session's checkpoint folder; the rounds
    end when no label moves.
    """
    spark = nodes.sparkSession
    ensure_checkpoints(spark)
    both = links.select("i", "j").unionByName(links.select(F.col("j").alias("i"), F.col("i").alias("j"))).where("i <> j").distinct().checkpoint()
    label = nodes.select("id", F.col("id").alias("c")).checkpoint()
    while True:
        near = both.join(label, both["j"] == label["id"]).groupBy("i").agg(F.min("c").alias("m"))
        step = label.join(near, label["id"] == near["i"], "left").select("id", F.least("c", F.coalesce("m", F.col("c"))).alias("c"))
        jump = step.alias("a").join(step.alias("b"), F.col("a.c") == F.col("b.id")).select("a.id", F.least("a.c", "b.c").alias("c")).checkpoint()
        moved = jump.join(label.withColumnRenamed("c", "old"), "id").where("c <> old").limit(1).count()
        label = jump
        if not moved:
            return label.select("id", F.col("c").alias("component"))
