"""Connected components of a graph in a DataFrame.

Edge cases: repeated links count once and loops not at all; a null end links
nothing; without links the result is empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SALTS, dropped, written


def _least(edges: DataFrame) -> DataFrame:
    """u, its least neighbour m, and a row for each partition that ``u`` is dealt over."""
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.collect_set("salt").alias("salts")).select("u", "m", F.explode("salts").alias("salt"))


def _salted(edges: DataFrame) -> DataFrame:
    return edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))


def _stars(edges: DataFrame) -> bool:
    """Whether every vertex has one edge up at most, and those with one are nobody's upper end."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("x").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1").isEmpty()


def components(links: DataFrame, label: str = "components") -> DataFrame:
    """``v`` and ``root``, the smallest vertex that v reaches, of every vertex of ``links`` (a, b) but the roots.

    Rounds of two stars: every vertex hands its larger neighbours, then its
    smaller ones, to its smallest; the rounds end when all edges lead to roots,
    after about the logarithm of the longest path.  No vertex gathers its
    neighbours, and those of one with many are dealt over partitions.
    """
    e = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = written(e, label)
    while not _stars(e):
        both = _salted(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = _least(both).select("u", "salt", F.least("u", "m").alias("m"))
        large = both.join(low, ["u", "salt"]).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        large = _salted(large)
        low = _least(large)
        small = large.join(low, ["u", "salt"])
        new = small.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        new = written(new, label)
        dropped(e)
        e = new
    return e.select(F.col("u").alias("v"), F.col("v").alias("root"))
