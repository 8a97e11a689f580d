"""Command-line programs over binary files: ``python -m nearfield.programs COMMAND ...``.

Vectors, graphs and neighbour tables are the files of ``sources.binary``, on a
folder that all machines see.  Without a ground truth the exact search gives it.
"""

from __future__ import annotations

import argparse
import math
import sys
import time
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import report
from .operators import cliques, duplicates, edits, graphs, ivf, knn, prune, search, tree
from .session import ship
from .sources import binary, local

CHOOSERS = {"prune": prune.robust_prune, "cover": prune.set_cover, "voted": prune.voted}
BEAMS = (1, 2, 5, 10, 20, 50, 100, 200, 500)


def _queries(rows: DataFrame) -> DataFrame:
    return rows.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))


def _base(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = local.read_vectors(spark, a.base)
    return rows.where(F.col("id") < a.subset) if getattr(a, "subset", None) else rows


def _measured(spark: SparkSession, a: argparse.Namespace, base: DataFrame, find) -> dict:
    """Mean recall, queries a second and, where the search counts them, comparisons of a search of the file's queries."""
    q = _queries(local.read_vectors(spark, a.queries)) if a.queries else _queries(base)
    n = q.count()
    truth = local.read_neighbours(spark, a.truth).where(F.col("rank") < a.k) if a.truth else knn.knn(q, base, a.k)
    began = time.time()
    found = edits.recalls(find(q), truth)
    mean = edits.mean_recall(found).first()["mean_recall"]
    return {"recall": mean, "qps": round(n / max(time.time() - began, 1e-9), 1), "queries": n, "k": a.k}


def _self_recall(found: DataFrame) -> float | None:
    return edits.self_recall(found).first()["self_recall"]


def _row(spark: SparkSession, values: dict) -> DataFrame:
    return spark.createDataFrame([tuple(values.values())], list(values))


def _degrees(adj: DataFrame) -> dict:
    r = graphs.statistics(adj).first()
    return {"avg_degree": edits.average_degree(adj).first()[0], "max_degree": r["max_degree"]}


def ground_truth(spark: SparkSession, a: argparse.Namespace) -> dict:
    base = _base(spark, a)
    q = _queries(local.read_vectors(spark, a.queries)) if a.queries else _queries(base)
    binary.write_neighbours(knn.ground_truth(q, base, a.k, a.metric), a.out)
    return {"queries": q.count(), "k": a.k}


def _walked(spark: SparkSession, a: argparse.Namespace, base: DataFrame, g: search.Graph, adj: DataFrame) -> dict:
    """What is reported of a built graph: recall, self-recall at width 1, degrees, edges to the nearest other."""
    out = _measured(spark, a, base, lambda q: g.search(q, a.k, a.width))
    out["self_recall"] = _self_recall(g.search(_queries(base), 1, 1))
    near = knn.knn(_queries(base), base, 1, skip_self=True).select(F.col("qid").alias("src"), F.col("nbr").alias("dst"))
    out |= _degrees(adj) | graphs.nearest_linked(graphs.edges_of(adj), near).first().asDict()
    if a.out:
        binary.write_graph(adj, a.out)
    return out


def build_vamana(spark: SparkSession, a: argparse.Namespace) -> dict:
    base = _base(spark, a)
    g = search.build_vamana(base, a.alpha, a.bound, a.beam, shards=a.shards)
    g = search.Graph(g.shards.cache())
    return _walked(spark, a, base, g, g.adjacency())


def build_slow(spark: SparkSession, a: argparse.Namespace) -> dict:
    base = _base(spark, a)
    adj = prune.global_local(base, CHOOSERS[a.choose]).cache()
    return _walked(spark, a, base, search.from_adjacency(base, adj), adj)


def build_ivf(spark: SparkSession, a: argparse.Namespace) -> dict:
    base = _base(spark, a)
    lists = a.lists or max(1, round(math.sqrt(base.count())))
    index = ivf.build(base, lists, 10)
    return {"lists": lists} | _measured(spark, a, base, lambda q: index.search(q, a.k, a.probes))


def build_kmt(spark: SparkSession, a: argparse.Namespace) -> dict:
    base = _base(spark, a)
    t = tree.build(base, a.branching, a.leaf, spillover=a.spillover)
    sample = edits.strided(base, max(1, base.count() // 1000))
    out = t.summary().first().asDict() | _measured(spark, a, base, lambda q: t.search(q, a.k, a.width))
    return out | {"self_recall": _self_recall(t.search(_queries(sample), 1, a.width))}


def kmt_sweep(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One row a beam, added to a CSV folder."""
    base = _base(spark, a)
    began = time.time()
    t = tree.build(base, a.branching, a.leaf, spillover=a.spillover)
    built = round(time.time() - began, 3)
    rows = None
    for beam in a.beams:
        got = _measured(spark, a, base, lambda q, beam=beam: t.search(q, a.k, beam))
        row = _row(spark, {"timestamp": int(time.time()), "dataset": Path(a.base).parent.name, "branching": a.branching, "max_leaf": a.leaf, "spillover": a.spillover, "beam": beam, "build_seconds": built, **got})
        rows = row if rows is None else rows.unionByName(row)
    edits.append_csv(rows.coalesce(1), a.csv)
    return {"rows": len(a.beams)}


def scaling_sweep(spark: SparkSession, a: argparse.Namespace) -> dict:
    """One row a size: how long the graph of the first rows takes, and its degrees."""
    rows = None
    for size in a.sizes:
        base = local.read_vectors(spark, a.base).where(F.col("id") < size)
        began = time.time()
        adj = prune.global_local(base, CHOOSERS[a.choose]).cache()
        degrees = _degrees(adj)
        row = _row(spark, {"timestamp": int(time.time()), "method": a.choose, "subset_size": size, "construction_seconds": round(time.time() - began, 3), **degrees})
        rows = row if rows is None else rows.unionByName(row)
        adj.unpersist()
    edits.append_csv(rows.coalesce(1), a.csv)
    return {"rows": len(a.sizes)}


def compact(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Every source of cliques by every way to compact, one row each, as CSV and Markdown."""
    base = _base(spark, a).cache()
    adj = local.read_graph(spark, a.graph).cache()
    e, nodes = graphs.edges_of(adj).cache(), adj.select(F.col("src").alias("id"))
    both = e.select("src", "dst").unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()
    near = knn.knn(_queries(base), base, 1, skip_self=True).select(F.col("qid").alias("src"), F.col("nbr").alias("dst")).cache()
    rows = None
    for source, linked in (("mutual", e), ("either", both), ("copies", None)):
        if linked is not None:
            groups = cliques.disjoint(cliques.maximal(nodes, linked))
        else:
            groups = duplicates.groups(base, a.radius).groupBy("component").agg(F.array_sort(F.collect_list("id")).alias("members")).select("members")
        groups = groups.cache()
        lists = cliques.posting(groups).cache()
        inside = cliques.nearest_inside(groups, near).first()["percent"]
        for how, kept in (("none", e.select("src", "dst")), ("plain", cliques.compacted(e, lists)), ("pruned", cliques.compacted_pruned(e, lists, base, a.alpha))):
            small = kept.groupBy("src").agg(F.array_sort(F.collect_list("dst")).alias("nbrs")).cache()
            g = search.from_adjacency(base, small)
            find = lambda q, g=g: g.search(q, a.k, a.width)
            points = cliques.points(nodes, kept, lists).first().asDict()
            row = _row(spark, {"timestamp": int(time.time()), "clique": source, "method": how, "width": a.width, **points, "nearest_inside": inside, **_degrees(small), **_measured(spark, a, base, find)})
            rows = row if rows is None else rows.unionByName(row)
    if a.csv:
        edits.append_csv(rows.coalesce(1), a.csv)
    if a.markdown:
        report.write_markdown(report.in_order(rows), a.markdown)
    return {"rows": 9}


def search_graph(spark: SparkSession, a: argparse.Namespace) -> dict:
    base = _base(spark, a)
    g = search.from_adjacency(base, local.read_graph(spark, a.graph))
    return _measured(spark, a, base, lambda q: g.search(q, a.k, a.width))


def graph_info(spark: SparkSession, a: argparse.Namespace) -> dict:
    adj = local.read_graph(spark, a.graph)
    graphs.degrees(adj).orderBy("degree").show(1000, False)
    adj.orderBy("src").show(10, 80)
    return graphs.statistics(adj).first().asDict()


def graph_roundtrip(spark: SparkSession, a: argparse.Namespace) -> dict:
    """A graph written again, and the edges in which the copy differs."""
    adj = local.read_graph(spark, a.graph)
    binary.write_graph(adj, a.out)
    other = local.read_graph(spark, a.out)
    return {"nodes": adj.count(), "copied": other.count(), "differing": graphs.differing(graphs.edges_of(adj), graphs.edges_of(other)).count()}


def find_duplicates(spark: SparkSession, a: argparse.Namespace) -> dict:
    """Groups of near duplicates in the base rows and the queries of every data set in a folder."""
    out = {}
    for name, paths in local.data_sets(a.folder):
        for part, path in (("base", paths.base), ("queries", paths.queries)):
            if Path(path).exists():
                rows = local.read_vectors(spark, path)
                out[f"{name} {part}"] = duplicates.totals(duplicates.groups(rows, a.radius), rows).first().asDict()
    return out


def choose(spark: SparkSession, a: argparse.Namespace) -> dict:
    """The neighbours that one row is given among all others."""
    x = local.to_numpy(_base(spark, a)).astype(float)
    if not 0 <= a.centre < len(x):
        raise IndexError(f"row {a.centre} of {len(x)}")
    others = [i for i in range(len(x)) if i != a.centre]
    return {"kept": [others[p] for p in CHOOSERS[a.choose](x[a.centre], x[others])]}


def random_vectors(spark: SparkSession, a: argparse.Namespace) -> dict:
    binary.write_vectors(local.random_vectors(spark, a.n, a.dim, a.seed), a.out)
    return {"n": a.n, "dim": a.dim}


def random_graph(spark: SparkSession, a: argparse.Namespace) -> dict:
    adj = local.random_graph(spark, a.n, a.degree, a.seed)
    binary.write_graph(adj, a.out)
    return _degrees(adj)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="nearfield.programs")
    commands = top.add_subparsers(dest="command", required=True)

    def add(run, *options: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__.replace("_", "-"), help=run.__doc__)
        p.set_defaults(run=run)
        known = {
            "base": lambda: p.add_argument("base"),
            "graph": lambda: p.add_argument("graph"),
            "asked": lambda: [p.add_argument("--queries"), p.add_argument("--truth"), p.add_argument("-k", type=int, default=10), p.add_argument("--width", type=int, default=20)],
            "subset": lambda: p.add_argument("--subset", type=int),
            "choose": lambda: p.add_argument("--choose", choices=CHOOSERS, default="voted"),
            "alpha": lambda: p.add_argument("--alpha", type=float, default=1.2),
            "tree": lambda: [p.add_argument("--branching", type=int, default=10), p.add_argument("--leaf", type=int, default=200), p.add_argument("--spillover", type=int, default=1)],
            "radius": lambda: p.add_argument("--radius", type=float, default=1e-9),
            "csv": lambda: p.add_argument("--csv"),
            "out": lambda: p.add_argument("out"),
            "maybe out": lambda: p.add_argument("--out"),
            "seed": lambda: [p.add_argument("-n", type=int, default=1000), p.add_argument("--seed", type=int, default=42)],
        }
        for o in options:
            known[o]()
        return p

    p = add(ground_truth, "base", "out")
    p.add_argument("--queries")
    p.add_argument("-k", type=int, default=100)
    p.add_argument("--metric", default="euclidean")
    p = add(build_vamana, "base", "asked", "subset", "alpha", "maybe out")
    p.add_argument("--bound", type=int, default=8)
    p.add_argument("--beam", type=int, default=100)
    p.add_argument("--shards", type=int)
    add(build_slow, "base", "asked", "subset", "choose", "maybe out")
    p = add(build_ivf, "base", "asked", "subset")
    p.add_argument("--lists", type=int)
    p.add_argument("--probes", type=int, default=10)
    add(build_kmt, "base", "asked", "subset", "tree")
    p = add(kmt_sweep, "base", "asked", "tree")
    p.add_argument("--csv", required=True)
    p.add_argument("--beams", type=int, nargs="+", default=BEAMS)
    p = add(scaling_sweep, "base", "choose")
    p.add_argument("--csv", required=True)
    p.add_argument("--sizes", type=int, nargs="+", default=[1000, 2500, 5000, 10_000, 25_000])
    p = add(compact, "base", "graph", "asked", "radius", "alpha", "csv")
    p.add_argument("--markdown")
    add(search_graph, "base", "graph", "asked")
    add(graph_info, "graph")
    add(graph_roundtrip, "graph", "out")
    add(find_duplicates, "radius").add_argument("folder")
    p = add(choose, "base", "subset", "choose")
    p.add_argument("centre", type=int)
    add(random_vectors, "out", "seed").add_argument("-d", "--dim", type=int, default=2)
    add(random_graph, "out", "seed").add_argument("--degree", type=int, default=8)
    return top


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> dict:
    a = parser().parse_args(args)
    spark = ship(spark or SparkSession.builder.appName(f"nearfield {a.command}").getOrCreate())
    out = a.run(spark, a)
    for key, value in out.items():
        print(f"{key}: {value}")
    return out


if __name__ == "__main__":
    main(sys.argv[1:])
