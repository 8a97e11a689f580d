"""Objects, programs, files of a folder, near duplicates by pivots, and voting against a plain version."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield import api, programs
from nearfield.functions import report
from nearfield.functions.vectors import pair_distances
from nearfield.operators import cliques, duplicates, knn, prune, search
from nearfield.sources import binary, local

RNG = np.random.default_rng(5)


def apart(x, a, b):
    return float(pair_distances("euclidean", x[a][None], x[b][None])[0])


@pytest.mark.parametrize("n", [1, 2, 9, 40])
@pytest.mark.parametrize("begin", [(), (0,)])
def test_voting_against_a_plain_version(n, begin):
    x, centre = RNG.random((n, 3)), RNG.random(3)
    points = np.vstack([x, centre])
    covers = lambda a, v: a == v or apart(points, v, a) < apart(points, v, n)
    kept, voters, want = list(begin), [], max(1, round(np.log(n)))
    most = lambda: max(range(n), key=lambda c: (sum(covers(c, v) for v in voters), -c))
    for v in prune.voters_in_order(n):
        if any(covers(k, v) for k in kept):
            continue
        voters.append(v)
        best = most()
        if sum(covers(best, u) for u in voters) >= want:
            kept.append(best)
            voters = [u for u in voters if not covers(best, u)]
    while voters:
        kept.append(most())
        voters = [u for u in voters if not covers(kept[-1], u)]
    assert prune.voted(centre, x, begin=begin) == kept


@pytest.mark.parametrize("radius", [1e-9, 0.05, 0.4])
def test_pivots_lose_no_pair(spark, radius):
    x = RNG.random((60, 3)).astype(np.float32)
    x = np.vstack([x, x[:10] + np.float32(1e-7), x[:5] + np.float32(0.02)])
    v = local.from_numpy(spark, x)
    rows = np.asarray(x, float)
    want = {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if apart(rows, i, j) < radius}
    assert {(r["i"], r["j"]) for r in duplicates.near_pairs(v, radius).collect()} == want


def test_groups_of_copies(spark):
    v = local.from_numpy(spark, np.array([[1, 0], [0, 1], [1, 0], [5, 5], [1, 0], [5, 5.0]]))
    v = v.unionByName(spark.createDataFrame([(6, None)], v.schema))
    found = duplicates.groups(v)
    assert {(r["id"], r["component"], r["size"]) for r in found.collect()} == {(0, 0, 3), (2, 0, 3), (4, 0, 3), (3, 3, 2), (5, 3, 2)}
    assert tuple(duplicates.totals(found, v).first()) == (2, 5, 71.43)
    empty = v.limit(0)
    assert tuple(duplicates.totals(duplicates.groups(empty), empty).first()) == (0, 0, 0.0)
    with pytest.raises(ValueError):
        duplicates.groups(v, 0.0)


def test_ranks_with_ties(spark):
    x = np.array([[0], [1], [1], [2], [3.0]])
    v = local.from_numpy(spark, x).repartition(3)
    q = spark.createDataFrame([(7, [0.0])], "qid long, qvec array<float>")
    seen = spark.createDataFrame([(7, i) for i in (4, 2, 1, 0)], "qid long, nbr long")
    assert {r["nbr"]: r["rank"] for r in knn.ranks(seen, q, v).collect()} == {0: 0, 1: 1, 2: 2, 4: 4}
    assert knn.ranks(seen.limit(0), q, v).count() == 0


def test_walk_variants():
    x = np.array([[0.0], [1], [2], [3]])
    nbrs = [np.array(n) for n in ([1], [0, 2], [1], [2])]
    assert search.greedy_walk(np.array([5.0]), x, nbrs, 0) == [0, 1, 2]
    assert search.greedy_walk(np.array([0.4]), x, nbrs, 1) == [1, 0]
    assert search.greedy_walk(np.array([0.9]), x, nbrs, 0, skip_path=True) == [0, 1, 2]
    assert search.path_to(2, x, nbrs, 0) == [0, 1, 2] and search.path_to(3, x, nbrs, 0) == [0, 1, 2] and search.path_to(1, x, nbrs, 1) == [1]


def test_nearest_inside(spark):
    groups = spark.createDataFrame([([0, 1],), ([2, 5],), ([3],), ([],)], "members array<long>")
    near = spark.createDataFrame([(0, 1), (2, 3), (3, 3)], "src long, dst long")
    assert cliques.nearest_inside(groups, near).first()["percent"] == 33.33


def test_objects(spark):
    x = np.array([[0, 0], [1, 0], [0, 2], [3, 3]], float)
    s = api.VectorSet(spark, x)
    assert (s.n, s.dim, s.compare_internal(0, 1), s.compare([0, 0], 2)) == (4, 2, 1.0, 2.0)
    assert [r["nbr"] for r in s.brute_force([0, 0]).orderBy("rank").collect()] == [0, 1, 2, 3]
    assert [r["nbr"] for r in s.brute_force_subset_internal(3, [0, 2]).orderBy("rank").collect()] == [2, 0]
    with pytest.raises(IndexError):
        s.get_vector(4)
    with pytest.raises(ValueError):
        s.brute_force([1])
    part = api.Subset(s, [3, 1, 3]).further([2, 1])
    assert part.n == 2 and part.original(0) == 3 and part.get_vector(1).tolist() == [1, 0]
    whole = s.build_global_local_graph()
    assert whole.n == 4
    g = api.VectorGraph(spark, [[1, 2], [0], [0, 3], []])
    assert (g.total_edges(), g.max_degree(), g.get_neighborhood(2)) == (5, 2, [0, 3])
    assert g.add_neighbor(3, 2).get_neighborhood(3) == [2] and g.set_neighborhood(0, []).get_neighborhood(0) == []
    with pytest.raises(IndexError):
        g.add_neighbor(0, 9)
    members = lambda df: sorted(r["members"] for r in df.collect())
    assert members(g.maximal_cliques()) == [[0, 1], [0, 2], [2, 3]]
    assert members(g.maximal_bidirectional_cliques()) == [[0, 1], [0, 2], [3]]
    assert members(g.maximal_independent_cliques()) == [[0, 1], [2, 3]]
    assert api.VectorGraph.empty(spark, 3).total_edges() == 0
    steps = g.transparent_beam_search(s, [3, 3], 2, 4).first()
    assert steps["visited"][0]["id"] == 2 and steps["beam"][0]["id"] == 3


def test_rows_by_numpy_and_lists(spark):
    v = local.random_vectors(spark, 50, 3)
    x = local.to_numpy(v)
    assert x.shape == (50, 3) and 0 <= x.min() and x.max() < 1 and len(np.unique(x)) > 140
    assert np.array_equal(local.to_numpy(local.from_numpy(spark, x)), x)
    lists = local.to_lists(local.random_graph(spark, 40, 5))
    assert all(4 <= len(n) <= 6 and i not in n and len(set(n)) == len(n) for i, n in enumerate(lists))
    assert local.to_lists(local.from_lists(spark, lists)) == lists
    found = knn.ground_truth(v.where("id < 2").selectExpr("id AS qid", "vec AS qvec"), v.where("id < 2"), 3)
    ids, dist = local.neighbours_to_numpy(found)
    assert ids.tolist() == [[0, 1, -1], [1, 0, -1]] and dist[0, 0] == 0


def test_reports(spark, tmp_path):
    assert report.read_sweep(spark, f"{tmp_path}/none").count() == 0
    rows = spark.createDataFrame([(2, "b", None), (1, "a", 0.5)], "timestamp long, method string, recall double")
    assert report.markdown(report.in_order(rows)) == "| timestamp | method | recall |\n|-|-|-|\n| 1 | a | 0.5 |\n| 2 | b |  |"
    assert report.present(rows, ("recall", "none", "method")).columns == ["recall", "method"]
    assert [r[0] for r in report.keys(rows, "recall").collect()] == [0.5]
    rows.write.csv(f"{tmp_path}/sweep", header=True)
    assert [r["method"] for r in report.read_sweep(spark, f"{tmp_path}/sweep").collect()] == ["a", "b"]
    assert rows.select(report.label(F.col("method"), {})).count() == 2


def test_programs(spark, tmp_path):
    run = lambda *args: programs.main([str(a) for a in args], spark)
    top = tmp_path / "data" / "one"
    top.mkdir(parents=True)
    base = top / "base.fbin"
    assert run("random-vectors", base, "-n", 60, "-d", 3) == {"n": 60, "dim": 3}
    assert local.paths_of("one", str(tmp_path / "data")).base == str(base)
    run("ground-truth", base, top / "GT", "-k", 5)
    asked = ("--truth", top / "GT", "-k", 5)
    assert run("build-ivf", base, *asked, "--lists", 4, "--probes", 4)["recall"] == 1.0
    assert run("build-kmt", base, *asked, "--leaf", 20, "--branching", 3, "--width", 50)["recall"] == 1.0
    out = run("build-slow", base, *asked, "--width", 60, "--choose", "prune", "--out", top / "graph")
    assert out["recall"] == 1.0 and out["nodes"] == 60
    assert run("build-vamana", base, *asked, "--width", 60, "--shards", 1)["recall"] > 0.9
    assert run("search-graph", base, top / "graph", *asked, "--width", 60)["recall"] == 1.0
    assert run("graph-info", top / "graph")["nodes"] == 60
    assert run("graph-roundtrip", top / "graph", top / "copy")["differing"] == 0
    assert run("find-duplicates", tmp_path / "data") == {"one base": {"sets": 0, "members": 0, "percent": 0.0}}
    assert run("choose", base, 7)["kept"]
    run("kmt-sweep", base, *asked, "--leaf", 20, "--branching", 3, "--beams", 1, 50, "--csv", tmp_path / "kmt")
    assert [r["beam"] for r in report.in_order(report.read_sweep(spark, f"{tmp_path}/kmt")).collect()] == [1, 50]
    run("scaling-sweep", base, "--sizes", 20, 40, "--csv", tmp_path / "scaling")
    assert report.read_sweep(spark, f"{tmp_path}/scaling").count() == 2
    assert run("random-graph", tmp_path / "g", "-n", 30, "--degree", 4)["max_degree"] <= 5


def test_compaction_program(spark, tmp_path):
    binary.write_vectors(local.random_vectors(spark, 40, 2), str(tmp_path / "base"))
    binary.write_graph(local.from_lists(spark, [[(i + 1) % 40, (i - 1) % 40] for i in range(40)]), str(tmp_path / "graph"))
    programs.main(["compact", str(tmp_path / "base"), str(tmp_path / "graph"), "--csv", str(tmp_path / "csv"), "--markdown", str(tmp_path / "table.md"), "-k", "3"], spark)
    rows = report.read_sweep(spark, str(tmp_path / "csv"))
    assert {(r["clique"], r["method"]) for r in rows.collect()} == {(c, m) for c in ("mutual", "either", "copies") for m in ("none", "plain", "pruned")}
    assert (tmp_path / "table.md").read_text().count("\n") == 11
