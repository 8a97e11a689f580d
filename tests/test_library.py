"""Small exact cases and properties of the similarity-search operators."""

import math

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions import curves
from nearfield.functions import vectors as V
from nearfield.operators import cliques, clustering, graphs, ivf, knn, prune, search, tree
from nearfield.plans import catalog
from nearfield.sources import binary

SF = "/root/testdata/sf0.001"


def vecs(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in r]) for i, r in enumerate(rows)], "id long, vec array<float>")


def asks(spark, rows):
    return vecs(spark, rows).toDF("qid", "qvec")


def links(spark, lists):
    return spark.createDataFrame([(s, p, d) for s, ds in enumerate(lists) for p, d in enumerate(ds)], "src long, pos int, dst long")


FOUR = [(1, 0, 0), (0, 1, 0), (0, 0, 1), (0.5, 0.5, 0)]


@pytest.mark.parametrize("a, b, d", [((1, 2, 3), (4, 5, 6), math.sqrt(27)), ((1, 0, 0, 0), (0, 1, 0, 0), math.sqrt(2)), ((3, 4), (7, 1), 5.0)])
def test_euclidean(spark, a, b, d):
    got = vecs(spark, [a]).select(V.euclidean(F.col("vec"), F.array(*[F.lit(float(x)) for x in b])).alias("d")).first()["d"]
    assert got == pytest.approx(d, abs=1e-6)


def test_unknown_metric():
    with pytest.raises(ValueError):
        V.metric("manhattan")


def test_nearest_order(spark):
    rows = knn.knn(asks(spark, [(1, 0, 0)]), vecs(spark, FOUR), 4).orderBy("rank").collect()
    assert [r["nbr"] for r in rows[:2]] == [0, 3]
    assert rows[0]["dist"] == 0.0 and rows[1]["dist"] == pytest.approx(math.sqrt(0.5))


def test_closest(spark):
    q = asks(spark, [(1, 0, 0), (0.6, 0.4, 0), (1, 1, 1)])
    c = spark.createDataFrame([(k, p, p) for k in (0, 1) for p in range(4)], "qid long, pos int, id long")
    assert [r["pos"] for r in knn.closest(q, c, vecs(spark, FOUR)).orderBy("qid").collect()] == [0, 3, 0]


def test_subset_keeps_both_ids(spark):
    s = spark.createDataFrame([(0, 2), (1, 0), (2, 3)], "sub_id long, id long")
    assert {(r["sub_id"], r["id"]) for r in knn.subset(vecs(spark, FOUR), s).collect()} == {(0, 2), (1, 0), (2, 3)}


def test_ground_truth_pads(spark):
    q, v = asks(spark, [(0, 0)]), vecs(spark, [(0, 0), (1, 0)])
    rows = knn.ground_truth(q, v, 5).orderBy("rank").collect()
    assert [r["nbr"] for r in rows] == [0, 1] + [knn.PAD_ID] * 3
    assert [r["dist"] for r in rows] == [0.0, 1.0] + [knn.PAD_DISTANCE] * 3


GRAPH = [[1, 2, 3], [0, 2, 3], [0], [0, 1]]
POINTS = [(0, 0), (1, 0), (0, 2), (3, 0)]


def lists(adj):
    return [list(r["nbrs"]) for r in adj.orderBy("src").collect()]


@pytest.mark.parametrize(
    "cut, want",
    [
        (lambda e: graphs.shorter_than(e, 2.0), [[1, 2], [0, 3], [0], [1]]),
        (lambda e: graphs.percentile(e, 0), [[1], [0], [], []]),
        (lambda e: graphs.percentile(e, 50), [[1, 2], [0, 3], [0], [1]]),
        (lambda e: graphs.percentile(e, 100), GRAPH),
        (lambda e: graphs.shortest(e, 2), [[1, 2], [0, 3], [0], [1, 0]]),
        (lambda e: graphs.shortest(e, 1), [[1], [0], [0], [1]]),
        (lambda e: graphs.shortest(e, 0), [[], [], [], []]),
    ],
)
def test_edge_filters(spark, cut, want):
    v = vecs(spark, POINTS)
    e = graphs.measured(links(spark, GRAPH), v)
    assert lists(graphs.adjacency(v, cut(e))) == want


def test_graph_statistics(spark):
    v = spark.range(10).select("id")
    e = links(spark, [[1, 2, 3], [0, 4, 5], [0, 6, 7], [0, 8, 9], [1], [1], [2], [2], [3], [3]])
    r = graphs.statistics(graphs.adjacency(v, e)).first()
    assert (r["nodes"], r["edges"], r["max_degree"], r["self_loops"]) == (10, 18, 3, 0)
    assert graphs.differing(e, e).count() == 0


def test_queued_edges_respect_the_bound(spark):
    e = links(spark, [[1], [0, 2]])
    new, left = graphs.with_edges(e, spark.createDataFrame([(0, 5), (1, 6)], "src long, dst long"), 2)
    assert {(r["src"], r["dst"]) for r in new.collect()} == {(0, 1), (0, 5), (1, 0), (1, 2)}
    assert [tuple(r) for r in left.collect()] == [(1, 6)]


def both_ways(spark, pairs):
    return spark.createDataFrame([(a, 0, b) for a, b in pairs] + [(b, 0, a) for a, b in pairs], "src long, pos int, dst long")


@pytest.mark.parametrize(
    "n, pairs, want",
    [
        (4, [(0, 1), (0, 2), (1, 2), (2, 3)], {(0, 1, 2), (2, 3)}),
        (3, [], {(0,), (1,), (2,)}),
        (4, [(0, 1), (0, 2), (0, 3), (1, 2), (1, 3), (2, 3)], {(0, 1, 2, 3)}),
    ],
)
def test_cliques(spark, n, pairs, want):
    e = both_ways(spark, pairs) if pairs else spark.createDataFrame([], "src long, pos int, dst long")
    assert {tuple(r["members"]) for r in cliques.maximal(spark.range(n), e).collect()} == want


def test_one_way_edges_make_no_clique(spark):
    e = spark.createDataFrame([(0, 0, 1), (1, 0, 0), (1, 1, 2)], "src long, pos int, dst long")
    assert {tuple(r["members"]) for r in cliques.maximal(spark.range(3), e).collect()} == {(0, 1), (2,)}


def test_disjoint_cliques(spark):
    c = spark.createDataFrame([([0, 1, 2],), ([2, 3],), ([3, 4],)], "members array<long>")
    assert {tuple(r["members"]) for r in cliques.disjoint(c).collect()} == {(0, 1, 2), (3, 4)}


def test_compaction(spark):
    e = both_ways(spark, [(0, 1), (0, 2), (1, 2), (2, 3)])
    p = cliques.posting(spark.createDataFrame([([0, 1, 2],)], "members array<long>"))
    assert {tuple(r) for r in p.collect()} == {(0, 1), (0, 2)}
    assert {tuple(r) for r in cliques.compacted(e, p).collect()} == {(3, 0)}


@pytest.mark.parametrize("rows", [[(1, 0), (0.5, 0.5), (1, 0), (0.5, 0.5), (2, 1)], [(1, 0), (2, 2), (1, 0), (2, 2), (3, 1)]])
def test_duplicate_groups(spark, rows):
    v = vecs(spark, rows)
    got = graphs.components(v.select("id"), knn.within(v, 1e-9)).collect()
    groups = {}
    for r in got:
        groups.setdefault(r["component"], set()).add(r["id"])
    assert [g for g in groups.values() if len(g) > 1] in ([{0, 2}, {1, 3}], [{1, 3}, {0, 2}])


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (5, 6)], "i long, j long")
    got = {r["id"]: r["component"] for r in graphs.components(spark.range(1, 7), e).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5, 6: 5}


def test_kmeans(spark):
    v = vecs(spark, [(0,), (1,), (10,), (11,)])
    init = np.array([[0.0], [10.0]])
    assert clustering.kmeans(v, 2, 10, init=init).tolist() == [[0.5], [10.5]]
    assert clustering.kmeans(v, 2, 0, init=init).tolist() == [[0.0], [10.0]]
    assert clustering.kmeans(v, 2, 1, init=np.array([[5.0], [500.0]])).tolist() == [[5.5], [500.0]]


def test_spillover_keeps_order(spark):
    v = vecs(spark, [(0.0,)])
    c = np.array([[3.0], [1.0], [2.0]])
    assert [r["cid"] for r in clustering.assigned(v, c, 2).orderBy("rank").collect()] == [1, 2]
    assert clustering.assigned(v, c, 9).count() == 3


def random_vectors(n=60, dim=4, seed=3):
    return np.random.default_rng(seed).random((n, dim))


def exact(spark, x, q, k):
    return {(r["qid"], r["rank"]): r["nbr"] for r in knn.knn(asks(spark, q), vecs(spark, x), k).collect()}


def test_ivf_with_all_probes_is_exact(spark):
    x, q = random_vectors(), random_vectors(5, seed=9)
    found = ivf.build(vecs(spark, x), 4, 3).search(asks(spark, q), 5, 4)
    assert {(r["qid"], r["rank"]): r["nbr"] for r in found.collect()} == exact(spark, x, q, 5)


def test_tree_with_a_wide_beam_is_exact(spark):
    x, q = random_vectors(), random_vectors(5, seed=9)
    t = tree.build(vecs(spark, x), 3, 10, spillover=2)
    found = t.search(asks(spark, q), 5, 1000)
    assert {(r["qid"], r["rank"]): r["nbr"] for r in found.collect()} == exact(spark, x, q, 5)
    s = t.summary().first()
    assert s["leaves"] > 1 and s["leaf_points"] >= 60 and s["height"] >= 1


def test_tree_of_equal_points_ends(spark):
    t = tree.build(vecs(spark, [(1, 1)] * 30), 3, 5)
    assert t.leaf_points.select("id").distinct().count() == 30
    with pytest.raises(ValueError):
        tree.build(vecs(spark, POINTS), 3, 1, spillover=3)


def test_robust_prune():
    line = lambda *p: np.array([[float(x)] for x in p])
    assert prune.robust_prune(np.zeros(1), line(1, 2, 10)) == [0]
    assert prune.robust_prune(np.zeros(1), line(-1, 1)) == [0, 1]


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 25), st.sampled_from([1.0, 1.2]))
def test_pruning_properties(seed, n, alpha):
    x = np.random.default_rng(seed).random((n, 3))
    centre = np.zeros(3)
    d = V.pair_distances("euclidean", x, centre[None])
    kept = prune.robust_prune(centre, x, alpha)
    assert kept[0] == d.argmin() and len(set(kept)) == len(kept)
    for i in set(range(n)) - set(kept):
        assert any(alpha * V.pair_distances("euclidean", x[[i]], x[[k]])[0] < d[i] for k in kept)
    for choose in (prune.set_cover(centre, x, alpha), prune.voted(centre, x, seed)):
        c = prune.covers(centre, x, alpha if choose is not None else 1.0)
        assert set(choose) <= set(range(n))
    own = prune.covers(centre, x)
    covered = set(prune.voted(centre, x, seed))
    assert all(i in covered or own[list(covered), i].any() for i in range(n)) and len(c) == n


def test_beam_search_on_a_complete_graph_is_exact():
    x, q = random_vectors(), random_vectors(1, seed=9)[0]
    nbrs = [np.delete(np.arange(60), i) for i in range(60)]
    walk = search.beam_search(q, x, nbrs, 0, 60)
    d = V.pair_distances("euclidean", x, q[None])
    assert [n for n, _ in walk.beam] == np.argsort(d, kind="stable").tolist() and walk.compared == 60


def test_beam_search_on_a_path():
    x = np.array([[0.0], [1], [2], [3]])
    nbrs = [np.array(n) for n in ([1], [0, 2], [1, 3], [2])]
    assert [n for n, _ in search.beam_search(np.array([3.0]), x, nbrs, 0, 1).visited] == [0, 1, 2, 3]
    assert [n for n, _ in search.beam_search(np.array([3.0]), x, nbrs, 0, 1, 2).visited] == [0, 1]
    assert search.greedy_walk(np.array([3.0]), x, nbrs, 0) == [0, 1, 2, 3]


def test_vamana_finds_neighbours(spark):
    x = np.random.default_rng(5).random((300, 3))
    v, q = vecs(spark, x), asks(spark, x[::15])
    truth = {(r["qid"], r["nbr"]) for r in knn.knn(q, v, 5).collect()}
    for shards in (1, 3):
        g = search.build_vamana(v, shards=shards)
        found = {(r["qid"], r["nbr"]) for r in g.search(q, 5, 40).collect()}
        assert len(found & truth) >= 0.95 * len(truth)
        assert g.adjacency().agg(F.max(F.size("nbrs"))).first()[0] <= 8


def test_recall(spark):
    df = spark.createDataFrame([([1, 2, 3], [3, 9]), ([], [1])], "found array<long>, truth array<long>")
    assert [r[0] for r in df.select(V.recall(F.col("found"), F.col("truth"))).collect()] == [0.0, None]


def test_pareto(spark):
    df = spark.createDataFrame([(1, 5), (2, 4), (2, 3), (3, 1)], "x int, y int")
    assert {tuple(r) for r in curves.pareto(df, "x", "y").collect()} == {(3, 1), (2, 4), (1, 5)}


def test_hilbert_visits_neighbours(spark):
    df = spark.range(256).select((F.col("id") % 16).alias("x"), F.floor(F.col("id") / 16).alias("y"))
    cells = [(r["x"], r["y"]) for r in df.withColumn("h", curves.hilbert(F.col("x"), F.col("y"), 4)).orderBy("h").collect()]
    assert all(abs(a - c) + abs(b - d) == 1 for (a, b), (c, d) in zip(cells, cells[1:], strict=False))
    one = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 0)], "x int, y int")
    assert [r[0] for r in one.select(curves.hilbert(F.col("x"), F.col("y"), 1)).collect()] == [0, 1, 2, 3]


def test_files_round_trip(spark, tmp_path):
    binary.register(spark)
    path = str(tmp_path / "v")
    x = random_vectors(20, 3).astype(np.float32)
    binary.write_vectors(vecs(spark, x), path)
    rows = spark.read.format("vectorfile").option("path", path).load().orderBy("id").collect()
    assert np.array_equal(np.array([r["vec"] for r in rows], np.float32), x)
    assert spark.read.format("vectorfile").option("path", path).option("limit", 5).load().count() == 5
    adj = spark.createDataFrame([(i, [(i + j + 1) % 20 for j in range(i % 4)]) for i in range(20)], "src long, nbrs array<long>")
    binary.write_graph(adj, str(tmp_path / "g"), block=7)
    back = spark.read.format("graphfile").option("path", str(tmp_path / "g")).load()
    assert lists(back) == lists(adj)
    truth = knn.ground_truth(asks(spark, x[:3]), vecs(spark, x[:2]), 4)
    binary.write_neighbours(truth, str(tmp_path / "t"))
    got = spark.read.format("neighbourfile").option("path", str(tmp_path / "t")).load()
    assert [(r["nbr"]) for r in got.orderBy("qid", "rank").collect()] == [r["nbr"] for r in truth.orderBy("qid", "rank").collect()]


def test_broken_files_are_errors(spark, tmp_path):
    binary.register(spark)
    short = tmp_path / "short"
    short.write_bytes(bytes([1, 2, 3, 4]))
    for fmt in ("vectorfile", "graphfile", "neighbourfile"):
        for path in (short, tmp_path / "missing"):
            with pytest.raises(Exception):  # noqa: B017  raised by the executor
                spark.read.format(fmt).option("path", str(path)).load().count()


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("embeddings", "part"):
        con.sql(f"create view {table} as select * from '{SF}/{table}.parquet'")
    got, want = catalog.queries()[name](spark, SF).toPandas(), con.sql(catalog.oracle_sql()[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    rows = lambda d: sorted(map(str, d[cols].astype(object).where(d[cols].notna(), None).values.tolist()))
    assert rows(got) == rows(want)


@pytest.mark.parametrize("name", sorted(catalog.queries().keys() - catalog.oracle_sql().keys()))
def test_queries_without_sql_have_rows(spark, name):
    df = catalog.queries()[name](spark, SF)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


def test_chosen_pruning_covers_every_candidate(spark):
    """Every candidate of a centre is kept or nearer to a kept one than to the centre."""
    e, v = catalog.neighbour_edges(spark, SF), catalog.vectors(spark, SF)
    x = {r["id"]: np.array(r["vec"], float) for r in v.collect()}
    near = {}
    for r in e.collect():
        near.setdefault(r["src"], []).append(r["dst"])
    far = lambda a, b: float(V.pair_distances("euclidean", x[a][None], x[b][None])[0])
    for choose in (prune.set_cover, prune.voted):
        kept = {r["src"]: r["nbrs"] for r in prune.pruned(e, v, choose=choose).collect()}
        assert kept.keys() == near.keys()
        for s, ds in near.items():
            assert all(d in kept[s] or any(far(k, d) < far(s, d) for k in kept[s]) for d in ds)


def test_greedy_walk_on_a_path(spark):
    g = search.from_adjacency(vecs(spark, [(0,), (1,), (2,), (3,)]), graphs.adjacency(spark.range(4), links(spark, [[1], [0, 2], [1, 3], [2]])))
    rows = g.greedy(asks(spark, [(3,)])).orderBy("step").collect()
    assert [(r["id"], r["dist"]) for r in rows] == [(0, 3.0), (1, 2.0), (2, 1.0), (3, 0.0)]


@pytest.mark.parametrize("name", ["kmt_built_search", "ivf_built_search", "vamana_search"])
@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_built_indexes(spark, name, sf):
    d = f"/root/testdata/{sf}"
    truth = {(r["qid"], r["nbr"]) for r in catalog.queries()["knn_exact"](spark, d).collect()}
    found = {(r["qid"], r["nbr"]) for r in catalog.queries()[name](spark, d).collect()}
    recall = len(found & truth) / len(truth)
    print(name, sf, round(recall, 4))
    assert recall >= 0.9


def test_bounds_samples_and_lookups(spark, tmp_path):
    from nearfield.operators import edits

    adj = spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "src long, nbrs array<long>")
    more = spark.createDataFrame([(0, [5]), (9, [1])], "src long, nbrs array<long>")
    assert {r["src"]: r["nbrs"] for r in edits.appended(adj, more, 3).collect()} == {0: [1, 2, 5], 1: [], 2: [0]}
    with pytest.raises(Exception, match="too many neighbours of 0"):
        edits.appended(adj, more, 2).collect()
    rows = spark.range(100)
    a, b, c = ([r["id"] for r in edits.sampled(rows.repartition(n), 10, seed).collect()] for n, seed in ((3, 1), (5, 1), (3, 2)))
    assert a == b != c and len(set(a)) == 10
    pairs = spark.createDataFrame([(0, 1, 2.5)], "i long, j long, d double")
    asked = spark.createDataFrame([(1, 0), (0, 1), (1, 1), (0, 7)], "i long, j long")
    assert {(r["i"], r["j"]): r["d"] for r in edits.distance_of(pairs, asked).collect()} == {(1, 0): 2.5, (0, 1): 2.5, (1, 1): 0.0, (0, 7): None}
    for _ in range(2):
        edits.append_csv(rows.limit(3).coalesce(1), f"{tmp_path}/sweep")
    assert spark.read.csv(f"{tmp_path}/sweep", header=True).count() == 6


def test_tiles_of_queries_find_the_same(monkeypatch):
    rng = np.random.default_rng(3)
    q, x = rng.random((37, 4)), np.repeat(rng.random((20, 4)), 2, 0)
    for metric in V.METRICS:
        whole = knn._best(metric, q, x, np.arange(40), 3)
        monkeypatch.setattr(knn, "TILE", 100)
        tiled = knn._best(metric, q, x, np.arange(40), 3)
        monkeypatch.undo()
        assert all(np.array_equal(a, b) for a, b in zip(whole, tiled, strict=True)) and len(whole[0]) == 37 * 3
