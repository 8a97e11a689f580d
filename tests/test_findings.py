"""What a reviewer found: each test failed before."""

import time
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from nearfield.functions import vectors as V
from nearfield.llm import neardup, suffix
from nearfield.operators import duplicates, edits, graphs, knn, prune, search
from nearfield.plans import catalog

from .test_library import asks, vecs

SF = "/root/testdata/sf0.001"


def test_self_recall_query(spark):
    assert catalog.queries()["self_recall"](spark, SF).columns == ["self_recall"]
    found = spark.createDataFrame([(0, 0, 0), (0, 1, 3), (1, 0, 7), (1, 1, 1)], "qid long, rank int, nbr long")
    assert edits.self_recall(found).first()[0] == 0.5


def test_lookup_computes_what_is_asked(spark, monkeypatch):
    v = vecs(spark, [(0, 0), (3, 4), (6, 8)])
    asked = spark.createDataFrame([(0, 1), (1, 0), (2, 0), (1, 1), (0, 7)], "i long, j long")
    rows = lambda df: sorted(map(str, df.collect()))
    got = edits.distance_between(v, asked)
    assert rows(got) == rows(edits.distance_of(knn.within(v, float("inf")), asked))
    plan = edits.distance_of(knn.within(v, float("inf")), asked)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan
    monkeypatch.setattr(knn, "within", None)  # the query makes no matrix
    assert catalog.queries()["distance_lookup"](spark, SF).count() == 250


def mixed(spark):
    """Rows with copies, near copies, a null vector and one of another length, in no order; and the plain distances of those that have one."""
    rng = np.random.default_rng(11)
    x = rng.random((150, 3)).astype(np.float32)
    x = np.vstack([x, x[:20], x[:20] + np.float32(1e-3)])
    ids = rng.permutation(len(x)) * 7
    rows = [(int(i), [float(c) for c in r]) for i, r in zip(ids, x, strict=True)] + [(5, None), (6, [0.5]), (8, [0.25])]
    d = V.pair_distances("euclidean", x.astype(float)[:, None], x.astype(float)[None])
    want = {(int(min(a, b)), int(max(a, b))): d[m, n] for m, a in enumerate(ids) for n, b in enumerate(ids) if m < n} | {(6, 8): 0.25}
    return spark.createDataFrame(rows, "id long, vec array<float>").repartition(3), want


@pytest.mark.parametrize("pivots", [0, 2])
@pytest.mark.parametrize("radius", [1e-9, 0.3, float("inf")])
def test_pairs_in_blocks(spark, monkeypatch, radius, pivots):
    monkeypatch.setattr(knn, "QUERY_BYTES", 1500)
    monkeypatch.setattr(knn, "ROWS", 16)
    monkeypatch.setattr(knn, "CELL", 64)
    monkeypatch.setattr(knn, "TILE", 320)
    v, want = mixed(spark)
    near = {p: d for p, d in want.items() if d < radius}
    around = [np.array(r) for r in [(0.1, 0.2, 0.3), (0.9, 0.5, 0.1)][:pivots]]
    got = knn.within(v, radius, around).collect()
    assert len(got) == len(near) and {(r["i"], r["j"]): r["d"] for r in got} == near
    nodes = v.select("id")
    label = lambda links: {r["id"]: r["component"] for r in graphs.components(nodes, links).collect()}
    links = knn.linked(v, radius, around)
    assert label(links) == label(spark.createDataFrame([(int(a), int(b)) for a, b in near] or [], "i long, j long"))


def test_linked_rows_are_a_forest(spark):
    """A thousand rows near each other: half a million pairs, but no more links than rows a task."""
    v = vecs(spark, np.random.default_rng(2).random((1000, 2)))
    assert knn.linked(v, 10.0).count() <= 4 * 1000
    began = time.time()
    found = duplicates.groups(v, 10.0).collect()
    assert {(r["component"], r["size"]) for r in found} == {(0, 1000)}
    assert time.time() - began < 60


@pytest.mark.parametrize("dense", [0, 3, 1000])
@pytest.mark.parametrize("alpha", [1.0, 1.2])
def test_pruning_all_at_once_keeps_the_same(monkeypatch, alpha, dense):
    monkeypatch.setattr(prune, "DENSE", dense)
    rng = np.random.default_rng(4)
    for x in (rng.random((120, 5)), rng.integers(0, 3, (80, 2)).astype(float), np.repeat(rng.random((30, 3)), 3, 0) * 1e3, rng.random((1, 2))):
        for rows in np.array_split(np.arange(len(x)), 3):
            for c, got in zip(rows, prune.robust_prune_all(rows, x, prune.factors(x), alpha), strict=True):
                other = np.delete(np.arange(len(x)), c)
                assert got.tolist() == other[prune.robust_prune(x[c], x[other], alpha)].tolist()


def test_pruning_all_at_once_adds_up_little(monkeypatch):
    """One by one, a centre has at least the distances to all others added up term by term."""
    x = np.random.default_rng(5).standard_normal((2000, 16))
    rows, plain = [], prune._to
    monkeypatch.setattr(prune, "_to", lambda a, v: rows.append(len(a)) or plain(a, v))
    prune.robust_prune_all(np.arange(50), x, prune.factors(x))
    assert sum(rows) < 50 * 20


@pytest.mark.parametrize("most", [1 << 20, 100])
def test_sorted_distances_need_no_shuffle(spark, monkeypatch, most):
    v, want = mixed(spark)
    lists = {}
    for (i, j), d in want.items():
        lists.setdefault(i, []).append((d, j))
        lists.setdefault(j, []).append((d, i))
    rows = {(i, pos, j, d) for i, own in lists.items() for pos, (d, j) in enumerate(sorted(own))}
    monkeypatch.setattr(knn, "SORT_BYTES", most)
    got = edits.sorted_others(v)
    assert {tuple(r) for r in got.collect()} == rows and got.count() == len(rows)
    assert got.dtypes == edits.sorted_lists(knn.within(v, float("inf"))).dtypes
    assert ("Window" in got._jdf.queryExecution().executedPlan().toString()) == (most == 100)


@pytest.mark.parametrize("width, limit", [(1, None), (3, 4), (30, None)])
def test_walks_together_are_the_walks(monkeypatch, width, limit):
    rng = np.random.default_rng(6)
    x = np.repeat(rng.random((60, 3)), 2, 0)
    nbrs = [rng.integers(0, len(x), rng.integers(0, 6)) for _ in x]  # with loops, repeats and dead ends
    nbrs[0] = np.array([3, 9, 9, 50])
    q = rng.random((25, 3))
    off = np.concatenate([[0], np.cumsum([len(n) for n in nbrs])])
    got = search.beam_searches(q, x, off, np.concatenate(nbrs), width, limit)
    for k, own in enumerate(q):
        walk = search.beam_search(own, x, nbrs, 0, width, limit)
        for name in ("beam", "visited"):
            rows = got[name][0] == k
            assert list(zip(got[name][1][rows].tolist(), got[name][2][rows].tolist(), strict=True)) == getattr(walk, name)


def test_graph_from_a_table_is_the_same(monkeypatch):
    x = np.random.default_rng(7).random((200, 6))
    whole = search.vamana(x, bound=6, beam=20)
    monkeypatch.setattr(search, "TABLE_BYTES", 0)
    assert all(np.array_equal(a, b) for a, b in zip(whole, search.vamana(x, bound=6, beam=20), strict=True))


def test_search_sends_no_walks(spark, monkeypatch):
    """The k nearest of each task leave it, not beams and steps."""
    x = np.random.default_rng(8).random((90, 3))
    g = search.build_vamana(vecs(spark, x), shards=3)
    want = g.search(asks(spark, x[:10]), 4, 20).collect()
    monkeypatch.setattr(search.Graph, "walks", None)
    monkeypatch.setattr(search, "TOGETHER", 70)
    assert g.search(asks(spark, x[:10]), 4, 20).collect() == want and len(want) == 40


class Counting:
    """NumPy, counting the entries that ``repeat`` returns: the rows that an expansion visits."""

    def __init__(self):
        self.entries = 0

    def __getattr__(self, name):
        return getattr(np, name)

    def repeat(self, a, n):
        out = np.repeat(a, n)
        self.entries += len(out)
        return out


def test_expansion_follows_runs(monkeypatch):
    rng = np.random.default_rng(3)
    part = rng.integers(97, 123, 400).astype(np.uint8)
    text = np.concatenate([*[np.append(part, np.uint8(0xFF))] * 50, [np.uint8(0xFE)]])
    order = suffix.suffix_order(text, 100)
    counting = Counting()
    monkeypatch.setattr(suffix, "np", counting)
    got = suffix.apart(text, order, 100)
    key = [text[i : i + 100].tobytes().ljust(100, b"\xfe") for i in order]
    assert got.tolist() == [True] + [a != b for a, b in zip(key, key[1:])]
    assert counting.entries < 5 * len(text)


@pytest.mark.parametrize("ranked", [7, 100, 1 << 15])
def test_anchors_in_chunks(monkeypatch, ranked):
    monkeypatch.setattr(suffix, "RANKED", ranked, raising=False)
    rng = np.random.default_rng(7)
    for letters, n in ((1, 300), (2, 700), (26, 900), (26, 99), (26, 20)):
        raw = rng.integers(97, 97 + letters, n).astype(np.uint8)
        off = np.array([0, 0, *sorted(rng.integers(0, n + 1, 2)), n])
        got = {p: list(range(low, high + 1)) for p, low, high in zip(*[v.tolist() for v in suffix.anchors(raw, off)], strict=True)}
        want, starts = {}, [s for a, b in zip(off[:-1], off[1:]) for s in range(a, b - 99)]
        rank = suffix._ranks(suffix._eights(raw), 32) if starts else None
        for s in starts:
            for p in np.flatnonzero(rank[s : s + 69] == rank[s : s + 69].min()) + s:
                want.setdefault(int(p), []).append(s)
        assert got == want


def odd(rng):
    """Vectors with copies, infinite, NaN and null coordinates, null and empty ones and other lengths, in no order, one id twice."""
    inf, nan = float("inf"), float("nan")
    vec = [None, [], [5.0, None, 1.0], [None, None, None], [1.0], [0.5, nan], [inf, 0.0, 0.0], [inf, 1.0, 0.0], [-inf, 0.0, 0.0], [3e38, 0.0, 0.0], [1.0, 2.0, 3.0, 4.0]]
    vec += rng.random((30, 3)).tolist() + [[0.25, 0.5, 0.75]] * 3
    ids = rng.permutation(len(vec)) * 3
    return pa.table({"vec_id": pa.array([*ids, ids[0]], pa.int64()), "embedding": pa.array([*vec, [9.0, 9.0, 9.0]], pa.list_(pa.float32()))})


@pytest.mark.parametrize("block", [1 << 20, 300])
def test_matrix_has_every_pair(spark, monkeypatch, tmp_path, block):
    """Infinite, NaN and null distances are entries as well."""
    monkeypatch.setattr(knn, "QUERY_BYTES", block)
    pq.write_table(odd(np.random.default_rng(8)), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = sorted(map(repr, con.sql(catalog.oracle_sql()["distance_matrix"]).fetchall()))
    got = catalog.queries()["distance_matrix"](spark, str(tmp_path))
    assert got.dtypes == [("i", "bigint"), ("j", "bigint"), ("d", "double")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == want


def test_matrix_of_no_rows(spark):
    assert knn.distances(spark.createDataFrame([], "id long, vec array<float>")).count() == 0
    assert knn.distances(spark.createDataFrame([(None, [1.0]), (2, [1.0]), (2, [4.0])], "id long, vec array<float>")).count() == 0


@pytest.mark.parametrize("cell, high", [(1, 1), (21, 7), (40, 64), (1 << 16, 256)])
def test_matrix_in_cells(monkeypatch, cell, high):
    monkeypatch.setattr(knn, "CELL", cell)
    monkeypatch.setattr(knn, "ROWS", high)
    t = odd(np.random.default_rng(9))
    groups = knn._grouped(t["vec_id"].to_numpy(), t["embedding"].combine_chunks().fill_null([]))
    turned = [(ids, x.T, has if has is None else has.T) for ids, x, has in groups]
    got = [tuple(r.values()) for a in groups for b in turned for cells in knn._all_between(a, b) for r in cells.to_pylist()]
    con = duckdb.connect()
    con.register("embeddings", t)
    want = con.sql(catalog.oracle_sql()["distance_matrix"]).fetchall()
    assert sorted(map(repr, got)) == sorted(map(repr, want))


@pytest.mark.parametrize("twice", [True, False])
@pytest.mark.parametrize("most, lists", [(1 << 20, 64), (1 << 20, 5), (100, 64)])
def test_sorted_lists_have_every_other_row(spark, monkeypatch, tmp_path, most, lists, twice):
    """Infinite, NaN and null distances are entries as well, in the order of the SQL."""
    monkeypatch.setattr(knn, "SORT_BYTES", most)
    monkeypatch.setattr(knn, "LISTS", lists)
    monkeypatch.setattr(knn, "CELL", 40)
    t = odd(np.random.default_rng(10))
    pq.write_table(t if twice else t.slice(0, len(t) - 1), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet'")
    want = sorted(map(repr, con.sql(catalog.oracle_sql()["sorted_distances"]).fetchall()))
    got = catalog.queries()["sorted_distances"](spark, str(tmp_path))
    assert got.dtypes == [("i", "bigint"), ("pos", "int"), ("j", "bigint"), ("d", "double")]
    assert sorted(repr(tuple(r)) for r in got.collect()) == want
    assert ("Window" in got._jdf.queryExecution().executedPlan().toString()) == (most == 100 or twice)


def test_sorted_lists_of_no_rows(spark):
    for rows in ([], [(None, [1.0])], [(2, [1.0])]):
        assert edits.sorted_distances(spark.createDataFrame(rows, "id long, vec array<float>")).count() == 0


def test_sorted_lists_take_little_room(monkeypatch):
    """Written list by list, places and ids of 4,000 rows took 3 bytes a row besides the distance."""
    x = np.random.default_rng(11).random((4000, 2))
    ids = np.arange(4000)
    cells = knn._all_sorted((ids[:256], x[:256], None), ids, [(ids, np.ascontiguousarray(x.T), None)])
    t = pa.Table.from_batches(cells)
    assert len(t) == 256 * 3999
    pq.write_table(t.select(["i", "j", "pos"]), sink := pa.BufferOutputStream(), compression="snappy")
    assert sink.getvalue().size < 2.2 * len(t)


def near_sets(families, members, size):
    """Sets in families of near copies, and their signatures."""
    rng = np.random.default_rng(7)
    sets = []
    for _ in range(families):
        own = rng.integers(0, 1 << 63, size, dtype=np.uint64)
        for k in range(members):
            one = own.copy()
            one[: size // 100] += np.uint64(k)
            sets.append(np.unique(one))
    off = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    return sets, (neardup.signatures(np.concatenate(sets), off) & 0xFFFF).astype("<u2")


def test_links_take_little_memory():
    """What hangs together was sorted with all its places, in over six times the memory of its sets."""
    sets, sig = near_sets(20, 4, 5000)
    tracemalloc.start()
    links = neardup.links_of(sig, sets)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert links == [(4 * f, 4 * f + k) for f in range(20) for k in (1, 2, 3)]
    assert peak < 3 * sum(s.nbytes for s in sets)


def test_a_group_is_held_once():
    """The batches that a group came in were held beside it while it was worked on."""

    def batches(rows):
        for k in (0, 1, 2, 3):
            key = pa.array(np.full(rows, k // 2))
            yield pa.RecordBatch.from_arrays([key, pa.array([bytes(100_000)] * rows, pa.binary())], ["key", "set"])

    start = pa.total_allocated_bytes()
    seen = []
    for b in neardup._groups(batches(20), 1):
        seen.append((b.column(0)[0].as_py(), b.num_rows))
        if len(seen) == 2:  # the last group: no batch follows
            assert pa.total_allocated_bytes() - start < 1.5 * b.nbytes
        del b
    assert seen == [(0, 40), (1, 40)]


def test_links_are_those_of_plain_sets():
    sets, sig = near_sets(6, 3, 300)
    sets = [s[: len(s) - 20 * (k % 3)] for k, s in enumerate(sets)]
    n = len(sets)
    b = pa.RecordBatch.from_arrays([pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([s.tobytes() for s in sig], pa.binary()), pa.array(np.arange(n)), pa.array(np.full(n, -1, np.int32)), pa.array(np.arange(n) + 100)], ["set", "sig", "grp", "side", "cls"])
    got = neardup._confirmed(b, 0, 75).to_pydict()
    root = list(range(n))
    for i in range(n):
        for j in range(i):
            common = len(set(sets[i].tolist()) & set(sets[j].tolist()))
            if 100 * common >= 75 * (len(sets[i]) + len(sets[j]) - common):
                root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
    assert sorted(zip(got["a"], got["b"], strict=True)) == [(100 + r, 100 + k) for k, r in sorted(enumerate(root), key=lambda x: (x[1], x[0])) if k != r]
