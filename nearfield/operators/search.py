"""Beam search on proximity graphs, and their construction in rounds.

A graph is held in shards.  A shard is a row: its node ids, vectors and
neighbour lists, of at most ``SHARD_BYTES``.  Queries search every shard and the
best of all shards are merged, so no task holds more than a shard, and none more
than its share of queries.  One shard is the whole graph where it fits.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.vectors import pair_distances
from .knn import CELL, ROWS, _apart, _blocks, matrix
from .prune import quick, robust_prune

SHARD_BYTES = 256 << 20
#: Bytes of the distances between all rows of a shard that its construction holds at most, else they are computed as asked for.
TABLE_BYTES = 32 << 20
#: Queries times nodes of the walks that a task takes step by step together.
TOGETHER = 4_000_000


@dataclass
class Walk:
    """What a beam search saw: (position, distance) of the final beam and of the visited nodes, in order, and each step's beam."""

    beam: list[tuple[int, float]]
    visited: list[tuple[int, float]] = field(default_factory=list)
    steps: list[tuple[int, list[int]]] = field(default_factory=list)
    compared: int = 0


def exact(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    return pair_distances("euclidean", x, q[None, :])


def beam_search(q: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray], start: int, width: int, limit: int | None = None, measure: Callable[[np.ndarray, np.ndarray], np.ndarray] = exact) -> Walk:
    """Expands the nearest unvisited entry of the beam until all are visited, or ``limit`` are."""
    d0 = float(measure(x[[start]], q)[0])
    walk = Walk([(start, d0)], compared=1)
    seen, visited = {start}, set()
    while True:
        at = next((e for e in walk.beam if e[0] not in visited), None)
        if at is None:
            return walk
        visited.add(at[0])
        walk.visited.append(at)
        new = [int(n) for n in nbrs[at[0]] if int(n) not in seen]
        seen.update(new)
        if new:
            d = measure(x[new], q)
            walk.compared += len(new)
            walk.beam = sorted([*walk.beam, *zip(new, d.tolist(), strict=True)], key=lambda e: e[1])[:width]
        walk.steps.append((at[0], [n for n, _ in walk.beam]))
        if limit is not None and len(walk.visited) >= limit:
            return walk


def beam_searches(q: np.ndarray, x: np.ndarray, off: np.ndarray, flat: np.ndarray, width: int, limit: int | None = None) -> dict[str, list[np.ndarray]]:
    """(query, node, distance) of the final beams and of the visited nodes of ``beam_search`` from node 0 for every query, all a step at a time."""
    degree = np.diff(off)
    beam, far = np.full((len(q), width), -1), np.full((len(q), width), np.inf)
    done, seen = np.zeros((len(q), width), bool), np.zeros((len(q), len(x)), bool)
    # where the walks may compare all nodes anyhow, distances to all are computed side by side
    table = _all_distances(q, x) if width * degree.max(initial=0) >= len(x) else None
    measure = (lambda own, node: table[own, node]) if table is not None else (lambda own, node: pair_distances("euclidean", x[node], q[own]))
    every = np.arange(len(q))
    beam[:, 0], seen[:, 0] = 0, True
    far[:, 0] = measure(every, np.zeros(len(q), int))
    visited = []
    while limit is None or len(visited) < max(1, limit):
        left = ~done & (beam >= 0)
        own = np.flatnonzero(left.any(1))
        if not len(own):
            break
        at = left[own].argmax(1)
        node = beam[own, at]
        visited.append((own, node, far[own, at]))
        done[own] |= beam[own] == node[:, None]
        size = degree[node]
        place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        walk = np.repeat(own, size)
        new = flat[np.repeat(off[node], size) + place]
        fresh = ~seen[walk, new]
        walk, new, place = walk[fresh], new[fresh], place[fresh]
        seen[walk, new] = True
        d = measure(walk, new)
        near = d < far[walk, -1]  # others would be behind a full beam
        walk, new, place, d = walk[near], new[near], place[near], d[near]
        rows, row = np.unique(walk, return_inverse=True)
        more = place.max(initial=-1) + 1
        grown = [np.hstack([held[rows], np.full((len(rows), more), none)]) for held, none in ((far, np.inf), (beam, -1), (done, False))]
        grown[0][row, width + place], grown[1][row, width + place] = d, new
        order = np.argsort(grown[0], axis=1, kind="stable")[:, :width]
        far[rows], beam[rows], done[rows] = (np.take_along_axis(g, order, 1) for g in grown)
    own, at = np.nonzero(beam >= 0)
    return {"beam": [own, beam[own, at], far[own, at]], "visited": [np.concatenate(v) for v in zip(*visited, strict=True)]}


def _all_distances(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    right = np.ascontiguousarray(x.T)
    return np.vstack([np.hstack([_apart(q[i : i + ROWS], right[:, j : j + CELL // ROWS]) for j in range(0, len(x), CELL // ROWS)]) for i in range(0, len(q), ROWS)])


def greedy_walk(q: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray], start: int, most: int = 20, near: float = 0.01, skip_path: bool = False) -> list[int]:
    """Steps to the neighbour nearest to the query, even a farther one, until one is on the path, or within ``near``.

    With ``skip_path``, neighbours on the path don't count, and the walk ends where none is left.
    """
    path = [start]
    while len(path) <= most and float(pair_distances("euclidean", x[[path[-1]]], q[None, :])[0]) >= near and len(nbrs[path[-1]]):
        own = np.asarray(nbrs[path[-1]], int)
        if skip_path:
            own = own[~np.isin(own, path)]
            if not len(own):
                break
        nxt = int(own[pair_distances("euclidean", x[own], q[None, :]).argmin()])
        if nxt in path:
            break
        path.append(nxt)
    return path


def path_to(target: int, x: np.ndarray, nbrs: list[np.ndarray], start: int, most: int = 10_000) -> list[int]:
    """Steps to the neighbour nearest to the target, each strictly nearer; a neighbour that is the target is taken at once."""
    path, d = [start], float(pair_distances("squared_euclidean", x[[start]], x[[target]])[0])
    while path[-1] != target and len(path) <= most and len(nbrs[path[-1]]):
        own = np.asarray(nbrs[path[-1]], int)
        if target in own:
            path.append(target)
            break
        near = pair_distances("squared_euclidean", x[own], x[[target]])
        if not near.min() < d:
            break
        d = float(near.min())
        path.append(int(own[near.argmin()]))
    return path


def vamana(x: np.ndarray, alpha: float = 1.01, bound: int = 8, beam: int = 100, limit: int = 500, root: int = 0, seed: int = 41901) -> list[np.ndarray]:
    """Neighbour lists built by inserting one row after the other, in a random order."""
    nbrs = [np.zeros(0, int) for _ in x]
    measure = quick
    if len(x) ** 2 * 8 <= TABLE_BYTES:  # places stand for the rows
        table = np.stack([quick(x, v) for v in x]) if len(x) else np.zeros((0, 0))
        x, measure = np.arange(len(x)), lambda rows, v: table[v, rows]
    for i in np.random.default_rng(seed).permutation(len(x)):
        if i == root:
            continue
        seen = np.array([n for n, _ in beam_search(x[i], x, nbrs, root, beam, limit, measure).visited if n != i])
        own = np.unique(np.concatenate([seen, nbrs[i]]).astype(int))
        nbrs[i] = own[robust_prune(x[i], x[own], alpha, bound, measure)]
        for n in nbrs[i]:
            back = nbrs[n] if i in nbrs[n] else np.append(nbrs[n], i)
            nbrs[n] = back if len(back) <= bound else back[robust_prune(x[n], x[back], alpha, bound, measure)]
    return nbrs


_SHARD = "shard long, ids array<long>, vecs array<double>, off array<int>, flat array<int>"


def _shard_table(shard: int, ids: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray]) -> pa.Table:
    off = np.concatenate([[0], np.cumsum([len(n) for n in nbrs])]).astype(np.int32)
    flat = np.concatenate([np.zeros(0, int), *nbrs]).astype(np.int32)
    values = [(ids, pa.int64()), (x.ravel(), pa.float64()), (off, pa.int32()), (flat, pa.int32())]
    return pa.table([pa.array([shard], pa.int64()), *[pa.array([v], pa.list_(t)) for v, t in values]], ["shard", "ids", "vecs", "off", "flat"])


def _nearest(found: list[np.ndarray], k: int) -> list[np.ndarray]:
    """The first k of each query (qid, nbr, dist), by distance, ties by id; repeats count once."""
    order = np.lexsort((found[1], found[2], found[0]))
    qid, nbr, d = (v[order] for v in found)
    new = np.ones(len(qid), bool)
    new[1:] = (qid[1:] != qid[:-1]) | (nbr[1:] != nbr[:-1]) | (d[1:] != d[:-1])
    qid, nbr, d = qid[new], nbr[new], d[new]
    ok = np.arange(len(qid)) - np.searchsorted(qid, qid) < k
    return [qid[ok], nbr[ok], d[ok]]


@dataclass
class Graph:
    """Shards of a graph; searches start at each shard's first node."""

    shards: DataFrame

    def _served(self, queries: DataFrame, serve: Callable[[Iterator[tuple]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
        """What ``serve`` makes of a task's parts: query ids and vectors, and shard, ids, vectors, offsets and neighbours."""
        parts = None
        for qids, q in _blocks(queries):
            shared = self.shards.sparkSession.sparkContext.broadcast((qids, q))

            def parts_of(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[tuple]:
                qids, q = shared.value
                for b in batches:
                    for row in range(b.num_rows):
                        get = lambda c: b.column(c)[row].values.to_numpy(zero_copy_only=False)  # noqa: E731, B023
                        ids = get("ids")
                        part = np.array_split(np.arange(len(qids)), b.column("parts")[row].as_py())[b.column("part")[row].as_py()]
                        yield qids[part], q[part], b.column("shard").slice(row, 1), ids, get("vecs").reshape(len(ids), -1), get("off"), get("flat")

            def run(batches: Iterator[pa.RecordBatch], parts_of=parts_of) -> Iterator[pa.RecordBatch]:
                return serve(parts_of(batches))

            n = self.shards.sparkSession.sparkContext.defaultParallelism
            dealt = self.shards.withColumn("parts", F.lit(n)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).repartition(n, "shard", "part")
            part = dealt.mapInArrow(run, schema)
            parts = part if parts is None else parts.unionByName(part)
        return parts if parts is not None else self.shards.sparkSession.createDataFrame([], schema)

    def _each(self, queries: DataFrame, answer: Callable[[np.ndarray, np.ndarray, np.ndarray, list[np.ndarray]], list[pa.Array]], columns: list[str], schema: str) -> DataFrame:
        """qid, shard and the columns that ``answer`` (query, ids, vectors, neighbour lists) gives for each query in each shard."""

        def serve(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for qids, q, shard, ids, x, off, flat in parts:
                nbrs = [flat[i:j] for i, j in zip(off[:-1], off[1:], strict=True)]
                for k in range(len(qids)):
                    yield pa.RecordBatch.from_arrays([pa.array([qids[k]]), shard, *answer(q[k], ids, x, nbrs)], ["qid", "shard", *columns])

        return self._served(queries, serve, f"qid long, shard long, {schema}")

    def walks(self, queries: DataFrame, width: int, limit: int | None = None, start: int | None = None) -> DataFrame:
        """qid, shard, beam and visited (lists of id and dist), steps (expanded, beam) and compared; from ``start`` in the shards that have it, else from the first node."""
        entry = pa.list_(pa.struct([("id", pa.int64()), ("dist", pa.float64())]))
        step = pa.list_(pa.struct([("expanded", pa.int64()), ("beam", pa.list_(pa.int64()))]))

        def answer(q: np.ndarray, ids: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray]) -> list[pa.Array]:
            at = np.flatnonzero(ids == start)
            w = beam_search(q, x, nbrs, int(at[0]) if len(at) else 0, width, limit)
            named = lambda es: [{"id": int(ids[n]), "dist": d} for n, d in es]
            steps = [{"expanded": int(ids[e]), "beam": ids[s].tolist()} for e, s in w.steps]
            return [pa.array([named(w.beam)], entry), pa.array([named(w.visited)], entry), pa.array([steps], step), pa.array([w.compared])]

        return self._each(queries, answer, ["beam", "visited", "steps", "compared"], "beam array<struct<id:long,dist:double>>, visited array<struct<id:long,dist:double>>, steps array<struct<expanded:long,beam:array<long>>>, compared long")

    def greedy(self, queries: DataFrame, most: int = 20, near: float = 0.01, skip_path: bool = False) -> DataFrame:
        """qid, shard, step, id and dist of a greedy walk in each shard."""
        entry = pa.list_(pa.struct([("id", pa.int64()), ("dist", pa.float64())]))

        def answer(q: np.ndarray, ids: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray]) -> list[pa.Array]:
            path = greedy_walk(q, x, nbrs, 0, most, near, skip_path)
            return [pa.array([[{"id": int(ids[n]), "dist": float(d)} for n, d in zip(path, exact(x[path], q), strict=True)]], entry)]

        walks = self._each(queries, answer, ["path"], "path array<struct<id:long,dist:double>>")
        return walks.select("qid", "shard", F.posexplode("path").alias("step", "e")).select("qid", "shard", "step", F.col("e.id").alias("id"), F.col("e.dist").alias("dist"))

    def paths(self, queries: DataFrame, most: int = 10_000) -> DataFrame:
        """qid, shard, step, src and dst: the edges walked in each shard to the node nearest to the query, ever nearer."""

        def answer(q: np.ndarray, ids: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray]) -> list[pa.Array]:
            path = path_to(int(exact(x, q).argmin()), x, nbrs, 0, most) if len(x) else []
            return [pa.array([ids[path].tolist()], pa.list_(pa.int64()))]

        walks = self._each(queries, answer, ["path"], "path array<long>")
        return walks.select("qid", "shard", F.posexplode(F.slice("path", F.lit(2), F.greatest(F.size("path") - 1, F.lit(0)))).alias("step", "dst"), "path").select("qid", "shard", "step", F.get("path", F.col("step")).alias("src"), "dst")

    def search(self, queries: DataFrame, k: int, width: int = 10, limit: int | None = None, among: str = "beam") -> DataFrame:
        """qid, rank, nbr and dist of the k nearest that the searches of all shards found."""

        def serve(parts: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]  # of all shards so far, the k nearest of each query
            for qids, q, _, ids, x, off, flat in parts:
                step = max(1, TOGETHER // max(1, len(ids)))
                for i in range(0, len(qids), step):
                    own, node, d = beam_searches(q[i : i + step], x, off, flat, width, limit)[among]
                    held = _nearest([np.concatenate(v) for v in zip(held, (qids[i : i + step][own], ids[node], d), strict=True)], k)
            if len(held[0]):
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in held], ["qid", "nbr", "dist"])

        hits = self._served(queries, serve, "qid long, nbr long, dist double").distinct()
        order = Window.partitionBy("qid").orderBy("dist", "nbr")
        return hits.withColumn("rank", F.row_number().over(order) - 1).where(F.col("rank") < k).select("qid", "rank", "nbr", "dist")

    def adjacency(self) -> DataFrame:
        """src and nbrs; a node of several shards has the edges of each."""
        at = F.posexplode("ids").alias("i", "src")
        rows = self.shards.select("ids", "off", "flat", at)
        own = F.slice("flat", F.get("off", F.col("i")) + 1, F.get("off", F.col("i") + 1) - F.get("off", F.col("i")))
        return rows.select("src", F.transform(own, lambda n: F.get("ids", n)).alias("nbrs")).groupBy("src").agg(F.array_distinct(F.flatten(F.collect_list("nbrs"))).alias("nbrs"))


def _sharded(vectors: DataFrame, n: int) -> DataFrame:
    return vectors.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("shard"), "id", "vec")


def _n_shards(vectors: DataFrame) -> int:
    size = vectors.agg(F.count("*"), F.max(F.size("vec"))).first()
    return max(1, -(-(size[0] * (size[1] or 0) * 8) // SHARD_BYTES))


def build_vamana(vectors: DataFrame, alpha: float = 1.01, bound: int = 8, beam: int = 100, limit: int = 500, shards: int | None = None) -> Graph:
    """A graph over each shard of the rows; as many shards as their size asks for."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        x = matrix(t["vec"].combine_chunks())
        return _shard_table(t["shard"][0].as_py(), t["id"].to_numpy(), x, vamana(x, alpha, bound, beam, limit))

    return Graph(_sharded(vectors, shards or _n_shards(vectors)).groupBy("shard").applyInArrow(run, _SHARD))


def from_adjacency(vectors: DataFrame, adj: DataFrame) -> Graph:
    """A graph given by its lists, in one shard: a search may go everywhere."""
    if _n_shards(vectors) > 1:
        raise ValueError("the graph doesn't fit a shard; build it in shards")
    rows = vectors.select("id", "vec").join(adj, F.col("id") == F.col("src"), "left").select(F.lit(0).cast("long").alias("shard"), "id", "vec", F.coalesce("nbrs", F.array().cast("array<long>")).alias("nbrs"))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("id")
        ids = t["id"].to_numpy()
        nbrs = [np.searchsorted(ids, np.array(n, np.int64)) for n in t["nbrs"].to_pylist()]
        return _shard_table(0, ids, matrix(t["vec"].combine_chunks()), nbrs)

    return Graph(rows.groupBy("shard").applyInArrow(run, _SHARD))
