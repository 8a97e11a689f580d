"""Blocks of documents, and a count-min prefilter over their window hashes.

Documents are packed into blocks of a few megabytes, one row each, written once
in buckets of the block id.  A block asks about its windows, answers come back
by block id, and joining them to the blocks shuffles only the answers.

Texts that are whole copies of an earlier document's are found first, by 128 bits
of a cryptographic hash; no window of theirs is sent anywhere.

The prefilter: every block sends, to each of a number of shards, the sorted
fingerprints of its windows there, a sparse sketch.  A shard merges all
sketches into two rows of saturating counters, and answers each block
which of its windows the counters hold to be repeated.  Counters only
overestimate, so no repeated window is lost; each shard's work and answer
follow the number of its windows, and nothing is broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkit as tk
from .common import bucketed, shards_of, text_of, written

#: Bytes of text in a block, but for a longer document, which is a block of its own.
BLOCK_BYTES = 2 << 20
#: Bits of a fingerprint within its shard, and of a counter's number.
FINGER_BITS, CELL_BITS = 28, 25
#: Buckets that a task's blocks lie in at most.
FAN = 8
_LAST = np.iinfo(np.int64).max


def bucket_of(numbers: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket that Spark puts each long in: Murmur3 with the seed 42, then the remainder."""
    u = np.uint32

    def turned(x: np.ndarray, r: int) -> np.ndarray:
        return (x << u(r)) | (x >> u(32 - r))

    halves = numbers.astype("<i8").view("<u4").reshape(-1, 2)
    h = np.full(len(halves), 42, u)
    for k in (0, 1):
        h = turned(h ^ (turned(halves[:, k] * u(0xCC9E2D51), 15) * u(0x1B873593)), 13) * u(5) + u(0xE6546B64)
    h ^= u(8)
    h = (h ^ (h >> u(16))) * u(0x85EBCA6B)
    h = (h ^ (h >> u(13))) * u(0xC2B2AE35)
    return (h ^ (h >> u(16))).view(np.int32) % buckets


def block_ids(task: int, buckets: int) -> Iterator[int]:
    """Ids for a task's blocks, none another task's: they lie in at most ``FAN`` buckets, so that files grow with tasks and not with tasks times buckets."""
    wanted = [(task * FAN + k) % buckets for k in range(FAN)]
    found: dict[int, list[int]] = {b: [] for b in wanted}
    low, turn = 0, 0
    while True:
        bucket = wanted[turn % FAN]
        while not found[bucket]:
            numbers = (task << 32) + np.arange(low, low + 4 * buckets, dtype=np.int64)
            low += len(numbers)
            at = bucket_of(numbers, buckets)
            for b in found:
                found[b] += numbers[at == b].tolist()
        yield found[bucket].pop(0)
        turn += 1


def packed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks: blk, and lists of doc_id, text, null as empty, and two halves of its digest.  Ids that are no longs are cast, and null where that fails."""
    df = docs.select(docs[id_col].try_cast("long").alias("doc_id"), text_of(docs, text_col).alias("text"))
    buckets = shards_of(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = block_ids(TaskContext.get().partitionId(), buckets)
        for b in batches:
            for first, end, raw, off in tk.chunks(b.column(1), BLOCK_BYTES):
                data = memoryview(raw)
                halves = tk.digests(data[i:j] for i, j in zip(off[:-1].tolist(), off[1:].tolist(), strict=True))
                columns = [*b.slice(first, end - first).columns, *[pa.array(halves[:, k]) for k in (0, 1)]]
                lists = [pa.ListArray.from_arrays(pa.array([0, end - first], pa.int32()), c) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), *lists], ["blk", "doc_id", "text", "one", "two"])

    return bucketed(df.mapInArrow(run, "blk long, doc_id array<long>, text array<string>, one array<long>, two array<long>"), "blk", "blocks")


def two_hashes(raw: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two independent hashes of byte runs."""
    return tk.word_hashes(raw, begin, end), tk.word_hashes(raw, begin, end, 1)


def same(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows in which both hashes are."""
    rows = np.lexsort((two, one))
    a, b = one[rows], two[rows]
    head = np.ones(len(rows), bool)
    head[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(rows), np.int64)
    out[rows] = np.cumsum(head) - 1
    return out


def first_of(order: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which rows are at the first place of their group: none is smaller by order, then start."""
    rows = np.lexsort((start, order, group))
    g, o, s = group[rows], order[rows], start[rows]
    head = np.ones(len(rows), bool)
    head[1:] = g[1:] != g[:-1]
    lead = np.flatnonzero(head)[np.cumsum(head) - 1] if len(rows) else rows
    out = np.empty(len(rows), bool)
    out[rows] = (o == o[lead]) & (s == s[lead])
    return out


def _order(ids: pa.Array) -> np.ndarray:
    """What orders documents: their ids, null as the largest."""
    return ids.fill_null(_LAST).to_numpy(zero_copy_only=False)


class Opened:
    """A block's row: bytes and offsets of its texts, what orders its documents, and which are copies of earlier ones."""

    def __init__(self, b: pa.RecordBatch, row: int) -> None:
        self.blk = b.column("blk")[row].as_py()
        self.ids = b.column("doc_id")[row].values
        self.order = _order(self.ids)
        self.raw, self.off = tk.buffers(b.column("text")[row].values)
        self.copy = np.zeros(len(self.ids), bool)
        for a in b.column("copies")[row].as_py() or []:
            self.copy[a["at"]] = True


def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Opened, list]]:
    """Every block with its answers (a list of dicts, empty without)."""
    for b in batches:
        for row in range(b.num_rows):
            yield Opened(b, row), (b.column("answers")[row].as_py() or []) if "answers" in b.schema.names else []


def squeezed(a: np.ndarray, rising: bool = True) -> bytes:
    """A number array in few bytes: by byte planes, compressed; numbers that rise as differences."""
    a = np.ascontiguousarray(a)
    if rising:
        a = np.diff(a, prepend=a.dtype.type(0))
    planes = a.view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True) if planes else b""


def spread(data: bytes, n: int, dtype: str, rising: bool = True) -> np.ndarray:
    """Undoes ``squeezed`` for n numbers."""
    d = np.dtype(dtype)
    if not n:
        return np.zeros(0, d)
    planes = np.frombuffer(pa.decompress(data, decompressed_size=n * d.itemsize, codec="zstd"), np.uint8)
    a = np.ascontiguousarray(planes.reshape(d.itemsize, n).T).view(d).ravel()
    return np.cumsum(a, dtype=d) if rising else a


def sent_hash(h: np.ndarray) -> np.ndarray:
    """The part of a hash that is sent: 48 bits; two of them tell windows apart."""
    return h >> np.uint64(16)


def shard_of(sent: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a sent hash."""
    return ((sent >> np.uint64(20)) % np.uint64(shards)).astype(np.int64)


def _fingers(hashes: np.ndarray, shards: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (shard, fingerprint) numbers, sorted; their counts; and where each hash is among them."""
    shard = (hashes >> np.uint64(40)) % np.uint64(shards)
    finger = (hashes >> np.uint64(8)) & np.uint64((1 << FINGER_BITS) - 1)
    u, at, n = np.unique((shard << np.uint64(FINGER_BITS)) | finger, return_inverse=True, return_counts=True)
    return u, n, at


def _cells(finger: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two counters of each fingerprint."""
    f = finger.astype(np.uint64)
    return (f >> np.uint64(FINGER_BITS - CELL_BITS)).astype(np.int64), (tk.mixed(f + np.uint64(1)) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


def _judge(pieces: list[tuple[int, np.ndarray, np.ndarray]], hot: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each block's fingerprints, whether the smaller counter stands at two or more, and at ``hot`` or more."""
    count = np.zeros((2, 1 << CELL_BITS), np.uint8)
    for _, finger, twice in pieces:
        for row, cell in enumerate(_cells(finger)):
            u, at, n = np.unique(cell, return_inverse=True, return_counts=True)
            n = n + np.bincount(at[twice], minlength=len(u))
            count[row, u] = np.minimum(count[row, u] + n, 255)
    for blk, finger, _ in pieces:
        a, b = _cells(finger)
        least = np.minimum(count[0, a], count[1, b])
        yield blk, least >= 2, least >= hot


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[int, list[dict]]]:
    """Runs of rows with one value of ``key``, from sorted batches."""
    at, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r[key] != at:
                if rows:
                    yield at, rows
                at, rows = r[key], []
            rows.append(r)
    if rows:
        yield at, rows


def answered(blocks: DataFrame, answers: DataFrame, name: str = "answers") -> DataFrame:
    """Blocks with the rows of ``answers`` (blk, answer: struct) in a list."""
    per = answers.groupBy("blk").agg(F.collect_list("answer").alias(name))
    return blocks.join(per, "blk", "left")


def with_copies(blocks: DataFrame) -> DataFrame:
    """Blocks with ``copies``: at which places of the block a text is a copy of an earlier document's."""
    shards = shards_of(blocks)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                one, two = (b.column(c)[row].values.to_numpy(zero_copy_only=False).view(np.uint64) for c in ("one", "two"))
                order = _order(b.column("doc_id")[row].values)
                first = first_of(order, np.zeros(len(order), np.int64), same(one, two))
                shard = np.where(first, shard_of(one, shards), -1)  # -1: settled here
                for s in np.unique(shard):
                    at = np.flatnonzero(shard == s)
                    yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int32()), b.column("blk").slice(row, 1), *[pa.array([v], pa.list_(pa.int64())) for v in (at, one[at].view(np.int64), two[at].view(np.int64), order[at])]], ["shard", "blk", "at", "one", "two", "place"])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in by_group(batches, "shard"):
            of = {c: np.concatenate([np.array(r[c], np.int64) for r in rows]) for c in ("at", "one", "two", "place")}
            later = ~first_of(of["place"], np.zeros(len(of["at"]), np.int64), same(of["one"], of["two"]))
            cut = np.concatenate([[0], np.cumsum([len(r["at"]) for r in rows])])
            for r, i, j in zip(rows, cut[:-1], cut[1:], strict=True):
                if later[i:j].any():
                    yield pa.RecordBatch.from_arrays([pa.array([r["blk"]], pa.int64()), pa.array([of["at"][i:j][later[i:j]]], pa.list_(pa.int64()))], ["blk", "at"])

    sent = written(blocks.select("blk", "doc_id", "one", "two").mapInArrow(send, "shard int, blk long, at array<long>, one array<long>, two array<long>, place array<long>"), "copies")
    asked = sent.where("shard >= 0").repartition(shards, "shard").sortWithinPartitions("shard", "blk")
    gone = written(asked.mapInArrow(judge, "blk long, at array<long>").unionByName(sent.where("shard < 0").select("blk", "at")), "copies")
    return answered(blocks.drop("one", "two"), gone.select("blk", F.struct("at").alias("answer")), "copies")


def prefiltered(blocks: DataFrame, hashes: Callable[[Opened], np.ndarray], shards: int, hot: int = 255) -> DataFrame:
    """blk and answer (shard, n, bits, hot): which fingerprints of the block may be repeated, and which may be in ``hot`` blocks."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, _ in opened(batches):
            u, n, _ = _fingers(hashes(block), shards)
            cut = np.searchsorted(u, np.arange(shards + 1, dtype=np.uint64) << np.uint64(FINGER_BITS))
            rows = [(s, i, j) for s, (i, j) in enumerate(zip(cut[:-1], cut[1:], strict=True)) if j > i]
            if rows:
                finger = (u & np.uint64((1 << FINGER_BITS) - 1)).astype("<u4")
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([s for s, _, _ in rows], pa.int32()),
                        pa.array([block.blk] * len(rows), pa.int64()),
                        pa.array([j - i for _, i, j in rows], pa.int32()),
                        pa.array([squeezed(finger[i:j]) for _, i, j in rows], pa.binary()),
                        pa.array([squeezed(np.packbits(n[i:j] > 1), False) for _, i, j in rows], pa.binary()),
                    ],
                    ["shard", "blk", "n", "fingers", "twice"],
                )

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in by_group(batches, "shard"):
            pieces = [(r["blk"], spread(r["fingers"], r["n"], "<u4"), np.unpackbits(spread(r["twice"], -(-r["n"] // 8), "u1", False), count=r["n"]).astype(bool)) for r in rows]
            out = [x for x in _judge(pieces, hot) if x[1].any()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out]), pa.array([shard] * len(out), pa.int32()), pa.array([len(o[1]) for o in out], pa.int32()), *[pa.array([squeezed(np.packbits(o[k]), False) for o in out], pa.binary()) for k in (1, 2)]], ["blk", "shard", "n", "bits", "hot"])

    sent = blocks.mapInArrow(sketch, "shard int, blk long, n int, fingers binary, twice binary")
    sent = sent.repartition(shards, "shard").sortWithinPartitions("shard", "blk")
    return sent.mapInArrow(judge, "blk long, shard int, n int, bits binary, hot binary").select("blk", F.struct("shard", "n", "bits", "hot").alias("answer"))


def maybe_repeated(hashes: np.ndarray, answers: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """The block's windows that the prefilter holds to be repeated, and those in many blocks."""
    u, _, at = _fingers(hashes, shards)
    held = np.zeros((2, len(u)), bool)
    cut = np.searchsorted(u, np.arange(shards + 1, dtype=np.uint64) << np.uint64(FINGER_BITS))
    for a in answers:
        s = a["shard"]
        for row, name in enumerate(("bits", "hot")):
            held[row, cut[s] : cut[s + 1]] = np.unpackbits(spread(a[name], -(-a["n"] // 8), "u1", False), count=a["n"]).astype(bool)
    return held[0, at], held[1, at]
