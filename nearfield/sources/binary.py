"""Binary files of vectors, graphs and nearest-neighbour tables.

All numbers are little-endian.  Vectors: u32 rows, u32 length, then the rows.
Graphs: u32 nodes, u32 largest degree, u32 degree of every node, then all
neighbour lists.  Neighbour tables: u32 rows, u32 k, ids as u32, distances as
f32.  Readers split a file by ranges of rows and seek; writers put each row at
its own offset, so a task that runs twice writes the same bytes.  Paths are on a
file system that the driver and the executors mount alike.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Element types of vector files.
ELEMENTS = {"float": "<f4", "double": "<f8", "int": "<i4", "byte": "<i1"}
_NAMES = {"float": "float", "double": "double", "int": "int", "byte": "tinyint"}
_SPLIT = 1 << 20


class _Rows(InputPartition):
    def __init__(self, first: int, end: int, skip: int = 0) -> None:
        self.first, self.end, self.skip = first, end, skip


def _header(path: str) -> tuple[int, int]:
    with open(path, "rb") as f:
        head = f.read(8)
    if len(head) < 8:
        raise ValueError(f"{path}: {len(head)} bytes; a header has 8")
    n, m = np.frombuffer(head, "<u4")
    return int(n), int(m)


def _read(path: str, offset: int, count: int, dtype: str) -> np.ndarray:
    out = np.fromfile(path, dtype, count, offset=offset)
    if len(out) < count:
        raise ValueError(f"{path}: {count - len(out)} numbers are missing at byte {offset}")
    return out


def _size(path: str, want: int) -> None:
    if os.path.getsize(path) != want:
        raise ValueError(f"{path}: {os.path.getsize(path)} bytes; its header asks for {want}")


class _VectorReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.element = options["path"], options.get("element", "float")
        self.limit = int(options.get("limit", -1))

    def partitions(self) -> list[_Rows]:
        n, dim = _header(self.path)
        dtype = np.dtype(ELEMENTS[self.element])
        if self.limit < 0:
            _size(self.path, 8 + n * dim * dtype.itemsize)
        elif self.limit > n:
            raise ValueError(f"{self.path}: {n} rows; {self.limit} are asked for")
        n = n if self.limit < 0 else self.limit
        step = max(1, _SPLIT // max(dim, 1))
        return [_Rows(i, min(n, i + step)) for i in range(0, n, step)] or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        dim = _header(self.path)[1]
        dtype = np.dtype(ELEMENTS[self.element])
        rows = part.end - part.first
        data = _read(self.path, 8 + part.first * dim * dtype.itemsize, rows * dim, ELEMENTS[self.element])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * dim, pa.int32()), pa.array(data))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.end), pa.int64()), lists], ["id", "vec"])


class VectorFile(DataSource):
    """Options: path, element (float, double, int or byte) and limit, the rows to read from the beginning."""

    @classmethod
    def name(cls) -> str:
        return "vectorfile"

    def schema(self) -> str:
        return f"id bigint, vec array<{_NAMES[self.options.get('element', 'float')]}>"

    def reader(self, schema) -> DataSourceReader:
        return _VectorReader(dict(self.options))


class _GraphReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_Rows]:
        n, _ = _header(self.path)
        parts, skip = [], 0
        for i in range(0, n, _SPLIT):  # the degrees, a block at a time
            end = min(n, i + _SPLIT)
            parts.append(_Rows(i, end, skip))
            skip += int(_read(self.path, 8 + 4 * i, end - i, "<u4").sum(dtype=np.int64))
        if os.path.getsize(self.path) < 8 + 4 * (n + skip):
            raise ValueError(f"{self.path}: {os.path.getsize(self.path)} bytes; its degrees ask for {8 + 4 * (n + skip)}")
        return parts or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        n, _ = _header(self.path)
        degree = _read(self.path, 8 + 4 * part.first, part.end - part.first, "<u4").astype(np.int64)
        off = np.concatenate([[0], np.cumsum(degree)])
        flat = _read(self.path, 8 + 4 * (n + part.skip), int(off[-1]), "<u4").astype(np.int64)
        lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(flat))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first, part.end), pa.int64()), lists], ["src", "nbrs"])


class GraphFile(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "graphfile"

    def schema(self) -> str:
        return "src bigint, nbrs array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return _GraphReader(dict(self.options))


class _NeighbourReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]

    def partitions(self) -> list[_Rows]:
        n, k = _header(self.path)
        _size(self.path, 8 + 8 * n * k)
        step = max(1, _SPLIT // max(k, 1))
        return [_Rows(i, min(n, i + step)) for i in range(0, n, step)] or [_Rows(0, 0)]

    def read(self, part: _Rows) -> Iterator[pa.RecordBatch]:
        n, k = _header(self.path)
        count = (part.end - part.first) * k
        ids = _read(self.path, 8 + 4 * part.first * k, count, "<u4").astype(np.int64)
        dist = _read(self.path, 8 + 4 * (n * k + part.first * k), count, "<f4").astype(float)
        qid = np.repeat(np.arange(part.first, part.end), k)
        rank = np.tile(np.arange(k, dtype=np.int32), part.end - part.first)
        yield pa.RecordBatch.from_arrays([pa.array(qid, pa.int64()), pa.array(rank, pa.int32()), pa.array(ids), pa.array(dist)], ["qid", "rank", "nbr", "dist"])


class NeighbourFile(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "neighbourfile"

    def schema(self) -> str:
        return "qid bigint, rank int, nbr bigint, dist double"

    def reader(self, schema) -> DataSourceReader:
        return _NeighbourReader(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    for source in (VectorFile, GraphFile, NeighbourFile):
        spark.dataSource.register(source)
    return spark


#: End of the name of a file that is being written.
_PART = ".part"


def _laid_out(path: str, head: list[int], size: int) -> None:
    """A file of this size beside ``path``, which keeps its content until all rows are written."""
    with open(path + _PART, "wb") as f:
        f.write(np.array(head, "<u4").tobytes())
        f.truncate(size)


def _put(df: DataFrame, path: str, place) -> int:
    """Writes (offset, bytes) that ``place`` makes of each batch to the file laid out, which then takes its name; returns the rows written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        with open(path + _PART, "r+b") as f:
            for b in batches:
                for offset, data in place(b):
                    f.seek(offset)
                    f.write(data)
                n += b.num_rows
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    n = df.mapInArrow(run, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    os.replace(path + _PART, path)
    return n


def write_vectors(df: DataFrame, path: str, element: str = "float") -> None:
    """Rows (id, vec) with ids from 0 without gaps, as a vector file."""
    n, dim, least, most = df.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.min("id"), F.max("id")).first()
    if n and (least, most) != (0, n - 1):
        raise ValueError("ids must count from 0 without gaps")
    dtype = np.dtype(ELEMENTS[element])
    _laid_out(path, [n, dim], 8 + n * dim * dtype.itemsize)
    _put(df.select("id", "vec"), path, lambda b: ((8 + i * dim * dtype.itemsize, np.asarray(v, dtype).tobytes()) for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)))


def write_neighbours(df: DataFrame, path: str) -> None:
    """Rows (qid, rank, nbr, dist) with k ranks for each qid from 0 on, as a neighbour table."""
    n, k = df.agg(F.countDistinct("qid"), F.coalesce(F.max("rank") + 1, F.lit(0))).first()
    _laid_out(path, [n, k], 8 + 8 * n * k)

    def place(b: pa.RecordBatch) -> Iterator[tuple[int, bytes]]:
        for q, r, i, d in zip(*[c.to_pylist() for c in b.columns], strict=True):
            yield 8 + 4 * (q * k + r), np.array([i], "<u4").tobytes()
            yield 8 + 4 * (n * k + q * k + r), np.array([d], "<f4").tobytes()

    _put(df.select("qid", "rank", "nbr", "dist"), path, place)


def write_graph(adj: DataFrame, path: str, block: int = 1 << 16) -> None:
    """Rows (src, nbrs) with src from 0 without gaps, as a graph file; one total a block of nodes reaches the driver."""
    size = F.size("nbrs")
    totals = {r[0]: (r[1], r[2], r[3]) for r in adj.groupBy(F.floor(F.col("src") / block).alias("b")).agg(F.sum(size), F.max(size), F.count("*")).collect()}
    n = sum(t[2] for t in totals.values())
    starts, at = {}, 0
    for b in sorted(totals):
        starts[b] = at
        at += totals[b][0]
    _laid_out(path, [n, max([0, *[t[1] for t in totals.values()]])], 8 + 4 * (n + at))

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("src")
        first = t["src"][0].as_py()
        lists = t["nbrs"].to_pylist()
        with open(path + _PART, "r+b") as f:
            f.seek(8 + 4 * first)
            f.write(np.array([len(x) for x in lists], "<u4").tobytes())
            f.seek(8 + 4 * (n + starts[first // block]))
            f.write(np.array([v for x in lists for v in x], "<u4").tobytes())
        return pa.table({"n": pa.array([len(lists)], pa.int64())})

    adj.withColumn("b", F.floor(F.col("src") / block)).groupBy("b").applyInArrow(run, "n long").agg(F.sum("n")).first()
    os.replace(path + _PART, path)


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """id, the number of a line from 0, and word."""
    lines = spark.read.option("wholetext", False).text(path).withColumn("at", F.monotonically_increasing_id())
    parts = lines.withColumn("part", F.spark_partition_id())
    counts = {r["part"]: r["n"] for r in parts.groupBy("part").agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, at = {}, 0
    for p in sorted(counts):
        before[p] = at
        at += counts[p]
    if not before:
        return lines.select(F.col("at").alias("id"), F.col("value").alias("word"))
    skip = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])
    return parts.select((skip[F.col("part")] + F.col("at") - F.col("part").cast("long") * (1 << 33)).alias("id"), F.col("value").alias("word"))
