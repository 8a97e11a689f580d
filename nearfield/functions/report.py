"""What a report of sweeps needs: rows read, named, put in order, and written as a table."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns that rows of a report are ordered by, as far as they are there.
ORDER = ("timestamp", "dataset", "name", "clique", "beam", "method")


def label(key: Column, names: dict[str, str]) -> Column:
    """The name of a key; the key itself where it has none."""
    if not names:
        return key
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in names.items() for x in kv]), key), key)


def local_time(seconds: Column, pattern: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """Seconds since 1970 as text in the session's time zone."""
    return F.from_unixtime(seconds.cast("long"), pattern)


def in_order(rows: DataFrame, by: tuple[str, ...] = ORDER) -> DataFrame:
    """Rows ordered by those of the columns that they have."""
    have = [c for c in by if c in rows.columns]
    return rows.orderBy(*have) if have else rows


def present(rows: DataFrame, wanted: tuple[str, ...]) -> DataFrame:
    """The wanted columns that are there, in the order wanted."""
    return rows.select(*[c for c in wanted if c in rows.columns])


def keys(rows: DataFrame, column: str) -> DataFrame:
    """The distinct values of a column that are not null, sorted."""
    return rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column)


def read_sweep(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a sweep's CSV files, oldest first where they have times; a path that holds none gives no rows."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "timestamp long")
    return in_order(spark.read.csv(path, header=True, inferSchema=True), ("timestamp",))


def markdown(rows: DataFrame) -> str:
    """A small report as a table in Markdown; its rows come to the driver."""
    line = lambda cells: "| " + " | ".join("" if c is None else str(c) for c in cells) + " |"
    return "\n".join([line(rows.columns), "|" + "-|" * len(rows.columns), *[line(r) for r in rows.collect()]])


def write_markdown(rows: DataFrame, path: str) -> None:
    Path(path).write_text(markdown(rows) + "\n")
