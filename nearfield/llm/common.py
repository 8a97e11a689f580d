"""Working storage and column helpers that the operators share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_folder

#: Rows of a batch that goes to Python at most, where the session has the default: texts are long.
BATCH_ROWS = "2000"
_BATCHES = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: Partitions over which the rows of one key are dealt at most.
SALTS = 64

#: Working tables by path: the session, and the table's name where it has one.
_tables: dict[str, tuple[SparkSession, str | None]] = {}


def _path(spark: SparkSession, label: str, name: str | None = None) -> str:
    path = f"{shared_folder(spark)}/nearfield-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex[:12]}"
    _tables[path] = spark, name
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = _path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._nearfield_path = path
    return out


def bucketed(df: DataFrame, key: str, label: str) -> DataFrame:
    """Rows written once into buckets of ``key`` in the shared folder: later joins on it shuffle only the other side."""
    spark = df.sparkSession
    name = f"nearfield_{label}_{uuid.uuid4().hex[:12]}"
    path = _path(spark, label, name)
    df.write.option("compression", "zstd").option("path", path).bucketBy(shards_of(df), key).format("parquet").saveAsTable(name)
    out = spark.table(name)
    out._nearfield_path = path
    return out


def shards_of(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def dropped(*tables: DataFrame) -> None:
    """Working tables that nothing reads any more go."""
    for t in tables:
        _drop(t._nearfield_path)


def _drop(path: str) -> None:
    spark, name = _tables.pop(path)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def working() -> set[str]:
    """The working tables there are."""
    return set(_tables)


def dropped_since(before: set[str], but: DataFrame) -> None:
    """Working tables made since ``before`` was taken go, but for one."""
    for path in set(_tables) - before - {but._nearfield_path}:
        _drop(path)


@atexit.register
def _remove() -> None:
    """Working tables go when the program ends, as far as the session still runs."""
    for path in list(_tables):
        try:
            _drop(path)
        except Exception:  # noqa: BLE001  the JVM may be gone; nothing depends on this
            return


def spread_join(left: DataFrame, right: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``left`` joined with ``right`` (one row a key) on ``keys``, none of them null.

    The rows that one key has in ``left`` are dealt over ``SALTS`` partitions by
    the column ``by``, and ``right`` has a row for each of those: no key, however
    common, is one task's.
    """
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS)).cast("int")
    salted = left.withColumn("_salt", salt)
    seats = salted.groupBy(*keys).agg(F.collect_set("_salt").alias("_seats"))
    return salted.join(right.join(seats, keys).withColumn("_salt", F.explode("_seats")).drop("_seats"), [*keys, "_salt"]).drop("_salt")


def text_of(df: DataFrame, name: str = "text") -> Column:
    """The text column, null as empty."""
    return F.coalesce(df[name].cast("string"), F.lit(""))


def hex_sha(text: Column) -> Column:
    return F.sha2(text, 256)


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """A table.  Texts are long, so a session with the default batch size gets a smaller one, for good: results are computed later."""
    if spark.conf.get(_BATCHES) == "10000":
        spark.conf.set(_BATCHES, BATCH_ROWS)
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
