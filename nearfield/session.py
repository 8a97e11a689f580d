"""What the library needs of a session."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_stored: list[tuple[SparkSession, str]] = []


def ship(spark: SparkSession) -> SparkSession:
    """Makes the package known to the session's Python workers, once a session.

    Nothing is needed where PYTHONPATH has it.  Workers on the driver's machine
    get its folder in theirs; others get the package itself.
    """
    root = Path(__file__).resolve().parent
    app = spark.sparkContext.applicationId
    if app in _shipped or str(root.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    _shipped.add(app)
    if spark.sparkContext.master.startswith("local["):
        have = spark.sparkContext.environment.get("PYTHONPATH", "")
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [str(root.parent), have]))
        return spark
    top = Path(tempfile.mkdtemp(prefix="nearfield-"))
    atexit.register(shutil.rmtree, top, ignore_errors=True)
    shutil.copytree(root, top / "tree" / root.name, ignore=shutil.ignore_patterns("__pycache__"))
    spark.sparkContext.addPyFile(shutil.make_archive(str(top / "nearfield_package"), "zip", top / "tree"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine, as in tests, gets a new
    folder, removed at exit; a cluster must name one that all its machines see.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all machines of the cluster share")
        top = tempfile.mkdtemp(prefix="nearfield-")
        atexit.register(shutil.rmtree, top, ignore_errors=True)
        folder = "file://" + top
        spark.conf.set("spark.checkpoint.dir", folder)
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def ensure_checkpoints(spark: SparkSession) -> None:
    """Sees to it that the session has a checkpoint folder."""
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def stored(df: DataFrame) -> DataFrame:
    """The rows written to the shared folder and read back: lineage ends there, and joins know their real size."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/nearfield-{spark.sparkContext.applicationId}/rows-{uuid.uuid4().hex[:12]}"
    _stored.append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@atexit.register
def _remove() -> None:
    """Stored rows go when the program ends, as far as the session still runs."""
    for spark, path in _stored:
        try:
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:  # noqa: BLE001  the JVM may be gone; nothing depends on this
            return
