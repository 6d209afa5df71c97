"""Cutting lineage by written tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_staged: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or in a local run a folder of our own where it is unset."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            at = held.get()
        elif spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        else:
            at = "file://" + tempfile.mkdtemp(prefix="tessera-")
            _staged.add(at)
            spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def fresh_dir(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it goes when the driver ends or cleanup() is called."""
    path = f"{shared_dir(spark)}/tessera-{uuid.uuid4().hex}-{name}"
    _staged.add(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, which survives lost executors and gives the planner real sizes."""
    path = fresh_dir(df.sparkSession, name)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._staged = path
    return table


def drop(*tables: DataFrame) -> None:
    """Delete tables that stage() gave; nothing may read them any more."""
    cleanup(*[t._staged for t in tables])


def cleanup(*paths: str) -> None:
    """Delete staged tables (all of this session where none is named); results that read them must be done."""
    spark = SparkSession.getActiveSession()
    if spark is None:
        return
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths or tuple(_staged):
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _staged.discard(path)


@atexit.register
def _at_exit() -> None:
    try:
        cleanup()
    except Exception:  # noqa: BLE001  the JVM may be gone by now
        pass
