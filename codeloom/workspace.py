"""Where intermediate tables go."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, unless the session has a limit of its own.
BATCH_BYTES = 8 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
_SPARKS_DEFAULT = ("67108864b", "64MB")


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local session that names none gets a temporary folder of its own.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if base:
        return base.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    base = tempfile.mkdtemp(prefix="codeloom-")
    sc.setCheckpointDir(base)
    return sc.getCheckpointDir().rstrip("/")


_MADE: dict[str, list[str]] = {}


def fresh_dir(spark: SparkSession, label: str, keep: bool = False) -> str:
    """A new, unused path below the shared folder. ``clear`` removes it unless it is to be kept."""
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if not keep:
        _MADE.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of any file system that Spark reaches; none there is fine."""
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def folder_names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder of any file system that Spark reaches; none if it is not there."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return sorted(f.getPath().getName() for f in fs.listStatus(place)) if fs.exists(place) else []


def clear(spark: SparkSession) -> None:
    """Delete all folders made so far in this application. Call it when the results that
    read them have been written or collected.
    """
    paths = _MADE.pop(spark.sparkContext.applicationId, [])
    for path in paths:
        remove(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, cutting the lineage."""
    spark = df.sparkSession
    path = fresh_dir(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Let a session that has not chosen a limit send Arrow batches of ``BATCH_BYTES``: each
    task holds a few of them, in Spark and in Python."""
    if spark.conf.get(_BATCH_CONF, _SPARKS_DEFAULT[0]) in _SPARKS_DEFAULT:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))
