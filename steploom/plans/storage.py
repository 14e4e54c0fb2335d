"""Shared, fault-tolerant storage for intermediate results.

Iterative operators cut their lineage by writing a Parquet table into the folder that the
cluster names in ``spark.checkpoint.dir``; every executor can read it back, so a lost executor
costs a re-read and never a recomputation of the whole history. Only where the setting is
missing on a local master (unit tests, a laptop) is a private folder made.
"""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_private: str | None = None
_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder, or a private one on a local master without one.

    Off a local master the setting is needed: a folder of one machine can't be read by the others.
    """
    global _private
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    master = spark.conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _private is None:
        _private = tempfile.mkdtemp(prefix="steploom-")
        atexit.register(shutil.rmtree, _private, ignore_errors=True)
    return f"file://{_private}"


def is_stored(spark: SparkSession, path: str) -> bool:
    """Whether there is a file or folder of that name."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target)


def drop_stored(spark: SparkSession, path: str) -> None:
    """Deletes a table that :func:`store` wrote."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def store_path(df: DataFrame, label: str) -> str:
    """Writes ``df`` as Parquet below the shared folder and returns the path."""
    path = f"{shared_dir(df.sparkSession)}/steploom/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return path


def clear_stored(spark: SparkSession) -> int:
    """Deletes every table this driver has stored so far, once the results that read them are written; gives their number.

    A result that hasn't been written yet can't be read afterwards.
    """
    paths = [_written.pop() for _ in range(len(_written))]
    for path in paths:
        drop_stored(spark, path)
    return len(paths)


def store(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """``df`` written once and read back: a cut lineage.

    With ``release`` the shuffle files of the way here are given up at once. Spark deletes them when
    the driver collects its garbage, which a driver with little to do may not do for long.
    """
    path = store_path(df, label)
    if release:
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def superseded(df: DataFrame) -> None:
    """Deletes the table behind ``df``, a result of :func:`store` that nothing will read again."""
    for file in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        drop_stored(df.sparkSession, file)


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Size on disk of a stored table."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(target).getLength()
