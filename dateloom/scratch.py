"""Scratch tables in the folder that driver and executors share, ``spark.checkpoint.dir``.

A folder of our own is set only where a session has none (local runs and tests).
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_scratch: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``; where it is unset, a folder of our own, for local masters only."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("dateloom.checkpoint.dir", "")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="dateloom-")
        spark.conf.set("dateloom.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder; ``release`` deletes it."""
    path = f"{shared_root(spark)}/dateloom/{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex[:12]}"
    _scratch.append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that lost executors cost no recomputation."""
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Queries that run within delete their shuffle files when they end, not when the driver next collects garbage.

    The setting is the session's and returns to what it was; Spark before 4.1 does not know it and leaves the files for later.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(name)
        else:
            spark.conf.set(name, before)


def scratch_mark() -> int:
    """How many scratch tables there are now, for ``release``."""
    return len(_scratch)


def release(spark: SparkSession, since: int = 0, keep: list[str] | None = None) -> None:
    """Delete the scratch tables made since ``scratch_mark``, but for ``keep``. Call it when no DataFrame still reads them."""
    kept = [p for p in _scratch[since:] if p in (keep or [])]
    for path in _scratch[since:]:
        if path not in kept:
            delete_path(spark, path)
    _scratch[since:] = kept


def finish(df: DataFrame, tag: str, since: int) -> DataFrame:
    """``df`` written to the shared folder, and all scratch tables made since ``scratch_mark`` but that one deleted."""
    out = materialize(df, tag)
    release(df.sparkSession, since, keep=_scratch[-1:])
    return out
