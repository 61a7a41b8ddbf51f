"""Helpers shared by every operator: tables, checkpoints, size checks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of ``folder``."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder the session names in ``spark.checkpoint.dir``; a temporary one only where it is unset (tests)."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        folder = tempfile.mkdtemp(prefix="tidemill-")
        sc.setCheckpointDir(folder)
    elif sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder)
    return folder


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` cut from its lineage by a reliable checkpoint in the shared folder."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def discard() -> None:
    """Deletes what ``written`` has written so far. Frames read from it can't be used any more; runs by itself at the end of the program."""
    while _WRITTEN:
        spark, path = _WRITTEN.pop()
        try:
            jvm = spark.sparkContext._jvm
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may have ended before
            continue


def written(df: DataFrame) -> DataFrame:
    """``df`` written as compressed Parquet to the shared folder and read back: a checkpoint that prunes columns and takes less disk."""
    path = f"{_checkpoint_folder(df.sparkSession)}/written-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(discard)
    _WRITTEN.append((df.sparkSession, path))
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bounded_rows(df: DataFrame, limit: int, what: str) -> list:
    """Collects ``df``, which must stay within ``limit`` rows whatever the data's size; more raise, none are dropped."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"{what}: more than the documented bound of {limit} rows")
    return rows


def small_or_plain(df: DataFrame, rows: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``rows`` rows, else as it is (shuffle join)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def require(df: DataFrame, *columns: str) -> None:
    """Raises where a needed column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")


def ship(spark: SparkSession) -> None:
    """Makes this package importable on the executors, once a session: the sources travel as one small archive."""
    sc = spark.sparkContext
    if getattr(sc, "_tidemill_shipped", False):
        return
    import os
    import zipfile

    here = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="tidemill-"), "tidemill.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("tidemill", os.path.relpath(path, here)))
    sc.addPyFile(target)
    sc._tidemill_shipped = True
