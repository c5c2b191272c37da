"""Cutting lineage: tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import math
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``.

    Where it is unset a temporary folder is set once, but only on a local master: on a cluster every executor would
    write to a disk of its own.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="lodestrata-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_table(spark: SparkSession, label: str) -> str:
    """A path in the shared folder for a table that goes when the application ends, or with ``release``."""
    path = f"{shared_dir(spark)}/tables/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def append_table(df: DataFrame, path: str) -> None:
    """Add rows to a table of ``new_table``."""
    df.write.mode("append").parquet(path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once and return a reader of the written table.

    Unlike a cache it survives the loss of executors, and unlike ``checkpoint()`` it is columnar, so that later
    readers prune columns.
    """
    path = new_table(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _folder(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder of any file system; none if there is no such folder."""
    system, where = _folder(spark, path)
    return sorted(x.getPath().getName() for x in system.listStatus(where)) if system.exists(where) else []


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, which appears whole or not at all; an existing one is an error."""
    system, where = _folder(spark, path)
    _, half = _folder(spark, f"{path}.{uuid.uuid4().hex}")
    out = system.create(half)
    out.write(bytearray(text.encode()))
    out.close()
    if system.exists(where) or not system.rename(half, where):
        system.delete(half, False)
        raise FileExistsError(path)


def read_text(spark: SparkSession, path: str) -> str:
    system, where = _folder(spark, path)
    stream = system.open(where)
    try:
        return bytes(spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def release(spark: SparkSession | None = None) -> None:
    """Delete all tables written by ``materialize``, or those of one session."""
    for session, path in list(_written):
        if spark is None or session is spark:
            try:
                system, where = _folder(session, path)
                system.delete(where, True)
            except Exception:  # the session may have ended already
                pass
            _written.remove((session, path))


atexit.register(release)


#: A key is heavy if it has at least this share of the rows; so at most 1 / HEAVY_SHARE keys are, which are broadcast.
HEAVY_SHARE = 1 / 2000


def skew_join(big: DataFrame, small: DataFrame, on: list[str], weight: str, total: int, share: float = HEAVY_SHARE) -> DataFrame:
    """Inner equi-join in which ``small`` has one row per key and a key may hold a large part of ``big``.

    ``weight`` is the column of ``small`` with the number of rows of the key in ``big``, ``total`` their sum. The rows
    of heavy keys are joined where they are, with the heavy rows of ``small`` (at most 1 / share) broadcast; all
    others are shuffled by key once, without copies. ``small`` is read three times, so it should be a written table.
    NULL keys match nothing.
    """
    least = max(2, math.ceil(total * share))
    heavy = small.filter(F.col(weight) >= least)
    if not heavy.take(1):
        return big.join(small, on)
    hot = big.join(F.broadcast(heavy), on)
    cool = big.join(F.broadcast(heavy.select(*on)), on, "left_anti").join(small.filter(F.col(weight) < least), on)
    return hot.unionByName(cool)
