"""Lineage cuts and size-checked broadcasts.

A stage that is read more than once, or that ends a round of an iterative
operator, is written as Parquet below the shared folder that the cluster names
in ``spark.checkpoint.dir``.  Lost executors can read it again, and the planner
knows its size.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a narrow table may be broadcast (about 100 bytes a row, so some 10 MB).
BROADCAST_ROWS = 100_000

_own_base: dict[str, str] = {}
_written: dict[str, list[str]] = {}


def scratch_base(spark: SparkSession) -> str:
    """The shared folder of the session; a local one only where driver and executors are one process and none is configured."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_base:
        _own_base[app] = "file://" + tempfile.mkdtemp(prefix="simlake-")
    return _own_base[app]


def _file(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and return the table read back; it is deleted when the driver ends, if not before."""
    spark = df.sparkSession
    path = f"{scratch_base(spark)}/simlake/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    fs, where = _file(spark, path)
    fs.deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def written(spark: SparkSession) -> list[str]:
    """The tables staged by this session that still exist, in order."""
    return list(_written.get(spark.sparkContext.applicationId, []))


def release(spark: SparkSession, paths: Iterable[str]) -> None:
    """Delete staged tables; results that read them must be written before."""
    left = _written.get(spark.sparkContext.applicationId, [])
    for path in paths:
        fs, where = _file(spark, path)
        fs.delete(where, True)
        if path in left:
            left.remove(path)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """Mark a staged narrow table for broadcast if it has few rows; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
