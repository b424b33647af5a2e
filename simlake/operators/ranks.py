"""Order statistics and positions in a global order, without a task that sorts everything."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.plans.staging import staged

#: Bins of one narrowing step, and values that are looked at one by one.
BINS, LEAF = 1024, 4096


def rank_pick(rows: DataFrame, column: str, index: Callable[[int], int]) -> float | None:
    """The element at position ``index(n)`` of the sorted non-null values; None without any.

    The interval that holds it is narrowed by histograms, each of at most ``BINS`` rows.
    """
    x = rows.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("x"))
    all_ = x.agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.count("*").alias("n")).first()
    lo, hi, n = all_["lo"], all_["hi"], all_["n"]
    if not n:
        return None
    at = index(n)
    while n > LEAF and lo < hi:
        bin_ = F.least(F.floor((F.col("x") - lo) / (hi - lo) * BINS), F.lit(BINS - 1))
        for b in x.where(F.col("x").between(lo, hi)).groupBy(bin_.alias("bin")).agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")).orderBy("bin").collect():
            if at < b["n"]:
                lo, hi, n = b["lo"], b["hi"], b["n"]
                break
            at -= b["n"]
    if lo == hi:
        return lo
    return sorted(r["x"] for r in x.where(F.col("x").between(lo, hi)).collect())[at]


def positions(rows: DataFrame, by: str, name: str) -> DataFrame:
    """The rows with their position (from 0) in the order of ``by``: ranges of it are numbered apart and then offset."""
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = staged(rows.repartitionByRange(ranges, by).withColumn("_part", F.spark_partition_id()), "ranges")
    offsets, total = [], 0
    for r in parts.groupBy("_part").agg(F.count("*").alias("n")).orderBy("_part").collect():  # one row for each range
        offsets.append((r["_part"], total))
        total += r["n"]
    first = rows.sparkSession.createDataFrame(offsets, "_part int, _first bigint")
    own = F.row_number().over(W.partitionBy("_part").orderBy(by)) - 1
    return parts.withColumn("_own", own).join(F.broadcast(first), "_part").withColumn(name, F.col("_own") + F.col("_first")).drop("_part", "_own", "_first")


def evenly_spaced(rows: DataFrame, by: str, wanted: int, n: int | None = None) -> DataFrame:
    """``wanted`` rows spread evenly over the order of ``by``; all of them if there are no more."""
    n = rows.count() if n is None else n
    if not 0 < wanted < n:
        return rows
    return positions(rows, by, "_at").where(F.col("_at").isin(*(i * n // wanted for i in range(wanted)))).drop("_at")

