"""Concerns: units projected onto named queries, with the spread of those that are kept."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.analyze.duplicates import directory_entropy, nearest_distance
from simlake.functions import paths as P
from simlake.functions.vectors import dot
from simlake.plans.staging import staged

#: Queries are named by hand; more than this are not a concern list.
MOST_QUERIES = 10_000


def project(units: DataFrame, queries: Sequence[tuple[str, Sequence[float]]], min_projection: float = 0.45, top: int = 50) -> DataFrame:
    """``concern, unit_idx, projection, rank``: the best units of each query (name, unit vector)."""
    if len(queries) > MOST_QUERIES:
        raise ValueError(f"more than {MOST_QUERIES} concern queries")
    spark = units.sparkSession
    named = F.broadcast(spark.createDataFrame([(n, [float(x) for x in v]) for n, v in queries], "concern string, q array<double>"))  # at most MOST_QUERIES rows
    rows = units.where("vector is not null").select("unit_idx", "vector").join(named, F.lit(True)).select("concern", "unit_idx", dot("vector", "q").alias("projection"))
    rank = F.row_number().over(W.partitionBy("concern").orderBy(F.desc("projection"), "unit_idx"))
    return rows.where(F.col("projection") >= min_projection).withColumn("rank", rank).where(F.col("rank") <= top)


def spread(kept: DataFrame, units: DataFrame, key: str = "concern") -> DataFrame:
    """Files, directories, modules, entropy and dispersion of each concern's kept units."""
    rows = staged(kept.select(key, "unit_idx").join(units.select("unit_idx", "project", "relative_path"), "unit_idx"), "kept")
    files: Column = F.countDistinct(P.location())
    base = rows.groupBy(key).agg(files.alias("files"), F.countDistinct(P.directory_of("relative_path")).alias("directories"), F.countDistinct(P.top_level_module("relative_path")).alias("top_level_modules"))
    return base.join(directory_entropy(rows, key), key).join(nearest_distance(rows, key), key)
