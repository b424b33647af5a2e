"""Linear algebra over many vectors: sums of products by partition, small eigenproblems on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(vectors: DataFrame, column: str = "vector", origin: np.ndarray | None = None) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, sum and sum of outer products of the vectors, or of their differences from ``origin``; each task hands on one d x d matrix."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, total, outer = 0, None, None
        for batch in batches:
            if len(batch):
                x = np.stack([np.asarray(v, np.float64) for v in batch["v"]])
                if origin is not None:
                    x -= origin
                n += len(x)
                total = x.sum(axis=0) if total is None else total + x.sum(axis=0)
                outer = x.T @ x if outer is None else outer + x.T @ x
        if n:
            yield pd.DataFrame({"i": range(len(outer)), "n": n, "total": total, "row": list(outer)})

    parts = vectors.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).mapInPandas(partial, "i int, n bigint, total double, row array<double>")
    cells = parts.select("i", "n", "total", F.posexplode("row").alias("j", "x"))
    sums = cells.groupBy("i", "j").agg(F.sum("x").alias("x"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    found = sums.toPandas()  # d x d numbers, however many vectors there are
    if not len(found):
        return 0, np.zeros(0), np.zeros((0, 0))
    d = int(found["i"].max()) + 1
    outer, total = np.zeros((d, d)), np.zeros(d)
    outer[found["i"], found["j"]] = found["x"]
    total[found["i"]] = found["total"]
    return int(found["n"].iloc[0]), total, outer


def all_but_the_top(units: DataFrame, components: int) -> DataFrame:
    """Vectors without their mean and main directions, to unit length; a vector that vanishes becomes zero."""
    n, total, outer = moments(units)
    if not n:
        return units
    mean = total / n
    values, directions = np.linalg.eigh(outer / n - np.outer(mean, mean))
    top = directions[:, np.argsort(-values)[:components]]

    def move(v: pd.Series) -> pd.Series:
        def one(x: object) -> np.ndarray | None:
            if x is None:
                return None
            y = np.asarray(x, np.float64) - mean
            y = y - top @ (top.T @ y)
            size = np.sqrt(y @ y)
            return y / size if size > 1e-12 else np.zeros_like(y)

        return v.map(one)

    return units.withColumn("vector", F.pandas_udf(move, "array<double>")("vector"))


def gauge(vectors: DataFrame, column: str = "vector") -> dict[str, float]:
    """Effective rank, energy of the first and first three directions, and the norm of the mean."""
    n, total, outer = moments(vectors, column)
    values = np.clip(np.linalg.eigvalsh(outer / n)[::-1], 0, None)
    share = values / values.sum()
    positive = share[share > 0]
    return {"n": n, "effective_rank": float(np.exp(-(positive * np.log(positive)).sum())), "top1_energy": float(share[0]), "top3_energy": float(share[:3].sum()), "mean_norm": float(np.linalg.norm(total / n))}
