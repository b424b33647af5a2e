"""Measures of embedding quality: separation of known pairs, agreement of two models, expected clusters."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.analyze.spectrum import moments
from simlake.functions.vectors import dot
from simlake.operators.ranks import evenly_spaced, positions, rank_pick
from simlake.operators.similarity import top_k_between
from simlake.plans.staging import staged

#: Rows against which all others are compared in ``agreement``, spread evenly over the order of ids.
QUERIES = 512


def separation(left: DataFrame, right: DataFrame, pairs: DataFrame, mean: float, std: float) -> DataFrame:
    """One row on known pairs ``l, r`` of ``id, v``: their number, z scores against a background, how many are best, and the margin over the best other."""
    both = pairs.join(left.select(F.col("id").alias("l"), F.col("v").alias("x")), "l").join(right.select(F.col("id").alias("r"), F.col("v").alias("y")), "r")
    scores = staged(both.where("x is not null and y is not null").select("l", "r", dot("x", "y").alias("s")), "known")
    queries = left.join(scores.select(F.col("l").alias("id")).distinct(), "id", "left_semi")
    # the best two suffice: one of them is another than the known one
    best = top_k_between(queries, right, 2).select(F.col("a").alias("l"), "b", "score")
    others = scores.join(best, "l", "left").where("b is null or b != r").groupBy("l", "r").agg(F.max("score").alias("other"))
    rows = scores.join(others, ["l", "r"], "left")
    z = (F.col("s") - F.lit(mean)) / F.lit(std)
    return rows.agg(F.count("*").alias("gt_pairs"), F.avg(z).alias("gt_z_mean"), F.min(z).alias("gt_z_min"), F.avg((F.col("other").isNull() | (F.col("other") < F.col("s"))).cast("int")).alias("gt_top1_rate"), F.avg(F.col("s") - F.col("other")).alias("gt_margin_mean"))


def pair_similarities(aligned: DataFrame, queries: int = QUERIES, by: str = "body_hash") -> DataFrame:
    """``a, b, x, y``: similarities under both models of each pair of a query row with any other; ``aligned`` has ``id, x, y`` and the order ``by``."""
    chosen = evenly_spaced(aligned.select("id", "x", "y", by), by, queries).collect()  # at most ``queries`` rows
    ids = np.array([r["id"] for r in chosen], np.int64)
    xs, ys = (np.array([r[c] for r in chosen], np.float64) for c in ("x", "y"))

    def compared(batches):
        for batch in batches:
            if len(batch):
                own = batch["id"].to_numpy()
                a, b = np.stack(batch["x"].to_numpy()) @ xs.T, np.stack(batch["y"].to_numpy()) @ ys.T
                # two queries meet once
                keep = (own[:, None] != ids[None, :]) & (~np.isin(own, ids)[:, None] | (own[:, None] > ids[None, :]))
                rows, cols = np.nonzero(keep)
                yield pd.DataFrame({"a": ids[cols], "b": own[rows], "x": a[rows, cols], "y": b[rows, cols]})

    return aligned.select("id", "x", "y").mapInPandas(compared, "a bigint, b bigint, x double, y double")


def interpolated(rows: DataFrame, column: str, quantile: float) -> float | None:
    """A quantile by linear interpolation between neighbouring ranks."""
    at = lambda n: (n - 1) * quantile
    low = rank_pick(rows, column, lambda n: int(at(n)))
    if low is None:
        return None
    high = rank_pick(rows, column, lambda n: min(n - 1, int(at(n)) + 1))
    n = rows.where(F.col(column).isNotNull()).count()
    return low + (high - low) * (at(n) - int(at(n)))


def agreement(aligned: DataFrame, recall: float, queries: int = QUERIES) -> dict[str, float]:
    """Cosines and differences of pairwise similarities between two models of the same rows; ``aligned`` has ``id, x, y, cosine``."""
    pairs = staged(pair_similarities(aligned, queries).withColumn("delta", F.abs(F.col("x") - F.col("y"))), "similarities")
    c = aligned.agg(F.avg("cosine").alias("mean"), F.min("cosine").alias("least")).first()
    most = pairs.agg(F.max("delta")).first()[0]
    return {"mean_pooled_cosine": c["mean"], "min_pooled_cosine": c["least"], "p95_pairwise_delta": interpolated(pairs, "delta", 0.95) or 0.0, "max_pairwise_delta": most or 0.0, "top10_recall": recall}


def average_ranks(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The rows with their rank from 1 in the order of a column; equal values share the mean of their ranks."""
    at = staged(positions(rows, column, "_position"), "ranked")
    shared = at.groupBy(F.col(column).alias("_value")).agg((F.avg("_position") + 1).alias(name))
    return at.join(shared, F.col(column) == F.col("_value")).drop("_position", "_value")


def spearman(rows: DataFrame, a: str, b: str) -> float | None:
    """Rank correlation of two columns."""
    return average_ranks(average_ranks(rows.select(a, b), a, "_ra"), b, "_rb").agg(F.corr("_ra", "_rb")).first()[0]


def canonical_correlations(aligned: DataFrame, k: int = 16) -> list[float]:
    """Correlations between the spaces of both models' first k principal scores, from sums of products alone."""
    stacked = aligned.select(F.concat("x", "y").alias("vector"), F.size("x").alias("d"))
    d = stacked.select("d").first()["d"]
    n, total, outer = moments(stacked)
    c = outer - np.outer(total, total) / n

    def whitened(block: np.ndarray) -> np.ndarray:
        values, directions = np.linalg.eigh(block)
        top = np.argsort(-values)[:k]
        top = top[values[top] > 1e-12 * values.max()]
        return directions[:, top] / np.sqrt(values[top])

    p, q = whitened(c[:d, :d]), whitened(c[d:, d:])
    return np.linalg.svd(p.T @ c[:d, d:] @ q, compute_uv=False).tolist()


def expected_clusters(members: DataFrame, expected: DataFrame, fillers: DataFrame) -> DataFrame:
    """One row: clusters, expected pairs ``a, b``, how many share a cluster, and clusters with two of the ``fillers`` (``unit_idx``)."""
    home = members.select("unit_idx", "cluster")
    one, two = (home.select(F.col("unit_idx").alias(n), F.col("cluster").alias("c" + n)) for n in ("a", "b"))
    found = expected.join(one, "a", "left").join(two, "b", "left").agg(F.count("*").alias("expected"), F.count_if(F.col("ca") == F.col("cb")).alias("found"))
    false = home.join(fillers.select("unit_idx").distinct(), "unit_idx", "left_semi").groupBy("cluster").count().where("count > 1").agg(F.count("*").alias("false_filler_groups"))
    # one row each
    return home.agg(F.countDistinct("cluster").alias("clusters")).crossJoin(found).crossJoin(false)
