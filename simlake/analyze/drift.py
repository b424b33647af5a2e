"""Drift between two embeddings of the same bodies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.analyze.compare import nearest
from simlake.functions.vectors import dot, largest_difference, normalised
from simlake.operators.ranks import evenly_spaced, rank_pick
from simlake.operators.similarity import top_k_between
from simlake.plans.staging import staged


@dataclass(frozen=True)
class DriftReport:
    """What ``drift`` finds."""

    baseline_count: int
    candidate_count: int
    shared: int
    cosine_mean: float
    cosine_p50: float
    cosine_p05: float
    cosine_min: float
    max_abs_component_delta: float
    recall_queries: int
    mean_neighbor_recall: float

    def passes(self, min_cosine: float, min_recall: float) -> bool:
        return self.cosine_min >= min_cosine and self.mean_neighbor_recall >= min_recall


def aligned(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """``id, x, y, cosine, delta`` for the shared ``body_hash``; ids follow the hash."""
    both = baseline.select("body_hash", normalised("vector").alias("x")).join(candidate.select("body_hash", normalised("vector").alias("y")), "body_hash")
    return both.withColumns({"id": F.xxhash64("body_hash"), "cosine": dot("x", "y"), "delta": largest_difference("x", "y")})


def neighbor_recall(shared: DataFrame, k: int, sample: int = 0) -> DataFrame:
    """``id, recall``: the share of each query's k nearest that are nearest in both; evenly spaced queries if sampled."""
    n = shared.count()
    k = min(k, max(0, n - 1))
    queries = evenly_spaced(shared, "id", sample, n)
    found = []
    for column, name in (("x", "near_x"), ("y", "near_y")):
        rows = lambda d, c=column: d.select("id", F.col(c).alias("v"))
        best = top_k_between(rows(queries), rows(shared), k + 1).where("a != b")
        best = best.withColumn("k", F.row_number().over(W.partitionBy("a").orderBy("rank"))).where(F.col("k") <= k)
        found.append(best.groupBy(F.col("a").alias("id")).agg(F.collect_list("b").alias(name)))
    return found[0].join(found[1], "id").select("id", (F.size(F.array_intersect("near_x", "near_y")) / F.lit(float(max(k, 1)))).alias("recall"))


def drift(baseline: DataFrame, candidate: DataFrame, top_k: int = 10, sample: int = 0) -> DriftReport:
    """Compare ``body_hash, vector`` of two models; raises if they differ in length or share nothing."""
    lengths = [d.agg(F.max(F.size("vector"))).first()[0] for d in (baseline, candidate)]
    if lengths[0] != lengths[1]:
        raise ValueError(f"cannot compare {lengths[0]} with {lengths[1]} dimensions: drift needs the same model on both sides")
    shared = staged(aligned(baseline, candidate), "aligned")
    s = shared.agg(F.count("*").alias("n"), F.avg("cosine").alias("mean"), F.min("cosine").alias("least"), F.max("delta").alias("delta")).first()
    if not s["n"]:
        raise ValueError("the two sides share no body hashes to compare")
    recall = neighbor_recall(shared, top_k, sample).agg(F.count("*").alias("n"), F.avg("recall").alias("mean")).first()
    p = lambda q: rank_pick(shared, "cosine", nearest(q))
    return DriftReport(baseline.count(), candidate.count(), s["n"], s["mean"], p(0.5), p(0.05), s["least"], s["delta"], recall["n"], recall["mean"] if recall["n"] else 1.0)
