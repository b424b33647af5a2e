"""Exact vector joins: all pairs above a threshold, and the best k of another set.

Both run on blocks.  Rows are dealt into as many blocks as keep a block within
``block`` rows; a pair of blocks is one task with one matrix product, and only what
reaches the threshold (or the block's best k) leaves it.  Neither side is broadcast.
For a self-join each unordered pair of blocks meets once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.functions.vectors import dot

#: Rows of a block at least; a block holds more where its vectors are short.
BLOCK = 2048
BLOCK_BYTES = 32 << 20


def _blocks(rows: DataFrame, block: int | None) -> int:
    """Blocks that hold ``block`` rows, by default some 32 MB of doubles, but enough for every core while there are ``BLOCK`` rows for each."""
    size = rows.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("d")).first()
    if block is None:
        cores = int(rows.sparkSession.sparkContext.defaultParallelism)
        block = max(BLOCK, min(BLOCK_BYTES // (8 * max(1, size["d"] or 1)), size["n"] // cores))
    return max(1, -(-size["n"] // block))


def _dealt(rows: DataFrame, blocks: int) -> DataFrame:
    return rows.select(F.col("id").cast("long").alias("id"), "v", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block"))


def _matrix(rows: pd.DataFrame) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in rows["v"]])


def _best(scores: np.ndarray, k: int) -> np.ndarray:
    """The columns of each row's k largest scores, best first; among equal ones the smaller column."""
    if k >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    least = -np.partition(-scores, k - 1, axis=1)[:, k - 1 : k]
    # all above the k-th score, and of those equal to it the first that there is room for
    above, equal = scores > least, scores == least
    room = k - above.sum(axis=1, keepdims=True)
    picked = np.nonzero(above | (equal & (equal.cumsum(axis=1) <= room)))[1].reshape(len(scores), k)
    return np.take_along_axis(picked, np.argsort(-np.take_along_axis(scores, picked, axis=1), axis=1, kind="stable"), axis=1)


def similar_pairs(vectors: DataFrame, threshold: float, *, block: int | None = None) -> DataFrame:
    """``a, b, score`` with a < b for all pairs of ``id, v`` whose inner product is at least ``threshold``."""
    known = vectors.where("v is not null").select("id", "v")
    blocks = _blocks(known, block)
    dealt = _dealt(known, blocks)
    left = dealt.select("id", "v", "block", F.col("block").alias("i"), F.explode(F.sequence(F.col("block"), F.lit(blocks - 1))).alias("j"))
    right = dealt.select("id", "v", "block", F.explode(F.sequence(F.lit(0), F.col("block"))).alias("i"), F.col("block").alias("j"))

    def join(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        scores = _matrix(x) @ _matrix(y).T
        rows, cols = np.nonzero(scores >= threshold)
        a, b = x["id"].to_numpy()[rows], y["id"].to_numpy()[cols]
        keep = a < b if x["block"].iloc[0] == y["block"].iloc[0] else np.full(len(a), True)
        a, b, s = a[keep], b[keep], scores[rows, cols][keep]
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b), "score": s})

    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInPandas(join, "a bigint, b bigint, score double")


def similar_pairs_sql(vectors: DataFrame, threshold: float) -> DataFrame:
    """The same by a nested-loop join of array expressions: for small sets and as a check."""
    a = vectors.select(F.col("id").alias("a"), F.col("v").alias("va"))
    b = vectors.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return a.join(b, F.col("a") < F.col("b")).withColumn("score", dot("va", "vb")).where(F.col("score") >= threshold).select("a", "b", "score")


def top_k_between(left: DataFrame, right: DataFrame, k: int, threshold: float = -1.0, *, block: int | None = None) -> DataFrame:
    """``a, b, score, rank``: for each row of ``left`` its best k of ``right`` (ties: smaller b), at least ``threshold``."""
    x, y = left.where("v is not null"), right.where("v is not null")
    n, m = _blocks(x, block), _blocks(y, block)
    xs = _dealt(x, n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumnRenamed("block", "i")
    ys = _dealt(y, m).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnRenamed("block", "j")

    def best(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "score": []})
        q = q.sort_values("id", kind="stable")
        scores, ids = _matrix(p) @ _matrix(q).T, q["id"].to_numpy()
        order = _best(scores, k)
        a = np.repeat(p["id"].to_numpy(), order.shape[1])
        s = np.take_along_axis(scores, order, axis=1).reshape(-1)
        found = pd.DataFrame({"a": a, "b": ids[order].reshape(-1), "score": s})
        return found[found["score"] >= threshold]

    found = xs.groupBy("i", "j").cogroup(ys.groupBy("i", "j")).applyInPandas(best, "a bigint, b bigint, score double")
    rank = F.row_number().over(W.partitionBy("a").orderBy(F.desc("score"), "b"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def top_k_both(left: DataFrame, right: DataFrame, k: int, threshold: float = -1.0, *, block: int | None = None) -> DataFrame:
    """``a, b, score``: the pairs of rows of which one is among the best k of the other (ties: smaller id), once each, from one product of each pair of blocks."""
    x, y = left.where("v is not null"), right.where("v is not null")
    n, m = _blocks(x, block), _blocks(y, block)
    xs = _dealt(x, n).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(m - 1)))).withColumnRenamed("block", "i")
    ys = _dealt(y, m).withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumnRenamed("block", "j")

    def best(rows: pd.DataFrame) -> pd.DataFrame:
        p, q = rows[rows["of_left"]], rows[~rows["of_left"]]
        if not len(p) or not len(q):
            return pd.DataFrame({"a": [], "b": [], "score": [], "of_left": []})
        p, q = p.sort_values("id", kind="stable"), q.sort_values("id", kind="stable")
        scores, a, b = _matrix(p) @ _matrix(q).T, p["id"].to_numpy(), q["id"].to_numpy()
        forth, back = _best(scores, k), _best(scores.T, k)
        rows = np.concatenate([np.repeat(np.arange(len(a)), forth.shape[1]), back.reshape(-1)])
        cols = np.concatenate([forth.reshape(-1), np.repeat(np.arange(len(b)), back.shape[1])])
        found = pd.DataFrame({"a": a[rows], "b": b[cols], "score": scores[rows, cols], "of_left": np.arange(len(rows)) < forth.size})
        return found[found["score"] >= threshold]

    # one table with both sides: the two may have the same source
    sides = xs.withColumn("of_left", F.lit(True)).unionByName(ys.withColumn("of_left", F.lit(False)))
    found = sides.groupBy("i", "j").applyInPandas(best, "a bigint, b bigint, score double, of_left boolean")
    own, other = F.when(F.col("of_left"), F.col("a")).otherwise(F.col("b")), F.when(F.col("of_left"), F.col("b")).otherwise(F.col("a"))
    rank = F.row_number().over(W.partitionBy("of_left", own).orderBy(F.desc("score"), other))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).groupBy("a", "b").agg(F.max("score").alias("score"))


def expand_copies(pairs: DataFrame, units: DataFrame, score_within: DataFrame | None = None) -> DataFrame:
    """Pairs of bodies (``a, b, score`` by body hash id) to pairs of units; ``units`` has ``id, body``."""
    left = units.select(F.col("id").alias("ua"), F.col("body").alias("a"))
    right = units.select(F.col("id").alias("ub"), F.col("body").alias("b"))
    across = pairs.join(left, "a").join(right, "b").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b"), "score")
    if score_within is None:
        return across
    same = left.join(right.withColumnRenamed("b", "a"), "a").where("ua < ub").join(score_within, "a")
    return across.unionByName(same.select(F.col("ua").alias("a"), F.col("ub").alias("b"), "score"))
