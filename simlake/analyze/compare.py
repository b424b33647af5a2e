"""Asymmetric comparison of two projects in seven classes.

The classes look like successive steps, but their groups are disjoint: a right unit
has one best left, a left unit one best right.  So splits, merges, strong and possible
matches, missing and new units are aggregates and anti-joins, in any order of rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.analyze.duplicates import side
from simlake.analyze.spectrum import moments
from simlake.functions import paths as P
from simlake.functions.vectors import dot
from simlake.operators.index import ExactBlocks, SimilarityIndex
from simlake.operators.ranks import positions, rank_pick
from simlake.plans.staging import staged

CLASSES = ("exact_copy", "strong_match", "possible_match", "split", "merge", "missing_in_right", "new_in_right")
#: Calibration applies only over at least this range of scores.
LEAST_RANGE = 0.05


@dataclass(frozen=True)
class CompareConfig:
    """Thresholds of the comparison."""

    candidate_threshold: float = 0.78
    match_threshold: float = 0.86
    top_k_per_unit: int = 5
    min_body_node_count: int = 0
    use_name_hints: bool = True
    use_path_hints: bool = True
    max_right_candidate_fanout: int = 0
    calibration: str = "none"
    #: Pairs drawn for the background; None takes all of them.
    calibration_sample_pairs: int | None = 4096
    calibration_anchor: str = "hybrid"
    min_same_name_anchors: int = 3
    candidate_sigma_floor: float = 2.0
    match_sigma_floor: float = 4.0
    strong_min_margin_sigma: float = 0.0
    abtt_components: int = 0
    block_size: int | None = None


# fixed values: a 64-bit linear congruential generator and its first state
_MULTIPLIER, _INCREMENT, _SEED, _MASK = 6364136223846793005, 1442695040888963407, 0x9E3779B97F4A7C15, (1 << 64) - 1
#: Pairs drawn by one row of the distributed sampler.
DRAWS = 4096


def _steps(state: int, n: int, m: int, wanted: int) -> Iterator[tuple[int, int]]:
    """Pairs of positions in n x m that the generator draws from a state on."""
    for _ in range(wanted):
        state = (state * _MULTIPLIER + _INCREMENT) & _MASK
        i = (state >> 33) % n
        state = (state * _MULTIPLIER + _INCREMENT) & _MASK
        yield i, (state >> 33) % m


def _jumped(steps: int) -> tuple[int, int]:
    """Multiplier and increment of so many steps at once."""
    a, c, factor, add = 1, 0, _MULTIPLIER, _INCREMENT
    while steps:
        if steps & 1:
            a, c = a * factor & _MASK, (c * factor + add) & _MASK
        factor, add = factor * factor & _MASK, add * (factor + 1) & _MASK
        steps >>= 1
    return a, c


def sampled_pairs(spark: SparkSession, n: int, m: int, wanted: int) -> DataFrame:
    """``i, j``: pairs of positions in n x m; each row of the driver's list stands for ``DRAWS`` of them."""
    a, c = _jumped(2 * DRAWS)
    state, starts = _SEED ^ (n * m), []
    for at in range(0, wanted, DRAWS):
        starts.append((f"{state:x}", min(DRAWS, wanted - at)))
        state = (state * a + c) & _MASK

    def drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for first, k in batch.itertuples(index=False, name=None):
                yield pd.DataFrame(list(_steps(int(first, 16), n, m, k)), columns=["i", "j"])

    return spark.createDataFrame(starts, "state string, k int").mapInPandas(drawn, "i bigint, j bigint")


def _background(left: DataFrame, right: DataFrame, wanted: int) -> DataFrame:
    """Scores of the whole cross product where it is within the sample, else of sampled pairs."""
    n, m = left.count(), right.count()
    if n * m <= wanted:
        # the product has at most ``wanted`` rows
        return left.select(F.col("v").alias("x")).crossJoin(right.select(F.col("v").alias("y"))).select(dot("x", "y").alias("score"))
    pairs = sampled_pairs(left.sparkSession, n, m, wanted)
    x, y = positions(left, "id", "i").select("i", F.col("v").alias("x")), positions(right, "id", "j").select("j", F.col("v").alias("y"))
    return pairs.join(x, "i").join(y, "j").select(dot("x", "y").alias("score"))


def whole_background(left: DataFrame, right: DataFrame) -> tuple[int, float | None, float | None]:
    """Number, mean and deviation of the scores of the whole cross product, from the moments of either side.

    With means a, b and covariances A, B the mean is ab and the variance bAb + aBa + tr(AB).  A side's
    moments are taken about one of its vectors, so nothing is lost where they lie close together.
    """
    sides = []
    for rows in (left, right):
        first = rows.select("v").first()
        if first is None:
            return 0, None, None
        origin = np.asarray(first["v"], np.float64)
        n, total, outer = moments(rows, "v", origin)
        sides.append((n, origin + total / n, outer / n - np.outer(total / n, total / n)))
    (n, a, spread_a), (m, b, spread_b) = sides
    variance = b @ spread_a @ b + a @ spread_b @ a + (spread_a * spread_b).sum()
    return n * m, float(a @ b), float(np.sqrt(np.maximum(variance, 0.0)))


def unique_names(units: DataFrame) -> DataFrame:
    """``id, v, key`` of units whose lower-case name, kind and language occur once."""
    key = F.struct(F.lower("name").alias("name"), "kind", "language")
    once = units.withColumn("key", key).groupBy("key").agg(F.count("*").alias("n"), F.first("unit_idx").alias("id"), F.first("vector").alias("v"))
    return once.where("n = 1").select("key", "id", "v")


def nearest(quantile: float) -> Callable[[int], int]:
    """The position of a quantile among n sorted values, by nearest rank."""
    return lambda n: int((n - 1) * quantile + 0.5)


def same_name_anchor(left: DataFrame, right: DataFrame) -> tuple[float | None, int]:
    """Upper median of the scores of unambiguous namesakes, and their number."""
    pairs = unique_names(left).select("key", F.col("v").alias("x")).join(unique_names(right).select("key", F.col("v").alias("y")), "key")
    scores = staged(pairs.where("x is not null and y is not null").select(dot("x", "y").alias("score")), "namesakes")
    return rank_pick(scores, "score", lambda n: n // 2), scores.count()


def calibrate(left: DataFrame, right: DataFrame, top: DataFrame, config: CompareConfig) -> dict | None:
    """Thresholds from the background's mean and deviation and an anchor; None without vectors."""
    x, y = (d.where("vector is not null").select(F.col("unit_idx").alias("id"), F.col("vector").alias("v")) for d in (left, right))
    if config.calibration_sample_pairs is None:
        pairs, mean, std = whole_background(x, y)
    else:
        pairs, mean, std = _background(x, y, config.calibration_sample_pairs).agg(F.count("*"), F.avg("score"), F.stddev_pop("score")).first()
    top1 = rank_pick(top.where("rank = 1"), "score", nearest(0.95))
    if not pairs or top1 is None:
        return None
    named, count = same_name_anchor(left, right)
    trusted = named if named is not None and count >= config.min_same_name_anchors else None
    by_name = trusted is not None and (config.calibration_anchor == "same_name" or (config.calibration_anchor == "hybrid" and trusted > top1))
    anchor = trusted if by_name else top1
    span = anchor - mean
    applied = span >= LEAST_RANGE
    floors = mean + config.candidate_sigma_floor * std, mean + config.match_sigma_floor * std
    candidate, match = config.candidate_threshold, config.match_threshold
    base = (candidate, match)
    if applied:
        base = (mean + candidate * span, mean + match * span)
        candidate = max(base[0], floors[0])
        match = max(base[1], floors[1], candidate)
    return {
        "applied": applied, "sampled_pairs": pairs, "background_mean": mean, "background_std": std, "top1_anchor": top1, "same_name_anchor": named, "same_name_count": count,
        "anchor_source": "same_name" if by_name else "top1_p95", "effective_anchor": anchor, "candidate_floor": floors[0], "match_floor": floors[1],
        "candidate_floored": applied and candidate > base[0], "match_floored": applied and match > base[1], "margin_required": config.strong_min_margin_sigma * std if applied else 0.0,
        "effective_candidate_threshold": candidate, "effective_match_threshold": match,
    }


def exact_matches(left: DataFrame, right: DataFrame) -> DataFrame:
    """``left, right`` (arrays): each left unit with all right units of the same body."""
    rights = right.groupBy("body_hash").agg(F.sort_array(F.collect_list("unit_idx")).alias("right"))
    return left.join(rights, "body_hash").select(F.array("unit_idx").alias("left"), "right")


def candidate_edges(left: DataFrame, right: DataFrame, config: CompareConfig, threshold: float, top: DataFrame | None = None, index: SimilarityIndex | None = None) -> DataFrame:
    """``l, r, raw, hint``: the best of either direction, each edge once."""
    x, y = (d.select(F.col("unit_idx").alias("id"), F.col("vector").alias("v")) for d in (left, right))
    index = index or ExactBlocks(config.block_size)
    if top is None:
        edges = index.top_k_both(x, y, config.top_k_per_unit, threshold).select(F.col("a").alias("l"), F.col("b").alias("r"), F.col("score").alias("raw"))
    else:
        # one direction is known
        back = index.top_k_between(y, x, config.top_k_per_unit, threshold)
        both = top.where(F.col("score") >= threshold).select(F.col("a").alias("l"), F.col("b").alias("r"), "score").unionByName(back.select(F.col("b").alias("l"), F.col("a").alias("r"), "score"))
        edges = both.groupBy("l", "r").agg(F.max("score").alias("raw"))
    one, a = side(left, "l", ["name", "relative_path"])
    two, b = side(right, "r", ["name", "relative_path"])
    hint = P.hint_bonus(a, b, config.use_name_hints, config.use_path_hints)
    return edges.join(one, "l").join(two, "r").select("l", "r", "raw", hint.alias("hint"))


def best_edges(edges: DataFrame, own: str, other: str) -> DataFrame:
    """For each ``own`` its edge of the highest raw + hint (ties: smaller other), with the margin of raw scores."""
    mine = W.partitionBy(own)
    ranked = edges.withColumns({"k": F.row_number().over(mine.orderBy(F.desc(F.col("raw") + F.col("hint")), other)), "by_raw": F.row_number().over(mine.orderBy(F.desc("raw")))})
    second = F.max(F.when(F.col("by_raw") == 2, F.col("raw"))).over(mine)
    margin = F.coalesce(F.max("raw").over(mine) - second, F.lit(float("inf")))
    return ranked.withColumn("margin", margin).where("k = 1").drop("k", "by_raw")


def classify(left: DataFrame, right: DataFrame, edges: DataFrame, exact: DataFrame, config: CompareConfig, match: float, margin: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Match records ``class, score, hint, left, right`` and suppressed right units ``right, fanout``."""
    edges = staged(edges, "edges")
    best_right = best_edges(edges, "l", "r").withColumnRenamed("margin", "margin_l")
    best_left = best_edges(edges, "r", "l").withColumnRenamed("margin", "margin_r")
    fanout = best_right.groupBy(F.col("r").alias("right")).agg(F.count("*").alias("fanout"))
    if config.max_right_candidate_fanout > 0:
        suppressed = staged(fanout.where(F.col("fanout") > config.max_right_candidate_fanout), "suppressed")
        gone = suppressed.select(F.col("right").alias("r"))
        best_right, best_left = (best.join(gone, "r", "left_anti") for best in (best_right, best_left))
    else:
        suppressed = edges.sparkSession.createDataFrame([], fanout.schema)
    both = best_right.select(F.lit("l").alias("side"), "l", "r", "raw", "hint", F.col("margin_l").alias("margin")).unionByName(best_left.select(F.lit("r").alias("side"), "l", "r", "raw", "hint", F.col("margin_r").alias("margin")))
    both = staged(both, "best")
    best_right, best_left = (both.where(F.col("side") == s).drop("side").withColumnRenamed("margin", f"margin_{s}") for s in ("l", "r"))

    def record(rows: DataFrame, name: str) -> DataFrame:
        return rows.select(F.lit(name).alias("class"), "score", "hint", "left", "right")

    top = F.max(F.struct("raw", F.col("o").alias("o"), "hint"))
    claims = best_left.where(F.col("raw") >= match).withColumn("o", -F.col("r"))
    splits = claims.groupBy("l").agg(F.sort_array(F.collect_list("r")).alias("right"), top.alias("top")).where(F.size("right") >= 2)
    splits = splits.select("l", F.array("l").alias("left"), "right", F.col("top.raw").alias("score"), F.col("top.hint").alias("hint"))
    split_right = splits.select(F.explode("right").alias("r"))
    open_left = best_right.where(F.col("raw") >= match).join(splits, "l", "left_anti").join(split_right, "r", "left_anti").withColumn("o", -F.col("l"))
    merges = open_left.groupBy("r").agg(F.sort_array(F.collect_list("l")).alias("left"), top.alias("top")).where(F.size("left") >= 2)
    merges = staged(merges.select("r", "left", F.array("r").alias("right"), F.col("top.raw").alias("score"), F.col("top.hint").alias("hint")), "merges")
    used_left = splits.select("l").unionByName(merges.select(F.explode("left").alias("l")))
    used_right = split_right.unionByName(merges.select("r"))
    mutual = best_right.join(best_left.select("l", "r", "margin_r"), ["l", "r"]).where((F.col("raw") >= match) & (F.col("margin_l") >= margin) & (F.col("margin_r") >= margin))
    strong = mutual.join(used_left, "l", "left_anti").join(used_right, "r", "left_anti")
    strong = strong.select("l", "r", F.array("l").alias("left"), F.array("r").alias("right"), F.col("raw").alias("score"), "hint")
    matched_left = used_left.unionByName(strong.select("l"))
    possible = best_right.join(matched_left, "l", "left_anti").select(F.array("l").alias("left"), F.array("r").alias("right"), F.col("raw").alias("score"), "hint")
    whole = exact.select("left", "right", F.lit(1.0).alias("score"), F.lit(0.0).alias("hint"))
    found = [record(whole, "exact_copy"), record(splits, "split"), record(merges, "merge"), record(strong, "strong_match"), record(possible, "possible_match")]
    records = found[0]
    for more in found[1:]:
        records = records.unionByName(more)
    records = staged(records, "records")
    none = F.array().cast("array<bigint>")
    missing = left.select("unit_idx").join(records.select(F.explode("left").alias("unit_idx")), "unit_idx", "left_anti").select(F.lit(0.0).alias("score"), F.lit(0.0).alias("hint"), F.array("unit_idx").alias("left"), none.alias("right"))
    new = right.select("unit_idx").join(records.select(F.explode("right").alias("unit_idx")), "unit_idx", "left_anti").select(F.lit(0.0).alias("score"), F.lit(0.0).alias("hint"), none.alias("left"), F.array("unit_idx").alias("right"))
    return records.unionByName(record(missing, "missing_in_right")).unionByName(record(new, "new_in_right")), suppressed.orderBy(F.desc("fanout"), "right")


def class_order() -> F.Column:
    return F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))


def class_counts(records: DataFrame) -> DataFrame:
    """``class, n`` for all seven classes."""
    spark = records.sparkSession
    names = spark.createDataFrame([Row(**{"class": c}) for c in CLASSES])
    return names.join(records.groupBy("class").agg(F.count("*").alias("n")), "class", "left").na.fill(0, ["n"])


def coverage(records: DataFrame, left: DataFrame) -> DataFrame:
    """``by, group, total_left, covered, possible, missing``: by directory and by language in one pass."""
    kinds = records.select("class", F.explode("left").alias("unit_idx"))
    rows = left.select("unit_idx", P.directory_of("relative_path").alias("directory"), "language").join(kinds, "unit_idx", "left")
    keys = F.explode(F.array(F.struct(F.lit("directory").alias("by"), F.col("directory").alias("group")), F.struct(F.lit("language").alias("by"), F.col("language").alias("group")))).alias("k")
    is_covered = F.col("class").isin("exact_copy", "strong_match", "split", "merge")
    counts = rows.select(keys, "class").groupBy("k.by", "k.group")
    return counts.agg(F.count("*").alias("total_left"), F.count_if(is_covered).alias("covered"), F.count_if(F.col("class") == "possible_match").alias("possible"), F.count_if(~F.coalesce(is_covered | (F.col("class") == "possible_match"), F.lit(False))).alias("missing"))


def compare(units: DataFrame, left_label: str, right_label: str, config: CompareConfig = CompareConfig(), index: SimilarityIndex | None = None) -> dict[str, object]:
    """``records``, ``suppressed``, ``counts``, ``coverage`` and the ``calibration`` of two projects of ``units``."""
    if left_label == right_label:
        raise ValueError("the two projects must be different")
    # both sides with their vectors, which every step reads
    both = staged(units.where(F.col("project").isin(left_label, right_label)), "units")
    named = [r["project"] for r in both.select("project").distinct().collect()]
    for label in (left_label, right_label):
        if label not in named:
            some = [r["project"] for r in units.select("project").distinct().orderBy("project").limit(20).collect()]
            raise ValueError(f"no project {label!r}; the first are {', '.join(some)}")
    left, right = (both.where(F.col("project") == label) for label in (left_label, right_label))
    can = F.col("body_node_count") >= config.min_body_node_count
    exact = staged(exact_matches(left.where(can), right.where(can)), "exact")
    pending_left = left.where(can).join(exact.select(F.explode("left").alias("unit_idx")), "unit_idx", "left_anti")
    pending_right = right.where(can).join(exact.select(F.explode("right").alias("unit_idx")), "unit_idx", "left_anti")
    if config.abtt_components:
        from simlake.analyze.spectrum import all_but_the_top

        moved = all_but_the_top(both, config.abtt_components).select("unit_idx", "vector")
        pending_left, pending_right = (staged(d.drop("vector").join(moved, "unit_idx", "left"), "pending") for d in (pending_left, pending_right))
    calibration, top, threshold, match, margin = None, None, config.candidate_threshold, config.match_threshold, 0.0
    if config.calibration == "background":
        x, y = (d.select(F.col("unit_idx").alias("id"), F.col("vector").alias("v")) for d in (pending_left, pending_right))
        top = staged((index or ExactBlocks(config.block_size)).top_k_between(x, y, max(1, config.top_k_per_unit), -1.0), "top")
        calibration = calibrate(pending_left, pending_right, top, config)
        if calibration and calibration["applied"]:
            threshold, match, margin = (calibration[c] for c in ("effective_candidate_threshold", "effective_match_threshold", "margin_required"))
    edges = candidate_edges(pending_left, pending_right, config, threshold, top, index)
    records, suppressed = classify(left, right, edges, exact, config, match, margin)
    ordered = records.orderBy(class_order(), F.desc("score"), "left", "right")
    return {"records": ordered, "suppressed": suppressed, "counts": class_counts(records), "coverage": coverage(records, left), "calibration": calibration}
