"""Duplicate clusters: exact copies folded, near-duplicates ranked, spread measured."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.functions import paths as P
from simlake.functions.vectors import dot
from simlake.operators.clusters import bounded_clusters
from simlake.operators.index import ExactBlocks, SimilarityIndex
from simlake.operators.similarity import expand_copies
from simlake.plans.staging import staged

#: When a cluster reads as one name implemented by many scopes.
FAMILY_MEMBERS, FAMILY_SCOPES, FAMILY_SHARE = 6, 3, 0.75
KINDS = ("product", "mixed", "test_or_docs")


@dataclass(frozen=True)
class DuplicateConfig:
    """Thresholds and bounds of the analysis."""

    candidate_threshold: float = 0.70
    similarity_threshold: float = 0.81
    rerank_threshold: float = 0.85
    block_size: int | None = None
    min_semantic_body_node_count: int = 20
    max_edges_per_unit: int = 5
    max_cluster_size: int = 100
    max_semantic_cluster_size: int = 16


def body_vectors(units: DataFrame) -> DataFrame:
    """One ``id, v`` for each distinct body: the id is its smallest unit."""
    known = units.where("vector is not null")
    return known.groupBy("body_hash").agg(F.min_by("vector", "unit_idx").alias("v"), F.min("unit_idx").alias("id")).select("id", "v", "body_hash")


def candidate_pairs(units: DataFrame, config: DuplicateConfig, index: SimilarityIndex | None = None) -> DataFrame:
    """``a, b, score`` over units: bodies are compared once, then expanded to their copies."""
    bodies = staged(body_vectors(units), "bodies")
    pairs = (index or ExactBlocks(config.block_size)).similar_pairs(bodies.select("id", "v"), config.candidate_threshold)
    own = units.where("vector is not null").join(bodies.select("body_hash", F.col("id").alias("body")), "body_hash").select(F.col("unit_idx").alias("id"), "body")
    within = bodies.select(F.col("id").alias("a"), dot("v", "v").alias("score")).where(F.col("score") >= config.candidate_threshold)
    return expand_copies(pairs, own, within)


_SIDE = ("project", "relative_path", "start_byte", "end_byte", "start_line", "end_line", "body_node_count", "body_hash")


def side(units: DataFrame, name: str, columns: Iterable[str] = _SIDE) -> tuple[DataFrame, dict[str, str]]:
    """The units as one end of a pair: key ``name`` and columns with its prefix."""
    columns = list(columns)
    names = {c: f"{name}_{c}" for c in columns}
    return units.select(F.col("unit_idx").alias(name), *(F.col(c).alias(names[c]) for c in columns)), names


def ranked_pairs(units: DataFrame, candidates: DataFrame, config: DuplicateConfig) -> DataFrame:
    """``a, b, raw, boosted, exact``: nested units, trivial bodies and weak pairs left out."""
    left, a = side(units, "a")
    right, b = side(units, "b")
    rows = candidates.join(left, "a").join(right, "b")
    nested = (F.col(a["project"]) == F.col(b["project"])) & (F.col(a["relative_path"]) == F.col(b["relative_path"])) & P.spans_overlap(a["start_byte"], a["end_byte"], b["start_byte"], b["end_byte"])
    exact = F.col(a["body_hash"]) == F.col(b["body_hash"])
    least = F.lit(config.min_semantic_body_node_count)
    large = (F.col(a["body_node_count"]) >= least) & (F.col(b["body_node_count"]) >= least)
    rows = rows.where(~nested & (exact | large)).withColumn("boosted", F.col("score") * (1 + P.distance_boost(a, b)))
    keep = (F.col("score") >= config.similarity_threshold) | (F.col("boosted") >= config.rerank_threshold)
    return rows.where(keep).select("a", "b", F.col("score").alias("raw"), "boosted", exact.alias("exact"))


def nearest_distance(members: DataFrame, key: str) -> DataFrame:
    """``key, dispersion``: the mean over members of the way to the nearest other; 0 for one member.

    ``members`` has ``key, unit_idx, relative_path``.  Members are compared by directory
    with the other directories of their group, so many files in one directory count once.
    """
    dirs = members.withColumn("dir", P.directory_of("relative_path")).groupBy(key, "dir").agg(F.count("*").alias("k"))
    x = dirs.where("k = 1").select(key, "dir")
    y = dirs.select(key, F.col("dir").alias("other"))
    far = x.join(y, key).where("dir != other").withColumn("d", P.path_distance(F.concat("dir", F.when(F.col("dir") == "", "x").otherwise("/x")), F.concat("other", F.when(F.col("other") == "", "x").otherwise("/x"))))
    nearest = far.groupBy(key, "dir").agg(F.min("d").alias("d"))
    total = nearest.groupBy(key).agg(F.sum("d").alias("total"))
    return dirs.groupBy(key).agg(F.sum("k").alias("n")).join(total, key, "left").select(key, (F.coalesce("total", F.lit(0)) / F.col("n")).alias("dispersion"))


def directory_entropy(members: DataFrame, key: str) -> DataFrame:
    """``key, directory_entropy`` in bits over the members' directories."""
    counts = members.withColumn("dir", P.directory_of("relative_path")).groupBy(key, "dir").agg(F.count("*").alias("k"))
    shares = counts.withColumn("p", F.col("k") / F.sum("k").over(W.partitionBy(key)))
    return shares.groupBy(key).agg(F.sum(-F.col("p") * F.log2("p")).alias("directory_entropy"))


def families(members: DataFrame) -> DataFrame:
    """``cluster, name_family``: the dominant name of clusters that read as one interface."""
    names = members.groupBy("cluster", "name").agg(F.count("*").alias("k"))
    top = names.groupBy("cluster").agg(F.max(F.struct("k", "name")).alias("top"), F.sum("k").alias("n"))
    scopes = members.groupBy("cluster").agg(F.countDistinct("scope").alias("scopes"))
    fits = (F.col("n") >= FAMILY_MEMBERS) & (F.col("scopes") >= FAMILY_SCOPES) & (F.col("top.k") >= FAMILY_SHARE * F.col("n"))
    return top.join(scopes, "cluster").where(fits).select("cluster", F.col("top.name").alias("name_family"))


def cluster_order() -> list[Column]:
    """Product code first, families last within a kind, then the highest boosted score."""
    return [F.col("kind_ord"), F.col("name_family").isNotNull(), F.desc("top_boosted"), F.col("hash")]


def duplicates(units: DataFrame, config: DuplicateConfig = DuplicateConfig(), ignored: DataFrame | None = None, index: SimilarityIndex | None = None) -> dict[str, DataFrame]:
    """Clusters, their members and pairs, cross-directory candidates, and ignored hashes.

    ``units`` is the fact table with ``vector``; ``ignored`` has the column ``hash``.
    """
    candidates = staged(candidate_pairs(units, config, index), "candidates")
    edges = staged(ranked_pairs(units, candidates, config), "ranked")
    kept, clusters = bounded_clusters(edges, units, max_edges=config.max_edges_per_unit, max_units=config.max_cluster_size, max_bodies=config.max_semantic_cluster_size)
    facts = ["unit_idx", "project", "relative_path", "name", "scope", "body_hash", "start_line", "end_line"]
    members = staged(clusters.join(units.select(*facts), "unit_idx"), "members")
    ends = members.select("unit_idx", "cluster")
    pairs = kept.join(ends.select(F.col("unit_idx").alias("a"), "cluster"), "a").join(ends.select(F.col("unit_idx").alias("b"), F.col("cluster").alias("other")), "b").where("cluster = other")
    pairs = staged(pairs.select("cluster", "a", "b", "raw", "boosted", "exact"), "pairs")
    tests = F.sum(P.is_test_or_docs_unit().cast("int"))
    heads = members.groupBy("cluster").agg(
        F.sort_array(F.collect_list("unit_idx")).alias("members"), P.cluster_hash(F.collect_list(P.fingerprint())).alias("hash"), F.count("*").alias("size"),
        F.countDistinct("body_hash").alias("bodies"), F.when(tests == 0, 0).when(tests == F.count("*"), 2).otherwise(1).alias("kind_ord"),
    )
    tops = pairs.groupBy("cluster").agg(F.max("raw").alias("top_raw"), F.max("boosted").alias("top_boosted"))
    heads = heads.join(tops, "cluster", "left").join(families(members), "cluster", "left").na.fill(0.0, ["top_raw", "top_boosted"])
    heads = heads.withColumn("kind", F.element_at(F.array(*map(F.lit, KINDS)), F.col("kind_ord") + 1))
    hashes = ignored.select("hash").distinct() if ignored is not None else heads.select("hash").limit(0)
    gone = heads.join(hashes, "hash", "left_semi").select("hash").orderBy("hash")
    left = staged(heads.join(hashes, "hash", "left_anti"), "clusters")
    live = members.join(left.select("cluster", "hash"), "cluster")
    exact = live.groupBy("cluster", "body_hash").agg(F.sort_array(F.collect_list("unit_idx")).alias("members"))
    return {
        "candidates": candidates, "pairs": pairs.join(left.select("cluster"), "cluster", "left_semi"), "members": live, "exact_groups": exact, "ignored": gone,
        "clusters": left.orderBy(*cluster_order()), "cross_directory": cross_directory(live),
    }


def cross_directory(members: DataFrame) -> DataFrame:
    """Clusters that reach over modules or directories, ranked; ``members`` has cluster, hash and unit facts."""
    base = members.groupBy("cluster", "hash").agg(
        F.sort_array(F.collect_set(P.top_level_module("relative_path"))).alias("modules"), F.sort_array(F.collect_set("scope")).alias("scopes"),
        (2 * F.sum(P.is_generic_path("relative_path").cast("int")) > F.count("*")).alias("generic_helper"),
    )
    rows = base.join(nearest_distance(members, "cluster"), "cluster").join(directory_entropy(members, "cluster"), "cluster")
    rows = rows.where((F.size("modules") >= 2) | (F.col("dispersion") >= 1.0))
    score = F.col("dispersion") + F.col("directory_entropy") + F.size("modules")
    score = score * F.when(F.col("generic_helper"), 0.4).otherwise(1.0) * F.when(F.size("scopes") >= 2, 1.5).otherwise(1.0)
    return rows.withColumn("score", score).orderBy(F.desc("score"), "hash")
