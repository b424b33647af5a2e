"""Connected components of an edge table, without gathering a component anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.plans.staging import staged


class UnionFind:
    """Disjoint sets whose root is the smallest member."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def find(self, x: int) -> int:
        parent = self.parent
        root = x
        while (up := parent.get(root, root)) != root:
            root = up
        while x != root:
            parent[x], x = root, parent.get(x, x)
        return root

    def join(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.parent[max(x, y)] = min(x, y)
        return True


#: Edges that one union-find holds (some 100 MB) before it hands on its stars.
LOCAL_EDGES = 500_000


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replace the edges of a task by one edge from each node to its local root."""

    def out(sets: UnionFind) -> pa.RecordBatch:
        nodes = [x for x in sets.parent if sets.find(x) != x]
        return pa.record_batch([pa.array(nodes, pa.int64()), pa.array([sets.find(x) for x in nodes], pa.int64())], names=["u", "v"])

    sets, n = UnionFind(), 0
    for batch in batches:
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            sets.join(x, y)
        n += batch.num_rows
        if n > LOCAL_EDGES:
            yield out(sets)
            sets, n = UnionFind(), 0
    yield out(sets)


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` for each node of an edge; ``component`` is the smallest node reachable.

    Every task first contracts about ``LOCAL_EDGES`` edges by union-find, so what fits
    one task is done by that; alternating large-star and small-star rounds (Kiveris et
    al., 2014) then join the stars.  A round is an aggregate and a join on the node, so a
    node with very many edges is summed before the shuffle and its join can be split.
    Self-edges and null ends are left out.
    """
    e = staged(edges.select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).where("u != v"), "edges")
    tasks = -(-e.count() // LOCAL_EDGES)
    stars = e.coalesce(max(1, tasks)).mapInArrow(_stars, "u bigint, v bigint")
    e = staged(stars, "edges") if tasks <= 1 else _joined(staged(stars.distinct(), "edges"))
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _joined(e: DataFrame) -> DataFrame:
    """Large-star and small-star rounds until each edge leads to the smallest node of its component."""
    before = _mark(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = staged(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        after = _mark(e)
        if after == before:
            break
        before = after
    return e
