"""Bounded clusters of a similarity graph.

Two rules depend on the order of edges: each unit keeps only so many of its best
edges, and clusters merge best edge first while they stay within their bounds.  Both
concern one connected component at a time, so components are found in the open and
dealt to tasks, about ``TASK_EDGES`` edges to each; deciding several components at once
decides each of them.  A component is decided by one task, which holds its edges.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.operators.graph import connected_components
from simlake.plans.staging import staged


#: Edges that one task decides, some 50 MB.
TASK_EDGES = 100_000


def capped(edges: list[tuple], limit: int) -> list[tuple]:
    """Best-first edges ``(a, b, ..., exact)`` that both ends have room for; exact copies always stay and take room."""
    used: dict[int, int] = {}
    kept = []
    for e in edges:
        a, b, exact = e[0], e[1], e[-1]
        if exact or (used.get(a, 0) < limit and used.get(b, 0) < limit):
            used[a], used[b] = used.get(a, 0) + 1, used.get(b, 0) + 1
            kept.append(e)
    return kept


def merged(edges: list[tuple], body: dict[int, str], max_units: int, max_bodies: int) -> dict[int, int]:
    """Unit -> smallest unit of its cluster, merging along best-first edges within both bounds."""
    home = {u: u for e in edges for u in e[:2]}
    members = {u: [u] for u in home}
    bodies = {u: {body[u]} for u in home}
    for e in edges:
        x, y = home[e[0]], home[e[1]]
        if x == y or len(members[x]) + len(members[y]) > max_units:
            continue
        union = bodies[x] | bodies[y]
        if len(union) > max(len(bodies[x]), len(bodies[y])) and len(union) > max_bodies:
            continue
        if len(members[x]) < len(members[y]):
            x, y = y, x
        for u in members.pop(y):
            home[u] = x
            members[x].append(u)
        bodies[x] = union
        del bodies[y]
    return {u: min(m) for m in members.values() if len(m) > 1 for u in m}


def bounded_clusters(edges: DataFrame, bodies: DataFrame, *, max_edges: int = 5, max_units: int = 100, max_bodies: int = 16) -> tuple[DataFrame, DataFrame]:
    """Kept edges ``a, b, raw, boosted, exact`` and clusters ``unit_idx, cluster`` (its smallest unit).

    ``edges`` has ``a, b, raw, boosted, exact``; ``bodies`` has ``unit_idx, body_hash``.
    """
    comps = connected_components(edges)
    body = bodies.select(F.col("unit_idx").alias("node"), F.col("body_hash"))
    rows = edges.join(comps.withColumnRenamed("node", "a"), "a")
    for end in ("a", "b"):
        rows = rows.join(body.select(F.col("node").alias(end), F.col("body_hash").alias(f"body_{end}")), end)

    def decide(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["boosted", "a", "b"], ascending=[False, True, True], kind="stable")
        known = {**dict(zip(part["a"], part["body_a"], strict=True)), **dict(zip(part["b"], part["body_b"], strict=True))}
        kept = capped(list(part[["a", "b", "raw", "boosted", "exact"]].itertuples(index=False, name=None)), max_edges)
        home = merged(kept, known, max_units, max_bodies)
        out = [(a, b, raw, boosted, exact, home.get(a), home.get(b)) for a, b, raw, boosted, exact in kept]
        return pd.DataFrame(out, columns=["a", "b", "raw", "boosted", "exact", "home_a", "home_b"]).astype({"home_a": "Int64", "home_b": "Int64"})

    tasks = max(1, -(-edges.count() // TASK_EDGES))
    done = staged(rows.groupBy(F.pmod(F.xxhash64("component"), F.lit(tasks))).applyInPandas(decide, "a bigint, b bigint, raw double, boosted double, exact boolean, home_a bigint, home_b bigint"), "kept")
    ends = done.select(F.explode(F.array(F.struct(F.col("a").alias("unit_idx"), F.col("home_a").alias("cluster")), F.struct(F.col("b").alias("unit_idx"), F.col("home_b").alias("cluster")))).alias("e"))
    clusters = ends.select("e.*").where("cluster is not null").distinct()
    return done.select("a", "b", "raw", "boosted", "exact"), clusters
