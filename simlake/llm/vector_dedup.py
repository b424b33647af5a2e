"""Near-duplicate vectors by robust-pruned flat graphs on overlapping shards.

Only vectors with equal, non-null labels are compared, by cosine in double precision.
Vectors of a label with the same direction form one class, which counts once however
many copies it has.

A label of at most ``REGION`` classes is one region.  There, vectors are cut into
overlapping cluster shards.  Each shard's nearest neighbours are pruned robustly
(Vamana, Subramanya et al., 2019: an edge is dropped when a kept neighbour is closer to
its end by a factor), and the shards' adjacency lists are united.  A greedy search from
the region's medoids finds each vector's surroundings; as soon as it meets a vector
within the range it goes on to expand all neighbours in range until none is new.  Every
hit is verified by its cosine in double precision (in extended precision where that is
within 1e-9 of the limit).  Recall is audited on rows spread over the region against all
rows of its label; if a link is missing, the search is repeated with a wider beam, at last
by blocks.  The audited recall is a column of the result.

A larger label is split, and no pair is lost by that.  Each class has one home: the cell
of its nearest centroid, or, where a cell holds more than ``REGION``, one of the cell's
pieces by hash.  Pairs within a piece are compared by blocks.  A class is besides a guest
of every piece before its own that can hold a vector within the limit, by the cell's
radius and by the plane between the two centroids; guests meet the piece's classes in
tasks of about ``REGION`` of each, by blocks.  Each pair is thus met once, and what
leaves a task is one row for each class, never a pair.  A group too dense to split costs
its square.  A region whose audit shows more than ``DENSE`` links a class goes by blocks
as well.

Centroids are fitted on about ``SAMPLE`` vectors of a label to be split; they and the
cells' radii, some four rows for each ``REGION`` classes, pass through the driver.

Defined results.  A vector that is null, zero, or holds null or non-finite components,
and one with a null label, links with nothing.  A null vec_id is never linked and is
kept.  Rows that repeat a vec_id count as vectors of their own but are one node, whatever
their vectors and labels, so that their groups are one.
Vectors of unequal length are never compared.  An empty table gives an empty table;
extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.functions.vectors import bound
from simlake.llm.common import table
from simlake.operators.graph import connected_components
from simlake.plans.staging import staged

REGION, SHARD, SAMPLE, OVERLAP = 16384, 512, 4096, 2
DEGREE, BEAM, ALPHA, AUDIT = 20, 16, 1.2, 64
#: Similarity below the limit down to which neighbours are expanded, what single precision may be off, and cells of a batch of queries.
MARGIN, SLACK, BATCH = 0.05, 1e-4, 1 << 22
#: A cosine from unit rows is sure beyond so much.
EPS = 1e-9
#: Share of the audited links that the graph search must find before it is believed, and the least that a result may have.
RECALL, LEAST_RECALL = 1.0, 0.9
#: Links a class beyond which a region is compared by blocks, and rows of a block.
DENSE, BLOCK = 256, 512


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def centroids(x: np.ndarray, k: int, rounds: int = 6) -> np.ndarray:
    """Spherical k-means on unit rows, started evenly over the rows in their given order."""
    c = x[np.linspace(0, len(x) - 1, k).astype(int)].copy()
    for _ in range(rounds):
        near = (x @ c.T).argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.sqrt((total * total).sum(axis=1, keepdims=True))
        c = np.where(norm > 0, total / np.where(norm > 0, norm, 1), c)
    return c


def robust_prune(sims: np.ndarray, top: np.ndarray, degree: int = DEGREE, alpha: float = ALPHA) -> np.ndarray:
    """Which of each row's neighbours ``top`` (nearest first) it keeps: none much closer to a kept one than to the row."""
    far = np.sqrt(np.maximum(2 - 2 * np.take_along_axis(sims, top, axis=1), 0))
    open_, kept = np.ones(top.shape, bool), np.zeros(top.shape, bool)
    for i in range(top.shape[1]):
        kept[:, i] = open_[:, i] & (kept.sum(axis=1) < degree)
        rows = np.flatnonzero(kept[:, i])
        mutual = np.sqrt(np.maximum(2 - 2 * sims[top[rows, i, None], top[rows]], 0))
        open_[rows] &= alpha * mutual > far[rows]
    return kept


def build(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """United adjacency lists over overlapping shards (``start, ends``: those of row i are ends[start[i]:start[i + 1]]), and the shards' medoids."""
    n = len(x)
    c = centroids(x[:: max(1, n // SAMPLE)], min(n, max(1, -(-n // SHARD))))
    near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :OVERLAP]
    codes, medoids = [], []
    for shard in range(len(c)):
        mine = np.flatnonzero((near == shard).any(axis=1))
        if not len(mine):
            continue
        medoids.append(int(mine[(x[mine] @ c[shard]).argmax()]))
        for part in np.array_split(mine, max(1, -(-len(mine) // (4 * SHARD)))):
            sims = x[part] @ x[part].T
            np.fill_diagonal(sims, -2)
            width = min(2 * DEGREE, len(part) - 1)
            if not width:
                continue
            top = np.argpartition(-sims, width - 1, axis=1)[:, :width]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(sims, top, axis=1), axis=1, kind="stable"), axis=1)
            rows, at = np.nonzero(robust_prune(sims, top))
            codes.append(part[rows] * n + part[top[rows, at]])
    # medoids are linked in a ring, so that every shard can be reached
    ring = np.array(medoids)
    codes.append(ring * n + np.roll(ring, -1))
    a, b = np.divmod(np.concatenate(codes), n)
    both = np.unique(np.concatenate([a * n + b, b * n + a])[np.concatenate([a != b, a != b])])
    return np.searchsorted(both // n, np.arange(n + 1)), (both % n).astype(np.int64), ring


def range_search(x: np.ndarray, graph: tuple[np.ndarray, np.ndarray, np.ndarray], queries: np.ndarray, limit: float, beam: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, row) with similarity of at least ``limit``, for many queries at a time.

    A greedy search goes from the medoids towards the query; once it has met a row within
    ``margin`` of the range, all neighbours of such rows are expanded until none is new.
    """
    (start, ends, medoids), n, k = graph, len(x), len(queries)
    q = x[queries]
    seen = np.zeros(k * n, bool)
    turn = np.empty(k * n, np.int32)
    first = q @ x[medoids].T
    seen.reshape(k, n)[:, medoids] = True
    at, m = np.nonzero(first >= limit)
    found = [at * n + medoids[m]]
    at, m = np.nonzero(first >= limit - margin)
    go_q, go_id = at, medoids[m]
    arrived = np.zeros(k, bool)
    arrived[go_q] = True
    # the beam of queries under way: rows, similarities, and which have been expanded
    width = min(beam, len(medoids))
    best = np.argsort(-first, axis=1, kind="stable")[:, :width]
    ids, sims = np.full((k, beam), -1), np.full((k, beam), -9.0, x.dtype)
    ids[:, :width], sims[:, :width] = medoids[best], np.take_along_axis(first, best, axis=1)
    done = ids < 0
    while True:
        under = np.flatnonzero(~arrived & ~done.all(axis=1))
        pick = np.where(done[under], -9, sims[under]).argmax(axis=1)
        done[under, pick] = True
        go_q, go_id = np.concatenate([go_q, under]), np.concatenate([go_id, ids[under, pick]])
        if not len(go_q):
            break
        counts = start[go_id + 1] - start[go_id]
        flat = np.repeat(start[go_id] - np.cumsum(counts) + counts, counts) + np.arange(counts.sum())
        codes = np.repeat(go_q, counts) * n + ends[flat]
        codes = codes[~seen[codes]]
        turn[codes] = np.arange(len(codes))  # of a row met twice at once the last stays
        codes = codes[turn[codes] == np.arange(len(codes))]
        seen[codes] = True
        of, rows = np.divmod(codes, n)
        near = np.einsum("ij,ij->i", x[rows], q[of])
        found.append(codes[near >= limit])
        wide = near >= limit - margin
        go_q, go_id = of[wide], rows[wide]
        arrived[go_q] = True
        open_ = np.flatnonzero(~arrived[of])
        if len(open_):
            of, rows, near = of[open_], rows[open_], near[open_]
            order = np.lexsort((-near, of))
            of, rows, near = of[order], rows[order], near[order]
            rank = np.arange(len(of)) - np.searchsorted(of, of)
            top = rank < beam
            new_ids, new_sims = np.full((k, beam), -1), np.full((k, beam), -9.0, x.dtype)
            new_ids[of[top], rank[top]], new_sims[of[top], rank[top]] = rows[top], near[top]
            changed = np.unique(of)
            all_ids, all_sims = np.hstack([ids[changed], new_ids[changed]]), np.hstack([sims[changed], new_sims[changed]])
            all_done = np.hstack([done[changed], new_ids[changed] < 0])
            order = np.argsort(-all_sims, axis=1, kind="stable")[:, :beam]
            ids[changed], sims[changed], done[changed] = (np.take_along_axis(z, order, axis=1) for z in (all_ids, all_sims, all_done))
    at, rows = np.divmod(np.concatenate(found), n)
    return queries[at], rows


def _reaches(v: np.ndarray, a: np.ndarray, b: np.ndarray, sims: np.ndarray, limit: float) -> np.ndarray:
    """Which pairs have a cosine of at least ``limit``; those too close to tell from unit rows are summed in extended precision."""
    out = sims >= limit
    close = np.flatnonzero(np.abs(sims - limit) <= EPS)
    for at in range(0, len(close), 1 << 16):
        some = close[at : at + (1 << 16)]
        x, y = v[a[some]].astype(np.longdouble), v[b[some]].astype(np.longdouble)
        x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
        out[some] = ((x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))).astype(np.float64) >= limit
    return out


def smallest_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n rows the smallest row of its component, from links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def audited(x: np.ndarray, limit: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rows spread over the region, and for each all rows within the range, by brute force."""
    audit = np.unique(np.linspace(0, len(x) - 1, min(len(x), AUDIT)).astype(int))
    return audit, [np.flatnonzero(x @ x[i] >= limit + EPS) for i in audit]


def region_links(v: np.ndarray, copies: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray, float]:
    """Each row's linked copies, the smallest row of its component, and the recall audited, over one region."""
    x, n = unit_rows(v), len(v)
    audit, truth = audited(x, limit)
    if sum(map(len, truth)) > DENSE * len(audit):
        return *block_links(v, copies, limit), 1.0
    fast = x.astype(np.float32)
    graph, batch = build(fast), max(1, min(n, BATCH // n))
    for beam, margin in ((BEAM, MARGIN), (4 * BEAM, 3 * MARGIN)):
        # every link counts in both directions, so one end's search may miss it
        pairs = [np.empty(0, np.int64)]
        for lo in range(0, n, batch):
            a, b = range_search(fast, graph, np.arange(lo, min(n, lo + batch)), limit - SLACK, beam, margin)
            pairs.append((np.minimum(a, b) * n + np.maximum(a, b))[a != b])
        a, b = np.divmod(np.unique(np.concatenate(pairs)), n)
        sims = np.concatenate([np.empty(0), *(np.einsum("ij,ij->i", x[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536))])
        good = _reaches(v, a, b, sims, limit)
        a, b = a[good], b[good]
        known = np.unique(np.concatenate([a * n + b, b * n + a, np.arange(n) * n + np.arange(n)]))
        wanted = np.concatenate([i * n + t for i, t in zip(audit, truth, strict=True)])
        recall = float(np.isin(wanted, known).mean())
        if recall >= RECALL:
            break
    else:
        return *block_links(v, copies, limit), 1.0
    counts = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    return counts.astype(np.int64), smallest_linked(n, a, b), recall


def block_links(v: np.ndarray, copies: np.ndarray, limit: float, w: np.ndarray | None = None, w_copies: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Each row's linked copies and the smallest row of its component, over all pairs in ``v``, or of ``v`` with ``w`` (numbered on)."""
    n, own = len(v), w is None
    every = v if own else np.concatenate([v, w])
    x, weight = unit_rows(every), copies if own else np.concatenate([copies, w_copies])
    counts, root = np.zeros(len(every), np.int64), np.arange(len(every))
    for lo in range(0 if own else n, len(every), BLOCK):
        hi = min(lo + BLOCK, len(every))
        sims = x[lo:hi] @ x[:n].T
        near = sims >= limit
        a, b = np.nonzero(np.abs(sims - limit) <= EPS)
        if len(a):
            near[a, b] = _reaches(every, a + lo, b, sims[a, b], limit)
        if own:
            near[np.arange(hi - lo), np.arange(lo, hi)] = False
        rows = np.flatnonzero(near.any(axis=1))
        if not len(rows):
            continue
        at = rows + lo
        counts[at] += (near[rows] @ weight[:n].astype(np.float64)).astype(np.int64)
        if not own:
            counts[:n] += (weight[at].astype(np.float64) @ near[rows]).astype(np.int64)
        for i, row in zip(at.tolist(), rows.tolist(), strict=True):
            meets = np.unique(np.append(root[:n][near[row]], root[i]))
            if len(meets) > 1:
                root[np.isin(root, meets)] = meets[0]
    return counts, root


_REGION_OUT = "id bigint, root bigint, links bigint, recall double"


def _region(rows: pd.DataFrame, limit: float) -> pd.DataFrame:
    """One task: each class's links counted here, and its smallest linked class here."""
    rows = rows.sort_values(["guest", "id"], kind="stable").reset_index(drop=True)
    ids, copies, guest = rows["id"].to_numpy(), rows["copies"].to_numpy(), rows["guest"].to_numpy(bool)
    v, recall, n = np.stack(rows["v"].to_numpy()).astype(np.float64), 1.0, int((~guest).sum())
    if rows["task"].iloc[0] >= 0:
        # a piece with some of its guests; classes without a link here have a row in their own piece's task
        counts, root = block_links(v[:n], copies[:n], limit, v[n:], copies[n:])
        return pd.DataFrame({"id": ids, "root": ids[root], "links": counts, "recall": recall})[counts > 0]
    if rows["pieces"].iloc[0]:
        counts, root = block_links(v, copies, limit)
    else:
        counts, root, recall = region_links(v, copies, limit)
    return pd.DataFrame({"id": ids, "root": ids[root], "links": counts, "recall": recall})


def _fitted(rows: pd.DataFrame, size: int) -> pd.DataFrame:
    """Centroids of one label from its sample."""
    x = unit_rows(np.stack(rows.sort_values("id")["v"].to_numpy()).astype(np.float64))
    k = int(min(256, max(2, -(-rows["n"].iloc[0] * 4 // size)), len(x)))
    return pd.DataFrame({"region": rows["region"].iloc[0], "number": range(k), "c": list(centroids(x, k))})


def _units(rows: pd.DataFrame) -> np.ndarray:
    return unit_rows(np.stack(rows["v"].to_numpy()).astype(np.float64))


def split(classes: DataFrame, limit: float, size: int) -> DataFrame:
    """Deal ``id, copies, v, region`` to tasks ``region, task, guest, pieces``: -1 is a piece by itself, others are it and some of its guests."""
    whole = {"task": F.lit(-1), "guest": F.lit(False), "pieces": F.lit(False)}
    sizes = staged(classes.groupBy("region").agg(F.count("*").alias("n")).where(F.col("n") > size), "sizes")
    if not sizes.limit(1).count():
        return classes.withColumns(whole)
    big, kind = classes.join(sizes, "region"), dict(classes.dtypes)["v"]
    # a bounded sample of each label: a hash decides, so about SAMPLE rows are kept
    drawn = big.where(F.pmod(F.xxhash64("id", F.lit(0)), F.lit(1 << 30)).cast("double") * F.col("n") < float(SAMPLE << 30))
    fitted = drawn.groupBy("region").applyInPandas(lambda rows: _fitted(rows, size), "region string, number int, c array<double>").orderBy("region", "number").collect()
    cells: dict[str, np.ndarray] = {}
    for r in fitted:
        cells.setdefault(r["region"], []).append(r["c"])
    cells = {r: np.array(c) for r, c in cells.items()}

    def homes(batches):
        for batch in batches:
            for region, rows in batch.groupby("region"):
                near = _units(rows) @ cells[region].T
                yield rows.assign(cell=near.argmax(axis=1).astype("int32"), near=near.max(axis=1))

    home = staged(big.select("id", "copies", "v", "region", F.xxhash64("id", F.lit(1)).alias("h")).mapInPandas(homes, f"id bigint, copies bigint, v {kind}, region string, h bigint, cell int, near double"), "homes")
    radius, pieces = {r: np.full(len(c), -1.0) for r, c in cells.items()}, {r: np.zeros(len(c), np.int64) for r, c in cells.items()}
    for r in home.groupBy("region", "cell").agg(F.min("near").alias("near"), F.count("*").alias("n")).collect():
        radius[r["region"]][r["cell"]] = np.arccos(np.clip(r["near"], -1, 1))
        pieces[r["region"]][r["cell"]] = -(-r["n"] // size)
    far, angle, slack = np.sqrt(max(0.0, 2 - 2 * limit)), np.arccos(min(1.0, limit)), 1e-6

    def places(batches):
        for batch in batches:
            for region, rows in batch.groupby("region"):
                c, many, cell = cells[region], pieces[region], rows["cell"].to_numpy()
                piece = rows["h"].to_numpy() % many[cell]
                sims = _units(rows) @ c.T
                out = rows[["id", "copies", "v", "h"]]
                yield out.assign(region=[f"{region}/{a}/{p}" for a, p in zip(cell, piece, strict=True)], guest=False)
                for other in np.flatnonzero(many):
                    apart = sims[np.arange(len(cell)), cell] - sims[:, other] <= far * np.sqrt(((c[cell] - c[other]) ** 2).sum(axis=1)) + slack
                    within = np.arccos(np.clip(sims[:, other], -1, 1)) <= radius[region][other] + angle + slack
                    for p in range(many[other]):
                        may = (cell > other) & apart & within | (cell == other) & (piece > p)
                        if may.any():
                            yield out[may].assign(region=f"{region}/{other}/{p}", guest=True)

    placed = staged(home.mapInPandas(places, f"id bigint, copies bigint, v {kind}, h bigint, region string, guest boolean"), "places")
    # guests are dealt to tasks of about ``size``; the piece's own classes go to each of them
    turns = placed.groupBy("region").agg(F.ceil(F.sum(F.col("guest").cast("int")) / size).cast("int").alias("turns"))
    placed = placed.join(staged(turns, "turns"), "region")
    guests = placed.where("guest").withColumn("task", F.pmod(F.xxhash64("h", F.lit(2)), F.col("turns")).cast("int"))
    hosts = placed.where("not guest").withColumn("task", F.explode(F.sequence(F.lit(-1), F.col("turns") - 1)))
    cols = ["id", "copies", "v", "region", "task", "guest"]
    dealt = guests.select(cols).unionByName(hosts.select(cols)).withColumn("pieces", F.lit(True))
    return dealt.unionByName(classes.join(sizes, "region", "left_anti").withColumns(whole).select(*cols, "pieces"))


def near_vectors(vectors: DataFrame, *, limit: float = 0.98) -> DataFrame:
    """``vec_id, n_links, component_id, kept, recall`` from ``vec_id, embedding, label``: one row for each row.

    ``recall`` is what the search of the row's region found of the links of the audited
    rows, null for rows that are not compared; it raises if one is below ``LEAST_RECALL``.
    """
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("v"), F.col("label").cast("string").alias("label"))
    finite = F.forall("v", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite & F.exists("v", lambda a: a != 0)
    # one class for each direction: by the largest component, which keeps the sign; 0.0 in place of -0.0
    direction = bound(F.array_max(F.transform("v", lambda a: F.abs(a.cast("double")))), lambda top: F.transform("v", lambda a: a.cast("double") / top + F.lit(0.0)))
    hashed = bound(direction, lambda d: F.struct(F.xxhash64("label", d).alias("x"), F.xxhash64(F.lit("again"), F.size("v"), d, "label").alias("y")))
    v = staged(v.withColumn("key", F.when(F.coalesce(usable, F.lit(False)), hashed)), "vectors")
    known = v.where("key is not null")
    grouped = known.groupBy("key").agg(F.min("vec_id").alias("rep"), F.min_by("v", "vec_id").alias("v"), F.count("*").alias("copies"), F.min("label").alias("label"))
    # numbers are written down with the table, so that they hold from here on
    classes = staged(grouped.withColumn("id", F.monotonically_increasing_id()), "classes")
    rows = split(classes.select("id", "copies", "v", F.concat_ws(":", F.size("v").cast("string"), "label").alias("region")), limit, REGION)

    def region(part: pd.DataFrame) -> pd.DataFrame:
        return _region(part, limit)

    found = staged(rows.groupBy("region", "task").applyInPandas(region, _REGION_OUT), "found")
    worst = found.agg(F.min("recall")).first()[0]
    if worst is not None and worst < LEAST_RECALL:
        raise RuntimeError(f"the search found only {worst:.3f} of the audited links")
    edges = found.where("id != root").select(F.col("id").alias("a"), F.col("root").alias("b"))
    # rows that share an id are one node
    own = known.select("vec_id", "key").join(classes.select("key", "id"), "key")
    same = own.groupBy("vec_id").agg(F.min("id").alias("a"), F.max("id").alias("z")).where("a != z").select("vec_id", "a")
    edges = edges.unionByName(own.join(same, "vec_id").where("id != a").select("a", F.col("id").alias("b")).distinct())
    comps = connected_components(edges).select(F.col("node").alias("id"), "component")
    links = found.groupBy("id").agg(F.sum("links").alias("links"), F.min("recall").alias("recall"))
    per_class = classes.select("key", "id", "rep", "copies").join(links, "id").join(comps, "id", "left").withColumn("component", F.coalesce("component", "id"))
    least = per_class.groupBy("component").agg(F.min("rep").alias("component_id"))
    per_class = staged(per_class.join(least, "component").select("key", (F.col("links") + F.col("copies") - 1).alias("n_links"), "component_id", "recall"), "decided")
    out = v.select("vec_id", "key").join(per_class, "key", "left")
    # an id may have another row that is compared
    ids = out.where("component_id is not null").groupBy("vec_id").agg(F.min("component_id").alias("of_id"))
    alone = staged(out.where("key is null and vec_id is not null").select("vec_id").distinct().join(ids, "vec_id"), "alone")
    if not alone.isEmpty():
        out = out.join(alone, "vec_id", "left").withColumn("component_id", F.coalesce("component_id", "of_id")).drop("of_id")
    own = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(True)).alias("kept"), "recall")


def op10_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All embeddings, cosine 0.98 within equal labels: ``vec_id, n_links, component_id, kept`` (and ``recall``)."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


ORACLE = {
    "op10_vector_dedup": """
with recursive e as (select vec_id, label, embedding::double[] as v from embeddings
  where label is not null and len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
k as (select a.vec_id as a, b.vec_id as b from e a join e b on a.label = b.label and a.vec_id < b.vec_id and len(a.v) = len(b.v)
  where list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))) >= 0.98),
sym as (select a as x, b as y from k union all select b, a from k),
reach(x, c) as (select vec_id, vec_id from embeddings union select sym.y, reach.c from reach join sym on sym.x = reach.x),
comp as (select x, min(c) as c from reach group by x),
n as (select x, count(*) as n from sym group by x)
select vec_id, coalesce(n.n, 0) as n_links, c as component_id, vec_id = c as kept, case when e.vec_id is not null then 1.0::double end as recall
from embeddings left join e using (vec_id) left join n on n.x = vec_id join comp on comp.x = vec_id
"""
}
