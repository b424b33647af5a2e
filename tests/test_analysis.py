"""The analyses against plain Python versions of their rules, on random units."""

import math
import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from simlake.analyze import compare as C
from simlake.analyze import concerns, drift, duplicates, experiments, spectrum
from simlake.operators import graph, ranks
from simlake.operators.clusters import capped, merged
from simlake.operators.graph import UnionFind, connected_components
from simlake.operators.index import Comparison, Contract, Duplicates, ExactBlocks, HashEmbedder, contract_diff, query_vector
from simlake.operators.similarity import similar_pairs, similar_pairs_sql, top_k_between
from simlake.plans import registry
from tests.helpers import direction, drawn, entry, table

SETTINGS = duplicates.DuplicateConfig(candidate_threshold=0.9, similarity_threshold=0.96, rerank_threshold=1.0, max_edges_per_unit=3, max_cluster_size=7, max_semantic_cluster_size=4)
TEST_FOLDERS, HELPER_FOLDERS = {"tests", "docs"}, {"util", "lib"}


def cosine(u, v):
    return sum(x * y for x, y in zip(u["vector"], v["vector"], strict=True))


def folders(u):
    return u["relative_path"].split("/")[:-1]


def steps(u, v):
    x, y = folders(u), folders(v)
    same = 0
    while same < min(len(x), len(y)) and x[same] == y[same]:
        same += 1
    return len(x) + len(y) - 2 * same


def is_test(u):
    file = u["relative_path"].split("/")[-1]
    return bool(TEST_FOLDERS & {f.lower() for f in folders(u)}) or "_test." in file or ".spec." in file or (u["scope"] or "").split(".")[0] == "tests"


def ranked(rows, config):
    found = []
    for i, u in enumerate(rows):
        for j in range(i + 1, len(rows)):
            v = rows[j]
            if u["vector"] is None or v["vector"] is None or (raw := cosine(u, v)) < config.candidate_threshold:
                continue
            same_file = (u["project"], u["relative_path"]) == (v["project"], v["relative_path"])
            if same_file and u["start_byte"] < v["end_byte"] and v["start_byte"] < u["end_byte"]:
                continue
            exact = u["body_hash"] == v["body_hash"]
            if not exact and min(u["body_node_count"], v["body_node_count"]) < config.min_semantic_body_node_count:
                continue
            gap = max(0, v["start_line"] - u["end_line"], u["start_line"] - v["end_line"])
            boosted = raw * (1 + (0.1 * min(gap / 200, 1) if same_file else min(0.03 * steps(u, v), 0.15)))
            if raw >= config.similarity_threshold or boosted >= config.rerank_threshold:
                found.append((i, j, raw, boosted, exact))
    return sorted(found, key=lambda e: (-round(e[3], 12), e[0], e[1]))


def spread(rows, members):
    """Mean way to the nearest other member, entropy of directories."""
    where = [folders(rows[m]) for m in members]
    ways = [min((steps(rows[m], rows[o]) for o in members if o != m), default=0) for m in members]
    counts = Counter(map(tuple, where)).values()
    return sum(ways) / len(ways), -sum(c / len(members) * math.log2(c / len(members)) for c in counts)


@pytest.mark.parametrize("seed", [1, 2])
def test_duplicates_equal_the_rules(spark, seed):
    rows = drawn(seed, 70, ("one", "two"))
    found = duplicates.duplicates(table(spark, rows), SETTINGS)
    edges = ranked(rows, SETTINGS)
    kept = capped(edges, SETTINGS.max_edges_per_unit)
    home = merged(kept, {i: u["body_hash"] for i, u in enumerate(rows)}, SETTINGS.max_cluster_size, SETTINGS.max_semantic_cluster_size)
    want = defaultdict(list)
    for unit, cluster in sorted(home.items()):
        want[cluster].append(unit)
    assert len(want) > 3
    got = {tuple(r["members"]): r for r in found["clusters"].collect()}
    assert set(got) == set(map(tuple, want.values()))
    for members, r in got.items():
        tests = sum(is_test(rows[m]) for m in members)
        inside = [e for e in kept if e[0] in members and e[1] in members]
        assert r["kind"] == ("product" if not tests else "test_or_docs" if tests == len(members) else "mixed")
        assert r["top_raw"] == pytest.approx(max(e[2] for e in inside)) and r["top_boosted"] == pytest.approx(max(e[3] for e in inside)) and r["bodies"] == len({rows[m]["body_hash"] for m in members})
    cross = {r["hash"]: r for r in found["cross_directory"].collect()}
    for members, r in got.items():
        dispersion, entropy = spread(rows, members)
        tops = {rows[m]["relative_path"].split("/")[0] for m in members}
        assert (r["hash"] in cross) == (len(tops) >= 2 or dispersion >= 1)
        if r["hash"] in cross:
            helpers = 2 * sum(bool(HELPER_FOLDERS & {f.lower() for f in folders(rows[m])}) for m in members) > len(members)
            scopes = {rows[m]["scope"] for m in members} - {None}
            score = (dispersion + entropy + len(tops)) * (0.4 if helpers else 1) * (1.5 if len(scopes) >= 2 else 1)
            assert cross[r["hash"]]["score"] == pytest.approx(score) and cross[r["hash"]]["generic_helper"] == helpers
    # what is ignored leaves every table, and an index of the same shape can take the place of the default
    gone = sorted(r["hash"] for r in got.values())[0]
    again = Duplicates().run(table(spark, rows), SETTINGS)
    less = duplicates.duplicates(table(spark, rows), SETTINGS, ignored=spark.createDataFrame([(gone,)], "hash string"), index=ExactBlocks(9))
    assert again["clusters"].count() == len(got) and less["clusters"].count() == len(got) - 1 and [r["hash"] for r in less["ignored"].collect()] == [gone]


def test_a_family_is_one_name_in_many_scopes(spark):
    rows = [entry(f"one:shapes/s{i}.go", f"area{i}", direction(i / 9), name="Area" if i < 6 else "Border", scope=f"Shape{i % 4}") for i in range(8)]
    members = table(spark, rows).withColumn("cluster", F.lit(0))
    assert [tuple(r) for r in duplicates.families(members).collect()] == [(0, "Area")]
    assert not duplicates.families(members.where("unit_idx < 5")).count() and not duplicates.families(members.withColumn("scope", F.lit("Shape"))).count()
    config = replace(SETTINGS, max_edges_per_unit=20, max_cluster_size=20, max_semantic_cluster_size=20)
    rows += [entry(f"one:other/o{i}.go", f"o{i}", direction(120 + 3 * i)) for i in range(2)]
    assert [r["name_family"] for r in duplicates.duplicates(table(spark, rows), config)["clusters"].collect()] == [None, "Area"]


def test_deciding_by_component_is_deciding_globally():
    for seed in range(200):
        rng = random.Random(seed)
        n = rng.randint(3, 16)
        body = [rng.choice("pqrstuv") for _ in range(n)]
        edges = [(a, b, 1.0, rng.choice([0.7, 0.8, 0.9]), body[a] == body[b]) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.25]
        edges.sort(key=lambda e: (-e[3], e[0], e[1]))
        sets, parts = UnionFind(), defaultdict(list)
        for e in edges:
            sets.join(e[0], e[1])
        for e in edges:
            parts[sets.find(e[0])].append(e)
        decide = lambda some: (k := capped(some, 2), merged(k, dict(enumerate(body)), 5, 3))
        kept, home = decide(edges)
        apart = [decide(p) for p in parts.values()]
        assert sorted(kept) == sorted(e for k, _ in apart for e in k) and home == {u: c for _, h in apart for u, c in h.items()}


@pytest.mark.parametrize("local", [500_000, 40])
def test_components_of_chains_stars_and_noise(spark, monkeypatch, local):
    monkeypatch.setattr(graph, "LOCAL_EDGES", local)
    rng = random.Random(11)
    edges = [(7 * i, 7 * i + 7) for i in range(120)] + [(5000, 5001 + i) for i in range(150)] + [(rng.randrange(9000, 9300), rng.randrange(9000, 9300)) for _ in range(180)] + [(3, 3), (None, 5), (6, None)]
    want = UnionFind()
    for a, b in edges:
        if a is not None and b is not None:
            want.join(a, b)
    nodes = {x for a, b in edges if a is not None and b is not None and a != b for x in (a, b)}
    assert {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a int, b int")).collect()} == {x: want.find(x) for x in nodes}
    assert connected_components(spark.createDataFrame([], "a int, b int")).isEmpty()


def test_vector_joins_equal_nested_loops(spark):
    rng = np.random.default_rng(12)
    grid = rng.integers(-2, 3, size=(60, 4)).astype(float)  # equal scores occur
    rows = [(i * 3, None if i % 11 == 5 else v.tolist()) for i, v in enumerate(grid)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    pairs = sorted(tuple(r) for r in similar_pairs_sql(df, 3.0).collect())
    for block in (None, 7):
        assert sorted(tuple(r) for r in similar_pairs(df, 3.0, block=block).collect()) == pairs
    known = [(i, v) for i, v in rows if v is not None]
    for k, block in ((1, None), (4, 7), (99, 13)):
        want = []
        for i, v in known[:25]:
            order = sorted(((-float(np.dot(v, w)), j) for j, w in known[25:]))[:k]
            want += [(i, j, -s, at) for at, (s, j) in enumerate(order, 1)]
        cut = known[24][0]
        got = top_k_between(df.where(F.col("id") <= cut), df.where(F.col("id") > cut), k, -99.0, block=block)
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_both_directions_at_once(spark):
    rng = np.random.default_rng(14)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.integers(-2, 3, size=(50, 3)).astype(float))] + [(50, None)]
    df = spark.createDataFrame(rows, "id bigint, v array<double>")
    left, right = df.where("id < 22"), df.where("id >= 22")
    index = ExactBlocks(8)
    want = {(r["a"], r["b"], r["score"]) for r in index.top_k_between(left, right, 2, 1.0).collect()} | {(r["b"], r["a"], r["score"]) for r in index.top_k_between(right, left, 2, 1.0).collect()}
    for block in (8, None):
        assert sorted(tuple(r) for r in ExactBlocks(block).top_k_both(left, right, 2, 1.0).collect()) == sorted(want)


def test_positions_and_ranks(spark, monkeypatch):
    monkeypatch.setattr(ranks, "LEAF", 10)
    rng = random.Random(13)
    values = [rng.choice([rng.gauss(0, 1), 0.25, 1e9]) for _ in range(400)] + [None] * 5
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double").repartition(5)
    real = sorted(v for v in values if v is not None)
    for at in (0, 1, 133, 200, 399):
        assert ranks.rank_pick(df, "x", lambda n, at=at: at) == real[at]
    assert ranks.rank_pick(df.where("x is null"), "x", lambda n: 0) is None
    assert [r["p"] for r in ranks.positions(df, "i", "p").orderBy("i").collect()] == list(range(405))
    assert sorted(r["i"] for r in ranks.evenly_spaced(df, "i", 7).collect()) == [k * 405 // 7 for k in range(7)] and ranks.evenly_spaced(df, "i", 0).count() == 405
    assert experiments.interpolated(df, "x", 0.3) == pytest.approx(np.percentile(real, 30))


def compared(rows, config):
    """Records (class, left, right, score) by the rules, one after the other."""
    left, right = ([i for i, u in enumerate(rows) if u["project"] == p] for p in ("old", "new"))
    able = {i for i, u in enumerate(rows) if u["body_node_count"] >= config.min_body_node_count}
    records = []
    for i in left:
        if i in able and (same := [j for j in right if j in able and rows[j]["body_hash"] == rows[i]["body_hash"]]):
            records.append(("exact_copy", [i], same, 1.0))
    used_l, used_r = {i for r in records for i in r[1]}, {j for r in records for j in r[2]}
    ls, rs = ([i for i in side if i in able and i not in used and rows[i]["vector"]] for side, used in ((left, used_l), (right, used_r)))

    def hint(i, j):
        u, v = rows[i], rows[j]
        a, b = u["name"].lower(), v["name"].lower()
        name = 0.02 if a == b else 0.01 if a in b or b in a else 0
        top = lambda w: w["relative_path"].split("/")[0]
        return min(0.04, name + (0.02 if folders(u) == folders(v) else 0.01 if top(u) == top(v) else 0))

    raw = {(i, j): cosine(rows[i], rows[j]) for i in ls for j in rs}
    raw = {e: s for e, s in raw.items() if s >= config.candidate_threshold}
    best = lambda own, mine, other: set(sorted((e for e in raw if e[own] == mine), key=lambda e: (-round(raw[e], 12), e[other]))[: config.top_k_per_unit])
    edges = set().union(*(best(0, i, 1) for i in ls), *(best(1, j, 0) for j in rs))
    pick = lambda own, other: {m: min((e for e in edges if e[own] == m), key=lambda e: (-round(raw[e] + hint(*e), 12), e[other])) for m in {e[own] for e in edges}}
    to_right, to_left = pick(0, 1), pick(1, 0)
    fans = Counter(j for _, j in to_right.values())
    crowded = {j for j, c in fans.items() if config.max_right_candidate_fanout and c > config.max_right_candidate_fanout}
    to_right, to_left = ({m: e for m, e in way.items() if e[1] not in crowded} for way in (to_right, to_left))
    claims = defaultdict(list)
    for j, e in sorted(to_left.items()):
        if raw[e] >= config.match_threshold:
            claims[e[0]].append(j)
    for i, js in claims.items():
        if len(js) >= 2:
            records.append(("split", [i], js, max(raw[i, j] for j in js)))
    split_l, split_r = {r[1][0] for r in records if r[0] == "split"}, {j for r in records if r[0] == "split" for j in r[2]}
    claims = defaultdict(list)
    for i, e in sorted(to_right.items()):
        if raw[e] >= config.match_threshold and i not in split_l and e[1] not in split_r:
            claims[e[1]].append(i)
    for j, some in claims.items():
        if len(some) >= 2:
            records.append(("merge", some, [j], max(raw[i, j] for i in some)))
    taken_l = split_l | {i for r in records if r[0] == "merge" for i in r[1]}
    taken_r = split_r | {r[2][0] for r in records if r[0] == "merge"}
    for i, e in sorted(to_right.items()):
        if i not in taken_l:
            strong = raw[e] >= config.match_threshold and to_left.get(e[1]) == e and e[1] not in taken_r
            records.append(("strong_match" if strong else "possible_match", [i], [e[1]], raw[e]))
    seen_l, seen_r = {i for r in records for i in r[1]}, {j for r in records for j in r[2]}
    records += [("missing_in_right", [i], [], 0.0) for i in left if i not in seen_l] + [("new_in_right", [], [j], 0.0) for j in right if j not in seen_r]
    return records, {(j, fans[j]) for j in crowded}


@pytest.mark.parametrize(("seed", "fanout"), [(21, 0), (22, 2), (23, 1)])
def test_comparisons_equal_the_rules(spark, seed, fanout):
    rows = drawn(seed, 60, ("old", "new"))
    rows = [u | {"body_hash": u["body_hash"] + (u["project"] if i % 3 else "")} for i, u in enumerate(rows)]
    config = C.CompareConfig(candidate_threshold=0.93, match_threshold=0.985, top_k_per_unit=4, min_body_node_count=10, max_right_candidate_fanout=fanout)
    found = Comparison("old", "new").run(table(spark, rows), config)
    want, crowded = compared(rows, config)
    key = lambda r: (r[0], list(r[1]), list(r[2]), round(r[3], 6))
    got = [(r["class"], r["left"], r["right"], r["score"]) for r in found["records"].collect()]
    assert sorted(map(key, got)) == sorted(map(key, want)) and len({r[0] for r in want}) >= 5
    assert got == sorted(got, key=lambda r: (C.CLASSES.index(r[0]), -r[3], r[1], r[2]))
    assert {tuple(r) for r in found["suppressed"].collect()} == crowded
    assert {r["class"]: r["n"] for r in found["counts"].collect()} == {c: sum(r[0] == c for r in want) for c in C.CLASSES}
    classes = {i: r[0] for r in want for i in r[1]}
    for r in found["coverage"].collect():
        mine = [classes[i] for i, u in enumerate(rows) if u["project"] == "old" and r["group"] == ("/".join(folders(u)) if r["by"] == "directory" else u["language"])]
        assert (r["total_left"], r["possible"], r["missing"]) == (len(mine), mine.count("possible_match"), mine.count("missing_in_right"))
    for labels in (("old", "old"), ("old", "gone")):
        with pytest.raises(ValueError, match="project"):
            C.compare(table(spark, rows), *labels)


def test_many_projects_can_be_compared(spark):
    rows = [entry(f"p{i:04d}:a.go", f"b{i}", direction(i)) for i in range(1001)] + [entry("zz:a.go", "b0", direction(0))]
    counts = {r["class"]: r["n"] for r in C.compare(table(spark, rows), "p1000", "zz")["counts"].collect()}
    assert counts["missing_in_right"] == 1 and counts["new_in_right"] == 1


def test_margins(spark):
    edges = [(1, 1, 0.9, 0.0), (1, 2, 0.8, 0.2), (2, 1, 0.7, 0.0), (3, 1, 0.5, 0.0), (3, 2, 0.5, 0.0)]
    got = {r["l"]: (r["r"], r["margin"]) for r in C.best_edges(spark.createDataFrame(edges, "l int, r int, raw double, hint double"), "l", "r").collect()}
    assert got == {1: (2, pytest.approx(0.1)), 2: (1, math.inf), 3: (1, 0.0)}


def test_calibration_by_background(spark, monkeypatch):
    rng = np.random.default_rng(31)
    rows = [entry(f"{p}:f{i}.go", f"{p}{i}", (v := rng.normal(size=8)) is not None and (v / np.linalg.norm(v)).tolist(), name=f"n{i if i < 4 else i % 2}") for p in ("old", "new") for i in range(30)]
    x, y = (np.array([u["vector"] for u in rows if u["project"] == p]) for p in ("old", "new"))
    s = x @ y.T
    top = np.sort(s.max(axis=1))[int(29 * 0.95 + 0.5)]
    named = np.sort([s[i, i] for i in (2, 3)])[1]
    for anchor, wanted in (("top1_p95", top), ("same_name", named), ("hybrid", max(top, named))):
        config = C.CompareConfig(calibration="background", calibration_anchor=anchor, min_same_name_anchors=2)
        c = C.compare(table(spark, rows), "old", "new", config)["calibration"]
        assert c["background_mean"] == pytest.approx(s.mean()) and c["background_std"] == pytest.approx(s.std()) and c["effective_anchor"] == pytest.approx(wanted) and c["same_name_count"] == 2
        assert c["applied"] == (wanted - s.mean() >= 0.05)
        if c["applied"]:
            assert c["effective_candidate_threshold"] == pytest.approx(max(s.mean() + 0.78 * (wanted - s.mean()), s.mean() + 2 * s.std()))
    # more pairs than the sample: positions are drawn, alike however the draws are cut into rows
    few = [tuple(r) for r in C.sampled_pairs(spark, 13, 7, 50).collect()]
    monkeypatch.setattr(C, "DRAWS", 8)
    assert [tuple(r) for r in C.sampled_pairs(spark, 13, 7, 50).collect()] == few and all(0 <= i < 13 and 0 <= j < 7 for i, j in few) and len(set(few)) > 20
    drawn_scores = C._background(*(table(spark, rows).where(F.col("project") == p).select(F.col("unit_idx").alias("id"), F.col("vector").alias("v")) for p in ("old", "new")), 40)
    pairs = [tuple(r) for r in C.sampled_pairs(spark, 30, 30, 40).collect()]
    assert sorted(r["score"] for r in drawn_scores.collect()) == pytest.approx(sorted(s[i, j] for i, j in pairs))


def test_calibration_over_all_pairs(spark, tmp_path):
    # more than ten million pairs, none of them left out
    rng = np.random.default_rng(33)
    v = rng.normal(size=(6600, 4)) + [0.5, 0, 0, 0]
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    rows = spark.createDataFrame([(i, v[i].tolist(), i % 10) for i in range(len(v))], "vec_id bigint, embedding array<float>, label int")
    rows.write.parquet(f"{tmp_path}/embeddings.parquet")
    body = [i - 1 if i % 10 == 9 else i for i in range(len(v)) if i % 50 != 7]
    x, y = (v[[b for b, i in zip(body, (i for i in range(len(v)) if i % 50 != 7), strict=True) if i % 2 == side]].astype(float) for side in (0, 1))
    s = x @ y.T
    got = registry.QUERIES["a15_a17_calibration"](spark, str(tmp_path)).first()
    assert s.size > 10**7 and (got["pairs"], got["mean"], got["std"]) == (s.size, pytest.approx(s.mean(), abs=6e-7), pytest.approx(s.std(), abs=6e-7))
    # long vectors that lie close together, and a side without any
    near, far = (rng.normal(size=(n, 5)) * 1e-3 + 300 for n in (40, 7))
    left, right = (spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(z)], "id bigint, v array<double>") for z in (near, far))
    s = near @ far.T
    assert C.whole_background(left, right) == (280, pytest.approx(s.mean(), rel=1e-12), pytest.approx(s.std(), rel=1e-6))
    assert C.whole_background(left.limit(1), right.limit(1))[2] == 0 and C.whole_background(left, right.where("false"))[0] == 0


def test_all_but_the_top_and_the_spectrum(spark):
    rng = np.random.default_rng(32)
    x = rng.normal(size=(50, 7)) * [5, 3, 1, 1, 1, 0.5, 0.1] - 2
    units = table(spark, [entry(f"one:a.go#{i}", f"b{i}", v.tolist()) for i, v in enumerate(x)] + [entry("one:b.go", "none")])
    got = {r["unit_idx"]: r["vector"] for r in spectrum.all_but_the_top(units, 3).collect()}
    y = x - x.mean(axis=0)
    _, _, axes = np.linalg.svd(y, full_matrices=False)
    y = y - y @ axes[:3].T @ axes[:3]
    assert got.pop(50) is None and np.allclose([got[i] for i in range(50)], y / np.linalg.norm(y, axis=1, keepdims=True))
    values = np.linalg.eigvalsh(x.T @ x / 50)[::-1]
    share = values / values.sum()
    g = spectrum.gauge(units)
    assert (g["n"], g["top1_energy"], g["top3_energy"]) == (50, pytest.approx(share[0]), pytest.approx(share[:3].sum())) and g["effective_rank"] == pytest.approx(np.exp(-(share * np.log(share)).sum()))


def test_concerns(spark):
    rows = drawn(41, 40, ("one", "two"))
    queries = [("low", direction(0)), ("high", direction(80)), ("none", direction(0, -90))]
    kept = [tuple(r) for r in concerns.project(table(spark, rows), queries, 0.8, 5).collect()]
    for name, q in queries:
        scores = sorted(((-sum(a * b for a, b in zip(u["vector"], q, strict=True)), i) for i, u in enumerate(rows) if u["vector"]))
        want = [(i, at) for at, (s, i) in enumerate(scores, 1) if -s >= 0.8][:5]
        assert sorted((r[1], r[3]) for r in kept if r[0] == name) == sorted(want)
    got = {r["concern"]: r for r in concerns.spread(concerns.project(table(spark, rows), queries, 0.8, 5), table(spark, rows)).collect()}
    for name, r in got.items():
        members = [k[1] for k in kept if k[0] == name]
        dispersion, entropy = spread(rows, members)
        assert r["dispersion"] == pytest.approx(dispersion) and r["directory_entropy"] == pytest.approx(entropy) and r["files"] == len({(rows[m]["project"], rows[m]["relative_path"]) for m in members})


def _models(seed, n=40, d=6):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    return x, x + rng.normal(scale=0.3, size=(n, d))


def _side(spark, x):
    return spark.createDataFrame([(f"h{i:03d}", v.tolist()) for i, v in enumerate(x)], "body_hash string, vector array<double>")


def test_drift_and_agreement_of_models(spark):
    x, y = _models(51)
    u, w = (z / np.linalg.norm(z, axis=1, keepdims=True) for z in (x, y))
    report = drift.drift(_side(spark, x), _side(spark, y[:35]), top_k=4)
    cosines = np.sort((u * w).sum(axis=1)[:35])
    assert (report.baseline_count, report.candidate_count, report.shared, report.recall_queries) == (40, 35, 35, 35)
    assert report.cosine_min == pytest.approx(cosines[0]) and report.cosine_p50 == pytest.approx(cosines[17]) and report.max_abs_component_delta == pytest.approx(np.abs(u - w)[:35].max())
    near = lambda z: [set(np.argsort(-(row := z[:35] @ z[i]) + 9 * (np.arange(35) == i), kind="stable")[:4]) for i in range(35)]
    recall = np.mean([len(a & b) / 4 for a, b in zip(near(u), near(w), strict=True)])
    assert report.mean_neighbor_recall == pytest.approx(recall) and report.passes(-1, recall - 0.01) and not report.passes(0.9999, 0)
    assert drift.drift(_side(spark, x), _side(spark, 3 * x), top_k=4, sample=5).recall_queries == 5
    for wrong in (x[:, :3], None):
        with pytest.raises(ValueError):
            drift.drift(_side(spark, x), _side(spark, wrong) if wrong is not None else _side(spark, x).where("false"))
    shared = drift.aligned(_side(spark, x), _side(spark, y))
    got = experiments.agreement(shared, 0.5)
    delta = np.abs(u @ u.T - w @ w.T)[np.triu_indices(40, 1)]
    assert got["p95_pairwise_delta"] == pytest.approx(np.percentile(delta, 95)) and got["max_pairwise_delta"] == pytest.approx(delta.max()) and got["min_pooled_cosine"] == pytest.approx((u * w).sum(axis=1).min())
    assert experiments.pair_similarities(shared, 10).count() == 10 * 30 + 45
    score = lambda z: np.linalg.svd(z - z.mean(axis=0), full_matrices=False)[0][:, :4]
    want = np.linalg.svd(score(u).T @ score(w), compute_uv=False)
    assert experiments.canonical_correlations(shared, 4) == pytest.approx(want.tolist())
    tied = spark.createDataFrame([(float(a), float(b)) for a, b in [(1, 5), (2, 6), (2, 7), (4, 7), (9, 1)]], "a double, b double")
    assert experiments.spearman(tied, "a", "b") == pytest.approx(np.corrcoef([1, 2.5, 2.5, 4, 5], [2, 3, 4.5, 4.5, 1])[0, 1])


def test_separation_and_expected_clusters(spark):
    rows = [(i, direction(10 * i)) for i in range(6)]
    left, right = (spark.createDataFrame(rows, "id bigint, v array<double>") for _ in range(2))
    pairs = spark.createDataFrame([(0, 0), (1, 1), (2, 4), (3, 99)], "l bigint, r bigint")
    r = experiments.separation(left, right, pairs, 0.5, 0.25).first()
    cos = lambda a: math.cos(math.radians(a))
    assert r["gt_pairs"] == 3 and r["gt_top1_rate"] == pytest.approx(2 / 3) and r["gt_z_min"] == pytest.approx((cos(20) - 0.5) / 0.25) and r["gt_margin_mean"] == pytest.approx(((1 - cos(10)) * 2 + cos(20) - 1) / 3)
    members = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)], "unit_idx bigint, cluster bigint")
    expected = spark.createDataFrame([(1, 2), (2, 3), (4, 9)], "a bigint, b bigint")
    assert tuple(experiments.expected_clusters(members, expected, members.where("unit_idx in (2, 4, 5)")).first()) == (2, 3, 1, 1)


def test_contracts(spark):
    a = HashEmbedder(16).contract
    assert contract_diff(a, a) == [] and contract_diff(a, Contract("simlake", "other", "1", 32)) == ["model", "dimensions"]
    assert len(query_vector(spark, HashEmbedder(16), "open the door", a)) == 16 and query_vector(spark, HashEmbedder(4), "") == [0.0] * 4
    with pytest.raises(ValueError, match="dimensions"):
        query_vector(spark, HashEmbedder(8), "x", a)
    with pytest.raises(ValueError, match="query"):
        HashEmbedder().embed(F.lit("x"), "title")
