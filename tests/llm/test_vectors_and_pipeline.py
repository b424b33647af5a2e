import math
import random

import numpy as np
import pytest

from simlake.llm import vector_dedup
from simlake.operators.graph import UnionFind


def brute(rows, limit=0.98):
    sets, links = UnionFind(), {}
    for a, (i, v, label) in enumerate(rows):
        for b, (j, w, other) in enumerate(rows):
            if a < b and label is not None and label == other and good(v) and good(w) and len(v) == len(w):
                x, y = np.array(v, float), np.array(w, float)
                if x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= limit:
                    links[a], links[b] = links.get(a, 0) + 1, links.get(b, 0) + 1
                    sets.join(i, j)
    return links, sets


def good(v):
    return v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v)


def made(n, seed):
    rng = random.Random(seed)
    rows = []
    while len(rows) < n:
        base = [rng.gauss(0, 1) for _ in range(16)]
        label = rng.choice([0, 0, 0, 1, None])
        for _ in range(rng.choice([1, 1, 3, 12])):
            noise = rng.choice([0, 0.03, 0.06])
            rows.append((len(rows), [x + rng.gauss(0, noise) for x in base], label))
    return rows


@pytest.mark.parametrize("region", [16384, 150])
def test_links_equal_brute_force(spark, monkeypatch, region):
    monkeypatch.setattr(vector_dedup, "REGION", region)  # regions are split on the driver's plan; centroids are fitted with it too
    rows = made(600, 1)
    rows += [(len(rows) + k, v, 0) for k, v in enumerate([None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [-0.0] + [1.0] * 15, [0.0] + [1.0] * 15])]
    links, sets = brute(rows)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    f32 = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v], label) for i, v, label in rows]
    links, sets = brute(f32)
    assert {i: r["n_links"] for i, r in got.items()} == {i: links.get(i, 0) for i, _, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == {i: sets.find(i) for i, _, _ in rows}
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_split_labels_lose_no_pair(spark, monkeypatch):
    """One dense group and looser ones, each label beyond the region, so that cells, pieces and guests all occur."""
    monkeypatch.setattr(vector_dedup, "REGION", 60)
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=16) + rng.normal(scale=0.13, size=(300, 16)), np.repeat(rng.normal(size=(60, 16)), 5, axis=0) + rng.normal(scale=0.14, size=(300, 16))])
    rows = [(i, np.float32(v).tolist(), i % 2 if i < 550 else 2) for i, v in enumerate(x)]
    links, sets = brute(rows)
    got = {r["vec_id"]: r for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int")).collect()}
    assert sum(links.values()) > 5000
    assert {i: r["n_links"] for i, r in got.items()} == {i: links.get(i, 0) for i, _, _ in rows}
    assert {i: r["component_id"] for i, r in got.items()} == {i: sets.find(i) for i, _, _ in rows}


def test_guest_tasks_lose_no_link():
    """What a piece and its guests count equals brute force, and so do blocks within a piece."""
    rng = np.random.default_rng(6)
    x = vector_dedup.unit_rows(np.repeat(rng.normal(size=(40, 16)), 30, axis=0) + rng.normal(scale=0.1, size=(1200, 16)))
    copies = rng.integers(1, 4, 1200)
    near = (x @ x.T >= 0.98) & ~np.eye(1200, dtype=bool)
    counts, root = vector_dedup.block_links(x, copies, 0.98)
    assert (counts == near @ copies).all()
    sets = UnionFind()
    for i, j in np.argwhere(near).tolist():
        sets.join(i, j)
    assert root.tolist() == [sets.find(i) for i in range(1200)]
    counts, _ = vector_dedup.block_links(x[:500], copies[:500], 0.98, x[500:], copies[500:])
    assert (counts == np.concatenate([near[:500, 500:] @ copies[500:], near[500:, :500] @ copies[:500]])).all()


def test_links_of_a_dense_group_are_whole(spark, monkeypatch):
    """Near copies far beyond a region: with several centroids in the workers, every link is still counted."""
    monkeypatch.setattr(vector_dedup, "REGION", 4000)
    rng = np.random.default_rng(8)
    x = np.float32(rng.normal(size=16) + rng.normal(scale=0.13, size=(9000, 16)))
    got = vector_dedup.near_vectors(spark.createDataFrame([(i, v.tolist(), 0) for i, v in enumerate(x)], "vec_id bigint, embedding array<float>, label int")).collect()
    u = vector_dedup.unit_rows(x.astype(np.float64))
    want = np.concatenate([(u[i : i + 500] @ u.T >= 0.98 - 1e-9).sum(axis=1) - 1 for i in range(0, 9000, 500)])
    assert {r["vec_id"]: r["n_links"] for r in got} == dict(enumerate(want.tolist()))


def test_odd_vectors(spark):
    schema = "vec_id bigint, embedding array<float>, label int, key string, id string"
    rows = [(None, [1.0, 0.0], 1, "a", "b"), (5, [1.0, 0.0], 1, "a", "b"), (5, [1.0, 0.0], 1, "a", "b"), (6, [1.0, 0.001], 1, None, None), (7, [1.0, 0.0], None, "a", "b")]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert sorted((str(r["vec_id"]), r["n_links"], str(r["component_id"]), r["kept"]) for r in got) == [("5", 2, "5", True), ("5", 2, "5", True), ("6", 2, "5", False), ("7", 0, "7", True), ("None", 0, "None", True)]
    assert vector_dedup.near_vectors(spark.createDataFrame([], schema)).count() == 0


def test_graph_search_recall():
    rng = np.random.default_rng(3)
    x = vector_dedup.unit_rows(np.repeat(rng.normal(size=(500, 32)), 4, axis=0) + rng.normal(scale=0.03, size=(2000, 32)))
    graph = vector_dedup.build(x)
    queries = np.arange(0, 2000, 20)
    a, b = vector_dedup.range_search(x, graph, queries, 0.95, vector_dedup.BEAM, vector_dedup.MARGIN)
    truth = {(i, j) for i in queries.tolist() for j in np.flatnonzero(x @ x[i] >= 0.95).tolist()}
    got = set(zip(a.tolist(), b.tolist(), strict=True))
    assert got <= truth and len(got) >= 0.9 * len(truth) and np.diff(graph[0]).max() < 400


def test_pruned_neighbours_are_not_closer_to_a_kept_one():
    rng = np.random.default_rng(4)
    x = vector_dedup.unit_rows(rng.normal(size=(60, 5)))
    sims = x @ x.T
    np.fill_diagonal(sims, -2)
    top = np.argsort(-sims, axis=1)[:, :20]
    kept = vector_dedup.robust_prune(sims, top, degree=6)
    for row in range(60):
        mine = []
        for other in top[row]:
            far = np.sqrt(2 - 2 * sims[row, other])
            if len(mine) < 6 and all(1.2 * np.sqrt(max(0, 2 - 2 * sims[m, other])) > far for m in mine):
                mine.append(other)
        assert top[row][kept[row]].tolist() == mine


def test_the_limit_is_kept(spark):
    """Cosines a little below the limit do not link, in graph and blocks alike; at the limit they do."""
    def at(cosine):
        return [cosine, math.sqrt((1 - cosine) * (1 + cosine)), 0.0, 0.0]

    rows = [(0, [1.0, 0.0, 0.0, 0.0], "a"), (1, at(0.9799999995), "a"), (2, [1.0, 0.0, 0.0, 0.0], "b"), (3, at(0.9800000005), "b"), (4, [3.0, 4.0, 0.0, 0.0], "c"), (5, [4.0, 3.0, 0.0, 0.0], "c")]
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label string")).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 1, 4: 0, 5: 0}
    equal = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_vectors(spark.createDataFrame(rows[4:], "vec_id bigint, embedding array<double>, label string"), limit=0.96).collect()}
    assert equal == {4: 1, 5: 1}  # 24 / 25 exactly
    counts, _ = vector_dedup.block_links(np.array([r[1] for r in rows[:2]]), np.ones(2, int), 0.98)
    assert counts.tolist() == [0, 0]


def test_one_direction_is_one_class(spark):
    rng = np.random.default_rng(9)
    base = rng.normal(size=24)
    rows = [(i, (base * 2.0 ** (i % 40 - 20)).tolist(), 1) for i in range(3000)] + [(3000, (-base).tolist(), 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["recall"]) for r in vector_dedup.near_vectors(df).collect()}
    assert got == {i: (2999, 0, 1.0) for i in range(3000)} | {3000: (0, 3000, 1.0)}


def test_repeated_ids_are_one_node(spark):
    t, u = [1.0, 0.0], [0.0, 1.0]
    rows = [(3, t, 1), (5, t, 1), (5, u, 1), (9, u, 1), (9, None, 1), (7, u, 2)]
    got = sorted((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int")).collect())
    assert got == [(3, 1, 3, True), (5, 1, 3, False), (5, 1, 3, False), (7, 0, 7, True), (9, 0, 3, False), (9, 1, 3, False)]


def test_pipeline_against_its_parts(spark, odd_docs, tmp_path):
    """Each stage's decision is taken again without Spark on what the stage before it wrote."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    import tiktoken

    import public_tokenizers
    from simlake.llm import bpe, pii, toxicity
    from tests.llm.test_near_dup import brute as near_brute

    rng = random.Random(9)
    words = ["".join(rng.choice(["ka", "lo", "mi", "ten", "sor"]) for _ in range(3)) for _ in range(120)]
    texts = [" ".join(rng.choice(words) for _ in range(40)) + (" idiot" if i % 4 == 0 else "") + (f" 17.252.227.{i}" if i % 3 == 0 else "") for i in range(80)]
    texts += [t + " end" for t in texts[1:20:2]]
    rows = [(100 + i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").unionByName(odd_docs.select("doc_id", "text", "lang", "source", "n_chars"))
    d = str(tmp_path)
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(100 + i, 1, int("idiot" in t)) for i, t in enumerate(texts)], "doc_id bigint, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    stages = {"documents": spark.read.parquet(f"{d}/documents.parquet")}
    last = stages["documents"]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, last, d).write.parquet(f"{d}/{name}")
        stages[name] = last = spark.read.parquet(f"{d}/{name}")
    rows_of = lambda n: sorted((str(r["doc_id"]), str(r["text"]), str(r["source"])) for r in stages[n].collect())
    scorer = toxicity.Scorer(toxicity.fit(stages["documents"], spark.read.parquet(f"{d}/labels.parquet")))
    assert rows_of("toxicity") == [r for r in rows_of("documents") if scorer.score("" if r[1] == "None" else r[1]) < 0.3]
    assert sum("idiot" in t for _, t, _ in rows_of("toxicity")) <= 5 and len(rows_of("toxicity")) > 50
    home, _ = near_brute([(int(i), None if t == "None" else t) for i, t, _ in rows_of("toxicity") if i != "None"], 5)
    want = sorted({r for r in rows_of("toxicity") if r[0] != "None" and home[int(r[0])] == int(r[0])}) + [r for r in rows_of("toxicity") if r[0] == "None"]
    assert rows_of("near_duplicates") == sorted(want)
    p = pii.Pseudonyms(pii.TEST_KEY)
    assert rows_of("pii") == sorted((i, p.apply(t)[0], s) for i, t, s in rows_of("near_duplicates"))
    assert set(rows_of("mixing")) <= set(rows_of("pii")) and max(rows_of("mixing").count(r) for r in set(rows_of("mixing")) if r[0] != "None") <= 3
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.ranks_of(path), special_tokens={})
    assert sorted(r["n_tokens"] for r in stages["bpe"].collect()) == sorted(len(library.encode_ordinary("" if t == "None" else t)) for _, t, _ in rows_of("mixing"))
    assert corpus_pipeline.run(spark, d).count() == stages["bpe"].count()


def test_pipeline_of_empty_tables(spark, tmp_path):
    """Without documents there is nothing; without labels no document is toxic.  Tables of others are left alone."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    from simlake.plans.staging import staged

    docs, labels = "doc_id bigint, text string, lang string, source string, n_chars bigint", "doc_id bigint, quality int, toxic int"
    other = staged(spark.range(3), "other")
    for name, rows in (("none", []), ("some", [(1, "one two three", "en", "a", 13), (2, None, None, None, None), (2, "", "en", "a", 0), (None, "x", "en", "b", 1)])):
        spark.createDataFrame(rows, docs).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], labels).write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = corpus_pipeline.run(spark, f"{tmp_path}/{name}").collect()
        # a source of one document may lack its share of words, so not each is in the mix; empty ones are taken by whole parts
        assert (not got) if not rows else {r["doc_id"] for r in got} <= {1, 2, None}
    assert other.count() == 3


def test_no_text_is_lost_with_repeated_ids(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    docs = spark.createDataFrame([(3, t, "en", "a", 1), (5, t, "en", "a", 1), (5, u, "en", "a", 1), (9, u, "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(3, t), (5, u)]
