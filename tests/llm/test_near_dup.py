import random
from collections import Counter, defaultdict
from functools import partial

import numpy as np

from simlake.llm import near_dup
from simlake.operators.graph import UnionFind


def brute(rows, k, percent=80):
    """Component of each id by comparing all sets."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    joined, where = UnionFind(), defaultdict(list)
    for i, s in sets.items():
        for j, n in Counter(j for x in s for j in where[x]).items():
            if 100 * n >= percent * (len(s) + len(sets[j]) - n):
                joined.join(i, j)
        for x in s:
            where[x].append(i)
    return {i: joined.find(i) for i in sets}, {i: len(s) for i, s in sets.items()}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2**63, 1200).astype(np.uint64)
    b = np.concatenate([a[:900], rng.integers(0, 2**63, 300).astype(np.uint64)])
    h = near_dup.superminhash(np.concatenate([a, b]), np.repeat([0, 1], 1200), 2, 240)
    assert abs((h[0] == h[1]).mean() - 900 / 1500) < 0.12
    # a text in several chunks has the signature of its whole set
    x = rng.integers(0, 2**63, 3 * near_dup.CHUNK).astype(np.uint64)
    y = rng.permutation(x)
    assert (near_dup.superminhash(x, np.zeros(len(x), int), 1, 64) == near_dup.superminhash(y, np.zeros(len(y), int), 1, 64)).all()


def test_bitmaps_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(50):
        a = np.unique(rng.integers(0, 2**63, 200).astype(np.uint64))
        b = np.unique(np.concatenate([a[: rng.integers(1, 200)], rng.integers(0, 2**63, rng.integers(1, 200)).astype(np.uint64)]))
        x, y = near_dup._bitmaps([a, b])
        apart = sum(bin(int(p) & (2**64 - 1)).count("1") for p in x ^ y)
        assert apart <= len(np.setxor1d(a, b))


def test_components_equal_brute_force(spark):
    rng = random.Random(4)
    rows, vocabulary = [], [f"v{i}" for i in range(400)]
    for group in range(25):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(3, 80))]
        for _ in range(rng.choice([1, 1, 2, 9])):
            rows.append((len(rows), " ".join(w if rng.random() > rng.choice([0, 0.02, 0.1]) else rng.choice(vocabulary) for w in base)))
        if group % 4 == 0:
            rows.append((len(rows), rows[-1][1].upper()))
    want, sizes = brute(rows, 2)
    got = {r["doc_id"]: r for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert {i: r["n_shingles"] for i, r in got.items()} == sizes
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


def test_a_common_passage_does_not_link(spark):
    """Many texts share most of their words but not enough; a few link: later rounds must find them."""
    rng = random.Random(6)
    shared = [f"s{i}" for i in range(70)]
    rows = [(i, " ".join(shared + [f"u{i}_{j}" for j in range(12)])) for i in range(150)]
    rows += [(200 + i, " ".join(shared + [f"u{i}_{j}" for j in range(12)][: rng.randint(9, 12)])) for i in range(0, 150, 10)]
    want, _ = brute(rows, 2)
    got = {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), k=2).collect()}
    assert got == want


def test_odd_rows(spark, odd_docs, no_docs):
    rows = near_dup.near_duplicates(odd_docs, k=5).collect()
    assert len(rows) == 11
    by = defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
    assert all(r["component_id"] == 1 for i in (1, 2) for r in by[i]) and [r["kept"] for r in by[1]] == [True, True] and not by[2][0]["kept"]
    assert all(by[i][0]["n_shingles"] == 0 and by[i][0]["kept"] for i in (3, 4, 5)) and by[8][0]["n_shingles"] == 1
    assert [(r["component_id"], r["kept"]) for r in by[None]] == [(None, True)] * 2
    assert near_dup.near_duplicates(no_docs).count() == 0
    kept = near_dup.deduplicated(odd_docs)
    # of the two equal rows of id 1 and its copy, id 2, one stays
    assert kept.columns == odd_docs.columns and kept.count() == 9 and kept.where("doc_id in (1, 2)").count() == 1 and kept.where("doc_id is null").count() == 2
    assert near_dup.deduplicated(no_docs).count() == 0


def test_repeated_ids_with_unlike_texts(spark):
    """An id with two texts is one node, so it joins their groups; as rows, no text is lost."""
    t, u = " ".join(f"t{i}" for i in range(30)), " ".join(f"u{i}" for i in range(30))
    rows = [(3, t), (5, t), (5, u), (9, u), (9, ""), (11, ""), (12, t + " t30"), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in near_dup.near_duplicates(docs, k=2).collect())
    assert got == [(3, 29, 3, True), (5, 0, 3, False), (5, 29, 3, False), (5, 29, 3, False), (9, 0, 3, False), (9, 29, 3, False), (11, 0, 11, True), (12, 30, 3, False)]
    kept = sorted((r["doc_id"], r["text"]) for r in near_dup.deduplicated(docs, k=2).collect())
    assert kept == sorted([(3, t), (5, u), (9, ""), (11, ""), (5, "")])


def test_rows_of_one_group_that_repeat_the_smallest_id(spark):
    """Equal sets, one id, spelled differently: one row stays."""
    docs = spark.createDataFrame([(1, "a b c d e f g h"), (1, "A b c d e f g h"), (1, "a b c d e f g h"), (2, "a b c d e f g H")], "doc_id bigint, text string")
    assert [r["doc_id"] for r in near_dup.deduplicated(docs, k=2).collect()] == [1]


def test_star_groups_and_blocks(spark, monkeypatch):
    """Copies that link with one text only, and not with each other; the last round in several blocks."""
    monkeypatch.setattr(near_dup, "HEADS", 0)
    rng = random.Random(3)
    rows = []
    for group in range(3):
        base = [f"g{group}w{i}" for i in range(60)]
        copies = []
        for c in range(40):
            at = sorted(rng.sample(range(60), 3))
            copies.append(" ".join(f"x{group}_{c}_{i}" if i in at else w for i, w in enumerate(base)))
        for t in [*copies[:20], " ".join(base), *copies[20:]]:
            rows.append((len(rows), t))
    want, _ = brute(rows, 2)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (near_dup.BLOCK, 7):
        monkeypatch.setattr(near_dup, "_rest_pairs", partial(near_dup._rest_pairs.func if isinstance(near_dup._rest_pairs, partial) else near_dup._rest_pairs, block=block))
        assert {r["doc_id"]: r["component_id"] for r in near_dup.near_duplicates(docs, k=2).collect()} == want
