import hashlib
import random

import pytest
from pyspark.sql import functions as F

from simlake.llm import mixing


def water_level(sizes, weights=(5, 2, 1), cap=3):
    """Targets by resharing the excess until none is above its cap."""
    order = sorted(sizes, key=lambda s: (s is None, s))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        weight = sum(w[s] for s in order if s not in full)
        target = {s: cap * sizes[s] if s in full else w[s] * rest / weight for s in order}
        more = {s for s in order if s not in full and target[s] > cap * sizes[s]}
        if not more:
            return target
        full |= more


def test_targets_equal_resharing(spark):
    rng = random.Random(3)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i:02d}" if i else None: rng.choice([0, 1, 5, 80, 1000, 50_000]) for i in range(n)}
        sizes[None] = 7
        got = mixing.source_targets(spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")).collect()
        want = water_level(sizes)
        for r in got:
            assert abs(r["target"] - want[r["source"]]) < 1e-6 * (1 + want[r["source"]]), (sizes, r)


def test_odd_rows(spark, odd_docs, no_docs):
    rows = mixing.mix_counts(odd_docs).collect()
    assert len(rows) == 11
    for r in rows:
        assert r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_counts(odd_docs.repartition(7)).collect()))
    mixed = mixing.mix(odd_docs)
    assert mixed.columns == odd_docs.columns and mixed.count() == sum(r["copies"] for r in rows)
    assert set(map(str, mixed.collect())) <= set(map(str, odd_docs.collect()))
    assert mixing.mix_counts(no_docs).count() == 0 and mixing.mix(no_docs).count() == 0


def test_targets_are_met_when_the_order_is_refined(spark, monkeypatch):
    monkeypatch.setattr(mixing, "RANK_ROWS", 800)
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(["w"] * rng.randint(1, 60)), "ab"[i % 3 == 0]) for i in range(6000)], "doc_id bigint, text string, source string")
    fine = sorted(map(tuple, mixing.mix_counts(docs).collect()))
    by = {}
    for r in mixing.mix_counts(docs).collect():
        by.setdefault(r["source"], [r["target"], 0])[1] += r["taken"]
    assert all(abs(t - n) < 60 for t, n in by.values()), by
    monkeypatch.setattr(mixing, "RANK_ROWS", 10_000)
    assert fine == sorted(map(tuple, mixing.mix_counts(docs).collect()))


def greedy(rows):
    """Copies of each (source, id, size) by walking over each source's order, one lot after the other."""
    sizes = {}
    for source, _, n in rows:
        sizes[source] = sizes.get(source, 0) + n
    target, copies = water_level(sizes), {}
    for source, total in sizes.items():
        e = min(3.0, target[source] / total) if total else 0.0
        lots = {}
        for s, i, n in rows:
            if s == source:
                lots[i, n] = lots.get((i, n), 0) + 1
        gap, order = target[source] - sum(int(e) * n * k for (_, n), k in lots.items()), []
        for i, n in lots:
            u = (int(hashlib.md5(f"{'' if i is None else i}:mix".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            if e > int(e) and n:
                q = (u / (1 - u)) / ((e - int(e)) / (1 - (e - int(e))))
                order.append((q / (1 + q), "" if i is None else str(i), n, lots[i, n], i))
        copies |= {(source, i, n): int(e) for i, n in lots}
        for _, _, n, k, i in sorted(order, key=lambda o: o[:3]):
            if n * k <= gap:
                gap -= n * k
                copies[source, i, n] += 1
    return copies


@pytest.mark.parametrize("rank_rows", [10_000, 40])
def test_what_does_not_fit_is_passed_over(spark, monkeypatch, rank_rows):
    monkeypatch.setattr(mixing, "RANK_ROWS", rank_rows)
    rng = random.Random(8)
    rows = [("a", i, 40_000 if i == 50 else 100) for i in range(101)] + [("b", 1000 + i, rng.choice([1, 3, 10, 400, 5000])) for i in range(300)]
    rows += [("c", 2000 + i, rng.randint(0, 30)) for i in range(200)] + [(None, 3000 + i % 20, rng.choice([2, 50])) for i in range(200)] + [("", 5000, 7)] * 9 + [("d", None, 4)] * 3
    docs = spark.createDataFrame([(s, i, "w " * n) for s, i, n in rows], "source string, doc_id bigint, text string").withColumn("x", F.lit(1)).withColumn("gap", F.lit("g"))
    got = mixing.mix_counts(docs).collect()
    want = greedy(rows)
    assert {(r["source"], r["doc_id"], r["size"]): r["copies"] for r in got} == want
    taken, target = {}, {r["source"]: r["target"] for r in got}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    assert all(abs(target[s] - taken[s]) <= 100 for s in ("a", "b", "c"))
    assert mixing.mix(docs).count() == sum(r["copies"] for r in got)


def test_importance_changes_inclusion(spark):
    docs = spark.createDataFrame([(i, "w " * 10, "a", float(i % 2)) for i in range(400)], "doc_id bigint, text string, source string, quality double")
    rows = mixing.mix_counts(docs, importance="quality").collect()
    assert all(r["copies"] == 0 for r in rows if r["doc_id"] % 2 == 0) and all(r["copies"] == 2 for r in rows if r["doc_id"] % 2)
