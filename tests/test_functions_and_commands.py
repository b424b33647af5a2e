import json
import math
import os

import pytest
from pyspark.sql import functions as F

from simlake import cli
from simlake.functions import paths as P
from simlake.functions.vectors import hash_embedding, normalised, truncated
from simlake.operators.reports import token_report
from simlake.plans import registry
from simlake.query import queries as Q
from simlake.query.where import glob_pattern, parse
from simlake.sources import config
from simlake.sources.scan import python_units
from simlake.sources.store import Store, ignored_hashes, retained, unit_source
from simlake.streaming import incremental
from tests.helpers import direction, entry, table


def test_paths(spark):
    rows = spark.createDataFrame([("a/b/c.rs", "a/d/e.rs", 2), ("a/b/c.rs", "a/b/d.rs", 0), ("x.rs", "y.rs", 0), ("x.rs", "a/b/y.rs", 2), ("a/b.rs", "c/d/e/f.rs", 4)], "a string, b string, want int")
    assert all(r["got"] == r["want"] for r in rows.withColumn("got", P.path_distance("a", "b")).collect())
    names = {"src/a.rs": ("src", "src", False), "a.rs": ("", "a.rs", False), "tests/x/a.rs": ("tests/x", "tests", True), "a/test_x.py": ("a", "a", True), "a/b.spec.ts": ("a", "a", True), "a/contest.py": ("a", "a", False), "conftest.py": ("", "conftest.py", True), "a/x_test.go": ("a", "a", True), "Docs/a.md": ("Docs", "Docs", True)}
    got = spark.createDataFrame([(n,) for n in names], "p string").select("p", P.directory_of("p"), P.top_level_module("p"), P.is_test_or_docs_path("p")).collect()
    assert {r[0]: tuple(r[1:]) for r in got} == names
    u = spark.createDataFrame([("a/b.rs", "tests.inner", True), ("a/b.rs", None, False), ("a/b.rs", "mytests", False)], "relative_path string, scope string, want boolean")
    assert all(r["got"] == r["want"] for r in u.withColumn("got", P.is_test_or_docs_unit()).collect())
    assert spark.range(1).select(P.cluster_hash(F.array(F.lit("b"), F.lit("a")))).first()[0] == spark.range(1).select(P.cluster_hash(F.array(F.lit("a"), F.lit("b")))).first()[0]


def test_vectors(spark):
    row = spark.range(1).select(normalised(F.array(F.lit(3.0), F.lit(4.0))).alias("n"), normalised(F.array(F.lit(0.0))).alias("z"), truncated(F.array(F.lit(3.0), F.lit(4.0), F.lit(9.0)), 2).alias("t"), hash_embedding(F.lit("A b a!"), 16).alias("h"), hash_embedding(F.lit(" ."), 16).alias("e")).first()
    assert row["n"] == row["t"] == [0.6, 0.8] and row["z"] == [0.0] and row["e"] is None and math.isclose(sum(x * x for x in row["h"]), 1) and len(row["h"]) == 16


def test_where(spark):
    assert glob_pattern("a/*", True) == "^a/[^/]*$" and glob_pattern("a/**", True) == "^a/.*$"
    units = table(spark, [entry("v1:a/x.go", "h", name="load", scope="S"), entry("v1:a/b/x.go", "h", name="load_all"), entry("v2:c.go", "h", name="store", body_node_count=99)])
    pick = lambda *c: [r["unit_idx"] for r in units.where(parse(c)).orderBy("unit_idx").collect()]
    assert pick() == [0, 1, 2] and pick("path=a/*") == [0] and pick("path=a/**") == [0, 1] and pick("path=a/*", "path=c.go") == [0, 2]
    assert pick("name=load*", "project=v1") == [0, 1] and pick("min_nodes=50") == [2] and pick("scope=S") == [0]
    for bad in ("path", "colour=red"):
        with pytest.raises(ValueError):
            parse([bad])


def test_queries(spark):
    units = table(spark, [entry(f"m:{i}.go", f"h{i}", v) for i, v in enumerate([direction(0), direction(9), direction(90), None])])
    rows, matched = Q.similar(units, 0, limit=1)
    assert matched == 2 and [r["unit_idx"] for r in rows.collect()] == [1] and Q.envelope(rows, matched, 1) == {"matched": 2, "returned": 1, "exhaustive": False, "has_more": True}
    assert Q.similar(units, 0, threshold=0.9)[1] == 1 and Q.search(units, direction(90))[0].first()["unit_idx"] == 2
    with pytest.raises(ValueError):
        Q.similar(units, 3)
    with pytest.raises(Q.NotFound):
        Q.inspect(units, "unit:0000000000000000")
    wanted = Q.with_ids(units).first()["unit_id"]
    assert Q.inspect(units, wanted).count() == 1 and len(wanted) == 21
    why = Q.similar(units, 0, limit=1)[0].select(Q.why("score", {"unit": wanted}, ["kind=function"])).first()[0].asDict(True)
    assert why["evidence"] == [{"source": "vector", "unit": wanted}] and why["decision"] == {"reason": "vector_rank", "filters": ["kind=function"], "threshold": None, "suppressed": False} and why["scores"]["cosine"] == pytest.approx(math.cos(math.radians(9)))
    assert units.where("unit_idx = 0").select(Q.unit_line()).first()[0] == f"{wanted} m:0.go:1-3 function work"


def test_config():
    ok = config.load({"source_dir": "x", "analysis": {"candidate_threshold": 0.5}})
    assert ok.sources() == {"main": "x"} and ok.analysis.candidate_threshold == 0.5 and ok.comparison.match_threshold == 0.86
    bad = [{}, {"source_dir": "x", "projects": {"a": "b"}}, {"projects": {"a b": "x"}}, {"source_dir": "x", "colour": 1}, {"source_dir": "x", "analysis": {"candidate_threshold": 0.9}}, {"source_dir": "x", "retention": "none"}, {"source_dir": "x", "comparison": {"candidate_sigma_floor": 5}}, {"source_dir": "x", "concerns": {"enabled": True}}, {"source_dir": "x", "comparison": {"calibration": "magic"}}]
    for values in bad:
        with pytest.raises(config.ConfigError):
            config.load(values)


def test_token_report_and_statuses(spark):
    rows = spark.createDataFrame([("a", x) for x in (1, 2, 3, 600)] + [("b", 5)], "language string, tokens int")
    got = {r["language"]: r for r in token_report(rows).collect()}
    assert (got["a"]["p50"], got["a"]["p90"], got["a"]["max_tokens"], got["a"]["over_512"]) == (3, 600, 600, 1) and got["ALL"]["units"] == 5
    f = "project string, relative_path string, mtime_ns bigint, size bigint, source_hash string"
    old = spark.createDataFrame([("p", "a", 1, 1, "x"), ("p", "b", 1, 1, "x"), ("p", "c", 1, 1, "x"), ("p", "d", 1, 1, "x")], f)
    new = spark.createDataFrame([("p", "a", 1, 1, "x"), ("p", "b", 2, 1, "x"), ("p", "c", 2, 1, "y"), ("p", "e", 1, 1, "x")], f)
    assert {r["relative_path"]: r["status"] for r in incremental.changes(old, new).collect()} == {"a": "unchanged", "b": "unchanged", "c": "changed", "d": "removed", "e": "new"}


def _pages(spark, folder):
    """Pages by number, of which some have no html, some no address and some an address of their own twice or three times."""
    rows = [(i, None if i % 22 == 0 else f"u{i // 3 if i in (8, 9, 10, 30, 31, 32) else 1000 + i}", None if i % 4 == 1 else f"<p>{i % 5}</p>") for i in range(1, 90)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame([(i, [1.0], 1) for i in range(13)], "vec_id bigint, embedding array<float>, label int").write.parquet(f"{folder}/embeddings.parquet")
    urls = [u for _, u, _ in rows]
    once = [(i, u) for i, u, _ in rows if urls.count(u) == 1]
    return [(u, "new" if i % 5 == 0 else "removed" if i % 7 == 0 else "changed" if i % 6 == 0 else "unchanged") for i, u in once if i % 5 or i % 7]


def test_index_stats_over_addresses_with_several_pages(spark, tmp_path):
    states = [s for _, s in _pages(spark, tmp_path)]
    got = registry.QUERIES["a4_index_stats"](spark, str(tmp_path)).first()
    assert tuple(got) == (states.count("new") + states.count("changed"), states.count("unchanged"), states.count("removed"), 13)


def test_changes_over_addresses_with_several_pages(spark, tmp_path):
    states = _pages(spark, tmp_path)
    got = [tuple(r) for r in registry.QUERIES["j17_changes"](spark, str(tmp_path)).collect()]
    assert sorted(got) == sorted(("main", u, s) for u, s in states) and {s for _, s in states} == {"new", "removed", "changed", "unchanged"}


@pytest.mark.parametrize("odd", ["addresses with several pages", "no html", "no address"])
def test_changes_equal_their_sql(spark, tmp_path, odd):
    import duckdb

    several, empty, nowhere = (odd == x for x in ("addresses with several pages", "no html", "no address"))
    rows = [(i, None if nowhere and i == 11 else f"u{i // 3 if several and i < 30 else 1000 + i}", None if empty and i % 4 == 1 else f"<p>{i % 5}</p>") for i in range(1, 90)]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    want = db.execute(registry.ORACLE["j17_changes"]).fetchall()
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in registry.QUERIES["j17_changes"](spark, str(tmp_path)).collect())


SOURCE = '''import os


class Inventory:
    def restock(self, items):
        """Restock."""
        # merge
        for name, count in items:
            self.ledger[name] = self.ledger.get(name, 0) + count
        return len(self.ledger)


def report(inventory):
    def format_line(name, count):
        label = name.upper()
        return f"{label.ljust(20)} {count}"

    return [format_line(n, c) for n, c in inventory.items()]


def tiny():
    return 1
'''


def test_extraction(spark):
    found = list(python_units(SOURCE, 8, 10_000))
    assert [(u["name"], u["scope"], u["start_line"], u["end_line"]) for u in found] == [("restock", "Inventory", 5, 10), ("report", None, 13, 18), ("format_line", None, 14, 16)]
    assert all(SOURCE.encode()[u["start_byte"] : u["end_byte"]].decode() == u["display_source"] for u in found)
    spaced = SOURCE.replace("# merge", "# another comment").replace("        return len", "\n        return  len")
    assert [u["body_hash"] for u in python_units(spaced, 8, 10_000)] == [u["body_hash"] for u in found] and not list(python_units("def (", 1, 10))


def test_stream_embeds_each_body_once(spark, tmp_path):
    schema = "body_hash string, text string"
    src = str(tmp_path / "in")
    embed = lambda todo: todo.select("body_hash", hash_embedding("text", 8).alias("vector"))
    for rows in ([("a", "x y"), ("a", "x y"), ("b", "z")], [("b", "z"), ("c", "w")]):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(src)
        incremental.embed_stream(spark.readStream.schema(schema).parquet(src), str(tmp_path / "out"), str(tmp_path / "cp"), embed).awaitTermination()
    assert sorted(r["body_hash"] for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b", "c"]


def test_commands_end_to_end(spark, tmp_path, capsys):
    for project, text in (("v1", SOURCE), ("v2", SOURCE.replace("restock", "refill").replace("upper()", "lower()"))):
        os.makedirs(tmp_path / project / "pkg")
        (tmp_path / project / "pkg" / "inventory.py").write_text(text)
        (tmp_path / project / "pkg" / "skip_me.py").write_text(text)
    settings = {"projects": {p: str(tmp_path / p) for p in ("v1", "v2")}, "store": str(tmp_path / "store"), "exclude": ["**/skip_*"], "analysis": {"candidate_threshold": 0.5, "similarity_threshold": 0.6, "rerank_threshold": 0.7, "min_semantic_body_node_count": 5}}
    (tmp_path / "settings.json").write_text(json.dumps(settings))

    def run(*args):
        code = cli.main(["--config", str(tmp_path / "settings.json"), *args])
        lines = capsys.readouterr().out.strip().splitlines()
        return code, json.loads(lines[-1]) if lines and lines[-1][0] in "[{" else lines

    assert run("index")[1] == [{"project": p, "indexed": 1, "skipped": 0, "removed": 0, "units": 3} for p in ("v1", "v2")]
    assert run("query", "capabilities")[1] == {"units": 6, "bodies": 5, "embedded": 0, "pending": 5, "can_list": True, "can_search": False}
    assert run("embed")[1] == {"embedded": 5} and run("embed")[1] == {"embedded": 0}
    assert [s["skipped"] for s in run("index")[1]] == [1, 1]
    (tmp_path / "v1" / "pkg" / "inventory.py").write_text(SOURCE.replace("tiny", "small"))
    assert [s["indexed"] for s in run("index")[1]] == [1, 0]
    _, listed = run("query", "units", "--where", "project=v1", "--limit", "2")
    assert listed["summary"] == {"matched": 3, "returned": 2, "exhaustive": False, "has_more": True}
    _, near = run("query", "similar", listed["items"][0]["unit_id"], "--limit", "5")
    assert near["summary"]["matched"] == 5 and near["items"][0]["score"] >= near["items"][-1]["score"]
    assert run("query", "search", "ledger name count")[1]["summary"]["matched"] == 6
    _, found = run("analyze", "--json")
    assert found["items"] and found["items"][0]["cluster_id"].startswith("cluster:")
    run("analyze", "--out", str(tmp_path / "report"))
    index = (tmp_path / "report" / "duplicates" / "index.md").read_text()
    assert found["items"][0]["cluster_id"][8:] in index and (tmp_path / "report" / "duplicates" / "cluster-01.md").exists()
    _, cmp = run("compare", "--left", "v1", "--right", "v2", "--json")
    assert cmp["summary"]["exact_copy"] == 1 and all(i["match_id"].startswith("match:") for i in cmp["items"])
    run("compare", "--left", "v1", "--right", "v2", "--out", str(tmp_path / "report"))
    assert "Exact copies" in (tmp_path / "report" / "compare" / "index.md").read_text()
    code, same = run("drift", "--baseline", str(tmp_path / "store"), "--candidate", str(tmp_path / "store"), "--top-k", "2", "--min-cosine", "0.99")
    assert code == 0 and same["cosine_min"] == pytest.approx(1)
    store = Store(spark, str(tmp_path / "store"))
    assert store.read("runs").count() == 4 and run("tokens")[1][-1]["units"] > 0
    with pytest.raises(LookupError):
        store.context(["nope"])
    os.remove(tmp_path / "v2" / "pkg" / "inventory.py")
    assert [s["removed"] for s in run("index", "--project", "v2")[1]] == [1] and store.read("units").count() == 3


def test_store_helpers(spark, tmp_path):
    (tmp_path / "ignore").write_text("# reviewed\nabc # why\n\nabc\ndef\n")
    assert sorted(r["hash"] for r in ignored_hashes(spark, str(tmp_path / "ignore")).collect()) == ["abc", "def"] and ignored_hashes(spark, str(tmp_path / "none")).count() == 0
    units = spark.createDataFrame([(1, "p", "a", 2, 5, "shown", "body"), (2, "p", "a", 2, 5, None, None)], "unit_idx bigint, project string, relative_path string, start_byte bigint, end_byte bigint, display_source string, implementation string")
    for kind, want in (("full", ("shown", "body")), ("report", ("shown", None)), ("minimal", (None, None))):
        r = retained(units, kind).where("unit_idx = 1").first()
        assert (r["display_source"], r["implementation"]) == want
    files = spark.createDataFrame([("p", "a", bytearray("abédef".encode()))], "project string, relative_path string, content binary")
    assert {r["unit_idx"]: r["source"] for r in unit_source(units, files).collect()} == {1: "shown", 2: "éd"}
