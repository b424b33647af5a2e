import json
import os

import pytest
from pyspark.sql import functions as F

from simlake import cli
from simlake.functions.vectors import hash_embedding
from simlake.operators.reports import boilerplate_heavy, length_bucket, stable_id, stratified_split, token_report, write_split
from simlake.sources import config, offline
from simlake.sources.braces import brace_units, ruby_units
from simlake.sources.scan import ignore_rules, scan
from simlake.sources.store import Store
from simlake.streaming import incremental

RUST = """
// counts things { not a block }
pub struct Shelf<T> { items: Vec<T> }

impl<T> Display for Shelf<T> {
    fn put(&mut self, item: T) -> usize {
        if self.items.len() > 9 { self.items.clear(); }
        self.items.push(item); // "}"
        self.items.len()
    }
}

fn total(values: &[u32]) -> u32 {
    let brace = '}';
    values.iter().map(|v| { v + 1 }).sum()
}
"""
GO = """package main

func (s *Store) Load(name string) (int, error) {
	for i := 0; i < 3; i++ { s.try(name, "{") }
	return s.count, nil
}
"""
SCRIPT = """
class Cart extends Base {
  add(item, { price = 1 } = {}) {
    this.items.push({ item, price });
    return this.items.length;
  }
}
const sum = (list) => {
  let total = 0;
  for (const x of list) { total += x; }
  return total;
};
"""
RUBY = """module Shop
  class Cart
    def add(item)
      if item
        @items << item # end
      end
      @items.size
    end
  end
end
"""


@pytest.mark.parametrize(
    ("source", "want"),
    [
        (RUST, [("put", "Shelf", "method", 6, 10), ("total", None, "function", 13, 16)]),
        (GO, [("Load", "Store", "method", 3, 6)]),
        (SCRIPT, [("add", "Cart", "method", 3, 6), ("sum", None, "function", 8, 12)]),
        ("int add(int a, int b) {\n  // sum\n  return a + b;\n}\nint other(void);\nint naïve = 1; int last(int x) { while (x) { x--; } return x; }\n", [("add", None, "function", 1, 4), ("last", None, "function", 6, 6)]),
    ],
)
def test_units_between_braces(source, want):
    found = list(brace_units(source, 4, 10_000))
    assert sorted((u["name"], u["scope"], u["kind"], u["start_line"], u["end_line"]) for u in found) == sorted(want)
    for u in found:
        assert source.encode()[u["start_byte"] : u["end_byte"]].decode() == u["display_source"]
    changed = source.replace("// sum", "// another remark").replace("// counts", "/* x */ // counts").replace("\n", "\n ")
    assert [u["body_hash"] for u in brace_units(changed, 4, 10_000)] == [u["body_hash"] for u in found]
    assert not list(brace_units(source, 4, 5)) and not list(brace_units("}}{ fn ( {", 0, 99))


def test_units_of_ruby_and_shell():
    (u,) = ruby_units(RUBY, 3, 1000)
    assert (u["name"], u["scope"], u["kind"], u["start_line"], u["end_line"]) == ("add", "Shop.Cart", "method", 3, 8)
    (u,) = brace_units('# note {\nbuild() {\n  echo "a } b" # }\n  make all\n}\n', 2, 1000, shell=True)
    assert (u["name"], u["start_line"], u["end_line"]) == ("build", 2, 5)


def test_scan_keeps_to_ignore_files(spark, tmp_path):
    root = tmp_path / "a+b (c)"
    for name in ("main.go", "build/out.go", "src/build/x.go", "src/tmp.go", "src/keep.go", "src/deep/gen_a.go", "src/deep/gen_b.go", "docs/a.go"):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("package x")
    (root / ".gitignore").write_text("# made\nbuild/\n/src/tmp.go\ngen_*.go\n")
    (root / "src" / ".gitignore").write_text("!gen_b.go\n")
    seen = sorted(r["relative_path"] for r in scan(spark, "p", str(root), exclude=["docs/**"]).collect())
    assert seen == ["main.go", "src/deep/gen_b.go", "src/keep.go"]
    assert scan(spark, "p", str(root), ignore=False).count() == 8
    assert ignore_rules("\n# x\n!a/\n", "f/") == [("^f/(?:.*/)?a/.*$", True)]


def test_settings_from_yaml_and_environment(tmp_path):
    path = tmp_path / "conf" / "s.yaml"
    path.parent.mkdir()
    path.write_text("projects: {one: ../one}\nstore: /abs/store\ncomparison:\n  match_threshold: 0.9\n")
    c = config.load_file(str(path), {"SIMLAKE__COMPARISON__TOP_K_PER_UNIT": "3", "SIMLAKE__ANALYSIS__MAX_EDGES_PER_UNIT": "7", "OTHER": "x"})
    assert c.projects == {"one": str(tmp_path / "one")} and c.store == "/abs/store" and (c.comparison.match_threshold, c.comparison.top_k_per_unit, c.analysis.max_edges_per_unit) == (0.9, 3, 7)
    for text in ("projects: {one: x}\ncolour: red\n", "- a\n", "projects: [\n"):
        path.write_text(text)
        with pytest.raises(config.ConfigError):
            config.load_file(str(path), {})
    with pytest.raises(config.ConfigError):
        config.load({"projects": {"one": "x"}, "analysis": {"max_edges_per_unit": 0}})


UNIT = {"language": "go", "kind": "function", "name": "f", "scope": None, "start_byte": 0, "end_byte": 1, "start_line": 1, "end_line": 1, "body_node_count": 9, "display_source": "x", "implementation": "x y"}


def test_parts_and_additions_of_the_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    units = lambda project, *bodies: store.read("units").limit(0).unionByName(spark.createDataFrame([(i, project, "a.go", b) for i, b in enumerate(bodies)], "unit_idx bigint, project string, relative_path string, body_hash string").select("*", *(F.lit(v).alias(k) for k, v in UNIT.items())))
    store.write("units", units("one", "a", "b"), "one")
    store.write("units", units("two", "c"), "two")
    before = sorted(os.listdir(tmp_path / "store" / "units" / "two"))
    for bodies in (("a",), ("a", "d"), ("d",)):
        store.write("units", units("one", *bodies), "one")
        assert sorted(r["body_hash"] for r in store.read("units").collect()) == sorted([*bodies, "c"])
    assert sorted(os.listdir(tmp_path / "store" / "units" / "two")) == before and len([n for n in os.listdir(tmp_path / "store" / "units" / "one")]) == 2
    with pytest.raises(ValueError, match="project"):
        store.write("units", units("one", "a"))
    # an addition that was not committed does not count
    vectors = lambda *names: spark.createDataFrame([("s", n, [1.0]) for n in names], "space string, body_hash string, vector array<float>")
    store.append("embeddings", vectors("a"))
    store.append("embeddings", vectors("b"))
    os.remove(tmp_path / "store" / "embeddings" / "a000002" / "_SUCCESS")
    assert [r["body_hash"] for r in store.read("embeddings").collect()] == ["a"]
    store.append("embeddings", vectors("c"))
    store.write("embeddings", store.read("embeddings").where("body_hash != 'a'"))
    assert [r["body_hash"] for r in store.read("embeddings").collect()] == ["c"]
    for kind in ("x", "y"):
        store.log_run(kind, "m", [], {})
    assert sorted(r["kind"] for r in store.read("runs").collect()) == ["x", "y"]


def test_embedding_goes_on_where_it_broke_off(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    units = spark.createDataFrame([(f"b{i % 20}", f"text {i % 20}") for i in range(40)], "body_hash string, text string")
    embed = lambda todo: todo.select(F.lit("s").alias("space"), "body_hash", hash_embedding("text", 8).cast("array<float>").alias("vector"))
    pages = []

    def append(rows):
        if len(pages) == 2:
            raise RuntimeError("power cut")
        pages.append(rows.count())
        store.append("embeddings", rows)

    with pytest.raises(RuntimeError):
        incremental.embed_paged(incremental.pending(units, store.read("embeddings")), embed, append, page=4)
    done = store.read("embeddings").count()
    assert 0 < done == sum(pages) < 20
    assert incremental.embed_paged(incremental.pending(units, store.read("embeddings")), embed, lambda rows: store.append("embeddings", rows), page=100) == 20 - done
    assert store.read("embeddings").count() == 20 == store.read("embeddings").select("body_hash").distinct().count()


def test_strata_and_padding(spark, tmp_path):
    rows = [(1, "a", "f", "x" * 301, "a/f.go", None), (2, "a", "update", "y", "a/f_test.go", None), (3, "b", "g", "todo: assert", "b.go", None), (4, "b", "h", None, "b.go", None), (5, "b", "h", "z" * 2000, "b.go", None)]
    units = spark.createDataFrame(rows, "unit_idx bigint, language string, name string, text string, relative_path string, scope string")
    got = {r["unit_idx"]: r["stratum"] for r in stratified_split(units, 0.5).collect()}
    assert got == {1: "a/medium/prod/plain", 2: "a/short/prod/boilerplate", 3: "b/short/prod/boilerplate", 4: "b/short/prod/plain", 5: "b/near-max/prod/plain"}
    by_tokens = spark.createDataFrame([(9, 460), (9, 256), (9, 64), (9, 65), (600, None)], "chars int, tokens int").select(length_bucket("chars", "tokens")).collect()
    assert [r[0] for r in by_tokens] == ["near-max", "long", "short", "medium", "long"]
    assert [r[0] for r in units.orderBy("unit_idx").select(boilerplate_heavy("text", "name")).collect()] == [False, True, True, False, False]
    assert units.select(stable_id("unit_idx", "scope").alias("i")).distinct().count() == 5
    split = stratified_split(units, 0.5)
    write_split(split, units.drop("scope"), str(tmp_path / "split"))
    parts = [offline.read_jsonl(spark, str(tmp_path / "split" / p)) for p in ("calibration", "holdout") if any(f.endswith(".json") for f in os.listdir(tmp_path / "split" / p))]
    assert sum(p.count() for p in parts) == 5
    sizes = [3, 9, 9, 20, 700, 1]
    r = token_report(spark.createDataFrame([("a", n) for n in sizes], "language string, tokens int"), caps=(10, 100), batch=4).where("language = 'a'").first()
    cut = sorted(min(n, 100) for n in sizes)
    assert r["padding_waste"] == pytest.approx(1 - sum(cut) / (4 * max(cut[:4]) + 2 * max(cut[4:]))) and (r["over_10"], r["over_100"]) == (2, 1)


def test_more_commands(spark, tmp_path, capsys):
    settings = str(tmp_path / "s.yaml")
    run = lambda *args: (cli.main(["--config", settings, *args]), capsys.readouterr().out.strip())
    assert run("init")[0] == 0 and run("init")[0] == 1 and run("init", "--force")[0] == 0
    names = {r["language"]: r for r in json.loads(run("languages")[1])}
    assert names["rust"] == {"language": "rust", "extensions": ["rs"], "units": True} and json.loads(run("models")[1])[0]["dimensions"] == 256
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.rs").write_text(RUST)
    (tmp_path / "src" / "b.go").write_text(GO)
    (tmp_path / "s.yaml").write_text("source_dir: src\nstore: st\nmin_body_nodes: 4\nconcerns:\n  enabled: true\n  min_projection: 0.0\n  queries: [{name: counting, query: items len}, {name: absent, query: zebra}]\n")
    assert run("doctor")[0] == 1
    run("index")
    run("embed")
    code, said = run("doctor")
    assert code == 0 and all(c["ok"] for c in json.loads(said))
    lines = run("query", "units", "--text")[1].splitlines()
    assert len(lines) == 3 and any(line.endswith("main:a.rs:6-10 method put (Shelf)") for line in lines)
    unit = lines[0].split(" ")[0]
    assert len(run("query", "similar", unit, "--text")[1].splitlines()) == 2
    found = json.loads(run("query", "search", "items len", "--why", "--where", "language=rust")[1])
    assert found["items"][0]["name"] == "put" and found["items"][0]["why"]["decision"]["filters"] == ["language=rust"] and found["model"]["model"] == "hashed-words"
    report = json.loads(run("analyze", "concerns", "--json")[1])
    assert [i["name"] for i in report["items"]] == ["absent", "counting"] and report["items"][1]["units"][0]["name"] == "put" and report["items"][1]["spread"]["files"] >= 1
