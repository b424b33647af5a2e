"""Commands: init, index, embed, tokens, analyze, compare, drift, query, languages, models, doctor and run, over one store.

``python -m simlake.cli --config settings.yaml COMMAND``; settings are YAML or JSON.
"""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.analyze import concerns, drift, duplicates
from simlake.analyze.compare import compare
from simlake.operators.index import HashEmbedder, query_vector
from simlake.operators.reports import token_report
from simlake.query import queries as Q
from simlake.report import render
from simlake.sources import config as settings
from simlake.sources.scan import EXTRACTORS, LANGUAGES, extract, scan
from simlake.sources.store import Store, ignored_hashes, retained
from simlake.streaming import incremental

SPACE = "default/implementation"


def index(store: Store, config: settings.Config, only: str | None = None) -> list[dict]:
    """Bring files and units up to date; one row of counts for each project."""
    out = []
    for label, root in config.sources().items():
        if only and label != only:
            continue
        seen = scan(store.spark, label, root, languages=config.languages or None, exclude=config.exclude)
        known, units = store.read("files"), store.read("units")
        own = F.col("project") == label
        status = incremental.changes(known.where(own), seen)
        todo = seen.join(status.where("status in ('new', 'changed')").select("project", "relative_path"), ["project", "relative_path"], "left_semi")
        found = retained(extract(todo, least_nodes=config.min_body_nodes, most_chars=config.max_body_chars), "full")
        new_units = incremental.refreshed(units.where(own), status, found.select(*units.columns))
        stats = incremental.index_stats(status, new_units).first().asDict()
        store.write("units", new_units, label)
        store.write("files", seen.select(*known.columns), label)
        out.append({"project": label, **stats})
    orphans = store.read("embeddings").join(store.read("units").select("body_hash"), "body_hash", "left_anti")
    if not orphans.isEmpty():
        store.write("embeddings", incremental.pruned(store.read("embeddings"), store.read("units")))
    return out


def embed(store: Store, config: settings.Config) -> int:
    """Embed each pending body once; then drop texts that retention does not keep."""
    units, embedder = store.read("units"), HashEmbedder(config.dimensions)
    text = F.coalesce("implementation", "display_source")
    make = lambda todo: todo.select(F.lit(SPACE).alias("space"), "body_hash", embedder.embed(text).cast("array<float>").alias("vector")).where("vector is not null")
    before = store.read("embeddings").count()
    todo = incremental.pending(units, store.read("embeddings").where(F.col("space") == SPACE)).select("body_hash", "implementation", "display_source")
    incremental.embed_paged(todo, make, lambda rows: store.append("embeddings", rows), config.page_size)
    if config.retention != "full":
        for label in config.sources():
            store.write("units", retained(units.where(F.col("project") == label), config.retention), label)
    return store.read("embeddings").count() - before


def doctor(store: Store, config: settings.Config) -> list[dict]:
    """What a run needs, and whether it is there."""
    units, vectors = store.read("units"), store.read("embeddings")
    checks = [(f"folder of {label}", os.path.isdir(root) or "://" in root, root) for label, root in config.sources().items()]
    sizes = [r[0] for r in vectors.select(F.size("vector")).distinct().limit(3).collect()]
    checks += [("units", not units.isEmpty(), config.store), ("embeddings", not vectors.isEmpty(), SPACE), ("dimensions", sizes in ([], [config.dimensions]), str(sizes))]
    return [{"check": n, "ok": bool(ok), "detail": d} for n, ok, d in checks]


def embed_query(spark: SparkSession, text: str, dimensions: int) -> list[float]:
    return list(query_vector(spark, HashEmbedder(dimensions), text))


def run_concerns(units: DataFrame, config: settings.Config) -> tuple[DataFrame, DataFrame]:
    named = sorted((q["name"], embed_query(units.sparkSession, q["query"], config.dimensions)) for q in config.concerns.queries)
    kept = concerns.project(units, named, config.concerns.min_projection, config.concerns.top_units_per_concern)
    return kept, concerns.spread(kept, units)


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="simlake")
    parser.add_argument("--config", required=True)
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("show-config", "embed", "tokens", "run", "doctor"):
        sub.add_parser(name)
    sub.add_parser("languages").add_argument("what", nargs="?", default="list", choices=["list"])
    sub.add_parser("models").add_argument("what", nargs="?", default="list", choices=["list"])
    sub.add_parser("init").add_argument("--force", action="store_true")
    p = sub.add_parser("index")
    p.add_argument("--project")
    p = sub.add_parser("analyze")
    p.add_argument("what", nargs="?", default="duplicates", choices=["duplicates", "concerns"])
    p.add_argument("--ignore", default=".simlakeignore")
    p2 = sub.add_parser("compare")
    p2.add_argument("--left", required=True)
    p2.add_argument("--right", required=True)
    for q in (p, p2):
        q.add_argument("--json", action="store_true")
        q.add_argument("--limit", type=int)
        q.add_argument("--out", default="report")
    p = sub.add_parser("drift")
    p.add_argument("--baseline", required=True)
    p.add_argument("--candidate", required=True)
    p.add_argument("--top-k", type=int, default=10)
    p.add_argument("--sample", type=int, default=0)
    p.add_argument("--space", default=SPACE)
    p.add_argument("--min-cosine", type=float, default=-1.0)
    p.add_argument("--min-recall", type=float, default=0.0)
    p = sub.add_parser("query")
    p.add_argument("mode", choices=["capabilities", "units", "inspect", "similar", "qbe", "search"])
    p.add_argument("what", nargs="?")
    p.add_argument("--where", action="append", default=[])
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--threshold", type=float)
    p.add_argument("--why", action="store_true")
    p.add_argument("--text", action="store_true", help="a line for each unit instead of JSON")
    a = parser.parse_args(args)
    if a.command == "init":
        if os.path.exists(a.config) and not a.force:
            print(f"{a.config} exists; --force replaces it", file=sys.stderr)
            return 1
        with open(a.config, "w", encoding="utf-8") as f:
            f.write(settings.TEMPLATE)
        return 0
    if a.command == "languages":
        print(render.to_json([{"language": n, "extensions": [e for e, x in LANGUAGES.items() if x == n], "units": n in EXTRACTORS} for n in sorted(set(LANGUAGES.values()))]))
        return 0
    config = settings.load_file(a.config)
    model = asdict(HashEmbedder(config.dimensions).contract)
    if a.command == "models":
        print(render.to_json([model]))
        return 0
    if a.command == "show-config":
        print(json.dumps(settings.as_dict(config), indent=1))
        return 0
    spark = SparkSession.builder.appName("simlake").getOrCreate()
    store = Store(spark, config.store)
    say = lambda x: print(render.to_json(x))
    if a.command == "doctor":
        checks = doctor(store, config)
        say(checks)
        return 0 if all(c["ok"] for c in checks) else 1
    if a.command in ("index", "run"):
        say(index(store, config, getattr(a, "project", None)))
    if a.command in ("embed", "run"):
        say({"embedded": embed(store, config)})
    if a.command == "tokens":
        text = F.coalesce("implementation", "display_source", F.lit(""))
        say([r.asDict() for r in token_report(store.read("units").select("language", F.size(F.split(text, r"\W+")).alias("tokens"))).collect()])
    if a.command in ("analyze", "run"):
        units = store.context()
        if getattr(a, "what", "duplicates") == "duplicates":
            found = duplicates.duplicates(units, config.analysis, ignored_hashes(spark, getattr(a, "ignore", ".simlakeignore")))
            say(render.duplicate_envelope(found, units, a.limit, model)) if getattr(a, "json", False) else render.write_duplicates(found, units, f"{getattr(a, 'out', 'report')}/duplicates")
            store.log_run("duplicates", "hash", [], settings.as_dict(config)["analysis"])
        if getattr(a, "what", None) == "concerns" or (a.command == "run" and config.concerns.enabled):
            kept, spread = run_concerns(units, config)
            named = {q["name"]: q["query"] for q in config.concerns.queries}
            say(render.concern_envelope(kept, spread, units, named, a.limit, model)) if getattr(a, "json", False) else render.write_concerns(kept, spread, units, f"{getattr(a, 'out', 'report')}/concerns")
            store.log_run("concerns", "hash", [], settings.as_dict(config)["concerns"])
    if a.command == "compare":
        units = store.context([a.left, a.right])
        found = compare(units, a.left, a.right, config.comparison)
        say(render.comparison_envelope(found, units, a.left, a.right, a.limit, model)) if a.json else render.write_comparison(found, units, a.left, a.right, f"{a.out}/compare")
        store.log_run("compare", "hash", [a.left, a.right], settings.as_dict(config)["comparison"])
    if a.command == "drift":
        sides = [Store(spark, s).read("embeddings").where(F.col("space") == a.space).select("body_hash", "vector") for s in (a.baseline, a.candidate)]
        found = drift.drift(*sides, top_k=a.top_k, sample=a.sample)
        say(vars(found))
        return 0 if found.passes(a.min_cosine, a.min_recall) else 1
    if a.command == "query":
        units = store.read("units")
        if a.mode == "capabilities":
            say(Q.capabilities(units, store.read("embeddings")).first().asDict())
            return 0
        if a.mode == "inspect":
            say(render.unit_object(Q.inspect(units, a.what).first()))
            return 0
        evidence = {}
        if a.mode == "units":
            rows, matched = Q.list_units(units, a.where, a.limit)
        elif a.mode == "search":
            evidence = {"query": a.what}
            rows, matched = Q.search(store.context(), embed_query(spark, a.what, config.dimensions), a.where, a.limit)
        else:
            evidence = {"unit": a.what}
            rows, matched = Q.similar(store.context(), Q.inspect(units, a.what).first()["unit_idx"], a.where, a.limit, -1.0 if a.threshold is None else a.threshold)
        rows = Q.with_ids(rows).withColumn("line", Q.unit_line())
        if a.why and evidence:
            rows = rows.withColumn("why", Q.why("score", evidence, a.where, a.threshold))
        found = rows.collect()  # at most ``limit`` rows
        if a.text:
            for r in found:
                print(f"{r['score']:.4f} {r['line']}" if evidence else r["line"])
            if len(found) < matched:
                print(f"({len(found)} of {matched} shown; raise --limit for the rest)", file=sys.stderr)
            return 0
        extra = [c for c in ("score", "why") if c in rows.columns]
        items = [render.unit_object(r) | {c: r[c].asDict(True) if c == "why" else r[c] for c in extra} for r in found]
        say(render.envelope(a.mode, items, matched, {"where": a.where, "limit": a.limit, "threshold": a.threshold} | evidence, model if evidence else None))
    return 0


if __name__ == "__main__":
    sys.exit(main())
