"""Reports for people and programs from bounded results: Markdown pages and JSON envelopes."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from simlake.analyze.compare import CLASSES
from simlake.functions import paths as P

VERSION = "0.2"
# fixed values: numbers of shown rows, titles and sections of the reports
TOP_PAIRS, TOP_NAMES, EXAMPLES, SUPPRESSED = 5, 3, 5, 25
TITLES = {"exact_copy": "Exact copies", "strong_match": "Strong matches", "possible_match": "Possible matches", "split": "Splits (one → many)", "merge": "Merges (many → one)", "missing_in_right": "Possible missing coverage", "new_in_right": "Possible new behavior"}
SECTIONS = {"product": "Product code clusters", "mixed": "Mixed clusters", "test_or_docs": "Test and documentation clusters"}
_GENERATED = re.compile(r"index\.md|cluster-\d+\.md|(?:" + "|".join(CLASSES) + r")\.md")


def bounded(rows: DataFrame, limit: int | None) -> list:
    """At most ``limit`` rows; without a limit all, part by part, as a report that is asked for whole is written whole."""
    return list(rows.toLocalIterator()) if limit is None else rows.limit(limit).collect()


def summary(matched: int, returned: int) -> dict:
    return {"matched": matched, "returned": returned, "exhaustive": returned >= matched, "has_more": returned < matched}


def unit_object(u) -> dict:
    return {
        "unit_idx": u["unit_idx"], "unit_id": u["unit_id"], "project": u["project"], "path": u["relative_path"], "language": u["language"], "kind": u["kind"], "name": u["name"], "scope": u["scope"],
        "byte_range": [u["start_byte"], u["end_byte"]], "line_range": [u["start_line"], u["end_line"]], "body_node_count": u["body_node_count"], "body_hash": u["body_hash"],
    }


def _units(units: DataFrame, wanted: Sequence[int]) -> dict[int, dict]:
    """The unit objects of a bounded list of indices."""
    ids = units.sparkSession.createDataFrame([(i,) for i in sorted(set(wanted))], "unit_idx bigint")
    return {u["unit_idx"]: unit_object(u) for u in units.drop("vector").withColumn("unit_id", P.unit_id()).join(F.broadcast(ids), "unit_idx").collect()}


def envelope(kind: str, items: list, matched: int, query: dict | None = None, model: dict | None = None, **more: object) -> dict:
    """Kind and version, the model that made the vectors, what was asked, honest counts, and the items."""
    return {"schema_version": f"simlake.{kind}.v1", "version": VERSION, "kind": kind, "model": model, "query": query or {}, "summary": summary(matched, len(items)), "items": items, **more}


def concern_envelope(kept: DataFrame, spread: DataFrame, units: DataFrame, queries: dict[str, str], limit: int | None = None, model: dict | None = None) -> dict:
    """Concerns in order of name, each with its query, spread and units, best first."""
    names = sorted(queries)
    shown = names if limit is None else names[:limit]
    about = {r["concern"]: r for r in spread.where(F.col("concern").isin(*shown)).collect()} if shown else {}
    rows = kept.where(F.col("concern").isin(*shown)).orderBy("concern", "rank").collect() if shown else []  # bounded by the units kept for each concern
    known = _units(units, [r["unit_idx"] for r in rows])
    measures = ("files", "directories", "top_level_modules", "directory_entropy", "dispersion")
    items = [
        {"name": n, "query": queries[n], "spread": {m: about[n][m] if n in about else 0 for m in measures}, "units": [known[r["unit_idx"]] | {"score": r["projection"]} for r in rows if r["concern"] == n]}
        for n in shown
    ]
    return envelope("concerns", items, len(names), model=model)


def duplicate_envelope(found: dict[str, DataFrame], units: DataFrame, limit: int | None = None, model: dict | None = None) -> dict:
    """Clusters best first with their members, and the cross-directory candidates."""
    rows = bounded(found["clusters"], limit)
    known = _units(units, [m for r in rows for m in r["members"]])
    items = [
        {"cluster_id": f"cluster:{r['hash']}", "kind": r["kind"], "name_family": r["name_family"], "top_raw": r["top_raw"], "top_boosted": r["top_boosted"], "members": [known[m] for m in r["members"]]}
        for r in rows
    ]
    cross = [{"cluster_id": f"cluster:{r['hash']}", **{c: r[c] for c in ("modules", "scopes", "dispersion", "directory_entropy", "generic_helper", "score")}} for r in bounded(found["cross_directory"], limit)]
    return envelope("duplicates", items, found["clusters"].count(), model=model, cross_directory=cross, candidate_pairs=found["candidates"].count(), ignored=[r["hash"] for r in bounded(found["ignored"], None)])


def with_match_ids(records: DataFrame, units: DataFrame) -> DataFrame:
    """The records with their lasting ids, from the fingerprints of both sides in member order."""
    prints = units.select("unit_idx", F.concat_ws("\0", "project", "relative_path", "body_hash").alias("print"))
    keyed = records.withColumn("key", F.sha2(F.concat_ws("|", "class", F.col("left").cast("string"), F.col("right").cast("string")), 256))
    for name in ("left", "right"):
        one = keyed.select("key", F.posexplode(name).alias("i", "unit_idx")).join(prints, "unit_idx")
        keyed = keyed.join(one.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("i", "print"))).alias(f"{name}_prints")), "key", "left")
    empty = F.array().cast("array<string>")
    side = lambda c: F.coalesce(F.transform(c, lambda s: s["print"]), empty)
    return keyed.withColumn("match_id", P.match_id(F.col("class"), side(F.col("left_prints")), side(F.col("right_prints")))).drop("key", "left_prints", "right_prints")


def comparison_envelope(found: dict, units: DataFrame, left: str, right: str, limit: int | None = None, model: dict | None = None) -> dict:
    records = with_match_ids(found["records"], units)
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    rows = bounded(records.orderBy(order, F.desc("score"), "left", "right"), limit)
    known = _units(units, [m for r in rows for m in (*r["left"], *r["right"])])
    items = [{"match_id": r["match_id"], "class": r["class"], "score": r["score"], "hint_bonus": r["hint"], "left": [known[m] for m in r["left"]], "right": [known[m] for m in r["right"]]} for r in rows]
    out = envelope("comparison", items, records.count(), model=model, left=left, right=right, calibration=found["calibration"])
    out["summary"] |= {r["class"]: r["n"] for r in found["counts"].collect()}
    out["coverage"] = [r.asDict() for r in bounded(found["coverage"].orderBy("by", "group"), None)]
    out["suppressed_right_candidates"] = [r.asDict() for r in bounded(found["suppressed"], None)]
    return out


def clean(directory: Path) -> None:
    """Remove what an earlier report wrote, and nothing else."""
    if directory.is_dir():
        for p in directory.iterdir():
            if p.is_file() and _GENERATED.fullmatch(p.name):
                p.unlink()


def _place(u: dict) -> str:
    return f"`{u['project']}:{u['path']}` lines {u['line_range'][0]}-{u['line_range'][1]}"


def _shown(u: dict) -> str:
    return f"{u['scope']}.{u['name']}" if u["scope"] else u["name"]


def _table(head: Sequence[str], rows: Sequence[Sequence[object]]) -> list[str]:
    return [f"| {' | '.join(head)} |", f"|{' --- |' * len(head)}", *(f"| {' | '.join(map(str, r))} |" for r in rows), ""]


def write_duplicates(found: dict[str, DataFrame], units: DataFrame, directory: str, ignore_file: str = ".simlakeignore") -> None:
    """An index page and a page for each cluster."""
    data, to = duplicate_envelope(found, units), Path(directory)
    to.mkdir(parents=True, exist_ok=True)
    clean(to)
    lines = ["# Duplicate code report", "", f"{data['candidate_pairs']} candidate pairs, {len(data['items'])} clusters ({len(data['ignored'])} ignored).", ""]
    for kind, title in SECTIONS.items():
        own = [(n, c) for n, c in enumerate(data["items"], 1) if c["kind"] == kind]
        if own:
            rows = [(n, f"[`{c['cluster_id'][8:]}`](cluster-{n:02d}.md)", len(c["members"]), f"{c['top_raw']:.4f}", f"{c['top_boosted']:.4f}", ", ".join(_shown(u) for u in c["members"][:TOP_NAMES])) for n, c in own]
            lines += [f"## {title}", "", *_table(("#", "Cluster", "Units", "Top raw", "Boosted", "Members"), rows)]
    if data["cross_directory"]:
        rows = [(f"`{c['cluster_id'][8:]}`", ", ".join(c["modules"]), f"{c['dispersion']:.2f}", f"{c['directory_entropy']:.2f}", ", ".join(c["scopes"]), "yes" if c["generic_helper"] else "no", f"{c['score']:.2f}") for c in data["cross_directory"]]
        lines += ["## Cross-directory duplication", "", *_table(("Cluster", "Modules", "Dispersion", "Entropy", "Scopes", "Generic helper", "Score"), rows)]
    lines += [f"Append a cluster hash to `{ignore_file}` to suppress it.", ""]
    (to / "index.md").write_text("\n".join(lines))
    pairs: dict[int, list] = {}
    order = W.partitionBy("cluster").orderBy(F.desc("boosted"), "a", "b")
    for p in bounded(found["pairs"].withColumn("k", F.row_number().over(order)).where(F.col("k") <= TOP_PAIRS).orderBy("cluster", "k"), None):
        pairs.setdefault(p["cluster"], []).append(p)
    for n, c in enumerate(data["items"], 1):
        known = {u["unit_idx"]: u for u in c["members"]}
        best = pairs.get(min(known), [])[:TOP_PAIRS]
        page = [f"# Cluster {n} — `{c['cluster_id'][8:]}`", "", "## Top pairs", "", *(f"- {p['raw']:.4f} (boosted {p['boosted']:.4f}): {_place(known[p['a']])} ↔ {_place(known[p['b']])}" for p in best), ""]
        for body in dict.fromkeys(u["body_hash"] for u in c["members"]):
            same = [u for u in c["members"] if u["body_hash"] == body]
            page += [f"## {_shown(same[0])}", "", *(f"- {_place(u)}" for u in same), "", *([f"{len(same)} exact copies of this body.", ""] if len(same) > 1 else [])]
        (to / f"cluster-{n:02d}.md").write_text("\n".join(page))


def write_comparison(found: dict, units: DataFrame, left: str, right: str, directory: str) -> None:
    """An index page with counts and coverage, and a page for each class that occurs."""
    data, to = comparison_envelope(found, units, left, right), Path(directory)
    to.mkdir(parents=True, exist_ok=True)
    clean(to)
    counts = [(f"[{t}]({c}.md)" if data["summary"][c] else t, data["summary"][c]) for c, t in TITLES.items()]
    lines = [f"# Comparison: `{left}` (reference) vs `{right}` (candidate)", "", *_table(("Class", "Count"), counts)]
    for by in ("directory", "language"):
        rows = [(f"`{r['group'] or '.'}`", r["total_left"], r["covered"], r["possible"], r["missing"]) for r in data["coverage"] if r["by"] == by]
        lines += [f"## Coverage by {by}", "", *_table(("Group", "Left units", "Covered", "Possible", "Missing"), rows)]
    (to / "index.md").write_text("\n".join(lines))

    def line(r: dict) -> str:
        side = lambda us: ", ".join(f"{_shown(u)} ({_place(u)})" for u in us)
        both = " ↔ ".join(side(r[s]) for s in ("left", "right") if r[s])
        return f"- {both}" + (f" (score {r['score']:.4f}, hints +{r['hint_bonus']:.2f})" if r["left"] and r["right"] else "")

    for c, title in TITLES.items():
        own = [r for r in data["items"] if r["class"] == c]
        if own:
            (to / f"{c}.md").write_text("\n".join([f"# {title}", "", "## Examples", "", *map(line, own[:EXAMPLES]), "", "## All records", "", *map(line, own), ""]))


def write_concerns(kept: DataFrame, spread: DataFrame, units: DataFrame, directory: str) -> None:
    """A page for each concern: its spread and its units, best first."""
    to = Path(directory)
    to.mkdir(parents=True, exist_ok=True)
    clean(to)
    rows, about = bounded(kept.orderBy("concern", "rank"), None), {r["concern"]: r for r in bounded(spread, None)}
    known, pages = _units(units, [r["unit_idx"] for r in rows]), {}
    for r in rows:
        pages.setdefault(r["concern"], []).append(f"- {r['projection']:.4f} — {_shown(known[r['unit_idx']])} ({_place(known[r['unit_idx']])})")
    (to / "index.md").write_text("\n".join(["# Concerns", "", *(f"- [{c}]({c}.md)" for c in sorted(pages)), ""]))
    for c, lines in pages.items():
        s = about[c]
        said = f"Structural spread: {s['files']} files, {s['directories']} directories, {s['top_level_modules']} top-level modules, entropy {s['directory_entropy']:.2f}, dispersion {s['dispersion']:.2f}."
        (to / f"{c}.md").write_text("\n".join([f"# Candidate concern: {c}", "", said, "", "## Top units", "", *lines, ""]))


def to_json(data: dict) -> str:
    return json.dumps(data, ensure_ascii=False, default=str)
