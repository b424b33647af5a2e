"""Source trees: files that are not excluded, their languages, and the units in them."""

from __future__ import annotations

import ast
import hashlib
import io
import re
import tokenize
from collections.abc import Callable, Iterator, Sequence
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.query.where import glob_pattern
from simlake.sources.braces import brace_units, ruby_units

#: Languages by file name extension; extraction is registered separately.
LANGUAGES = {"py": "python", "rs": "rust", "go": "go", "c": "c", "h": "c", "js": "javascript", "ts": "typescript", "java": "java", "rb": "ruby", "php": "php", "cs": "csharp", "cpp": "cpp", "sh": "bash"}


def ignore_rules(text: str, folder: str = "") -> list[tuple[str, bool]]:
    """The lines of an ignore file as (pattern over paths, whether it takes files back in), in order."""
    rules = []
    for line in text.splitlines():
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        back, line = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        below, line = line.endswith("/"), line.strip("/") if line.strip("/").count("/") == 0 and not line.startswith("/") else "/" + line.strip("/")
        inner = glob_pattern(line.lstrip("/"), True)[1:-1].replace(".*/", "(?:.*/)?")
        anywhere = "" if line.startswith("/") else "(?:.*/)?"
        rules.append((f"^{re.escape(folder)}{anywhere}{inner}{'/.*' if below else '(?:/.*)?'}$", back))
    return rules


def _ignored(spark: SparkSession, root: str, paths: DataFrame) -> F.Column:
    """Whether a path is ignored by the tree's ignore files: of those that say something the last rule holds, deeper files later."""
    # one row for each folder; readers of data pass over hidden files, so these are opened here
    folders = {""} | {r["f"] for r in paths.select(F.regexp_replace("relative_path", "[^/]*$", "").alias("f")).distinct().collect()}
    folders |= {"/".join(parts[:i]) + "/" for f in folders for parts in [f.split("/")] for i in range(1, len(parts))}
    jvm = spark._jvm
    out = F.lit(False)
    for folder in sorted(folders, key=lambda f: (f.count("/"), f)):
        file = jvm.org.apache.hadoop.fs.Path(jvm.org.apache.hadoop.fs.Path(root), folder + ".gitignore")
        fs = file.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        if fs.exists(file):
            stream = fs.open(file)
            text = bytes(stream.readAllBytes()).decode("utf-8", "replace")
            stream.close()
            for pattern, back in ignore_rules(text, folder):
                out = F.when(F.col("relative_path").rlike(pattern), F.lit(not back)).otherwise(out)
    return out


def scan(spark: SparkSession, project: str, root: str, *, languages: Sequence[str] | None = None, exclude: Sequence[str] = (), ignore: bool = True) -> DataFrame:
    """``project, relative_path, language, mtime_ns, size, source_hash, content`` of the files below ``root`` that no ignore file and no glob leaves out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    base = "^" + re.escape("/" + root.split("://", 1)[-1].strip("/") + "/")
    table = F.create_map(*(F.lit(x) for pair in LANGUAGES.items() for x in pair))
    rows = files.select(
        F.lit(project).alias("project"), F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), base, "").alias("relative_path"), table[F.lower(F.element_at(F.split("path", r"\."), -1))].alias("language"),
        (F.unix_micros("modificationTime") * 1000).alias("mtime_ns"), F.col("length").alias("size"), F.sha2("content", 256).alias("source_hash"), "content",
    )
    rows = rows.where("language is not null")
    if languages is not None:
        rows = rows.where(F.col("language").isin(*languages))
    for pattern in exclude:
        rows = rows.where(~F.col("relative_path").rlike(glob_pattern(pattern, True)))
    return rows.where(~_ignored(spark, root, rows)) if ignore else rows


def normalised_body(source: str) -> str:
    """Python source without comments, its white space collapsed."""
    try:
        tokens = [t.string for t in tokenize.generate_tokens(io.StringIO(source).readline) if t.type not in (tokenize.COMMENT, tokenize.NL)]
    except (tokenize.TokenError, IndentationError):
        tokens = source.split()
    return " ".join(" ".join(tokens).split())


def python_units(source: str, least_nodes: int, most_chars: int) -> Iterator[dict]:
    """Functions and methods of a Python module with their scopes, spans and sizes."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError):
        return
    lines = source.encode().splitlines(keepends=True)
    starts = [0]
    for line in lines:
        starts.append(starts[-1] + len(line))

    def walk(node: ast.AST, scope: tuple[str, ...]) -> Iterator[dict]:
        kind = "method" if isinstance(node, ast.ClassDef) else "function"
        for child in ast.iter_child_nodes(node):
            if isinstance(child, ast.FunctionDef | ast.AsyncFunctionDef):
                start, end = starts[child.lineno - 1] + child.col_offset, starts[child.end_lineno - 1] + child.end_col_offset
                text = source.encode()[start:end].decode("utf-8", "replace")
                size = sum(1 for _ in ast.walk(child)) - 1
                if size >= least_nodes and len(text) <= most_chars:
                    body = "\n".join(normalised_body(ast.unparse(s)) for s in child.body)
                    yield {
                        "kind": kind, "name": child.name, "scope": ".".join(scope) or None, "start_byte": start, "end_byte": end, "start_line": child.lineno, "end_line": child.end_lineno,
                        "body_node_count": size, "body_hash": hashlib.sha256(body.encode()).hexdigest(), "display_source": text, "implementation": body,
                    }
                yield from walk(child, scope)
            else:
                yield from walk(child, (*scope, child.name) if isinstance(child, ast.ClassDef) else scope)

    yield from walk(tree, ())


#: Extractors by language: (source, least nodes, most characters) -> unit rows.  More can be registered.
EXTRACTORS: dict[str, Callable[[str, int, int], Iterator[dict]]] = {
    "python": python_units, "ruby": ruby_units, "bash": partial(brace_units, shell=True), **dict.fromkeys(("rust", "go", "c", "javascript", "typescript", "java", "php", "csharp", "cpp"), brace_units),
}

_UNIT = "project string, relative_path string, language string, kind string, name string, scope string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, body_node_count bigint, body_hash string, display_source string, implementation string"


def extract(files: DataFrame, *, least_nodes: int = 8, most_chars: int = 10_000) -> DataFrame:
    """Units of the scanned files, each with a ``unit_idx`` from its place; files in other languages have none."""
    names = [x.split(" ")[0] for x in _UNIT.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for f in batch.itertuples(index=False):
                units = EXTRACTORS.get(f.language, lambda *_: ())(bytes(f.content).decode("utf-8", "replace"), least_nodes, most_chars)
                rows += [{"project": f.project, "relative_path": f.relative_path, "language": f.language, **u} for u in units]
            yield pd.DataFrame(rows, columns=names)

    found = files.select("project", "relative_path", "language", "content").mapInPandas(run, _UNIT)
    place = F.xxhash64("project", "relative_path", "start_byte", "end_byte", "name")
    return found.withColumn("unit_idx", F.shiftrightunsigned(place, 1))
