"""Scalar functions over paths, spans and names, as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: directory names that mark tests and documents, and shared helper scopes
TEST_DOC_DIRS = (
    "test", "tests", "testdata", "testing", "__tests__", "spec", "specs", "e2e", "fixtures", "doc", "docs",
    "example", "examples", "sample", "samples", "bench", "benches", "benchmark", "benchmarks",
)
GENERIC_DIRS = ("utils", "util", "common", "helpers", "helper", "shared", "lib")


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def directory_of(path: str | Column) -> Column:
    """The path without its last part; "" for a file at the root."""
    return F.regexp_replace(_c(path), "/?[^/]*$", "")


def top_level_module(path: str | Column) -> Column:
    """The first part of the path: the file itself at the root."""
    return F.substring_index(_c(path), "/", 1)


def directory_parts(path: str | Column) -> Column:
    """The directories of a path in order; empty at the root."""
    parts = F.split(_c(path), "/")
    return F.slice(parts, 1, F.size(parts) - 1)


def path_distance(a: str | Column, b: str | Column) -> Column:
    """Directory steps from one file to the other over their deepest common ancestor."""
    x, y = directory_parts(a), directory_parts(b)
    # how many leading directories agree: the marks of agreement up to the first gap
    same = F.zip_with(x, y, lambda p, q: F.coalesce(p == q, F.lit(False)))
    first_gap = F.array_position(same, F.lit(False))
    common = F.when(F.size(same) == 0, 0).when(first_gap == 0, F.size(same)).otherwise(first_gap - 1)
    return (F.size(x) + F.size(y) - 2 * common).cast("long")


def spans_overlap(start_a: str, end_a: str, start_b: str, end_b: str) -> Column:
    """Whether two half-open spans share anything."""
    return (F.col(start_a) < F.col(end_b)) & (F.col(start_b) < F.col(end_a))


def line_gap(start_a: str, end_a: str, start_b: str, end_b: str) -> Column:
    """Lines between two spans; 0 if they touch or overlap."""
    return F.greatest(F.lit(0), F.col(start_b) - F.col(end_a), F.col(start_a) - F.col(end_b))


def is_test_or_docs_path(path: str | Column) -> Column:
    """Whether directory or file name says test, documentation, example or benchmark."""
    file = F.lower(F.element_at(F.split(_c(path), "/"), -1))
    parts = F.split(file, r"\.")
    stem = parts[0]
    middle = F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0)))
    return (
        F.exists(directory_parts(path), lambda d: F.lower(d).isin(*TEST_DOC_DIRS))
        | (file == "conftest.py")
        | stem.startswith("test_")
        | stem.endswith("_test")
        | stem.isin("test", "tests")
        | F.exists(middle, lambda p: p.isin("test", "spec"))
    )


def is_test_or_docs_unit(path: str | Column = "relative_path", scope: str | Column = "scope") -> Column:
    """The same, or a unit within an inline test module."""
    return is_test_or_docs_path(path) | F.coalesce(F.substring_index(_c(scope), ".", 1).isin("tests", "test"), F.lit(False))


def is_generic_path(path: str | Column) -> Column:
    """Whether the file lies below a directory of shared helpers."""
    return F.exists(directory_parts(path), lambda d: F.lower(d).isin(*GENERIC_DIRS))


def distance_boost(a: dict[str, str], b: dict[str, str]) -> Column:
    """How much farther apart than usual two units lie: by lines within a file, by directories beyond."""
    same_file = (F.col(a["project"]) == F.col(b["project"])) & (F.col(a["relative_path"]) == F.col(b["relative_path"]))
    near = F.least(line_gap(a["start_line"], a["end_line"], b["start_line"], b["end_line"]) / 200.0, F.lit(1.0)) * 0.10
    far = F.least(path_distance(a["relative_path"], b["relative_path"]) * 0.03, F.lit(0.15))
    return F.when(same_file, near).otherwise(far)


def hint_bonus(a: dict[str, str], b: dict[str, str], use_names: bool = True, use_paths: bool = True) -> Column:
    """A bounded bonus for like names and near directories."""
    parts = []
    if use_names:
        x, y = F.lower(F.col(a["name"])), F.lower(F.col(b["name"]))
        parts.append(F.when(x == y, 0.02).when(F.contains(x, y) | F.contains(y, x), 0.01).otherwise(0.0))
    if use_paths:
        x, y = F.col(a["relative_path"]), F.col(b["relative_path"])
        parts.append(F.when(directory_of(x) == directory_of(y), 0.02).when(top_level_module(x) == top_level_module(y), 0.01).otherwise(0.0))
    return F.least(reduce(lambda p, q: p + q, parts), F.lit(0.04)) if parts else F.lit(0.0)


def display_name(name: str | Column = "name", scope: str | Column = "scope") -> Column:
    return F.concat_ws(".", _c(scope), _c(name))


def location(project: str = "project", path: str = "relative_path") -> Column:
    return F.concat_ws(":", F.col(project), F.col(path))


def group_label(directory: str | Column) -> Column:
    """A directory for display: "." at the root."""
    return F.when(_c(directory) == "", ".").otherwise(_c(directory))


def unit_id() -> Column:
    """The lasting id of a unit: 16 hex digits over what it is and where."""
    parts = ["project", "relative_path", "start_byte", "end_byte", "body_hash", "name", "scope", "language"]
    joined = F.concat_ws("\0", *(F.coalesce(F.col(p).cast("string"), F.lit("")) for p in parts))
    return F.concat(F.lit("unit:"), F.substring(F.sha2(joined, 256), 1, 16))


def cluster_hash(fingerprints: Column) -> Column:
    """The lasting id of a cluster from the array of its members' path \\0 hash."""
    return F.substring(F.sha2(F.array_join(F.sort_array(fingerprints), "\n"), 256), 1, 16)


def fingerprint(path: str | Column = "relative_path", body: str | Column = "body_hash") -> Column:
    return F.concat(_c(path), F.lit("\0"), _c(body))


def match_id(kind: Column, left: Column, right: Column) -> Column:
    """The lasting id of a match; left and right are arrays of project \\0 path \\0 hash in member order."""
    sides = F.concat_ws("\1", kind, F.array_join(left, "\n"), F.array_join(right, "\n"))
    return F.concat(F.lit("match:"), F.substring(F.sha2(sides, 256), 1, 16))
