"""The warehouse: fact tables as Parquet below one path, with fixed schemas."""

from __future__ import annotations

import datetime
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMAS = {
    "projects": "label string, source_dir string",
    "files": "project string, relative_path string, language string, mtime_ns bigint, size bigint, source_hash string",
    "units": "unit_idx bigint, project string, relative_path string, language string, kind string, name string, scope string, start_byte bigint, end_byte bigint, start_line bigint, end_line bigint, body_node_count bigint, body_hash string, display_source string, implementation string",
    "embeddings": "space string, body_hash string, vector array<float>",
    "runs": "kind string, model string, scope string, config string, created_at timestamp",
}


#: Tables with a part for each value of a column: a part is replaced without touching the others.
PARTS = {"units": "project", "files": "project"}


class Store:
    """Tables below ``path``, or parts of them: a base, which replaces all before it, and additions after it.

    A base or addition counts once its writer has committed it, so readers are not
    disturbed and what breaks off leaves the table as it was.
    """

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _fs(self, where: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _names(self, where: str) -> list[str]:
        fs, p = self._fs(where)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _committed(self, where: str) -> list[tuple[int, str]]:
        """Number and name of what counts in a table or part, in order."""
        found = sorted((int(n[1:]), n) for n in self._names(where) if n[0] in "ba" and n[1:].isdigit())
        found = [v for v in found if self._fs(f"{where}/{v[1]}/_SUCCESS")[0].exists(self._fs(f"{where}/{v[1]}/_SUCCESS")[1])]
        base = max((i for i, (_, n) in enumerate(found) if n[0] == "b"), default=0)
        return found[base:]

    def _places(self, table: str) -> list[str]:
        where = f"{self.path}/{table}"
        return [f"{where}/{n}" for n in self._names(where)] if table in PARTS else [where]

    def read(self, table: str) -> DataFrame:
        paths = [f"{where}/{name}" for where in self._places(table) for _, name in self._committed(where)]
        if not paths:
            return self.spark.createDataFrame([], SCHEMAS[table])
        return self.spark.read.schema(SCHEMAS[table]).parquet(*paths)

    def _put(self, table: str, rows: DataFrame, part: str | None, kind: str) -> None:
        if (table in PARTS) != (part is not None):
            raise ValueError(f"{table} is {'written by ' + PARTS[table] if table in PARTS else 'one table'}")
        where = f"{self.path}/{table}" + (f"/{part}" if part else "")
        before = self._committed(where)
        columns = [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.spark.createDataFrame([], SCHEMAS[table]).schema]
        rows.select(*columns).write.mode("overwrite").parquet(f"{where}/{kind}{(before[-1][0] if before else 0) + 1:06d}")
        if kind == "b":
            # what the base before the last one held is no longer read by anyone
            for name in self._names(where):
                if name[1:].isdigit() and before and int(name[1:]) < before[0][0]:
                    fs, p = self._fs(f"{where}/{name}")
                    fs.delete(p, True)

    def write(self, table: str, rows: DataFrame, part: str | None = None) -> None:
        """Replace a table, or one part of it."""
        self._put(table, rows, part, "b")

    def append(self, table: str, rows: DataFrame, part: str | None = None) -> None:
        """Add rows to a table, or to one part of it."""
        self._put(table, rows, part, "a")

    def log_run(self, kind: str, model: str, scope: list[str], config: dict) -> None:
        row = [(kind, model, json.dumps(scope), json.dumps(config, sort_keys=True), datetime.datetime.now(datetime.UTC))]
        self.append("runs", self.spark.createDataFrame(row, SCHEMAS["runs"]).coalesce(1))

    def context(self, projects: list[str] | None = None, space: str = "default/implementation") -> DataFrame:
        """Units of the chosen projects (all by default) with the vectors of one space; raises if there is nothing."""
        units = self.read("units")
        if projects:
            units = units.where(F.col("project").isin(*projects))
        if not units.limit(1).count():
            raise LookupError("no units of these projects: index first")
        vectors = self.read("embeddings").where(F.col("space") == space).select("body_hash", "vector")
        if not vectors.limit(1).count():
            raise LookupError(f"space {space} has no embeddings: embed first")
        return units.join(vectors, "body_hash", "left")


def ignored_hashes(spark: SparkSession, path: str) -> DataFrame:
    """``hash``: one a line, ``#`` starts a comment; a missing file is empty."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return spark.createDataFrame([], "hash string")
    return spark.read.text(path).select(F.trim(F.split("value", "#")[0]).alias("hash")).where("hash != ''").distinct()


def retained(units: DataFrame, retention: str) -> DataFrame:
    """``full`` keeps both texts, ``report`` the displayed one, ``minimal`` neither."""
    if retention not in ("full", "report", "minimal"):
        raise ValueError(f"retention is full, report or minimal, not {retention!r}")
    keep = lambda c, kinds: F.when(F.lit(retention in kinds), F.col(c)).alias(c)
    return units.withColumns({"display_source": keep("display_source", ("full", "report")), "implementation": keep("implementation", ("full",))})


def unit_source(units: DataFrame, files: DataFrame) -> DataFrame:
    """``unit_idx, source``: the stored text, else the bytes of the unit in its file (``project, relative_path, content``)."""
    rows = units.join(files.select("project", "relative_path", "content"), ["project", "relative_path"], "left")
    cut = F.decode(F.substring("content", F.col("start_byte") + 1, F.col("end_byte") - F.col("start_byte")), "utf-8")
    return rows.select("unit_idx", F.coalesce("display_source", cut).alias("source"))
