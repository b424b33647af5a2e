"""Questions to an index: units by metadata, one unit, neighbours, search by text, and what can be asked."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from simlake.functions.paths import unit_id
from simlake.functions.vectors import dot
from simlake.query.where import parse

MODES = ("similar", "qbe")


class NotFound(LookupError):
    """A selector that names nothing."""


def with_ids(units: DataFrame) -> DataFrame:
    return units.withColumn("unit_id", unit_id())


def list_units(units: DataFrame, where: Iterable[str] = (), limit: int | None = None) -> tuple[DataFrame, int]:
    """Matching units in order of place, at most ``limit``, and how many match."""
    found = with_ids(units).where(parse(where))
    ordered = found.orderBy("project", "relative_path", "start_byte", "end_byte", "name", "unit_idx")
    return (ordered if limit is None else ordered.limit(limit)), found.count()


def inspect(units: DataFrame, selector: str) -> DataFrame:
    """The unit with an id; raises NotFound with what to do."""
    found = with_ids(units).where(F.col("unit_id") == selector)
    if not found.limit(1).count():
        raise NotFound(f"no unit {selector}: ids change with their code, so list the units again")
    return found


def _scored(units: DataFrame, vector: Sequence[float], where: Column, threshold: float) -> DataFrame:
    q = F.array(*(F.lit(float(x)) for x in vector))
    return units.where(F.col("vector").isNotNull() & where).withColumn("score", dot("vector", q)).where(F.col("score") >= threshold)


def _top(found: DataFrame, limit: int) -> tuple[DataFrame, int]:
    """The best ``limit`` rows and the number of all, from one pass over them."""
    seen = Observation()
    rows = found.observe(seen, F.count(F.lit(1)).alias("n")).orderBy(F.desc("score"), "unit_idx").limit(limit).collect()
    return found.sparkSession.createDataFrame(rows, found.schema), seen.get["n"]


def similar(units: DataFrame, unit_idx: int, where: Iterable[str] = (), limit: int = 20, threshold: float = -1.0) -> tuple[DataFrame, int]:
    """The nearest other units of one unit, and how many pass the filters; raises if it has no vector."""
    own = units.where(F.col("unit_idx") == unit_idx).select("vector").first()
    if own is None:
        raise NotFound(f"no unit {unit_idx}")
    if own["vector"] is None:
        raise ValueError(f"unit {unit_idx} is not embedded")
    return _top(_scored(units, own["vector"], parse(where) & (F.col("unit_idx") != unit_idx), threshold).drop("vector"), limit)


def search(units: DataFrame, vector: Sequence[float], where: Iterable[str] = (), limit: int = 20) -> tuple[DataFrame, int]:
    """The units nearest to a query's vector, and how many embedded units pass the filter."""
    return _top(_scored(units, vector, parse(where), -1.0).drop("vector"), limit)


def why(score: Column | str, evidence: dict[str, str], where: Iterable[str] = (), threshold: float | None = None) -> Column:
    """Evidence for a hit: its scores, what it was compared with, and what decided."""
    decision = [F.lit("vector_rank").alias("reason"), F.array(*map(F.lit, where)).cast("array<string>").alias("filters"), F.lit(threshold).cast("double").alias("threshold"), F.lit(False).alias("suppressed")]
    source = F.struct(F.lit("vector").alias("source"), *(F.lit(v).alias(k) for k, v in evidence.items()))
    score = F.col(score) if isinstance(score, str) else score
    return F.struct(F.struct(score.alias("cosine")).alias("scores"), F.array(source).alias("evidence"), F.struct(*decision).alias("decision"))


def unit_line() -> Column:
    """A unit as a line of text: id, place, kind, name and scope."""
    return F.concat_ws(" ", unit_id(), F.format_string("%s:%s:%d-%d", "project", "relative_path", "start_line", "end_line"), "kind", "name", F.when(F.col("scope").isNotNull(), F.concat(F.lit("("), "scope", F.lit(")"))))


def envelope(rows: DataFrame, matched: int, limit: int | None) -> dict:
    """Honest bounds of a result."""
    returned = matched if limit is None else min(matched, limit)
    return {"matched": matched, "returned": returned, "exhaustive": returned == matched, "has_more": returned < matched}


def language_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("language").agg(F.count("*").alias("units"))


def project_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("project").agg(F.countDistinct("relative_path").alias("files"), F.count("*").alias("units"))


def pending_bodies(units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Distinct bodies without an embedding."""
    return units.select("body_hash").distinct().join(embeddings.select("body_hash"), "body_hash", "left_anti")


def capabilities(units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One row: units, bodies, embedded and pending bodies, and which questions can be answered."""
    bodies = units.select("body_hash").distinct().join(embeddings.select("body_hash", F.lit(1).alias("has")).distinct(), "body_hash", "left")
    counts = bodies.agg(F.count("*").alias("bodies"), F.count("has").alias("embedded"))
    total = units.agg(F.count("*").alias("units"))
    # one row joined to one row
    return total.crossJoin(counts).select("units", "bodies", "embedded", (F.col("bodies") - F.col("embedded")).alias("pending"), (F.col("units") > 0).alias("can_list"), (F.col("embedded") > 0).alias("can_search"))
