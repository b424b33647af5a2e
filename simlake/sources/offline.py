"""Facts for work outside the store: one joined table, and JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def joined(units: DataFrame, files: DataFrame, projects: DataFrame) -> DataFrame:
    """Units with what is known of their files and projects; ``projects`` has ``label``."""
    facts = [c for c in files.columns if c not in units.columns]
    rows = units.join(files.select("project", "relative_path", *facts), ["project", "relative_path"])
    return rows.join(projects.withColumnRenamed("label", "project"), "project")


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """A table from JSON lines; a line that is no object fails the read."""
    reader = spark.read.option("mode", "FAILFAST")
    return (reader.schema(schema) if schema else reader).json(path)
