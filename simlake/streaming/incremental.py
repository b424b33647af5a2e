"""Incremental upkeep of the facts: what changed, what is pending, what is orphaned."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from simlake.plans.staging import staged

KEYS = ["project", "relative_path"]


def changes(known: DataFrame, seen: DataFrame) -> DataFrame:
    """``project, relative_path, status``: new, changed, unchanged or removed.

    Both have ``project, relative_path, mtime_ns, size, source_hash``.  Equal time and
    size are unchanged without a look at the hash; else the hash decides.
    """
    old, new = (d.select(*KEYS, F.struct("mtime_ns", "size", "source_hash").alias(n)) for d, n in ((known, "old"), (seen, "new")))
    rows = old.join(new, KEYS, "full_outer")
    same = ((F.col("old.mtime_ns") == F.col("new.mtime_ns")) & (F.col("old.size") == F.col("new.size"))) | (F.col("old.source_hash") == F.col("new.source_hash"))
    status = F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return rows.select(*KEYS, status.alias("status"))


def index_stats(statuses: DataFrame, units: DataFrame) -> DataFrame:
    """One row: files indexed, skipped, removed and the units in the index."""
    s = F.col("status")
    counts = statuses.agg(F.count_if(s.isin("new", "changed")).alias("indexed"), F.count_if(s == "unchanged").alias("skipped"), F.count_if(s == "removed").alias("removed"))
    return counts.crossJoin(units.agg(F.count("*").alias("units")))  # one row joined to one row


def refreshed(units: DataFrame, statuses: DataFrame, extracted: DataFrame) -> DataFrame:
    """Units after an upsert: those of unchanged files, and what was extracted from the rest."""
    kept = units.join(statuses.where("status = 'unchanged'").select(*KEYS), KEYS, "left_semi")
    return kept.unionByName(extracted)


def pruned(embeddings: DataFrame, units: DataFrame) -> DataFrame:
    """Embeddings whose body still occurs."""
    return embeddings.join(units.select("body_hash").distinct(), "body_hash", "left_semi")


def pending(units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """One unit for each body without an embedding."""
    return units.join(embeddings.select("body_hash"), "body_hash", "left_anti").dropDuplicates(["body_hash"])


def embed_paged(todo: DataFrame, embed: Callable[[DataFrame], DataFrame], append: Callable[[DataFrame], None], page: int = 100_000) -> int:
    """Embed each pending body once, in pages of about ``page`` that are appended as they are done.

    What breaks off keeps the pages before it; the rest is pending again.
    """
    todo = staged(todo, "pending")
    n = todo.count()
    pages = max(1, -(-n // page))
    for at in range(pages if n else 0):
        append(embed(todo.where(F.pmod(F.xxhash64("body_hash"), F.lit(pages)) == at)))
    return n


def embed_stream(files: DataFrame, path: str, checkpoint: str, embed: Callable[[DataFrame], DataFrame]):
    """Structured Streaming: each new batch of units (``body_hash, text``) is embedded once and appended at ``path``."""

    def batch(rows: DataFrame, _: int) -> None:
        try:
            known = rows.sparkSession.read.parquet(path).select("body_hash")
        except Exception as e:  # nothing is embedded before the first batch
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            known = rows.select("body_hash").limit(0)
        todo = rows.dropDuplicates(["body_hash"]).join(known, "body_hash", "left_anti")
        embed(todo).write.mode("append").parquet(path)

    return files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
