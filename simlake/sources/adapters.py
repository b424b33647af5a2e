"""The fact model over plain tables: units and their vectors from ``embeddings`` or ``documents``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.functions.vectors import hash_embedding


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def units_from_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units without vectors; every tenth body is an exact copy of its neighbour."""
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings")
    body = F.when(i % 10 == 9, i - 1).otherwise(i)
    below = F.when(i % 7 == 3, "Utils").when(i % 7 == 5, "examples").otherwise(F.concat(F.lit("d"), (i % 7).cast("string")))
    ending = F.when(i % 11 == 0, "_test.rs").when(i % 11 == 4, ".spec.rs").otherwise(".rs")
    return rows.select(
        i.alias("unit_idx"), F.when(i % 2 == 0, "v1").otherwise("v2").alias("project"),
        F.concat_ws("/", F.concat(F.lit("m"), F.col("label").cast("string")), below, F.concat(F.lit("u"), F.floor(i / 4).cast("string"), ending)).alias("relative_path"),
        F.when(i % 3 == 0, "python").otherwise("rust").alias("language"), F.when(i % 5 == 0, "method").otherwise("function").alias("kind"),
        F.concat(F.lit("f"), F.when(i % 3 == 0, F.floor(i / 4)).otherwise(i % 25).cast("string")).alias("name"), F.when(i % 4 != 0, F.concat(F.lit("S"), F.col("label").cast("string"))).alias("scope"),
        ((i % 4) * 60).alias("start_byte"), ((i % 4) * 60 + 80).alias("end_byte"), ((i % 4) * 6 + 1).alias("start_line"), ((i % 4) * 6 + 9).alias("end_line"),
        (F.lit(10) + i % 30).alias("body_node_count"), F.sha2(F.concat(F.lit("body:"), body.cast("string")), 256).alias("body_hash"),
    )


def body_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``body_hash, vector``: one for each distinct body; one body in fifty is not embedded."""
    i = F.col("vec_id")
    rows = table(spark, sf_dir, "embeddings").where((i % 10 != 9) & (i % 50 != 7))
    return rows.select(F.sha2(F.concat(F.lit("body:"), i.cast("string")), 256).alias("body_hash"), F.col("embedding").alias("vector"))


def with_vectors(units: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Units with the vector of their body; null where there is none."""
    return units.join(embeddings, "body_hash", "left")


def units_from_documents(spark: SparkSession, sf_dir: str, dimensions: int = 256) -> DataFrame:
    """Documents as units, with hashed word counts as vectors."""
    i, text = F.col("doc_id"), F.coalesce(F.col("text"), F.lit(""))
    plain = F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))
    return table(spark, sf_dir, "documents").select(
        i.alias("unit_idx"), F.when(i % 2 == 0, "v1").otherwise("v2").alias("project"), F.concat("lang", F.lit("/"), "source", F.lit("/doc_"), i.cast("string"), F.lit(".txt")).alias("relative_path"),
        F.col("lang").alias("language"), F.lit("document").alias("kind"), F.substring_index(plain, " ", 1).alias("name"), F.col("source").alias("scope"),
        F.lit(0).cast("long").alias("start_byte"), F.octet_length(text).cast("long").alias("end_byte"), F.lit(1).cast("long").alias("start_line"), (F.size(F.split(text, "\n"))).cast("long").alias("end_line"),
        F.size(F.split(plain, " ")).cast("long").alias("body_node_count"), F.sha2(plain, 256).alias("body_hash"), hash_embedding(text, dimensions).alias("vector"),
    )
