"""The corpus pipeline: toxicity, near-duplicates, personal data, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns
of ``documents``.

Every stage takes documents as they are: nulls in any column, empty and very long texts,
repeated rows and ids, extra columns (which are left out), and an empty table, which gives
an empty table.  What a stage does with them is said at the stage.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from simlake.llm import bpe, mixing, near_dup, pii, toxicity
from simlake.llm.common import table
from simlake.plans.staging import release, scratch_base, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the last stage staged, by application: they go when the next one begins, as its input is written by then.
_last: dict[str, list[str]] = {}


def _stage(f: Stage) -> Stage:
    @wraps(f)
    def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        release(spark, _last.pop(app, []))
        before = set(written(spark))
        done = f(spark, docs, sf_dir)
        _last[app] = [path for path in written(spark) if path not in before]
        return done

    return call


@_stage
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject; null and empty texts score 0 and stay.  Without labels nothing is rejected."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, model).where("predicted = 0").select(*COLUMNS)


@_stage
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8): the smallest id.

    Rows are dropped, not ids: an id with two unlike texts keeps both.  Rows without words
    or id stay; of rows that repeat id and text one stays.
    """
    return near_dup.deduplicated(docs.select(*COLUMNS), k=5).select(*COLUMNS)


@_stage
def pseudonymise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pseudonyms in place of personal data; ``n_chars`` follows the text where it changed.  A null text stays null."""
    done = pii.pseudonymise(docs.select(*COLUMNS))
    return done.withColumn("n_chars", F.when(F.size("_pii_kinds") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


@_stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a document appears as often as it is taken; null is a source of its own, last."""
    return mixing.mix(docs).select(*COLUMNS)


@_stage
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids``: token ids packed as little-endian unsigned 32-bit integers; a null text has none."""
    done = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))
    return done.select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("pii", pseudonymise),
    ("mixing", mix_sources),
    ("bpe", encode),
]

#: Training and signatures have no SQL form; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    last: str | None = None
    hadoop = spark._jvm.org.apache.hadoop.fs
    for name, stage in STAGES:
        path = f"{scratch_base(spark)}/simlake-pipeline/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:  # what the stage read is no longer needed
            where = hadoop.Path(last)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
        last = path
    release(spark, _last.pop(spark.sparkContext.applicationId, []))
    return docs
