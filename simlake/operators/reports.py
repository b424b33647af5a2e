"""Aggregates behind reports: percentiles by nearest rank, and stratified splits."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

QUANTILES = {"p50": 0.5, "p90": 0.9, "p99": 0.99}


def token_report(rows: DataFrame, caps: Sequence[int] = (512, 2048), batch: int = 32) -> DataFrame:
    """By language and for all: units, tokens, nearest-rank percentiles, maximum, how many exceed each cap, and padding.

    ``padding_waste`` is the share of a batch's cells that hold no token when units are
    embedded in batches of ``batch`` in order of length, each cut at the largest cap.
    Everything comes from counts by value, so no task sorts the rows of a language.
    """
    counts = rows.groupBy("language", "tokens").agg(F.count("*").alias("k"))
    both = counts.unionByName(counts.groupBy("tokens").agg(F.sum("k").alias("k")).withColumn("language", F.lit("ALL")))
    own = W.partitionBy("language")
    both = both.withColumns({"upto": F.sum("k").over(own.orderBy("tokens")), "n": F.sum("k").over(own)})
    at = lambda q: F.min(F.when(F.col("upto") > F.floor((F.col("n") - 1) * q + 0.5), F.col("tokens")))
    over = [F.sum(F.when(F.col("tokens") > c, F.col("k")).otherwise(0)).alias(f"over_{c}") for c in caps]
    # a value of the count is the longest of the batches whose last unit has it
    cut, first = F.least("tokens", F.lit(max(caps))), F.col("upto") - F.col("k")
    ends = F.floor(F.col("upto") / batch) - F.floor(first / batch)
    rest = F.when(F.col("upto") == F.col("n"), F.col("n") % batch).otherwise(0)
    cells = F.sum(cut * (ends * batch + rest))
    waste = F.when(cells > 0, 1 - F.sum(cut * F.col("k")) / cells).otherwise(0.0)
    return both.groupBy("language").agg(F.sum("k").alias("units"), F.sum(F.col("tokens").cast("long") * F.col("k")).alias("tokens"), *(at(q).alias(n) for n, q in QUANTILES.items()), F.max("tokens").alias("max_tokens"), *over, waste.alias("padding_waste"))


# fixed values: marks of boilerplate, names that are boilerplate by themselves
MARKERS = ("todo", "panic(", "unimplemented", "notimplemented", "throw new", "assert", "return null", "return none", "return nil")
COMMON_NAMES = ("update", "fmt", "serialize", "deserialize")


def length_bucket(chars: str, tokens: str | None = None, most: int = 512) -> Column:
    """short, medium, long or near-max: by tokens where they are known, else by characters."""
    c = F.col(chars)
    by_chars = F.when(c >= 3 * most, "near-max").when(c >= most, "long").when(c <= 300, "short").otherwise("medium")
    if tokens is None:
        return by_chars
    t = F.col(tokens)
    return F.when(t.isNull(), by_chars).when(t >= int(most * 0.9), "near-max").when(t >= int(most * 0.5), "long").when(t <= 64, "short").otherwise("medium")


def boilerplate_heavy(text: str, name: str) -> Column:
    """Two or more kinds of marks, or a name that says it."""
    low = F.lower(F.coalesce(F.col(text), F.lit("")))
    return (sum((F.contains(low, F.lit(m)).cast("int") for m in MARKERS), F.lit(0)) >= 2) | F.col(name).isin(*COMMON_NAMES)


def stable_id(*parts: str) -> Column:
    """SHA-256 over the parts, each closed by a zero byte."""
    return F.sha2(F.concat(*(x for p in parts for x in (F.coalesce(F.col(p).cast("string"), F.lit("None")), F.lit("\0")))), 256)


def stratified_split(units: DataFrame, ratio: float, *, text: str = "text", tokens: str | None = None, is_test: Column | None = None, most: int = 512) -> DataFrame:
    """``unit_idx, stratum, part``: calibration or holdout by a hash of the id; strata by language, length, test and boilerplate."""
    size = units.withColumn("_chars", F.length(F.coalesce(F.col(text), F.lit(""))))
    marks = [F.when(is_test, "test").otherwise("prod") if is_test is not None else F.lit("prod"), F.when(boilerplate_heavy(text, "name"), "boilerplate").otherwise("plain")]
    share = F.conv(F.substring(F.sha2(F.col("unit_idx").cast("string"), 256), 1, 8), 16, 10).cast("double") / 4294967295.0
    return size.select("unit_idx", F.concat_ws("/", "language", length_bucket("_chars", tokens, most), *marks).alias("stratum"), F.when(share < ratio, "holdout").otherwise("calibration").alias("part"))


def write_split(split: DataFrame, units: DataFrame, directory: str) -> None:
    """The units of both parts as JSON lines below ``calibration`` and ``holdout``."""
    rows = units.join(split, "unit_idx")
    for part in ("calibration", "holdout"):
        rows.where(F.col("part") == part).drop("part").write.mode("overwrite").json(f"{directory.rstrip('/')}/{part}")
