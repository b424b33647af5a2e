"""Vectors as array columns, computed in double precision."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product, summed in order."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def bound(value: Column, f) -> Column:
    """``f(value)`` with the value evaluated once; a lambda would evaluate it for every element."""
    return F.transform(F.array(value), f)[0]


def normalised(v: str | Column) -> Column:
    """Unit length; a zero vector stays as it is."""

    def scale(w: Column) -> Column:
        return bound(F.sqrt(dot(w, w)), lambda n: F.transform(w, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double"))))

    return bound(_c(v), scale)


def truncated(v: str | Column, dimensions: int) -> Column:
    """The first components, to unit length again."""
    return normalised(F.slice(_c(v), 1, dimensions))


def largest_difference(a: str | Column, b: str | Column) -> Column:
    return F.array_max(F.zip_with(_c(a), _c(b), lambda x, y: F.abs(x.cast("double") - y.cast("double"))))


def hash_embedding(text: str | Column, dimensions: int = 256) -> Column:
    """Counts of lower-cased words hashed into ``dimensions`` buckets, to unit length; null without words.

    Words and their buckets are found in the JVM; a text's buckets are counted in one pass
    over an Arrow batch.
    """
    words = F.filter(F.split(F.lower(_c(text)), "[^a-z0-9]+"), lambda w: w != "")
    buckets = F.transform(words, lambda w: (F.conv(F.substring(F.md5(w), 1, 4), 16, 10).cast("int") % dimensions).cast("int"))

    def counted(column: pd.Series) -> pd.Series:
        def one(found: np.ndarray | None) -> np.ndarray | None:
            if found is None or not len(found):
                return None
            n = np.bincount(found, minlength=dimensions).astype(np.float64)
            return n / np.sqrt(n @ n)

        return column.map(one)

    counted.__annotations__ = {"column": pd.Series, "return": pd.Series}
    return F.pandas_udf(counted, "array<double>")(buckets)
