"""Interfaces: analyses, similarity indexes and embedders can be replaced by others of the same shape."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from simlake.functions.vectors import hash_embedding
from simlake.operators.similarity import similar_pairs, top_k_between, top_k_both


class SimilarityIndex(Protocol):
    """Answers both vector joins over ``id, v``."""

    def similar_pairs(self, vectors: DataFrame, threshold: float) -> DataFrame:
        """``a, b, score`` with a < b."""

    def top_k_between(self, left: DataFrame, right: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
        """``a, b, score, rank``."""

    def top_k_both(self, left: DataFrame, right: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
        """``a, b, score``: the best k of either direction, each pair once."""


@dataclass(frozen=True)
class ExactBlocks:
    """The default index: every pair, in blocks."""

    block: int | None = None

    def similar_pairs(self, vectors: DataFrame, threshold: float) -> DataFrame:
        return similar_pairs(vectors, threshold, block=self.block)

    def top_k_between(self, left: DataFrame, right: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
        return top_k_between(left, right, k, threshold, block=self.block)

    def top_k_both(self, left: DataFrame, right: DataFrame, k: int, threshold: float = -1.0) -> DataFrame:
        return top_k_both(left, right, k, threshold, block=self.block)


@dataclass(frozen=True)
class Contract:
    """What makes two vectors comparable."""

    provider: str
    model: str
    revision: str
    dimensions: int
    normalised: bool = True
    max_tokens: int | None = None


def contract_diff(a: Contract, b: Contract) -> list[str]:
    """Names of the fields in which two contracts differ."""
    x, y = asdict(a), asdict(b)
    return [name for name in x if x[name] != y[name]]


class Embedder(Protocol):
    """Vectors for texts; a text is a document or a query."""

    contract: Contract

    def embed(self, text: Column, role: str = "document") -> Column:
        """The vector of a text column as array<double>; null if it has none."""


@dataclass(frozen=True)
class HashEmbedder:
    """Hashed word counts: deterministic, and alike for documents and queries."""

    dimensions: int = 256

    @property
    def contract(self) -> Contract:
        return Contract("simlake", "hashed-words", "1", self.dimensions)

    def embed(self, text: Column, role: str = "document") -> Column:
        if role not in ("document", "query"):
            raise ValueError(f"a text is a document or a query, not {role!r}")
        return hash_embedding(text, self.dimensions)


def query_vector(spark, embedder: Embedder, text: str, stored: Contract | None = None) -> Sequence[float]:
    """A query's vector; raises if the stored vectors were made under another contract."""
    if stored is not None and (differ := contract_diff(stored, embedder.contract)):
        raise ValueError(f"the index was embedded with another {', '.join(differ)}: embed again")
    found = spark.range(1).select(embedder.embed(F.lit(text), "query").alias("v")).first()["v"]
    return found or [0.0] * embedder.contract.dimensions


class Analyzer(Protocol):
    """An analysis over units with vectors."""

    def run(self, units: DataFrame, config: object) -> dict[str, object]:
        """Named tables."""


class Duplicates:
    """Duplicate clusters as an analyzer."""

    def run(self, units: DataFrame, config: object) -> dict[str, object]:
        from simlake.analyze.duplicates import duplicates

        return duplicates(units, config)


@dataclass(frozen=True)
class Comparison:
    """The comparison of two projects as an analyzer."""

    left: str
    right: str

    def run(self, units: DataFrame, config: object) -> dict[str, object]:
        from simlake.analyze.compare import compare

        return compare(units, self.left, self.right, config)
