"""The seam for embedding models, and the registry of retrieval strategies."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vectors import unit
from . import bm25, search
from .materials import TextSource

DISTANCES, KINDS = {"cosine", "l2", "inner"}, {"dense_text", "dense_image", "sparse_text"}


@dataclass(frozen=True)
class Provider:
    """A model that gives texts or pictures vectors: its name, size, distance, how many it takes at once, and what it supports.

    ``dense`` takes texts; ``image`` pictures (bytes); ``sparse`` a DataFrame (doc_id, text) and gives doc_id, term_id, weight.
    """

    model_id: str
    size: int = 0
    dense: Callable[[list[str]], list[list[float]]] | None = None
    distance: str = "cosine"
    max_batch: int = 64
    image: Callable[[list[bytes]], list[list[float]]] | None = None
    sparse: Callable[[DataFrame], DataFrame] | None = None
    supports: frozenset[str] = frozenset({"dense_text"})

    def __post_init__(self):
        given = {"dense_text": self.dense, "dense_image": self.image, "sparse_text": self.sparse}
        if not self.supports or self.supports - KINDS or any(given[k] is None for k in self.supports):
            raise ValueError(f"{self.model_id} does not support {sorted(self.supports)}")
        if self.distance not in DISTANCES or self.max_batch <= 0 or self.size < 0 or (self.size == 0 and self.supports != {"sparse_text"}):
            raise ValueError(f"not a provider: {self.distance}, {self.size}, {self.max_batch}")

    def needs(self, kind: str) -> None:
        if kind not in self.supports:
            raise ValueError(f"{self.model_id} has no {kind}")


def hash_vectors(texts: list[str], size: int = 1024) -> list[list[float]]:
    """Counts of tokens by a hash, of length 1: an offline stand-in for a model. A text without tokens is zero."""
    out = []
    for t in texts:
        v = np.zeros(size)
        for token in re.findall("[a-z0-9]+", t.lower()):
            v[int.from_bytes(blake2b(token.encode(), digest_size=8).digest(), "big") % size] += 1
        out.append((v / (np.sqrt(v @ v) or 1)).tolist())
    return out


def hash_provider(size: int = 1024) -> Provider:
    return Provider(f"local-hash-{size}", size, lambda texts: hash_vectors(texts, size))


def bm25_provider(fitted: bm25.Fitted) -> Provider:
    """A fitted model as a provider of sparse vectors; another fit needs another version in its name."""
    return Provider(fitted.model_id, sparse=fitted.sparse_text, supports=frozenset({"sparse_text"}))


def provider(name: str, spark: SparkSession | None = None, model_path: str | None = None) -> Provider:
    """By name: hash, or bm25 with the folder of a fitted model."""
    if name == "hash":
        return hash_provider()
    if name == "bm25":
        if spark is None or model_path is None:
            raise ValueError("bm25 needs a fitted model")
        return bm25_provider(bm25.load(spark, model_path))
    raise ValueError(f"no provider {name!r}")


def embed_images(rows: DataFrame, provider: Provider, key: str = "doc_id") -> DataFrame:
    """key, embedding, model of ``rows`` (key, picture: binary); rows without picture drop out."""
    provider.needs("dense_image")
    return _embedded(rows.where("picture is not null").select(key, "picture"), "picture", provider, provider.image, key)


def embed(rows: DataFrame, provider: Provider, key: str = "doc_id", prefix: str = "") -> DataFrame:
    """key, embedding, model of ``rows`` (key, text); null texts are empty. ``prefix``: what a model wants before queries. Vectors of
    another size are an error."""
    provider.needs("dense_text")
    text = F.concat(F.lit(prefix), F.coalesce("text", F.lit(""))).alias("text")
    return _embedded(rows.select(key, text), "text", provider, provider.dense, key)


def embed_queries(queries: DataFrame, provider: Provider, prefix: str = "") -> DataFrame:
    """qid and embedding, of length 1, of ``queries`` (qid, text)."""
    return embed(queries, provider, "qid", prefix).select("qid", unit(F.col("embedding")).cast("array<float>").alias("embedding"))


def _embedded(rows: DataFrame, column: str, provider: Provider, make: Callable, key: str) -> DataFrame:
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), provider.max_batch):
                part = batch.iloc[k : k + provider.max_batch]
                vectors = make(part[column].tolist())
                if any(len(v) != provider.size for v in vectors):
                    raise ValueError(f"{provider.model_id}: vectors are not of {provider.size}")
                yield pd.DataFrame({key: part[key].to_numpy(), "embedding": vectors, "model": provider.model_id})

    return rows.mapInPandas(run, f"{key} {kind}, embedding array<float>, model string")


@dataclass(frozen=True)
class Strategy:
    """A named way to rank: ``hits`` of queries (qid, text) over documents (doc_id, text), to qid, doc_id, score, rank. ``spec`` says of
    what it is made, read off its parts; ``arm`` is its name within another."""

    name: str
    hits: Callable[[DataFrame, DataFrame, int], DataFrame] = field(repr=False)
    spec: dict = field(default_factory=dict)

    def manifest(self, texts: TextSource) -> dict:
        """What a run of it over these texts is, for its manifest and its hash."""
        return {"strategy": self.name, **texts.spec, **self.spec}


def sparse(model: bm25.Bm25) -> Strategy:
    hits = lambda queries, docs, k: bm25.top_hits(queries, docs, k, model)
    return Strategy(f"bm25-{model.idf_side}", hits, asdict(model))


def dense(provider: Provider, prefix: str = "", name: str = "dense") -> Strategy:
    """``name``: a stand-in goes by its own, and its spec names the provider only."""

    def hits(queries, docs, k):
        q, d = embed(queries, provider, "qid", prefix), embed(docs, provider)
        return search.dense_top(q, d, k, provider.distance)

    own = {"model": provider.model_id, "dim": provider.size, "query_prefix": bool(prefix)} if name == "dense" else {"provider": provider.model_id}
    return Strategy(name, hits, own)


def fused(*arms: Strategy) -> Strategy:
    """Reciprocal ranks of the arms; the spec has what the arms' models are, but for those that need none."""

    def hits(queries, docs, k):
        depth = max(search.DEPTH, k)
        return search.fuse({arm.name: arm.hits(queries, docs, depth) for arm in arms}, k)

    models = {key: value for arm in arms if "model" in arm.spec for key, value in arm.spec.items()}
    return Strategy("rrf", hits, models | {"rrf_k": search.RRF_K, "arm_depth": search.DEPTH, "arms": [arm.name for arm in arms]})


def _with(provider: Provider | None, name: str) -> Provider:
    if provider is None:
        raise ValueError(f"{name} needs a provider")
    return provider


#: How each is put together of a provider and what the provider wants before queries.
REGISTRY: dict[str, Callable[[Provider | None, str], Strategy]] = {
    "bm25-both": lambda p, prefix: sparse(bm25.Bm25(idf_side="both")),
    "bm25-query": lambda p, prefix: sparse(bm25.Bm25()),
    "hash-dense": lambda p, prefix: dense(hash_provider(), name="hash-dense"),
    "dense": lambda p, prefix: dense(_with(p, "dense"), prefix),
    "rrf": lambda p, prefix: fused(sparse(bm25.Bm25()), dense(_with(p, "rrf"), prefix)),
}


def strategy(name: str, provider: Provider | None = None, prefix: str = "") -> Strategy:
    """By name: bm25-query, bm25-both, hash-dense, dense, rrf; the last two with a provider, and a prefix for queries if it wants one.

    Documents are what :class:`tessella.operators.materials.TextSource` makes.
    """
    if name not in REGISTRY:
        raise ValueError(f"no strategy {name!r}; there are {', '.join(REGISTRY)}")
    return REGISTRY[name](provider, prefix)
