"""Plug points for models: a reranker scores the pool of a question, an embedder gives texts vectors.

A backend is a small picklable object; Spark decides where it runs. A question's pool is one row
(at most POOL texts), texts to embed come in Arrow batches, so neither grows with the corpus.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from groundwork.operators.retrieval import POOL, TOP_N

WORD = re.compile(r"[^\W_]+")


class Reranker(Protocol):
    enabled: bool

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        """A score for each text, in their order; larger is better. Another number of scores leaves the order as it was."""


class Embedder(Protocol):
    name: str
    size: int

    def embed(self, texts: Sequence[str], kind: str) -> np.ndarray:
        """A row of `size` numbers for each text; kind is `query` or `passage`."""


class NullReranker:
    """Leaves the fused order as it is."""

    enabled = False

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        return []


class OverlapReranker:
    """The share of the question's different words that a text has."""

    enabled = True

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        asked = set(WORD.findall(query.lower()))
        return [len(asked & set(WORD.findall(t.lower()))) / max(1, len(asked)) for t in texts]


def _features(query: str, text: str) -> np.ndarray:
    """What the linear reranker looks at: shares of words and of three-letter pieces that are met, the order kept, lengths."""
    asked, words = WORD.findall(query.lower()), WORD.findall(text.lower())
    have, pairs = set(words), set(zip(words, words[1:], strict=False))
    own = {query[k : k + 3].lower() for k in range(len(query) - 2)}
    pieces = {text[k : k + 3].lower() for k in range(len(text) - 2)}
    two = list(zip(asked, asked[1:], strict=False))
    return np.array([
        1.0, sum(w in have for w in asked) / max(1, len(asked)), sum(p in pairs for p in two) / max(1, len(two)), len(own & pieces) / max(1, len(own)),
        sum(w in have for w in asked if len(w) > 5) / max(1, sum(len(w) > 5 for w in asked)), math.log1p(len(words)) / 10,
    ])


@dataclass(frozen=True)
class LinearReranker:
    """A logistic model over word and piece overlaps; scores are its logits."""

    weights: tuple[float, ...]
    enabled: bool = True

    def score(self, query: str, texts: Sequence[str]) -> list[float]:
        return [float(_features(query, t) @ np.array(self.weights)) for t in texts]

    @classmethod
    def fitted(cls, pairs: DataFrame, most: int = 4000, steps: int = 300, penalty: float = 1e-3) -> LinearReranker:
        """Fitted to pairs (query, text, good boolean), at most `most` of them, those whose hashes come first."""
        rows = pairs.where("query is not null and text is not null").orderBy(F.xxhash64("query", "text"), "query", "text").limit(most).collect()
        x = np.array([_features(r.query, r.text) for r in rows])
        y = np.array([float(r.good) for r in rows])
        w = np.zeros(x.shape[1] if rows else 6)
        for _ in range(steps if rows else 0):  # Newton's method, damped by the penalty
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty * len(rows) * np.eye(len(w)), x.T @ (p - y) + penalty * len(rows) * w)
            w -= step
            if np.abs(step).max() < 1e-9:
                break
        return cls(tuple(map(float, w)))


@dataclass(frozen=True)
class NullEmbedder:
    """Zero vectors, which no search by angle takes for a direction: words alone decide."""

    size: int = 8
    name: str = "none"

    def embed(self, texts: Sequence[str], kind: str) -> np.ndarray:
        return np.zeros((len(texts), self.size))


@dataclass(frozen=True)
class SubspaceEmbedder:
    """Hashed pieces of words, by inverse document share, projected on the directions in which a sample of texts differs most."""

    weights: np.ndarray = field(repr=False)
    axes: np.ndarray = field(repr=False)
    name: str = "subspace"

    @property
    def size(self) -> int:
        return self.axes.shape[1]

    def embed(self, texts: Sequence[str], kind: str) -> np.ndarray:
        return _counts(texts, len(self.weights)) * self.weights @ self.axes

    @classmethod
    def fitted(cls, docs: DataFrame, text: str = "text", size: int = 32, buckets: int = 2048, most: int = 1000) -> SubspaceEmbedder:
        """Fitted to at most `most` texts, those whose hashes come first."""
        rows = docs.where(F.col(text).isNotNull()).select(text).orderBy(F.xxhash64(text), text).limit(most).collect()
        counts = _counts([r[0] for r in rows], buckets)
        weights = np.log((1 + len(rows)) / (1 + (counts > 0).sum(axis=0)))
        _, _, axes = np.linalg.svd(counts * weights, full_matrices=False)
        axes = axes[:size].T
        axes = axes * np.where(axes.sum(axis=0) < 0, -1.0, 1.0)  # an axis has no sign of its own
        return cls(weights, np.pad(axes, ((0, 0), (0, size - axes.shape[1]))))


def _counts(texts: Sequence[str], buckets: int) -> np.ndarray:
    out = np.zeros((len(texts), buckets))
    for k, text in enumerate(texts):
        for word in WORD.findall(text.lower()):
            padded = f"<{word}>"
            for i in range(max(1, len(padded) - 3)):
                out[k, xxhash.xxh3_64_intdigest(padded[i : i + 4]) % buckets] += 1
        out[k] = np.sqrt(out[k])
    return out


def confidence(logit: float) -> float:
    """A logit between 0 and 1, in the same order."""
    small = math.exp(-abs(logit))
    return (1.0 if logit >= 0 else small) / (1.0 + small)


def rerank(found: DataFrame, questions: DataFrame, docs: DataFrame, backend: Reranker, query: str, key: str, n: int = TOP_N) -> DataFrame:
    """found (query, key, position, ...) with rerank_score, and position after the pool's scores; the tail keeps its order.

    The pool is a question's first max(n, 20) rows. Equal scores keep the fused order. A backend that
    is not enabled, or gives a question another number of scores than texts, leaves that order;
    rerank_score is then null. A null text counts as empty. questions: query, text; docs: key, text.
    """
    if not backend.enabled:
        return found.withColumn("rerank_score", F.lit(None).cast("double"))
    most = max(n, POOL)
    pool = found.where(F.col("position") <= most).select(query, key, "position").join(docs.select(key, F.coalesce("text", F.lit("")).alias("passage")), key)
    rows = pool.groupBy(query).agg(F.sort_array(F.collect_list(F.struct("position", key, "passage"))).alias("pool")).join(questions.select(query, F.coalesce("text", F.lit("")).alias("asked")), query)
    kinds = dict(found.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                scores = backend.score(row["asked"], [p["passage"] for p in row["pool"]])
                told = [confidence(s) for s in scores] if len(scores) == len(row["pool"]) else [None] * len(row["pool"])
                columns = [batch.schema.field(query).type, batch.schema.field("pool").type.value_type.field(key).type, pa.float64()]
                values = [[row[query]] * len(told), [p[key] for p in row["pool"]], told]
                yield pa.RecordBatch.from_arrays([pa.array(v, c) for v, c in zip(values, columns, strict=True)], [query, key, "rerank_score"])

    scores = rows.select(query, "asked", "pool").mapInArrow(run, f"{query} {kinds[query]}, {key} {kinds[key]}, rerank_score double")
    out = found.join(scores, [query, key], "left")
    order = Window.partitionBy(query).orderBy((F.col("position") <= most).desc(), F.col("rerank_score").desc_nulls_last(), "position")
    return out.withColumn("position", F.row_number().over(order))


def embedded(texts: DataFrame, backend: Embedder, key: str, kind: str = "passage", text: str = "text") -> DataFrame:
    """(key, embedding): a vector for each row; a null text is empty, a row with a null key is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                vectors = np.asarray(backend.embed(part.column(1).to_pylist(), kind), np.float64).reshape(part.num_rows, -1)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(vectors), pa.list_(pa.float64()))], [key, "embedding"])

    rows = texts.where(F.col(key).isNotNull()).select(key, F.coalesce(text, F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, embedding array<double>")
