"""Embeddings and exact dense retrieval.

A batch of questions is packed into matrices of a bounded size; each pass over the vectors multiplies
an Arrow batch by one matrix and keeps k candidates a question and batch, so what is shuffled is
candidates, never scores of all pairs.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import reduce
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import real, top_k_or
from corpusloom.functions.text import query_error, semantic_query
from corpusloom.operators.bm25 import top_k

#: Bytes of question vectors that one pass carries to the executors.
MATRIX_BYTES = 32 << 20


class Embedder(Protocol):
    """Texts to vectors of one length; loaded once for each Python worker."""

    dimension: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


#: Buckets that a worker remembers, and how many at most.
_buckets: dict[str, int] = {}
_BUCKETS_MOST = 1 << 18


def _bucket(word: str, dimension: int) -> int:
    n = _buckets.get(word)
    if n is None:
        if len(_buckets) >= _BUCKETS_MOST:
            _buckets.clear()
        n = _buckets[word] = int(hashlib.md5(word.encode()).hexdigest()[:8], 16)
    return n % dimension


class HashingEmbedder:
    """Counts of words in md5 buckets, scaled to length 1: deterministic, a stand-in for a trained model."""

    def __init__(self, dimension: int = 64) -> None:
        self.dimension = dimension

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension))
        for i, text in enumerate(texts):
            for w in re.findall(r"[^\W]+", text.lower()):
                out[i, _bucket(w, self.dimension)] += 1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)


def embed(text: Column, embedder: Embedder, batch_size: int | None = None) -> Column:
    """array<double> of a text, in Arrow batches, `batch_size` texts to a call; an empty text has a zero vector."""

    @F.pandas_udf("array<double>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            all_texts = [t or "" for t in texts]
            step = batch_size or max(1, len(all_texts))
            yield pd.Series([v for at in range(0, len(all_texts), step) for v in embedder.embed(all_texts[at : at + step])], dtype=object)

    return run(text)


def normalized(vector: Column) -> Column:
    """array<double> of length 1; null for a null or zero vector."""
    doubled = vector.cast("array<double>")
    norm = F.sqrt(F.aggregate(doubled, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(doubled, lambda x: x / norm))


def packs(questions: DataFrame, dimension: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of (query_id, v), in matrices of MATRIX_BYTES at most."""
    rows = max(1, MATRIX_BYTES // (8 * max(1, dimension)))
    ids, vectors = [], []
    for r in questions.toLocalIterator(prefetchPartitions=True):
        ids.append(r["query_id"])
        vectors.append(r["v"])
        if len(ids) == rows:
            yield np.array(ids), np.array(vectors, float)
            ids, vectors = [], []
    if ids:
        yield np.array(ids), np.array(vectors, float)


def similar(questions: DataFrame, vectors: DataFrame, k: int | None = None, min_score: float | None = None, dimension: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_ord, score): the k rows of (chunk_ord, v) of greatest cosine for each of (query_id, v).

    Questions and vectors of another length than `dimension` have no cosine and no hits; without one
    given it is the most frequent length of the vectors (of equally frequent ones the smallest).
    """
    k = top_k_or(k, 10)
    if min_score is not None:
        real("min_score", min_score, -1, 1)
    spark: SparkSession = vectors.sparkSession
    unit = vectors.select("chunk_ord", normalized(F.col("v")).alias("v")).where("v is not null")
    asked = questions.select("query_id", normalized(F.col("v")).alias("v")).where("v is not null")
    kind = dict(questions.dtypes)["query_id"]
    schema = f"query_id {kind}, chunk_ord bigint, score double"
    if dimension is None:
        sizes = vectors.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dimension = sizes["d"] if sizes else 0
    same = unit.where(F.size("v") == dimension)
    parts = [same.mapInPandas(_scan(ids, matrix, k, min_score), schema) for ids, matrix in packs(asked.where(F.size("v") == dimension), dimension)]
    if not parts:
        return spark.createDataFrame([], f"query_id {kind}, rank int, chunk_ord bigint, score double")
    return top_k(reduce(DataFrame.unionByName, parts), k).select("query_id", "rank", "chunk_ord", "score")


def _scan(ids: np.ndarray, matrix: np.ndarray, k: int, min_score: float | None) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            b = b.sort_values("chunk_ord")
            ords = b["chunk_ord"].to_numpy()
            s = np.clip(matrix @ np.stack(b["v"].to_numpy()).T, -1.0, 1.0)
            shown = np.round(s, 9)
            out = []
            for q, row, exact in zip(ids, shown, s, strict=True):
                if len(row) > k:
                    least = np.partition(row, len(row) - k)[len(row) - k]
                    above, equal = np.flatnonzero(row > least), np.flatnonzero(row == least)  # in the order of chunk_ord
                    best = np.concatenate([above, equal[: k - len(above)]])
                else:
                    best = np.arange(len(row))
                if min_score is not None:
                    best = best[exact[best] >= min_score]
                out.append(pd.DataFrame({"query_id": q, "chunk_ord": ords[best], "score": exact[best]}))
            yield pd.concat(out)

    return run


def semantic_search(questions: DataFrame, vectors: DataFrame, embedder: Embedder, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """`similar` for the valid rows of (query_id, query)."""
    valid = questions.where(query_error("query").isNull())
    return similar(valid.select("query_id", embed(semantic_query("query"), embedder).alias("v")), vectors, k, min_score, embedder.dimension)
