"""Reranking of candidates by a pluggable scorer."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import top_k_or
from corpusloom.errors import RerankingError
from corpusloom.functions.text import tokenize

#: Pairs of (question, passage) to scores, as a cross-encoder has it.
Scorer = Callable[[list[tuple[str, str]]], object]


def overlap(query: Column, content: Column) -> Column:
    """Share of the question's distinct words that the passage has: a stand-in for a trained scorer, as a plain expression."""
    asked = F.array_distinct(tokenize(query, None))
    return F.coalesce(F.size(F.array_intersect(asked, tokenize(content, None))) / F.nullif(F.size(asked), F.lit(0)), F.lit(0.0))


def scored_by(scorer: Scorer, query: Column, content: Column) -> Column:
    """The scorer's numbers in Arrow batches. One number for each pair, all finite, or the job stops."""

    @F.pandas_udf("double")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, c in batches:
            got = scorer(list(zip(q, c, strict=True)))
            got = got.tolist() if hasattr(got, "tolist") else got
            numbers = [float(got)] if np.isscalar(got) else [float(x) for x in got]
            if len(numbers) != len(q):
                raise RerankingError(f"the scorer gave {len(numbers)} scores for {len(q)} pairs")
            if not all(map(math.isfinite, numbers)):
                raise RerankingError("the scorer gave a score that is not finite")
            yield pd.Series(numbers, dtype=float)

    return run(query, content)


def rerank(candidates: DataFrame, k: int | None = None, score: Column | None = None) -> DataFrame:
    """The k best candidates of each question by the reranker.

    candidates: (query_id, query, rank, chunk_id, content, score, ...). Of equal chunks the first
    counts; equal reranker scores keep the order of retrieval. `score` stays, `retrieval_score` and
    `reranker_score` are added.
    """
    k = top_k_or(k, 5)
    first = Window.partitionBy("query_id", "chunk_id").orderBy("rank")
    once = candidates.withColumn("_first", F.row_number().over(first)).where("_first = 1").drop("_first")
    number = overlap(F.col("query"), F.col("content")) if score is None else score
    once = once.withColumn("retrieval_score", F.col("score")).withColumn("reranker_score", number).withColumnRenamed("rank", "retrieval_rank")
    order = Window.partitionBy("query_id").orderBy(F.col("reranker_score").desc(), "retrieval_rank", "chunk_id")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
