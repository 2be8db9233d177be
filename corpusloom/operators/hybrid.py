"""Reciprocal rank fusion of dense and keyword hits, and the hybrid retriever."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.config import SettingsError, real, top_k_or, whole


def fuse(semantic: DataFrame | None, keyword: DataFrame | None, weights: tuple[float, float] = (1.0, 1.0), rrf_k: int = 60, k: int | None = None) -> DataFrame:
    """(query_id, rank, chunk_id, chunk_ord, score, semantic_rank, keyword_rank) from two of (query_id, rank, chunk_id, chunk_ord).

    A side of weight 0, or that is None, is left out of the plan. Equal scores go by chunk_id.
    """
    k = top_k_or(k, 10)
    whole("rrf_k", rrf_k, 1, 1000)
    w = [real("weight", x, 0, 10) for x in weights]
    if not any(w):
        raise SettingsError("the weights must not both be 0")
    sides = []
    for name, hits, weight in (("semantic", semantic, w[0]), ("keyword", keyword, w[1])):
        if hits is not None and weight > 0:
            none = F.lit(None).cast("int")
            rank = F.col("rank").cast("int")
            sides.append(
                hits.select("query_id", "chunk_id", "chunk_ord", (F.lit(weight) / (rrf_k + F.col("rank"))).alias("part"), (rank if name == "semantic" else none).alias("semantic_rank"), (rank if name == "keyword" else none).alias("keyword_rank"))
            )
    both = sides[0] if len(sides) == 1 else sides[0].unionByName(sides[1])
    fused = both.groupBy("query_id", "chunk_id").agg(
        F.min("chunk_ord").alias("chunk_ord"), F.sum("part").alias("sum"), F.max("semantic_rank").alias("semantic_rank"), F.max("keyword_rank").alias("keyword_rank")
    )
    order = Window.partitionBy("query_id").orderBy(F.round("sum", 12).desc(), "chunk_id")
    ranked = fused.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "chunk_id", "chunk_ord", F.round("sum", 8).alias("score"), "semantic_rank", "keyword_rank")
