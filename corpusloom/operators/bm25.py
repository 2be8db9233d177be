"""The keyword index (BM25) as DataFrames, and batch search over it.

postings(term, chunk_ord, tf, dl), df(term, df) and corpus(n, avgdl) are the index. A search first
reduces the questions to (query_id, term, qtf); where their vocabulary passes the size check it is
broadcast and cuts the tokens down before anything is shuffled, else it is joined by term.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.config import real, top_k_or
from corpusloom.functions.text import STOP_WORDS, keyword_query, query_error, tokenize
from corpusloom.operators.store import ChunkStore

#: Rows of a question side that may be broadcast.
BROADCAST_ROWS = 200_000


@dataclass(frozen=True)
class Bm25Index:
    """chunk_tokens(chunk_ord, tokens, dl) and the sums over it."""

    tokens: DataFrame
    corpus: DataFrame
    stop_words: tuple[str, ...] | None
    k1: float
    b: float

    def postings(self, vocabulary: DataFrame | None = None) -> DataFrame:
        """(term, chunk_ord, tf, dl), of the given terms only if there are any given."""
        rows = self.tokens.select("chunk_ord", "dl", F.explode("tokens").alias("term"))
        if vocabulary is not None:
            rows = rows.join(vocabulary, "term", "left_semi")
        return rows.groupBy("term", "chunk_ord", "dl").agg(F.count("*").alias("tf"))

    def document_frequency(self, postings: DataFrame | None = None) -> DataFrame:
        """(term, df). Counting by tf keeps that column, so the plan reuses the postings' exchange."""
        rows = self.postings() if postings is None else postings
        return rows.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df"))


def build_index(chunks: DataFrame, stop_words: tuple[str, ...] | None = STOP_WORDS, k1: float = 1.5, b: float = 0.75) -> Bm25Index:
    """Index of (chunk_ord, content); chunks without a word still count in n."""
    real("k1", k1, 0, float("inf"))
    real("b", b, 0, 1)
    tokens = chunks.select("chunk_ord", tokenize("content", stop_words).alias("tokens"))
    tokens = tokens.select("chunk_ord", "tokens", F.size("tokens").alias("dl"))
    corpus = tokens.agg(F.count("*").alias("n"), F.coalesce(F.sum("dl") / F.nullif(F.count("*"), F.lit(0)), F.lit(0.0)).alias("avgdl"))
    return Bm25Index(tokens, corpus, stop_words, k1, b)


def build_index_from_store(store: ChunkStore, stop_words: tuple[str, ...] | None = STOP_WORDS, k1: float = 1.5, b: float = 0.75) -> Bm25Index:
    """Index of the chunks that a store holds now; of an empty store one without chunks."""
    chunks = store.read()
    if chunks is None:
        chunks = store.spark.createDataFrame([], "chunk_ord bigint, content string")
    return build_index(chunks, stop_words, k1, b)


@dataclass(frozen=True)
class StoredBm25Index(Bm25Index):
    """An index read back from a folder: postings sorted by term, so a few terms prune the files they read."""

    stored: DataFrame

    def postings(self, vocabulary: DataFrame | None = None) -> DataFrame:
        return self.stored if vocabulary is None else self.stored.join(vocabulary, "term", "left_semi")


def save_index(index: Bm25Index, path: str, files: int | None = None) -> None:
    """Write the postings in ranges of terms, and the sums, below `path`."""
    postings = index.postings()
    ranged = postings.repartitionByRange(files, "term") if files else postings.repartitionByRange("term")
    ranged.sortWithinPartitions("term", "chunk_ord").write.mode("overwrite").parquet(f"{path}/postings")
    index.tokens.select("chunk_ord", "dl").write.mode("overwrite").parquet(f"{path}/lengths")
    index.corpus.write.mode("overwrite").parquet(f"{path}/corpus")


def load_index(spark: SparkSession, path: str, stop_words: tuple[str, ...] | None = STOP_WORDS, k1: float = 1.5, b: float = 0.75) -> StoredBm25Index:
    real("k1", k1, 0, float("inf"))
    real("b", b, 0, 1)
    read = spark.read.parquet
    return StoredBm25Index(read(f"{path}/lengths"), read(f"{path}/corpus"), stop_words, k1, b, read(f"{path}/postings"))


def question_terms(questions: DataFrame, stop_words: tuple[str, ...] | None = STOP_WORDS) -> DataFrame:
    """(query_id, term, qtf) of the valid rows of (query_id, query); repeats of a word count."""
    valid = questions.where(query_error("query").isNull())
    terms = valid.select("query_id", F.explode(tokenize(keyword_query("query"), stop_words)).alias("term"))
    return terms.groupBy("query_id", "term").agg(F.count("*").alias("qtf"))


def scores(index: Bm25Index, questions: DataFrame) -> DataFrame:
    """(query_id, chunk_ord, score) of all chunks that share a term with the question."""
    terms = question_terms(questions, index.stop_words)
    small = terms.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    terms = F.broadcast(terms) if small else terms
    vocabulary = terms.select("term").distinct()
    postings = index.postings(F.broadcast(vocabulary) if small else vocabulary)
    frequency = index.document_frequency(postings)
    n, avgdl, df = F.col("n"), F.col("avgdl"), F.col("df")
    idf = frequency.crossJoin(F.broadcast(index.corpus)).select("term", "avgdl", F.ln((n - df + 0.5) / (df + 0.5) + 1).alias("idf"))
    idf = F.broadcast(idf) if small else idf  # not more terms than the questions have
    norm = F.when(avgdl > 0, 1 - index.b + index.b * F.col("dl") / avgdl).otherwise(1.0)
    part = F.col("qtf") * F.col("idf") * F.col("tf") * (index.k1 + 1) / (F.col("tf") + index.k1 * norm)
    return postings.join(idf, "term").join(terms, "term").groupBy("query_id", "chunk_ord").agg(F.sum(part).alias("score"))


def top_k(scored: DataFrame, k: int, by: str = "score") -> DataFrame:
    """The k best rows of each question with their rank; equal scores in the order of the collection."""
    order = Window.partitionBy("query_id").orderBy(F.round(by, 9).desc(), "chunk_ord")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def search(index: Bm25Index, questions: DataFrame, k: int | None = None, min_score: float | None = None) -> DataFrame:
    """(query_id, rank, chunk_ord, score) of the k best chunks with a positive score."""
    found = scores(index, questions).where(F.col("score") > 0)
    if min_score is not None:  # by the same score as the rank, so it may come before the cut
        found = found.where(F.col("score") >= real("min_score", min_score, float("-inf"), float("inf")))
    return top_k(found, top_k_or(k, 10))


def without_document(chunks: DataFrame, document_id: str) -> DataFrame:
    """The chunks of all other documents; an index is rebuilt from them."""
    return chunks.where(~F.col("document_id").eqNullSafe(F.lit(document_id)))
