"""The two entry points, indexing documents and answering questions, and the comparison of retrieval modes."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.config import Settings, top_k_or
from corpusloom.functions.text import query_error
from corpusloom.operators import answer, bm25, evaluate, hybrid, rerank, vectors
from corpusloom.operators.chunking import chunk_documents
from corpusloom.operators.store import ChunkStore
from corpusloom.sources import files, ocr

#: Hits of a question before reranking, if no depth is set.
DEPTH = 20
MODES = ("semantic", "semantic_rerank", "keyword", "hybrid", "hybrid_rerank")


def open_store(spark: SparkSession, settings: Settings | None = None) -> ChunkStore:
    """The store of the settings' folder and collection."""
    settings = settings or Settings()
    return ChunkStore(spark, f"{settings.vector_store_path.rstrip('/')}/{settings.collection}")


def load_files(spark: SparkSession, path: str, settings: Settings | None = None, reader: files.PdfReader | None = None, engine: ocr.OcrEngine | None = None) -> tuple[DataFrame, DataFrame]:
    """(pages, failures) of all files below a path: pages as the chunker takes them, and (document_id, error_code).

    PDF files need a reader; their pages without text, and pictures, also an engine, which is left out
    if the settings switch recognition off. Documents are ordered by a hash of their path.
    """
    settings = settings or Settings()
    most = settings.max_upload_size_mb << 20
    engine = engine if settings.ocr_enabled else None
    found = files.read_files(spark, path)
    is_pdf = files.suffix(F.col("path")) == ".pdf"
    texts = (lambda content: [p.text for p in reader.pages(content)]) if reader else None
    scanned = reader is not None and engine is not None
    plain = files.load_pages(found.where(~is_pdf) if scanned else found, texts, engine, most, settings.ocr_max_image_pixels, settings.ocr_language, settings.ocr_timeout)
    rows = plain.select(F.col("document_id"), "document_name", "source_type", "page_number", "content", "metadata", F.lit(None).cast("map<string,string>").alias("page_metadata"), "error_code")
    if scanned:
        rows = rows.unionByName(files.load_scanned(found.where(is_pdf), reader, engine, most, settings.ocr_min_native_chars, settings.ocr_dpi, settings.ocr_max_pages, settings.ocr_max_image_pixels, settings.ocr_language, settings.ocr_timeout))
    # 39 bits: with 24 for a document's chunks they fill a positive long
    rows = rows.withColumn("doc_ord", F.shiftrightunsigned(F.xxhash64("document_id"), 25))
    return rows.where("error_code is null").drop("error_code"), rows.where("error_code is not null").select("document_id", "error_code")


def chat_generator(settings: Settings | None = None) -> answer.ChatGenerator:
    s = settings or Settings()
    return answer.ChatGenerator(s.llm_base_url, s.llm_model, s.llm_temperature, s.llm_max_tokens, s.llm_timeout)


def index_documents(pages: DataFrame, store: ChunkStore, settings: Settings | None = None, embedder: vectors.Embedder | None = None, one_page: bool = False) -> DataFrame:
    """Chunk, embed and store pages, replacing the documents that they belong to; a report row for each document.

    Vectors are part of the version that is written, so a failed embedding leaves the store as it was.
    """
    settings = settings or Settings()
    chunks = chunk_documents(pages, settings.chunk_size, settings.chunk_overlap, one_page)
    if embedder is not None:
        chunks = chunks.withColumn("v", vectors.embed(F.col("content"), embedder, settings.embedding_batch_size))
    store.index(chunks)
    counts = store.read().groupBy("document_id").agg(F.count("*").alias("n_chunks"))
    docs = pages.groupBy("document_id", "document_name").agg(F.count("*").alias("n_pages"))
    out = docs.join(counts, "document_id", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)).cast("long"))
    return out.withColumn("status", F.when(F.col("n_chunks") > 0, "ok").otherwise("no_chunks"))


def _sides(questions: DataFrame, chunks: DataFrame, settings: Settings, embedder: vectors.Embedder | None) -> tuple[Callable[[int], DataFrame], Callable[[int], DataFrame]]:
    """The dense and the keyword retriever, as functions of the number of hits. Dense hits below the settings' least score are none."""
    embedder = embedder or vectors.HashingEmbedder()

    def dense(n: int) -> DataFrame:
        v = F.col("v") if "v" in chunks.columns else vectors.embed(F.col("content"), embedder, settings.embedding_batch_size)
        return vectors.semantic_search(questions, chunks.select("chunk_ord", v.alias("v")), embedder, n, settings.retrieval_min_score)

    def words(n: int) -> DataFrame:
        return bm25.search(bm25.build_index(chunks, k1=settings.bm25_k1, b=settings.bm25_b), questions, n)

    return dense, words


def _fused(dense: DataFrame | None, words: DataFrame | None, chunks: DataFrame, settings: Settings, k: int) -> DataFrame:
    ids = chunks.select("chunk_ord", "chunk_id")
    sides = [None if x is None else x.join(ids, "chunk_ord") for x in (dense, words)]
    return hybrid.fuse(*sides, (settings.hybrid_semantic_weight, settings.hybrid_keyword_weight), settings.rrf_k, k).drop("chunk_id")


def retrieve(questions: DataFrame, chunks: DataFrame, settings: Settings | None = None, embedder: vectors.Embedder | None = None, top_k: int | None = None) -> DataFrame:
    """Hits of (query_id, query) by the settings' mode: (query_id, rank, score and the chunk's columns).

    chunks may bring their vectors as `v`; otherwise they are embedded on the way. The least score
    holds for dense hits, also for those that go into a fusion.
    """
    settings = settings or Settings()
    k = top_k_or(top_k, settings.vector_search_top_k)
    dense, words = _sides(questions, chunks, settings, embedder)
    if settings.retrieval_mode == "semantic":
        hits = dense(k)
    elif settings.retrieval_mode == "keyword":
        hits = words(k)
    else:
        left = dense(settings.hybrid_semantic_top_k) if settings.hybrid_semantic_weight else None
        right = words(settings.hybrid_keyword_top_k) if settings.hybrid_keyword_weight else None
        hits = _fused(left, right, chunks, settings, k)
    return hits.join(chunks.drop("v"), "chunk_ord")


def _reranked(hits: DataFrame, questions: DataFrame, k: int, scorer: rerank.Scorer | None) -> DataFrame:
    asked = hits.join(questions.where(query_error("query").isNull()).select("query_id", "query"), "query_id")
    return rerank.rerank(asked, k, rerank.scored_by(scorer, F.col("query"), F.col("content")) if scorer else None)


def answer_questions(
    questions: DataFrame, chunks: DataFrame, settings: Settings | None = None, embedder: vectors.Embedder | None = None, scorer: rerank.Scorer | None = None, generator: answer.Generator = answer.first_passage, top_k: int | None = None
) -> DataFrame:
    """Retrieve, gate, rerank, pack, generate and cite: a row for each row of (query_id, query).

    The gate comes before the reranker and holds for dense scores, which alone have a fixed scale.
    """
    settings = settings or Settings()
    k = top_k_or(top_k, settings.vector_search_top_k)
    depth = max(settings.reranker_candidate_top_k if settings.reranker_enabled else k, k)
    hits = retrieve(questions, chunks, settings, embedder, depth)
    if settings.reranker_enabled:
        hits = _reranked(hits, questions, k, scorer)
    best = Window.partitionBy("query_id").orderBy("rank")
    hits = hits.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n")
    hits = hits.withColumn("metadata", F.map_concat(F.map_filter("metadata", lambda key, _: key != "page_number"), F.when(F.col("page_number").isNotNull(), F.create_map(F.lit("page_number"), F.col("page_number").cast("string"))).otherwise(F.create_map().cast("map<string,string>"))))
    return answer.answer_report(questions, hits, None, settings.context_max_chars, generator)


def compare_modes(questions: DataFrame, expected: DataFrame, chunks: DataFrame, settings: Settings | None = None, embedder: vectors.Embedder | None = None, scorer: rerank.Scorer | None = None, top_k: int = 5) -> DataFrame:
    """A summary for each of the five modes, with the mode's name. questions: (query_id, query, category).

    All modes are made of one dense and one keyword ranking, DEPTH deep.
    """
    settings = settings or Settings()
    depth = max(DEPTH, top_k)
    dense, words = (side(depth) for side in _sides(questions, chunks, settings, embedder))
    fused = _fused(dense, words, chunks, settings, depth)
    named = chunks.select("chunk_ord", "chunk_id", "document_name", "content")
    deep = {"semantic": dense, "keyword": words, "hybrid": fused}
    out = []
    for mode in MODES:
        kind, _, again = mode.partition("_")
        hits = deep[kind].join(named, "chunk_ord")
        hits = _reranked(hits, questions, top_k, scorer) if again else hits.where(F.col("rank") <= top_k)
        measures = evaluate.per_query(hits.select("query_id", "rank", "document_name"), expected, questions.select("query_id", "category"))
        out.append(evaluate.summary(measures).withColumn("mode", F.lit(mode)))
    return reduce(DataFrame.unionByName, out)
