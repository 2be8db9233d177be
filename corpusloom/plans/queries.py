"""Every operator as a query over the harness's tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corpusloom.functions import metadata as M
from corpusloom.functions import text as T
from corpusloom.operators import answer as A
from corpusloom.operators import bm25 as B
from corpusloom.operators import chunking as C
from corpusloom.operators import evaluate as E
from corpusloom.operators import hybrid as H
from corpusloom.operators import rerank as R
from corpusloom.operators import store as S
from corpusloom.operators import vectors as V
from corpusloom.config import Settings
from corpusloom.plans import sample, service
from corpusloom.sources import files as FS
from corpusloom.sources import ocr as O

EMBEDDER = V.HashingEmbedder(64)
#: The least dense score of the queries that have a gate; the stand-in's scores are high.
GATE = 0.9
#: Marks that no table holds, put into texts so that cleaning has something to do.
DIRT = (("\ufeff", ""), ("\n", " \r\n\r\r\n\t\u00a0 "), (" ", "\u00a0\t"))


def _read(spark: SparkSession, d: str, table: str) -> DataFrame:
    """A table. Texts in fewer partitions than there are cores, as a small file of one row group has them, are dealt out."""
    rows, cores = spark.read.parquet(f"{d}/{table}.parquet"), spark.sparkContext.defaultParallelism
    return rows.repartition(cores) if table == "documents" and rows.rdd.getNumPartitions() <= cores else rows


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Each row of documents as a document of one page."""
    return _read(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), F.col("doc_id").alias("doc_ord"), F.concat(F.lit("doc-"), "doc_id").alias("document_name"), F.lit("text").alias("source_type"), F.lit(1).alias("page_number"), F.col("text").alias("content"),
        F.create_map(F.lit("lang"), "lang", F.lit("char_count"), F.col("n_chars").cast("string")).alias("metadata"),
        F.create_map(F.lit("source"), F.col("source"), F.lit("lang"), F.lit("page"), F.lit("char_count"), F.lit("1")).alias("page_metadata"),
    )


def _books(spark: SparkSession, d: str) -> DataFrame:
    """Each source as a document whose pages are the rows of documents."""
    number = F.row_number().over(Window.partitionBy("source").orderBy("doc_id"))
    return _read(spark, d, "documents").select(F.col("source").alias("document_id"), F.substring("source", 4, 9).cast("bigint").alias("doc_ord"), F.concat("source", F.lit(".pdf")).alias("document_name"), F.lit("pdf").alias("source_type"), number.alias("page_number"), F.col("text").alias("content"))


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_pages(spark, d), one_page=True)


def _stored(spark: SparkSession, d: str, vectors: bool = False) -> DataFrame:
    """The chunks as a store holds them: made once, for plans that read them from several sides."""
    chunks, store = _chunks(spark, d), S.scratch_store(spark)
    store.index(chunks.withColumn("v", V.embed(F.col("content"), EMBEDDER)) if vectors else chunks)
    return store.read()


def _small(rows: DataFrame) -> DataFrame:
    """For a broadcast if it is small by count; otherwise as it is, for a join by key."""
    return F.broadcast(rows) if rows.limit(B.BROADCAST_ROWS + 1).count() <= B.BROADCAST_ROWS else rows


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _named(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunks' columns; hits are k a question, so the chunks are cut down to them first."""
    return hits.join(chunks.drop("start"), "chunk_ord")


def _keyword(spark: SparkSession, d: str, k: int = 10, min_score: float | None = None, chunks: DataFrame | None = None) -> DataFrame:
    return B.search(B.build_index(_chunks(spark, d) if chunks is None else chunks), _questions(spark, d), k, min_score)


def _semantic(spark: SparkSession, d: str, chunks: DataFrame, k: int = 10, min_score: float | None = None) -> DataFrame:
    return V.semantic_search(_questions(spark, d), chunks.select("chunk_ord", "v"), EMBEDDER, k, min_score)


def _with_id(hits: DataFrame) -> DataFrame:
    """chunk_id by chunk_ord, as _pages numbers them."""
    return hits.withColumn("chunk_id", F.concat_ws("#", F.floor(F.col("chunk_ord") / C.ORD_STEP).cast("bigint"), F.col("chunk_ord") % C.ORD_STEP))


def _hybrid(spark: SparkSession, d: str, weights: tuple[float, float], k: int = 10) -> DataFrame:
    chunks = _stored(spark, d, vectors=weights[0] > 0)
    semantic = _with_id(_semantic(spark, d, chunks, 20)) if weights[0] else None
    keyword = _with_id(_keyword(spark, d, 20, chunks=chunks)) if weights[1] else None
    return H.fuse(semantic, keyword, weights, 60, k)


# ---- text -------------------------------------------------------------------------------------------


def clean_text(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.concat(F.lit(DIRT[0][0]), F.replace(F.replace("text", F.lit(DIRT[1][0]), F.lit(DIRT[1][1])), F.lit(DIRT[2][0]), F.lit(DIRT[2][1])), F.lit("\u200b \n"))
    return _read(spark, d, "documents").select("doc_id", T.clean_text(dirty).alias("clean"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    words = T.tokenize("text")
    return _read(spark, d, "documents").select("doc_id", F.size(words).alias("n_tokens"), F.array_join(words, " ").alias("tokens"))


def alnum_count(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", T.alnum_count("text").alias("n"))


def validate_query(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("doc_id") % 7 == 0, F.lit(" \u200b\n")).when(F.col("doc_id") % 11 == 0, None).otherwise(F.concat(F.lit("\ufeff "), "text"))
    return _read(spark, d, "documents").select("doc_id", T.query_error(raw).alias("error"), F.length(T.semantic_query(raw)).alias("n_semantic"), F.length(T.keyword_query(raw)).alias("n_keyword"))


def validate_question(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("turn") % 5 == 4, F.lit("\u200b ")).otherwise(F.concat(F.repeat(F.lit(" "), 9990), "text"))
    return _read(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", T.question_error(raw).alias("error"))


def normalize_text(spark: SparkSession, d: str) -> DataFrame:
    raw = F.replace(F.replace("text", F.lit("é"), F.lit("e\u0301")), F.lit(" "), F.lit("\t\u00a0"))
    return _read(spark, d, "documents").select("doc_id", T.normalize_text(raw).alias("normal"))


def _spoiled(c: str):
    return F.replace(F.replace(c, F.lit("th"), F.lit("t")), F.lit("er "), F.lit("e r"))


def cer(spark: SparkSession, d: str) -> DataFrame:
    ascii_only = F.regexp_replace("text", r"[^\x00-\x7F]", "e")
    rows = _read(spark, d, "benchmark").select("item_id", ascii_only.alias("reference"))
    return rows.select("item_id", F.round(T.char_error_rate("reference", _spoiled("reference")), 6).alias("cer"))


def wer(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "benchmark").select("item_id", F.round(T.word_error_rate("text", _spoiled("text")), 6).alias("wer"))


def _meta_value():
    k = F.col("doc_id") % 9
    return F.when(k == 0, "3.0").when(k == 1, "3.5").when(k == 2, "true").when(k == 3, "0").when(k == 4, "-2").when(k == 5, "nan").when(k == 6, None).otherwise(F.col("doc_id").cast("string"))


def extract_page_number(spark: SparkSession, d: str) -> DataFrame:
    both = F.create_map(F.lit("page_number"), _meta_value(), F.lit("page"), F.lit("5"))
    old = F.create_map(F.lit("page"), _meta_value())
    return _read(spark, d, "documents").select("doc_id", M.page_number_of(F.when(F.col("doc_id") % 2 == 0, both).otherwise(old)).alias("page"))


def build_prompt(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "conversations").where("role = 'user'")
    messages = A.build_prompt(F.concat(F.lit(" \ufeff"), "text"), F.concat(F.lit("turn "), F.col("turn").cast("string")))
    return rows.select("conv_id", "turn", F.size(messages).alias("n"), messages[0]["role"].alias("first_role"), messages[1]["content"].alias("user"))


def flatten_metadata(spark: SparkSession, d: str) -> DataFrame:
    extra = F.create_map(F.lit("lang"), F.col("lang"), F.lit("chunk_id"), F.lit("other"), F.lit("weight"), _meta_value(), F.lit("list"), F.lit("[1]"))
    core = {"chunk_id": F.concat_ws("#", "doc_id", F.lit(0)), "document_id": F.col("doc_id"), "page_number": F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3)}
    flat = M.flatten_metadata(core, extra)
    return _read(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(F.transform(F.map_entries(flat), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";").alias("meta"))


# ---- chunks -----------------------------------------------------------------------------------------


def page_boundaries(spark: SparkSession, d: str) -> DataFrame:
    docs = C.page_boundaries(_books(spark, d))
    return docs.select("document_id", F.explode("bounds").alias("b")).select("document_id", "b.page_number", "b.start", "b.end")


def split_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.posexplode(C.segments(F.col("text"), 300, 50)).alias("i", "s"))
    return rows.select("doc_id", "i", "s.start", "s.content")


def page_for_offset(spark: SparkSession, d: str) -> DataFrame:
    # lengths are all it takes, so no text meets its document's others
    rows = _read(spark, d, "documents").where("source is not null").select(F.col("source").alias("document_id"), "doc_id", F.length(T.clean_text("text")).alias("length"))
    number = F.row_number().over(Window.partitionBy("document_id").orderBy("doc_id"))
    return C.pages_at(rows.select("document_id", number.alias("page_number"), "length"), 997, 500)


def chunk_document(spark: SparkSession, d: str) -> DataFrame:
    return C.chunk_documents(_books(spark, d)).select("document_id", "chunk_id", "chunk_index", "page_number", "start", "content")


def chunk_metadata(spark: SparkSession, d: str) -> DataFrame:
    meta = F.col("metadata")
    return _chunks(spark, d).select("chunk_id", *[meta[k].alias(k) for k in ("lang", "source", "char_count", "chunk_size", "chunk_overlap")], F.cardinality(meta).alias("n_keys"))


# ---- keyword index and search -----------------------------------------------------------------------


def bm25_postings(spark: SparkSession, d: str) -> DataFrame:
    return B.build_index(_chunks(spark, d)).postings()


def bm25_df(spark: SparkSession, d: str) -> DataFrame:
    return B.build_index(_chunks(spark, d)).document_frequency()


def bm25_corpus_stats(spark: SparkSession, d: str) -> DataFrame:
    return B.build_index(_chunks(spark, d)).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


def bm25_score(spark: SparkSession, d: str) -> DataFrame:
    found = B.scores(B.build_index(_chunks(spark, d)), _questions(spark, d))
    return found.select("query_id", "chunk_ord", F.round("score", 6).alias("score"))


def _shown(hits: DataFrame) -> DataFrame:
    return hits.select("query_id", "rank", "chunk_ord", F.round("score", 6).alias("score"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_keyword(spark, d))


def bm25_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_keyword(spark, d, 20, 12.0))


def bm25_remove_document(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d)
    left = B.build_index(B.without_document(chunks, "0")).corpus
    return left.crossJoin(chunks.where("document_id = '0'").agg(F.count("*").alias("removed"))).select("n", F.round("avgdl", 6).alias("avgdl"), "removed")


# ---- dense search and fusion ------------------------------------------------------------------------


def embed_hashing(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "documents").select("doc_id", F.posexplode(V.embed(F.col("text"), EMBEDDER)).alias("bucket", "w"))
    return rows.where("w > 0").select("doc_id", "bucket", F.round("w", 6).alias("w"))


def _vectors(spark: SparkSession, d: str, k: int, min_score: float | None = None, every: int = 20) -> DataFrame:
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("v"))
    asked = rows.where(F.col("chunk_ord") % every == 0).select(F.col("chunk_ord").alias("query_id"), "v")
    return _shown(V.similar(asked, rows, k, min_score))


def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 10)


def semantic_min_score(spark: SparkSession, d: str) -> DataFrame:
    return _vectors(spark, d, 20, 0.3)


def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    """Fusion of two given rankings of vectors: by similarity, and by number within the label.

    The second ranking is the same for all questions of a label, so it is cut to its length before it meets them.
    """
    rows = _read(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("v"), "label")
    asked = rows.where("chunk_ord % 50 = 0").select(F.col("chunk_ord").alias("query_id"), "v", F.col("label").alias("q"))
    dense = V.similar(asked.select("query_id", "v"), rows, 20).withColumn("chunk_id", F.lpad(F.col("chunk_ord").cast("string"), 9, "0"))
    first = rows.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("chunk_ord"))).where("n <= 20").select(F.col("label").alias("q"), "chunk_ord")
    same = _small(asked.select("query_id", "q")).join(first, "q").select("query_id", "chunk_ord", F.lit(1.0).alias("score"))
    second = B.top_k(same, 20).withColumn("chunk_id", F.lpad(F.col("chunk_ord").cast("string"), 9, "0"))
    return H.fuse(dense, second, (1.0, 0.5), 60, 15).select("query_id", "rank", "chunk_id", "score", "semantic_rank", "keyword_rank")


def hybrid_topk(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, (1.0, 1.0)).select("query_id", "rank", "chunk_id", "score")


def hybrid_weighted(spark: SparkSession, d: str) -> DataFrame:
    return _hybrid(spark, d, (0.5, 2.0)).select("query_id", "rank", "chunk_id", "score")


def hybrid_one_sided(spark: SparkSession, d: str) -> DataFrame:
    """A side of weight 0 is left out of the plan."""
    return _hybrid(spark, d, (0.0, 2.0)).select("query_id", "rank", "chunk_id", "score")


def _candidates(spark: SparkSession, d: str, k: int) -> DataFrame:
    chunks = _stored(spark, d)
    hits = _named(_keyword(spark, d, k, chunks=chunks), chunks)
    return hits.join(_small(_questions(spark, d)), "query_id")


def rerank_candidates(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d, 20).select("query_id", "rank", "chunk_id", F.round("score", 6).alias("score"))


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    best = R.rerank(_candidates(spark, d, 20), 5)
    return best.select("query_id", "rank", "chunk_id", F.round("retrieval_score", 6).alias("retrieval_score"), F.round("reranker_score", 6).alias("reranker_score"))


# ---- answers ----------------------------------------------------------------------------------------


def relevance_gate(spark: SparkSession, d: str) -> DataFrame:
    hits = _vectors(spark, d, 10, every=10)
    questions = _read(spark, d, "embeddings").where("vec_id % 10 = 0").select(F.col("vec_id").alias("query_id"))
    return A.relevance_gate(hits, questions, 0.35)[1]


def context_pack(spark: SparkSession, d: str) -> DataFrame:
    chunks = _stored(spark, d)
    return A.build_context(_named(_keyword(spark, d, chunks=chunks), chunks), 3000)


def format_sources(spark: SparkSession, d: str) -> DataFrame:
    hits = _keyword(spark, d).withColumn("doc", F.floor(F.col("chunk_ord") / C.ORD_STEP).cast("bigint"))
    hits = hits.select("query_id", "rank", F.concat(F.lit("c"), F.col("doc").cast("string")).alias("chunk_id"), F.col("doc").cast("string").alias("document_id"), F.concat(F.lit("doc-"), F.col("doc").cast("string")).alias("document_name"), F.round("score", 6).alias("score"),
        F.create_map(F.lit("page"), (F.col("doc") % 4).cast("string")).alias("metadata"), F.when(F.col("doc") % 3 > 0, F.col("doc") % 3).when(F.col("doc") % 2 == 0, F.lit(float("nan"))).alias("reranker_score"))
    return A.format_sources(hits)


def answer_report(spark: SparkSession, d: str) -> DataFrame:
    """Questions to cited answers in one plan: chunk, index, search by keywords, pack, generate, cite. See answer_* for gate and reranker."""
    chunks = _stored(spark, d)
    return A.answer_report(_questions(spark, d), _named(_keyword(spark, d, chunks=chunks), chunks), None, 3000)


def _answered(spark: SparkSession, d: str, mode: str) -> DataFrame:
    """The service's entry point in a mode: retrieve 20, gate (dense scores), rerank to 5, pack, generate, cite."""
    settings = Settings(retrieval_mode=mode, retrieval_min_score=GATE, reranker_enabled=True, vector_search_top_k=5)
    return service.answer_questions(_questions(spark, d), _stored(spark, d, vectors=mode != "keyword"), settings, EMBEDDER)


def answer_semantic(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d, "semantic")


def answer_keyword(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d, "keyword")


def answer_hybrid(spark: SparkSession, d: str) -> DataFrame:
    return _answered(spark, d, "hybrid")


# ---- the store --------------------------------------------------------------------------------------


def _rows(spark: SparkSession, d: str) -> DataFrame:
    """The chunk table's columns over orders: three chunks a document."""
    return _read(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_custkey").cast("string").alias("document_id"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_orderstatus")).alias("document_name"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("content"), F.col("o_orderkey").alias("batch_pos")
    )


def scan_chunks(spark: SparkSession, d: str) -> DataFrame:
    return S.scan(_rows(spark, d))


def upsert_last_wins(spark: SparkSession, d: str) -> DataFrame:
    """Into the whole table: keys that it has, repeated in the batch, and keys that it doesn't have."""
    rows = _rows(spark, d)
    key = F.when(F.col("batch_pos") % 64 == 0, -F.col("batch_pos")).otherwise(F.col("batch_pos") - F.col("batch_pos") % 32)
    batch = rows.where("batch_pos % 4 = 0").select(key.cast("string").alias("chunk_id"), "document_id", "document_name", F.lit("new").alias("content"), "batch_pos")
    return S.upsert(rows, batch)


def reindex_replace(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    batch = rows.where("batch_pos % 50 = 1").withColumn("content", F.lit("again"))
    return S.replace_documents(rows, batch).groupBy("document_id").agg(F.count("*").alias("n"), F.count_if(F.col("content") == "again").alias("again"))


def delete_document(spark: SparkSession, d: str) -> DataFrame:
    rows = _rows(spark, d)
    left, removed = S.delete_document(rows, "7")
    return left.agg(F.count("*").alias("remaining")).crossJoin(removed)


def store_count(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).agg(F.count("*").alias("n"))


def indexing_report(spark: SparkSession, d: str) -> DataFrame:
    """The service's entry point: chunk, embed and store all documents, and report on each."""
    return service.index_documents(_pages(spark, d), S.scratch_store(spark), embedder=EMBEDDER, one_page=True)


def index_from_store(spark: SparkSession, d: str) -> DataFrame:
    """A keyword index of what a store holds after one of its documents went."""
    store = S.scratch_store(spark)
    store.index(_chunks(spark, d).select("chunk_id", "document_id", "chunk_ord", "content"))
    store.delete("0")
    return B.build_index_from_store(store).corpus.select("n", F.round("avgdl", 6).alias("avgdl"))


# ---- evaluation -------------------------------------------------------------------------------------


def _expected(spark: SparkSession, d: str) -> DataFrame:
    needles = _read(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("needle"))
    docs = _read(spark, d, "documents").select(F.concat(F.lit("doc-"), "doc_id").alias("document_name"), "text")
    return E.containing(docs, needles).select("query_id", "document_name")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    hits = _keyword(spark, d, 5, 30.0)
    named = hits.select("query_id", "rank", F.concat(F.lit("doc-"), F.floor(F.col("chunk_ord") / C.ORD_STEP).cast("bigint").cast("string")).alias("document_name"))
    questions = _questions(spark, d).select("query_id", F.concat(F.lit("group "), (F.col("query_id") % 5).cast("string")).alias("category"))
    return E.per_query(named, _expected(spark, d), questions)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def eval_per_query(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_measures(spark, d))


def eval_summary(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.summary(_measures(spark, d)))


def eval_by_category(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.by_category(_measures(spark, d)))


def eval_mode_comparison(spark: SparkSession, d: str) -> DataFrame:
    """The five modes, and what the reranked ones are above those that they build on."""
    questions = _questions(spark, d).withColumn("category", F.lit("all"))
    modes = service.compare_modes(questions, _expected(spark, d), _stored(spark, d, vectors=True), Settings(retrieval_min_score=GATE), EMBEDDER, top_k=5)
    return _rounded(E.mode_comparison(modes, ["hit_rate", "recall", "precision", "mrr", "rejection_rate"]))


def eval_sample(spark: SparkSession, d: str) -> DataFrame:
    """Twelve questions in five categories over three small documents, by keywords."""
    questions = sample.sample_questions(spark)
    chunks = C.chunk_documents(sample.sample_pages(spark))
    hits = B.search(B.build_index(chunks), questions, 5).join(chunks.select("chunk_ord", "document_name"), "chunk_ord")
    expected = questions.select("query_id", F.explode("expected").alias("document_name"))
    return _rounded(E.per_query(hits, expected, questions.select("query_id", "category")))


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(E.percentiles(_read(spark, d, "events"), "value", ["event_type"]))


def timing_stats(spark: SparkSession, d: str) -> DataFrame:
    return E.timing(_read(spark, d, "events").withColumn("v", F.round("value", 1)), "v", ["event_type"])


def ocr_macro_error(spark: SparkSession, d: str) -> DataFrame:
    rows = _read(spark, d, "benchmark").select(F.regexp_replace("text", r"[^\x00-\x7F]", "e").alias("reference"))
    return _rounded(E.macro_error(rows.select("reference", _spoiled("reference").alias("hypothesis"))))


def ocr_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Each question as a document of one to three pages, read with errors."""
    rows = _read(spark, d, "benchmark").select("item_id", F.filter(F.split(F.regexp_replace("text", r"[^\x00-\x7F]", "e"), r"[ \n]+"), lambda w: w != "").alias("w"))
    half, k = F.ceil(F.size("w") / 2).cast("int"), F.col("item_id")
    rows = rows.select("item_id", F.array_join(F.slice("w", 1, half), " ").alias("a"), F.array_join(F.slice("w", half + 1, F.greatest(F.size("w") - half, F.lit(0))), " ").alias("b"))
    read = F.when(k % 3 == 0, F.array(_spoiled("a"))).when(k % 7 == 3, F.array(_spoiled("a"), _spoiled("b"), F.lit("more"))).otherwise(F.array(_spoiled("a"), _spoiled("b")))
    truth = F.when(k % 3 == 0, F.col("a")).otherwise(F.concat_ws("\n\n", "a", "b"))
    out = E.recognition_errors(rows.select(k.alias("doc"), truth.alias("reference"), read.alias("pages")))
    return _rounded(out.withColumn("page_cers", F.transform("page_cers", lambda x: F.format_string("%.4f", x)).cast("string")))


def token_presence(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", F.round(E.token_presence(F.col("text"), ["the", "ing", "de", "que", "|", "!!"]), 6).alias("share"), (E.line_count(F.col("text")) == 4).alias("four_rows"))


# ---- files and recognition --------------------------------------------------------------------------


def _files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id") % 8
    end = F.element_at(F.array(*[F.lit(x) for x in (".pdf", ".PDF", ".docx", ".png", ".jpg", ".jpeg", ".txt", "")]), (k + 1).cast("int"))
    heads = F.element_at(F.array(*[F.lit(m) for _, m, _ in FS.FORMATS]), (F.col("doc_id") % 4 + 1).cast("int"))
    return _read(spark, d, "documents").select("doc_id", F.concat(F.lit("/in/f"), F.col("doc_id").cast("string"), end).alias("path"), F.when(F.col("doc_id") % 13 > 0, F.col("n_chars")).otherwise(0).alias("length"), heads.alias("head"))


def ingest_validate(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", FS.file_error(F.col("path"), F.col("length"), 5000).alias("error"))


def detect_format(spark: SparkSession, d: str) -> DataFrame:
    return _files(spark, d).select("doc_id", FS.detect_format(F.col("path"), F.col("head")).alias("r")).select("doc_id", "r.format", "r.error_code")


def docx_table_text(spark: SparkSession, d: str) -> DataFrame:
    n, r = _read(spark, d, "nation"), _read(spark, d, "region")
    rows = n.join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    return rows.select("n_nationkey", FS.table_rows_text([F.col("n_name"), F.col("r_name"), F.col("n_regionkey")]).alias("line"))


def _images(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("event_id") % 11
    return _read(spark, d, "events").select(
        F.col("user_id").alias("page_id"), F.lit(612.0).alias("page_width"), F.when(F.col("user_id") % 17 == 0, 0.0).otherwise(792.0).alias("page_height"), x.alias("xref"),
        (x * 60.0 - 30).alias("x0"), (x * 40.0 - 50).alias("y0"), (x * 60.0 + (F.col("user_id") % 5) * 30).alias("x1"), (x * 40.0 + (F.col("user_id") % 7) * 40).alias("y1"),
    )


def image_coverage(spark: SparkSession, d: str) -> DataFrame:
    return O.image_coverage(_images(spark, d)).select("page_id", F.round("coverage", 6).alias("coverage"))


def needs_ocr(spark: SparkSession, d: str) -> DataFrame:
    docs = _read(spark, d, "documents").select("doc_id", "text")
    return docs.select("doc_id", O.needs_ocr(F.col("text"), (F.col("doc_id") % 10) / 10, 40).alias("wants"))


def raster_guard(spark: SparkSession, d: str) -> DataFrame:
    return _read(spark, d, "documents").select("doc_id", O.raster_error(F.col("n_chars") * 1.0, F.col("n_chars") * 0.5, 300, 40_000_000).alias("error"))


def _word_tables(spark: SparkSession, d: str) -> DataFrame:
    """Each question's words as an engine's word table, with structural, negative and broken rows."""
    words = F.filter(F.split("text", r"[ \n]+"), lambda w: w != "")
    line = F.transform(
        words,
        lambda w, i: F.concat_ws("\t", F.lit("5"), F.lit("1"), F.floor(i / 24).cast("string"), (F.floor(i / 12) % 2).cast("string"), (F.floor(i / 4) % 3).cast("string"), F.when(i % 17 == 16, "x").otherwise((i % 4).cast("string")),
            (i % 4 * 100 + F.when(i % 7 == 3, 60).otherwise(0)).cast("string"), F.lit("0"), F.lit("70"), F.lit("12"), F.when(i % 9 == 8, "-1").otherwise((90 - i % 9).cast("string")), w),
    )
    return _read(spark, d, "benchmark").select(F.col("item_id").alias("doc"), F.when(F.col("item_id") % 10 == 9, F.lit(" ")).otherwise(F.concat_ws("\n", F.lit("\t".join(O.TSV_COLUMNS)), F.array_join(line, "\n"), F.lit("5\t1\t2"))).alias("tsv"))


def ocr_tsv_layout(spark: SparkSession, d: str) -> DataFrame:
    return O.tsv_layout(_word_tables(spark, d))


def ocr_gap_heuristic(spark: SparkSession, d: str) -> DataFrame:
    return O.gap_layout(_word_tables(spark, d))


def pdf_outcome_rules(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("doc_id")
    pages = _read(spark, d, "documents").select(
        (n / 4).cast("bigint").alias("document_id"), (n % 4 + 1).cast("int").alias("page_number"), F.when((n / 4).cast("bigint") % 5 == 0, F.lit(" - ")).otherwise(F.col("text")).alias("native_text"), (n % 3 != 1).alias("wants_ocr"),
        F.when((n / 4).cast("bigint") % 10 == 0, F.lit("?")).otherwise(F.lit("word")).alias("ocr_text"), F.when(n % 7 == 0, "ocr_page").alias("ocr_error"),
    )
    out = O.pdf_outcome(pages, 2)
    return out.withColumn("failed_pages", F.array_join(F.col("failed_pages").cast("array<string>"), ","))


class _Reader:
    """Stands in for a PDF library: pages are parted by form feeds, `[scan w h]` marks a page that is one picture."""

    def pages(self, content: bytes) -> list[FS.PdfPage]:
        out = []
        for n, text in enumerate(content.decode()[4:].split("\f")):
            mark = re.match(r"\[scan (\d+) (\d+)\]", text)
            w, h = (float(mark[1]), float(mark[2])) if mark else (612.0, 792.0)
            out.append(FS.PdfPage("" if mark else text, w, h, [(n, 0.0, 0.0, w, h)] if mark else []))
        return out

    def draw(self, content: bytes, page_number: int, dpi: int) -> bytes:
        return content.decode()[4:].split("\f")[page_number - 1].partition("]")[2].encode()


class _Engine:
    """Reads what `_Reader` draws; fails on a page that begins with a T."""

    def version(self) -> str:
        return "stand-in 1"

    def recognize(self, image: bytes, language: str, timeout: float) -> O.Recognized:
        text = image.decode()
        if text.startswith("T"):
            raise O.OcrPageError("bad page")
        return O.Recognized(f"read: {text}" if text else "-", 90.0)


def pdf_scanned_pages(spark: SparkSession, d: str) -> DataFrame:
    """Four rows of documents as the pages of a file, some of them pictures: extraction, rules, drawing, recognition and outcome in one plan."""
    n, f, text = F.col("doc_id"), F.floor(F.col("doc_id") / 4).cast("bigint"), F.col("text")
    scan, huge = F.lit("[scan 612 792]"), F.lit("[scan 9000 9000]")
    page = F.when(f % 9 == 4, F.when(n % 4 == 0, "- -").otherwise(scan)).when((f % 9 == 7) | (n % 3 == 1), F.concat(scan, text)).when(n % 16 == 3, F.concat(huge, text)).otherwise(text)
    pages = F.transform(F.array_sort(F.collect_list(F.struct("doc_id", page.alias("p")))), lambda x: x["p"])
    files = _read(spark, d, "documents").groupBy(f.alias("f")).agg(F.encode(F.concat(F.lit("%PDF"), F.array_join(pages, "\f")), "UTF-8").alias("content"))
    files = files.select(F.concat(F.lit("/in/"), F.col("f").cast("string"), F.lit(".pdf")).alias("path"), F.length("content").cast("bigint").alias("length"), "content")
    out = FS.load_scanned(files, _Reader(), _Engine(), max_pages=3)
    return out.select("document_id", "page_number", F.md5(F.col("content").cast("binary")).alias("content"), F.col("page_metadata")["extraction_method"].alias("method"), F.col("metadata")["ocr_failed_pages"].alias("failed"), F.col("metadata")["ocr_page_count"].alias("tried"), "error_code")


_ALL = (
    clean_text, tokenize, alnum_count, validate_query, validate_question, normalize_text, cer, wer, extract_page_number, build_prompt, flatten_metadata,
    page_boundaries, split_text, page_for_offset, chunk_document, chunk_metadata, bm25_postings, bm25_df, bm25_corpus_stats, bm25_score, bm25_topk,
    bm25_min_score, bm25_remove_document, embed_hashing, vector_topk, semantic_min_score, rrf_fusion, hybrid_topk, hybrid_weighted, hybrid_one_sided, rerank_candidates,
    rerank_topk, relevance_gate, context_pack, format_sources, answer_report, answer_semantic, answer_keyword, answer_hybrid, scan_chunks, upsert_last_wins, reindex_replace, delete_document, store_count,
    indexing_report, index_from_store, eval_per_query, eval_summary, eval_by_category, eval_mode_comparison, eval_sample, latency_percentiles, timing_stats, ocr_macro_error, ocr_evaluation, token_presence,
    ingest_validate, detect_format, docx_table_text, image_coverage, needs_ocr, raster_guard, ocr_tsv_layout, ocr_gap_heuristic, pdf_outcome_rules, pdf_scanned_pages,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _ALL}
