"""Settings with their ranges. All values are checked when a Settings object is made."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from corpusloom.errors import InvalidTopKError, LoomError

TOP_K_MOST = 1000


class SettingsError(LoomError, ValueError): ...


def whole(name: str, value: object, least: int, most: int | None = None, error: type[Exception] = SettingsError) -> int:
    """`value` if it is an int (no bool) within the bounds."""
    if isinstance(value, bool) or not isinstance(value, int) or value < least or (most is not None and value > most):
        raise error(f"{name} must be a whole number from {least}" + (f" to {most}" if most is not None else "") + f", not {value!r}")
    return value


def real(name: str, value: object, least: float, most: float, open_below: bool = False, error: type[Exception] = SettingsError) -> float:
    """`value` if it is a finite number within the bounds."""
    bad = isinstance(value, bool) or not isinstance(value, int | float) or not math.isfinite(value)
    if bad or value > most or value < least or (open_below and value == least):
        raise error(f"{name} must be a number from {least} to {most}, not {value!r}")
    return float(value)


def top_k_or(value: int | None, default: int) -> int:
    """The number of results asked for."""
    return whole("top_k", default if value is None else value, 1, TOP_K_MOST, InvalidTopKError)


@dataclass(frozen=True)
class Settings:
    """The defaults and their ranges. `plans.service` reads them; the two model names are for the embedder and reranker that the caller plugs in."""

    max_upload_size_mb: int = 50
    chunk_size: int = 1000
    chunk_overlap: int = 200
    embedding_model: str = "all-MiniLM-L6-v2"
    embedding_batch_size: int = 64
    vector_store_path: str = "data/vectorstore"
    collection: str = "loom_chunks"
    vector_search_top_k: int = 10
    retrieval_min_score: float = 0.3
    retrieval_mode: str = "semantic"
    hybrid_semantic_top_k: int = 20
    hybrid_keyword_top_k: int = 20
    hybrid_semantic_weight: float = 1.0
    hybrid_keyword_weight: float = 1.0
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    reranker_enabled: bool = False
    reranker_model: str = "ms-marco-MiniLM-L-6-v2"
    reranker_candidate_top_k: int = 20
    llm_model: str = "qwen2.5:0.5b-instruct"
    llm_base_url: str = "http://localhost:11434"
    llm_temperature: float = 0.1
    llm_max_tokens: int = 512
    llm_timeout: float = 120.0
    context_max_chars: int = 3000
    ocr_enabled: bool = True
    ocr_language: str = "eng"
    ocr_dpi: int = 300
    ocr_min_native_chars: int = 25
    ocr_timeout: float = 60.0
    ocr_max_pages: int = 50
    ocr_max_image_pixels: int = 40_000_000

    def __post_init__(self) -> None:
        whole("max_upload_size_mb", self.max_upload_size_mb, 1)
        whole("chunk_size", self.chunk_size, 1)
        whole("chunk_overlap", self.chunk_overlap, 0, self.chunk_size - 1)
        whole("embedding_batch_size", self.embedding_batch_size, 1)
        for name in ("embedding_model", "vector_store_path", "reranker_model", "llm_model"):
            if not str(getattr(self, name)).strip():
                raise SettingsError(f"{name} must not be blank")
        if not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]{1,510}[A-Za-z0-9]", self.collection):
            raise SettingsError(f"collection must be 3 to 512 characters and start and end with a letter or digit, not {self.collection!r}")
        for name in ("vector_search_top_k", "hybrid_semantic_top_k", "hybrid_keyword_top_k", "reranker_candidate_top_k", "rrf_k", "ocr_max_pages"):
            whole(name, getattr(self, name), 1, TOP_K_MOST)
        real("retrieval_min_score", self.retrieval_min_score, -1, 1)
        if self.retrieval_mode not in ("semantic", "keyword", "hybrid"):
            raise SettingsError(f"retrieval_mode must be semantic, keyword or hybrid, not {self.retrieval_mode!r}")
        real("hybrid_semantic_weight", self.hybrid_semantic_weight, 0, 10)
        real("hybrid_keyword_weight", self.hybrid_keyword_weight, 0, 10)
        if self.hybrid_semantic_weight == self.hybrid_keyword_weight == 0:
            raise SettingsError("the hybrid weights must not both be 0")
        real("bm25_k1", self.bm25_k1, 0, math.inf)
        real("bm25_b", self.bm25_b, 0, 1)
        if not re.match(r"https?://", self.llm_base_url):
            raise SettingsError(f"llm_base_url must be an http address, not {self.llm_base_url!r}")
        real("llm_temperature", self.llm_temperature, 0, 2)
        whole("llm_max_tokens", self.llm_max_tokens, 1, 32_768)
        real("llm_timeout", self.llm_timeout, 0, 600, open_below=True)
        whole("context_max_chars", self.context_max_chars, 100, 500_000)
        if not re.fullmatch(r"[A-Za-z]{3}(_[A-Za-z]+)?(\+[A-Za-z]{3}(_[A-Za-z]+)?)*", self.ocr_language):
            raise SettingsError(f"ocr_language must be codes joined by +, not {self.ocr_language!r}")
        whole("ocr_dpi", self.ocr_dpi, 72, 600)
        whole("ocr_min_native_chars", self.ocr_min_native_chars, 1, 10_000)
        real("ocr_timeout", self.ocr_timeout, 0, 600, open_below=True)
        whole("ocr_max_image_pixels", self.ocr_max_image_pixels, 1_000_000, 200_000_000)
