from __future__ import annotations

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings, SettingsError, top_k_or
from corpusloom.errors import InsufficientContextError, InvalidTopKError, QueryError
from corpusloom.functions import text as T

DIRTY = [
    None, "", "  ", "a\r\nb\rc\n\n\n\nd", "\ta \t b  c​﻿", "x\u0000y", "  lead\n  mid  \n\n\n \n tail  ", "one  two　", "café \U0001f600  ß",
]


def cleaned(t: str | None) -> str:
    t = re.sub("[\u0000﻿​]", "", t or "").replace(" ", " ")
    t = re.sub("\r\n?", "\n", t).replace("\t", " ")
    t = "\n".join(x.strip() for x in t.split("\n"))
    return re.sub(r"\n{3,}", "\n\n", re.sub(r"[^\S\n]{2,}", " ", t)).strip()


def rows(spark, values, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [r[0] for r in df.orderBy("i").select(column).collect()]


def test_clean_text(spark):
    assert rows(spark, DIRTY, T.clean_text("t")) == [cleaned(t) for t in DIRTY]


def test_tokenize(spark):
    got = rows(spark, ["What is the Model's accuracy?", "the of and", None, "a_b x1 Été déjà x1"], T.tokenize("t"))
    assert got == [["model", "accuracy"], [], [], ["a_b", "x1", "été", "déjà", "x1"]]
    assert len(T.STOP_WORDS) == len(set(T.STOP_WORDS)) == 132


def test_query_errors(spark):
    values = [None, " ​", "ok", "x" * 10_000, "x" * 10_001, " " * 10_000 + "x"]
    assert rows(spark, values, T.query_error("t")) == ["invalid_query:missing", "invalid_query:empty", None, None, "invalid_query:too_long", "invalid_query:too_long"]
    assert rows(spark, values, T.question_error("t"))[4:] == ["invalid_query:too_long", None]


def edits(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@pytest.mark.parametrize("unit", ["char", "word"])
def test_error_rates(spark, unit):
    pairs = [("", ""), ("", "x"), ("the cat sat", "the cat sat"), ("a b c d", "a x c"), ("café \U0001f600 x", "cafe x"), ("x", "y z w v"), ("a  b\n c", "a b c"), ("one two two three", "two one two")]
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, r string, h string")
    f = T.char_error_rate if unit == "char" else T.word_error_rate
    got = [r[0] for r in df.orderBy("i").select(f("r", "h")).collect()]

    def expected(r, h):
        r, h = " ".join(r.split()), " ".join(h.split())
        r, h = (r, h) if unit == "char" else (r.split(), h.split())
        return edits(r, h) / len(r) if r else float(bool(h))

    assert got == pytest.approx([expected(a, b) for a, b in pairs])


def test_normalize_text(spark):
    values = ["é \t x \r\ny ", None]
    assert rows(spark, values, T.normalize_text("t")) == [" ".join(unicodedata.normalize("NFC", values[0]).split()), ""]


def test_alnum_count(spark):
    assert rows(spark, ["a1_ é-", None, "--"], T.alnum_count("t")) == [3, 0, 0]


def test_settings():
    Settings()
    for bad in (
        {"chunk_overlap": 1000}, {"chunk_size": 0}, {"retrieval_mode": "x"}, {"retrieval_min_score": 1.5}, {"hybrid_semantic_weight": 0.0, "hybrid_keyword_weight": 0.0}, {"collection": "a"},
        {"ocr_dpi": 71}, {"rrf_k": True}, {"llm_base_url": "ftp://x"}, {"llm_timeout": 0}, {"ocr_language": "english"}, {"context_max_chars": 99}, {"bm25_b": 1.1},
    ):
        with pytest.raises(SettingsError):
            Settings(**bad)
    assert top_k_or(None, 5) == 5
    for bad_k in (0, 1001, True, 2.0):
        with pytest.raises(InvalidTopKError):
            top_k_or(bad_k, 5)
    assert InsufficientContextError.code() == "insufficient_context" and issubclass(InsufficientContextError, QueryError)


def test_word_error_rate_of_many_words(spark):
    """More distinct words than there are letters below the surrogates, and time in proportion to them."""
    n = 40_000
    words = " ".join(f"w{i}" for i in range(n))
    codes = spark.createDataFrame([(words, words + " more"), ("a b a", "b a b")], "r string, h string").select(T.word_codes(F.col("r"), F.col("h")).alias("c")).select("c.*").collect()
    assert codes[0].n == n and len(set(codes[0].r)) == n and codes[0].h[:-1] == codes[0].r and codes[0].h[-1] not in codes[0].r
    assert codes[1].r == codes[1].h[1] + codes[1].h[0] + codes[1].h[1]
    assert spark.createDataFrame([(" ".join(words.split()[:2000]), "x")], "r string, h string").select(T.word_error_rate("r", "h")).first()[0] == 1.0
