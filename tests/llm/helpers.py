from __future__ import annotations

import random

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def documents(spark, texts, ids=None):
    """A documents table with two more columns of names that the operators use themselves."""
    ids = list(range(len(texts))) if ids is None else ids
    rows = [(i, t, "en", "s", None if t is None else len(t), "mine", 7) for i, t in zip(ids, texts, strict=True)]
    return spark.createDataFrame(rows, DOC + ", score string, key int")


def words(rng: random.Random, n: int, vocabulary: int = 400) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


#: Texts that every operator must bear.
ODD = [None, "", " \n\t ", "one", "a\x1cb c d", "x " * 30_000, "Same text here", "Same text here", "ümläut ß \U0001f600 end", "\x0b\x0c", "w" * 1_000_000, "#" * 1_000_000 + "x"]
