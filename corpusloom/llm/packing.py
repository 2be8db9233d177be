"""Packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Documents become token ids once; whole windows of the sequence length and the rest of each document
are its pieces. The pieces' sizes and checksums (never the ids) are written to the shared folder,
dealt at random into groups of a set size, and each group is packed on its own, so a task's memory
is bounded by the group size and not by the table.

Defined results: a null or empty text is its end id alone; repeated rows are packed row by row (a
row number, fixed by the written table, is part of a piece's place); a null id is packed as null; an
empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import os
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import batched
from unicodedata import is_normalized, normalize

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, partitions_for

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Words and stems whose ids a task remembers.
CACHE_WORDS = 500_000
#: ASCII marks that end words.
MARKS = b".,!?;:#$%&*|"

_models: dict[str, object] = {}
#: The characters that byte-level tokenizers write bytes as: printable ones stand for themselves, others from U+0100 on.
_PRINTABLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_OTHERS = [b for b in range(256) if b not in set(_PRINTABLE)]
_BYTES = {b: chr(b) for b in _PRINTABLE} | {b: chr(0x100 + i) for i, b in enumerate(_OTHERS)}
_AS_BYTES = [_BYTES[b] for b in range(256)]


def tokenizer(path: str):
    """The tokenizer, loaded once for each Python worker."""
    if path not in _models:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _models[path] = Tokenizer.from_file(path)
    return _models[path]


def stem_and_tail(word: bytes) -> tuple[bytes, bytes]:
    """A word without the ASCII marks at its end, and those marks.

    The tokenizer always splits between a letter or digit and such a mark, so both have their own
    ids. Anything less plain is left in one piece, also a letter that ends in a combining mark once
    it is folded and composed, such as a capital I with a dot.
    """
    stem = word.rstrip(MARKS)
    if stem and len(stem) < len(word) and (stem[-1:].isalnum() if stem[-1] < 128 else normalize("NFC", normalize("NFC", stem.decode("utf-8")[-1]).lower())[-1].isalpha()):
        return stem, word[len(stem) :]
    return word, b""


def folded(text: str) -> list[bytes]:
    """The words of a text, A-Z in lower case as the tokenizer has them; special tokens keep theirs."""
    raw = text.encode("utf-8", "replace")
    return (raw if b"<|" in raw else raw.lower()).split()


def merged(merges, text: str) -> list[int]:
    """Ids of a piece that normaliser and splitter leave as it is."""
    return [t.id for t in merges.tokenize("".join([_AS_BYTES[b] for b in text.encode()]))]


def is_plain(model) -> bool:
    """Whether a tokenizer folds case, splits marks off words and works on bytes, as the short ways here ask for."""

    def ids(text: str) -> list[int]:
        return model.encode(text, add_special_tokens=False).ids

    words = ("the", "zebraing", "née", "straße", "überñandú")
    return all(ids(w) == ids(w.title()) == merged(model.model, w) and ids(f"{w}.") == ids(w) + ids(".") and ids(f"{w}?! {w}#$") == ids(w) + ids("?!") + ids(w) + ids("#$") for w in words)


class Words(dict):
    """A task's words to their ids, made when first asked for."""

    def __init__(self, model, most: int = CACHE_WORDS) -> None:
        self.model, self.merges, self.most, self.plain = model, model.model, most, is_plain(model)

    def __missing__(self, word: bytes) -> bytes:
        stem, tail = stem_and_tail(word) if self.plain else (word, b"")
        ids = self[stem] + self[tail] if tail else self.fresh(word)
        if len(self) >= self.most:
            self.clear()
        self[word] = ids
        return ids

    def fresh(self, word: bytes) -> bytes:
        """Composed small Latin letters pass normaliser and splitter as they are: only the merges are left to do."""
        text = word.decode("utf-8")
        if self.plain and word.isalpha() and word.islower():  # of bytes, these ask for a-z
            ids = [t.id for t in self.merges.tokenize(text)]
        elif self.plain and text.isalpha() and max(text) < "\u0250" and text == text.lower() and is_normalized("NFC", text):
            ids = merged(self.merges, text)
        else:
            ids = self.model.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()


def encode(texts: Iterable[str], path: str, cache_words: int = CACHE_WORDS) -> Iterator[bytes]:
    """The ids of each text, as little-endian unsigned 32-bit numbers.

    The tokenizer never joins characters across ASCII white space, so a text's ids are its words'
    ids in turn, and each distinct word is encoded once.
    """
    known = Words(tokenizer(path), cache_words)
    for text in texts:
        yield b"".join([known[w] for w in (folded(text) if known.plain else text.encode("utf-8", "replace").split())])


def cut(docs: DataFrame, tokenizer_path: str, sequence: int = 2048, end_id: int = 1) -> DataFrame:
    """Each document's pieces: whole sequences, then its rest."""

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], "<u4").tobytes()
        docs: deque[str | None] = deque()

        def texts() -> Iterator[str]:
            for b in batches:
                for doc, t in zip(b["doc_id"], b["text"], strict=True):
                    docs.append(doc)
                    yield t if isinstance(t, str) else ""

        for some in batched(encode(texts(), tokenizer_path), 1024):  # one memory of words for the whole task
            rows = []
            for ids in some:
                doc = docs.popleft()
                ids += end
                n = len(ids) // 4
                for s in range(0, n, sequence):
                    part = ids[4 * s : 4 * (s + sequence)]
                    rows.append((None if doc is None else int(doc), s, len(part) // 4, zlib.crc32(part), n))
            out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
            out["doc_id"] = pd.array([r[0] for r in rows], "Int64")
            yield out

    # ids travel as text: beside a null, pandas would turn numbers into doubles
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInPandas(pieces, PIECES)


def first_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """Bin and offset of each size, in the given order, by first fit.

    A tournament tree holds the greatest free capacity below each node; unopened bins are free
    throughout, so one walk down from the root finds the first bin that fits or opens the next.
    """
    leaves = 1
    while leaves < len(sizes):
        leaves *= 2
    free = [capacity] * (2 * leaves)
    bins, offsets = [], []
    for size in sizes:
        at = 1
        while at < leaves:
            at *= 2
            if free[at] < size:
                at += 1
        bins.append(at - leaves)
        offsets.append(capacity - free[at])
        free[at] -= size
        while at > 1:
            at //= 2
            most = max(free[2 * at], free[2 * at + 1])
            if free[at] == most:
                break
            free[at] = most
    return bins, offsets


def pack(pieces: DataFrame, scratch: Scratch, sequence: int = 2048, group_rows: int = 8192) -> DataFrame:
    """Give each piece a sequence and its place there."""
    table = scratch.keep(pieces.withColumn("row", F.monotonically_increasing_id()))  # fixed once written
    groups = partitions_for(table.count(), group_rows)
    dealt = table.withColumn("grp", F.pmod(F.xxhash64("row"), F.lit(groups)))

    def ffd(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["length", "row"], ascending=[False, True], ignore_index=True)
        bins, offsets = first_fit(b["length"].tolist(), sequence)
        b["sequence_id"] = b["grp"] * np.int64(2**32) + np.array(bins, "int64")
        b["offset"] = np.array(offsets, "int64")
        b["doc_id"] = pd.array([None if x is None else int(x) for x in b["doc_id"]], "Int64")
        return b.drop(columns=["row", "grp"])

    return dealt.withColumn("doc_id", F.col("doc_id").cast("string")).groupBy("grp").applyInPandas(ffd, PIECES + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, sequence: int = 2048, end_id: int = 1, group_rows: int = 8192) -> DataFrame:
    """Pack `docs` (doc_id, text) into sequences of at most `sequence` ids: a row for each piece."""
    scratch = Scratch(docs.sparkSession, "packing")
    return pack(cut(docs, tokenizer_path, sequence, end_id), scratch, sequence, group_rows)
