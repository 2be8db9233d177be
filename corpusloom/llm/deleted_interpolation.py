"""LM scoring by deleted interpolation of bigrams, unigrams and the uniform distribution.

P(w|h) = l2 * c(h,w)/c(h) + l1 * c(w)/N + l0 / (V+1), with weights for each bucket of c(h) (powers
of two). The weights are learned by expectation-maximisation on counts held out of the estimates: a
tenth of the training documents is set aside, the estimates of the others predict its bigrams, and
the final model then counts all training documents under those weights.

How the counts meet the documents without a row for each token:

* Documents are read once into blocks of about two million tokens, each with a vocabulary of its own;
  a block is one row of a written table.
* A block sends each of its distinct n-grams once, as sorted hashes cut into ranges (shards), and a
  shard sums the counts of all blocks and answers each block in its own order. Both directions are
  packed arrays; a shard's size is set by the number of n-grams, so both it and a block stay bounded.
* A block and its answers then give every token's probabilities by array operations.

Defined results: a null or blank text is one end token; a null id is not held out and is learned
from; repeated rows count as often as they occur; an empty table gives an empty result; without any
training document every probability is that of an unknown token; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import Scratch, fold, partitions_for

#: Tokens in a block, and distinct n-grams in a shard, about.
BLOCK_TOKENS, SHARD_GRAMS = 2_000_000, 2_000_000
#: Folds: counted, set aside for the weights, held out of all learning.
COUNTED, ASIDE, HELD_OUT = 0, 1, 2
#: Buckets of the context's count: unseen, 1, 2-3, 4-7, ...
BUCKETS = 24
#: Steps to a factor of two, and the greatest number of such factors, of the grid that sums up held-out events.
GRID, OCTAVES = 8, 40
ROUNDS = 200

_START, _END = 0, 1
BLOCK_ROW = "block long, fold int, docs array<string>, lengths array<int>, vocabulary binary, tokens binary, grams long"


def squeeze(a: np.ndarray) -> bytes:
    """An integer array as compressed byte planes."""
    a = np.ascontiguousarray(a)
    return zstandard.compress(a.view(np.uint8).reshape(len(a), a.itemsize).T.tobytes(), 1)


def spread(b: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.decompress(b), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).view(kind).ravel()


class _Ids(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _level(h: np.ndarray, level: int) -> np.ndarray:
    """Hashes whose two lowest bits tell the kind of n-gram: 0 the start, 1 a token, 2 a bigram."""
    return (h & np.uint64(0xFFFFFFFFFFFFFFFC)) | np.uint64(level)


class Block:
    """The n-grams of a block's token sequence."""

    def __init__(self, lengths: np.ndarray, vocabulary: np.ndarray, tokens: np.ndarray) -> None:
        size = len(vocabulary)
        self.tokens = tokens.astype(np.int64)
        self.ends = np.cumsum(lengths.astype(np.int64))
        self.starts = self.ends - lengths
        self.before = np.empty_like(self.tokens)
        self.before[1:] = self.tokens[:-1]
        self.before[self.starts] = _START
        pairs, self.pair_of, self.pair_count = np.unique(self.before * size + self.tokens, return_inverse=True, return_counts=True)
        with np.errstate(over="ignore"):
            mixed = vocabulary[pairs // size] * np.uint64(0x9E3779B97F4A7C15) + vocabulary[pairs % size]
            mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
            mixed ^= mixed >> np.uint64(29)
        single = _level(vocabulary, 1)
        single[_START] = _level(vocabulary[:1], 0)[0]
        hashes = np.concatenate([single, _level(mixed, 2)])
        token_count = np.bincount(self.tokens, minlength=size)
        token_count[_START] = len(lengths)
        self.order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[self.order]
        self.counts = np.concatenate([token_count, self.pair_count])[self.order].astype(np.uint32)
        self.size = size

    def placed(self, answers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Answers in the order of `hashes`, as those of tokens and those of bigrams."""
        out = np.empty(len(answers), np.int64)
        out[self.order] = answers
        return out[: self.size], out[self.size :]

    def slices(self, shards: int) -> list[tuple[int, int, int]]:
        """(shard, from, to) of the sorted hashes."""
        shard = ((self.hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)
        cuts = np.flatnonzero(np.diff(shard)) + 1
        a = np.concatenate([[0], cuts])
        return list(zip(shard[a].tolist(), a.tolist(), [*cuts.tolist(), len(shard)], strict=True))


def read_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Blocks of `docs` (doc_id as text, fold, text)."""
    constants = [int(_level(np.array([xxhash.xxh3_64_intdigest(b"", 7)], np.uint64), 0)[0]), xxhash.xxh3_64_intdigest(b"", 11)]

    def close(held: dict, fold_: int, number: int) -> tuple:
        ids = held["ids"]
        vocabulary = np.array(constants + [xxhash.xxh3_64_intdigest(w) for w in ids if isinstance(w, bytes)], np.uint64)
        tokens, lengths = np.concatenate(held["tokens"]), np.array(held["lengths"], np.int32)
        grams = len(Block(lengths, vocabulary, tokens).hashes)
        block = (TaskContext.get().partitionId() << 24) + number
        return block, fold_, held["docs"], held["lengths"], squeeze(vocabulary), squeeze(tokens), grams

    def fresh() -> dict:
        ids = _Ids({_START: _START, _END: _END})  # no word is a number
        return {"ids": ids, "docs": [], "lengths": [], "tokens": [], "size": 0}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in BLOCK_ROW.split(", ")]
        open_ = {f: fresh() for f in (COUNTED, ASIDE, HELD_OUT)}
        number = 0
        for b in batches:
            for doc, f, text in zip(b["doc_id"], b["fold"], b["text"], strict=True):
                held = open_[f]
                words = text.encode("utf-8", "replace").lower().split() if isinstance(text, str) else []
                t = np.empty(len(words) + 1, np.int32)
                t[:-1] = np.fromiter(map(held["ids"].__getitem__, words), np.int32, len(words))
                t[-1] = _END
                held["docs"].append(doc)
                held["lengths"].append(len(t))
                held["tokens"].append(t)
                held["size"] += len(t)
                if held["size"] >= block_tokens:
                    yield pd.DataFrame([close(held, f, number)], columns=columns)
                    number += 1
                    open_[f] = fresh()
        for f, held in open_.items():
            if held["docs"]:
                yield pd.DataFrame([close(held, f, number)], columns=columns)
                number += 1

    return docs.mapInPandas(run, BLOCK_ROW)


def _block(row: pd.Series) -> Block:
    return Block(np.asarray(row["lengths"], np.int32), spread(row["vocabulary"], np.uint64), spread(row["tokens"], np.int32))


def send(blocks: DataFrame, shards: int) -> DataFrame:
    """(shard, block, fold, hashes, counts): each block's n-grams, cut by shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for _, row in b.iterrows():
                block = _block(row)
                rows = [
                    (s, row["block"], row["fold"], squeeze(np.diff(block.hashes[a:z], prepend=np.uint64(0))), squeeze(block.counts[a:z]) if row["fold"] != HELD_OUT else b"")
                    for s, a, z in block.slices(shards)
                ]
                yield pd.DataFrame(rows, columns=["shard", "block", "fold", "hashes", "counts"])

    return blocks.select("block", "fold", "lengths", "vocabulary", "tokens").mapInPandas(run, "shard int, block long, fold int, hashes binary, counts binary")


ANSWER = "shard int, block long, fold int, total binary, counted binary, stats array<long>"


def answer(b: pd.DataFrame) -> pd.DataFrame:
    """One shard: counts over all blocks, for each block in its own order; and a row of sums (block -1)."""
    with np.errstate(over="ignore"):
        parts = [np.cumsum(spread(x, np.uint64), dtype=np.uint64) for x in b["hashes"]]
    grams, place = np.unique(np.concatenate(parts), return_inverse=True)
    ends = np.cumsum([len(p) for p in parts])
    total, counted = np.zeros(len(grams), np.int64), np.zeros(len(grams), np.int64)
    for f, packed, end, p in zip(b["fold"], b["counts"], ends, parts, strict=True):
        if f != HELD_OUT:
            at = place[end - len(p) : end]
            n = spread(packed, np.uint32).astype(np.int64)
            total[at] += n  # a block has an n-gram once
            if f == COUNTED:
                counted[at] += n
    shard = int(b["shard"].iloc[0])
    rows = []
    for block, f, end, p in zip(b["block"], b["fold"], ends, parts, strict=True):
        at = place[end - len(p) : end]
        rows.append((shard, block, f, squeeze(total[at].astype(np.uint32)), squeeze(counted[at].astype(np.uint32)) if f == ASIDE else b"", None))
    token = (grams & np.uint64(3)) == 1
    sums = [int((total[token] > 0).sum()), int(total[token].sum()), int((counted[token] > 0).sum()), int(counted[token].sum())]
    rows.append((shard, -1, -1, b"", b"", sums))
    return pd.DataFrame(rows, columns=[c.split()[0] for c in ANSWER.split(", ")])


def _joined(answers: pd.DataFrame, column: str) -> np.ndarray:
    return np.concatenate([spread(x, np.uint32) for x in answers.sort_values("shard")[column]]).astype(np.int64)


def bucket_of(context: np.ndarray) -> np.ndarray:
    """0 for an unseen context, otherwise the bit length of its count."""
    return np.minimum(np.frexp(context.astype(np.float64))[1], BUCKETS - 1).astype(np.int64)


def held_out_events(blocks: DataFrame, answers: DataFrame, tokens: int, vocabulary: int) -> DataFrame:
    """(bucket, cell, n, p2, p1): the bigrams of the documents set aside, summed in a grid of probabilities.

    A cell spans an eighth of a factor of two of both probabilities and keeps their exact means, so
    the grid, which has a fixed number of cells, changes the weights little.
    """

    def step(p: np.ndarray) -> np.ndarray:
        with np.errstate(divide="ignore"):
            return np.where(p > 0, 1 + np.minimum(-np.log2(p) * GRID, GRID * OCTAVES), 0).astype(np.int64)

    def run(enc: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "cell", "n", "p2", "p1"]
        if not len(enc):
            return pd.DataFrame(columns=columns)
        block = _block(enc.iloc[0])
        single, pair = block.placed(_joined(ans, "counted"))
        first = np.zeros(len(pair), np.int64)
        first[block.pair_of] = np.arange(len(block.tokens))
        context, token = single[block.before[first]], single[block.tokens[first]]
        p2, p1 = pair / np.maximum(context, 1), token / max(tokens, 1)
        frame = pd.DataFrame({"bucket": bucket_of(context), "cell": step(p2) * 10_000 + step(p1), "n": block.pair_count.astype(np.float64)})
        frame["p2"], frame["p1"] = p2 * frame["n"], p1 * frame["n"]
        return frame.groupby(["bucket", "cell"], as_index=False).sum()[columns]

    only = blocks.where(F.col("fold") == ASIDE).groupBy("block")
    cells = only.cogroup(answers.where(F.col("fold") == ASIDE).groupBy("block")).applyInPandas(run, "bucket long, cell long, n double, p2 double, p1 double")
    return cells.groupBy("bucket", "cell").agg(F.sum("n").alias("n"), F.sum("p2").alias("p2"), F.sum("p1").alias("p1"))


def learn_weights(events: pd.DataFrame, vocabulary: int, rounds: int = ROUNDS) -> np.ndarray:
    """(bucket, 3): weights of the bigram, unigram and uniform estimates by expectation-maximisation.

    A bucket without events takes the weights of the nearest one that has some.
    """
    out = np.full((BUCKETS, 3), np.nan)
    for bucket, e in events.groupby("bucket"):
        n = e["n"].to_numpy()
        p = np.stack([e["p2"] / n, e["p1"] / n, np.full(len(n), 1 / (vocabulary + 1))], axis=1)
        w = np.full(3, 1 / 3)
        for _ in range(rounds):
            mixed = p * w
            share = mixed / mixed.sum(axis=1, keepdims=True)
            new = (share * n[:, None]).sum(axis=0) / n.sum()
            if np.abs(new - w).max() < 1e-9:
                break
            w = new
        out[int(bucket)] = np.maximum(new, 1e-9) / np.maximum(new, 1e-9).sum()
    seen = np.flatnonzero(~np.isnan(out[:, 0]))
    if not len(seen):
        return np.full((BUCKETS, 3), 1 / 3)
    for k in range(BUCKETS):
        out[k] = out[seen[np.abs(seen - k).argmin()]]
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score_blocks(blocks: DataFrame, answers: DataFrame, weights: np.ndarray, tokens: int, vocabulary: int) -> DataFrame:
    def run(enc: pd.DataFrame, ans: pd.DataFrame) -> pd.DataFrame:
        columns = [c.split()[0] for c in SCORES.split(", ")]
        if not len(enc):
            return pd.DataFrame(columns=columns)
        row = enc.iloc[0]
        block = _block(row)
        single, pair = block.placed(_joined(ans, "total"))
        context, token = single[block.before], single[block.tokens]
        w = weights[bucket_of(context)]
        p = w[:, 0] * (pair[block.pair_of] / np.maximum(context, 1)) + w[:, 1] * (token / max(tokens, 1)) + w[:, 2] / (vocabulary + 1)
        base = np.log10((token + 0.5) / (tokens + 0.5 * (vocabulary + 1)))
        out = pd.DataFrame({"doc_id": pd.array([None if x is None else int(x) for x in row["docs"]], "Int64")})
        out["held_out"] = bool(row["fold"] == HELD_OUT)
        out["n_tokens"] = np.asarray(row["lengths"], np.int64)
        out["n_known"] = np.add.reduceat((token > 0).astype(np.int64), block.starts)
        out["train_tokens"] = tokens
        out["base_score"] = np.add.reduceat(base, block.starts)
        out["score"] = np.add.reduceat(np.log10(p), block.starts)
        return out[columns]

    return blocks.groupBy("block").cogroup(answers.where("block >= 0").groupBy("block")).applyInPandas(run, SCORES)


def lm_scores(docs: DataFrame, modulus: int = 5, held_out: int = 1, aside: int = 10, block_tokens: int = BLOCK_TOKENS, shard_grams: int = SHARD_GRAMS) -> DataFrame:
    """Scores of each row of `docs` (doc_id, text), learned from the rows whose fold is not `held_out`."""
    scratch = Scratch(docs.sparkSession, "lm")
    doc = F.col("doc_id").cast("long")
    kind = F.when(F.coalesce(fold(doc, modulus), F.lit(-1)) == held_out, HELD_OUT).when(F.pmod(F.xxhash64(doc), F.lit(aside)) == 0, ASIDE).otherwise(COUNTED)
    blocks = scratch.keep(read_blocks(docs.select(doc.cast("string").alias("doc_id"), kind.alias("fold"), F.col("text").cast("string").alias("text")), block_tokens))
    grams = blocks.agg(F.sum("grams")).first()[0] or 0
    shards = partitions_for(grams, shard_grams)
    answers = scratch.keep(send(blocks, shards).groupBy("shard").applyInPandas(answer, ANSWER))
    sums = answers.where("block = -1").agg(*[F.coalesce(F.sum(F.col("stats")[i]), F.lit(0)) for i in range(4)]).first()
    vocabulary, tokens, part_vocabulary, part_tokens = (int(x) for x in sums)
    events = held_out_events(blocks, answers, part_tokens, part_vocabulary).toPandas()
    weights = learn_weights(events, part_vocabulary)
    return score_blocks(blocks, answers, weights, tokens, vocabulary)
