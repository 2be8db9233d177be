"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Each text becomes a few statistics, written once. Random Fourier features of the scaled statistics
approximate a Gaussian kernel; each partition of the labelled rows adds up its part of the normal
equations, whose sum (a fixed number of cells) is solved on the driver. A fifth of the labelled rows
is kept for calibration, in a fixed number of score bins. The scale and the kernel's width come from
a bounded sample of labelled rows (`sample_rows`); the normal equations and bins use them all. The
calibrated share is mixed with 0.1 % of a sigmoid of the raw score, so that the order of scores shows
within a pooled block too.

Defined results: a null or blank text has the statistics of an empty one and a score like any other;
a null id is scored, is not held out, and never has a label; contradictory labels are left out; with
no labels, or one class only, the score is the share of label 1 (0.5 without labels); repeated rows
are scored alike; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.calibration import Isotonic, clear_labels
from corpusloom.llm.common import Scratch, bounded_sample, fold, unused
from corpusloom.llm.quality_rules import STOP_WORDS

#: Random features, besides the constant.
FEATURES = 192
SEED = 20_240_229
RIDGE = 1e-3
#: Tasks that add up the partitions' sums, and rows of sums (150 kB each) that reach the driver.
SUMMERS = 16
#: Raw scores fall into so many bins for calibration.
BINS = 2000

_STOP = frozenset(w.encode() for w in STOP_WORDS)
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
_DIGITS = b"0123456789"
_SYMBOLS = b"#*$%&|<>"
_STOPS = b".,;:?"
_RUN_END = re.compile(rb"(?<![#*$%&|<>!])[#*$%&|<>!]{2,}+(?=\s|$)")  # linear: starts with its run, takes nothing back

NAMES = (
    "log_words", "word_bytes", "symbols", "upper", "exclaims", "stops", "digits", "pipes", "distinct", "same_as_before",
    "top_word", "repeated_lines", "line_words", "stop_words", "marked_ends", "repeated_runs", "spaces", "long_words",
)


def statistics(text: str | None) -> list[float]:
    """The statistics of a whole text, in the order of NAMES."""
    raw = text.encode("utf-8", "replace") if text else b""
    words = raw.lower().split()
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    size = len(raw)

    def rate(chars: bytes) -> float:
        return (size - len(raw.translate(None, chars))) / size

    lines = [x for x in raw.split(b"\n") if x.strip()]
    counts: dict[bytes, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    distinct = len(counts)
    most = max(counts.values())
    stop = sum(counts.get(w, 0) for w in _STOP)
    long_words = sum(c for w, c in counts.items() if len(w) > 20)
    runs = n - 5
    repeated = 1 - len(set(zip(words, words[1:], words[2:], words[3:], words[4:], words[5:], strict=False))) / runs if runs > 0 else 0.0
    letters = sum(map(len, words))
    return [
        float(np.log1p(n)), letters / n, rate(_SYMBOLS), rate(_UPPER), rate(b"!"), rate(_STOPS), rate(_DIGITS), rate(b"|"),
        distinct / n, sum(map(eq, words, words[1:])) / n, most / n, 1 - len(set(lines)) / len(lines), float(np.log1p(n / len(lines))),
        stop / n, len(_RUN_END.findall(raw)) / n, repeated, 1 - letters / size, long_words / n,
    ]


class Fourier:
    """Random Fourier features of scaled statistics, with a constant."""

    def __init__(self, sample: np.ndarray, features: int = FEATURES, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        d = len(NAMES)
        sample = sample.reshape(-1, d)
        sample = rng.permutation(sample[np.lexsort(sample.T)])  # whatever the order of the rows
        self.mean = sample.mean(axis=0) if len(sample) else np.zeros(d)
        spread = sample.std(axis=0) if len(sample) else np.ones(d)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = self.scaled(sample)
        half = len(z) // 2
        gaps = np.sqrt(((z[:half] - z[half : 2 * half]) ** 2).sum(axis=1)) if half else np.ones(1)
        width = max(float(np.median(gaps)), 0.1)
        self.w = rng.normal(size=(d, features)) / width
        self.b = rng.uniform(0, 2 * np.pi, features)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        phi = np.cos(self.scaled(x) @ self.w + self.b) * np.sqrt(2 / self.w.shape[1])
        return np.hstack([phi, np.ones((len(x), 1))])


def statistics_of(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([statistics(t if isinstance(t, str) else None) for t in texts], dtype=object)

    return run(text.cast("string"))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x): the statistics of each row."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), statistics_of(F.col("text")).alias("x"))


def normal_equations(rows: DataFrame, fourier: Fourier) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums over (x, y) of phi phi', phi y and rows: one packed row of sums a partition, added up in SUMMERS tasks."""
    d = fourier.w.shape[1] + 1
    upper = np.triu_indices(d)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        a, v, n = np.zeros((d, d)), np.zeros(d), 0
        for b in batches:
            if len(b):
                phi = fourier(np.stack(b["x"].to_numpy()))
                a += phi.T @ phi
                v += phi.T @ b["y"].to_numpy()
                n += len(b)
        if n:
            yield pd.DataFrame({"sums": [np.concatenate([a[upper], v, [n]]).tobytes()]})

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(len(upper[0]) + d + 1)
        for b in batches:
            for sums in b["sums"]:
                total += np.frombuffer(sums)
        yield pd.DataFrame({"sums": [total.tobytes()]})

    parts = rows.select("x", "y").mapInPandas(run, "sums binary").repartition(SUMMERS).mapInPandas(add, "sums binary")
    values = np.zeros(len(upper[0]) + d + 1)
    for row in parts.collect():
        values += np.frombuffer(row["sums"])
    a = np.zeros((d, d))
    a[upper] = values[: len(upper[0])]
    a = a + np.triu(a, 1).T
    return a, values[len(upper[0]) : -1], values[-1]


def fit(train: DataFrame, sample_rows: int = 20_000):
    """A function from statistics to scores, learned from (doc_id, x, y)."""
    sample = bounded_sample(train, sample_rows).select("x").toPandas()["x"]
    fourier = Fourier(np.stack(sample.to_numpy()) if len(sample) else np.zeros((0, len(NAMES))))
    aside = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(5)) == 0
    a, v, n = normal_equations(train.where(~aside), fourier)
    weights = np.linalg.solve(a + (RIDGE * max(n, 1.0) / len(v) + 1e-9) * np.eye(len(v)), v)

    def raw(x: np.ndarray) -> np.ndarray:
        return fourier(x) @ weights

    def bins(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                r = raw(np.stack(b["x"].to_numpy()))
                yield pd.DataFrame({"bin": np.clip((r + 0.5) / 2 * BINS, 0, BINS - 1).astype("int32"), "r": r, "y": b["y"]})

    part = train.where(aside).select("x", "y").mapInPandas(bins, "bin int, r double, y double")
    got = part.groupBy("bin").agg(F.avg("r").alias("r"), F.avg("y").alias("y"), F.count("*").alias("n")).toPandas()
    if not len(got):
        share = float(v[-1] / n) if n else 0.5
        got = pd.DataFrame({"r": [0.0], "y": [share], "n": [1]})
    isotonic = Isotonic(got["r"].to_numpy(), got["y"].to_numpy(), got["n"].to_numpy(float))
    return lambda x: isotonic(raw(x))


def score_column(score, x: Column) -> Column:
    """The score of a column of statistics."""

    @F.pandas_udf("double")
    def run(xs: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack(xs.to_numpy())) if len(xs) else [], dtype=float)

    return run(x)


def learned(rows: DataFrame, labels: DataFrame, modulus: int | None, held_out: int, sample_rows: int, scratch: Scratch):
    """The score learned from (doc_id, x) and `labels`, outside the held-out fold if there is one."""
    train = rows.select("doc_id", "x").join(clear_labels(labels, "quality"), "doc_id")
    train = train if modulus is None else train.where(fold(F.col("doc_id"), modulus) != held_out)
    return fit(scratch.keep(train), sample_rows)  # read for the count, the sample, the sums and the bins


def quality_scores(docs: DataFrame, labels: DataFrame, modulus: int = 3, held_out: int = 1, sample_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """Scores of each row of `docs` (doc_id, text), learned from `labels` (doc_id, quality) outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(measured(docs))
    score = learned(rows, labels, modulus, held_out, sample_rows, scratch)
    held = F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False))
    out = rows.select("doc_id", held.alias("held_out"), score_column(score, F.col("x")).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_filter(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, threshold: float = 0.5) -> DataFrame:
    """`docs` without the rows that score below the threshold; all labels are learned from."""
    x = unused(docs, "_statistics")
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.keep(docs.withColumn(x, statistics_of(F.col("text"))))
    score = learned(rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(x).alias("x")), labels, None, 0, sample_rows, scratch)
    return rows.where(score_column(score, F.col(x)) >= threshold).drop(x)
