"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

The features of a whole text are densities of a seed lexicon and of a lexicon learned from the
labels, hits near second-person words, and rates of capitals, punctuation and obfuscation. Lexicon,
trees and calibration are learned from a bounded sample of labelled ids (`sample_rows`), whose texts
are found by a broadcast of that many ids; of an id with several texts the smallest is learned from.
Every row is then scored in one pass. The calibrated share is mixed with 0.1 % of a sigmoid of the log
odds, so that the order of scores shows within a pooled block too.

Defined results: a null or blank text has the features of an empty one and a score like any other; a
null id is scored, is not held out, and never has a label; contradictory labels are left out; without
labels the score is 0.5; repeated rows are scored alike; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.calibration import Isotonic, clear_labels
from corpusloom.llm.common import Scratch, bounded_sample, fold

#: Insults of the four languages.
INSULTS = (
    "idiot idiots moron morons stupid scum trash clown loser losers pathetic worthless disgusting dumb fool imbecile jerk garbage filth vermin ugly "
    "dummkopf blöd blöde abschaum müll versager widerlich erbärmlich wertlos trottel arschloch "
    "imbécile débile ordure minable raté pathétique dégoûtant nul crétin connard "
    "imbécil estúpido estúpida basura escoria payaso patético asqueroso inútil tonto perdedor"
).split()
SECOND_PERSON = frozenset(w.encode() for w in "you your yours yourself du dich dir dein deine ihr euch euer tu toi te ton ta tes vous votre vos tú ti usted ustedes vosotros tus".split())
#: Words between a hit and a second-person word, at most.
NEAR = 5
#: Learned words at most, and the documents and log odds that a word needs.
LEARNED, LEAST_DOCS, LEAST_ODDS = 1000, 3, 2.0

_MARKS = bytes(c for c in range(128) if not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122))
_PLAIN = bytes.maketrans(_MARKS, b" " * len(_MARKS))
_UPPER = bytes(range(65, 91))
# a match starts where its run does, and no run is taken back: either alone leaves long runs quadratic
_MIXED = re.compile(rb"(?<![a-z])[a-z]++[0-9@$!*_.\-]++[a-z][a-z0-9@$!*_.\-]*+|(?<![0-9@$])[0-9@$]++[a-z]{2}[a-z0-9@$!*_.\-]*+")
_LEET = bytes.maketrans(b"01345$7@!", b"oieasstai")
_SPELLED = re.compile(rb"\b(?:[a-z][ .\-_*]){3,}[a-z]\b")
_LONG = re.compile(rb"([a-z])\1{2,}")
_CAPITALS = re.compile(rb"\b[A-Z]{3,}\b")
_RUNS = re.compile(rb"[!?]{2,}")

NAMES = (
    "log_words", "seed_hits", "seed_density", "learned_hits", "learned_density", "learned_odds", "learned_top", "distinct_hits", "near_you", "you_density",
    "capitals", "capital_words", "exclaims", "questions", "mark_runs", "mixed_rate", "mixed_hits", "spelled_hits", "stretched_rate",
)


def plain_words(raw: bytes) -> list[bytes]:
    return raw.lower().translate(_PLAIN).split()


def features(text: str | None, learned: dict[bytes, float], seeds: frozenset) -> list[float]:
    """The features of a whole text, in the order of NAMES."""
    raw = text.encode("utf-8", "replace") if text else b""
    words = plain_words(raw)
    n = len(words)
    if not n:
        return [0.0] * len(NAMES)
    small = raw.lower()
    counts = Counter(words)
    seed = {w: counts[w] for w in seeds if w in counts}
    odds = {w: learned[w] for w in counts.keys() & learned.keys()}
    seed_hits = sum(seed.values())
    learned_hits = sum(counts[w] for w in odds)
    near = 0
    hits = set(seed) | set(odds)
    you = sum(counts[w] for w in SECOND_PERSON if w in counts)
    if hits and you:
        spots = [i for i, w in enumerate(words) if w in SECOND_PERSON]
        places = np.searchsorted(spots, at := np.array([i for i, w in enumerate(words) if w in hits]))
        s = np.array([-(10**9), *spots, 10**9])
        near = int((np.minimum(at - s[places], s[places + 1] - at) <= NEAR).sum())
    mixed = _MIXED.findall(small)
    mixed_hits = sum((x := re.sub(rb"[^a-z]", b"", w.translate(_LEET))) in seeds or x in learned for w in mixed)
    spelled = sum((x := re.sub(rb"[^a-z]", b"", w)) in seeds or x in learned for w in _SPELLED.findall(small))
    size = len(raw)
    return [
        math.log1p(n), float(seed_hits), 100 * seed_hits / n, float(learned_hits), 100 * learned_hits / n, sum(odds.values()), max(odds.values(), default=0.0),
        float(len(hits)), float(near), 100 * you / n, (size - len(raw.translate(None, _UPPER))) / size, len(_CAPITALS.findall(raw)) / n,
        100 * raw.count(b"!") / n, 100 * raw.count(b"?") / n, 100 * len(_RUNS.findall(raw)) / n, 100 * len(mixed) / n, float(mixed_hits), float(spelled),
        100 * len(_LONG.findall(small)) / n,
    ]


class Trees:
    """Gradient-boosted regression trees for the logistic loss, over quantile bins."""

    def __init__(self, x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, bins: int = 32, least: float = 5.0, ridge: float = 1.0) -> None:
        self.cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        for k, c in enumerate(self.cuts):  # counts are mostly zero: 0, 1, 2 and so on stay apart
            values = np.unique(x[:, k])
            self.cuts[k] = np.unique(np.concatenate([c, values[:8]]))
        b = self.binned(x)
        width = max((len(c) for c in self.cuts), default=0) + 1
        mean = np.clip(y.mean() if len(y) else 0.5, 1e-6, 1 - 1e-6)
        self.start = float(np.log(mean / (1 - mean)))
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # feature and bin of inner nodes, values of leaves
        f = np.full(len(y), self.start)
        d = x.shape[1]
        offset = np.arange(d) * width
        for _ in range(rounds if len(y) else 0):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, p * (1 - p)
            node = np.zeros(len(y), np.int64)
            feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width, np.int64)
            for level in range(depth):
                for k in range(2**level):
                    rows = np.flatnonzero(node == k)
                    at = 2**level - 1 + k
                    if len(rows) < 2 * least:
                        continue
                    flat = (b[rows] + offset).ravel()
                    gs = np.bincount(flat, np.repeat(g[rows], d), d * width).reshape(d, width).cumsum(axis=1)
                    hs = np.bincount(flat, np.repeat(h[rows], d), d * width).reshape(d, width).cumsum(axis=1)
                    ns = np.bincount(flat, minlength=d * width).reshape(d, width).cumsum(axis=1)
                    gt, ht, nt = gs[:, -1:], hs[:, -1:], ns[:, -1:]
                    gain = gs**2 / (hs + ridge) + (gt - gs) ** 2 / (ht - hs + ridge) - gt**2 / (ht + ridge)
                    gain[(ns < least) | (nt - ns < least)] = 0
                    best = int(gain.argmax())
                    if gain.flat[best] > 1e-6:
                        feature[at], cut[at] = divmod(best, width)
                at = 2**level - 1 + node
                node = 2 * node + (b[np.arange(len(y)), feature[at]] > cut[at])
            gs = np.bincount(node, g, 2**depth)
            hs = np.bincount(node, h, 2**depth)
            leaf = rate * gs / (hs + ridge)
            self.trees.append((feature, cut, leaf))
            f += leaf[node]

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, v, "left") for c, v in zip(self.cuts, x.T, strict=True)], axis=1)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Log odds."""
        out = np.full(len(x), self.start)
        if not len(x):
            return out
        b, row = self.binned(x), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            level = 0
            while 2**level < len(leaf):
                at = 2**level - 1 + node
                node = 2 * node + (b[row, feature[at]] > cut[at])
                level += 1
            out += leaf[node]
        return out


def learn_lexicon(sample: DataFrame) -> dict[bytes, float]:
    """Words of (text, y) with the log odds of their documents' being toxic; at most LEARNED."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        toxic: Counter = Counter()
        clean: Counter = Counter()
        docs = [0, 0]
        for b in batches:
            for text, y in zip(b["text"], b["y"], strict=True):
                (toxic if y else clean).update(set(plain_words(text.encode("utf-8", "replace"))) if isinstance(text, str) else ())
                docs[int(y)] += 1
        rows = [(w.decode("utf-8", "replace"), toxic[w], clean[w]) for w in toxic.keys() | clean.keys()]
        yield pd.DataFrame([*rows, ("", docs[1], docs[0])], columns=["word", "toxic", "clean"])

    counts = sample.mapInPandas(run, "word string, toxic long, clean long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    found = counts.where((F.col("toxic") >= LEAST_DOCS) | (F.col("word") == ""))
    got = found.orderBy(F.col("word") != "", (F.col("toxic") / (F.col("clean") + 1)).desc(), "word").limit(LEARNED + 1).toPandas()
    total = got[got["word"] == ""]
    if not len(total):
        return {}
    bad, good = int(total["toxic"].iloc[0]), int(total["clean"].iloc[0])
    out = {}
    for w, t, c in got[got["word"] != ""][["word", "toxic", "clean"]].itertuples(index=False):
        odds = math.log((t + 0.1) / (bad + 1)) - math.log((c + 0.5) / (good + 1))
        if odds >= LEAST_ODDS:
            out[w.encode()] = odds
    return out


def _all_features(texts, learned: dict[bytes, float], seeds: frozenset) -> np.ndarray:
    return np.array([features(t if isinstance(t, str) else None, learned, seeds) for t in texts], float).reshape(-1, len(NAMES))


def toxicity_scores(docs: DataFrame, labels: DataFrame, modulus: int = 4, held_out: int = 2, sample_rows: int = 20_000, threshold: float = 0.3) -> DataFrame:
    """Scores of each row of `docs` (doc_id, text), learned from `labels` (doc_id, toxic) outside the held-out fold."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    held = F.coalesce(fold(F.col("doc_id"), modulus) == held_out, F.lit(False))
    only = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = bounded_sample(clear_labels(labels, "toxic").where(~held), sample_rows)
    # three of four rows make the lexicon and the trees, the fourth calibrates them
    part = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("part")), F.lit(4)).cast("int").alias("part")
    found = only.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = scratch.keep(found.select("text", "y", part))
    seeds = frozenset(w.encode() for w in INSULTS)
    # a word's odds are learned on other rows than those from which the trees learn their worth
    learned = learn_lexicon(sample.where("part < 2").select("text", "y"))

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield pd.DataFrame({"x": list(_all_features(b["text"], learned, seeds)), "y": b["y"], "part": b["part"]})

    got = sample.where("part >= 1").mapInPandas(measure, "x array<double>, y double, part int").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, len(NAMES)))
    y, calibrates = got["y"].to_numpy(float), got["part"].to_numpy() == 3
    trees = Trees(x[~calibrates], y[~calibrates])
    isotonic = Isotonic(trees(x[calibrates]), y[calibrates], np.ones(int(calibrates.sum())))

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(isotonic(trees(_all_features(texts, learned, seeds))), dtype=float)

    out = only.select("doc_id", held.alias("held_out"), score("text").alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
