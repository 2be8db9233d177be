"""Mixing to target weights by soft domain membership.

A multinomial classifier, learned from the labelled table, gives each document the posteriors of the
domains that the labels define: sound, poor and toxic. Rates r >= 0 for all documents minimise

    sum over domains of (expected tokens of d - target of d)^2, starting from r = 1,

where the expected tokens of domain d are the sum of rate * tokens * posterior. Projected gradient
descent, scaled by the inverse Gram matrix of the domains, needs only one sum for each domain a step:
a document's rate follows from the steps' sums alone, so no table of rates is rewritten, and each
step is one pass over (tokens, posteriors). Of all rates that meet the targets, those nearest to 1
are reached.

A rate r then means floor(r + u) copies, u being a hash of the row, so copies follow the rate in
expectation. The targets are the given weights' shares of all tokens. With `supply`, which is off in
`mixing_rates` and on in `mix`, they are set against what the sound domain holds, so sound documents
stay, and no domain's target is above `supply` times what it holds, so scarce domains aren't repeated
at will. The targets used, the tokens reached and whether they agree are part of `mixing_rates`' rows;
`mix` warns where they don't.

Defined results: a null or blank text has no tokens and the rate 1; ids with contradictory labels are
not learned from; without labels, or with one domain only, there is one domain, and its rate is its
target over its share; repeated rows have the same rate and round alike; a null id is a row like any
other; an empty table gives an empty result; all columns are kept.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.calibration import clear_labels
from corpusloom.llm.common import Scratch, bounded_sample, unused
from corpusloom.llm.quality_classifier import NAMES, statistics
from corpusloom.llm.toxicity import INSULTS, learn_lexicon, plain_words

#: The domains, and the target share of expected tokens of each.
DOMAINS = ("sound", "poor", "toxic")
TARGETS = (0.94, 0.03, 0.03)
#: In `mix`, the sound domain's target as a multiple of what it holds, and the most that any domain's may be.
SUPPLY = 1.2
#: Steps of descent at most, and the relative gap to the targets at which they end.
STEPS, CLOSE = 20, 1e-3

_INSULTS = frozenset(w.encode() for w in INSULTS)
#: Inputs of the domain classifier.
INPUTS = len(NAMES) + 4


def inputs(text: str | None, learned: dict[bytes, float]) -> list[float]:
    """A text's statistics, with the density and presence of insults and of words learned from the labels."""
    words = plain_words(text.encode("utf-8", "replace")) if text else []
    insults = sum(map(_INSULTS.__contains__, words))
    odds = [learned[w] for w in words if w in learned]
    return [*statistics(text), min(100 * insults / max(1, len(words)), 5.0), float(insults > 0), min(100 * len(odds) / max(1, len(words)), 5.0), max(odds, default=0.0)]


class Softmax:
    """Multinomial logistic regression on scaled inputs and their squares, by Newton-like descent."""

    def __init__(self, x: np.ndarray, y: np.ndarray, classes: int, rounds: int = 300, ridge: float = 1e-3) -> None:
        self.mean = x.mean(axis=0) if len(x) else np.zeros(INPUTS)
        spread = x.std(axis=0) if len(x) else np.ones(INPUTS)
        self.scale = np.where(spread > 1e-9, spread, 1.0)
        z = self.expanded(x)
        share = np.bincount(y, minlength=classes) + 0.5
        self.w = np.zeros((z.shape[1], classes))
        self.w[-1] = np.log(share / share.sum())
        if not len(x):
            return
        target = np.eye(classes)[y]
        lipschitz = 0.5 * np.linalg.eigvalsh(z.T @ z / len(z))[-1] + ridge
        last, ahead, t = self.w.copy(), self.w.copy(), 1.0
        for _ in range(rounds):
            g = z.T @ (self._share(z @ ahead) - target) / len(z) + ridge * ahead
            new = ahead - g / lipschitz
            t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
            ahead = new + (t - 1) / t2 * (new - last)
            last, t = new, t2
        self.w = last

    def expanded(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x.reshape(-1, len(self.mean)) - self.mean) / self.scale, -5, 5)
        return np.hstack([z, z**2 - 1, np.ones((len(z), 1))])

    @staticmethod
    def _share(s: np.ndarray) -> np.ndarray:
        e = np.exp(s - s.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return self._share(self.expanded(x) @ self.w)


def learn_domains(rows: DataFrame, labels: DataFrame, sample_rows: int, scratch: Scratch) -> tuple[Softmax, dict[bytes, float]]:
    """The domain classifier and its lexicon, from halves of a bounded sample of labelled rows of (doc_id, text)."""
    quality, toxic = clear_labels(labels, "quality").withColumnRenamed("y", "quality"), clear_labels(labels, "toxic").withColumnRenamed("y", "toxic")
    domain = F.when(F.col("toxic") > 0, 2).when(F.col("quality") > 0, 0).otherwise(1)
    chosen = bounded_sample(quality.join(toxic, "doc_id").select("doc_id", domain.alias("y")), sample_rows)

    half = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("half")), F.lit(2)).alias("half")
    found = rows.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))
    sample = scratch.keep(found.select("text", "y", half))
    learned = learn_lexicon(sample.where("half = 0").select("text", (F.col("y") == 2).cast("double").alias("y")))

    @F.pandas_udf("array<double>")
    def measure(texts: pd.Series) -> pd.Series:
        return pd.Series([inputs(t if isinstance(t, str) else None, learned) for t in texts], dtype=object)

    got = sample.where("half = 1").select(measure("text").alias("x"), "y").toPandas()
    x = np.stack(got["x"].to_numpy()) if len(got) else np.zeros((0, INPUTS))
    return Softmax(x, got["y"].to_numpy(np.int64), len(DOMAINS)), learned


def membership(model: Softmax, learned: dict[bytes, float], text: Column) -> Column:
    """struct<tokens, p>: the words and the domain posteriors of a text."""

    @F.pandas_udf("struct<tokens:long,p:array<double>>")
    def run(texts: pd.Series) -> pd.DataFrame:
        each = [t if isinstance(t, str) else None for t in texts]
        p = list(model(np.array([inputs(t, learned) for t in each], float))) if each else []
        return pd.DataFrame({"tokens": np.array([len(t.encode("utf-8", "replace").split()) if t else 0 for t in each], "int64"), "p": p})

    return run(text)


def rates(p: np.ndarray, duals: Sequence[np.ndarray]) -> np.ndarray:
    """The rates after the given steps, from 1."""
    r = np.ones(len(p))
    for d in duals:
        r = np.maximum(0.0, r + p @ d)
    return r


@dataclass
class Solution:
    """The steps of descent, the domains' targets and the tokens that the rates give."""

    steps: list[np.ndarray] = field(default_factory=list)
    target: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))
    reached: np.ndarray = field(default_factory=lambda: np.zeros(len(DOMAINS)))

    @property
    def converged(self) -> bool:
        return bool((np.abs(self.target - self.reached) <= CLOSE * self.target).all())


def solve(table: DataFrame, targets: tuple, supply: float | None, steps: int) -> Solution:
    """Projected gradient descent over (tokens, p)."""
    k = len(targets)
    p = [F.col("p")[d] for d in range(k)]
    columns = [F.sum(F.col("tokens") * x) for x in p] + [F.sum(F.col("tokens") * x * y) for x in p for y in p]
    sums = np.array([x or 0.0 for x in table.agg(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()], float)
    have, gram = sums[:k], sums[k:].reshape(k, k)
    total = have.sum()
    if not total:
        return Solution()
    target = np.array(targets, float) / sum(targets)
    if supply is None:
        target = target * total
    else:  # a domain with less than its share isn't repeated beyond the supply
        target = np.minimum(target * (supply * have[0] / target[0] if have[0] else total), np.maximum(supply * have, 1e-6 * total))
    scale = np.linalg.pinv(gram + 1e-6 * total / k * np.eye(k))
    out = Solution([], target, have)
    while not out.converged and len(out.steps) < steps:
        out.steps.append(scale @ (target - out.reached))

        def part(batches: Iterator[pd.DataFrame], duals=tuple(out.steps)) -> Iterator[pd.DataFrame]:
            s = np.zeros(k)
            for b in batches:
                if len(b):
                    p = np.stack(b["p"].to_numpy())
                    s += (rates(p, duals) * b["tokens"].to_numpy()) @ p
            yield pd.DataFrame({"d": np.arange(k), "s": s})

        got = table.select("tokens", "p").mapInPandas(part, "d int, s double").groupBy("d").agg(F.sum("s").alias("s")).toPandas()
        out.reached = np.zeros(k)
        out.reached[got["d"]] = got["s"]
    return out


def rate_columns(docs: DataFrame, labels: DataFrame, targets: tuple = TARGETS, supply: float | None = None, steps: int = STEPS, sample_rows: int = 20_000) -> tuple[DataFrame, str, Solution]:
    """`docs`, written again with a column struct<tokens, p, rate, copies>, that column's name, and the solution.

    The membership is stored beside the row, so no row number or join is needed to bring both together.
    """
    name, scratch = unused(docs, "_mix"), Scratch(docs.sparkSession, "mixing")
    model, learned = learn_domains(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")), labels, sample_rows, scratch)
    rows = scratch.keep(docs.withColumn(name, membership(model, learned, F.col("text").cast("string"))))
    found = solve(rows.select(f"{name}.tokens", f"{name}.p"), targets, supply, steps)
    duals = tuple(found.steps)

    @F.pandas_udf("double")
    def rate(tokens: pd.Series, p: pd.Series) -> pd.Series:
        r = rates(np.stack(p.to_numpy()), duals) if len(p) else np.zeros(0)
        return pd.Series(np.where(tokens.to_numpy() > 0, r, 1.0), dtype=float)

    chance = F.pmod(F.xxhash64("doc_id", "text", F.lit("copies")), F.lit(1_000_000)) / 1_000_000
    out = rows.withColumn(name, F.struct(f"{name}.tokens", f"{name}.p", rate(F.col(f"{name}.tokens"), F.col(f"{name}.p")).alias("rate"), chance.alias("chance")))
    return out.withColumn(name, F.col(name).withField("copies", F.floor(F.col(f"{name}.rate") + F.col(f"{name}.chance")).cast("int")).dropFields("chance")), name, found


def mixing_rates(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """(doc_id, tokens, p_<domain>, rate, copies, target_<domain>, reached_<domain>, converged) of each row of `docs` (doc_id, text)."""
    rows, m, found = rate_columns(docs.select("doc_id", "text"), labels, **options)
    shares = [F.col(f"{m}.p")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)]
    totals = [F.lit(float(x[k])).alias(f"{n}_{d}") for n, x in (("target", found.target), ("reached", found.reached)) for k, d in enumerate(DOMAINS)]
    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), f"{m}.tokens", *shares, f"{m}.rate", f"{m}.copies", *totals, F.lit(found.converged).alias("converged"))


def mix(docs: DataFrame, labels: DataFrame, supply: float | None = SUPPLY, **options) -> DataFrame:
    """`docs` with each row as often as its rate says."""
    rows, m, found = rate_columns(docs, labels, supply=supply, **options)
    if not found.converged:
        warnings.warn(f"mixing targets {found.target.tolist()} were not met: {found.reached.tolist()} after {len(found.steps)} steps", stacklevel=2)
    times = rows.where(F.col(f"{m}.copies") > 0).withColumn(m, F.explode(F.sequence(F.lit(1), F.col(f"{m}.copies"))))
    return times.drop(m)
