"""The trained operators: held-out accuracy, and their parts against plain versions."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest
from helpers import ODD, documents, words
from pyspark.sql import functions as F

from corpusloom.llm import mixing as M
from corpusloom.llm.ann import Quantiser, ann_search, scan_codes
from corpusloom.llm.calibration import Isotonic, clear_labels
from corpusloom.llm.quality_classifier import NAMES, Fourier, quality_filter, quality_scores, statistics
from corpusloom.llm.toxicity import Trees, features, learn_lexicon, plain_words, toxicity_scores

LABELS = "doc_id bigint, quality int, toxic int"


def labelled(spark, n=400):
    rng = random.Random(3)
    texts, rows = [], []
    for i in range(n):
        w = words(rng, rng.randrange(20, 80))
        bad, toxic = i % 4 == 0, i % 5 == 0
        if bad:
            w = [x.upper() + "!!" if i % 8 else x + "###" for x in w]
        if toxic:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(["idiot", "scum", "gorblax", "frumpel"])
        texts.append(" ".join(w) + ".")
        rows.append((i, int(not bad), int(toxic)))
    return documents(spark, texts), spark.createDataFrame(rows, LABELS)


def held(doc_id: int, modulus: int) -> int:
    return zlib.crc32(str(doc_id).encode()) % modulus


def test_quality(spark):
    docs, labels = labelled(spark)
    got = quality_scores(docs, labels).collect()
    assert all(r.held_out == (held(r.doc_id, 3) == 1) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 4 > 0) for r in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    kept = quality_filter(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id % 4 > 0 for r in kept.collect()} == {True}
    assert kept.count() >= 290


def test_toxicity(spark):
    docs, labels = labelled(spark, 600)
    got = toxicity_scores(docs, labels).collect()
    assert all(r.held_out == (held(r.doc_id, 4) == 2) for r in got)
    out = [r for r in got if r.held_out]
    assert np.mean([r.predicted == (r.doc_id % 5 == 0) for r in out]) > 0.95


@pytest.mark.parametrize("scores", [quality_scores, toxicity_scores])
def test_odd_rows(spark, scores):
    docs = documents(spark, ODD, [None, *range(len(ODD) - 1)])
    one = spark.createDataFrame([(3, 1, 1), (3, 0, 0), (None, 1, 1), (4, None, None), (5, 1, 0)], LABELS)
    for labels in (one.limit(0), one):
        got = scores(docs, labels).collect()
        assert len(got) == len(ODD) and all(0 <= r.score <= 1 for r in got)
        assert {r.held_out for r in got if r.doc_id is None} == {False}
    assert scores(docs.limit(0), one).count() == 0
    assert clear_labels(one, "quality").count() == 1


def test_held_out_labels_are_not_learned_from(spark):
    docs, labels = labelled(spark, 120)
    flipped = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = ({r.doc_id: r.score for r in quality_scores(docs, x).collect()} for x in (labels, flipped))
    assert a == pytest.approx(b)


def test_isotonic():
    rng = np.random.default_rng(1)
    x, y, w = rng.normal(size=300), rng.integers(0, 2, 300).astype(float), rng.integers(1, 4, 300).astype(float)
    f = Isotonic(x, y, w)
    assert (np.diff(f.p) > 0).all() and (np.diff(f(np.linspace(-4, 4, 500))) >= 0).all()
    assert (f.p * 0 + 1).sum() < 300 and Isotonic(np.zeros(0), np.zeros(0), np.zeros(0))(np.zeros(1))[0] == pytest.approx(0.5)


def test_fourier_features_approximate_the_kernel():
    x = np.random.default_rng(2).normal(size=(200, len(NAMES)))
    f = Fourier(x, 20_000)
    phi = f(x[:20])[:, :-1]
    z = f.scaled(x[:20])
    width = 1 / np.linalg.norm(f.w, axis=1).mean() * np.sqrt(f.w.shape[1])
    kernel = np.exp(-((z[:, None] - z[None]) ** 2).sum(-1) / (2 * width**2))
    assert np.abs(phi @ phi.T - kernel).max() < 0.05


def test_trees_learn_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 3, (2000, 4)).astype(float)
    y = ((x[:, 0] > 0) & (x[:, 2] == 2)).astype(float)
    t = Trees(x[:1500], y[:1500])
    assert ((t(x[1500:]) > 0) == (y[1500:] > 0)).all()
    assert np.isfinite(Trees(np.zeros((0, 4)), np.zeros(0))(x[:2])).all()


def test_features_of_texts():
    f = features("You are an IDIOT!! truly 1d10t i.d.i.o.t", {}, frozenset([b"idiot"]))
    assert f[1] == 1 and f[8] == 1 and f[16] + f[17] >= 1
    assert statistics(None) == statistics(" \n") == [0.0] * len(NAMES)


def exact(x, ids, q, k):
    s = x @ x[q]
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != ids[q]]
    return [ids[i] for i in order[:k]]


def test_ann(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 17))
    ids = np.arange(600) * 3
    rows = [(int(i), v.tolist(), "x") for i, v in zip(ids, x, strict=True)]
    odd = [(1801, None, ""), (1803, [0.0] * 17, ""), (1805, [float("nan")] * 17, ""), (1807, [1.0] * 16, ""), (1809, [None] + [1.0] * 16, ""), (1811, [float("inf")] + [1.0] * 16, ""), (None, [1.0] * 17, "")]
    df = spark.createDataFrame(rows + odd + rows[:5], "vec_id bigint, embedding array<float>, score string")
    got = ann_search(df, F.col("vec_id") % 20 == 0, keep=100).collect()
    single = x.astype(np.float32).astype(float)
    hit = total = 0
    for q in np.flatnonzero(ids % 20 == 0):
        mine = sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and ids[q] not in [r.vec_id for r in mine]
        assert [r.score for r in mine] == pytest.approx([float(single[r.vec_id // 3] @ single[q]) for r in mine], rel=1e-12)
        assert mine == sorted(mine, key=lambda r: (-r.score, r.vec_id))
        hit += len({r.vec_id for r in mine} & set(exact(single, ids, q, 20)))
        total += 20
    assert hit / total > 0.95
    assert not {r.vec_id for r in got} & {r[0] for r in odd}


def test_ann_ties_and_few_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "vec_id bigint, embedding array<double>")
    got = ann_search(df, F.col("vec_id") == 40, keep=25).orderBy("rank").collect()
    assert [r.vec_id for r in got] == list(range(20)) and {r.score for r in got} == {5.0}
    few = ann_search(df.limit(3), F.col("vec_id") == 0).collect()
    assert sorted(r.vec_id for r in few) == [1, 2]
    assert ann_search(df.limit(0), F.col("vec_id") == 0).count() == 0


def test_scan_is_the_table_sum():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 8))
    q = Quantiser(x)
    codes = q.encode(x)
    decoded = q.words[np.arange(q.pairs)[None], codes].reshape(400, -1)
    got = scan_codes(q.tables(x[:3]), q.packed(x), np.arange(400), np.arange(3), 10)
    for k in range(3):
        s = decoded @ x[k]
        s[k] = -np.inf
        assert set(got[1][got[0] == k]) == set(np.argsort(-s)[:10])
    plain = Quantiser(x, parallel=1.0)
    along = lambda z: (((x - z.words[np.arange(z.pairs)[None], z.encode(x)].reshape(400, -1)) * x).sum(axis=1) ** 2).mean()
    assert along(q) < along(plain)


def test_ann_in_groups_blocks_and_passes(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>").repartition(4)
    some = dict(keep=40, block_rows=64, scan_blocks=4, query_rows=16)
    first = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann_search(df, F.col("vec_id") % 20 == 0, **some).collect()}
    assert len(first) == 150 * 20
    hit = sum(len({first[q, r][0] for r in range(1, 21)} & set(exact(x, np.arange(3000), q, 20))) for q in range(0, 3000, 20))
    assert hit / (150 * 20) > 0.97
    passes = {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann_search(df, F.col("vec_id") % 20 == 0, pass_bytes=16 * 8 * 40, **some).collect()}
    assert passes == first


def test_ann_scales_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(300, 8))
    want = [exact(x, np.arange(300), q, 20) for q in (0, 100, 200)]
    for scale in (1e-120, 1e120):
        df = spark.createDataFrame([(i, (v * scale).tolist()) for i, v in enumerate(x)], "vec_id bigint, embedding array<double>")
        got = ann_search(df, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
        assert [[r.vec_id for r in got if r.query_id == q] for q in (0, 100, 200)] == want
    rows = [(0, [1.0, 0.0]), (1, [1.0, 5.0]), (1, [3.0, -5.0]), (1, [1.0, 5.0]), (2, [2.0, 0.0])]
    got = ann_search(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>"), F.col("vec_id") == 0).orderBy("rank").collect()
    assert [(r.vec_id, r.score) for r in got] == [(1, 3.0), (2, 2.0)]


def test_quality_by_one_machine(spark):
    docs, labels = labelled(spark, 300)
    got = {r.doc_id: r.score for r in quality_scores(docs, labels).collect()}
    parts = F.crc32(F.col("doc_id").cast("string")) % 3, F.pmod(F.xxhash64(F.col("doc_id"), F.lit("calibration")), F.lit(5))
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "quality", parts[0].alias("fold"), parts[1].alias("part")).collect()
    train = [r for r in rows if r.fold != 1]
    x, y = np.array([statistics(r.text) for r in train]), np.array([float(r.quality) for r in train])
    aside = np.array([r.part == 0 for r in train])
    f = Fourier(x)
    phi = f(x[~aside])
    w = np.linalg.solve(phi.T @ phi + (1e-3 * (~aside).sum() / phi.shape[1] + 1e-9) * np.eye(phi.shape[1]), phi.T @ y[~aside])
    raw = f(x[aside]) @ w
    place = np.clip((raw + 0.5) / 2 * 2000, 0, 1999).astype(int)
    cells = {b: place == b for b in sorted(set(place))}
    isotonic = Isotonic(np.array([raw[m].mean() for m in cells.values()]), np.array([y[aside][m].mean() for m in cells.values()]), np.array([m.sum() for m in cells.values()], float))
    every = docs.collect()
    want = isotonic(f(np.array([statistics(r.text) for r in every])) @ w)
    assert [got[r.doc_id] for r in every] == pytest.approx(want.tolist(), abs=1e-6)


def test_lexicon_and_first_split_by_brute_force(spark):
    docs, labels = labelled(spark, 300)
    rows = docs.join(labels, "doc_id").select("text", F.col("toxic").cast("double").alias("y"))
    counts = ({}, {})
    n = [0, 0]
    for r in rows.collect():
        n[int(r.y)] += 1
        for w in set(plain_words(r.text.encode())):
            counts[int(r.y)][w] = counts[int(r.y)].get(w, 0) + 1
    odds = {w: np.log((t + 0.1) / (n[1] + 1)) - np.log((counts[0].get(w, 0) + 0.5) / (n[0] + 1)) for w, t in counts[1].items() if t >= 3}
    want = {w: v for w, v in odds.items() if v >= 2}
    assert len(odds) < 1000 and learn_lexicon(rows) == pytest.approx(want)

    rng = np.random.default_rng(8)
    x = rng.integers(0, 6, (200, 3)).astype(float)
    y = ((x[:, 1] > 2) ^ (rng.random(200) < 0.2)).astype(float)
    p = y.mean()
    g, h = y - p, np.full(200, p * (1 - p))

    def gain(k, c):
        left = x[:, k] <= c
        if min(left.sum(), (~left).sum()) < 5:
            return 0.0
        return g[left].sum() ** 2 / (h[left].sum() + 1) + g[~left].sum() ** 2 / (h[~left].sum() + 1) - g.sum() ** 2 / (h.sum() + 1)

    t = Trees(x, y, rounds=1, depth=1)
    feature, cut, leaf = t.trees[0]
    best = max(((gain(k, c), -k, -c) for k in range(3) for c in range(6)))
    assert (feature[0], t.cuts[feature[0]][cut[0]]) == (-best[1], -best[2])
    left = x[:, feature[0]] <= -best[2]
    assert leaf.tolist() == pytest.approx([0.15 * g[m].sum() / (h[m].sum() + 1) for m in (left, ~left)])


def descent(tokens, p, target, steps):
    """Projected gradient descent in one piece."""
    r, k = np.ones(len(p)), p.shape[1]
    scale = np.linalg.pinv(p.T @ (p * tokens[:, None]) + 1e-6 * tokens.sum() / k * np.eye(k))
    for _ in range(steps):
        reached = (r * tokens) @ p
        if (np.abs(target - reached) <= M.CLOSE * target).all():
            break
        r = np.maximum(0, r + p @ (scale @ (target - reached)))
    return r


def test_mixing_meets_its_targets(spark):
    docs, labels = labelled(spark, 600)
    share = np.array(M.TARGETS)
    for supply in (None, M.SUPPLY):
        got = M.mixing_rates(docs, labels, supply=supply).toPandas()
        p = got[[f"p_{d}" for d in M.DOMAINS]].to_numpy()
        have, reached = got.tokens.to_numpy() @ p, (got.tokens * got.rate).to_numpy() @ p
        target = share * have.sum() if supply is None else np.minimum(share / share[0] * supply * have[0], supply * have)
        assert reached == pytest.approx(target, rel=0.002) and got.converged.all()
        assert [got[f"target_{d}"][0] for d in M.DOMAINS] == pytest.approx(target) and [got[f"reached_{d}"][0] for d in M.DOMAINS] == pytest.approx(reached)
        assert got.rate.to_numpy() == pytest.approx(descent(got.tokens.to_numpy(), p, target, M.STEPS), rel=1e-6)
        assert (got.rate >= 0).all() and (got.copies >= np.floor(got.rate)).all() and (got.copies <= np.ceil(got.rate)).all()
    sound = got[(got.doc_id % 4 > 0) & (got.doc_id % 5 > 0)]
    assert (sound.copies >= 1).mean() > 0.97
    mixed = M.mix(docs, labels)
    assert mixed.columns == docs.columns
    assert dict(mixed.groupBy("doc_id").count().collect()) == {i: c for i, c in zip(got.doc_id, got.copies, strict=True) if c}


def test_mixing_says_when_targets_are_not_met(spark):
    docs, labels = labelled(spark, 80)
    got = M.mixing_rates(docs, labels, targets=(0.1, 0.1, 0.8), steps=0).first()
    assert not got.converged and got.reached_toxic != pytest.approx(got.target_toxic, rel=0.01)
    with pytest.warns(UserWarning, match="not met"):
        M.mix(docs, labels, targets=(0.1, 0.1, 0.8), steps=0)


def test_mixing_odd_rows(spark):
    docs = documents(spark, ODD, [None, *range(len(ODD) - 1)])
    labels = spark.createDataFrame([(3, 1, 0)], LABELS)
    for known in (labels.limit(0), labels):
        got = M.mixing_rates(docs, known).collect()
        assert len(got) == len(ODD) and all(r.rate == 1.0 and r.copies >= 1 for r in got if not r.tokens)
    assert M.mix(docs.limit(0), labels).count() == 0
