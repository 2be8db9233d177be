from __future__ import annotations

import math
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from helpers import ODD, documents, words

from corpusloom.llm import deleted_interpolation as L


def expected(texts, ids, weights):
    toks = [[*(t or "").encode().lower().split(), None] for t in texts]
    out = [i is not None and zlib.crc32(str(i).encode()) % 5 == 1 for i in ids]
    train = [t for t, o in zip(toks, out, strict=True) if not o]
    one = Counter(w for t in train for w in t)
    two = Counter(p for t in train for p in zip(["start"], t[:1])) + Counter(p for t in train for p in zip(t, t[1:]))
    n, v = sum(one.values()), len(one)
    rows = []
    for i, t, o in zip(ids, toks, out, strict=True):
        base = score = 0.0
        for h, w in zip(["start", *t], t):
            c = len(train) if h == "start" else one[h]
            l2, l1, l0 = weights[min(L.BUCKETS - 1, c.bit_length())]
            p = l2 * (two[h, w] / c if c else 0) + l1 * (one[w] / n if n else 0) + l0 / (v + 1)
            base += math.log10((one[w] + 0.5) / (n + 0.5 * (v + 1)))
            score += math.log10(p)
        rows.append((i, o, len(t), sum(one[w] > 0 for w in t), n, base, score))
    return rows


@pytest.mark.parametrize("block, shard", [(100, 50), (10**6, 10**6)])
def test_scores_by_brute_force(spark, monkeypatch, block, shard):
    held = {}

    def learn(*a, f=L.learn_weights):
        held["w"] = f(*a)
        return held["w"]

    monkeypatch.setattr(L, "learn_weights", learn)
    rng = random.Random(1)
    texts = [t for t in ODD if t is None or len(t) < 1000] + [" ".join(words(rng, rng.randrange(1, 60), 80)) for _ in range(60)]
    ids = [None, *range(10, 8 + len(texts)), 11]
    got = L.lm_scores(documents(spark, texts, ids), block_tokens=block, shard_grams=shard).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[6], 6))
    for a, b in zip(sorted(map(tuple, got), key=key), sorted(expected(texts, ids, held["w"]), key=key), strict=True):
        assert a[:5] == b[:5] and a[5:] == pytest.approx(b[5:])


def test_no_training_text(spark):
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = L.lm_scores(documents(spark, ["a b"], [only])).first()
    assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score) == (True, 3, 0, 0, 0.0) and math.isfinite(r.score)
    assert L.lm_scores(documents(spark, ["a"]).limit(0)).count() == 0


def test_expectation_maximisation_climbs():
    rng = np.random.default_rng(0)
    e = pd.DataFrame({"bucket": 3, "cell": range(200), "n": rng.integers(1, 9, 200).astype(float)})
    e["p2"], e["p1"] = e["n"] * rng.random(200) * (rng.random(200) > 0.5), e["n"] * rng.random(200)
    p = np.stack([e.p2 / e.n, e.p1 / e.n, np.full(200, 1 / 51)], axis=1)
    best = L.learn_weights(e, 50)[3]
    assert best.sum() == pytest.approx(1)
    value = lambda w: (e.n * np.log(p @ w)).sum()
    for _ in range(50):
        other = np.clip(best + rng.normal(size=3) * 0.02, 1e-9, 1)
        assert value(other / other.sum()) <= value(best) + 1e-6


def test_arrays_survive_packing():
    for a in (np.array([], np.uint64), np.array([0, 2**64 - 1, 5], np.uint64), np.arange(1000, dtype=np.uint32), np.arange(-5, 5, dtype=np.int32)):
        if len(a):
            assert (L.spread(L.squeeze(a), a.dtype.type) == a).all()
