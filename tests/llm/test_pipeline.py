from __future__ import annotations

import random
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from helpers import ODD, words
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline as P
from corpusloom.llm.calibration import Isotonic
from corpusloom.llm.mixing import DOMAINS, SUPPLY, mixing_rates
from corpusloom.llm.packing import tokenizer
from corpusloom.llm.quality_classifier import Fourier, statistics

DATA = "/root/testdata/sf0.001"


def test_stages_in_order():
    assert [k for k, _ in P.STAGES] == ["quality_classifier", "simhash_near_dedup", "substring_dedup", "mixing", "packing"]
    assert "pipeline" in __spark_entry__.queries() and {f"op{n}" for n in range(1, 11)} == {k.split("_")[0] for k in __spark_entry__.queries() if k.startswith("op")}


def write(spark, at, rng):
    passage = " ".join(words(rng, 70, 5000))
    texts, labels = [], []
    for i in range(160):
        w = " ".join(words(rng, 90, 5000))
        texts.append(w.upper().replace(" ", "!! ") if i % 4 == 0 else w + "\n" + passage if i % 10 == 3 else w)
        labels.append((i, int(i % 4 > 0), 0))
    texts[7] = texts[5]
    texts[9] = texts[5] + " end"
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    return passage


def test_decisions_take_effect(spark, tmp_path):
    passage = write(spark, tmp_path, random.Random(1))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = {}
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = {r.doc_id: r for r in docs.collect()}
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert all(i % 4 for i in seen["quality_classifier"])
    assert set(seen["quality_classifier"]) - set(seen["simhash_near_dedup"]) == {7, 9}
    holders = [i for i, r in seen["substring_dedup"].items() if passage in r.text]
    assert holders == [min(i for i, r in seen["simhash_near_dedup"].items() if passage in r.text)]
    assert set(seen["packing"]) == set(seen["mixing"])
    final = P.run(spark, str(tmp_path))
    assert set(final.columns) >= {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"}
    assert {r.doc_id for r in final.collect()} == set(seen["packing"])


def near_copies_gone(texts):
    """Ids that stay of {id: text}: the smallest of each component of pairs of similarity 0.8."""
    grams = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
    root = {i: i for i in texts}
    for a in grams:
        for b in grams:
            if a < b and len(grams[a] & grams[b]) >= 0.8 * len(grams[a] | grams[b]):
                x, y = root[a], root[b]
                root = {i: min(x, y) if r in (x, y) else r for i, r in root.items()}
    return {i for i, r in root.items() if i == r}


def passages_cut(texts, window=50):
    """Words left of {id: text}, without windows that a smaller id has too."""
    first, out = {}, {}
    for i in sorted(texts):
        w = texts[i].split()
        gone = [False] * len(w)
        for k in range(len(w) - window + 1):
            if first.setdefault(tuple(w[k : k + window]), i) < i:
                gone[k : k + window] = [True] * window
        out[i] = [x for x, g in zip(w, gone, strict=True) if not g]
    return {i: w for i, w in out.items() if w}


def test_all_rows_by_brute_force(spark, tmp_path):
    """run()'s rows against plain versions of all stages in turn; the trained ones fit the library's models on one machine."""
    write(spark, tmp_path, random.Random(2))
    docs, labels = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    part = {r.doc_id: r.p for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", F.lit("calibration")), F.lit(5)).alias("p")).collect()}
    x = {i: np.array(statistics(t)) for i, t in texts.items()}
    fourier = Fourier(np.stack(list(x.values())))
    train = [i for i in texts if part[i]]
    phi = fourier(np.stack([x[i] for i in train]))
    n, d = phi.shape
    w = np.linalg.solve(phi.T @ phi + (1e-3 * n / d + 1e-9) * np.eye(d), phi.T @ np.array([quality[i] for i in train], float))
    aside = [i for i in texts if not part[i]]
    raw = fourier(np.stack([x[i] for i in aside])) @ w
    bins = np.clip((raw + 0.5) / 2 * 2000, 0, 1999).astype(int)
    y = np.array([quality[i] for i in aside], float)
    cells = [bins == b for b in np.unique(bins)]
    score = Isotonic(np.array([raw[m].mean() for m in cells]), np.array([y[m].mean() for m in cells]), np.array([m.sum() for m in cells], float))
    texts = {i: t for i, t in texts.items() if score(fourier(x[i][None]) @ w)[0] >= 0.5}
    stay = near_copies_gone(texts)
    left = passages_cut({i: t for i, t in texts.items() if i in stay})

    # the rounding hash is of the text with its white space, so copies are read from the stage
    stages = dict(P.STAGES)
    cut = docs
    for name in ("quality_classifier", "simhash_near_dedup", "substring_dedup"):
        cut = stages[name](spark, cut, str(tmp_path))
        cut.write.parquet(f"{tmp_path}/{name}")
        cut = spark.read.parquet(f"{tmp_path}/{name}")
    assert {r.doc_id: r.text.split() for r in cut.collect()} == left
    rates = {r.doc_id: r for r in mixing_rates(cut, labels, supply=SUPPLY).collect()}
    p = np.array([[rates[i][f"p_{k}"] for k in DOMAINS] for i in left])
    tokens, target = np.array([len(v) for v in left.values()], float), np.array([rates[min(left)][f"target_{k}"] for k in DOMAINS])
    r, scale = np.ones(len(p)), np.linalg.pinv(p.T @ (p * tokens[:, None]) + 1e-6 * tokens.sum() / 3 * np.eye(3))
    for _ in range(20):
        reached = (r * tokens) @ p
        if (np.abs(target - reached) <= 1e-3 * target).all():
            break
        r = np.maximum(0, r + p @ (scale @ (target - reached)))
    assert [rates[i].rate for i in left] == pytest.approx(r.tolist(), rel=1e-6)
    copies = {i: rates[i].copies for i in left}
    assert all(np.floor(a) <= copies[i] <= np.ceil(a) for i, a in zip(left, r, strict=True))

    whole = tokenizer(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, words_left in left.items():
        ids = [*whole.encode(" ".join(words_left), add_special_tokens=False).ids, 1]
        for s in range(0, len(ids), 2048):
            piece = ids[s : s + 2048]
            want[i, s, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids)] += copies[i]
    rows = P.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in rows) == +want
    sequences = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        pieces.sort()
        assert [o for o, _ in pieces] == [sum(n for _, n in pieces[:k]) for k in range(len(pieces))] and sum(n for _, n in pieces) <= 2048


@pytest.mark.parametrize("empty", [True, False])
def test_odd_rows_and_empty_tables(spark, tmp_path, empty):
    rows = [] if empty else [(None if k % 3 == 0 else k // 2, t, None, "s", None if t is None else len(t)) for k, t in enumerate([*ODD, *ODD])]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(f"{tmp_path}/documents.parquet")
    known = [] if empty else [(1, 1, 0), (1, 0, 1), (2, 1, 0), (None, 1, 1), (4, None, 0), (5, 1, 1)]
    spark.createDataFrame(known, "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in P.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/{name}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        assert name == "packing" or docs.columns == before.columns
    assert (docs.count() == 0) == empty and P.run(spark, str(tmp_path)).count() == docs.count()


def test_stages_leave_no_tables_behind(spark, tmp_path):
    write(spark, tmp_path, random.Random(1))
    shared = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = {p.name for p in shared.iterdir()}
    P.run(spark, str(tmp_path)).count()
    made = {p.name for p in shared.iterdir()} - before
    assert len(made) == 1 and len([p for p in (shared / made.pop()).iterdir() if p.is_dir()]) == 1


@pytest.mark.skipif(not Path(DATA).is_dir(), reason="the harness's tables are not here")
def test_whole_tables(spark):
    assert P.run(spark, DATA).count() > 0
