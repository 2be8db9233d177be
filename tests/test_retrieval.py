from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.config import SettingsError
from corpusloom.errors import InvalidTopKError, RerankingError
from corpusloom.operators import bm25 as B
from corpusloom.operators import hybrid as H
from corpusloom.operators import rerank as R
from corpusloom.operators import vectors as V

TEXTS = ["Neural networks learn features", "Markets fell and bonds rose", "", "Deep networks learn deep features", "Neural networks learn features", "Quarterly revenue rose"]


def reference_scores(query: list[str], k1=1.5, b=0.75) -> list[float]:
    docs = [[w for w in t.lower().split() if w not in B.STOP_WORDS] for t in TEXTS]
    n, avg = len(docs), sum(map(len, docs)) / len(docs)
    df = Counter(w for d in docs for w in set(d))
    out = []
    for d in docs:
        tf = Counter(d)
        out.append(sum(math.log((n - df[w] + 0.5) / (df[w] + 0.5) + 1) * tf[w] * (k1 + 1) / (tf[w] + k1 * (1 - b + b * len(d) / avg)) for w in query if tf[w]))
    return out


@pytest.fixture
def chunks(spark):
    return spark.createDataFrame([(i, f"d{i}", t) for i, t in enumerate(TEXTS)], "chunk_ord bigint, document_id string, content string")


def asked(spark, *queries):
    return spark.createDataFrame(list(enumerate(queries)), "query_id int, query string")


def test_bm25(spark, chunks):
    index = B.build_index(chunks)
    assert index.corpus.first().n == len(TEXTS)
    got = B.search(index, asked(spark, "deep neural NETWORKS deep?", "the of", "unheard", None, "x" * 10_001), 3).collect()
    want = reference_scores(["deep", "neural", "networks", "deep"])
    order = sorted((i for i in range(len(TEXTS)) if want[i] > 0), key=lambda i: (-round(want[i], 9), i))[:3]
    assert [(r.query_id, r.rank, r.chunk_ord) for r in sorted(got, key=lambda r: r.rank)] == [(0, k + 1, i) for k, i in enumerate(order)]
    assert [r.score for r in sorted(got, key=lambda r: r.rank)] == pytest.approx([want[i] for i in order])


def test_stored_index(spark, chunks, tmp_path):
    index = B.build_index(chunks)
    B.save_index(index, f"file://{tmp_path}/i", 3)
    stored = B.load_index(spark, f"file://{tmp_path}/i")
    q = asked(spark, "deep networks", "bonds")
    assert sorted(map(str, B.search(stored, q).collect())) == sorted(map(str, B.search(index, q).collect()))


def test_bm25_limits(spark, chunks):
    index = B.build_index(chunks)
    best = B.search(index, asked(spark, "networks"), 1000).count()
    assert best == 3
    top = B.search(index, asked(spark, "networks"), 1).first()
    assert B.search(index, asked(spark, "networks"), 10, top.score + 1e-9).count() == 0
    assert B.search(index, asked(spark, "networks"), 10, top.score).count() >= 1
    for k in (0, True, 1001):
        with pytest.raises(InvalidTopKError):
            B.search(index, asked(spark, "networks"), k)
    assert B.build_index(B.without_document(chunks, "d0")).corpus.first().n == len(TEXTS) - 1
    empty = B.build_index(chunks.limit(0))
    assert tuple(empty.corpus.first()) == (0, 0.0) and B.search(empty, asked(spark, "networks")).count() == 0


def test_vectors(spark):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(50, 8))
    x[7] = x[3]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(50, [0.0] * 8), (51, None)]
    store = spark.createDataFrame(rows, "chunk_ord bigint, v array<double>").repartition(5)
    q = spark.createDataFrame([("a", x[3].tolist()), ("b", (-x[0]).tolist()), ("z", [0.0] * 8)], "query_id string, v array<double>")
    got = V.similar(q, store, 5).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for name, v in (("a", unit[3]), ("b", -unit[0])):
        s = unit @ v
        best = sorted(range(50), key=lambda i: (-round(s[i], 9), i))[:5]
        mine = sorted((r for r in got if r.query_id == name), key=lambda r: r.rank)
        assert [r.chunk_ord for r in mine] == best
        assert [r.score for r in mine] == pytest.approx([s[i] for i in best])
    assert not [r for r in got if r.query_id == "z"]
    assert all(r.score >= 0.9 for r in V.similar(q, store, 5, 0.9).collect())
    assert V.similar(q.limit(0), store, 5).count() == 0


def test_semantic_search(spark):
    e = V.HashingEmbedder(32)
    store = spark.createDataFrame(list(enumerate(TEXTS)), "chunk_ord bigint, t string").select("chunk_ord", V.embed(F.col("t"), e).alias("v"))
    got = V.semantic_search(asked(spark, "Neural networks learn features", " "), store, e, 2).collect()
    assert [(r.query_id, r.rank, r.chunk_ord) for r in got] == [(0, 1, 0), (0, 2, 4)] and got[0].score == pytest.approx(1)


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id int, rank int, chunk_id string, chunk_ord bigint")


def test_fusion(spark):
    left, right = hits(spark, [(1, 1, "a", 0), (1, 2, "b", 1)]), hits(spark, [(1, 1, "b", 1), (1, 2, "c", 2), (2, 1, "z", 9)])
    got = {(r.query_id, r.chunk_id): (r.rank, r.score) for r in H.fuse(left, right, (1.0, 0.5), 60, 10).collect()}
    assert got == {(1, "b"): (1, round(1 / 62 + 0.5 / 61, 8)), (1, "a"): (2, round(1 / 61, 8)), (1, "c"): (3, round(0.5 / 62, 8)), (2, "z"): (1, round(0.5 / 61, 8))}
    tie = H.fuse(hits(spark, [(1, 1, "y", 0)]), hits(spark, [(1, 1, "x", 1)])).orderBy("rank").collect()
    assert [r.chunk_id for r in tie] == ["x", "y"]
    assert {r.chunk_id for r in H.fuse(left, right, (0.0, 1.0)).collect()} == {"b", "c", "z"}
    with pytest.raises(SettingsError):
        H.fuse(left, right, (0.0, 0.0))


def test_rerank(spark):
    rows = [(1, "neural nets", 1, "a", "other words", 0.9), (1, "neural nets", 2, "b", "Neural nets!", 0.8), (1, "neural nets", 3, "b", "again", 0.7), (1, "neural nets", 4, "c", "nets", 0.6), (1, "neural nets", 5, "d", "nets", 0.5)]
    df = spark.createDataFrame(rows, "query_id int, query string, rank int, chunk_id string, content string, score double")
    got = R.rerank(df, 3).orderBy("rank").collect()
    assert [(r.chunk_id, r.reranker_score, r.retrieval_score) for r in got] == [("b", 1.0, 0.8), ("c", 0.5, 0.6), ("d", 0.5, 0.5)]
    by = R.rerank(df, 5, R.scored_by(lambda pairs: np.array([float(len(c)) for _, c in pairs]), F.col("query"), F.col("content"))).orderBy("rank").collect()
    assert [r.chunk_id for r in by] == ["b", "a", "c", "d"]
    with pytest.raises(Exception, match="not finite"):
        R.rerank(df, 5, R.scored_by(lambda pairs: [float("nan")] * len(pairs), F.col("query"), F.col("content"))).collect()
    assert issubclass(RerankingError, Exception)
