from __future__ import annotations

import random

import pytest

from corpusloom.operators import evaluate as E
from corpusloom.operators import store as S
from corpusloom.operators.store import ChunkStore

ROW = "chunk_id string, document_id string, document_name string, content string, chunk_index int"


def test_upsert(spark):
    old = spark.createDataFrame([("a", "d", "n", "old", 0), ("b", "d", "n", "old", 1)], ROW)
    new = spark.createDataFrame([("a", "d", "n", "first", 0), ("c", "d", "n", "new", 1), ("a", "d", "n", "last", 2)], ROW)
    got = {r.chunk_id: r.content for r in S.upsert(old, new, "chunk_index").collect()}
    assert got == {"a": "last", "b": "old", "c": "new"}


def test_store(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    assert store.count() == 0 and store.read() is None and store.delete("d") == 0
    store.index(spark.createDataFrame([("a", "d", "n", "x", 0), ("b", "d", "n", "y", 1), ("z", "e", None, None, 0)], ROW))
    store.index(spark.createDataFrame([("a", "d", "n", "again", 0)], ROW))
    assert sorted((r.chunk_id, r.content) for r in store.read().collect()) == [("a", "again"), ("z", None)]
    store.add(spark.createDataFrame([("z", "e", "m", "now", 0), ("q", "f", "m", "q", 0)], ROW))
    assert store.count() == 3 and store.version() == 3
    assert {(r.document_name, r.content, r.score) for r in S.scan(store.read()).collect()} >= {("m", "now", 0.0)}
    assert store.delete("e") == 1 and store.delete("missing") == 0 and store.count() == 2
    with pytest.raises(ValueError):
        store.delete(" ")
    store.reset()
    assert store.count() == 0


def test_store_survives_a_failed_write(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    store.index(spark.createDataFrame([("a", "d", "n", "x", 0)], ROW))
    with pytest.raises(Exception):
        store.publish(spark.range(1).selectExpr("raise_error('no')"))
    assert store.count() == 1


def test_store_merges_changes_in_any_order(spark, tmp_path):
    """Random changes against a plain dictionary, through compactions."""
    rng = random.Random(2)
    store = ChunkStore(spark, f"file://{tmp_path}/s", compact_after=4)
    want: dict[str, tuple] = {}
    for step in range(14):
        kind = rng.choice(["index", "add", "delete", "index"])
        docs = rng.sample("abcd", 2)
        if kind == "delete":
            n = sum(r[1] == docs[0] for r in want.values())
            assert store.delete(docs[0]) == n
            want = {k: r for k, r in want.items() if r[1] != docs[0]}
            continue
        rows = [(f"{d}#{i}", d, "n", f"{step}", i) for d in docs for i in range(rng.randrange(1, 4))]
        getattr(store, kind)(spark.createDataFrame(rows, ROW))
        if kind == "index":
            want = {k: r for k, r in want.items() if r[1] not in docs}
        want |= {r[0]: r for r in rows}
        if step % 4 == 3:
            assert sorted(tuple(r[c] for c in ("chunk_id", "document_id", "document_name", "content", "chunk_index")) for r in store.read().collect()) == sorted(want.values())
    assert len(store._commits()) <= 5
    assert sorted(r.chunk_id for r in store.read().collect()) == sorted(want)
    folders = [p for p in (tmp_path / "s").iterdir() if p.name.startswith("d-")]
    assert len(folders) <= 12


def test_writers_never_take_one_number(spark, tmp_path):
    stores = [ChunkStore(spark, f"file://{tmp_path}/s") for _ in range(2)]
    stores[0].index(spark.createDataFrame([("a", "d", "n", "x", 0)], ROW))
    late = stores[1]._write(spark.createDataFrame([("b", "e", "n", "y", 0)], ROW))
    version = stores[1].version
    stores[1].version = lambda: version() - 1  # as if the other writer came in between
    assert stores[1]._commit(kind="index", data=late) == 2
    assert sorted(r.chunk_id for r in stores[0].read().collect()) == ["a", "b"]


def test_change_during_a_compaction_is_kept(spark, tmp_path):
    store = ChunkStore(spark, f"file://{tmp_path}/s")
    store.index(spark.createDataFrame([("a", "d", "n", "x", 0)], ROW))
    store.index(spark.createDataFrame([("b", "e", "n", "y", 0)], ROW))
    live = store._write(store.read())
    store.index(spark.createDataFrame([("a", "d", "n", "late", 0)], ROW))  # commit 3, before the whole table's commit 4
    store._commit(kind="whole", data=live, upto=2)
    store.index(spark.createDataFrame([("c", "f", "n", "z", 0)], ROW))
    assert sorted((r.chunk_id, r.content) for r in store.read().collect()) == [("a", "late"), ("b", "y"), ("c", "z")]


def measures(spark, hits, expected, questions):
    return E.per_query(
        spark.createDataFrame(hits, "query_id int, rank int, document_name string"), spark.createDataFrame(expected, "query_id int, document_name string"), spark.createDataFrame(questions, "query_id int, category string")
    )


def test_measures(spark):
    hits = [(1, 1, "x"), (1, 2, "a"), (1, 3, "a"), (1, 4, "b"), (2, 1, "a")]
    m = measures(spark, hits, [(1, "a"), (1, "b"), (1, "c"), (4, "z")], [(1, "k"), (2, "k"), (3, "l"), (4, "l")])
    got = {r.query_id: tuple(r)[2:] for r in m.collect()}
    assert got == {1: (True, 4, 1.0, pytest.approx(2 / 3), 0.75, 0.5, False), 2: (False, 1, 0.0, 0.0, 0.0, 0.0, False), 3: (False, 0, 0.0, 0.0, 0.0, 0.0, True), 4: (True, 0, 0.0, 0.0, 0.0, 0.0, True)}
    s = E.summary(m).first()
    assert (s.n_queries, s.n_relevant, s.hit_rate, s.mrr, s.rejection_rate) == (4, 2, 0.5, 0.25, 0.5)
    assert {r.category: r.rejection_rate for r in E.by_category(m).collect()} == {"k": 0.0, "l": 1.0}
    empty = E.summary(m.limit(0)).first()
    assert (empty.hit_rate, empty.rejection_rate) == (0.0, 1.0)
    only = E.summary(m.where("relevant")).first()
    assert only.rejection_rate == 1.0


@pytest.mark.parametrize("n", [1, 2, 19, 20, 21, 100])
def test_percentiles(spark, n):
    values = [float((i * 37) % 50) for i in range(n)]
    got = E.percentiles(spark.createDataFrame([("g", v) for v in values] + [("g", None)], "g string, v double"), "v", ["g"]).first()
    s = sorted(values)
    assert got.n == n and got.median == (s[(n - 1) // 2] + s[n // 2]) / 2 and got.p95 == s[min(int(0.95 * n), n - 1)]


def test_recognition_errors(spark):
    rows = [("one", "a b c", ["a b c"]), ("two", "first page\n\n\n\nsecond page", ["first pag", "second page", "third"]), ("none", "x", []), ("null", None, [None, "y"])]
    got = {r.doc: r for r in E.recognition_errors(spark.createDataFrame(rows, "doc string, reference string, pages array<string>")).collect()}
    assert got["one"].cer == got["one"].wer == 0 and got["one"].page_cers is None and got["one"].n_pages == 1
    assert got["two"].page_cers == [0.1, 0.0, 1.0] and got["two"].wer == pytest.approx(2 / 4)
    assert got["none"].cer == 1.0 and got["null"].cer == 1.0 and got["null"].page_cers == [0.0, 1.0]


def test_comparison(spark):
    rows = spark.createDataFrame([("semantic", 0.5), ("semantic_rerank", 0.75), ("keyword", 0.25)], "mode string, mrr double")
    got = {r["mode"]: r.overhead for r in E.mode_comparison(rows, ["mrr"]).collect()}
    assert got == {"semantic": None, "semantic_rerank": 0.25, "keyword": None}
