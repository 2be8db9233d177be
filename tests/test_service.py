from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from corpusloom.config import Settings
from corpusloom.operators.evaluate import mode_comparison
from corpusloom.operators.store import ChunkStore
from corpusloom.operators.vectors import HashingEmbedder
from corpusloom.plans import sample
from corpusloom.plans import service as S

PAGES = [
    ("nets", 1, "nets.pdf", "pdf", 1, "Neural networks learn layered features from examples."), ("nets", 1, "nets.pdf", "pdf", 2, "Training lowers a loss by gradient descent."),
    ("bonds", 2, "bonds.pdf", "pdf", 1, "Bond prices fall when market rates rise."), ("blank", 3, "blank.pdf", "pdf", 1, " \n "),
]
QUESTIONS = [(1, "How do neural networks learn features?", "nets"), (2, "bond prices and rates", "bonds"), (3, "zebra quagga", "other"), (4, " ", "other")]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    store = ChunkStore(spark, f"file://{tmp_path_factory.mktemp('store')}/s")
    pages = spark.createDataFrame(PAGES, "document_id string, doc_ord bigint, document_name string, source_type string, page_number int, content string")
    report = S.index_documents(pages, store, Settings(chunk_size=60, chunk_overlap=10), HashingEmbedder(128))
    assert {(r.document_id, r.n_pages, r.status) for r in report.collect()} == {("nets", 2, "ok"), ("bonds", 1, "ok"), ("blank", 1, "no_chunks")}
    return store.read()


def questions(spark):
    return spark.createDataFrame(QUESTIONS, "query_id int, query string, category string")


@pytest.mark.parametrize("mode", ["semantic", "keyword", "hybrid"])
@pytest.mark.parametrize("again", [False, True])
def test_answers(spark, stored, mode, again):
    settings = Settings(retrieval_mode=mode, reranker_enabled=again, retrieval_min_score=0.2)
    scorer = (lambda pairs: [float(len(set(q.lower().split()) & set(c.lower().split()))) for q, c in pairs]) if again else None
    got = {r.query_id: r for r in S.answer_questions(questions(spark), stored, settings, HashingEmbedder(128), scorer, top_k=2).collect()}
    assert got[1].status == "ok" and got[1].answer.startswith("Neural networks") and got[1].sources[0] == "nets#0#1"
    assert got[2].answer.startswith("Bond prices") and got[2].n_hits <= 2
    assert got[4].status == "invalid_query:empty"
    assert got[3].status == "insufficient_context"  # also in a fusion, whose dense side keeps the least score


def test_modes_side_by_side(spark, stored):
    expected = spark.createDataFrame([(1, "nets.pdf"), (2, "bonds.pdf")], "query_id int, document_name string")
    got = S.compare_modes(questions(spark), expected, stored, Settings(retrieval_min_score=0.2), HashingEmbedder(128), top_k=3)
    rows = {r["mode"]: r for r in got.collect()}
    assert set(rows) == set(S.MODES) and all(r.hit_rate == 1.0 for r in rows.values())
    over = {r["mode"]: r.overhead for r in mode_comparison(got, ["mrr"]).collect()}
    assert over["hybrid_rerank"] == pytest.approx(rows["hybrid_rerank"].mrr - rows["hybrid"].mrr) and over["keyword"] is None


def test_sample_questions_in_all_modes(spark):
    questions = sample.sample_questions(spark)
    assert questions.groupBy("category").count().count() == 5 and questions.count() == 12
    expected = questions.select("query_id", F.explode("expected").alias("document_name"))
    chunks = S.chunk_documents(sample.sample_pages(spark))
    got = {r["mode"]: r for r in S.compare_modes(questions, expected, chunks, Settings(retrieval_min_score=0.2), HashingEmbedder(256), top_k=3).collect()}
    assert set(got) == set(S.MODES) and all(r.n_queries == 12 and r.n_relevant == 9 for r in got.values())
    assert got["keyword"].hit_rate > 0.6


def test_files_to_answers(spark, tmp_path):
    """Everything that the settings name: folders, limits, recognition, batch sizes, the chat model."""
    from corpusloom.plans.queries import _Engine, _Reader

    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "nets.pdf").write_bytes(b"%PDFNeural networks learn features from examples.\f[scan 612 792]bonds fall when rates rise")
    (folder / "note.txt").write_bytes(b"x")
    (folder / "big.pdf").write_bytes(b"%PDF" + b"x" * (1 << 20))
    settings = Settings(max_upload_size_mb=1, vector_store_path=f"file://{tmp_path}/stores", collection="papers", embedding_batch_size=1, retrieval_min_score=0.0)
    pages, failures = S.load_files(spark, f"file://{folder}", settings, _Reader(), _Engine())
    assert {r.document_id.rsplit("/")[-1]: r.error_code for r in failures.collect()} == {"note.txt": "unsupported_format", "big.pdf": "file_too_large"}
    store = S.open_store(spark, settings)
    report = S.index_documents(pages, store, settings, HashingEmbedder(64)).collect()
    assert [(r.document_name, r.n_pages, r.status) for r in report] == [("nets.pdf", 2, "ok")]
    assert (tmp_path / "stores" / "papers").is_dir() and "read: bonds fall" in store.read().first().content and store.read().first().chunk_ord >= 0
    off = S.load_files(spark, f"file://{folder}", Settings(ocr_enabled=False), _Reader(), _Engine())[0].collect()
    assert "bonds" not in "".join(r.content for r in off if r.document_name == "nets.pdf")

    asked = []

    class Model(BaseHTTPRequestHandler):
        def do_POST(self):
            asked.append((self.path, json.loads(self.rfile.read(int(self.headers["Content-Length"])))))
            body = json.dumps({"message": {"content": " They learn. "}}).encode()
            self.send_response(200)
            self.send_header("Content-Length", str(len(body)))
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Model)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    own = Settings(llm_base_url=f"http://127.0.0.1:{server.server_port}/", llm_model="m", llm_max_tokens=7, retrieval_min_score=0.0)
    one = spark.createDataFrame([(1, "How do networks learn?")], "query_id int, query string")
    got = S.answer_questions(one, store.read(), own, HashingEmbedder(64), generator=S.chat_generator(own)).first()
    server.shutdown()
    assert (got.status, got.answer) == ("ok", "They learn.")
    path, body = asked[0]
    assert path == "/api/chat" and body["model"] == "m" and body["options"] == {"temperature": 0.1, "num_predict": 7} and not body["stream"] and [m["role"] for m in body["messages"]] == ["system", "user"]
