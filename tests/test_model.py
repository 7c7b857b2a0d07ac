"""A model in the answer path: calls, retries, stored responses, the summary in its place."""

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from pyspark.sql import functions as F

from tabulora.operators import model, retrieve
from tabulora.plans import fixtures
from tabulora.sources import tables


@pytest.fixture
def case(spark):
    docs = spark.sql(fixtures.REPORTS)
    passages = spark.sql(fixtures.PASSAGES).join(docs.select("doc_id", "title", "company", "ticker", "source"), "doc_id")
    asked = spark.createDataFrame([(1, "招商银行 总资产"), (2, "600519 股票代码"), (3, "zzz qqq"), (4, "招商银行 总资产")], "query_id long, query string")
    hits = retrieve.retrieve(asked, passages, docs, top_k=3).join(passages, "chunk_id").withColumns({"doc_type": F.lit("pdf"), "published_at": F.lit(None).cast("string")})
    return asked, hits.localCheckpoint()


def stub(log, fail=""):
    def make():
        def call(messages):
            with open(log, "a") as f:
                f.write("x")
            text = messages[1]["content"]
            if fail and fail in text:
                raise RuntimeError("down")
            return "  " if "股票代码" in text else f" 答：{text[3:9]} "

        return call

    return make


def test_answers_of_a_model(spark, case, tmp_path):
    asked, hits = case
    log, stored = tmp_path / "log", tables.Table(spark, f"file://{tmp_path}/r", model.RESPONSES)
    got = {r.query_id: r for r in model.answers(asked, hits, stub(log), 3, stored, pause=0.01).collect()}
    assert got[1].answer == got[4].answer == "答：招商银行 总" and got[1].answer_mode == "llm" and got[1].citations
    assert got[2].answer_mode == "fallback_summary" and got[2].answer.startswith("结论：") and got[2].refusal_reason is None
    assert got[3].answer_mode == "refusal" and not got[3].guard_passed and got[3].citations is None
    assert len(log.read_text()) == 2  # equal prompts once, none for the refused one
    again = {r.query_id: r.answer for r in model.answers(asked, hits, stub(log), 3, stored).collect()}
    assert again == {k: r.answer for k, r in got.items()} and len(log.read_text()) == 2


def test_failing_model(spark, case, tmp_path):
    asked, hits = case
    log, stored = tmp_path / "log", tables.Table(spark, f"file://{tmp_path}/r", model.RESPONSES)
    got = {r.query_id: r for r in model.answers(asked, hits, stub(log, "招商银行 总资产"), 3, stored, attempts=2, pause=0.01).collect()}
    assert got[1].answer_mode == "fallback_summary" and got[1].error == "RuntimeError: down" and "总资产为" in got[1].answer
    assert len(log.read_text()) == 3 and stored.read().count() == 1
    assert model.answers(asked, hits, stub(log), 3, stored).where("answer_mode = 'llm'").count() == 2


def test_http_client():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": f"{body['model']} {body['messages'][0]['content']} {self.headers['Authorization']} {self.path}"}}]}).encode())

        def log_message(self, *a):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    client = model.http_client(f"http://127.0.0.1:{server.server_port}/v1/", "k", "m")()
    assert client([{"role": "user", "content": "hi"}]) == "m hi Bearer k /v1/chat/completions"
    server.shutdown()
    assert model.content_of({"choices": [{"message": {"content": [{"type": "text", "text": "a"}, {"type": "image"}, {"type": "text", "text": "b"}]}}]}) == "a\nb"
    for bad in ({}, {"choices": []}, {"choices": [{"message": {"content": 3}}]}):
        with pytest.raises(ValueError, match="the model returned"):
            model.content_of(bad)
