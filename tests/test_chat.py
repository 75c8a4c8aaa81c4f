"""The chat client against a service on this machine."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import pytest

from galley.operators import review_map
from galley.operators.review_map import CallError
from galley.plans import catalog, run
from galley.sources.chat import Chat, reply_text


@pytest.fixture
def service():
    """base, answers (status, headers, text) to give in turn, the last one again and again, and what was asked."""
    answers, asked = [], []

    class Handler(BaseHTTPRequestHandler):
        protocol_version = "HTTP/1.1"

        def do_POST(self):
            body = self.rfile.read(int(self.headers["Content-Length"]))
            asked.append((self.path, self.headers["Authorization"], json.loads(body), self.client_address))
            status, headers, text = answers.pop(0) if len(answers) > 1 else answers[0]
            data = text.encode()
            self.send_response(status)
            for k, v in (headers | {"Content-Length": str(len(data))}).items():
                self.send_header(k, v)
            self.end_headers()
            self.wfile.write(data)

        def log_message(self, *args):
            pass

    server = ThreadingHTTPServer(("127.0.0.1", 0), Handler)
    server.daemon_threads = True
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1/", answers, asked
    server.shutdown()


def said(text):
    return json.dumps({"choices": [{"message": {"content": text}}]}, ensure_ascii=False)


def test_request_and_reply(service, monkeypatch):
    base, answers, asked = service
    waits = []
    monkeypatch.setattr(review_map.retrying, "__defaults__", (*review_map.retrying.__defaults__[:2], waits.append))
    answers += [(503, {}, "busy"), (429, {"Retry-After": "2"}, ""), (200, {}, said("好")), (200, {}, said("two"))]
    chat = Chat(base, "k", "m", temperature=0.5)
    assert chat("sys", "问") == "好" and chat("sys", "b") == "two" and waits == [1, 2.0]
    path, auth, body, _ = asked[0]
    assert path == "/v1/chat/completions" and auth == "Bearer k" and "k'" not in repr(chat)
    assert body == {"model": "m", "messages": [{"role": "system", "content": "sys"}, {"role": "user", "content": "问"}], "temperature": 0.5}
    assert len({a[3] for a in asked}) == 1  # one connection for all calls


def test_refusals(service):
    base, answers, asked = service
    answers += [(401, {}, "who are you"), (200, {}, '{"choices": []}')]
    with pytest.raises(CallError, match="401: who are you"):
        Chat(base, "k", "m")("s", "u")
    with pytest.raises(CallError, match="without a choice"):
        Chat(base, "k", "m")("s", "u")
    with pytest.raises(CallError, match="no base and no key"):
        Chat("", "", "m")("s", "u")
    with pytest.raises(CallError, match="without a text"):
        reply_text(said(None))
    assert len(asked) == 2


def test_no_service():
    with pytest.raises(CallError, match="ConnectionRefusedError"):
        Chat("http://127.0.0.1:9", "k", "m", retries=0)("s", "u")


def test_run_over_the_service(spark, service, tmp_path):
    """Executors ask the service; the accumulator counts the chunks."""
    base, answers, asked = service
    item = {"original_text": "Two.", "issue_type": "t", "category": "normal", "confidence": "high", "suggestion": "x", "reason": "y"}
    answers.append((200, {"Connection": "close"}, said(json.dumps([item]))))
    spark.createDataFrame([(1, "One.\nTwo."), (2, "Three.")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seen = spark.sparkContext.accumulator(0)
    found = run.compute(catalog.blocks(spark, str(tmp_path)), Chat(base, "k", "m"), "rules", str(tmp_path / "run"), progress=seen)
    got = {(r["doc_id"], r["block_index"]) for r in found.collect()}
    assert got == {(1, 1), (2, None)} and seen.value == len(asked) == 2 and asked[0][2]["messages"][0]["content"] == "rules"
