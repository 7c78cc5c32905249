import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest
from test_flows import PAPER, write

from quire.__main__ import factory, run
from quire.functions import models, prompts, remote
from quire.functions.remote import chat_factory
from quire.settings import DEFAULTS, Settings, merged


def test_settings():
    own = Settings.of_json('{"a": {"b": 1}, "paths": {"x": "d/e", "y": "/abs", "z": "s3://k/v"}}', "/base")
    assert own.get("a.b") == 1 and own.get("a.b.c", 7) == 7 and own.get("q") is None
    assert [own.path(f"paths.{n}") for n in "xyzw"] == ["/base/d/e", "/abs", "s3://k/v", None]
    assert Settings().headers()[1] == ("##", "Header 2")
    assert Settings({"chunking": {"headers": [["=", "A"], ["==", "B"]]}}).headers() == [("=", "A"), ("==", "B")]
    assert merged({"a": {"b": 1, "c": 2}, "d": [1]}, {"a": {"c": 3}, "d": [2]}) == {"a": {"b": 1, "c": 3}, "d": [2]}


def test_models_come_from_the_settings():
    own = Settings(merged(DEFAULTS, {"chat": {"base_url": "http://x", "model": "m"}, "generation": {"temperature": 0.5}}))
    client = factory("generator", None, own, "generation")()
    assert (client.base_url, client.model, client.temperature, client.max_tokens, client.attempts) == ("http://x", "m", 0.5, 8192, 3)
    assert factory("extractor", None, own, "extraction")().max_tokens == 16384
    assert isinstance(factory("extractor", None, Settings(), "extraction")(), models.RuleExtractor)


def test_all_commands(spark, tmp_path):
    data = tmp_path / "md"
    data.mkdir()
    write(data, one=PAPER.format(title="One", m="CNN"), two=PAPER.format(title="Two", m="LSTM"))
    (tmp_path / "short.json").write_text(json.dumps({"cnn": "Convolutional Network"}))
    store = ["--store", f"file://{tmp_path}/store"]

    def say(*more):
        return list(run(spark, [*store, *more]))

    assert say("graph") == ["no extractions: run extract first"]
    assert say("index", "--data", str(data)) == ["version 1"] and say("index", "--data", str(data)) == ["nothing changed"]
    with pytest.raises(SystemExit):
        say("index", "--data", str(data), "--limit", "1")  # would delete the chunks of all other files
    assert say("extract", "--data", str(data), "--limit", "1") == ["1 of 1 papers", "version 1"]
    assert say("extract", "--data", str(data)) == ["1 of 1 papers", "version 2"]
    lines = say("graph", "--abbreviations", str(tmp_path / "short.json"))
    assert "Paper: 2" in lines and lines[1] == "taken in: 2 papers, 5 entities, 2 chunks, 6 mentions, 4 relations, 2 results"
    assert say("retrieve", "CNN One", "-k", "1", "--hops", "1")[0] == "1 by vector, 1 by graph, 2 merged"
    answer = say("answer", "CNN One", "--top-n", "2", "--points")
    assert answer[0].startswith("[1] source: ") and len(answer) == 3
    assert say("ask", "Two")[0].startswith("# ")
    assert [x.split(" ")[0] for x in say("dump")] == ["one.md::0", "two.md::0"]
    say("dump", "--to", str(tmp_path / "dump"))
    assert sorted(r.chunk_id for r in spark.read.json(str(tmp_path / "dump")).collect()) == ["one.md::0", "two.md::0"]


@pytest.fixture
def service():
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, self.headers["Authorization"], body))
            text = '{"entities": [], "relations": []}' if "response_format" in body else "hello"
            reply = json.dumps({"choices": [{"message": {"content": text}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(reply)

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{server.server_port}/v1", asked
    server.shutdown()


def test_chat_client(service, monkeypatch):
    url, asked = service
    client = chat_factory(url, "m", "OWN_KEY", 0.0, 99)()
    with pytest.raises(RuntimeError, match="OWN_KEY"):
        client.generate("x")
    monkeypatch.setenv("OWN_KEY", "secret")
    assert client.generate("x") == "hello" and json.loads(client.extract("body", "T"))["entities"] == []
    path, key, body = asked[1]
    assert path == "/v1/chat/completions" and key == "Bearer secret" and body["max_tokens"] == 99 and body["temperature"] == 0
    assert body["messages"][0]["content"] == prompts.fill(prompts.EXTRACTION, title="T", text="body")


def test_a_busy_service_is_asked_again(monkeypatch):
    asked = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            self.rfile.read(int(self.headers["Content-Length"]))
            asked.append(self.path)
            self.send_response(503 if len(asked) < 3 else 200 if len(asked) == 3 else 400)
            self.end_headers()
            self.wfile.write(json.dumps({"choices": [{"message": {"content": "late"}}]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    monkeypatch.setenv("OWN_KEY", "secret")
    monkeypatch.setattr(remote, "PAUSE", 0.01)
    client = chat_factory(f"http://127.0.0.1:{server.server_port}", "m", "OWN_KEY")()
    assert client.generate("x") == "late" and len(asked) == 3
    with pytest.raises(Exception, match="400"):
        client.generate("x")  # a wrong request is not repeated
    assert len(asked) == 4
    server.shutdown()
