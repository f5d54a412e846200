import json
import pickle
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from docspark.operators import models
from docspark.operators.phrasing import NotConfigured, PhrasingError


@pytest.fixture
def server():
    """A server that answers with what `reply` holds and keeps what it was asked."""

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = self.rfile.read(int(self.headers["content-length"]))
            self.server.asked.append((self.path, {k.lower(): v for k, v in self.headers.items()}, json.loads(body)))
            status, reply = self.server.reply
            self.send_response(status)
            self.end_headers()
            self.wfile.write(reply if isinstance(reply, bytes) else json.dumps(reply).encode())

        def log_message(self, *args):
            pass

    out = HTTPServer(("127.0.0.1", 0), Handler)
    out.asked, out.url = [], f"http://127.0.0.1:{out.server_port}"
    threading.Thread(target=out.serve_forever, daemon=True).start()
    yield out
    out.shutdown()
    out.server_close()


def test_settings():
    assert models.configured({}) == {}
    one = models.configured({"ANTHROPIC_API_KEY": "k", "LLM_MODEL": "m", "LLM_TIMEOUT": "5"})
    assert list(one) == ["anthropic"] and (one["anthropic"].model, one["anthropic"].timeout) == ("m", 5.0)
    assert "k-secret" not in repr(models.MessagesClient("m", "u", "k-secret"))
    two = models.configured({"LLM_BASE_URL": "http://x/v1", "ANTHROPIC_API_KEY": "k"})
    assert models.config("auto", two) == {"mode": "anthropic", "model": models.MESSAGES_MODEL} and models.available(None, two)
    assert models.config("auto", {"openai": two["openai"]})["mode"] == "openai"
    assert not models.available("auto", {}) and models.config(None, {}) == {"mode": "local", "model": models.LOCAL_MODEL}
    shown = models.providers({"openai": two["openai"]})
    assert [(m, p["configured"]) for m, p in shown.items()] == [("local", True), ("anthropic", False), ("openai", True)]
    assert shown["openai"]["endpoint"] == "http://x/v1"
    with pytest.raises(NotConfigured) as error:
        models.config("openai", {})
    assert "LLM_API_KEY" in str(error.value) and error.value.mode == "openai"
    with pytest.raises(PhrasingError):
        models.config("other", {})


def test_messages(server):
    client = pickle.loads(pickle.dumps(models.MessagesClient("m", server.url, "secret", 5)))
    server.reply = 200, {"content": [{"type": "text", "text": " a"}, {"type": "other"}, {"type": "text", "text": "b "}]}
    talk = [{"role": "user", "content": "q"}]
    assert client.complete("s", talk) == "ab"
    path, headers, body = server.asked[0]
    assert path == "/v1/messages" and headers["x-api-key"] == "secret" and headers["anthropic-version"] == models.MESSAGES_VERSION
    assert body == {"model": "m", "max_tokens": 700, "temperature": 0, "system": "s", "messages": talk}
    client.for_summaries().complete("s", talk)
    assert server.asked[1][2]["max_tokens"] == 500


def test_chat(server):
    server.reply = 200, {"choices": [{"message": {"content": "yes"}}]}
    talk = [{"role": "user", "content": "q"}]
    assert models.ChatClient("m", server.url + "/v1/", "secret").complete("s", talk) == "yes"
    assert models.ChatClient("m", server.url + "/v1").complete("s", talk) == "yes"
    (path, headers, body), (_, without, _) = server.asked
    assert path == "/v1/chat/completions" and headers["authorization"] == "Bearer secret" and "authorization" not in without
    assert body["messages"] == [{"role": "system", "content": "s"}, *talk] and body["temperature"] == 0


@pytest.mark.parametrize(
    "status, reply, said",
    [(401, {}, "key"), (403, {}, "key"), (429, {}, "rate limit"), (500, {}, "500"), (200, b"no json", "unknown form"), (200, {}, "unknown form"), (200, [], "unknown form"), (200, {"choices": []}, "unknown form"), (200, {"choices": [{"message": {"content": None}}]}, "empty")],
)
def test_failures(server, status, reply, said):
    server.reply = status, reply
    with pytest.raises(PhrasingError) as error:
        models.ChatClient("m", server.url, timeout=5).complete("s", [])
    assert said in str(error.value)


def test_unreachable():
    with pytest.raises(PhrasingError) as error:
        models.ChatClient("m", "http://127.0.0.1:9", timeout=2).complete("s", [])
    assert "reached" in str(error.value)
