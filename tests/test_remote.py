"""Providers and remote datasets, against a server in this process: requests sent, answers read, pages fetched, errors."""

import json
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer
from urllib.parse import parse_qs, urlsplit

import pytest
from pyspark.sql import functions as F

from gaugeworks.operators import providers, sampling
from gaugeworks.plans import command
from gaugeworks.plans.store import Store
from gaugeworks.sources.config import Evaluation, Style
from gaugeworks.sources.datasets import DatasetError
from gaugeworks.sources.remote import RemoteCatalog

ROWS = [{"question": f"q{i}", "golden": "Paris" if i % 2 else "Rome", "row_index": -1} | ({"more": i} if i % 50 == 0 else {}) for i in range(230)]


class Served(BaseHTTPRequestHandler):
    """A dataset server and the four providers. What was asked for is kept in `seen`."""

    def log_message(self, *_):
        pass

    def _tell(self, body, status=200):
        raw = body.encode() if isinstance(body, str) else json.dumps(body).encode()
        self.send_response(status)
        self.send_header("Content-Length", str(len(raw)))
        self.end_headers()
        self.wfile.write(raw)

    def do_GET(self):
        at, q = urlsplit(self.path), {k: v[0] for k, v in parse_qs(urlsplit(self.path).query).items()}
        self.server.seen.append((at.path, q, self.headers.get("Authorization")))
        if q["dataset"] != "team/cities":
            return self._tell({"error": "no"}, 404)
        if at.path == "/splits":
            return self._tell({"splits": [{"config": "main", "split": s} for s in ("train", "validation", "short", "unknown")]})
        if at.path == "/size":
            return self._tell({"size": {"splits": [{"split": q["split"], "num_rows": None if q["split"] == "unknown" else len(ROWS)}]}})
        own = ROWS[: 150 if q["split"] == "short" else None]
        a = int(q["offset"])
        return self._tell({"rows": [{"row": r} for r in own[a : a + int(q["length"])]]})

    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        self.server.seen.append((self.path, body, {k.lower(): v for k, v in self.headers.items()}))
        text = json.dumps(body)
        if "overload" in text:
            return self._tell("overloaded" if "plain" in text else {"error": {"message": "too much"}}, 503)
        if "empty" in text:
            return self._tell({"result": {}})
        if self.path == "/v1/chat/completions":
            said = {"choices": [{"message": {"content": "Paris"}}], "usage": {"total_tokens": 7}}
        elif self.path == "/v1/messages":
            said = {"content": [{"type": "thinking"}, {"type": "text", "text": "Paris"}], "usage": {"input_tokens": 4, "output_tokens": 3}}
        elif self.path.startswith("/v1beta/"):
            said = {"candidates": [{"content": {"parts": [{"text": "Paris"}]}}], "usageMetadata": {"totalTokenCount": 7}}
        elif "long" in text:
            said = {"result": {"choices": [{"finish_reason": "length", "message": {"content": "Pa"}}]}}
        else:
            said = {"result": {"response": "Paris"}}
        return self._tell(said)


@pytest.fixture
def server():
    it = ThreadingHTTPServer(("127.0.0.1", 0), Served)
    it.seen = []
    threading.Thread(target=it.serve_forever, daemon=True).start()
    it.url = f"http://127.0.0.1:{it.server_port}"
    yield it
    it.shutdown()
    it.server_close()


@pytest.fixture(autouse=True)
def keys(monkeypatch):
    monkeypatch.setattr(sampling, "REGISTERED", {})
    for name in ("OPENAI_API_KEY", "ANTHROPIC_API_KEY", "GEMINI_API_KEY", "CLOUDFLARE_API_KEY"):
        monkeypatch.setenv(name, "k")


CONVERSATION = [{"role": "system", "content": "be brief"}, {"role": "user", "content": "where?"}, {"role": "assistant", "content": "here"}, {"role": "user", "content": "no"}]
TURNS = CONVERSATION[1:]
SENT = {
    "openai": ("/v1/chat/completions", ("authorization", "Bearer k"), {"model": "m", "messages": CONVERSATION}),
    "anthropic": ("/v1/messages", ("x-api-key", "k"), {"model": "m", "max_tokens": 4096, "system": "be brief", "messages": TURNS}),
    "gemini": ("/v1beta/models/m:generateContent", ("x-goog-api-key", "k"), {"contents": [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in TURNS], "systemInstruction": {"parts": [{"text": "be brief"}]}}),
    "cloudflare_ai_gateway": ("/client/v4/accounts/a1/ai/run", ("cf-aig-gateway-id", "g1"), {"model": "m", "input": {"messages": CONVERSATION}, "max_tokens": 4096}),
}


@pytest.mark.parametrize("provider", SENT)
def test_what_a_provider_is_sent(server, provider):
    request = providers.request_of(provider, "m", {"base_url": server.url + "/", "account_id": "a1", "gateway_id": "g1"})
    told = providers.ask(request, CONVERSATION)
    path, header, body = SENT[provider]
    (got,) = server.seen
    assert got[0] == path and got[1] == body and got[2][header[0]] == header[1]
    assert told == {"content": "Paris", "tokens": None if provider == "cloudflare_ai_gateway" else 7}


@pytest.mark.parametrize("prompt, error", [("overload", "503: too much"), ("plain overload", "503: overloaded"), ("empty", "there is no text"), ("long", "truncated")])
def test_answers_that_are_errors(server, prompt, error):
    ask = providers.sampler("cloudflare_ai_gateway", "m", {"base_url": server.url, "account_id": "a1", "gateway_id": "g1"})
    with pytest.raises(providers.ProviderError, match=error):
        ask(prompt)


def test_missing_keys_and_unreachable_servers(monkeypatch):
    with pytest.raises(providers.ProviderError, match="can't be reached"):
        providers.sampler("openai", "m", {"base_url": "http://127.0.0.1:1"})("x")
    monkeypatch.delenv("OPENAI_API_KEY")
    with pytest.raises(ValueError, match="OPENAI_API_KEY must be set"):
        providers.sampler("openai", "m")
    monkeypatch.delenv("CLOUDFLARE_ACCOUNT_ID", raising=False)
    with pytest.raises(ValueError, match="CLOUDFLARE_ACCOUNT_ID must be set"):
        providers.sampler("cloudflare_ai_gateway", "m")


def test_models_as_tables():
    told = sampling.model_spec({"type": "cloudflare_ai_gateway:@cf/x", "account_id": "a1", "gateway_id": "g1"})
    assert (told.provider, told.model, dict(told.settings)) == ("cloudflare_ai_gateway", "@cf/x", {"account_id": "a1", "gateway_id": "g1"})
    assert sampling.model_spec({"type": "openai", "model_id": "m"}) == sampling.model_spec({"type": "openai:m"}) == sampling.model_spec("openai:m")
    for bad in ({"type": "openai"}, {"type": "openai:"}, {"type": "openai", "model_id": ""}, {}):
        with pytest.raises(ValueError):
            sampling.model_spec(bad)


def test_a_column_of_prompts_is_sampled(spark, server):
    rows = spark.range(40).select("id", F.concat(F.lit("prompt "), "id").alias("prompt"))
    spec = sampling.model_spec({"type": "anthropic:m", "base_url": server.url})
    told = sampling.sampled(rows, "prompt", spec, workers=4).collect()
    assert {(r["id"], r["response"]) for r in told} == {(i, "Paris") for i in range(40)}
    assert sorted(b["messages"][0]["content"] for _, b, _ in server.seen) == sorted(f"prompt {i}" for i in range(40))
    broken = rows.withColumn("prompt", F.when(F.col("id") == 7, "overload").otherwise(F.col("prompt")))
    with pytest.raises(Exception, match="anthropic answered 503: too much"):
        sampling.sampled(broken, "prompt", spec, workers=4).collect()
    turn = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    chatted = sampling.chat(rows.limit(3).withColumn("messages", turn), "messages", spec)
    assert [tuple(r["reply"]) for r in chatted.collect()] == [("Paris", 7)] * 3


def test_a_remote_dataset_is_fetched_by_pages(spark, server, tmp_path):
    catalog = RemoteCatalog(spark, str(tmp_path), server.url, token="t")
    at = catalog.resolved("hf://team/cities", revision="r1")
    assert (at.config, at.split, at.source_id) == ("main", "validation", "hf:team/cities:main:validation")
    assert catalog.total_rows(at) == 230
    told = {r["row_index"]: json.loads(r["json"]) for r in catalog.page(at).collect()}
    assert told == dict(enumerate(ROWS))
    rows = [q for p, q, _ in server.seen if p == "/rows"]
    assert sorted((int(q["offset"]), int(q["length"])) for q in rows) == [(0, 100), (100, 100), (200, 30)]
    assert {q["revision"] for q in rows} == {"r1"} and {a for _, _, a in server.seen} == {"Bearer t"}
    server.seen.clear()
    some = catalog.page(at, 20, 190).filter("row_index >= 150 and row_index < 160")
    assert sorted(r["row_index"] for r in some.collect()) == list(range(150, 160))
    assert [(int(q["offset"]), int(q["length"])) for p, q, _ in server.seen if p == "/rows"] == [(150, 10)]
    assert catalog.page(at, 500, 10).count() == 0


def test_a_remote_dataset_is_fetched_once(spark, server, tmp_path):
    catalog = RemoteCatalog(spark, str(tmp_path), server.url)
    at = catalog.resolved("hf://team/cities")
    first = catalog.rows(at)
    assert first.columns == ["row_index", "golden", "more", "question"] and first.schema["more"].dataType.typeName() == "long"
    asked = sum(p == "/rows" for p, _, _ in server.seen)
    assert asked == 3
    again = sorted(map(tuple, catalog.rows(at).collect()))
    assert again == [(i, r["golden"], r.get("more"), r["question"]) for i, r in enumerate(ROWS)]
    assert sum(p == "/rows" for p, _, _ in server.seen) == asked
    assert catalog.rows(at, 5).count() == 5


def test_remote_errors(spark, server, tmp_path):
    catalog = RemoteCatalog(spark, str(tmp_path), server.url)
    with pytest.raises(DatasetError, match="dataset_unavailable"):
        catalog.resolved("hf://team/nothing")
    with pytest.raises(DatasetError, match="there is no split"):
        catalog.resolved("hf://team/cities", split="test")
    unknown = catalog.resolved("hf://team/cities", split="unknown")
    with pytest.raises(DatasetError, match="unknown"):
        catalog.rows(unknown)
    assert catalog.rows(unknown, 150).count() == 150
    with pytest.raises(Exception, match="the server gave"):
        catalog.page(catalog.resolved("hf://team/cities", split="short")).collect()


def test_a_configured_evaluation_end_to_end(spark, server, tmp_path):
    """A remote dataset, a template, a provider: the run's accuracy is that of the answers."""
    prompt = tmp_path / "prompt.txt"
    prompt.write_text("{{ row.question }}?")
    params = {"dataset": "team/cities", "prompt_template_file": str(prompt), "model": {"type": "openai:m", "base_url": server.url}, "limit": 60}
    found = Evaluation("cities", "custom_nocode", params, Style("exact_match", answer_column="golden"))
    store = Store(spark, str(tmp_path / "store"))
    report = command.run(store, "cities", {"cities": found}, catalog=RemoteCatalog(spark, str(tmp_path / "mirror"), server.url))
    assert report.metrics["accuracy"] == 0.5 and report.output == {"samples_completed": 60}
    assert sorted(b["messages"][0]["content"] for p, b, _ in server.seen if p.startswith("/v1/")) == sorted(f"q{i}?" for i in range(60))
