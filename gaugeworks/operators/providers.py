"""Model providers over HTTP: what a prompt is sent as, and where the answer's text is.

A provider is described by the request it wants: where, with which headers, and how a conversation is written. The calls
themselves are made by `sampling.external`, so they go through the task's sliding window and stop at the first error;
none is repeated. Keys are looked up on the driver when the plan is made, and one that is missing is an error there.
"""

from __future__ import annotations

import json
import os
import urllib.error
import urllib.request
from collections.abc import Callable
from dataclasses import dataclass

#: Where the providers listen, the version one of them asks for, and the longest answer that is asked for.
BASES = {
    "openai": "https://api.openai.com",
    "anthropic": "https://api.anthropic.com",
    "gemini": "https://generativelanguage.googleapis.com",
    "cloudflare_ai_gateway": "https://api.cloudflare.com",
}
ANTHROPIC_VERSION = "2023-06-01"
LONGEST_ANSWER = 4096
#: Seconds that an answer may take.
PATIENCE = 600.0


class ProviderError(RuntimeError):
    pass


@dataclass(frozen=True)
class Request:
    """How a conversation is put to a provider, and the paths at which its answer may hold the text and the tokens."""

    provider: str
    url: str
    headers: tuple[tuple[str, str], ...]
    body: Callable[[list[dict]], dict]
    texts: tuple[str, ...]
    tokens: tuple[str, ...]
    cut: str | None = None  # where "length" says that the answer was cut short


def needed(variable: str) -> str:
    value = os.environ.get(variable)
    if not value:
        raise ValueError(f"{variable} must be set")
    return value


def _split_system(messages: list[dict]) -> tuple[str, list[dict]]:
    """The system's words, and the other turns."""
    return "\n".join(m["content"] for m in messages if m["role"] == "system"), [m for m in messages if m["role"] != "system"]


def _openai(model: str, base: str, settings: dict) -> Request:
    def body(messages):
        return {"model": model, "messages": messages}

    return Request("openai", f"{base}/v1/chat/completions", (("Authorization", f"Bearer {needed('OPENAI_API_KEY')}"),), body, ("choices.0.message.content",), ("usage.total_tokens",))


def _anthropic(model: str, base: str, settings: dict) -> Request:
    def body(messages):
        system, turns = _split_system(messages)
        return {"model": model, "max_tokens": LONGEST_ANSWER, "messages": turns} | ({"system": system} if system else {})

    headers = (("x-api-key", needed("ANTHROPIC_API_KEY")), ("anthropic-version", ANTHROPIC_VERSION))
    return Request("anthropic", f"{base}/v1/messages", headers, body, ("content.*.text",), ("usage.input_tokens", "usage.output_tokens"))


def _gemini(model: str, base: str, settings: dict) -> Request:
    def body(messages):
        system, turns = _split_system(messages)
        told = [{"role": "model" if m["role"] == "assistant" else "user", "parts": [{"text": m["content"]}]} for m in turns]
        return {"contents": told} | ({"systemInstruction": {"parts": [{"text": system}]}} if system else {})

    return Request("gemini", f"{base}/v1beta/models/{model}:generateContent", (("x-goog-api-key", needed("GEMINI_API_KEY")),), body, ("candidates.0.content.parts.*.text",), ("usageMetadata.totalTokenCount",))


def _cloudflare(model: str, base: str, settings: dict) -> Request:
    def body(messages):
        return {"model": model, "input": {"messages": messages}, "max_tokens": LONGEST_ANSWER}

    account = settings.get("account_id") or needed("CLOUDFLARE_ACCOUNT_ID")
    gateway = settings.get("gateway_id") or needed("CLOUDFLARE_GATEWAY_ID")
    headers = (("Authorization", f"Bearer {needed('CLOUDFLARE_API_KEY')}"), ("cf-aig-gateway-id", gateway))
    places = ("result.response", "result.choices.0.message.content", "result")
    return Request("cloudflare_ai_gateway", f"{base}/client/v4/accounts/{account}/ai/run", headers, body, places, ("result.usage.total_tokens",), "result.choices.0.finish_reason")


_MAKERS = {"openai": _openai, "anthropic": _anthropic, "gemini": _gemini, "cloudflare_ai_gateway": _cloudflare}


def request_of(provider: str, model: str, settings: dict | None = None) -> Request:
    """settings: base_url for servers that speak a provider's language, and what the provider itself needs."""
    settings = settings or {}
    base = settings.get("base_url") or BASES[provider]
    return _MAKERS[provider](model, base.rstrip("/"), settings)


def at(value, path: str):
    """What lies at a path of keys and places, or None; `*` is the first item that has the rest."""
    step, _, rest = path.partition(".")
    if step == "*":
        found = (at(item, rest) for item in value) if isinstance(value, list) else ()
        return next((x for x in found if x is not None), None)
    if isinstance(value, dict):
        inner = value.get(step)
    else:
        inner = value[int(step)] if isinstance(value, list) and step.isdigit() and int(step) < len(value) else None
    return at(inner, rest) if rest else inner


def _complaint(raw: str, status: int) -> str:
    """The error a body tells, else the body, else the status."""
    try:
        told = json.loads(raw)
    except ValueError:
        told = None
    found = next((x for p in ("error.message", "errors.0.message", "error") if isinstance(x := at(told, p), str)), None)
    return found or raw.strip() or f"HTTP {status}"


def ask(request: Request, messages: list[dict]) -> dict:
    """One call: {"content", "tokens"}; tokens are None where the provider doesn't tell them."""
    sent = json.dumps(request.body(messages)).encode()
    call = urllib.request.Request(request.url, sent, {"Content-Type": "application/json", **dict(request.headers)}, method="POST")
    try:
        with urllib.request.urlopen(call, timeout=PATIENCE) as answer:
            raw = answer.read().decode("utf-8", "replace")
    except urllib.error.HTTPError as e:
        raise ProviderError(f"{request.provider} answered {e.code}: {_complaint(e.read().decode('utf-8', 'replace'), e.code)}") from None
    except OSError as e:
        raise ProviderError(f"{request.provider} can't be reached: {e}") from None
    try:
        told = json.loads(raw)
    except ValueError:
        raise ProviderError(f"{request.provider} answered no JSON: {raw[:200]}") from None
    if request.cut and at(told, request.cut) == "length":
        raise ProviderError(f"{request.provider}: the response was truncated")
    text = next((x for p in request.texts if isinstance(x := at(told, p), str)), None)
    if text is None:
        raise ProviderError(f"{request.provider}: there is no text in the response: {raw[:200]}")
    counts = [n for p in request.tokens if isinstance(n := at(told, p), int)]
    return {"content": text, "tokens": sum(counts) if counts else None}


def sampler(provider: str, model: str, settings: dict | None = None) -> Callable[[str], str]:
    """A function from a prompt to the response's text."""
    request = request_of(provider, model, settings)
    return lambda prompt: ask(request, [{"role": "user", "content": prompt}])["content"]


def converser(provider: str, model: str, settings: dict | None = None) -> Callable[[str, str | None, list[dict]], dict]:
    """A function for `sampling.chat`."""
    request = request_of(provider, model, settings)
    return lambda _provider, _model, messages: ask(request, messages)
