"""Clients of language models: one method, from a request to a reply with its usage."""

from __future__ import annotations

import hashlib
import json
import time
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Protocol

import pandas as pd

REPLY_SCHEMA = "cache_key string, text string, prompt_tokens bigint, completion_tokens bigint, total_tokens bigint, latency_seconds double"
# The roles for which a light model will do.
LIGHT_ROLES = ("router", "memory_specialist", "fast_path", "eval_coverage")


@dataclass(frozen=True)
class Reply:
    text: str
    prompt_tokens: int = 0
    completion_tokens: int = 0
    total_tokens: int = 0
    latency_seconds: float = 0.0


class Client(Protocol):
    def complete(self, role: str, prompt: str, model: str, temperature: float, context_id: str | None = None) -> Reply: ...


def tier(role: str) -> str:
    return "light" if role in LIGHT_ROLES else "strong"


class ScriptedClient:
    """Replies that depend on the role and the prompt only; for tests and dry runs.

    `script` maps a role to a text or to a function of the prompt. Without an entry a
    role gets a fitting reply whose letter comes from the prompt's hash.
    """

    def __init__(self, script: dict[str, str | Callable[[str], str]] | None = None) -> None:
        self.script = script or {}

    def complete(self, role: str, prompt: str, model: str, temperature: float, context_id: str | None = None) -> Reply:
        if role in self.script:
            s = self.script[role]
            text = s(prompt) if callable(s) else s
        else:
            h = int(hashlib.sha256(f"{role}\n{prompt}".encode()).hexdigest(), 16)
            question = " ".join(prompt.split("Question:\n", 1)[-1].rsplit("\n\nFailed query:\n", 1)[0].splitlines())
            text = {
                "router": f"Search Query: {question}",
                "router_reformulate": f"Search Query: {question} again",
                "router_multi": f"Search Query 1: {question}\nSearch Query 2: treatment {question}",
                "researcher_eval": f"Relevance: {'sufficient' if h % 2 else 'insufficient'}\nReason: scripted",
                "verifier_review": f"Decision: {'agree' if h % 3 else 'disagree'}\nReview Memo: scripted",
            }.get(role, f"Scripted reasoning of {role}. [1]\nFinal Answer: {'ABCD'[h % 4]}")
        return Reply(text, 10, 5, 15, 0.01)


class HttpClient:
    """An endpoint with the usual chat-completion shape."""

    def __init__(self, url: str, api_key: str, timeout: float = 60.0) -> None:
        self.url, self.api_key, self.timeout = url, api_key, timeout

    def complete(self, role: str, prompt: str, model: str, temperature: float, context_id: str | None = None) -> Reply:
        body = json.dumps({"model": model, "temperature": temperature, "messages": [{"role": "user", "content": prompt}]}).encode()
        request = urllib.request.Request(self.url, body, {"Content-Type": "application/json", "Authorization": f"Bearer {self.api_key}"})
        began = time.monotonic()
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            data = json.load(r)
        text, used = data["choices"][0]["message"]["content"], data.get("usage") or {}
        guess = lambda t: len(t.split()) * 4 // 3
        p, c = used.get("prompt_tokens", guess(prompt)), used.get("completion_tokens", guess(text))
        return Reply(text, p, c, used.get("total_tokens", p + c), time.monotonic() - began)


@dataclass
class Provider:
    """A service with its keys and its models for light and strong roles. `make(key)` gives a client."""

    make: Callable[[str], Client]
    keys: list[str]
    light: str
    strong: str
    turn: int = 0


class CascadeClient:
    """Asks the providers in turn, each with its next key after a failure, and the whole row of
    them again after a pause that grows, up to `attempts` times; then the last error is raised."""

    def __init__(self, providers: list[Provider], attempts: int = 4, pause: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> None:
        self.providers, self.attempts, self.pause, self.sleep = [p for p in providers if p.keys], attempts, pause, sleep

    def complete(self, role: str, prompt: str, model: str, temperature: float, context_id: str | None = None) -> Reply:
        last: Exception = RuntimeError("no provider has a key")
        for attempt in range(self.attempts if self.providers else 0):
            for p in self.providers:
                for _ in p.keys:
                    key = p.keys[p.turn % len(p.keys)]
                    p.turn += 1
                    try:
                        return p.make(key).complete(role, prompt, p.light if tier(role) == "light" else p.strong, temperature, context_id)
                    except Exception as e:
                        last = e
                        self.sleep(self.pause / 2 * (attempt + 1))
            if attempt + 1 < self.attempts:
                self.sleep(self.pause * (attempt + 1))
        raise RuntimeError(f"all providers failed: {last}") from last


def keys_from(environment: dict[str, str], prefix: str, most: int = 10) -> list[str]:
    """The keys PREFIX_1, PREFIX1, PREFIX_2, ... of an environment, else PREFIX alone."""
    found = [environment.get(f"{prefix}_{i}") or environment.get(f"{prefix}{i}") or "" for i in range(1, most + 1)]
    found = [k.strip() for k in found if k.strip()]
    return found or [k for k in [environment.get(prefix, "").strip()] if k]


def make_client(kind: str, url: str = "", environment: dict[str, str] | None = None, prefix: str = "API_KEY", light: str = "", strong: str = "") -> Callable[[], Client]:
    """What makes a client in each task: "scripted", or "http" with the keys of an environment,
    taken in turn and tried again after failures."""
    if kind == "scripted":
        return ScriptedClient
    if kind != "http":
        raise ValueError(f"no client is named {kind!r}")
    keys = keys_from(environment or {}, prefix)
    if not keys or not url:
        raise ValueError(f"a client by HTTP needs a URL and a key in {prefix}")
    return lambda: CascadeClient([Provider(lambda key: HttpClient(url, key), keys, light, strong)])


def as_batches(make_client: Callable[[], Client]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """A function over batches of requests. The client is made once in each task; a failed
    call gives the reply `ERR` without usage, so that one question can't end a run."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make_client()
        for f in frames:
            rows = []
            for r in f.itertuples():
                try:
                    x = client.complete(r.role, r.prompt, r.model, r.temperature, r.context_id)
                except Exception:
                    x = Reply("ERR")
                rows.append((r.cache_key, x.text, x.prompt_tokens, x.completion_tokens, x.total_tokens, x.latency_seconds))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in REPLY_SCHEMA.split(", ")])

    return run
