"""Clients for hosted language models over HTTP, and the register of modes; phrasing says what they are asked.

A client holds its key and travels with the tasks that ask it. Every failure is a PhrasingError, so that a question falls
back to sentences of the documents.
"""

from __future__ import annotations

import http.client
import json
import os
import urllib.error
import urllib.request
from collections.abc import Mapping
from dataclasses import dataclass, field, replace

from docspark.operators.phrasing import NotConfigured, PhrasingError, http_error, resolve

# Addresses, default models, the version of the protocol, tokens of an answer and of a summary, seconds.
MESSAGES_URL = "https://api.anthropic.com"
MESSAGES_MODEL = "claude-haiku-4-5-20251001"
MESSAGES_VERSION = "2023-06-01"
CHAT_URL = "https://api.openai.com/v1"
CHAT_MODEL = "gpt-4o-mini"
ANSWER_TOKENS, SUMMARY_TOKENS, TIMEOUT = 700, 500, 60.0

LOCAL_MODEL = "extractive (BM25)"
ODD = "The model's answer has an unknown form."


def _posted(url: str, headers: dict, body: dict, timeout: float) -> dict:
    try:
        request = urllib.request.Request(url, json.dumps(body).encode(), {"content-type": "application/json", **headers})
        with urllib.request.urlopen(request, timeout=timeout) as reply:
            return json.load(reply)
    except urllib.error.HTTPError as error:
        raise PhrasingError(http_error(error.code) or ODD) from error
    except (OSError, http.client.HTTPException) as error:
        raise PhrasingError(f"The model can't be reached ({type(error).__name__}).") from error
    except ValueError as error:
        raise PhrasingError(ODD) from error


@dataclass(frozen=True)
class _Client:
    model: str
    url: str
    key: str | None = field(default=None, repr=False)
    timeout: float = TIMEOUT
    max_tokens: int = ANSWER_TOKENS

    def for_summaries(self) -> _Client:
        """The same model with the shorter answers of summaries."""
        return replace(self, max_tokens=SUMMARY_TOKENS)

    def complete(self, system: str, messages: list[dict]) -> str:
        """The model's text, never empty; temperature 0, so that answers repeat."""
        try:
            text = self._text(system, messages).strip()
        except (KeyError, IndexError, TypeError, AttributeError) as error:
            raise PhrasingError(ODD) from error
        if not text:
            raise PhrasingError("The model gave an empty answer.")
        return text

    def _body(self, messages: list[dict]) -> dict:
        return {"model": self.model, "max_tokens": self.max_tokens, "temperature": 0, "messages": messages}


class MessagesClient(_Client):
    """The protocol with content blocks; blocks that aren't text are passed over."""

    def _text(self, system: str, messages: list[dict]) -> str:
        headers = {"x-api-key": self.key or "", "anthropic-version": MESSAGES_VERSION}
        reply = _posted(f"{self.url.rstrip('/')}/v1/messages", headers, self._body(messages) | {"system": system}, self.timeout)
        return "".join(block.get("text", "") for block in reply.get("content", []) if block.get("type") == "text")


class ChatClient(_Client):
    """The protocol of chat completions, which many servers speak; a server of one's own may need no key."""

    def _text(self, system: str, messages: list[dict]) -> str:
        headers = {"authorization": f"Bearer {self.key}"} if self.key else {}
        body = self._body([{"role": "system", "content": system}, *messages])
        return _posted(f"{self.url.rstrip('/')}/chat/completions", headers, body, self.timeout)["choices"][0]["message"]["content"] or ""


def configured(env: Mapping[str, str] | None = None) -> dict[str, _Client]:
    """The clients that the environment has settings for, to be given to the engine.

    ANTHROPIC_API_KEY (and ANTHROPIC_BASE_URL); LLM_API_KEY or LLM_BASE_URL; LLM_MODEL and LLM_TIMEOUT for both.
    """
    env = os.environ if env is None else env
    timeout, found = float(env.get("LLM_TIMEOUT", TIMEOUT)), {}
    if key := env.get("ANTHROPIC_API_KEY"):
        found["anthropic"] = MessagesClient(env.get("LLM_MODEL", MESSAGES_MODEL), env.get("ANTHROPIC_BASE_URL", MESSAGES_URL), key, timeout)
    if env.get("LLM_API_KEY") or env.get("LLM_BASE_URL"):
        found["openai"] = ChatClient(env.get("LLM_MODEL", CHAT_MODEL), env.get("LLM_BASE_URL") or CHAT_URL, env.get("LLM_API_KEY"), timeout)
    return found


def providers(clients: dict) -> dict[str, dict]:
    """Every mode with whether it can be used, its model and what it needs; keys are never shown."""
    out = {"local": {"configured": True, "model": LOCAL_MODEL, "hint": NotConfigured.HINTS["local"]}}
    for mode in dict.fromkeys(["anthropic", "openai", *clients]):
        client, default = clients.get(mode), {"anthropic": MESSAGES_MODEL, "openai": CHAT_MODEL}.get(mode)
        out[mode] = {"configured": client is not None, "model": getattr(client, "model", default), "hint": NotConfigured.HINTS.get(mode, "")}
        if mode == "openai":
            out[mode]["endpoint"] = getattr(client, "url", CHAT_URL)
    return out


def config(mode: str | None, clients: dict) -> dict:
    """The mode to use and its model; raises as resolve does."""
    mode = resolve(mode, clients)
    return {"mode": mode, "model": providers(clients)[mode]["model"]}


def available(mode: str | None, clients: dict) -> bool:
    return resolve(mode, clients) != "local"
