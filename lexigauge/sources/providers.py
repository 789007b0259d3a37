"""Text providers: what a model says, behind one interface. Network providers are plug-ins; the mock one is deterministic.

A provider is made once for each model in a worker process.
"""

from __future__ import annotations

import json
import os
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any, Protocol


@dataclass
class Answer:
    """What a model gave, which model it came from, and the tokens it took, where that is known."""

    text: str
    served_by: str | None = None
    input_tokens: int | None = None
    output_tokens: int | None = None


class Provider(Protocol):
    def generate(self, system: str, prompt: str) -> str | Answer:
        """The text for a prompt; an exception if it is refused or cut off."""
        ...

    def generate_json(self, system: str, prompt: str, schema: dict) -> dict:
        """An answer that fits a schema."""
        ...


class MockProvider:
    """Answers without a model; the engine's own expressions do the same for whole tables."""

    def __init__(self, config: dict):
        self.style = config.get("mockStyle", "plain")

    def generate(self, system: str, prompt: str) -> str:
        return prompt

    def generate_json(self, system: str, prompt: str, schema: dict) -> dict:
        return {k: 3 if v.get("type") == "integer" else "" for k, v in schema.get("properties", {}).items()}


class HttpProvider:
    """Posts JSON to the model's baseUrl and reads the text from the answer. Subclasses say how requests and answers look."""

    key_variable = ""
    token_cap = 8000

    def __init__(self, config: dict):
        self.config = config
        self.url = config["baseUrl"]
        self.key = credential(config.get("apiKeyEnv") or self.key_variable)

    def headers(self) -> dict[str, str]:
        return {"authorization": f"Bearer {self.key}"}

    def body(self, system: str, prompt: str, schema: dict | None = None) -> dict[str, Any]:
        c = self.config
        messages = [{"role": "system", "content": system}] if system else []
        out = {"model": c["model"], "max_completion_tokens": int(c.get("maxTokens", self.token_cap)), "messages": [*messages, {"role": "user", "content": prompt}]}
        out |= {"temperature": c["temperature"]} if "temperature" in c else {}
        out |= {"reasoning_effort": c["effort"]} if "effort" in c else {}
        return out | ({"response_format": {"type": "json_schema", "json_schema": {"name": "answer", "strict": True, "schema": schema}}} if schema else {})

    def answer(self, said: dict) -> Answer:
        choice, usage = said["choices"][0], said.get("usage") or {}
        if choice.get("finish_reason") not in (None, "stop"):
            raise RuntimeError(f"the answer ended with {choice['finish_reason']}")
        return Answer(choice["message"]["content"], said.get("model"), usage.get("prompt_tokens"), usage.get("completion_tokens"))

    def ask(self, system: str, prompt: str, schema: dict | None = None) -> Answer:
        import urllib.request

        request = urllib.request.Request(self.url, json.dumps(self.body(system, prompt, schema)).encode(), {"content-type": "application/json"} | self.headers())
        with urllib.request.urlopen(request, timeout=600) as r:
            return self.answer(json.load(r))

    def generate(self, system: str, prompt: str) -> Answer:
        return self.ask(system, prompt)

    def generate_json(self, system: str, prompt: str, schema: dict) -> dict:
        return json.loads(self.ask(system, prompt, schema).text)


class ChatProvider(HttpProvider):
    key_variable = "OPENAI_API_KEY"


class MessagesProvider(HttpProvider):
    key_variable = "ANTHROPIC_API_KEY"

    def headers(self) -> dict[str, str]:
        return {"x-api-key": self.key, "anthropic-version": "2023-06-01"}

    def body(self, system: str, prompt: str, schema: dict | None = None) -> dict[str, Any]:
        c = self.config
        out = {"model": c["model"], "max_tokens": int(c.get("maxTokens", self.token_cap)), "messages": [{"role": "user", "content": prompt}]}
        out |= {"system": system} if system else {}
        # thinking is left out, not switched off, where a model is asked to do without
        out |= {"thinking": {"type": "adaptive"}} if c.get("thinking", "adaptive") == "adaptive" else {}
        out |= {"temperature": c["temperature"]} if "temperature" in c else {}
        out |= {"fallbacks": "default"} if c.get("fallbacks") else {}
        shape = ({"effort": c["effort"]} if "effort" in c else {}) | ({"format": {"type": "json_schema", "schema": schema}} if schema else {})
        return out | ({"output_config": shape} if shape else {})

    def answer(self, said: dict) -> Answer:
        if said.get("stop_reason") in ("refusal", "max_tokens"):
            raise RuntimeError(f"the answer ended with {said['stop_reason']}")
        usage = said.get("usage") or {}
        return Answer("".join(p.get("text", "") for p in said["content"]), said.get("model"), usage.get("input_tokens"), usage.get("output_tokens"))


KINDS: dict[str, Callable[[dict], Provider]] = {"mock": MockProvider, "openai": ChatProvider, "anthropic": MessagesProvider}
_made: dict[str, Provider] = {}


def credential(variable: str) -> str:
    value = os.environ.get(variable, "")
    if not value:
        raise RuntimeError(f"{variable} is not set")
    return value


def register(kind: str, make: Callable[[dict], Provider]) -> None:
    KINDS[kind] = make


def provider_for(config: dict) -> Provider:
    """The provider of a model, made once in this process."""
    key = json.dumps(config, sort_keys=True)
    if key not in _made:
        if config["provider"] not in KINDS:
            raise ValueError(f"no provider {config['provider']!r}")
        _made[key] = KINDS[config["provider"]](config)
    return _made[key]
