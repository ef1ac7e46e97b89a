"""A client for model services that speak the public chat-completions and embeddings forms over HTTP."""

from __future__ import annotations

import json
import urllib.error
import urllib.request
from dataclasses import dataclass
from typing import Any

from codeloom.operators.semantic import Answer, Request

BASE_URL = "https://api.openai.com/v1"


class ServiceError(RuntimeError):
    """What a service answered instead of a result; ``status_code`` says whether another attempt may help."""

    def __init__(self, status_code: int, message: str) -> None:
        super().__init__(f"{status_code}: {message}")
        self.status_code = status_code


def usage_of(reported: dict[str, Any] | None) -> dict[str, int]:
    """The service's usage under this engine's names."""
    reported = reported or {}
    cached = (reported.get("prompt_tokens_details") or {}).get("cached_tokens") or 0
    return {"input_tokens": reported.get("prompt_tokens") or 0, "output_tokens": reported.get("completion_tokens") or 0, "cache_read": cached, "cache_creation": 0}


@dataclass(frozen=True)
class HttpClient:
    """Asks a service with a key; holds no connection, so it travels to the workers."""

    key: str
    base_url: str = BASE_URL
    timeout: float = 120.0

    def _post(self, path: str, body: dict[str, Any]) -> dict[str, Any]:
        request = urllib.request.Request(f"{self.base_url.rstrip('/')}/{path}", json.dumps(body).encode(), {"Content-Type": "application/json", "Authorization": f"Bearer {self.key}"}, method="POST")
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as response:
                return json.load(response)
        except urllib.error.HTTPError as e:
            text = e.read().decode(errors="replace")
            try:
                text = json.loads(text)["error"]["message"]
            except (ValueError, KeyError, TypeError):
                text = text[:500]
            raise ServiceError(e.code, text) from None
        except (urllib.error.URLError, TimeoutError) as e:
            raise ServiceError(503, f"no answer from {self.base_url}: {e}") from None

    def generate(self, request: Request) -> Answer:
        messages = [{"role": "system", "content": request.prompt}, {"role": "user", "content": request.content}]
        found = self._post("chat/completions", request.options() | {"messages": messages})
        texts = [(choice["message"].get("content") or "") for choice in sorted(found["choices"], key=lambda c: c.get("index", 0))]
        return Answer(texts, usage_of(found.get("usage")))

    def embed(self, texts: list[str], size: int, model: str) -> tuple[list[list[float]], int]:
        found = self._post("embeddings", {"model": model, "input": texts, "dimensions": size})
        vectors = [row["embedding"] for row in sorted(found["data"], key=lambda r: r["index"])]
        if len(vectors) != len(texts):
            raise ServiceError(500, f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors, (found.get("usage") or {}).get("total_tokens") or 0
