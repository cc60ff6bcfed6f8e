"""Language models and embeddings behind an HTTP service that speaks the widespread chat and embeddings formats.

Objects hold settings alone, so they travel to tasks; the key is read from the environment where a call is made.
"""

from __future__ import annotations

import json
import os
import urllib.request
from dataclasses import dataclass


def _post(url: str, token_variable: str, header: str, body: dict, seconds: float) -> dict:
    token = os.environ.get(token_variable)
    if not token:
        raise RuntimeError(f"{token_variable} is not set")
    value = f"Bearer {token}" if header == "Authorization" else token
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", header: value})
    with urllib.request.urlopen(request, timeout=seconds) as answer:
        return json.loads(answer.read())


@dataclass
class HttpProvider:
    url: str
    model_id: str
    token_variable: str = "MODEL_TOKEN"
    header: str = "Authorization"
    seconds: float = 120.0

    def complete(self, prompt: str, schema_name: str) -> str:
        body = {"model": self.model_id, "messages": [{"role": "user", "content": prompt}], "response_format": {"type": "json_object"}}
        first = _post(self.url, self.token_variable, self.header, body, self.seconds)["choices"][0]
        if first.get("finish_reason") == "content_filter" or not first["message"].get("content"):
            raise RuntimeError("the model gave no answer")
        return first["message"]["content"]


@dataclass
class HttpEmbedder:
    url: str
    model_id: str
    token_variable: str = "MODEL_TOKEN"
    header: str = "Authorization"
    seconds: float = 120.0

    def embed(self, texts: list[str]) -> list[list[float]]:
        if not texts:
            return []
        rows = _post(self.url, self.token_variable, self.header, {"model": self.model_id, "input": texts}, self.seconds)["data"]
        vectors = [r["embedding"] for r in sorted(rows, key=lambda r: r["index"])]
        if len(vectors) != len(texts):
            raise RuntimeError(f"{len(vectors)} vectors for {len(texts)} texts")
        return vectors
