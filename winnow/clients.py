"""Clients of embedding, reranking and chat services, for the scorers and judges that take a caller's function.

They hold an address and some numbers only, so that they can be sent to executors. Requests that fail raise.
"""

from __future__ import annotations

import json
import time
import urllib.request
from dataclasses import dataclass, field


def _post(url: str, body: dict, seconds: float, headers: dict[str, str] | None = None) -> dict:
    data = json.dumps(body).encode()
    request = urllib.request.Request(url, data, {"Content-Type": "application/json", **(headers or {})})
    with urllib.request.urlopen(request, timeout=seconds) as got:
        return json.load(got)


@dataclass(frozen=True)
class Service:
    url: str
    model: str = "default"
    batch: int = 32
    seconds: float = 120.0

    def check(self) -> None:
        """Raises unless the service says that it is up."""
        with urllib.request.urlopen(f"{self.url.rstrip('/')}/health", timeout=5) as got:
            got.read()

    def ask(self, path: str, body: dict) -> dict:
        return _post(self.url.rstrip("/") + path, {"model": self.model, **body}, self.seconds)


class Embedder(Service):
    def __call__(self, texts: list[str]) -> list[list[float]]:
        """A vector of length 1 for each text, in order; a zero vector stays as it is."""
        out = []
        for start in range(0, len(texts), self.batch):
            rows = self.ask("/v1/embeddings", {"input": list(texts[start : start + self.batch])})["data"]
            for row in sorted(rows, key=lambda r: r["index"]):
                size = sum(x * x for x in row["embedding"]) ** 0.5 or 1.0
                out.append([x / size for x in row["embedding"]])
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        return out


class Reranker(Service):
    def __call__(self, query: str, texts: list[str]) -> dict[int, float]:
        """Scores by position in texts; what the service leaves out is left out."""
        rows = self.ask("/v1/rerank", {"query": query, "documents": list(texts)})["results"]
        return {r["index"]: float(r["relevance_score"]) for r in rows}


@dataclass(frozen=True)
class Chat:
    """One reply to a system's and a user's text. Failing calls are tried again, with waits that double."""

    url: str
    key: str = field(default="", repr=False)
    tries: int = 5
    wait: float = 3.0
    seconds: float = 180.0

    def __call__(self, model: str, system: str, user: str, max_tokens: int = 1024) -> str:
        said = [{"role": r, "content": t} for r, t in (("system", system), ("user", user)) if t]
        headers = {"Authorization": f"Bearer {self.key}"} if self.key else {}
        for left in range(self.tries - 1, -1, -1):
            try:
                got = _post(self.url, {"model": model, "max_tokens": max_tokens, "messages": said}, self.seconds, headers)
                return got["choices"][0]["message"]["content"].strip()
            except OSError:
                if not left:
                    raise
                time.sleep(self.wait * 2 ** (self.tries - 1 - left))
        raise ValueError("tries must be 1 at least")


def unfenced(reply: str) -> str:
    """A reply without the code fence that models like to put around JSON."""
    reply = reply.strip()
    if not reply.startswith("```"):
        return reply
    inner = reply.partition("\n")[2].rstrip()
    return inner.removesuffix("```").strip()
