"""A chat service as the completion function of the model stage, over HTTP with the standard library.

A `Chat` is a small value that travels to the executors; each Python worker keeps one connection to the service open
for all the chunks it asks about.
"""

from __future__ import annotations

import http.client
import json
import threading
from dataclasses import dataclass
from urllib.parse import urlsplit

from galley.operators.review_map import CallError, retrying

_open = threading.local()


@dataclass(frozen=True)
class Chat:
    """Settings of a service that takes messages at ``{base}/chat/completions``; called with (system, user) it returns
    the reply. Without base or key nothing is sent."""

    base: str
    key: str
    model: str
    temperature: float = 0.0
    timeout: float = 210.0
    retries: int = 3

    def __repr__(self) -> str:
        return f"Chat({self.base!r}, {self.model!r})"  # plans and logs must not show the key

    def __call__(self, system: str, user: str) -> str:
        if lacking := [n for n in ("base", "key") if not getattr(self, n)]:
            raise CallError(f"no {' and no '.join(lacking)} of the service")
        body = json.dumps(self.request(system, user), ensure_ascii=False).encode()
        return reply_text(retrying(lambda: self.post(body), self.retries))

    def request(self, system: str, user: str) -> dict:
        messages = [{"role": r, "content": c} for r, c in (("system", system), ("user", user))]
        return {"model": self.model, "messages": messages, "temperature": self.temperature}

    def post(self, body: bytes) -> tuple[int, dict, str]:
        """Status, headers and text of one answer; OSError where there is none."""
        url = urlsplit(self.base.rstrip("/") + "/chat/completions")
        headers = {"Authorization": f"Bearer {self.key}", "Content-Type": "application/json"}
        held = _open.__dict__.setdefault("connections", {})
        at = (url.scheme, url.netloc, self.timeout)
        if at not in held:
            kind = http.client.HTTPSConnection if url.scheme == "https" else http.client.HTTPConnection
            held[at] = kind(url.netloc, timeout=self.timeout)
        try:
            held[at].request("POST", url.path, body, headers)
            answer = held[at].getresponse()
            return answer.status, dict(answer.headers), answer.read().decode("utf-8", "replace")
        except (OSError, http.client.HTTPException) as e:
            held.pop(at).close()
            raise OSError(f"{type(e).__name__}: {e}") from e


def reply_text(body: str) -> str:
    """The text of the first choice; an answer without one fails like a refused call, so only its chunk is lost."""
    try:
        text = json.loads(body)["choices"][0]["message"]["content"]
    except (ValueError, KeyError, IndexError, TypeError) as e:
        raise CallError(f"an answer without a choice: {body[:200]}") from e
    if not isinstance(text, str):
        raise CallError(f"an answer without a text: {body[:200]}")
    return text
