"""A summary service reached over HTTP."""

from __future__ import annotations

import json
from collections.abc import Callable
from urllib.request import Request, urlopen

TIMEOUT_SECONDS = 4


def remote(base_url: str, timeout: float = TIMEOUT_SECONDS) -> Callable[[str, list[str], int], dict]:
    """A summarizer for ``search``: posts the query and its snippets; statuses of 400 and more are errors."""

    def ask(query: str, snippets: list[str], count: int) -> dict:
        body = json.dumps({"query": query, "snippets": snippets}).encode()
        request = Request(f"{base_url.rstrip('/')}/summarize", body, {"Content-Type": "application/json"})
        with urlopen(request, timeout=timeout) as answer:  # raises on such statuses
            said = json.load(answer)
        return {"query": said.get("query", query), "summary": said["summary"], "grounded_points": list(said.get("grounded_points") or []), "generated": True}

    return ask
