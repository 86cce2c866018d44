"""Caches of answers: in memory, or in a Redis server where its client is installed."""

from __future__ import annotations

import time
from collections import OrderedDict
from collections.abc import Callable
from typing import Any


class MemoryCache:
    """Values with a time to live, the least recently used going first when there are ``most``; ``dropped`` is told of each that goes."""

    def __init__(self, ttl: float = 120, most: int = 1000, clock: Callable[[], float] = time.time, dropped: Callable[[Any], None] = lambda value: None) -> None:
        self.ttl, self.most, self.clock, self.dropped = ttl, most, clock, dropped
        self.held: OrderedDict[str, tuple[float, Any]] = OrderedDict()

    def get(self, key: str) -> Any | None:
        entry = self.held.get(key)
        if entry is None:
            return None
        if self.clock() - entry[0] > self.ttl:
            self._drop(key)
            return None
        self.held.move_to_end(key)
        return entry[1]

    def set(self, key: str, value: Any) -> None:
        self._drop(key)
        self.held[key] = (self.clock(), value)
        while len(self.held) > self.most:
            self._drop(next(iter(self.held)))

    def delete_prefix(self, prefix: str) -> int:
        """Forgets all keys that start with ``prefix``; how many there were."""
        keys = [k for k in self.held if k.startswith(prefix)]
        for k in keys:
            self._drop(k)
        return len(keys)

    def _drop(self, key: str) -> None:
        if key in self.held:
            self.dropped(self.held.pop(key)[1])


class RedisCache:
    """The same over a Redis client: values are text, and prefixes are scanned in pages."""

    def __init__(self, address: str = "127.0.0.1:6379", ttl: float = 120, client: Any = None) -> None:
        if client is None:
            try:
                import redis
            except ImportError as e:
                raise RuntimeError("the redis client is not installed") from e
            host, _, port = address.partition(":")
            client = redis.Redis(host=host, port=int(port or 6379), decode_responses=True, socket_timeout=3)
            client.ping()
        self.client, self.ttl = client, ttl

    def get(self, key: str) -> str | None:
        return self.client.get(key)

    def set(self, key: str, value: str) -> None:
        self.client.set(key, value, ex=max(1, int(self.ttl)))

    def delete_prefix(self, prefix: str) -> int:
        escaped = "".join(f"\\{c}" if c in "*?[]\\" else c for c in prefix)
        keys = list(self.client.scan_iter(match=f"{escaped}*", count=100))
        return self.client.delete(*keys) if keys else 0
