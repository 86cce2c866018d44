"""Settings of a service from the environment."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """Where a service listens, what it calls itself, and what it stores documents and answers in."""

    address: str = ":8080"
    user_agent: str = "LoomSearchBot/0.1"
    summary_url: str = ""
    database_url: str = ""
    store: str = "parquet"  # or jdbc
    store_path: str = ""
    cache: str = "memory"  # or redis
    redis_address: str = "127.0.0.1:6379"

    @classmethod
    def load(cls, env: Mapping[str, str] = os.environ) -> Config:
        """``LOOM_ADDRESS``, ``LOOM_USER_AGENT`` and so on; what is unset or empty keeps its default."""
        return cls(**{name: value for name in cls.__dataclass_fields__ if (value := env.get(f"LOOM_{name.upper()}", ""))})

    @property
    def host_port(self) -> tuple[str, int]:
        host, _, port = self.address.rpartition(":")
        return host or "0.0.0.0", int(port)
