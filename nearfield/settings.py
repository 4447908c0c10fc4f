"""Settings of a service, read from any mapping of names to strings."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

from nearfield.schema import LIMITS

# fixed values: the interface's variable names, defaults and ranges
VARIABLES = {
    "provider": ("EMBEDDING_PROVIDER", "api_openai", None),
    "http_port": ("EMBEDDING_HTTP_PORT", 8401, (1, 65_535)),
    "api_key": ("EMBEDDING_API_KEY", "", None),
    "api_url": ("EMBEDDING_API_URL", "https://api.openai.com/v1/embeddings", None),
    "model": ("EMBEDDING_MODEL", "", None),
    "timeout": ("EMBEDDING_TIMEOUT_SECS", 30, None),
    "dimensions": ("EMBEDDING_DIMENSIONS", 1536, None),
    "index_enabled": ("EMBEDDING_INDEX_ENABLED", True, None),
    "index_path": ("EMBEDDING_INDEX_DB_PATH", "data/embedding_index", None),
    "search_backend": ("EMBEDDING_SEARCH_BACKEND", "numpy", ("numpy", "mlx")),
    "max_seq_len": ("ONNX_MAX_SEQ_LEN", LIMITS.max_seq_len, (1, 8192)),
    "model_dir": ("ONNX_MODEL_DIR", "", None),
    "ep_preference": ("ONNX_EP_PREFERENCE", "", None),
    "auth_token": ("NEARFIELD_AUTH_TOKEN", "", None),
    "require_auth": ("NEARFIELD_REQUIRE_AUTH", "", None),
}


@dataclass(frozen=True)
class Settings:
    provider: str
    http_port: int
    api_key: str
    api_url: str
    model: str
    timeout: int
    dimensions: int
    index_enabled: bool
    index_path: str
    search_backend: str
    max_seq_len: int
    model_dir: str
    ep_preference: str
    auth_token: str
    require_auth: str

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None) -> Settings:
        """The settings of a mapping, of the process's environment by default; a value that isn't allowed is an error that names it."""
        env = os.environ if env is None else env
        return cls(**{f.name: _value(env, *VARIABLES[f.name]) for f in fields(cls)})


def _value(env: Mapping[str, str], name: str, default: object, allowed: tuple | None) -> object:
    text = env.get(name)
    if text is None:
        return default
    if isinstance(default, bool):
        return text.lower() == "true"
    if isinstance(default, int):
        try:
            number = int(text)
        except ValueError:
            raise ValueError(f"{name} must be a whole number, got {text}") from None
        if allowed and not allowed[0] <= number <= allowed[1]:
            raise ValueError(f"{name} must be {allowed[0]}-{allowed[1]}, got {number}")
        return number
    if allowed:
        if text.lower() not in allowed:
            raise ValueError(f"{name} must be {' or '.join(allowed)}, got {text}")
        return text.lower()
    return text.strip() if name.endswith("TOKEN") else text
