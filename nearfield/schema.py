"""Schemas of the engine's tables and its limits."""

from __future__ import annotations

from dataclasses import dataclass

INDEX = "namespace string not null, item_id string not null, vector array<float> not null, dim int not null, created_at timestamp, seq bigint not null"
OPS = "op_seq bigint, op string, namespace string, item_id string, vector array<float>"


@dataclass(frozen=True)
class Limits:
    """Request limits and defaults."""

    batch: int = 100
    results: int = 500
    default_results: int = 10
    default_similarity: float = 0.3
    default_namespace: str = "default"
    max_seq_len: int = 2048


LIMITS = Limits()
