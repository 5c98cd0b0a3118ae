"""Tunables of the search engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    page_rank_iterations: int = 70
    teleport: float = 0.85
    page_rank_delta: float = 1e-7
    text_weight: float = 0.9
    rank_weight: float = 0.1
    not_factor: float = -1000.0
    correction_threshold: int = 200
    correction_tries: int = 3
    correction_distance: int = 1
    correction_distance_step: int = 1
    suggest_frequent_only: bool = True
    max_query_bytes: int = 255
    max_results: int = 150
    default_results: int = 20
    max_hops: int = 5
    domain: str = "en"
    #: A side of at most this many rows, counted first, is broadcast.
    broadcast_rows: int = 100_000
