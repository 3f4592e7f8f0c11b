"""Parameters of indexing and retrieval, with their usual values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Config:
    """All sizes are counts; chunk sizes are code points."""

    top_k: int = 5
    dense_k: int = 20
    sparse_k: int = 20
    parent_cap: int = 2
    rerank_pool: int = 20
    mmr_lambda: float = 0.5
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    first_chunk: int = 1024
    first_overlap: int = 128
    second_chunk: int = 128
    second_overlap: int = 32
    cluster_tokens: int = 1024
    cluster_stop: int = 20
    cluster_k_max: int = 8
    max_levels: int = 8
    json_retries: int = 2
    research_rounds: int = 3
    research_queries: int = 3
    history_short: int = 2
    history_long: int = 10
    summary_seconds: float = 300.0
    end_check_seconds: float = 60.0

    def flush_seconds(self) -> float:
        """How often a transcript is flushed: the shorter of both thresholds, each at least 30 s."""
        return min(max(30.0, self.summary_seconds), max(30.0, self.end_check_seconds))
