"""Settings that change results. Every function takes them explicitly; nothing is read from the environment on executors."""

from __future__ import annotations

import os
from dataclasses import dataclass, fields


@dataclass(frozen=True)
class Settings:
    embedding_dim: int = 96
    strip_urls: bool = True
    strip_emojis: bool = True
    algorithm: str = "auto"
    eps: float = 0.34
    hdbscan_min_cluster: int = 3
    hdbscan_min_samples: int = 2
    hierarchical_fallback: bool = True
    min_cluster_size: int = 3
    min_support: float = 0.58
    min_cohesion: float = 0.60
    min_confidence: float = 0.20
    high_confidence: float = 0.72
    duplicate_threshold: float = 0.78
    two_example_clusters: bool = True
    two_example_cohesion: float = 0.80
    reject_support: float = 0.46
    reject_cohesion: float = 0.48
    hard_reject_cohesion: float = 0.28
    min_question_evidence: int = 2
    max_question_words: int = 18
    max_answer_words: int = 55
    align_strong: float = 0.56
    align_partial: float = 0.42
    skip_rejected: bool = True
    message_limit: int = 50_000
    look_back_days: int = 365

    def __post_init__(self):
        if not 1 <= self.look_back_days <= 3650:
            raise ValueError("look_back_days must be from 1 to 3650")
        if self.message_limit < 1:
            raise ValueError("message_limit must be at least 1")
        if self.algorithm not in ("auto", "dbscan", "hdbscan", "agglomerative"):
            raise ValueError(f"unknown algorithm {self.algorithm}")

    @classmethod
    def from_env(cls, prefix: str = "RECURQ_", env: dict[str, str] | None = None) -> Settings:
        """Settings from variables such as RECURQ_EPS; values that don't parse leave the default."""
        env = dict(os.environ) if env is None else env
        found = {}
        for f in fields(cls):
            raw = env.get(prefix + f.name.upper())
            if raw is None:
                continue
            kind = type(f.default)
            try:
                found[f.name] = raw.strip().lower() in ("1", "true", "yes", "on") if kind is bool else kind(raw)
            except ValueError:
                pass
        return cls(**found)
