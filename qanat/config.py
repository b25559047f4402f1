"""Settings of retrieval, chunking and answering."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ChunkConfig:
    """Windows of ``size`` words that overlap by ``overlap``."""

    size: int = 300
    overlap: int = 60


@dataclass(frozen=True)
class Bm25Config:
    k1: float = 1.5
    b: float = 0.75
    #: Negative idf values become this share of the vocabulary's mean idf.
    epsilon: float = 0.25
    #: Scores are rounded before ranking, so equal scores tie on every run.
    digits: int = 6


@dataclass(frozen=True)
class RetrievalConfig:
    k_rrf: int = 60
    w_dense: float = 0.7
    w_sparse: float = 0.3
    pool: int = 50
    #: With filters, each side ranks ``pool_mult`` times as many candidates.
    pool_mult: int = 4
    k_final: int = 8
    tau_days: float = 30.0
    max_boost: float = 0.10
    digits: int = 8
    #: Candidates without any query token may fill the sparse pool; off by default.
    pad_zero_scores: bool = False
    #: "post" filters after ranking and boosting; "pre" before.
    filter_mode: str = "post"


@dataclass(frozen=True)
class AnswerConfig:
    top_k: int = 6
    max_sources: int = 3
    max_tokens: int = 600
    max_prompt_tokens: int = 6000
    long_body: int = 1500
    short_body: int = 800
    prompt_version: int = 3
    default_ttl: int = 30 * 24 * 3600
    #: Least and greatest number of characters of a query.
    query_chars: tuple[int, int] = (2, 500)
