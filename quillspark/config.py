"""Settings of the retrieval pipeline, checked when made."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Settings:
    """Sizes in characters, counts in rows, ``min_score`` in [0, 1]."""

    child_size: int = 400
    child_overlap: int = 80
    parent_size: int = 1500
    candidate_k: int = 20
    top_k: int = 5
    min_score: float = 0.30
    rrf_k: int = 60
    mmr_lambda: float = 0.5
    mmr_k: int | None = None
    keep_lexical_only: bool = False
    # What the embedding model expects before passages and questions.
    passage_prefix: str = "Represent this passage for retrieval: "
    query_prefix: str = "Represent this sentence for searching relevant passages: "

    def __post_init__(self) -> None:
        rules = {
            "child_size must be from 50 to 2000": 50 <= self.child_size <= 2000,
            "child_overlap must be from 0 to half of child_size": 0 <= self.child_overlap <= self.child_size / 2,
            "parent_size must be from 200 to 10000": 200 <= self.parent_size <= 10000,
            "parent_size must exceed child_size": self.parent_size > self.child_size,
            "candidate_k must be from 5 to 100": 5 <= self.candidate_k <= 100,
            "top_k must be from 1 to 20": 1 <= self.top_k <= 20,
            "top_k must be below candidate_k": self.top_k < self.candidate_k,
            "min_score must be from 0 to 1": 0 <= self.min_score <= 1,
            "mmr_lambda must be from 0 to 1": 0 <= self.mmr_lambda <= 1,
            "mmr_k must be positive": self.mmr_k is None or self.mmr_k > 0,
        }
        broken = [rule for rule, holds in rules.items() if not holds]
        if broken:
            raise ValueError("; ".join(broken))


@dataclass(frozen=True)
class SplitterSettings:
    """Sizes of the recursive splitter."""

    chunk_size: int = 1000
    overlap: int = 200
    top_k: int = 4

    def __post_init__(self) -> None:
        if not 100 <= self.chunk_size <= 10000:
            raise ValueError("chunk_size must be from 100 to 10000")
        if not 0 <= self.overlap <= self.chunk_size / 2:
            raise ValueError("overlap must be from 0 to half of chunk_size")
        if not 1 <= self.top_k <= 20:
            raise ValueError("top_k must be from 1 to 20")
