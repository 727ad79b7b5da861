"""Options of a search and of the index."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class SearchOptions:
    """Weights of the branches and limits of the results; a branch of weight 0 is never planned."""

    title_weight: float = 0.0
    content_weight: float = 1.0
    embedding_weight: float = 0.6
    bm25_weight: float = 0.4
    top_k: int = 10
    multiplier: int = 10
    vector_method: str = "weighted_top_l_sum"
    bm25_method: str = "max_p"
    folder: str | None = None
    exclude_folder: str | None = None
    exclude_file: str | None = None
    rerank_context: int = 512

    def __post_init__(self) -> None:
        for name, pair in (("title and content", (self.title_weight, self.content_weight)), ("embedding and bm25", (self.embedding_weight, self.bm25_weight))):
            if min(pair) < 0 or sum(pair) <= 0:
                raise ValueError(f"{name} weights must not be negative, nor both 0")

    @property
    def limit(self) -> int:
        return self.top_k * self.multiplier
