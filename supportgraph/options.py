"""Settings of the retrieval plans."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace


@dataclass(frozen=True)
class RetrievalOptions:
    """Settings shared by the search and retrieval plans.

    top_k            tickets kept per question; 0 keeps none
    context_limit    exact maximum of earlier comments per solution; 0 keeps none
    min_score        inclusive lower bound of the similarity score
    score_mode       "normalized" is (1 + cos) / 2, in 0..1; "raw" is the cosine itself
    filter_mode      "post" ranks all tickets, then drops open ones, so fewer than ``top_k`` may
                     stay; "pre" ranks closed tickets only
    context_order    "newest" or "oldest" first
    same_category    keep only tickets of the category the triage gave the question
    history_length   messages of a conversation shown to the model; 0 shows none
    dim              length of every vector

    Spark cuts ranks down inside the map tasks up to spark.sql.optimizer.windowGroupLimitThreshold
    (1000). Keep ``top_k`` and ``history_length`` below it where one group may be very large, or
    raise it.
    """

    top_k: int = 5
    context_limit: int = 2
    min_score: float = 0.9
    score_mode: str = "normalized"
    filter_mode: str = "post"
    context_order: str = "newest"
    same_category: bool = False
    history_length: int = 10
    dim: int = 768

    def __post_init__(self) -> None:
        if self.score_mode not in ("normalized", "raw"):
            raise ValueError(f"score_mode must be normalized or raw, not {self.score_mode!r}")
        if self.filter_mode not in ("post", "pre"):
            raise ValueError(f"filter_mode must be post or pre, not {self.filter_mode!r}")
        if self.context_order not in ("newest", "oldest"):
            raise ValueError(f"context_order must be newest or oldest, not {self.context_order!r}")
        for name in ("top_k", "context_limit", "history_length"):
            if getattr(self, name) < 0:
                raise ValueError(f"{name} must not be negative")
        if self.dim < 1:
            raise ValueError("dim must be positive")

    def updated(self, **changes) -> "RetrievalOptions":
        """A copy with the given settings; a setting of None is left as it was."""
        known = {f.name for f in fields(self)}
        unknown = set(changes) - known
        if unknown:
            raise TypeError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: v for k, v in changes.items() if v is not None})

    @staticmethod
    def context_limit_from(context_comments: int) -> int:
        """The exact maximum behind a slice with an exclusive end, ``[0..n-1]``."""
        return max(context_comments - 1, 0)


# The three sets of defaults a user meets (library call, question handler, chat page).
RETRIEVER = RetrievalOptions(top_k=5, context_limit=2, min_score=0.9)
HANDLER = RetrievalOptions(top_k=5, context_limit=2, min_score=0.85, history_length=10)
PAGE = RetrievalOptions(top_k=2, context_limit=0, min_score=0.80, history_length=2)
