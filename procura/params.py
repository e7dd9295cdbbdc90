"""Parameters of a run, with their defaults; a query names the ones it changes."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Thresholds and limits.
    title_similarity: float = 0.90
    authority_similarity: float = 0.80
    title_alone: float = 0.97
    window_days: int = 21
    authority_candidates: int = 200
    default_priority: int = 50
    block_authority_chars: int = 24
    block_title_words: int = 3
    minimum_similarity: float = 0.34
    minimum_confidence: int = 85
    max_offers: int = 10
    max_items: int = 2000
    max_priced_items: int = 200
    max_text: int = 2_000_000
    spread_warning: float = 0.5
    max_confidence: int = 95
    missing: str = "UNKNOWN"


DEFAULTS = Params()
