"""Parameters of a linkage run."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Settings:
    k: int = 25
    max_postings: int = 25_000
    rule_threshold: float = 0.74
    rule_singleton: float = 0.78
    margin: float = 0.02
    default_threshold: float = 0.94
    thresholds: dict[str, float] = field(default_factory=lambda: {"US": 0.94, "India": 0.94, "France": 0.96})
    strip_domain_words: bool = False
