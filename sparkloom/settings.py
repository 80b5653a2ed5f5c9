"""Constants that are part of the ranking semantics."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

MODES = ("bm25", "dense", "hybrid")


@dataclass(frozen=True)
class Settings:
    """Weights, thresholds and limits that results depend on."""

    rrf_k: int = 60
    lexical_weight: float = 1.0
    semantic_weight: float = 1.0
    exact_boost: float = 0.018
    name_boost: float = 0.004
    graph_boost: float = 0.006
    graph_decay: float = 0.45
    refinement_weight: float = 0.12
    test_weight: float = 0.82
    candidates: int = 1000
    max_depth: int = 5
    max_file_bytes: int = 1_000_000
    max_files: int = 20_000
    max_total_bytes: int = 50_000_000
    k1: float = 1.6
    b: float = 0.75
    title_weight: float = 2.0
    text_weight: float = 1.0
    semantic_threshold: float = 0.05
    seed_threshold: float = 0.25
    agreement_threshold: float = 0.2
    retrieval: str = "hybrid"
    semantic: str = "auto"
    schema: int = 11

    def __post_init__(self):
        if self.retrieval not in MODES:
            raise ValueError(f"retrieval must be one of {MODES}")
        if self.semantic not in ("on", "auto", "off"):
            raise ValueError("semantic must be on, auto or off")

    def fingerprint(self) -> str:
        """24 hex digits that change with every setting."""
        return hashlib.sha256(json.dumps(asdict(self), sort_keys=True).encode()).hexdigest()[:24]


DEFAULT = Settings()
