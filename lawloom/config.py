"""All tunable parameters of the retrieval and answering operators, in one immutable object."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class EngineConfig:
    """Parameters that a caller may override; nothing is read from the command line at import.

    The numbers are fixed values of the documented pipeline.
    """

    top_k: int = 200
    dense_top_k: int = 500
    negatives_per_label: int = 5
    min_max_eps: float = 1e-4
    seed: int = 42
    train_share: float = 0.8
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    bm25_epsilon: float = 0.25
    recall_cutoffs: tuple[int, ...] = (1, 2, 5, 10, 20, 50, 100, 200, 500)
    fusion_cutoffs: tuple[int, ...] = (1, 2, 5, 10, 20, 50)
