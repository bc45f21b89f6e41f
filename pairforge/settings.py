"""Settings records. Defaults are the published experiment's values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class ScoringSettings:
    """Coverage, band and residual thresholds used to score candidates."""

    hit_threshold: float = 0.19
    chunk_weight: float = 0.8
    max_words_per_chunk: int = 8
    residual_limit_positive: float = 0.14
    residual_limit_negative: float = 0.16
    risk_multiplier: float = 0.4
    safe_multiplier: float = 1.0
    mad_factor: float = 1.4826

    def __post_init__(self) -> None:
        if not 0.0 <= self.chunk_weight <= 1.0:
            raise ValueError("chunk_weight must lie in [0, 1]")


@dataclass(frozen=True)
class PairSettings:
    """Pool sizes and caps of the preference-pair builder."""

    chosen_count: int = 6
    rejected_count: int = 30
    max_chosen: int = 10
    max_rejected: int = 40
    minimum_margin: float = 1.0


@dataclass(frozen=True)
class PoolSettings:
    """Route pools kept from a generator's trials."""

    target: int = 40
    trials_multiplier: int = 4


@dataclass(frozen=True)
class TokenEditSettings:
    """Token-edit augmentation (replace, insert, swap, delete)."""

    num_aug: int = 2
    alpha_replace: float = 0.1
    alpha_insert: float = 0.1
    alpha_swap: float = 0.1
    p_delete: float = 0.1
    letters_only: bool = True
    deduplicate_within_source: bool = False
    include_original: bool = False

    def __post_init__(self) -> None:
        if self.num_aug < 1:
            raise ValueError("num_aug must be at least one")


@dataclass(frozen=True)
class DeletionSettings:
    """Deletion-negative records."""

    n_aug: int = 3
    n_neg: int = 3
    probability: float = 0.3
    allow_empty: bool = True


@dataclass(frozen=True)
class BootstrapSettings:
    """Stratified paired bootstrap."""

    replicates: int = 10_000
    seed: int = 20260621
    ece_bins: int = 10
    low: float = 0.025
    high: float = 0.975
    block: int = 200
