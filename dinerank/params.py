"""Job parameters (validated once, passed to every transformation)."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    """Tunable values of the recommendation jobs.

    Defaults and allowed ranges are fixed values of the behaviour being
    reproduced: budget bands 500 / 1500, 30 candidates (1..100), free text
    capped at 500 characters (50..2000), one scorer retry (0..3).
    """

    budget_low_max: float = 500.0
    budget_medium_max: float = 1500.0
    max_candidates: int = 30
    max_additional_preferences_length: int = 500
    scorer_max_retries: int = 1
    scorer_timeout_seconds: float = 30.0
    # Tasks that ask the scorer side by side; 0: four per core.
    scorer_partitions: int = 0
    default_top_k: int = 5
    # Upper bound of top_k; also lets Spark apply a per-group limit.
    max_top_k: int = 20

    def __post_init__(self) -> None:
        if not self.budget_low_max > 0 or not self.budget_medium_max > 0:
            raise ValueError("budget thresholds must be positive")
        if self.budget_low_max >= self.budget_medium_max:
            raise ValueError("the low band has to end below the medium one: budget_low_max < budget_medium_max")
        if not 1 <= self.max_candidates <= 100:
            raise ValueError("max_candidates must be within 1..100")
        if not 50 <= self.max_additional_preferences_length <= 2000:
            raise ValueError("max_additional_preferences_length must be within 50..2000")
        if not 0 <= self.scorer_max_retries <= 3:
            raise ValueError("scorer_max_retries must be within 0..3")
        if not self.scorer_timeout_seconds > 0:
            raise ValueError("scorer_timeout_seconds must be positive")
        if self.scorer_partitions < 0:
            raise ValueError("scorer_partitions must not be negative")
        if not 1 <= self.default_top_k <= self.max_top_k:
            raise ValueError("default_top_k must be within 1..max_top_k")


DEFAULT = Params()
