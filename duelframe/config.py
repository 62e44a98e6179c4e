"""Constants and settings of the engine, as immutable values."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class RatingSettings:
    """The two-player rating model."""

    mean: float = 25.0
    deviation: float = 25.0 / 3.0
    performance: float = 25.0 / 6.0
    dynamics: float = 25.0 / 300.0
    epsilon: float = 1e-9
    steepness: float = 1.5


@dataclass(frozen=True)
class RankingSettings:
    """Pair selection and storage."""

    seed_percentage: int = 5
    seed_target: int = 10
    insertion_target: int = 1
    sigma_threshold: float = 3.0
    transitive_depth: int = 5
    reserve_count: int = 30
    subfolder_threshold: int = 1000
    default_score: float = 0.5
    min_chains: int = 20
    chain_gap: float = 0.01
    recent_items: int = 240


@dataclass(frozen=True)
class TrainingSettings:
    min_comparisons: int = 4
    random_state: int = 947
    calibration_points: int = 257
    cumulative_gain: float = 0.99
    interaction_top: int = 500


RATING = RatingSettings()
RANKING = RankingSettings()
TRAINING = TrainingSettings()
