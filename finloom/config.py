"""Thresholds and weights of the statement engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Config:
    # composite score: weights of the three layers, grade cuts
    layer_weights: tuple[float, float, float] = (0.4, 0.3, 0.3)
    qcs_cuts: tuple[float, float, float] = (0.90, 0.75, 0.60)
    grade_cuts: tuple[float, float, float] = (0.85, 0.65, 0.40)
    grade_scores: dict = field(default_factory=lambda: {"EXCELLENT": 1.0, "GOOD": 0.80, "FAIR": 0.55, "POOR": 0.25})
    severity_weights: dict = field(default_factory=lambda: {"CRITICAL": 3, "ERROR": 2, "WARNING": 1})
    # matching
    fuzzy_cut: float = 85.0
    suggestion_cut: float = 75.0
    align_cut: float = 0.70
    # alignment, vote
    numeric_tolerance: float = 1.0
    delta_green: float = 0.1
    delta_red: float = 0.5
    label_alpha: float = 0.5
    # validation
    relative_tolerance: float = 0.01
    absolute_tolerance: float = 1.0
    variation_tolerance: float = 0.5
    correction_tolerance: float = 5.0
    # gates
    class_confidence: float = 0.70
    green_match: float = 0.95
    green_columns: float = 0.80
    green_class: float = 0.60
    tier0_accept: float = 0.95
    tier1_accept: float = 0.75
    continuation: float = 2.5
    promote_count: int = 3


DEFAULT = Config()
