"""All adjustable definitions in one place. None of these values is known from a publication."""

from __future__ import annotations

from dataclasses import dataclass

HOUR = 3_600_000_000  # microseconds
#: Hours are counted from here, so that sums of times stay small: 2024-01-01.
ORIGIN = 1_704_067_200_000_000


@dataclass(frozen=True)
class Settings:
    low: float = 20.0  # values below belong to an episode
    min_run: int = 2  # measurements an episode has at least
    window_h: int = 48
    grid_h: int = 16
    horizons_h: tuple[int, ...] = (24, 48, 72)
    alarm_horizon_h: int = 48
    folds: int = 5
    score_scale: float = 10.0  # of the value in the fixed references' scores, which are 1/2 at ``low``
    severity_at: float = 40.0  # severity is 0 from here on, 1 at 0
    trend_scale: float = 1.0  # fall per hour at which the trend component is 1
    weights: tuple[float, float, float] = (0.5, 0.3, 0.2)  # time, severity, trend
    cutoff: float = 0.5
    epsilon: float = 1e-7
    alarm_budget: float = 0.02  # false alarms per evaluable hour
    thresholds: int = 19  # candidates: 1 / (n + 1), ..., n / (n + 1)
    rolling_h: int = 96
    plausible: tuple[float, float] = (1.0, 480.0)  # values outside are artefacts
    min_plausible: float = 0.9  # share of plausible values a clean segment has at least
    max_gap_h: int = 24  # longest stretch without a value inside a clean segment
    channels: tuple[str, ...] = ("click", "purchase", "view")  # event types stacked as channels
    slots: int = 3  # means per channel and window
    buckets: int = 16  # folders that stored recordings are dealt to
    bands_hz: tuple[float, float] = (8.0, 20.0)  # between low, middle and high frequencies
    refractory_s: float = 0.04  # least time between beats
    sampled_hz: float = 64.0  # rate of the vectors that stand in for waveforms
    gain: float = 40.0  # steps of 16-bit samples per unit
    draws: int = 200
    level: float = 0.95


DEFAULT = Settings()
