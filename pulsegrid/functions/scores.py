"""Scalar functions of the pipeline as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..plans.settings import HOUR, Settings


def clip(x: Column) -> Column:
    """To [0, 1]; null stays null (greatest and least alone would skip it)."""
    return F.when(x.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), x)))


def proximity(t: Column, onset: Column, ongoing: Column, horizon_h: Column) -> Column:
    """1 during an episode, falling to 0 at the horizon before its onset, 0 without one."""
    away = (onset - t).cast("double") / (horizon_h * HOUR).cast("double")
    return F.when(ongoing, F.lit(1.0)).otherwise(F.coalesce(clip(1.0 - away), F.lit(0.0)))


def severity(value: Column, s: Settings) -> Column:
    return F.coalesce(clip((F.lit(s.severity_at) - value) / F.lit(s.severity_at)), F.lit(0.0))


def falling(trend: Column, s: Settings) -> Column:
    return F.coalesce(clip(-trend / F.lit(s.trend_scale)), F.lit(0.0))


def logistic(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def value_score(value: Column, s: Settings) -> Column:
    return logistic((s.low - value) / s.score_scale)


def trend_score(trend: Column) -> Column:
    return logistic(-trend)


def both_score(value: Column, trend: Column, s: Settings) -> Column:
    return logistic((s.low - value) / s.score_scale - F.coalesce(trend, F.lit(0.0)))


def bernoulli_kl(p: Column, q: Column, epsilon: float) -> Column:
    """KL(p || q) of two Bernoulli distributions; 0 ln 0 is 0, and q keeps away from 0 and 1."""
    q = F.greatest(F.lit(epsilon), F.least(F.lit(1.0 - epsilon), q))
    side = lambda a, b: F.when(a > 0, a * F.ln(a / b)).otherwise(F.lit(0.0))
    return side(p, q) + side(1.0 - p, 1.0 - q)
