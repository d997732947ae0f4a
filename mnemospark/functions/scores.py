"""Scores, decay and statistics as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def rounded(x, digits: int = 6) -> Column:
    """Rounds; values on a decimal tie (up to 1e-10) go up, whatever the last bits of the double."""
    return F.round(c(x) + 1e-10, digits)


def clamp(x, low: float = 0.0, high: float = 1.0) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), c(x)))


def hours_between(later, earlier) -> Column:
    return (F.unix_micros(c(later).cast("timestamp")) - F.unix_micros(c(earlier).cast("timestamp"))) / 3.6e9


def seconds_between(later, earlier) -> Column:
    return (F.unix_micros(c(later).cast("timestamp")) - F.unix_micros(c(earlier).cast("timestamp"))) / 1e6


def decayed(strength, rate, hours) -> Column:
    """strength * exp(-rate * hours)."""
    return c(strength) * F.exp(-c(rate) * c(hours))


def retention_curve(rate, hours) -> Column:
    """exp(-rate * hours), whatever the current strength."""
    return F.exp(-c(rate) * c(hours))


def boosted(strength, by) -> Column:
    return F.least(F.lit(1.0), c(strength) + c(by))


def half_life_weight(days, half_life: float = 30.0, low: float = 0.1) -> Column:
    """2 ** -(whole days / half_life) within [low, 1]; 0.5 where the age is unknown."""
    return F.coalesce(clamp(F.exp(-math.log(2) / half_life * F.floor(c(days))), low, 1.0), F.lit(0.5))


def retention_score(surprise, accesses, days, kind_bonus=0.0) -> Column:
    return c(surprise) * 0.4 + F.least(F.lit(0.3), c(accesses) * 0.02) + F.exp(c(days) * -0.01) * 0.2 + c(kind_bonus)


def laplace(successes, n) -> Column:
    """(successes + 1) / (n + 2)."""
    return (c(successes) + 1) / (c(n) + 2)


def wilson(successes, n, z: float = 1.96) -> tuple[Column, Column]:
    """Bounds of the Wilson interval; (0, 1) without trials."""
    n, p = c(n), F.try_divide(c(successes).cast("double"), c(n))
    mid = (p + z * z / (2 * n)) / (1 + z * z / n)
    half = z * F.sqrt(p * (1 - p) / n + z * z / (4 * n * n)) / (1 + z * z / n)
    return F.when(n > 0, F.greatest(F.lit(0.0), mid - half)).otherwise(0.0), F.when(n > 0, F.least(F.lit(1.0), mid + half)).otherwise(1.0)


def fitness(mean, n, full: int = 20) -> Column:
    """Mean score shrunk towards 0.5 until there are ``full`` executions."""
    k = F.least(F.lit(1.0), c(n) / full)
    return c(mean) * k + (1 - k) * 0.5


def uncertainty(p, boundary: float = 0.5) -> Column:
    return clamp(1 - F.abs(c(p) - boundary) * 2)


def sigmoid(x) -> Column:
    return 1 / (1 + F.exp(-c(x)))


def normal_cdf(x) -> Column:
    """Standard normal distribution, by the five-term polynomial of Abramowitz and Stegun 26.2.17."""
    #: Fixed values of the approximation.
    p, b = 0.2316419, (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)
    z = F.abs(c(x))
    t = 1 / (1 + p * z)
    poly = t * (b[0] + t * (b[1] + t * (b[2] + t * (b[3] + t * b[4]))))
    tail = F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly
    return F.when(c(x) >= 0, 1 - tail).otherwise(tail)


def p_value(effect, error) -> Column:
    """Two-sided; 1 where the standard error is 0."""
    return F.when(c(error) == 0, F.lit(1.0)).otherwise(2 * (1 - normal_cdf(F.abs(F.try_divide(c(effect), c(error))))))


def power(effect_size, n, z: float = 1.96) -> Column:
    return 1 - normal_cdf(z - c(effect_size) * F.sqrt(c(n) / 2))


def granularity(importance, per_day, age_days, related, references) -> Column:
    """Need for detail: importance, use, recency, whether related, references."""
    return c(importance) * 0.35 + F.least(F.lit(1.0), c(per_day) / 10) * 0.2 + F.exp(-c(age_days) / 30) * 0.15 + F.when(c(related), 0.3).otherwise(0.1) + F.least(F.lit(1.0), c(references) / 10) * 0.1


def granularity_level(score) -> Column:
    return F.when(c(score) >= 0.8, "full").when(c(score) >= 0.6, "detailed").when(c(score) >= 0.4, "standard").when(c(score) >= 0.2, "summary").otherwise("minimal")


def eviction_score(age_hours, accesses, tokens) -> Column:
    """Cache entries with the lowest score go first."""
    return 0.4 / (c(age_hours) + 1) + F.least(F.lit(1.0), c(accesses) / 10) * 0.4 + c(tokens) / 1000 * 0.2
