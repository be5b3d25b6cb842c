"""Decay, validity and expiry. Time is always an argument; nothing reads a clock."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lorebase.plans.views import micros

DAY = 86_400.0


def at(as_of: str) -> Column:
    return F.lit(as_of).cast("timestamp_ntz")


def age_seconds(reference: Column, as_of: str) -> Column:
    """Seconds from reference to as_of; a reference in the future has age 0."""
    return F.greatest(F.lit(0.0), (micros(at(as_of)) - micros(reference)) / 1e6)


def decay(age: Column, kind: str = "exponential", half_life_days: float = 7, floor: float = 0.1, ceiling: float = 1.0) -> Column:
    """The factor that an age in seconds leaves of a value: none, linear, exponential or step, within [floor, ceiling]."""
    half = half_life_days * DAY
    if kind == "none":
        return F.lit(float(ceiling)) + 0 * age
    raw = {"linear": 1 - age / (2 * half), "exponential": F.pow(F.lit(0.5), age / half), "step": F.when(age >= half, 0.5).otherwise(1.0)}[kind]
    return F.greatest(F.lit(float(floor)), F.least(F.lit(float(ceiling)), raw))


def effective_confidence(confidence: Column, age: Column, boost: float = 0.0, **how) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence * decay(age, **how) + boost))


def valid_at(valid_from: Column, valid_until: Column, as_of: str) -> Column:
    """Within bounds, both inclusive; a null bound is open."""
    now = at(as_of)
    return (valid_from.isNull() | (valid_from <= now)) & (valid_until.isNull() | (now <= valid_until))


def expired(reference: Column, ttl_seconds: Column, as_of: str) -> Column:
    """Older than its time to live; a null time to live never ends."""
    return F.coalesce((micros(at(as_of)) - micros(reference)) / 1e6 > ttl_seconds, F.lit(False))


def validity(confidence: Column, reference: Column, valid_from: Column, valid_until: Column, ttl_seconds: Column, as_of: str, stale_days: float = 30, **how) -> Column:
    """One verdict: bounds first, then time to live, then staleness; with the confidence that is left."""
    age, inside = age_seconds(reference, as_of), valid_at(valid_from, valid_until, as_of)
    reason = F.when(~inside, "out_of_bounds").when(expired(reference, ttl_seconds, as_of), "expired").when(age > stale_days * DAY, "stale").otherwise("valid")
    left = F.when(reason.isin("out_of_bounds", "expired"), 0.0).otherwise(effective_confidence(confidence, age, **how))
    return F.struct(reason.alias("reason"), reason.isin("valid", "stale").alias("is_valid"), left.alias("confidence"))


def needs_verification(reference: Column, as_of: str, stale_days: float = 30) -> Column:
    return age_seconds(reference, as_of) > stale_days * DAY / 2


def clock_minutes(text: Column) -> Column:
    """``H:M:S`` or ``M:S`` as minutes."""
    p = F.split(text, ":")
    n = F.transform(p, lambda x: x.try_cast("double"))
    return F.when(F.size(p) == 3, n[0] * 60 + n[1] + n[2] / 60).when(F.size(p) == 2, n[0] + n[1] / 60)


def clamped(value: Column, low: float = 0.1, high: float = 0.95, default: float = 0.7) -> Column:
    return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value.try_cast("double"), F.lit(default))))
