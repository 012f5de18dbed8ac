"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Arm:
    """A lag window: fixed (``max_lag_s``) or half a period of the source rhythm."""

    name: str
    max_lag_s: float
    rule: str | None = None
    min_lag_s: float | None = None


@dataclass(frozen=True)
class Stratum:
    name: str
    min_hz: float | None = None
    below_hz: float | None = None


@dataclass(frozen=True)
class Contrast:
    name: str
    metric: str
    arm: str
    minus: str


@dataclass(frozen=True)
class Criterion:
    grp: str  # guards, success or failure
    id: str
    metric: str
    op: str
    value: float


@dataclass(frozen=True)
class Settings:
    """What a study measures: the same tests can be measured under other settings."""

    alpha: float
    fs: float
    arms: Sequence[Arm]
    strata: Sequence[Stratum]
    contrasts: Sequence[Contrast] = ()


def half_even(column: Column) -> Column:
    """Round to the nearest integer, ties to even."""
    return F.bround(column, 0).cast("long")


def stratum_of(freq: Column, strata: Sequence[Stratum]) -> Column:
    """First stratum, in declared order, with ``min <= f < below``; missing bounds are open."""
    out = None
    for s in strata:
        inside = freq.isNotNull()
        if s.min_hz is not None:
            inside &= freq >= s.min_hz
        if s.below_hz is not None:
            inside &= freq < s.below_hz
        else:
            inside &= freq < float("inf")
        if s.min_hz is None:
            inside &= freq >= 0.0
        out = F.when(inside, s.name) if out is None else out.when(inside, s.name)
    return out if out is not None else F.lit(None).cast("string")


def arm_lag(arm: Arm, freq: Column, fs: float) -> Column:
    """Samples in an arm's lag window; a missing or zero frequency earns the longest half-period window."""
    longest = half_even(F.lit(arm.max_lag_s * fs))
    if arm.rule != "half_period":
        return F.greatest(F.lit(1).cast("long"), longest)
    shortest = half_even(F.lit(arm.min_lag_s * fs))
    half = F.ceil(F.lit(fs) / (F.lit(2.0) * F.nullif(freq, F.lit(0.0)))) + 1
    return F.when(freq.isNull() | (freq == 0.0), longest).otherwise(F.least(longest, F.greatest(shortest, half)))


def detected(p: Column | str, alpha: float) -> Column:
    return (F.col(p) if isinstance(p, str) else p) <= F.lit(float(alpha))


def finite(column: Column) -> Column:
    """The value, or null where it is NaN or infinite."""
    return F.when(F.isnan(column) | (F.abs(column) == float("inf")), None).otherwise(column)


def is_finite(column: Column) -> Column:
    return F.coalesce(~F.isnan(column) & (F.abs(column) != float("inf")), F.lit(False))


def holds(observed: Column, op: Column | str, value: Column | float) -> Column:
    """``observed op value``; null when nothing was observed."""
    tests = {"<": observed < value, "<=": observed <= value, ">": observed > value, ">=": observed >= value}
    if isinstance(op, str):
        return tests[op]
    out = None
    for symbol, test in tests.items():
        out = F.when(op == symbol, test) if out is None else out.when(op == symbol, test)
    return out


def slug(title: Column) -> Column:
    """Lower-case words joined by ``-``, at most 60 characters, ``source`` when nothing is left."""
    words = F.regexp_replace(F.lower(title), "[^a-z0-9]+", "-")
    cut = F.rtrim(F.substring(F.trim(words, F.lit("-")), 1, 60), F.lit("-"))
    return F.when(cut == "", "source").otherwise(cut)


def packed_hash(column: Column | str) -> Column:
    """A text hash in half the bytes, for comparing only: different texts stay different, whether they are hashes or not."""
    column = F.col(column) if isinstance(column, str) else column
    other = F.concat(F.lit(bytes(33)), F.encode(column, "utf-8"))  # longer than any packed hash
    return F.when(column.rlike("^[0-9a-f]{64}$"), F.unhex(column)).otherwise(other)
