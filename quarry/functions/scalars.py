"""Scalar column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The linear congruential step used wherever a reproducible pseudo-random
# order or pick is needed (multiplier, increment, modulus). Small modulus keeps the
# product inside 64 bits, so ANSI mode never overflows and SQL engines agree.
LCG_MULTIPLIER = 1103515245
LCG_INCREMENT = 12345
LCG_MODULUS = 2147483648

# Per-channel mean and standard deviation used to normalise inputs
# (red, green, blue).
CHANNEL_MEAN = (0.485, 0.456, 0.406)
CHANNEL_STD = (0.229, 0.224, 0.225)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def lcg(x, steps: int = 1) -> Column:
    """``steps`` applications of x -> (x mod m * a + c) mod m, a value in [0, 2^31)."""
    v = _c(x)
    for _ in range(steps):
        v = (F.pmod(v, F.lit(LCG_MODULUS)) * F.lit(LCG_MULTIPLIER) + F.lit(LCG_INCREMENT)) \
            % F.lit(LCG_MODULUS)
    return v


def stable_round(x, digits: int) -> Column:
    """Round half-up after a 1e-9 nudge, so values that are exact ties in decimal (averages of
    integers) round the same way whatever the last-bit noise of the summation order."""
    return F.round(_c(x) + F.lit(1e-9), digits)


def micros_between(start, end) -> Column:
    """end - start in microseconds. On ``timestamp_ntz`` this is wall-clock arithmetic, the
    same in every session time zone (a cast to ``timestamp`` would shift across DST)."""
    return F.timestamp_diff("MICROSECOND", _c(start), _c(end))


def epoch_micros(ts) -> Column:
    """Microseconds since 1970-01-01 00:00:00 of a ``timestamp_ntz``, zone-independent."""
    return micros_between(F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), ts)


def timestamp_seconds_component(start, end) -> Column:
    """Seconds part of (end - start) as a day/second split: 0..86399, so 24h10m -> 600 and
    -1s -> 86399 (the behaviour of a timedelta's ``seconds`` field)."""
    us = micros_between(start, end)
    return F.pmod(F.floor(us / F.lit(1_000_000)), F.lit(86400)).cast("long")


trip_duration = timestamp_seconds_component


def strict_bool(x) -> Column:
    """Only True/False/true/false parse; anything else fails the query."""
    c = _c(x)
    return (F.when(c.isin("True", "true"), F.lit(True))
             .when(c.isin("False", "false"), F.lit(False))
             .otherwise(F.raise_error(F.concat(F.lit("cannot read as true or false: "),
                                               F.coalesce(c, F.lit("NULL"))))).cast("boolean"))


def ceil_div(a, b) -> Column:
    return F.ceil(_c(a) / _c(b)).cast("long")


def round_robin(i, n: int) -> Column:
    return F.pmod(_c(i), F.lit(n))


def normalize_channels(value, index) -> Column:
    """(x - mean[i % 3]) / std[i % 3] for a flat interleaved channel array."""
    ch = F.pmod(_c(index), F.lit(3))
    mean = F.element_at(F.array(*[F.lit(m) for m in CHANNEL_MEAN]), ch + 1)
    std = F.element_at(F.array(*[F.lit(s) for s in CHANNEL_STD]), ch + 1)
    return (_c(value) - mean) / std
