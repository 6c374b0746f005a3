"""Time windows and angles as Column expressions."""

from __future__ import annotations

import math
from fractions import Fraction
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Steps of the table of arctangents, and the factor that splits a double into two halves whose products are exact.
STEPS, SPLIT = 64, 134217729.0


def window_start(time: Column, minutes: int) -> Column:
    """Minute of the day at which the point's window starts."""
    m = F.hour(time) * 60 + F.minute(time)
    return (m - m % minutes).cast("int")


@lru_cache(maxsize=1)
def _arctangents() -> tuple[list[float], list[float]]:
    """atan(k / STEPS) for k up to STEPS, as doubles and what these lack."""
    high, low = [], []
    for k in range(STEPS + 1):
        near = Fraction(math.atan(k / STEPS))
        # one step of Newton's from the double on: tan by the series of sine and cosine
        sine = sum(Fraction((-1) ** n, math.factorial(2 * n + 1)) * near ** (2 * n + 1) for n in range(14))
        cosine = sum(Fraction((-1) ** n, math.factorial(2 * n)) * near ** (2 * n) for n in range(14))
        high.append(float(near))
        low.append(float((Fraction(k, STEPS) * cosine - sine) / (cosine + Fraction(k, STEPS) * sine)))
    return high, low


def let(value: Column, body) -> Column:
    """body of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def halves(x: Column) -> tuple[Column, Column]:
    high = x * SPLIT - (x * SPLIT - x)
    return high, x - high


def arctangent(x: Column) -> Column:
    """Arctangent of a number in [-1, 1], rounded to the nearest double but for a few of ten thousand; of others as atan2
    gives it. The JVM's atan2 is off by a bit for 1 to 2 of 100, so that angles tie or not otherwise than in SQL.
    atan(a) = atan(c) + atan(z), z = (a - c) / (1 + a * c), where c is the nearest of the table's; z and the sum are
    carried in two doubles."""
    high, low = (F.array(*map(F.lit, t)) for t in _arctangents())

    def near(a: Column) -> Column:
        k = F.rint(a * STEPS).cast("int")
        c = k / F.lit(float(STEPS))
        ah, al = halves(a)

        def quotient(d: Column) -> Column:
            below = 1 - d + ah * c + al * c  # what d = 1 + a * c lacks
            return let((a - c) / d, lambda z: summed(z, d, below))

        def summed(z: Column, d: Column, below: Column) -> Column:
            (zh, zl), (dh, dl) = halves(z), halves(d)
            rest = zh * dh - z * d + zh * dl + zl * dh + zl * dl  # what z * d lacks
            w = z * z
            series = z * w * (w * (w * (w * (w * F.lit(-1 / 11) + F.lit(1 / 9)) + F.lit(-1 / 7)) + F.lit(1 / 5)) + F.lit(-1 / 3))
            small = low[k] + (a - c - z * d - rest - z * below) / d + series
            return high[k] + z + (z - (high[k] + z - high[k]) + small)

        return let(1 + (ah * c + al * c), quotient)

    plain = F.atan2(x, F.lit(1.0))
    return F.when(F.abs(x) <= 1, F.when(x < 0, -let(-x, near)).otherwise(let(x, near))).otherwise(plain)


def angle(rise: Column, arctan=arctangent) -> Column:
    """Degrees of a rise over a run of one: from 0 up, falling ones from 360 down. arctan: libm.arctangent for angles that
    tie as SQL's do."""
    degrees = arctan(rise) * F.lit(180 / math.pi)
    return F.when(rise < 0, degrees + 360).otherwise(degrees)


def angle_difference(a: Column, b: Column, wrap: bool = True) -> Column:
    d = F.abs(a - b)
    return F.least(d, 360 - d) if wrap else d


def seconds_between(start: Column, end: Column) -> Column:
    """Seconds as double, to the microsecond."""
    return (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
