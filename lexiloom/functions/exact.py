"""Arithmetic that gives the same digits in any order of rows, on any machine and in any engine that adds and multiplies by the IEEE
standard: sums of whole units, an exp() of its own, doubles cut to fewer bits."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: A double is settled to 27 bits by this factor; sums count whole units of HALF, and what is left in units of HALF squared.
SETTLE, HALF = 2.0**26 + 1, 2.0**-30

#: exp(-32 a), exp(-i) and exp(-j / 32), which decay() puts together, and the coefficients of exp(-f) for f under 1/32 from the highest
#: power down; from DECAYED on exp(-t) counts as 0.
DECAY = ([math.exp(-32.0 * a) for a in range(24)], [math.exp(-float(i)) for i in range(32)], [math.exp(-j / 32) for j in range(32)])
DECAY_SERIES = [(-1.0) ** k / math.factorial(k) for k in range(7, -1, -1)]
DECAYED = 700.0


def settled(value: Column) -> Column:
    """value to 27 bits: digits that depend on the order of an earlier sum go."""
    grown = value * F.lit(SETTLE)
    return grown - (grown - value)


def decay(t: np.ndarray) -> np.ndarray:
    """exp(-t) for t from 0 on."""
    t = np.asarray(t, float)
    held = np.minimum(t, DECAYED)
    q = np.floor(held * 32.0)
    f = held - q / 32.0
    q = q.astype(np.int64)
    series = np.full_like(held, DECAY_SERIES[0])
    for c in DECAY_SERIES[1:]:
        series = series * f + c
    a, i, j = (np.array(x) for x in DECAY)
    return np.where(t >= DECAYED, 0.0, a[q // 1024] * i[q // 32 % 32] * j[q % 32] * series)


def units(values: np.ndarray) -> tuple[int, int]:
    """The sum of values, under 2**33 each, as whole units of HALF and of HALF squared."""
    scaled = values / HALF
    whole = np.floor(scaled)
    return int(whole.astype(np.int64).sum()), int(np.floor((scaled - whole) / HALF).astype(np.int64).sum())


def value(whole: int, rest: int) -> float:
    """The double that units() stand for."""
    return (float(whole) + float(rest) * HALF) * HALF
