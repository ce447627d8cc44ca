"""Time mapping and easing as column expressions."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from loomframe.functions.numeric import clamp

_HALVINGS = 52
def progress(t: Column, duration: Column, loop: bool = True) -> Column:
    """Position in a clip: repeats, or stops at the ends."""
    if loop:
        return F.pmod(t, duration) / duration
    return clamp(t / duration, 0.0, 1.0)


def smoothstep(t: Column) -> Column:
    x = clamp(t, 0.0, 1.0)
    return x * x * (3.0 - 2.0 * x)


def harmonic(u: Column) -> Column:
    return 0.5 - 0.5 * F.cos(2.0 * math.pi * u)


@F.pandas_udf(DoubleType())
def bezier_ease(
    t: pd.Series, x1: pd.Series, y1: pd.Series, x2: pd.Series, y2: pd.Series
) -> pd.Series:
    """y of the cubic curve through (0, 0), (x1, y1), (x2, y2), (1, 1) where x is ``t``.

    With both x controls in [0, 1] the curve is monotone in x, so halving the interval
    finds the position; a whole Arrow batch is halved at once.
    """

    def curve(u: pd.Series, first: pd.Series, second: pd.Series) -> pd.Series:
        v = 1.0 - u
        return 3.0 * v * v * u * first + 3.0 * v * u * u * second + u * u * u

    low, high = t * 0.0, t * 0.0 + 1.0
    for _ in range(_HALVINGS):
        middle = (low + high) / 2.0
        below = curve(middle, x1, x2) < t
        low, high = low.where(~below, middle), high.where(below, middle)
    return curve((low + high) / 2.0, y1, y2)


def map_tau(tau: Column, mode: str) -> Column:
    """Loop, ping-pong, hold or clamp a curve parameter into [0, 1]."""
    if mode == "loop":
        return F.pmod(tau, F.lit(1.0))
    if mode == "ping_pong":
        there = F.pmod(tau, F.lit(2.0))
        return F.when(there <= 1.0, there).otherwise(2.0 - there)
    if mode in ("hold", "clamp"):
        return clamp(tau, 0.0, 1.0)
    raise ValueError(f"unknown loop mode {mode!r}")


def rotation_delta(a: Column, b: Column, mode: str, turns: float = 0.0) -> Column:
    """Signed way from angle ``a`` to ``b`` in degrees."""
    raw = b - a
    if mode == "preserve_turns":
        return raw + 360.0 * turns
    if mode == "forward":
        around = F.pmod(raw, F.lit(360.0))
        return F.when(around == 0.0, F.lit(360.0)).otherwise(around)
    if mode == "shortest":
        return F.pmod(raw + 180.0, F.lit(360.0)) - 180.0
    raise ValueError(f"unknown rotation mode {mode!r}")
