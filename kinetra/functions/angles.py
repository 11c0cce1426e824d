"""Angles in radians or degrees as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrap(angle: Column, turn: float = 2 * math.pi) -> Column:
    """angle in [0, turn); pmod, since % keeps the sign."""
    return F.pmod(angle, F.lit(turn))


def difference(a: Column, b: Column, turn: float = 2 * math.pi) -> Column:
    """Signed difference a - b in [-turn/2, turn/2)."""
    return F.pmod(a - b + F.lit(turn / 2), F.lit(turn)) - F.lit(turn / 2)


def separation(a: Column, b: Column, turn: float = 2 * math.pi) -> Column:
    """Unsigned difference in [0, turn/2]."""
    return F.abs(difference(a, b, turn))


def heading(east: Column, north: Column) -> Column:
    """Clockwise from north, in [0, 2 pi)."""
    return wrap(F.atan2(east, north))
