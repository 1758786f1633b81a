"""Angles in degrees as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def wrap_360(x: Column) -> Column:
    """To [0, 360)."""
    return F.pmod(x, F.lit(360.0))


def wrap_180(x: Column) -> Column:
    """To [-180, 180)."""
    return F.pmod(x + 180.0, F.lit(360.0)) - 180.0


def difference(a: Column, b: Column) -> Column:
    """Signed circular difference a - b in [-180, 180)."""
    return wrap_180(a - b)


def unwrapped(x: Column, by: list[str], order: list[str]) -> Column:
    """Continuous angle of each group: whole turns are added where neighbours differ by more than half a turn."""
    w = Window.partitionBy(*by).orderBy(*order)
    step = x - F.lag(x).over(w)
    turn = F.when(F.abs(step) > 180, -360.0 * F.floor((step + 180.0) / 360.0)).otherwise(0.0)
    return turn


def circular_mean(x: Column) -> Column:
    """Aggregate: mean direction in [0, 360)."""
    r = F.radians(x)
    return wrap_360(F.degrees(F.atan2(F.avg(F.sin(r)), F.avg(F.cos(r)))))


def resultant(x: Column) -> Column:
    """Aggregate: length of the mean direction vector."""
    r = F.radians(x)
    return F.sqrt(F.pow(F.avg(F.sin(r)), 2) + F.pow(F.avg(F.cos(r)), 2))
