"""Rounding as the planner does it everywhere: halves go up, also below zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(x: Column | str, digits: int = 0) -> Column:
    """floor(x * 10^digits + 0.5) / 10^digits (MTH06)."""
    c = F.col(x) if isinstance(x, str) else x
    if digits == 0:
        return F.floor(c + 0.5).cast("double")
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def round_km(x: Column | str) -> Column:
    return js_round(x, 2)
