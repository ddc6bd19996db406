"""Retention rate, rate bands and ratios, with rounding that Spark and SQL
engines agree on.

Rounding a double to 2 decimals differs between engines on ties, so whole
counts use integer arithmetic: round_half_up(100 * m / t, 2) equals
((20000 * m + t) div (2 * t)) / 100 exactly. It is done on decimals without a
fraction, which hold every product of two longs of this kind. Non-integral
inputs fall back to Spark's HALF_UP ``round``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col_of

# Gauge bands of the global retention rate (percent).
BAND_LOW_UPPER = 5.0
BAND_MID_UPPER = 10.0
AXIS_FLOOR = 20.0
AXIS_HEADROOM = 1.2


def _is_whole(c: Column) -> Column:
    return c == F.floor(c)


def round_ratio_half_up(num, den, scale: int, digits: int) -> Column:
    """round_half_up(scale * num / den, digits); 0.0 when den <= 0."""
    n, d = col_of(num), col_of(den)
    factor = 10 ** digits
    ni, di = n.cast("decimal(20,0)"), d.cast("decimal(20,0)")
    times = F.lit(2 * scale * factor).cast("decimal(8,0)")
    exact = F.call_function("div", ni * times + di, di * F.lit(2).cast("decimal(1,0)")) / factor
    return (
        F.when(d.isNull() | (d <= 0), F.lit(0.0))
        .when(_is_whole(n) & _is_whole(d), exact)
        .otherwise(F.round(n * scale / d, digits))
    )


def retention_rate(released, retained) -> Column:
    """Retained share of released + retained, percent with 2 decimals."""
    m = col_of(retained)
    return round_ratio_half_up(m, col_of(released) + m, 100, 2)


def rate_band(rate) -> Column:
    """Gauge colour band of a retention rate."""
    r = col_of(rate)
    return (F.when(r < BAND_LOW_UPPER, F.lit("green"))
            .when(r < BAND_MID_UPPER, F.lit("yellow"))
            .otherwise(F.lit("red")))


def axis_limit(rate) -> Column:
    return F.greatest(F.lit(AXIS_FLOOR), col_of(rate) * AXIS_HEADROOM)


def ratio_1dp(num, den) -> Column:
    """num / den rounded HALF_UP to one decimal (routes per flight)."""
    return round_ratio_half_up(num, den, 1, 1)
