"""Conversions of single values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def magnitude(re: Column, im: Column) -> Column:
    return F.hypot(re, im)


def phase(re: Column, im: Column) -> Column:
    return F.atan2(im, re)


def to_db(v: Column) -> Column:
    """Decibels of an amplitude; none where it is not positive."""
    return F.when(v > 0, 20 * F.log10(v))


def db_ratio(a: Column, b: Column) -> Column:
    return to_db(b) - to_db(a)


def signed_angle_difference(a: Column, b: Column, period: float) -> Column:
    """Shortest way from a to b, in [-period / 2, period / 2)."""
    return F.pmod(b - a + F.lit(period / 2), F.lit(period)) - F.lit(period / 2)


def quantise(v: Column, lo: Column, hi: Column, bits: int) -> Column:
    """Code 1 to 2**bits - 1 of a value between bounds; 0 is missing."""
    span = F.when(hi > lo, hi - lo).otherwise(F.lit(1.0))
    part = F.least(F.greatest((v - lo) / span, F.lit(0.0)), F.lit(1.0))
    return F.when(v.isNull(), 0).otherwise(1 + F.rint(part * ((1 << bits) - 2))).cast("int")


def dequantise(code: Column, lo: Column, hi: Column, bits: int) -> Column:
    return F.when(code != 0, lo + (code - 1) * (hi - lo) / ((1 << bits) - 2))


def mask_preview(v: Column, cutoff: float | None = None) -> Column:
    """A fraction as is, or 1 at and above a cutoff and 0 below; outside 0 to 1 is missing."""
    inside = (v >= 0) & (v <= 1)
    return F.when(inside, v if cutoff is None else F.when(v >= cutoff, 1.0).otherwise(0.0))


def rescale(raw: Column, scale: float, offset: float, nodata: float | None = None) -> Column:
    if scale == 0:
        raise ValueError("a scale is not 0")
    out = raw * scale + offset
    return out if nodata is None else F.when(raw != nodata, out)


def direction_parts(degrees: Column) -> tuple[Column, Column]:
    return F.sin(F.radians(degrees)), F.cos(F.radians(degrees))


def days_between(a: Column, b: Column) -> Column:
    return F.datediff(b, a)
