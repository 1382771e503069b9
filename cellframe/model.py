"""Cells, grids and the missing-value contract.

A layer is a table of (layer, row, col, v); missing is NULL, never NaN. Functions take further
key columns (site, scene, channel) as ``keys``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEYS = ("layer",)


def finite(c: Column) -> Column:
    """NaN and infinities become NULL; done once, at the scan."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def spine(grids: DataFrame, keys=KEYS) -> DataFrame:
    """Every cell of each grid (keys, height, width)."""
    rows = grids.select(*keys, "height", "width", F.explode(F.sequence(F.lit(0), F.col("height") - 1)).alias("row"))
    return rows.select("*", F.explode(F.sequence(F.lit(0), F.col("width") - 1)).alias("col"))


def densify(cells: DataFrame, grids: DataFrame, keys=KEYS) -> DataFrame:
    """Cells with the absent ones as NULL, and height and width beside each."""
    return spine(grids, keys).join(cells, [*keys, "row", "col"], "left")


def shape_of(cells: DataFrame, keys=KEYS) -> DataFrame:
    return cells.groupBy(*keys).agg((F.max("row") + 1).alias("height"), (F.max("col") + 1).alias("width"))


def rounded(c: Column | str, digits: int = 6) -> Column:
    """For results that are compared: rounded, with no negative zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, digits) + F.lit(0.0)
