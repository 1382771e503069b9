"""Values of a layer at the cells of another lattice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.model import KEYS


def resample(targets: DataFrame, src: DataFrame, shape: DataFrame, method: str = "nearest", keys=KEYS, complex_values: bool = False, keep_outside: bool = False) -> DataFrame:
    """Value of ``src`` at fractional positions (x, y, counted from cell centres) of targets
    (keys, trow, tcol, x, y).

    A position is up to half a cell outside at most, and then counts as on the edge. Bilinear
    values are missing if any cell they use is. Complex cells can only be taken as they are.
    The join to the source is by equal row and column. Targets outside the source come out only with
    ``keep_outside``, as missing; they take no part in the join, where they would share one key.
    """
    if method not in ("nearest", "bilinear") or (complex_values and method != "nearest"):
        raise ValueError("nearest, or bilinear for real values")
    h, w = F.col("height"), F.col("width")
    at = [*keys, "trow", "tcol"]
    values = [c for c in ("v", "re", "im") if c in src.columns]
    if keep_outside and method == "nearest":
        # one pass: a target outside has no row and column, meets no cell and so is missing; its key in the join is
        # its own place, negative, so that no two share it
        placed = targets.join(shape, list(keys), "left")
        within = F.coalesce((F.col("x") >= -0.5) & (F.col("x") <= w - 0.5) & (F.col("y") >= -0.5) & (F.col("y") <= h - 0.5), F.lit(False))
        at_cell = lambda c, most, own: F.when(within, F.least(F.greatest(F.floor(F.col(c) + 0.5), F.lit(0)), most - 1)).otherwise(-1 - F.col(own)).cast("int")
        one = placed.select(*at, at_cell("y", h, "trow").alias("row"), at_cell("x", w, "tcol").alias("col"))
        return one.join(src.select(*keys, "row", "col", *values), [*keys, "row", "col"], "left").select(*at, *values)
    if keep_outside:
        placed = targets.join(shape, list(keys), "left")
        within = F.coalesce((F.col("x") >= -0.5) & (F.col("x") <= w - 0.5) & (F.col("y") >= -0.5) & (F.col("y") <= h - 0.5), F.lit(False))
        missing = placed.filter(~within).select(*at, *(F.lit(None).cast("double").alias(c) for c in values))
        return resample(targets, src, shape, method, keys, complex_values).unionByName(missing)
    inside = targets.join(shape, list(keys)).filter((F.col("x") >= -0.5) & (F.col("x") <= w - 0.5) & (F.col("y") >= -0.5) & (F.col("y") <= h - 0.5))
    clamp = lambda c, most: F.least(F.greatest(c, F.lit(0)), most - 1)
    if method == "nearest":
        one = inside.select(*at, clamp(F.floor(F.col("y") + 0.5), h).cast("int").alias("row"), clamp(F.floor(F.col("x") + 0.5), w).cast("int").alias("col"))
        return one.join(src.select(*keys, "row", "col", *values), [*keys, "row", "col"], "left").select(*at, *values)
    cx, cy = clamp(F.col("x"), w), clamp(F.col("y"), h)
    fine = inside.withColumns({"_x0": F.floor(cx), "_y0": F.floor(cy), "_tx": cx - F.floor(cx), "_ty": cy - F.floor(cy)})
    tx, ty = F.col("_tx"), F.col("_ty")
    near = [(0, 0, (1 - tx) * (1 - ty)), (0, 1, tx * (1 - ty)), (1, 0, (1 - tx) * ty), (1, 1, tx * ty)]
    four = F.array(*[F.struct(F.least(F.col("_y0") + i, h - 1).cast("int").alias("row"), F.least(F.col("_x0") + j, w - 1).cast("int").alias("col"), c.alias("w")) for i, j, c in near])
    each = fine.select(*at, F.explode(F.filter(four, lambda t: t["w"] > 0)).alias("_t")).select(*at, "_t.*")
    got = each.join(src.select(*keys, "row", "col", "v"), [*keys, "row", "col"], "left")
    whole = F.count("v") == F.count("*")
    return got.groupBy(*at).agg(F.when(whole, F.sum(F.col("w") * F.col("v"))).alias("v"))


def containing_cell(points: DataFrame, src: DataFrame, keys=KEYS) -> DataFrame:
    """Value of the cell that holds each position (x, y from cell centres)."""
    at = points.withColumns({"row": F.floor(F.col("y") + 0.5).cast("int"), "col": F.floor(F.col("x") + 0.5).cast("int")})
    return at.join(src, [*keys, "row", "col"], "left")


def window_read(cells: DataFrame, x0: float, y0: float, x1: float, y1: float, res: float, top: float, left: float, margin: int = 8) -> DataFrame:
    """Cells that cover bounds, and a margin; the filter reaches the scan, none if disjoint."""
    import math

    r0, r1 = math.floor((top - y1) / res) - margin, math.ceil((top - y0) / res) + margin
    c0, c1 = math.floor((x0 - left) / res) - margin, math.ceil((x1 - left) / res) + margin
    return cells.filter(F.col("row").between(r0, r1 - 1) & F.col("col").between(c0, c1 - 1))
