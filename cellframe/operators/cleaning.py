"""Screens, masks and gap filling."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.model import KEYS, finite
from cellframe.operators import tiles

# Undeclared fills, ranges and spike tolerances by kind of layer. None is unbounded.
SENTINELS = (-3.4028234663852886e38, -10000.0, -9999.0)
BUILD_RANGES = {
    "DEM": (-500.0, 9000.0), "SD": (-1.0, 20.0), "VH": (-1.0, 120.0), "SWE": (0.0, 5000.0), "DENSITY": (0.0, 1000.0),
    "dem_tiff": (-500.0, 9000.0), "hgt": (-500.0, 9000.0), "cor": (0.0, 1.0), "unw": (-1e4, 1e4),
}
ENRICH_RANGES = {
    "snow_depth": (0.0, 15.0), "elevation": (-500.0, 9000.0), "veg_height": (0.0, 120.0), "swe": (0.0, 6000.0),
    "snow_density": (0.0, 1000.0), "cor": (0.0, 1.0), "amp1": (0.0, None), "amp2": (0.0, None),
}
SPIKES = {"DEM": 25.0, "dem_tiff": 25.0, "hgt": 25.0, "SD": 10.0, "VH": 30.0, "cor": 0.9}
NOISE_FLOOR, COHERENT, MASK_MISSING, GAP_PASSES = -0.25, 0.30, 255, 2


def normalise_fill(v: Column, nodata: Column | None = None) -> Column:
    """Declared nodata, the least float32 and non-finite values become missing."""
    bad = F.isnan(v) | (F.abs(v) == float("inf")) | (v == SENTINELS[0])
    return F.when(~bad if nodata is None else ~(bad | v.eqNullSafe(nodata)), v)


def integer_fill(code: Column, sentinel: int = MASK_MISSING) -> Column:
    return F.nullif(code, F.lit(sentinel))


def strip_sentinels(v: Column) -> Column:
    return F.when(~v.isin(*SENTINELS), v)


def ranges_table(spark: SparkSession, ranges: dict[str, tuple]) -> DataFrame:
    return spark.createDataFrame([(k, *x) for k, x in ranges.items()], "kind string, low double, high double")


def range_screen(cells: DataFrame, ranges: DataFrame, kind: str = "kind") -> DataFrame:
    """Values out of their kind's bounds become missing in ``screened``; other kinds pass. The
    bounds are a short fixed table, so Spark broadcasts it by its size."""
    bounds = ranges.withColumnRenamed("kind", "_kind")
    out = cells.join(bounds, F.col(kind) == F.col("_kind"), "left")
    inside = F.coalesce(F.col("v") >= F.col("low"), F.lit(True)) & F.coalesce(F.col("v") <= F.col("high"), F.lit(True))
    return out.withColumn("screened", F.when(inside, F.col("v"))).drop("_kind", "low", "high")


def clean_snow_depth(v: Column) -> Column:
    """Small negatives are noise around zero; larger ones are missing."""
    return F.when(v < NOISE_FLOOR, F.lit(None).cast("double")).when(v < 0, F.lit(0.0)).otherwise(v)


def coherence_mask(v: Column, least: float = COHERENT) -> Column:
    return F.when(v.isNull(), MASK_MISSING).when(v >= least, 1).otherwise(0)


def zero_fill(v: Column) -> Column:
    """An exact zero of an unwrapped phase is a fill."""
    return F.nullif(v, F.lit(0.0))


def zero_fill_counts(cells: DataFrame, keys=KEYS, v: str = "v") -> DataFrame:
    """Zero fills that zero_fill() removes from each layer, and why it is empty if nothing else was there."""
    zero = F.count_if(F.col(v) == 0)
    empty = (zero > 0) & (F.count(v) == zero)
    return cells.groupBy(*keys).agg(zero.alias("removed"), F.when(empty, "every value was a zero fill").alias("empty_reason"))


def point_fill(text: Column) -> Column:
    """A number from text; -9999 and what is no number are missing."""
    return F.nullif(text.try_cast("double"), F.lit(-9999.0))


def cardinal(cells: DataFrame, keys=KEYS, v: str = "v") -> DataFrame:
    """Values of the four neighbours as left, right, up, down: one exchange by row, one by column."""
    along, down = Window.partitionBy(*keys, "row").orderBy("col"), Window.partitionBy(*keys, "col").orderBy("row")
    out = cells.withColumns({"left": F.lag(v).over(along), "right": F.lead(v).over(along)})
    return out.withColumns({"up": F.lag(v).over(down), "down": F.lead(v).over(down)})


def _sum4() -> tuple[Column, Column]:
    four = [F.col(c) for c in ("left", "right", "up", "down")]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in four), F.lit(0.0))
    return total, sum((c.isNotNull().cast("int") for c in four), F.lit(0))


def spike_screen(dense: DataFrame, tolerance: Column, keys=KEYS, v: str = "v") -> DataFrame:
    """A cell further than ``tolerance`` from the median of its four neighbours becomes missing;
    all five must be there. All cells are judged on the input."""
    near = cardinal(dense, keys, v)
    total, n = _sum4()
    median = (total - F.least("left", "right", "up", "down") - F.greatest("left", "right", "up", "down")) / 2
    spike = (n == 4) & F.coalesce(F.abs(F.col(v) - median) > tolerance, F.lit(False))
    return near.withColumn(v, F.when(~spike, F.col(v))).drop("left", "right", "up", "down")


def fill_gaps(dense: DataFrame, passes: int = GAP_PASSES, keys=KEYS, v: str = "v") -> DataFrame:
    """A missing cell with three neighbours or more takes their mean, in so many passes."""
    for _ in range(passes):
        near = cardinal(dense, keys, v)
        total, n = _sum4()
        dense = near.withColumn(v, F.when(F.col(v).isNull() & (n >= 3), total / n).otherwise(F.col(v))).drop("left", "right", "up", "down")
    return dense


def clean_layer(cells: DataFrame, kind: str, keys=KEYS, side: int = tiles.SIDE) -> DataFrame:
    """Sentinels, range, spikes and gaps of one kind of layer, all in tiles with a border: one exchange.

    ``cells`` is (keys, row, col, v, height, width), sparse or dense. Returns the cells that are there before
    or after: ``v``, ``before``, ``removed`` (the step that took the value: sentinels, out_of_range,
    spikes) and ``filled`` (a gap got a value, also one that a step made). Layers of less than three rows
    or columns have no spikes and no gaps. Complex layers don't come here.
    """
    low, high = BUILD_RANGES.get(kind, (None, None))
    tolerance = SPIKES.get(kind)

    def work(tile: tiles.Tile, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        v = tile.v
        removed = np.full(v.shape, None, dtype=object)

        def take(hit: np.ndarray, step: str) -> None:
            nonlocal v
            removed[hit] = step
            v = np.where(hit, np.nan, v)

        take(np.isin(v, SENTINELS), "sentinels")
        if low is not None or high is not None:
            take((v < (-np.inf if low is None else low)) | (v > (np.inf if high is None else high)), "out_of_range")
        wide = tile.height > 2 and tile.width > 2
        if wide and tolerance is not None:
            take(tiles.spikes(v, tolerance), "spikes")
        after = tiles.filled(v, GAP_PASSES) if wide else v
        got = np.where(np.isnan(v) & ~np.isnan(after), True, None)
        return {"v": tile.inner(after), "before": tile.inner(tile.v), "removed": tile.inner(removed), "filled": tile.inner(got)}

    out = tiles.applied(cells, work, "v double, before double, removed string, filled boolean", 1 + GAP_PASSES, keys, side)
    return out.withColumns({"v": finite(F.col("v")), "before": finite(F.col("before")), "filled": F.coalesce("filled", F.lit(False))})


def cleaning_counts(cleaned: DataFrame, keys=KEYS) -> DataFrame:
    gone, made = F.col("before").isNotNull() & F.col("v").isNull(), F.col("before").isNull() & F.col("v").isNotNull()
    return cleaned.groupBy(*keys).agg(F.count_if(gone).alias("removed"), F.count_if(made).alias("filled"))


def cleaning_steps(cleaned: DataFrame, keys=KEYS) -> DataFrame:
    """A counter for each step of clean_layer(), what was taken in all, and why a layer is empty.

    A value that a step took and a gap's pass put back counts in both. ``empty_reason`` is set
    where nothing is left: ``no_valid_input_cells`` if nothing was there, else ``every value was removed``.
    """
    step = {s: F.count_if(F.col("removed") == s).alias(s) for s in ("sentinels", "out_of_range", "spikes")}
    reason = F.when(F.count("v") > 0, None).when(F.count("before") == 0, "no_valid_input_cells").otherwise("every value was removed")
    return cleaned.groupBy(*keys).agg(*step.values(), F.count_if("filled").alias("gaps_filled"), F.count("removed").alias("removed_total"), F.count("v").alias("valid"), reason.alias("empty_reason"))


def swath_mask(channels: DataFrame, layers: DataFrame, scene=("scene",), names=("amp1", "amp2", "cor")) -> DataFrame:
    """Cells of ``layers`` only where every channel that the scene has is there and not zero.

    ``channels`` is dense: (scene, leaf, row, col, v). A scene without channels is left alone.
    """
    some = channels.filter(F.col("leaf").isin(*names))
    seen = some.groupBy(*scene, "row", "col").agg(F.bool_and(F.col("v").isNotNull() & (F.coalesce("v", F.lit(0.0)) != 0)).alias("inside"))
    has = some.select(*scene).distinct().withColumn("_masked", F.lit(True))
    out = layers.join(has, list(scene), "left").join(seen, [*scene, "row", "col"], "left")
    keep = F.col("_masked").isNull() | F.coalesce("inside", F.lit(False))
    return out.withColumn("v", F.when(keep, F.col("v"))).drop("_masked", "inside")
