"""Reduction of cells to blocks, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.model import KEYS

CANCELLED = 1e-12
#: Areas whose shares differ by less are equal: sums of areas end apart by their order.
EVEN = 1e-9


def in_blocks(cells: DataFrame, k: int) -> DataFrame:
    """Cells of whole blocks with their block's brow, bcol. ``cells`` has height and width."""
    whole = cells.filter((F.col("row") < F.floor(F.col("height") / k) * k) & (F.col("col") < F.floor(F.col("width") / k) * k))
    return whole.withColumns({"brow": F.floor(F.col("row") / k).cast("int"), "bcol": F.floor(F.col("col") / k).cast("int")})


def block_mean(cells: DataFrame, k: int, keys=KEYS) -> DataFrame:
    """Mean and coverage by block; one valid cell gives a mean."""
    return in_blocks(cells, k).groupBy(*keys, "brow", "bcol").agg(F.avg("v").alias("mean"), (F.count("v") / float(k * k)).alias("coverage"))


def keep_blocks(blocks: DataFrame, least: float = 0.8, *coverages: str) -> DataFrame:
    for c in coverages or ("coverage",):
        blocks = blocks.filter(F.col(c) >= least)
    return blocks


def circular(total_sin: Column, total_cos: Column, n: Column, period: float = 360.0) -> Column:
    """Mean direction of summed unit vectors in [0, period); missing where they cancel."""
    turn = F.pmod(F.atan2(total_sin, total_cos) * (period / 6.283185307179586), F.lit(period))
    turn = F.when(turn >= period, F.lit(0.0)).otherwise(turn)
    return F.when(F.hypot(total_sin, total_cos) > n * CANCELLED, turn)


def block_circular_mean(cells: DataFrame, k: int, keys=KEYS) -> DataFrame:
    """Mean of directions in degrees."""
    a = F.radians("v")
    sums = in_blocks(cells, k).groupBy(*keys, "brow", "bcol").agg(F.sum(F.sin(a)).alias("_s"), F.sum(F.cos(a)).alias("_c"), F.count("v").alias("n"))
    return sums.select(*keys, "brow", "bcol", "n", circular(F.col("_s"), F.col("_c"), F.col("n")).alias("direction"))


def block_complex(cells: DataFrame, k: int, keys=KEYS) -> DataFrame:
    """Phase of the complex mean and mean magnitude of cells (re, im); both parts must be there."""
    there = F.col("re").isNotNull() & F.col("im").isNotNull()
    re, im = F.sum(F.when(there, F.col("re"))), F.sum(F.when(there, F.col("im")))
    sums = in_blocks(cells, k).groupBy(*keys, "brow", "bcol").agg(re.alias("_re"), im.alias("_im"), F.avg(F.when(there, F.hypot("re", "im"))).alias("magnitude"))
    phase = F.when(F.hypot("_re", "_im") >= CANCELLED, F.atan2("_im", "_re"))
    return sums.select(*keys, "brow", "bcol", phase.alias("phase"), "magnitude")


def upsample(blocks: DataFrame, k: int, value: str = "mean") -> DataFrame:
    """Each block as k x k cells."""
    rows = blocks.withColumn("row", F.explode(F.expr(f"sequence(brow * {k}, brow * {k} + {k - 1})")))
    cols = rows.withColumn("col", F.explode(F.expr(f"sequence(bcol * {k}, bcol * {k} + {k - 1})")))
    return cols.withColumnRenamed(value, "v").drop("brow", "bcol")


def overlaps(cells: DataFrame, scale: float, offset_row: float, offset_col: float, height: int | Column, width: int | Column) -> DataFrame:
    """Each cell with the target cells it overlaps and the shares of its area, for a target whose
    cells are ``scale`` source cells wide and begin at the offsets (in source cells). Its height and
    width are numbers, or columns of ``cells``."""
    r0, c0 = F.col("row") - F.lit(offset_row), F.col("col") - F.lit(offset_col)
    span = lambda a, most: F.expr("sequence(0, 0)") if isinstance(most, int) and most < 1 else F.sequence(F.greatest(F.floor(a / scale), F.lit(0)), F.least(F.ceil((a + 1) / scale) - 1, F.lit(most) - 1))
    touching = cells.filter((r0 + 1 > 0) & (r0 < F.lit(height) * scale) & (c0 + 1 > 0) & (c0 < F.lit(width) * scale) & F.col("v").isNotNull())
    out = touching.withColumns({"_r": r0, "_c": c0}).withColumn("trow", F.explode(span(F.col("_r"), height))).withColumn("tcol", F.explode(span(F.col("_c"), width)))
    cut = lambda a, t: F.least(a + 1, (t + 1) * scale) - F.greatest(a, t * scale)
    return out.withColumn("w", cut(F.col("_r"), F.col("trow")) * cut(F.col("_c"), F.col("tcol"))).filter("w > 0").drop("_r", "_c")


def overlap_average(weighted: DataFrame, keys=KEYS) -> DataFrame:
    """Area-weighted mean of overlaps()."""
    return weighted.groupBy(*keys, "trow", "tcol").agg((F.sum(F.col("w") * F.col("v")) / F.sum("w")).alias("mean"))


def overlap_direction(weighted: DataFrame, period: float = 360.0, keys=KEYS) -> DataFrame:
    a = F.col("v") * (6.283185307179586 / period)
    sums = weighted.groupBy(*keys, "trow", "tcol").agg(F.sum(F.col("w") * F.sin(a)).alias("_s"), F.sum(F.col("w") * F.cos(a)).alias("_c"), F.sum("w").alias("_w"))
    return sums.select(*keys, "trow", "tcol", circular(F.col("_s"), F.col("_c"), F.col("_w"), period).alias("direction"))


def overlap_majority(weighted: DataFrame, keys=KEYS) -> DataFrame:
    """Classes 0 and 1 by area; a tie is 1."""
    share = F.sum(F.col("w") * F.col("v")) / F.sum("w")
    return weighted.groupBy(*keys, "trow", "tcol").agg(F.when(share >= 0.5 - EVEN, 1).otherwise(0).alias("class"))


def overlap_mode(weighted: DataFrame, keys=KEYS) -> DataFrame:
    """The class with most area, missing where two have as much."""
    sums = weighted.groupBy(*keys, "trow", "tcol", "v").agg(F.sum("w").alias("_w"))
    most = Window.partitionBy(*keys, "trow", "tcol")
    best = sums.withColumn("_most", F.max("_w").over(most)).filter(F.col("_w") >= F.col("_most") * (1 - EVEN))
    return best.groupBy(*keys, "trow", "tcol").agg(F.when(F.count("*") == 1, F.first("v")).alias("class"))
