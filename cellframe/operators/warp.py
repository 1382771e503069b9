"""Layers moved onto the grid of another reference system.

The target's cells are dealt out, never the source's: a target centre goes to longitude and
latitude, into the source's system, through the inverse of its six-term transform, and takes the
value there by an equality join on row and column. Where the target lies in the source is worked out
before from points along its edges, so that the scan of the source reads that window alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.functions.geometry import Crs, affine_inverse, bind, reproject
from cellframe.model import KEYS
from cellframe.operators.regrid import resample
from cellframe.sources.shared import stored

TERMS = ("a", "b", "c", "d", "e", "f")
#: Target cells that a task works out.
CELLS = 250_000


def place(row: Column, col: Column) -> tuple[Column, Column]:
    """Coordinates of a fractional row and column, counted from cell edges, under TERMS."""
    a, b, c, d, e, f = (F.col(t) for t in TERMS)
    return a * col + b * row + c, d * col + e * row + f


def moved(cells: DataFrame, row: Column, col: Column, crs: Crs, source_crs: Crs, allow_approximate: bool) -> DataFrame:
    """``cells`` with x and y, column and row in the source counted from cell centres, of a place on the target."""
    x, y = place(row, col)
    there = reproject(bind(cells, {"x": x, "y": y}), crs, source_crs, allow_approximate)
    u, v = affine_inverse(F.col("x"), F.col("y"), *(F.col(f"s_{t}") for t in TERMS))
    out = bind(there, {"_u": u, "_v": v})
    return out.select(*(c for c in there.columns if c not in ("x", "y")), F.col("_u").alias("x"), F.col("_v").alias("y"))


def beside(grids: DataFrame, source_grids: DataFrame, keys) -> DataFrame:
    """Target grids (one row each) with the terms of their sources."""
    return grids.join(source_grids.select(*keys, *(F.col(t).alias(f"s_{t}") for t in TERMS), F.col("height").alias("s_height"), F.col("width").alias("s_width")), list(keys))


def source_windows(grids: DataFrame, source_grids: DataFrame, crs: Crs, source_crs: Crs, margin: int = 8, steps: int = 21, keys=KEYS, allow_approximate: bool = False) -> DataFrame:
    """Rows r0 to r1 and columns c0 to c1 of the source that a target grid can ask for, clamped to
    the source, by points along the target's edges; no row for a grid that lies apart.

    A map that is continuous takes its extremes over a box on the box's edge; between points
    an edge of a projected box bends by less than the margin.
    """
    t = F.explode(F.sequence(F.lit(0), F.lit(steps + 1))).alias("_i")
    along = beside(grids, source_grids, keys).select("*", t).withColumn("_t", F.col("_i") / float(steps + 1))
    r, c = F.col("_t") * F.col("height"), F.col("_t") * F.col("width")
    zero, bottom, right = F.lit(0.0), F.col("height").cast("double"), F.col("width").cast("double")
    edge = F.explode(F.array(*[F.struct(i.alias("r"), j.alias("c")) for i, j in ((zero, c), (bottom, c), (r, zero), (r, right))])).alias("_p")
    points = moved(along.select("*", edge), F.col("_p.r"), F.col("_p.c"), crs, source_crs, allow_approximate)
    found = points.select(*keys, "s_height", "s_width", "x", "y").groupBy(*keys, "s_height", "s_width").agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"))
    low = lambda v: F.greatest(F.floor(v) - margin, F.lit(0)).cast("int")
    high = lambda v, most: F.least(F.ceil(v) + margin, F.col(most) - 1).cast("int")
    out = found.select(*keys, low(F.col("y0")).alias("r0"), high(F.col("y1"), "s_height").alias("r1"), low(F.col("x0")).alias("c0"), high(F.col("x1"), "s_width").alias("c1"))
    return out.filter("r0 <= r1 and c0 <= c1")


def cells_of(grids: DataFrame) -> int:
    """Number of all cells of grids, a row each."""
    return grids.agg(F.sum(F.col("height").cast("long") * F.col("width"))).first()[0] or 0


def dealt(rows: DataFrame, cells: int) -> DataFrame:
    """``rows`` in as many parts as keep all cores busy, and as leave a task at most CELLS of their ``cells``."""
    return rows.repartition(max(2 * rows.sparkSession.sparkContext.defaultParallelism, -(-cells // CELLS)), "row")


def positions(grids: DataFrame, source_grids: DataFrame, crs: Crs, source_crs: Crs, keys=KEYS, allow_approximate: bool = False) -> DataFrame:
    """Every target cell (trow, tcol) with x and y in the source, counted from cell centres."""
    # cells come out of the grid's own row: its terms need no join by key. A grid is one row, so its rows are dealt
    # out before they become cells, or one task would work out every position
    rows = beside(grids, source_grids, keys).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("height") - 1)))
    cells = dealt(rows, cells_of(grids)).withColumn("col", F.explode(F.sequence(F.lit(0), F.col("width") - 1)))
    out = moved(cells, F.col("row") + 0.5, F.col("col") + 0.5, crs, source_crs, allow_approximate)
    return out.select(*keys, F.col("row").alias("trow"), F.col("col").alias("tcol"), "x", "y")


def warp(
    cells: DataFrame,
    source_grids: DataFrame,
    grids: DataFrame,
    source_crs: Crs,
    crs: Crs,
    method: str = "nearest",
    keys=KEYS,
    complex_values: bool = False,
    allow_approximate: bool = False,
) -> DataFrame:
    """``cells`` (keys, row, col, v, or re and im) on the grids of another system: keys, row, col, v.

    Grids have keys, TERMS, height and width, a row for each layer. Every target cell comes out,
    missing where it lies outside the source or meets missing cells (for bilinear, any it
    uses). Complex values can only be taken as they are. Of a source only the window that its
    target asks for is read: its bounds over all layers are literals, so that they reach the scan, and
    each layer's own are joined, a row a layer.
    """
    grids, source_grids = stored(grids, "grids")[0], stored(source_grids, "source-grids")[0]  # a row a layer, asked for several times
    windows = source_windows(grids, source_grids, crs, source_crs, keys=keys, allow_approximate=allow_approximate)
    r0, r1, c0, c1 = windows.agg(F.min("r0"), F.max("r1"), F.min("c0"), F.max("c1")).first()
    read = cells.filter(F.col("row").between(r0, r1) & F.col("col").between(c0, c1)) if r0 is not None else cells.limit(0)
    read = read.join(windows, list(keys)).filter("row between r0 and r1 and col between c0 and c1").drop("r0", "r1", "c0", "c1")
    shape = source_grids.select(*keys, "height", "width")
    at = positions(grids, source_grids, crs, source_crs, keys, allow_approximate)
    got = resample(at, read, shape, method, keys, complex_values, keep_outside=True)
    return got.withColumnsRenamed({"trow": "row", "tcol": "col"})


def grid_of(cells_shape: DataFrame, terms: tuple[float, float, float, float, float, float]) -> DataFrame:
    """Grids of one transform for layers with height and width."""
    return cells_shape.withColumns({t: F.lit(float(v)) for t, v in zip(TERMS, terms, strict=True)})


