"""Square tiles with a border of neighbours: several stencils over a layer for one exchange.

A cell goes to its tile and to those whose border it is in, so a tile is an array of at most
(side + 2 * border) squared cells whatever the layer's size, and every pass over it is done in place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.model import KEYS

SIDE = 128


def dealt(cells: DataFrame, border: int, side: int = SIDE) -> DataFrame:
    """``cells`` (row, col, height, width) with the tile (trow, tcol), once for each tile or border
    that they are in."""

    def tiles(at: str, size: str) -> Column:
        last = F.floor((F.col(size) - 1) / side)
        first = F.greatest(F.floor((F.col(at) - border) / side), F.lit(0))
        return F.explode(F.sequence(first, F.least(F.floor((F.col(at) + border) / side), last)))

    return cells.withColumn("trow", tiles("row", "height")).withColumn("tcol", tiles("col", "width"))


class Tile:
    """Values of a tile and its border (NaN: missing), and where in its layer they are."""

    def __init__(self, pdf: pd.DataFrame, border: int, side: int, value: str):
        self.border = border
        self.height, self.width = int(pdf["height"].iat[0]), int(pdf["width"].iat[0])
        self.top, self.left = int(pdf["trow"].iat[0]) * side, int(pdf["tcol"].iat[0]) * side
        self.rows, self.cols = min(side, self.height - self.top), min(side, self.width - self.left)
        self.v = np.full((self.rows + 2 * border, self.cols + 2 * border), np.nan)
        row, col = pdf["row"].to_numpy() - self.top + border, pdf["col"].to_numpy() - self.left + border
        self.v[row, col] = pdf[value].to_numpy(dtype=float, na_value=np.nan)

    def inner(self, a: np.ndarray) -> np.ndarray:
        return a[self.border : self.border + self.rows, self.border : self.border + self.cols]

    def repeated(self, a: np.ndarray) -> np.ndarray:
        """The tile and one cell around it; beyond the layer's edge the edge is repeated."""
        r = np.arange(self.top - 1, self.top + self.rows + 1).clip(0, self.height - 1) - self.top + self.border
        c = np.arange(self.left - 1, self.left + self.cols + 1).clip(0, self.width - 1) - self.left + self.border
        return a[np.ix_(r, c)]


def applied(cells: DataFrame, work: Callable[[Tile, pd.DataFrame], dict[str, np.ndarray]], schema: str, border: int, keys=KEYS, side: int = SIDE, value: str = "v", extra: tuple[str, ...] = ()) -> DataFrame:
    """``work``'s arrays, each the size of the tile without its border, as columns of cells.

    ``cells`` is (keys, row, col, value, height, width) and may be sparse; one row a cell. ``work`` gets the
    tile and its rows (with ``extra`` columns, the same all over a layer). Cells in which all of
    its arrays are missing are not returned, and a tile without any cell in or next to it isn't made.
    """
    keys = list(keys)
    kinds = ", ".join(f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys)
    few = cells.select(*keys, "row", "col", value, "height", "width", *extra)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        tile = Tile(pdf, border, side, value)
        arrays = work(tile, pdf)
        some = np.logical_or.reduce([pd.notna(a) for a in arrays.values()])
        row, col = np.nonzero(some)
        out = {k: pd.Series([pdf[k].iat[0]] * len(row), dtype=object) for k in keys}
        out |= {"row": row + tile.top, "col": col + tile.left}
        return pd.DataFrame(out | {n: pd.Series(a[some], dtype=a.dtype) for n, a in arrays.items()})

    return dealt(few, border, side).groupBy(*keys, "trow", "tcol").applyInPandas(one, f"{kinds}, row int, col int, {schema}")


def cross(a: np.ndarray) -> Iterator[np.ndarray]:
    """Left, right, upper and lower neighbours; missing around the array."""
    p = np.pad(a, 1, constant_values=np.nan)
    yield from (p[1:-1, :-2], p[1:-1, 2:], p[:-2, 1:-1], p[2:, 1:-1])


def spikes(a: np.ndarray, tolerance: float) -> np.ndarray:
    """Where a cell is further than ``tolerance`` from the median of its four neighbours, all there."""
    near = np.stack(list(cross(a)))
    median = (near.sum(axis=0) - near.min(axis=0) - near.max(axis=0)) / 2  # missing if one of them is
    return np.abs(a - median) > tolerance


def filled(a: np.ndarray, passes: int) -> np.ndarray:
    """Missing cells with three neighbours or more at their mean; ends with the first pass without any."""
    for _ in range(passes):
        near = np.stack(list(cross(a)))
        n = (~np.isnan(near)).sum(axis=0)
        holes = np.isnan(a) & (n >= 3)
        if not holes.any():
            break
        a = np.where(holes, np.nansum(near, axis=0) / np.maximum(n, 1), a)
    return a


def horn(p: np.ndarray, res: float) -> tuple[np.ndarray, np.ndarray]:
    """Slopes to the east and north of an array with one more cell on each side."""
    across, along = p[:, 2:] - p[:, :-2], p[:, :-2] + 2 * p[:, 1:-1] + p[:, 2:]
    return (across[:-2] + 2 * across[1:-1] + across[2:]) / (8 * res), (along[:-2] - along[2:]) / (8 * res)


def terrain(cells: DataFrame, res: float, keys=KEYS, side: int = SIDE) -> DataFrame:
    """Slope, aspect (degrees) and unit normals nx, ny, nz of each cell that is there, in one pass.

    ``cells`` is (keys, row, col, v, height, width). Edges repeat. For slope and aspect a missing
    neighbour makes both missing; for normals it counts as the layer's mean. Flat cells have no aspect.
    """
    from cellframe.operators.stencils import FLAT

    means = cells.groupBy(*keys).agg(F.avg("v").alias("mean"))  # a row a layer

    def work(tile: Tile, pdf: pd.DataFrame) -> dict[str, np.ndarray]:
        there = ~np.isnan(tile.inner(tile.v))
        east, north = horn(tile.repeated(tile.v), res)
        steep = np.hypot(east, north)
        turn = np.degrees(np.arctan2(-east, -north)) % 360.0
        turn[turn >= 360.0] = 0.0
        whole = np.where(np.isnan(tile.v), float(pdf["mean"].iat[0]), tile.v)
        x, y = horn(tile.repeated(whole), res)
        length = np.sqrt(x * x + y * y + 1)
        out = {"slope": np.degrees(np.arctan(steep)), "aspect": np.where(steep >= FLAT, turn, np.nan), "nx": -x / length, "ny": -y / length, "nz": 1 / length}
        return {n: np.where(there, a, np.nan) for n, a in out.items()}

    some = cells.join(means, list(keys))
    return applied(some, work, "slope double, aspect double, nx double, ny double, nz double", 1, keys, side, extra=("mean",))
