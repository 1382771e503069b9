"""Tiles with a border: the same results at every side, and the steps' counters."""

import math
import random

import pytest

from cellframe.model import densify, shape_of
from cellframe.operators import cleaning, stencils, tiles


def layers(spark, rows_of: dict):
    data = [(k, i, j, v) for k, rows in rows_of.items() for i, line in enumerate(rows) for j, v in enumerate(line)]
    cells = spark.createDataFrame(data, "layer string, row int, col int, v double")
    return cells.join(shape_of(cells), "layer")


def rough(seed, height=19, width=23, holes=0.15):
    r = random.Random(seed)
    return [[None if r.random() < holes else r.choice([r.uniform(0, 20), 90.0, -9999.0, 500.0]) if r.random() < 0.2 else r.uniform(0, 20) for _ in range(width)] for _ in range(height)]


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def stepwise(v, low=-1.0, high=120.0, tolerance=30.0):
    """Cleaning of kind VH written out cell by cell."""
    h, w = len(v), len(v[0])
    counts = {"sentinels": 0, "out_of_range": 0, "spikes": 0, "gaps_filled": 0}
    a = [list(line) for line in v]
    for i in range(h):
        for j in range(w):
            if a[i][j] in cleaning.SENTINELS:
                a[i][j], counts["sentinels"] = None, counts["sentinels"] + 1
            elif a[i][j] is not None and not low <= a[i][j] <= high:
                a[i][j], counts["out_of_range"] = None, counts["out_of_range"] + 1

    def near(b, i, j):
        return [b[y][x] for y, x in ((i, j - 1), (i, j + 1), (i - 1, j), (i + 1, j)) if 0 <= y < h and 0 <= x < w and b[y][x] is not None]

    if min(h, w) > 2:
        b = [list(line) for line in a]
        for i in range(h):
            for j in range(w):
                n = near(b, i, j)
                if b[i][j] is not None and len(n) == 4 and abs(b[i][j] - sum(sorted(n)[1:3]) / 2) > tolerance:
                    a[i][j], counts["spikes"] = None, counts["spikes"] + 1
        for _ in range(2):
            b = [list(line) for line in a]
            for i in range(h):
                for j in range(w):
                    n = near(b, i, j)
                    if b[i][j] is None and len(n) >= 3:
                        a[i][j], counts["gaps_filled"] = sum(n) / len(n), counts["gaps_filled"] + 1
    return a, counts


@pytest.mark.parametrize("side", [3, 8, 128])
def test_cleaning_equals_cell_by_cell_at_every_side(spark, side):
    given = {"a": rough(1), "b": rough(2, holes=0.4), "thin": rough(3, height=2), "none": [[None] * 4] * 4, "bad": [[-9999.0] * 4] * 4}
    cleaned = cleaning.clean_layer(layers(spark, given), "VH", side=side)
    want = {k: stepwise(v) for k, v in given.items()}
    got = {(r.layer, r.row, r.col): r.v for r in cleaned.collect() if r.v is not None}
    expected = {(k, i, j): x for k, (a, _) in want.items() for i, line in enumerate(a) for j, x in enumerate(line) if x is not None}
    assert got == {k: pytest.approx(x) for k, x in expected.items()}
    steps = {r.layer: r.asDict() for r in cleaning.cleaning_steps(cleaned).collect()}
    assert set(steps) == {"a", "b", "thin", "bad"}  # a layer without a cell has none after cleaning
    for k in steps:
        assert {n: steps[k][n] for n in want[k][1]} == want[k][1]
        assert steps[k]["removed_total"] == sum(want[k][1][n] for n in ("sentinels", "out_of_range", "spikes"))
    assert steps["bad"]["empty_reason"] == "every value was removed"
    assert steps["a"]["empty_reason"] is None


def test_two_passes_reach_over_a_border(spark):
    rows = [[1.0] * 9 for _ in range(9)]
    for i, j in ((3, 3), (3, 4), (4, 4)):
        rows[i][j] = None
    for side in (4, 128):
        got = cleaning.clean_layer(layers(spark, {"a": rows}), "VH", side=side)
        assert got.filter("filled").count() == 3


@pytest.mark.parametrize("side", [4, 128])
def test_terrain_equals_windows(spark, side):
    rows = [[None if (i * 7 + j) % 23 == 0 else math.sin(i) * 5 + j for j in range(11)] for i in range(10)]
    cells = layers(spark, {"a": rows, "flat": [[2.0] * 5] * 5})
    dense = densify(cells.drop("height", "width"), shape_of(cells))
    slopes = stencils.slope_aspect(dense, 3.0).filter("v is not null").selectExpr("layer", "row", "col", "round(slope, 9)", "round(aspect, 9)")
    normals = stencils.surface_normals(dense, 3.0).filter("v is not null").selectExpr("layer", "row", "col", "round(nx, 9) + 0.0", "round(ny, 9) + 0.0", "round(nz, 9)")
    got = tiles.terrain(cells, 3.0, side=side)
    clean = "round(nullif(slope, double('nan')), 9)", "round(nullif(aspect, double('nan')), 9)"
    assert rows_of(got.selectExpr("layer", "row", "col", *clean)) == rows_of(slopes)
    assert rows_of(got.selectExpr("layer", "row", "col", "round(nx, 9) + 0.0", "round(ny, 9) + 0.0", "round(nz, 9)")) == rows_of(normals)


def test_one_exchange_and_empty_tables(spark):
    cells = layers(spark, {"a": rough(4)})
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        whole = cleaning.clean_layer(spark.createDataFrame(cells.collect(), cells.schema), "VH")
        plan = whole._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 1
    assert cleaning.clean_layer(cells.limit(0), "VH").count() == 0
    assert tiles.terrain(cells.limit(0), 3.0).count() == 0
