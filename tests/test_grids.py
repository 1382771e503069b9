"""Layers: hand-worked results and invariants."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.functions import geometry, values
from cellframe.model import densify, finite, shape_of
from cellframe.operators import blocks, cleaning, compare, components, regrid, stats, stencils


def layer(spark, rows):
    data = [("a", i, j, None if v is None else float(v)) for i, line in enumerate(rows) for j, v in enumerate(line)]
    return spark.createDataFrame(data, "layer string, row int, col int, v double")


def dense(cells):
    return densify(cells, shape_of(cells))


def at(df, column, row, col):
    return df.filter((F.col("row") == row) & (F.col("col") == col)).first()[column]


def test_non_finite_is_missing(spark):
    df = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "v double").select(finite(F.col("v")).alias("v"))
    assert [r.v for r in df.collect()] == [1.0, None, None]


@pytest.mark.parametrize("bearing", [0, 45, 90, 135, 180, 225, 270, 315])
def test_plane_slopes_down_towards_its_bearing(spark, bearing):
    b = math.radians(bearing)
    rows = [[-(math.sin(b) * 3 * j - math.cos(b) * 3 * i) for j in range(5)] for i in range(5)]
    r = stencils.slope_aspect(dense(layer(spark, rows)), 3.0).filter("row = 2 and col = 2").first()
    assert r.slope == pytest.approx(45)
    assert min(abs(r.aspect - bearing), 360 - abs(r.aspect - bearing)) < 1e-6


def test_hole_spreads_and_edge_repeats(spark):
    rows = [[float(i + j) for j in range(5)] for i in range(5)]
    rows[2][2] = None
    s = stencils.slope_aspect(dense(layer(spark, rows)), 1.0)
    assert at(s, "slope", 1, 1) is None
    assert at(s, "slope", 2, 2) is None
    assert at(s, "slope", 0, 0) == pytest.approx(math.degrees(math.atan(math.hypot(0.5, 0.5))))


def test_flat_has_no_aspect(spark):
    r = stencils.slope_aspect(dense(layer(spark, [[1] * 3] * 3)), 1.0).filter("row = 1 and col = 1").first()
    assert (r.slope, r.aspect) == (0.0, None)


def test_box_fraction_has_eleven_cells_a_side(spark):
    rows = [[0.0] * 21 for _ in range(21)]
    rows[10][10] = 3.0
    f = stencils.box_fraction(dense(layer(spark, rows)), F.col("v") >= 2, 10)
    assert at(f, "fraction", 10, 10) == pytest.approx(1 / 121)
    assert at(f, "fraction", 0, 0) == 0


def test_one_spike_costs_one_cell_and_is_filled(spark):
    rows = [[10.0] * 5 for _ in range(5)]
    rows[2][2] = 500.0
    screened = cleaning.spike_screen(dense(layer(spark, rows)), F.lit(25.0))
    assert screened.filter("v is null").count() == 1
    assert at(cleaning.fill_gaps(screened), "v", 2, 2) == 10.0


def test_large_hole_is_not_filled(spark):
    rows = [[None if 0 < i < 6 and 0 < j < 6 else 1.0 for j in range(7)] for i in range(7)]
    assert at(cleaning.fill_gaps(dense(layer(spark, rows))), "v", 3, 3) is None


def test_circular_mean_wraps_and_cancels(spark):
    both = {k: blocks.block_circular_mean(layer(spark, [v]).withColumns({"height": F.lit(2), "width": F.lit(2)}).withColumn("row", F.lit(0)), 2).first() for k, v in {"wrap": [359, 1], "cancel": [0, 180]}.items()}
    assert both["wrap"].direction == pytest.approx(0, abs=1e-9)
    assert both["cancel"].direction is None


def test_overlap_average_and_classes(spark):
    eight = layer(spark, np.arange(64).reshape(8, 8).tolist())
    assert blocks.overlap_average(blocks.overlaps(eight, 8.0, 0, 0, 1, 1)).first()["mean"] == 31.5
    two = layer(spark, [[0, 10]])
    got = {r.tcol: r["mean"] for r in blocks.overlap_average(blocks.overlaps(two, 2.0, 0, -0.5, 1, 2)).collect()}
    assert got[0] == pytest.approx(10 / 3)
    tie = layer(spark, [[0, 1]])
    assert blocks.overlap_majority(blocks.overlaps(tie, 2.0, 0, 0, 1, 1)).first()["class"] == 1
    assert blocks.overlap_mode(blocks.overlaps(layer(spark, [[-1, 1]]), 2.0, 0, 0, 1, 1)).first()["class"] is None


def test_codes_round_trip_within_half_a_step(spark):
    df = spark.createDataFrame([(x / 7,) for x in range(50)], "v double")
    back = values.dequantise(values.quantise(F.col("v"), F.lit(0.0), F.lit(7.0), 8), F.lit(0.0), F.lit(7.0), 8)
    assert df.select(F.max(F.abs(back - F.col("v")))).first()[0] <= 7 / 254 / 2 + 1e-9


def test_same_grid_resamples_to_itself(spark):
    g = layer(spark, [[1, 2], [3, None]])
    t = g.select("layer", F.col("row").alias("trow"), F.col("col").alias("tcol"), F.col("col").cast("double").alias("x"), F.col("row").cast("double").alias("y"))
    for method in ("nearest", "bilinear"):
        got = {(r.trow, r.tcol): r.v for r in regrid.resample(t, g, shape_of(g), method).collect()}
        assert got == {(0, 0): 1, (0, 1): 2, (1, 0): 3, (1, 1): None}
    with pytest.raises(ValueError):
        regrid.resample(t, g, shape_of(g), "bilinear", complex_values=True)


def test_despeckle_keeps_large_and_single_components(spark):
    rows = [[1.0 if j < 6 or (i, j) == (150, 9) else None for j in range(10)] for i in range(260)]
    out = components.despeckle(layer(spark, rows), 5)
    assert out.filter("v is not null").count() == 260 * 6
    alone = components.despeckle(layer(spark, [[1, None], [None, None]]), 5)
    assert alone.filter("v is not null").count() == 1


def test_modes_of_comparison(spark):
    a, b = layer(spark, [[350.0, 1.0]]), layer(spark, [[10.0, None]])
    assert [r.d for r in compare.compare(a, b, "degrees").collect()] == [20.0]
    assert compare.layer_equality(a, a).first().verdict == "identical"
    assert compare.layer_equality(a, b).first().verdict == "different"


def test_stretch_of_constant_is_padded(spark):
    r = stats.stretch(layer(spark, [[5, 5]]), 2, 98).first()
    assert r.lo < 5 < r.hi


def test_projection_of_the_central_meridian(spark):
    df = spark.createDataFrame([(-105.0, 0.0), (-105.0, 45.0)], "lon double, lat double")
    x, y = geometry.utm(F.col("lon"), F.col("lat"), 13)
    got = df.select(x.alias("x"), y.alias("y")).collect()
    assert got[0].x == pytest.approx(500000, abs=1e-6) and got[0].y == pytest.approx(0, abs=1e-6)
    assert got[1].y == pytest.approx(4982950.400, abs=0.01)  # 0.9996 of the meridian arc


def test_even_shares_are_ties_whatever_the_order_of_sums(spark):
    w = spark.createDataFrame([("a", 0, 0, 0, 0.1), ("a", 0, 0, 0, 0.2), ("a", 0, 0, 0, 0.3), ("a", 0, 0, 1, 0.6)], "layer string, trow int, tcol int, v int, w double").coalesce(1)
    assert blocks.overlap_majority(w).first()["class"] == 1
    assert blocks.overlap_mode(w).first()["class"] is None
