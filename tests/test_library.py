"""Names, sources, matching and the driver's contract."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cellframe.functions import names
from cellframe.operators import blocks, matching
from cellframe.plans import checks, fixtures
from cellframe.sources import rasters, texts


def test_every_sql_has_a_query():
    q, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(q)
    assert len(q) > 80


def test_entry_has_rows(spark):
    assert __spark_entry__.entry(spark).count() > 0


SMALL = "/root/testdata/sf0.001"


def test_gbt_loso_leaves_out_each_site(spark):
    got = __spark_entry__.queries()["gbt_loso"](spark, SMALL)
    sites = {r.site for r in fixtures.samples(spark, SMALL).select("site").distinct().collect()}
    assert len(sites) > 2
    assert sorted((r.site, r.features) for r in got.collect()) == sorted((s, f) for s in sites for f in ("all", "no_retail"))


def test_sampled_blocks_finds_wrong_codes(spark, monkeypatch):
    assert {r.fine for r in checks.sampled_blocks(spark, SMALL).collect()} == {True}
    right = blocks.block_mean
    monkeypatch.setattr(blocks, "block_mean", lambda *a: right(*a).withColumn("mean", F.col("mean") + 5))
    assert {r.fine for r in checks.sampled_blocks(spark, SMALL).collect() if r.code > 0} == {False}


def test_survey_names(spark):
    df = spark.createDataFrame([("X_QSI_sd_3M_ab_20200101_20200102.tif",), ("X_QSI_sd_10M_ab_20200101_20200102.tif",), ("short",), (None,)], "n string")
    got = [r.p for r in df.select(names.survey_name(F.col("n")).alias("p")).collect()]
    assert got[0] == ("SD", "AB", dt.date(2020, 1, 1), dt.date(2020, 1, 2))
    assert got[1:] == [None, None, None]


def test_annotations(spark):
    lines = [("f", 0, "Peg Heading (deg) = -12.5 ; note"), ("f", 1, "no value"), ("f", 2, "peg heading (deg) = 3"), ("f", 3, "Name = a=b")]
    got = {r.key: (r.units, r.value, r.number) for r in texts.annotations(spark.createDataFrame(lines, "file string, n int, line string")).collect()}
    assert got == {"peg heading": ("deg", "3", 3.0), "name": (None, "a=b", None)}


def test_footprints(spark):
    j = '{"SpatialExtent":{"HorizontalSpatialDomain":{"Geometry":{"GPolygons":[{"Boundary":{"Points":[{"Longitude":0,"Latitude":0},{"Longitude":1,"Latitude":0},{"Longitude":1,"Latitude":1}]}},{"Boundary":{"Points":[]}}],"BoundingRectangles":[{"WestBoundingCoordinate":0}]}}}}'
    df = spark.createDataFrame([(j,), ("{}",)], "j string").select(texts.footprints(F.col("j")).alias("p"))
    assert [len(r.p) for r in df.collect()] == [1, 0]


def test_fixed_width_window(spark, tmp_path):
    import numpy as np

    np.arange(12, dtype="<f4").tofile(tmp_path / "x.grd")
    got = rasters.scan_fixed_width(spark, str(tmp_path / "x.grd"), 3, 4, r0=1, c0=1, nr=2, nc=2)
    assert sorted((r.row, r.col, r.v) for r in got.collect()) == [(1, 1, 5.0), (1, 2, 6.0), (2, 1, 9.0), (2, 2, 10.0)]


def test_shapes_are_reconciled(spark):
    f = spark.createDataFrame([(16046 * 24941 * 4, 16045, 24939, 4), (12345, 100, 200, 4)], "bytes long, rows int, cols int, itemsize int")
    got = [(r.fixed_rows, r.fixed_cols) for r in rasters.reconcile_shape(f).orderBy(F.desc("bytes")).collect()]
    assert got == [(16046, 24941), (None, None)]


def test_resume_leaves_out_what_is_done(spark):
    plan = spark.createDataFrame([("a", "1"), ("b", "1")], "layer string, content_key string")
    assert [r.layer for r in rasters.resume(plan, plan.filter("layer = 'a'")).collect()] == ["b"]


def _surveys(spark, gap, x):
    ring = lambda x: [(x, 0.0), (x + 1, 0.0), (x + 1, 1.0), (x, 1.0)]
    day = dt.date(2020, 2, 1)
    poly = "array<struct<x:double,y:double>>"
    g = spark.createDataFrame([(1, "g", day, day, ring(0.0))], f"site int, granule string, begin date, end date, ring {poly}")
    p = spark.createDataFrame([(1, "p", day + dt.timedelta(gap), day + dt.timedelta(gap + 7), ring(x))], f"site int, scene string, ref date, sec date, ring {poly}")
    return matching.match_surveys(g, p).count()


def test_match_window_and_footprints(spark):
    assert [_surveys(spark, g, 0.5) for g in (5, 6)] == [1, 0]
    assert _surveys(spark, 0, 3.0) == 0


def test_nearest_date_takes_the_earlier_of_two(spark):
    t = spark.createDataFrame([(1, dt.date(2020, 1, 3)), (2, dt.date(2020, 1, 3))], "site int, target date")
    c = spark.createDataFrame([(1, dt.date(2020, 1, 1)), (1, dt.date(2020, 1, 5)), (1, dt.date(2020, 2, 1))], "site int, candidate date")
    assert [(r.site, r.candidate) for r in matching.nearest_date(t, c).orderBy("site").collect()] == [(1, dt.date(2020, 1, 1)), (2, None)]


def test_hulls_of_batches_merge(spark):
    import math
    import random

    pick = random.Random(9)
    inner = [(pick.uniform(-70, 70), pick.uniform(-70, 70)) for _ in range(3000)]
    rim = [(100 * math.cos(t / 50 * math.tau), 100 * math.sin(t / 50 * math.tau)) for t in range(50)]
    rows = [(1, *p) for p in inner + rim + rim] + [(None, 0.0, 0.0), (None, 2.0, 0.0), (None, 1.0, 0.0), (2, None, 1.0), (3, 5.0, 5.0), (3, 5.0, 5.0)]
    points = spark.createDataFrame(rows, "site int, x double, y double").repartition(7)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = matching.hull(points, ["site"]).orderBy("site", "n").collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert {(r.x, r.y) for r in got if r.site == 1} == set(rim)
    around = [math.atan2(r.y, r.x) for r in got if r.site == 1]
    assert sum(b < a for a, b in zip(around, around[1:])) == 1 or around == sorted(around)
    assert [(r.x, r.y) for r in got if r.site is None] == [(0, 0), (2, 0)]
    assert [(r.x, r.y) for r in got if r.site == 3] == [(5, 5)]
    assert not [r for r in got if r.site == 2]


def test_hull_leaves_out_inner_points(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (1, 2.0, 0.0), (1, 2.0, 2.0), (1, 0.0, 2.0), (1, 1.0, 1.0)], "site int, x double, y double")
    assert [(r.x, r.y) for r in matching.hull(p, ["site"]).orderBy("n").collect()] == [(0, 0), (2, 0), (2, 2), (0, 2)]


def test_ingest_stores_each_cell_once_and_loses_none(spark, tmp_path):
    from cellframe.streaming.ingest import ingest, read_cells

    schema = "site string, layer string, content_key string, row int, col int, v double"
    src, out, mark = (str(tmp_path / x) for x in ("in", "out", "mark"))
    first, late, other = ("s", "a", "1", 0, 0, 1.0), ("s", "a", "1", 0, 1, 3.0), ("s", "b", "1", 0, 0, 2.0)
    spark.createDataFrame([first, first], schema).write.parquet(src)
    ingest(spark, src, out, mark, schema).awaitTermination()
    spark.createDataFrame([first, late, other], schema).write.mode("append").parquet(src)
    ingest(spark, src, out, mark, schema).awaitTermination()
    ingest(spark, src, out, mark + "-again", schema).awaitTermination()
    assert sorted((r.layer, r.col, r.v) for r in read_cells(spark, out).collect()) == [("a", 0, 1.0), ("a", 1, 3.0), ("b", 0, 2.0)]


def test_long_chains_are_followed(spark):
    from cellframe.operators.audit import empty_chains

    n = 10_000
    layers = spark.range(n + 1).selectExpr("id AS layer", f"if(id < {n}, id + 1, null) AS derived_from", "0 AS valid", f"if(id = {n}, 'dry', null) AS reason")
    assert {(r.layer, r.explained, r.steps) for r in empty_chains(layers).collect()} == {(i, True, n - i) for i in range(n + 1)}


def test_chains_and_circles_equal_a_walk(spark):
    import random

    from cellframe.operators.audit import derivation_ends, empty_verdicts

    pick = random.Random(5)
    links = {i: pick.choice([None, 999, pick.randrange(80), pick.randrange(80), i if i % 19 == 0 else i - 1]) for i in range(80)}
    ends = {i: pick.random() < 0.1 for i in links}
    layers = spark.createDataFrame([(i, links[i], ends[i]) for i in links] + [(None, 3, False)], "layer long, derived_from long, stop boolean")

    def walk(i):
        seen = [i]
        while not ends[seen[-1]] and links[seen[-1]] in links:
            step = links[seen[-1]]
            if step in seen:
                return min(seen[seen.index(step) :]), len(seen) - 1, True
            seen.append(step)
        return seen[-1], len(seen) - 1, False

    got = {r.layer: (r.end, r.steps, r.circular) for r in derivation_ends(layers, F.col("stop")).collect()}
    assert got == {i: walk(i) for i in links}
    assert len({c for _, _, c in got.values()}) == 2
    schema = "site long, layer string, leaf string, derived_from string, valid int, reason string, zero_mask string, zeros_masked long"
    rows = [
        (1, "a", "unw", None, 0, "unwrapper_zero_fill", "applied", 3), (1, "b", "unw", None, 0, "unwrapper_zero_fill", "applied", 0), (1, "c", "cor", None, 0, "unwrapper_zero_fill", "applied", 3),
        (1, "d", "hgt", "a", 0, "no_valid_input_cells", None, None), (1, "e", "hgt", "full", 0, "no_valid_input_cells", None, None), (1, "f", "hgt", "g", 0, "no_valid_input_cells", None, None),
        (1, "g", "hgt", "f", 0, "no_valid_input_cells", None, None), (1, "h", "hgt", "gone", 0, None, None, None), (1, "full", "hgt", None, 9, None, None, None), (1, "odd", "hgt", "a", None, "no_valid_input_cells", None, None),
    ]
    found = {r.layer: r.severity for r in empty_verdicts(spark.createDataFrame(rows, schema)).collect()}
    assert found == {"a": "warn", "b": "fail", "c": "fail", "d": "warn", "e": "fail", "f": "fail", "g": "fail", "h": "fail"}
    assert empty_verdicts(spark.createDataFrame([], schema)).count() == 0


def test_rotated_grids_are_refused(spark):
    from cellframe.functions.geometry import north_up

    grids = spark.createDataFrame([(3.0, 0.0, 0.0, -3.0), (3.0, 0.5, 0.0, -3.0)], "a double, b double, d double, e double")
    assert north_up(grids.filter("b = 0")).count() == 1
    with pytest.raises(Exception, match="rotated"):
        north_up(grids).collect()
