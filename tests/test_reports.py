"""Tables of reports and inventories: what nulls, ties, empty tables and odd names give."""

import pytest
from pyspark.sql import functions as F

from cellframe.functions import names
from cellframe.operators import matching, reports, samples, scenes


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*(columns or df.columns)).collect()), key=str)


def test_area_takes_the_first_of_two_as_near_and_sums_up(spark):
    layers = spark.createDataFrame(
        [("a", "LIDAR/y", 90), ("a", "LIDAR/x", 110), ("a", "LIDAR/DERIVED/z", 100), ("b", "LIDAR/x", 50), ("c", "LIDAR/x", 1)], "site string, layer string, valid long"
    )
    known = spark.createDataFrame([("a", 100.0), ("b", 50.0), ("d", 7.0)], "site string, reference double")
    got = {r["site"]: r for r in reports.area_agreement(layers, known, 1000.0, tolerance=10.5).collect()}
    assert set(got) == {"a", "b", None}
    assert got["a"]["layer"] == "LIDAR/x" and got["a"]["fine"]
    assert got[None]["area_km2"] == 160 and got[None]["reference"] == 150 and not got[None]["fine"]
    none = reports.area_agreement(layers.limit(0), known, 1.0).collect()
    assert [tuple(r) for r in none] == [(None,) * 6]


def test_random_split_stands_beside_and_not_among_sites(spark):
    r = spark.createDataFrame(
        [("s1", 3, "m", "all", 0.5), ("s2", 3, "m", "all", 0.7), ("split", 3, "m", "all", 0.9), ("s1", 9, "m", "all", 0.1)], "site string, scale int, model string, features string, r2 double"
    ).withColumns({"rmse": F.lit(1.0), "skill": F.lit(0.0)})
    got = {x["scale"]: x for x in reports.scale_table(r, "split").collect()}
    assert got[3]["mean_r2"] == pytest.approx(0.6) and got[3]["random_split_r2"] == 0.9
    assert got[9]["random_split_r2"] is None


def test_losses_have_no_share_and_radar_is_one_group(spark):
    i = [(3, "f", "HH_cor", 0.02), (3, "g", "HH_cor", 0.04), (3, "f", "inc_local", 0.01), (3, "f", "slope", -0.5), (9, "f", "slope", -0.1), (9, "f", "gap_days", None)]
    got = {(r["scale"], r["feature"]): r for r in reports.importance_table(spark.createDataFrame(i, "scale int, model string, feature string, increase double"), ["f", "g"]).collect()}
    assert got[3, "HH_cor"]["cm"] == pytest.approx(3) and got[3, "HH_cor"]["share"] == pytest.approx(0.75)
    assert got[3, "HH_cor"]["group_share"] == pytest.approx(1) and got[3, "inc_local"]["group_share"] == pytest.approx(1)
    assert got[3, "slope"]["share"] == 0 and got[3, "slope"]["rank"] == 3
    assert got[9, "slope"]["share"] == 0 and got[9, "gap_days"]["cm"] is None and got[9, "gap_days"]["rank"] == 2


def test_summary_lacks_what_a_site_lacks(spark):
    r = spark.createDataFrame([("a", "f", 0.12345, 1.0, 0.1), ("a", "g", 0.5, 2.0, 0.2), ("b", "f", 0.25, None, 0.3)], "site string, model string, r2 double, rmse double, bias double")
    got = {x["site"]: x for x in reports.summary_table(r, ["f", "g"]).collect()}
    assert got["a"]["f_r2"] == 0.123 and got["b"]["f_rmse"] is None and got["b"]["g_bias"] is None


def test_contents_of_sites_known_from_one_table_alone(spark):
    tree = spark.createDataFrame([("a", "group", {"k": "v"}), ("a", "dataset", None), ("a", None, {})], "site string, kind string, attrs map<string,string>")
    own = spark.createDataFrame([("b", {"x": "1", "y": "2"})], "site string, attrs map<string,string>")
    layers = spark.createDataFrame([("c", "snow_depth"), ("c", None)], "site string, leaf string")
    assert rows(reports.site_contents(tree, own, layers)) == [("a", 0, 1, 1, 1, False), ("b", 0, 0, 0, 2, False), ("c", 2, 0, 0, 0, True)]


def test_bands_remove_the_bias_of_their_own_site(spark):
    b = spark.createDataFrame([(0, 0, 0, 3.0, 1.0, 1.0), (0, 0, 1, 5.0, 1.0, 1.0), (1, 0, 0, 2.0, None, 2.0)], "site int, brow int, bcol int, boost double, forest double, label double")
    got = {(r["site"], r["bcol"], r["band"]): r["v"] for r in reports.prediction_bands(b).collect()}
    assert got[0, 0, "boosting_debiased"] == 0 and got[0, 1, "boosting_debiased"] == 2 and got[1, 0, "boosting_debiased"] == 2
    assert got[0, 1, "boosting_error"] == 4 and got[1, 0, "forest"] is None and len(got) == 15


def test_known_omissions_are_notes(spark):
    granules = spark.createDataFrame([("a", "SD", "f1"), ("a", "SWE", "f2"), ("b", None, "f3"), ("b", "SD", "f4")], "site string, product string, filename string")
    layers = spark.createDataFrame([("a", "LIDAR/f1"), ("a", "LIDAR/DERIVED/slope"), ("b", "LIDAR/f3"), ("z", "LIDAR/x")], "site string, layer string")
    sites = spark.createDataFrame([("a",), ("b",), ("c",)], "site string")
    assert rows(reports.inventory_agreement(sites, granules, layers)) == [("a", "f2", "omission", "note", "SWE"), ("b", None, "inventory", "fail", "1/2")]
    assert reports.inventory_agreement(sites, granules.limit(0), layers.limit(0)).isEmpty()


def test_types_of_cells(spark):
    layers = spark.createDataFrame([("a", "1", "int", "complex64"), ("a", "2", "int", None), ("a", "3", "coherence_mask", "float32"), ("a", "4", "cor", "int8"), ("a", "5", None, "x")], "site string, layer string, leaf string, dtype string")
    assert rows(reports.stored_types(layers), "layer", "detail") == [("2", "none/complex64"), ("3", "float32/uint8")]


def test_columns_of_matches_of_unequal_length(spark):
    c = spark.createDataFrame([("a", ["d1", "d2"], ["3", "x"], ["s1"]), ("b", None, [], None)], "site string, date array<string>, gap_days array<string>, flight array<string>")
    got = reports.match_records(c)
    assert got.schema["gap_days"].dataType.simpleString() == "int"
    assert rows(got) == [("a", "d1", 3, "s1"), ("a", "d2", None, None)]
    assert rows(reports.match_records(c.drop("flight")), "scene") == [("",), ("",)]


def test_originals_replace_whole_records(spark):
    mine = spark.createDataFrame([("1", "A", 5), ("2", "B", 6), (None, "C", 7)], "file_id string, level string, bytes long")
    original = spark.createDataFrame([("1", None, 9, "sum"), ("1", "Z", 9, "sum"), ("9", "Q", 1, "q")], "file_id string, level string, bytes long, checksum string")
    got = {r["file_id"]: r for r in reports.preferred_products(mine, original).collect()}
    assert tuple(got["1"]) == ("1", None, 9, "sum", True)
    assert tuple(got["2"]) == ("2", "B", 6, None, False) and got[None]["level"] == "C" and len(got) == 3


def test_recorded_but_not_discovered(spark):
    found = spark.createDataFrame([("a", "1", "x"), ("a", "2", "y")], "site string, filename string, note string")
    recorded = spark.createDataFrame([("a", "2"), ("a", "3"), ("a", "3"), ("b", "1")], "site string, filename string")
    kept, unknown = reports.recorded_granules(found, recorded)
    assert rows(kept) == [("a", "2", "y")] and rows(unknown) == [("a", "3"), ("b", "1")]


def test_annotation_types(spark):
    said = {"bandwidth": " 80.5 ", "peg heading": "12d", "number of looks in range": "4.0", "number of looks in azimuth": "+12", "radar look direction": " Left ", "global average altitude": "1e4", "other": "7"}
    eav = spark.createDataFrame([("f", k, v) for k, v in said.items()] + [("g", "other", "1")], "file string, key string, value string")
    (got,) = scenes.annotation_table(eav).collect()
    assert (got.radar_bandwidth_mhz, got.peg_heading_deg, got.looks_range, got.looks_azimuth) == (80.5, None, None, 12)
    assert (got.radar_look_direction, got.platform_altitude_m, got.baseline_iterations) == ("Left", 10000.0, None) and len(got) == 20


@pytest.mark.parametrize(
    ("path", "leaf", "label"),
    [
        ("science/UAVSAR/20200101_20200102/L1/HH/cor", "cor", "Coherence  ·  2020-01-01 → 2020-01-02  ·  L1  ·  HH"),
        ("science/UAVSAR/20200101_20200102/cor", "cor", "Coherence  ·  2020-01-01 → 2020-01-02"),
        ("science/UAVSAR/INT/a_b_20200101_20200101/cor", "cor", "Coherence  ·  2020-01-01  ·  a_b"),
        ("science/UAVSAR/INT/L2_20200101/VV/int", "int", "Interferogram  ·  2020-01-01  ·  L2  ·  VV"),
        ("science/LIDAR/VH/20200101/x", "x", "x  ·  2020-01-01"),
        ("science/LIDAR/L_20200101/x_20200102", "x", "x"),
        ("science/UAVSARX/20200101/HH/x", "x", "x  ·  2020-01-01"),
        ("x", "x", "x"),
    ],
)
def test_labels(spark, path, leaf, label):
    assert spark.range(1).select(names.layer_label(F.lit(path), F.lit(leaf))["label"]).first()[0] == label


def test_labels_of_nothing_and_with_a_suffix(spark):
    one = spark.range(1)
    got = one.select(names.layer_label(F.lit("a/20200101/cor"), F.lit("cor"), F.lit("(mean)")).alias("l")).select("l.*").first()
    assert tuple(got) == ("Coherence (mean)  ·  2020-01-01", "Coherence (mean)", "", "2020-01-01", "")
    assert one.select(names.layer_label(F.lit(None).cast("string"), F.lit("cor"))["label"]).first()[0] == "Coherence"


def test_units_of_one_kind_of_layer(spark):
    wording = "1 = usable, 0 = decorrelated, 255 = nodata"
    units = spark.createDataFrame([(wording, "coherence_mask"), (wording, "cor"), (f"coherence_mask: {wording}", "cor"), ("degree_C", "t"), ("degrees true", "t"), (" ", "t")], "u string, leaf string")
    got = [r[0] for r in units.select(names.display_unit(F.col("u"), F.col("leaf"))).collect()]
    assert got == ["", wording, f"coherence_mask: {wording}", "degree_C", "°", ""]


def test_canopy_of_the_nearest_date(spark):
    scene = spark.createDataFrame([(0, 5, 0, 0, 1.0), (1, 5, 0, 0, 1.0)], "site int, scene int, brow int, bcol int, inc_coverage double")
    day = F.to_date("date")
    matches = spark.createDataFrame([(0, 5, "2020-01-10"), (1, 5, "2020-01-10")], "site int, scene int, date string").withColumn("date", day)
    labels = spark.createDataFrame([(0, "2020-01-10", 0, 0, 2.0, 0.9), (1, "2020-01-10", 0, 0, 3.0, 0.9)], "site int, date string, brow int, bcol int, y double, label_coverage double").withColumn("date", day)
    static = spark.createDataFrame([(0, 0, 0, 9.0), (1, 0, 0, 9.0)], "site int, brow int, bcol int, elevation double")
    canopy = spark.createDataFrame([(0, "2020-01-08", 0, 0, 4.0), (0, "2020-01-12", 0, 0, 5.0), (0, "2020-01-10", 1, 1, None)], "site int, date string, brow int, bcol int, veg double").withColumn("date", day)
    at = lambda c: rows(samples.sample_table(scene, matches, labels, static, canopy=c), "site", F.col("canopy_date").cast("string"), "veg", "y")
    assert at(canopy) == [(0, "2020-01-10", None, 2.0), (1, None, None, 3.0)]
    assert at(canopy.filter("brow = 0"))[0] == (0, "2020-01-08", 4.0, 2.0)


def test_points_in_holes_and_off_the_grid(spark):
    from cellframe.functions.geometry import Crs

    points = spark.createDataFrame([(1, "a", -111.0, 44.0), (2, "a", -111.0, 44.00001), (3, "a", None, 44.0), (4, "a", -110.0, 44.0), (5, "b", -111.0, 44.0)], "id int, site string, lon double, lat double")
    x, y = spark.range(1).select(*[c.alias(n) for c, n in zip(Crs("WGS84", 12).of_lonlat(F.lit(-111.0), F.lit(44.0)), "xy", strict=True)]).first()
    grid = spark.createDataFrame([("a", x - 0.5, y + 1.5, 1.0, -1.0, 3, 3)], "site string, left double, top double, dx double, dy double, height int, width int")
    cells = spark.createDataFrame([("a", 1, 0, 7.0), ("a", 0, 0, None)], "site string, row int, col int, v double")
    assert rows(matching.point_values(points, grid, cells, Crs("WGS84", 12)), "id", "row", "col", "v") == [(1, 1, 0, 7.0), (2, 0, 0, None)]


def test_granules_are_not_dealt_out_by_product_or_outline(spark):
    """Each choice once, with its date and reason; specs are broadcast, and outlines not asked for don't travel."""
    rows = [(f"camp{i % 3}_{i}", "SD", "K1", i if i % 4 else None, None, [1.0] if i % 5 else None) for i in range(40)]
    cat = spark.createDataFrame(rows, "name string, product string, code string, begin int, single int, footprint array<double>")
    specs = spark.createDataFrame([(0, "SD", None, "camp0"), (0, "SD", "K1", None), (1, "VH", "K1", None)], "site int, product string, code string, part string")
    taken, refused = matching.select_granules(specs, cat.union(cat), ["site", "name", "date"])
    assert sorted(map(tuple, taken.collect())) == sorted((0, n, b) for n, _, _, b, _, f in rows if b is not None and f)
    assert sorted(map(tuple, refused.collect())) == sorted((0, n, "undated" if b is None else "no_footprint") for n, _, _, b, _, f in rows if b is None or not f)
    plan = taken._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan
    exchanged = [x for x in plan.splitlines() if "Exchange hashpartitioning" in x]
    assert exchanged and not any("footprint" in x for x in exchanged)
