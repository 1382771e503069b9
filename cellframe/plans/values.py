"""Queries on conversions of values, grids, names and point tables, and on tables written and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.functions import geometry, names, values
from cellframe.model import rounded as r
from cellframe.operators import audit, cleaning, matching, regrid, samples
from cellframe.plans.fixtures import G_COMPLEX, G_EVENTS, G_ORDERS, PRODUCTS, SAMPLES, g_complex, g_events, g_orders, products, read
from cellframe.plans.fixtures import samples as sample_rows
from cellframe.sources import rasters, texts
from cellframe.sources.shared import shared_path


def _filled(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 7
    v = F.when(k == 0, -9999.0).when(k == 1, -3.4028234663852886e38).when(k == 2, F.lit(float("nan"))).otherwise(F.col("value"))
    return read(spark, d, "events").select("event_id", v.alias("v"))


@query("SELECT event_id, CASE WHEN event_id % 7 > 2 THEN value END AS v, CASE WHEN event_id % 256 <> 255 THEN CAST(event_id % 256 AS INTEGER) END AS code FROM events")
def normalised_fills(spark: SparkSession, d: str) -> DataFrame:
    code = (F.col("event_id") % 256).cast("int")
    return _filled(spark, d).select("event_id", cleaning.normalise_fill(F.col("v"), F.lit(-9999.0)).alias("v"), cleaning.integer_fill(code).alias("code"))


@query("""WITH c AS (SELECT user_id % 40 AS layer, CASE WHEN user_id % 40 = 3 OR event_id % 4 = 0 THEN 0.0 WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT layer, count(*) FILTER (WHERE v = 0) AS removed, CASE WHEN count(*) FILTER (WHERE v <> 0) = 0 AND count(v) > 0 THEN 'every value was a zero fill' END AS empty_reason FROM c GROUP BY layer""")
def zero_fill_counts(spark: SparkSession, d: str) -> DataFrame:
    layer = F.col("user_id") % 40
    v = F.when((layer == 3) | (F.col("event_id") % 4 == 0), 0.0).when(F.col("event_type") != "error", F.col("value"))
    return cleaning.zero_fill_counts(read(spark, d, "events").select(layer.alias("layer"), v.alias("v")))


@query(f"WITH {G_COMPLEX} SELECT row, col, round(sqrt(re * re + im * im), 6) AS magnitude, round(atan2(im, re), 6) AS phase FROM z")
def complex_parts(spark: SparkSession, d: str) -> DataFrame:
    z = g_complex(spark, d)
    return z.select("row", "col", r(values.magnitude(F.col("re"), F.col("im"))).alias("magnitude"), r(values.phase(F.col("re"), F.col("im"))).alias("phase"))


@query("SELECT event_id, round(sin(radians(value)), 6) + 0.0 AS east, round(cos(radians(value)), 6) + 0.0 AS north, CASE WHEN value > 0 AND user_id > 0 THEN round(20 * log10(user_id) - 20 * log10(value), 6) + 0.0 END AS ratio FROM events")
def direction_and_ratio(spark: SparkSession, d: str) -> DataFrame:
    east, north = values.direction_parts(F.col("value"))
    ratio = values.db_ratio(F.col("value"), F.col("user_id").cast("double"))
    return read(spark, d, "events").select("event_id", r(east).alias("east"), r(north).alias("north"), r(ratio).alias("ratio"))


@query("""WITH e AS (SELECT event_id, value / 100 AS v FROM events)
SELECT event_id, CASE WHEN v BETWEEN 0 AND 1 THEN v END AS fraction, CAST(CASE WHEN v BETWEEN 0 AND 1 THEN CASE WHEN v >= 0.3 THEN 1 ELSE 0 END END AS DOUBLE) AS mask,
CASE WHEN event_id % 10 <> 3 THEN CAST(event_id % 10 AS DOUBLE) * 0.5 - 2 END AS scaled FROM e""")
def previews_and_scales(spark: SparkSession, d: str) -> DataFrame:
    v, raw = F.col("value") / 100, (F.col("event_id") % 10).cast("double")
    return read(spark, d, "events").select(
        "event_id", values.mask_preview(v).alias("fraction"), values.mask_preview(v, 0.3).cast("double").alias("mask"), values.rescale(raw, 0.5, -2.0, nodata=3.0).alias("scaled")
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS INTEGER) AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def pair_days(spark: SparkSession, d: str) -> DataFrame:
    both = read(spark, d, "lineitem").join(read(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return both.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", values.days_between(F.col("o_orderdate").cast("date"), F.col("l_shipdate").cast("date")).alias("days"))


@query("SELECT p_partkey, CAST(greatest(ceil(sqrt((p_partkey + 1) * 900.0 * p_size / 500000)), 4) AS INTEGER) AS step, 4 * CAST(greatest(ceil(sqrt((p_partkey + 1) * 900.0 * p_size / 500000)), 4) AS INTEGER) AS data_step FROM part")
def display_strides(spark: SparkSession, d: str) -> DataFrame:
    height, width = (F.col("p_partkey") + 1) * 900, F.col("p_size")
    return read(spark, d, "part").select("p_partkey", geometry.stride(height, width).alias("step"), geometry.data_stride(height, width).alias("data_step"))


@query("SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'rotated' WHEN 1 THEN 'south-up' WHEN 2 THEN 'mirrored' END AS fault FROM part")
def grid_faults(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey") % 5
    a, b, e = F.when(k == 2, -3.0).otherwise(3.0), F.when(k == 0, 0.25).otherwise(0.0), F.when(k == 1, 3.0).otherwise(-3.0)
    return read(spark, d, "part").select("p_partkey", geometry.grid_fault(a, b, F.lit(0.0), e).alias("fault"))


@query("""WITH p AS (SELECT o_orderkey, 100.0 + o_orderkey % 17 AS x, 50.0 - o_custkey % 13 AS y FROM orders), t AS (SELECT *, x - 90.0 AS u, y - 60.0 AS v, 2.0 * -4.0 - 0.5 * 0.25 AS det FROM p)
SELECT o_orderkey, round((u * -4.0 - v * 0.5) / det - 0.5, 6) + 0.0 AS col, round((v * 2.0 - u * 0.25) / det - 0.5, 6) + 0.0 AS row FROM t""")
def rotated_positions(spark: SparkSession, d: str) -> DataFrame:
    x, y = 100.0 + F.col("o_orderkey") % 17, 50.0 - F.col("o_custkey") % 13
    col, row = geometry.affine_inverse(x, y, *map(F.lit, (2.0, 0.5, 90.0, 0.25, -4.0, 60.0)))
    return read(spark, d, "orders").select("o_orderkey", r(col).alias("col"), r(row).alias("row"))


@query("""WITH b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 > 0 THEN CAST(o_orderkey % 9 AS DOUBLE) END AS dx, CAST(o_orderkey % 7 AS DOUBLE) AS sx FROM orders)
SELECT o_orderkey, coalesce(greatest(dx, sx), sx) - 1.5 AS "left", coalesce(least(dx, sx), sx) + 21.5 AS "right", coalesce(dx, sx) - 1.5 AS dem_left, sx AS science_left FROM b""")
def target_bounds(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    sides = lambda x: F.struct(x.cast("double").alias("left"), F.lit(0.0).alias("bottom"), (x + 20).cast("double").alias("right"), F.lit(5.0).alias("top"))
    dem, science = F.when(k % 4 > 0, sides(k % 9)), sides(k % 7)
    both = geometry.target_bounds(dem, science, "dem_intersect_science", 1.5)
    own = geometry.target_bounds(F.coalesce(dem, science), science, "dem", 1.5)
    plain = geometry.target_bounds(dem, science, "science")
    return read(spark, d, "orders").select("o_orderkey", both["left"].alias("left"), both["right"].alias("right"), own["left"].alias("dem_left"), plain["left"].alias("science_left"))


@query(f"""WITH {G_EVENTS}, p AS (SELECT o_orderkey, (o_orderkey % 97) + 0.25 AS x, (o_custkey % 60) - 0.5 AS y FROM orders)
SELECT o_orderkey, g.v FROM p LEFT JOIN g ON g.row = CAST(floor(y + 0.5) AS INTEGER) AND g.col = CAST(floor(x + 0.5) AS INTEGER)""")
def point_to_cell(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    points = o.select("o_orderkey", F.lit("events").alias("layer"), (F.col("o_orderkey") % 97 + 0.25).alias("x"), (F.col("o_custkey") % 60 - 0.5).alias("y"))
    return regrid.containing_cell(points, g_events(spark, d)).select("o_orderkey", "v")


@query("""SELECT event_id, CASE WHEN event_id % 3 < 2 THEN CAST(ts AS DATE) END AS day, CASE WHEN event_id % 4 = 0 THEN 'HH' WHEN event_id % 4 = 1 THEN 'VV' END AS pol, CASE WHEN event_id % 4 = 0 THEN 'cor' WHEN event_id % 4 = 1 THEN 'unw' END AS sub FROM events""")
def dates_and_members(spark: SparkSession, d: str) -> DataFrame:
    k, day = F.col("event_id"), F.date_format("ts", "yyyy-MM-dd")
    when = F.when(k % 3 == 0, day).when(k % 3 == 1, F.concat(day, F.lit("T01:02:03Z"))).otherwise(F.date_format("ts", "yyyyMMdd"))
    name = F.when(k % 4 == 0, "in/S_L090HH_01.cor.grd").when(k % 4 == 1, "S_L090VV_01.UNW.grd").when(k % 4 == 2, "S_L090HH_01.cor").otherwise("readme.grd")
    return read(spark, d, "events").select("event_id", names.lenient_date(when).alias("day"), names.member(name)["pol"].alias("pol"), names.member(name)["sub"].alias("sub"))


@query(f"WITH {PRODUCTS} SELECT file_id, level FROM pr WHERE level = 'AMPLITUDE_GRD' AND x % 5 <> 0")
def level_filter(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d).withColumn("broken", F.col("ring")[0]["x"] % 5 == 0)
    p = p.withColumn("ring", F.when(F.col("broken"), F.slice("ring", 1, 2)).otherwise(F.col("ring")))
    return matching.level_filter(p, ["AMPLITUDE_GRD", "AMPLITUDE"]).select("file_id", "level")


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_partkey % 2 = 0 INTERSECT SELECT p_name FROM part WHERE p_size < 25")
def shared_names(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_name").alias("name"), "p_partkey", "p_size")
    return matching.shared_names(p.filter("p_partkey % 2 = 0"), p.filter("p_size < 25"), "name")


@query("""WITH f AS (SELECT user_id % 8 AS site, 'l' || event_id AS layer, event_type AS "check", CASE WHEN event_id % 3 = 0 THEN 'fail' ELSE 'warn' END AS severity, props AS detail FROM events)
SELECT site, layer, "check", severity, detail FROM (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY site, layer, "check", detail) AS n FROM f) WHERE n <= 12""")
def report_lines(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    severity = F.when(F.col("event_id") % 3 == 0, "fail").otherwise("warn")
    f = e.select((F.col("user_id") % 8).alias("site"), F.concat(F.lit("l"), "event_id").alias("layer"), F.col("event_type").alias("check"), severity.alias("severity"), F.col("props").alias("detail"))
    return audit.first_lines(f, 12)


@query("SELECT event_id, CASE WHEN event_id % 9 > 0 THEN value END AS wavelength_cm FROM events WHERE event_id % 9 = 0 OR value NOT BETWEEN 23 AND 25")
def odd_wavelengths(spark: SparkSession, d: str) -> DataFrame:
    return audit.wavelength(read(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 > 0, F.col("value")).alias("wavelength_cm")))


@query("""SELECT o_orderkey, sha256('{"stage":"' || o_orderstatus || '","parameters":"' || o_orderpriority || '","inputs":["a","b' || (o_custkey % 10) || '"]}') AS recipe FROM orders""")
def lineage_recipes(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    inputs = F.array(F.concat(F.lit("b"), (F.col("o_custkey") % 10).cast("string")), F.lit("a"))
    return audit.lineage(o.select("o_orderkey", F.col("o_orderstatus").alias("stage"), F.col("o_orderpriority").alias("parameters"), inputs.alias("inputs"))).select("o_orderkey", "recipe")


@query("""WITH c AS (SELECT user_id AS layer, CASE WHEN event_type <> 'error' AND user_id % 5 > 0 THEN value END AS re, CASE WHEN event_id % 2 = 0 THEN 1.0 END AS im FROM events)
SELECT layer, count(*) FILTER (WHERE re IS NOT NULL AND im IS NOT NULL) AS valid FROM c GROUP BY layer HAVING count(*) FILTER (WHERE re IS NOT NULL AND im IS NOT NULL) = 0""")
def empty_complex_layers(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    re = F.when((F.col("event_type") != "error") & (F.col("user_id") % 5 > 0), F.col("value"))
    cells = e.select(F.col("user_id").alias("layer"), re.alias("re"), F.when(F.col("event_id") % 2 == 0, 1.0).alias("im"))
    return audit.empty_layers(audit.valid_cells(cells, ["layer"], ["re", "im"]))


@query("""SELECT c_custkey AS file, 'P' || c_custkey AS pit, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS note FROM customer WHERE c_custkey % 4 > 0""")
def pit_summaries(spark: SparkSession, d: str) -> DataFrame:
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    head = F.when(k % 4 > 0, "Location,PitID,Date,UTM,East,North,Depth,Note").otherwise("Location,PitID")
    row = F.concat(F.lit("Site,P"), k, F.lit(",2020-02-11,12,1,2,3"), F.when(k % 3 > 0, F.concat(F.lit(","), "c_mktsegment")).otherwise(F.lit("")))
    lines = F.array(F.lit("# PitID,a,b,c,d,e,f,g,h"), F.lit("a,b"), head, F.lit("1,2,3,4,5,6,7,8"), row, F.lit("  "))
    flat = c.select(k.alias("file"), F.posexplode(lines).alias("n", "line"))
    at = lambda x: F.try_element_at("fields", F.lit(x))
    return texts.pit_table(flat).select("file", at("PitID").alias("pit"), at("Note").alias("note"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS thickness, CAST(o_custkey AS DOUBLE) AS x, CAST(o_orderkey % 60 AS VARCHAR) AS zone, CAST(NULL AS VARCHAR) AS swe FROM orders""")
def transect_columns(spark: SparkSession, d: str) -> DataFrame:
    o, k = read(spark, d, "orders"), F.col("o_orderkey")
    depth = F.when(k % 5 == 0, "-9999").otherwise(F.col("o_totalprice").cast("string"))
    raw = o.select(k.cast("string").alias("Time"), depth.alias("Thick ness"), F.col("o_custkey").cast("string").alias("EASTING"), (k % 60).cast("string").alias("UTM_Zone"), F.lit("x").alias("other"))
    out = texts.normalise_columns(raw, texts.TRANSECT)
    return out.select(F.col("time").cast("long").alias("o_orderkey"), cleaning.point_fill(F.col("thickness")).alias("thickness"), cleaning.point_fill(F.col("x")).alias("x"), "zone", "swe")


@query("""WITH f AS (SELECT o_orderkey, o_orderkey % 40 AS x, o_custkey % 30 AS y FROM orders)
SELECT o_orderkey, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 1 WHEN o_orderkey % 3 = 1 THEN 1 ELSE 0 END AS INTEGER) AS rings, CASE WHEN o_orderkey % 3 = 0 THEN 3 WHEN o_orderkey % 3 = 1 THEN 4 END AS points, CAST(CASE WHEN o_orderkey % 3 < 2 THEN x + 2 END AS DOUBLE) AS east FROM f""")
def footprint_rings(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders").select("o_orderkey", (F.col("o_orderkey") % 40).cast("double").alias("x"), (F.col("o_custkey") % 30).cast("double").alias("y"))
    k, x, y = F.col("o_orderkey"), F.col("x"), F.col("y")
    point = lambda a, b: F.struct(a.alias("Longitude"), b.alias("Latitude"))
    corners = F.array(point(x, y), point(x + 2, y), point(x, y + 1))
    polygon = F.struct(F.struct(F.when(k % 3 == 0, corners).otherwise(F.slice(corners, 1, 2)).alias("Points")).alias("Boundary"))
    sides = [x.alias("WestBoundingCoordinate"), y.alias("SouthBoundingCoordinate"), (x + 2).alias("EastBoundingCoordinate"), F.when(k % 3 == 1, y + 1).alias("NorthBoundingCoordinate")]
    geometry_ = F.struct(F.array(polygon).alias("GPolygons"), F.array(F.struct(*sides)).alias("BoundingRectangles"))
    record = F.to_json(F.struct(F.struct(F.struct(geometry_.alias("Geometry")).alias("HorizontalSpatialDomain")).alias("SpatialExtent")))
    rings = texts.footprints(record)
    first = F.try_element_at("rings", F.lit(1))
    found = o.select("o_orderkey", rings.alias("rings"))
    return found.select("o_orderkey", F.size("rings").alias("rings"), F.when(F.size("rings") > 0, F.size(first)).alias("points"), F.array_max(F.transform(first, lambda p: p["x"])).alias("east"))


@query("""WITH s AS (SELECT l_orderkey || '-' || l_suppkey AS file_id, l_linenumber, l_suppkey, CASE WHEN l_suppkey % 3 > 0 THEN 'L' || (l_suppkey % 2) ELSE 'fallback' END AS level, CASE WHEN l_orderkey % 4 > 0 THEN l_linenumber * 100 ELSE 0 END AS bytes FROM lineitem)
SELECT file_id, min(level) AS level, CAST(max(bytes) AS BIGINT) AS bytes FROM s GROUP BY file_id""")
def harvested_products(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    known = F.when(F.col("l_suppkey") % 3 > 0, F.concat(F.lit("L"), F.col("l_suppkey") % 2))
    size = F.when(F.col("l_orderkey") % 4 > 0, (F.col("l_linenumber") * 100).cast("string")).otherwise("unknown")
    attrs = F.create_map(F.lit("file_id"), F.concat_ws("-", "l_orderkey", "l_suppkey"), F.lit("processing_level"), known, F.lit("bytes"), size)
    return texts.harvest_inventory(li.select(F.lit("fallback/x").alias("group"), attrs.alias("attrs"))).select("file_id", "level", "bytes")


@query(f"WITH {G_ORDERS} SELECT row % 4 AS site, row, col, v FROM g")
def layer_written_and_read(spark: SparkSession, d: str) -> DataFrame:
    cells = g_orders(spark, d).select((F.col("row") % 4).cast("string").alias("site"), F.lit("dem").alias("product"), "layer", "row", "col", "v")
    path = shared_path(spark, "layers")
    rasters.write_layer(cells, path)
    return rasters.scan_layer(spark, path, products=["dem"]).select(F.col("site").cast("int").alias("site"), "row", "col", "v")


@query(f"WITH {SAMPLES} SELECT site, count(*) AS n, CAST(sum(line) AS BIGINT) AS lines, max(y) AS most FROM sm GROUP BY site")
def sample_tables_read_back(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "samples")
    samples.write_samples(sample_rows(spark, d), path)
    return samples.read_samples(spark, path).groupBy(F.col("site").cast("int").alias("site")).agg(F.count("*").alias("n"), F.sum("line").alias("lines"), F.max("y").alias("most"))


@query(f"WITH {SAMPLES} SELECT CAST(site * 10 + 10 AS INTEGER) AS scale, count(*) AS n, CAST(sum(order_key) AS BIGINT) AS keys FROM sm GROUP BY site")
def results_of_scales(spark: SparkSession, d: str) -> DataFrame:
    path = shared_path(spark, "results")
    sm = sample_rows(spark, d).select(F.concat((F.col("site") * 10 + 10).cast("string"), F.lit("m")).alias("at"), "order_key")
    sm.write.partitionBy("at").option("header", True).csv(path)
    out = texts.scan_results(spark, f"{path}/at=*")
    return out.groupBy("scale").agg(F.count("*").alias("n"), F.sum(F.col("order_key").cast("long")).alias("keys"))
