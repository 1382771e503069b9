"""Queries on names, annotations and metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.functions import names
from cellframe.operators import scenes
from cellframe.plans.fixtures import products, read
from cellframe.sources import rasters, texts


def _survey_names(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    res = F.when(F.col("o_orderkey") % 5 == 0, "10M").otherwise("3M")
    day = F.date_format("o_orderdate", "yyyyMMdd")
    name = F.concat(F.lit("CAMP_QSI_"), F.lower(F.col("o_orderstatus")), F.lit("_"), res, F.lit("_s"), (F.col("o_custkey") % 8), F.lit("_"), day, F.lit("_"), F.when(F.col("o_orderkey") % 3 == 0, "bad").otherwise(day), F.lit(".tif"))
    return o.select("o_orderkey", name.alias("name"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderstatus END AS product, CASE WHEN o_orderkey % 5 <> 0 THEN 'S' || (o_custkey % 8) END AS code,
CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS "begin", CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderdate AS DATE) END AS "end" FROM orders""")
def parse_filename(spark: SparkSession, d: str) -> DataFrame:
    p = _survey_names(spark, d).withColumn("p", names.survey_name(F.col("name")))
    return p.select("o_orderkey", *[F.col(f"p.{c}").alias(c) for c in ("product", "code", "begin", "end")])


@query("SELECT l_orderkey || '-' || l_suppkey AS file_id, 'CAMP' || (l_suppkey % 5) || l_orderkey AS token, max(l_linenumber) AS version, 'CAMP' || (l_suppkey % 5) || l_orderkey AS line, 'science/UAVSAR/20200211_20200218/CAMP' || (l_suppkey % 5) || l_orderkey AS path FROM lineitem GROUP BY l_orderkey, l_suppkey")
def scene_names(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d)
    dates = F.array(F.lit("2020-02-11").cast("date"), F.lit("2020-02-18").cast("date"))
    g = names.group_name(F.lit("Some Site"), F.col("scene"), dates)
    return p.select("file_id", names.flight_token(F.col("scene")).alias("token"), names.scene_version(F.col("scene")).alias("version"), names.flight_parts(g)["line"].alias("line"), names.acquisition_path(g).alias("path"))


@query("SELECT user_id AS file, CAST(max_by(CAST(substr(props, 7, length(props) - 7) AS DOUBLE), event_id) AS DOUBLE) AS wavelength, count(*) AS lines FROM events GROUP BY user_id")
def annotation_pivot(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    line = F.concat(F.lit("Center Wavelength (cm) = "), F.get_json_object("props", "$.k"), F.lit(" ; from "), F.col("event_type"))
    lines = e.select(F.col("user_id").alias("file"), F.col("event_id").alias("n"), line.alias("line"))
    flat = texts.annotations(lines).withColumn("value", F.col("number"))
    wide = scenes.annotation_scalars(flat.select("file", "key", "value"), {"center wavelength": "wavelength"})
    return wide.join(lines.groupBy("file").agg(F.count("*").alias("lines")), "file").select("file", "wavelength", "lines")


@query("""WITH f AS (SELECT o_orderkey, 100 + o_orderkey % 7 AS rows, 200 + o_custkey % 9 AS cols, 4 AS itemsize, (100 + o_orderkey % 7 + o_orderkey % 3) * (200 + o_custkey % 9 + o_orderkey % 5) * 4 AS bytes FROM orders),
t AS (SELECT *, bytes // 4 AS s, rows + k AS r FROM f, (SELECT unnest(range(-4, 5)) AS k)), c AS (SELECT *, s // r AS c FROM t WHERE s % r = 0), b AS (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(r - rows) + abs(c - cols), r) AS n FROM c WHERE abs(c - cols) <= 8)
SELECT f.o_orderkey, CAST(b.r AS INTEGER) AS fixed_rows, CAST(b.c AS INTEGER) AS fixed_cols FROM f LEFT JOIN b ON f.o_orderkey = b.o_orderkey AND b.n = 1""")
def shape_reconcile(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    rows, cols = (F.lit(100) + F.col("o_orderkey") % 7).cast("int"), (F.lit(200) + F.col("o_custkey") % 9).cast("int")
    size = (rows + F.col("o_orderkey") % 3) * (cols + F.col("o_orderkey") % 5) * 4
    f = o.select("o_orderkey", rows.alias("rows"), cols.alias("cols"), F.lit(4).alias("itemsize"), size.alias("bytes"))
    return rasters.reconcile_shape(f).select("o_orderkey", "fixed_rows", "fixed_cols")


@query("SELECT p_partkey, CASE WHEN p_name LIKE 'red%' THEN 'Radar · HH' WHEN p_name LIKE 'blue%' THEN 'Radar geometry' WHEN p_name LIKE 'small%' THEN 'Canopy' WHEN p_name LIKE 'large%' THEN 'Timing' ELSE 'Terrain' END AS grp FROM part")
def feature_groups(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("p_name")
    f = F.when(n.startswith("red"), "HH_cor").when(n.startswith("blue"), "inc_local").when(n.startswith("small"), "veg_height").when(n.startswith("large"), "gap_days").otherwise("slope")
    return read(spark, d, "part").select("p_partkey", names.feature_group(f).alias("grp"))


@query("""SELECT event_id, CASE event_type WHEN 'click' THEN 'lidar' WHEN 'view' THEN 'insar' WHEN 'purchase' THEN 'amp' ELSE 'meta' END AS domain, CASE WHEN event_id % 3 = 0 THEN '°' WHEN event_id % 3 = 1 THEN 'rad' ELSE '' END AS unit,
CASE WHEN event_id % 2 = 0 THEN 'rad' ELSE 'unknown' END AS units FROM events""")
def layer_names(spark: SparkSession, d: str) -> DataFrame:
    e, t = read(spark, d, "events"), F.col("event_type")
    path = F.when(t == "click", "science/LIDAR/SD/20200211/snow_depth").when(t == "view", "science/UAVSAR/20200211_20200218/L1/HH/cor").when(t == "purchase", "science/UAVSAR/20200211_20200218/L1/HH/amp1").otherwise("index")
    unit = F.when(F.col("event_id") % 3 == 0, "degrees clockwise").when(F.col("event_id") % 3 == 1, "Radians").otherwise("unitless")
    said = F.when(F.col("event_id") % 2 == 0, "Radians").otherwise("turns")
    return e.select("event_id", names.domain(path).alias("domain"), names.display_unit(unit, F.lit("aspect")).alias("unit"), names.quantity(F.lit("unw"), said)["units"].alias("units"))


@query("""WITH l AS (SELECT 'p' || event_id AS path, CASE WHEN event_id % 4 = 0 THEN 'p' || (event_id + 1) END AS src, event_type AS u, CAST(user_id AS VARCHAR) AS k FROM events)
SELECT l.path, l.u AS own, m.u AS inherited FROM l LEFT JOIN l m ON l.src = m.path""")
def layer_metadata(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    src = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("p"), F.col("event_id") + 1))
    attrs = F.create_map(F.lit("units"), F.col("event_type"), F.lit("hidden"), F.col("user_id").cast("string"))
    layers = e.select(F.concat(F.lit("p"), "event_id").alias("path"), src.alias("derived_from"), attrs.alias("attrs"))
    out = scenes.layer_metadata(layers, ["units"])
    return out.select("path", F.try_element_at("own", F.lit("units")).alias("own"), F.try_element_at("inherited", F.lit("units")).alias("inherited"))


@query("""WITH a AS (SELECT user_id % 20 AS scene, CASE WHEN event_id % 2 = 0 THEN 'A' ELSE 'B' END AS level, event_type AS key, CAST(min(user_id % 3) AS VARCHAR) AS value FROM events GROUP BY 1, 2, 3),
s AS (SELECT scene, key, count(DISTINCT value) > 1 AS split FROM a GROUP BY 1, 2)
SELECT scene, string_agg(k || '=' || value, ',' ORDER BY k) AS attrs FROM (SELECT scene, CASE WHEN split THEN lower(level) || '_' || key ELSE key END AS k, min(value) AS value FROM a JOIN s USING (scene, key) GROUP BY 1, 2) GROUP BY scene""")
def merge_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    level = F.when(F.col("event_id") % 2 == 0, "A").otherwise("B")
    attrs = e.groupBy((F.col("user_id") % 20).alias("scene"), level.alias("level"), F.col("event_type").alias("key")).agg(F.min(F.col("user_id") % 3).cast("string").alias("value"))
    out = scenes.merge_attributes(attrs)
    return out.select("scene", F.array_join(F.transform(F.map_entries("attrs"), lambda x: F.concat_ws("=", x["key"], x["value"])), ",").alias("attrs"))
