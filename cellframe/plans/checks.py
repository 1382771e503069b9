"""Queries that report data-quality findings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.functions import strict, values
from cellframe.operators import audit, blocks, cleaning
from cellframe.plans.fixtures import CHANNELS, G_EVENTS, SHAPE, channels, g_events, read, shaped

LEAVES = ("amp1", "cor", "unw", "snow_depth", "coherence_mask")


@query("""SELECT user_id % 8 AS site, 'l' || event_id AS layer, 'attribute' AS "check", 'fail' AS severity, k AS detail FROM events, (SELECT unnest(['units', 'description']) AS k)
WHERE (k = 'units' AND event_type = 'error') OR (k = 'description' AND event_id % 5 = 0)""")
def audit_attributes(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    text = F.when(F.col("event_id") % 5 == 0, "  ").otherwise("text")
    attrs = F.map_filter(F.create_map(F.lit("units"), F.when(F.col("event_type") != "error", "m"), F.lit("description"), text), lambda k, v: v.isNotNull())
    layers = e.select((F.col("user_id") % 8).alias("site"), F.concat(F.lit("l"), "event_id").alias("layer"), F.lit("any").alias("kind"), attrs.alias("attrs"))
    required = spark.createDataFrame([("any", "units"), ("any", "description")], "kind string, key string")
    return audit.required_attributes(layers, required)


@query("""WITH c AS (SELECT user_id % 8 AS site, CASE event_id % 5 WHEN 0 THEN 'amp1' WHEN 1 THEN 'cor' WHEN 2 THEN 'unw' WHEN 3 THEN 'snow_depth' ELSE 'coherence_mask' END AS leaf, CASE WHEN event_id % 11 = 0 THEN 0 WHEN event_id % 5 = 1 THEN value / 40 ELSE value END AS v FROM events),
a AS (SELECT site, leaf, count(*) FILTER (WHERE (leaf = 'cor' AND (v < 0 OR v > 1)) OR (leaf = 'amp1' AND v < 0) OR (leaf = 'snow_depth' AND (v < 0 OR v > 15))) AS o, count(*) FILTER (WHERE leaf IN ('amp1', 'cor', 'unw') AND v = 0) AS z, count(*) FILTER (WHERE leaf = 'coherence_mask' AND v NOT IN (0, 1, 255)) AS s FROM c GROUP BY 1, 2)
SELECT site, leaf AS layer, k AS "check", 'fail' AS severity, CAST(n AS VARCHAR) AS detail FROM (SELECT site, leaf, 'out_of_range' AS k, o AS n FROM a UNION ALL SELECT site, leaf, 'zeros', z FROM a UNION ALL SELECT site, leaf, 'states', s FROM a) WHERE n > 0""")
def audit_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    leaf = F.element_at(F.array(*[F.lit(x) for x in LEAVES]), (F.col("event_id") % 5 + 1).cast("int"))
    v = F.when(F.col("event_id") % 11 == 0, 0.0).when(F.col("event_id") % 5 == 1, F.col("value") / 40).otherwise(F.col("value"))
    cells = e.select((F.col("user_id") % 8).alias("site"), leaf.alias("layer"), leaf.alias("leaf"), v.alias("v"))
    return audit.value_rules(cells, cleaning.ranges_table(spark, cleaning.ENRICH_RANGES))


@query(f"""WITH {CHANNELS}, leaves AS (SELECT DISTINCT scene, leaf FROM ch), cells AS (SELECT DISTINCT scene, row, col FROM ch), f AS (SELECT c.scene, l.leaf, c.row, c.col, x.v FROM cells c JOIN leaves l USING (scene) LEFT JOIN ch x ON x.scene = c.scene AND x.leaf = l.leaf AND x.row = c.row AND x.col = c.col)
SELECT a.scene, a.leaf, count(*) FILTER (WHERE a.v IS NOT NULL AND r.v IS NULL) AS faults, count(*) FILTER (WHERE a.v IS NULL AND r.v IS NOT NULL) AS warnings FROM f a LEFT JOIN f r ON r.leaf = 'amp1' AND r.scene = a.scene AND r.row = a.row AND r.col = a.col WHERE a.leaf <> 'amp1' GROUP BY 1, 2""")
def audit_swath_subset(spark: SparkSession, d: str) -> DataFrame:
    ch = channels(spark, d)
    full = ch.select("scene", "row", "col").distinct().join(ch.select("scene", "leaf").distinct(), "scene").join(ch, ["scene", "leaf", "row", "col"], "left")
    return audit.swath_subset(full)


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS layer, CASE WHEN c_custkey % 6 = 0 THEN c_custkey WHEN c_custkey % 6 < 4 THEN c_custkey - 1 END AS src, CASE WHEN c_custkey % 6 IN (0, 1, 2, 3, 5) THEN 0 ELSE 1 END AS valid, CASE WHEN c_custkey % 12 = 6 OR c_custkey % 6 = 5 AND c_custkey % 4 = 1 THEN 'dry' END AS reason FROM customer),
w AS (SELECT layer, src AS at, reason, valid, [layer] AS seen, 0 AS step FROM l WHERE valid = 0 UNION ALL SELECT w.layer, l.src, l.reason, l.valid, list_append(w.seen, l.layer), w.step + 1 FROM w JOIN l ON w.at = l.layer WHERE w.valid = 0 AND w.reason IS NULL AND NOT list_contains(w.seen, l.layer))
SELECT layer, bool_or(valid = 0 AND reason IS NOT NULL) AS explained, CAST(max(step) AS INTEGER) AS steps FROM w GROUP BY layer""")
def audit_empty_chain(spark: SparkSession, d: str) -> DataFrame:
    c, k = read(spark, d, "customer"), F.col("c_custkey")
    src = F.when(k % 6 == 0, k).when(k % 6 < 4, k - 1)
    reason = F.when((k % 12 == 6) | ((k % 6 == 5) & (k % 4 == 1)), "dry")
    layers = c.select(k.alias("layer"), src.alias("derived_from"), F.when((k % 6).isin(0, 1, 2, 3, 5), 0).otherwise(1).alias("valid"), reason.alias("reason"))
    return audit.empty_chains(layers)


@query("""WITH RECURSIVE l AS (SELECT c_custkey AS layer, c_custkey % 8 AS site, CASE WHEN c_custkey % 3 = 0 THEN 'unw' ELSE 'cor' END AS leaf, CASE WHEN c_custkey % 40 = 7 THEN c_custkey + 3 WHEN c_custkey % 5 > 0 THEN c_custkey - 1 END AS src,
CASE WHEN c_custkey % 11 < 8 THEN 0 ELSE 1 END AS valid, CASE WHEN c_custkey % 4 = 1 THEN 'unwrapper_zero_fill' WHEN c_custkey % 4 > 1 THEN 'no_valid_input_cells' END AS reason, CASE WHEN c_nationkey % 2 = 0 THEN 'applied' END AS mask, c_nationkey % 4 AS zeros FROM customer),
w AS (SELECT layer, src AS at, [layer] AS seen, false AS circular FROM l WHERE valid = 0 UNION ALL SELECT w.layer, l.src, list_append(w.seen, l.layer), list_contains(w.seen, l.layer) FROM w JOIN l ON w.at = l.layer WHERE l.valid = 0 AND NOT w.circular),
c AS (SELECT layer, bool_or(circular) AS circular FROM w GROUP BY layer),
v AS (SELECT l.*, coalesce(l.reason = 'unwrapper_zero_fill' AND l.leaf = 'unw' AND l.mask = 'applied' AND l.zeros > 0, false) OR coalesce(l.reason = 'no_valid_input_cells' AND s.valid = 0 AND NOT c.circular, false) AS fine FROM l JOIN c USING (layer) LEFT JOIN l s ON l.src = s.layer WHERE l.valid = 0)
SELECT site, layer, 'empty' AS "check", CASE WHEN fine THEN 'warn' ELSE 'fail' END AS severity, CASE WHEN fine THEN reason END AS detail FROM v""")
def audit_empty_layers(spark: SparkSession, d: str) -> DataFrame:
    """Customers as layers that derive from each other, in chains and circles, with reasons for being empty."""
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    layers = read(spark, d, "customer").select(
        (k % 8).alias("site"), k.alias("layer"), F.when(k % 3 == 0, "unw").otherwise("cor").alias("leaf"), F.when(k % 40 == 7, k + 3).when(k % 5 > 0, k - 1).alias("derived_from"), F.when(k % 11 < 8, 0).otherwise(1).alias("valid"),
        F.when(k % 4 == 1, "unwrapper_zero_fill").when(k % 4 > 1, "no_valid_input_cells").alias("reason"), F.when(n % 2 == 0, "applied").alias("zero_mask"), (n % 4).alias("zeros_masked"),
    )
    return audit.empty_verdicts(layers)


@query("SELECT c_custkey AS \"group\" FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def hollow_groups(spark: SparkSession, d: str) -> DataFrame:
    g = read(spark, d, "customer").select(F.col("c_custkey").alias("group"))
    return audit.hollow_groups(g, read(spark, d, "orders").select(F.col("o_custkey").alias("group")))


@query("SELECT user_id % 8 AS site, count(*) AS layers, count(DISTINCT user_id) AS groups, bool_or(event_type = 'purchase') AS has_depth FROM events GROUP BY 1")
def site_rollup(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    leaf = F.when(F.col("event_type") == "purchase", "snow_depth").otherwise("cor")
    return audit.site_rollup(e.select((F.col("user_id") % 8).alias("site"), F.col("user_id").alias("group"), leaf.alias("leaf")))


@query("""WITH f AS (SELECT user_id % 8 AS site, CASE WHEN event_type = 'error' THEN 'fail' WHEN event_type = 'click' THEN 'warn' ELSE 'note' END AS severity FROM events)
SELECT site, severity, count(*) AS n FROM f GROUP BY ROLLUP (site, severity)""")
def severity_rollup(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    e = read(spark, d, "events")
    return audit.severities(e.select((F.col("user_id") % 8).alias("site"), F.when(t == "error", "fail").when(t == "click", "warn").otherwise("note").alias("severity")))


@query("""WITH l AS (SELECT c_custkey AS layer, CASE WHEN c_custkey % 9 = 0 THEN 6341 ELSE 6340 END AS epsg, CASE WHEN c_custkey % 10 = 0 THEN 101 ELSE 100 END AS height, CASE WHEN c_custkey % 4 = 0 THEN 3.00001 ELSE 3.0 END AS a, c_custkey % 8 AS site FROM customer)
SELECT site, layer, 'grid' AS "check", 'fail' AS severity, concat_ws(',', CASE WHEN epsg <> 6340 THEN 'epsg' END, CASE WHEN height <> 100 THEN 'height' END, CASE WHEN abs(a - 3) > 1e-6 THEN 'a' END) AS detail FROM l WHERE epsg <> 6340 OR height <> 100 OR abs(a - 3) > 1e-6""")
def audit_grids(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    fixed = {"width": F.lit(50), "b": F.lit(0.0), "c": F.lit(0.0), "d": F.lit(0.0), "e": F.lit(-3.0), "f": F.lit(0.0)}
    layers = read(spark, d, "customer").select(
        (k % 8).alias("site"), k.alias("layer"), F.when(k % 9 == 0, 6341).otherwise(6340).alias("epsg"), F.when(k % 10 == 0, 101).otherwise(100).alias("height"), F.when(k % 4 == 0, 3.00001).otherwise(3.0).alias("a"),
    ).withColumns(fixed)
    grids = layers.select("site").distinct().withColumns({"epsg": F.lit(6340), "height": F.lit(100), "a": F.lit(3.0)} | fixed)
    return audit.grid_agreement(layers, grids)


@query("""WITH s AS (SELECT user_id AS layer, user_id % 8 AS site, count(*) AS n, count(CASE WHEN event_type <> 'error' THEN 1 END) AS v FROM events GROUP BY user_id)
SELECT site, layer, 'statistics' AS "check", 'fail' AS severity, (v + 1) || '/' || v AS detail FROM s WHERE layer % 7 = 0""")
def audit_statistics(spark: SparkSession, d: str) -> DataFrame:
    from cellframe.operators import stats

    e = read(spark, d, "events")
    cells = e.select((F.col("user_id") % 8).alias("site"), F.col("user_id").alias("layer"), F.when(F.col("event_type") != "error", F.col("value")).alias("v"))
    s = stats.layer_stats(cells, ["site", "layer"])
    recorded = s.select("site", "layer", (F.col("valid") + F.when(F.col("layer") % 7 == 0, 1).otherwise(0)).alias("valid"), "valid_fraction")
    return audit.recorded_statistics(recorded, s)


@query("SELECT user_id AS layer, 'clean' AS stage, '{\"n\":' || count(*) || '}' AS entry FROM events GROUP BY user_id")
def processing_history(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "events").groupBy(F.col("user_id").alias("layer")).agg(F.count("*").alias("n"))
    return audit.history_entries(s, "clean")


@query("SELECT p_partkey AS layer, 'units' AS key, CASE WHEN p_type = 'ECONOMY' THEN 'metres' ELSE p_type END AS value, CASE WHEN p_type = 'ECONOMY' THEN '{\"old\":\"ECONOMY\",\"new\":\"metres\"}' END AS history FROM part")
def metadata_corrections(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part").select(F.col("p_partkey").alias("layer"), F.lit("units").alias("key"), F.col("p_type").alias("value"))
    fixes = p.filter("value = 'ECONOMY'").select("layer", "key", F.col("value").alias("old"), F.lit("metres").alias("new"))
    return audit.corrections(p, fixes)


@query(f"""WITH {G_EVENTS}, {SHAPE}, b AS (SELECT row // 5 AS brow, col // 5 AS bcol, avg(v) AS mean FROM g, s WHERE row < height // 5 * 5 AND col < width // 5 * 5 GROUP BY 1, 2),
c AS (SELECT brow, bcol, CASE WHEN mean IS NULL THEN 0 ELSE 1 + CAST(floor(mean) AS INTEGER) END AS code FROM b), n AS (SELECT *, row_number() OVER (PARTITION BY code > 0 ORDER BY brow, bcol) AS n, count(*) OVER (PARTITION BY code > 0) AS k FROM c)
SELECT brow, bcol, code, true AS fine FROM n WHERE CASE WHEN code > 0 THEN n = 1 OR n = k OR n = ceil(k / 2) OR n = ceil(k / 4) ELSE n = 1 END""")
def sampled_blocks(spark: SparkSession, d: str) -> DataFrame:
    """An audit by samples: five blocks of a layer, worked out again from their cells.

    What is stored is the block product's code; the other side is a plain mean of the cells
    that goes through quantise() with steps of 1, so that the two differ by rounding alone.
    """
    cells = g_events(spark, d)
    b = blocks.block_mean(shaped(cells), 5)
    codes = b.select("layer", "brow", "bcol", F.when(F.col("mean").isNull(), 0).otherwise(1 + F.floor("mean")).cast("int").alias("code"))
    means = cells.groupBy("layer", F.floor(F.col("row") / 5).alias("brow"), F.floor(F.col("col") / 5).alias("bcol")).agg(F.avg("v").alias("mean"))
    lo, hi, bits = F.lit(0.0), F.lit(65534.0), 16
    again = means.select("layer", "brow", "bcol", values.quantise(F.col("mean"), lo, hi, bits).alias("code"))
    return audit.recomputed_blocks(codes, again).select("brow", "bcol", "code", "fine")


@query("SELECT c_custkey % 8 AS site, count(*) AS missing FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 2 = 0) GROUP BY 1")
def annotation_coverage(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "customer").select((F.col("c_custkey") % 8).alias("site"), F.col("c_custkey").alias("url"))
    return audit.coverage(e, read(spark, d, "orders").filter("o_orderkey % 2 = 0").select(F.col("o_custkey").alias("url")), "url")


@query("SELECT o_custkey % 8 AS site, o_orderkey AS match FROM orders WHERE o_orderkey % 5 = 0")
def unequal_columns(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    m = o.select((F.col("o_custkey") % 8).alias("site"), F.col("o_orderkey").alias("match"), F.array(F.lit(1), F.lit(2)).alias("dates"), F.when(F.col("o_orderkey") % 5 == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(1), F.lit(2))).alias("gaps"))
    return audit.unequal_columns(m, ["dates", "gaps"]).select("site", "match")


@query("""WITH j AS (SELECT p_partkey AS layer, p_size, CASE p_partkey % 7 WHEN 0 THEN '{"units":"m","size":' || p_size || '}' WHEN 1 THEN '{"units":"m","size":1,"units":"' || p_type || '"}' WHEN 2 THEN '{"in":{"size":1,"size":' || p_size || '}}'
WHEN 3 THEN '{"size":' || p_size WHEN 4 THEN '{"size":' || p_size || '} end' WHEN 5 THEN '[{"size":1},{"size":' || p_size || '}]' END AS text FROM part)
SELECT layer, CASE WHEN text IS NULL THEN NULL WHEN NOT json_valid(text) THEN 'malformed' WHEN len(json_keys(text)) <> len(list_distinct(json_keys(text))) OR coalesce(len(json_keys(text, '$.in')) <> len(list_distinct(json_keys(text, '$.in'))), false) THEN 'duplicate_key' END AS fault,
CASE layer % 4 WHEN 0 THEN '"nan"' WHEN 1 THEN '"inf"' WHEN 2 THEN '"-inf"' ELSE CAST(CAST(p_size AS DOUBLE) AS VARCHAR) END AS number,
'{"cleaning_size":"' || p_size || '","valid_fraction":' || CASE WHEN p_size % 2 = 0 THEN '"0.5"' ELSE 'null' END || '}' AS snapshot FROM j""")
def json_faults(spark: SparkSession, d: str) -> DataFrame:
    """Attributes as JSON with planted faults, numbers that aren't finite, and what of an attribute map is kept."""
    k, size = F.col("p_partkey"), F.col("p_size").cast("string")
    text = F.when(k % 7 == 0, F.concat(F.lit('{"units":"m","size":'), size, F.lit("}"))).when(k % 7 == 1, F.concat(F.lit('{"units":"m","size":1,"units":"'), "p_type", F.lit('"}')))
    text = text.when(k % 7 == 2, F.concat(F.lit('{"in":{"size":1,"size":'), size, F.lit("}}"))).when(k % 7 == 3, F.concat(F.lit('{"size":'), size))
    text = text.when(k % 7 == 4, F.concat(F.lit('{"size":'), size, F.lit("} end"))).when(k % 7 == 5, F.concat(F.lit('[{"size":1},{"size":'), size, F.lit("}]")))
    number = F.when(k % 4 == 0, float("nan")).when(k % 4 == 1, float("inf")).when(k % 4 == 2, -float("inf")).otherwise(F.col("p_size").cast("double"))
    attributes = F.create_map(F.lit("valid_fraction"), F.when(F.col("p_size") % 2 == 0, "0.5"), F.lit("units"), F.lit("m"), F.lit("cleaning_size"), size)
    return read(spark, d, "part").select(k.alias("layer"), strict.json_fault(text).alias("fault"), strict.finite_text(number).alias("number"), strict.snapshot(attributes, ("cleaning_", "value_"), ("valid_fraction",)).alias("snapshot"))
