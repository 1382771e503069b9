"""Queries on surveys, scenes, points and inventories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.functions import geometry
from cellframe.model import rounded as r
from cellframe.operators import matching, scenes
from cellframe.plans.fixtures import GRANULES, PRODUCTS, granules, products, read


@query(f"""WITH {GRANULES}, {PRODUCTS} SELECT DISTINCT gr.site, granule, scene, least(abs(b - ref), abs(b - sec), abs(e - ref), abs(e - sec)) AS gap_days
FROM gr JOIN pr ON gr.site = pr.site AND gr.x <= pr.x + 2 AND pr.x <= gr.x + 3 AND gr.y <= pr.y + 3 AND pr.y <= gr.y + 2
WHERE least(abs(b - ref), abs(b - sec), abs(e - ref), abs(e - sec)) <= 5""")
def match_surveys(spark: SparkSession, d: str) -> DataFrame:
    return matching.match_scenes(granules(spark, d), products(spark, d)).withColumn("gap_days", F.col("gap_days").cast("long"))


def outlined(rows: DataFrame, k: Column, w: float, h: float) -> DataFrame:
    """Outlines by k: a box, a triangle with a repeated point, or a ring that crosses itself."""
    at = lambda x, y: F.struct((F.col("ring")[0]["x"] + x).alias("x"), (F.col("ring")[0]["y"] + y).alias("y"))
    triangle = F.array(at(0, 0), at(w, 0), at(w, 0), at(0, h), at(0, 0))
    bow = F.array(at(0, 0), at(w, h), at(w, 0), at(0, h))
    return rows.withColumn("ring", F.when(k % 3 == 0, F.col("ring")).when(k % 3 == 1, triangle).otherwise(bow))


def outline_sql(name: str, rows: str, key: str, w: int, h: int) -> str:
    """SQL for the edges (key, i, ax, ay, bx, by) of outlined()."""
    corners = {0: [(0, 0), (w, 0), (w, h), (0, h)], 1: [(0, 0), (w, 0), (0, h)], 2: [(0, 0), (w, h), (w, 0), (0, h)]}
    parts = [f"SELECT {key}, {i} AS i, x + {p[0]} AS ax, y + {p[1]} AS ay, x + {q[0]} AS bx, y + {q[1]} AS by FROM {rows} WHERE k % 3 = {m}" for m, ring in corners.items() for i, (p, q) in enumerate(zip(ring, ring[1:] + ring[:1], strict=True))]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


SIDE = "(({1}bx - {1}ax) * ({2} - {1}ay) - ({1}by - {1}ay) * ({3} - {1}ax))"
CROSS = " AND ".join(f"sign({SIDE.format('', a, f'{b}ay', f'{b}ax')}) * sign({SIDE.format('', a, f'{b}by', f'{b}bx')}) <= 0" for a, b in (("s.", "t."), ("t.", "s.")))
CROSS += " AND " + " AND ".join(f"greatest({a}a{c}, {a}b{c}) >= least({b}a{c}, {b}b{c})" for a, b in (("s.", "t."), ("t.", "s.")) for c in "xy")


@query(f"""WITH {GRANULES}, {PRODUCTS}, g AS (SELECT site, granule, b, e, x, y, granule AS k FROM gr WHERE granule % 10 > 0), p AS (SELECT site, scene, ref, sec, x, y, bytes AS k, row_number() OVER () AS id FROM pr),
{outline_sql("ge", "g", "granule", 3, 2)}, {outline_sql("pe", "p", "id", 2, 3)},
c AS (SELECT g.site, granule, scene, id, g.x AS gx, g.y AS gy, p.x AS px, p.y AS py, least(abs(b - ref), abs(b - sec), abs(e - ref), abs(e - sec)) AS gap_days FROM g JOIN p ON g.site = p.site AND g.x <= p.x + 2 AND p.x <= g.x + 3 AND g.y <= p.y + 3 AND p.y <= g.y + 2
  WHERE least(abs(b - ref), abs(b - sec), abs(e - ref), abs(e - sec)) <= 5),
hit AS (SELECT DISTINCT c.granule, c.id FROM c JOIN ge s USING (granule) JOIN pe t USING (id) WHERE {CROSS}),
inside AS (SELECT c.granule, c.id FROM c JOIN ge s USING (granule) WHERE (s.ay > py) <> (s.by > py) AND px < (s.bx - s.ax) * (py - s.ay) / nullif(s.by - s.ay, 0) + s.ax GROUP BY c.granule, c.id HAVING count(*) % 2 = 1
  UNION SELECT c.granule, c.id FROM c JOIN pe s USING (id) WHERE (s.ay > gy) <> (s.by > gy) AND gx < (s.bx - s.ax) * (gy - s.ay) / nullif(s.by - s.ay, 0) + s.ax GROUP BY c.granule, c.id HAVING count(*) % 2 = 1)
SELECT site, granule, scene, gap_days, 'match' AS verdict FROM c WHERE EXISTS (SELECT 1 FROM hit WHERE hit.granule = c.granule AND hit.id = c.id) OR EXISTS (SELECT 1 FROM inside WHERE inside.granule = c.granule AND inside.id = c.id)
UNION ALL SELECT site, granule, NULL, -1, 'snow_off_no_match_expected' FROM gr WHERE granule % 10 = 0""")
def match_outlines(spark: SparkSession, d: str) -> DataFrame:
    """Surveys and scenes with outlines of three kinds, and the verdicts of bare-ground surveys."""
    g = outlined(granules(spark, d), F.col("granule"), 3.0, 2.0)
    p = outlined(products(spark, d), F.col("bytes"), 2.0, 3.0)
    found = matching.match_surveys(g.filter("granule % 10 > 0"), p)
    return matching.with_snow_off(found, g.filter("granule % 10 = 0")).withColumn("gap_days", F.col("gap_days").cast("long"))


@query("""WITH t AS (SELECT DISTINCT o_custkey % 8 AS site, CAST(o_orderdate AS DATE) AS target FROM orders), c AS (SELECT DISTINCT l_orderkey % 8 AS site, CAST(l_shipdate AS DATE) AS candidate FROM lineitem),
p AS (SELECT t.site, target, candidate AS before FROM t ASOF LEFT JOIN c ON t.site = c.site AND target >= candidate),
n AS (SELECT p.site, target, before, candidate AS after FROM p ASOF LEFT JOIN c ON p.site = c.site AND target <= candidate)
SELECT site, target, CASE WHEN after IS NULL OR target - before <= after - target THEN before ELSE after END AS candidate FROM n""")
def nearest_date(spark: SparkSession, d: str) -> DataFrame:
    t = read(spark, d, "orders").select((F.col("o_custkey") % 8).alias("site"), F.col("o_orderdate").cast("date").alias("target"))
    c = read(spark, d, "lineitem").select((F.col("l_orderkey") % 8).alias("site"), F.col("l_shipdate").cast("date").alias("candidate"))
    return matching.nearest_date(t, c)


@query("""WITH s AS (SELECT o_orderkey AS survey, o_custkey % 8 AS site, DATE '2024-01-01' + CAST(o_orderkey % 28 AS INTEGER) AS b, DATE '2024-01-01' + CAST(o_orderkey % 28 + o_orderkey % 3 AS INTEGER) AS e FROM orders),
v AS (SELECT user_id % 8 AS site, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2),
o AS (SELECT s.site, survey, n, CASE WHEN day < b THEN b - day WHEN day > e THEN day - e ELSE 0 END AS off FROM s LEFT JOIN v ON s.site = v.site)
SELECT site, survey, CAST(coalesce(sum(n) FILTER (WHERE off <= 0), 0) AS BIGINT) AS within, CAST(coalesce(sum(n) FILTER (WHERE off <= 3), 0) AS BIGINT) AS within_3, CAST(coalesce(sum(n) FILTER (WHERE off <= 7), 0) AS BIGINT) AS within_7 FROM o GROUP BY site, survey""")
def near_surveys(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    begin = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("o_orderkey") % 28).cast("int"))
    s = o.select((F.col("o_custkey") % 8).alias("site"), F.col("o_orderkey").alias("survey"), begin.alias("begin"), F.date_add(begin, (F.col("o_orderkey") % 3).cast("int")).alias("end"))
    v = read(spark, d, "events").select((F.col("user_id") % 8).alias("site"), F.col("ts").cast("date").alias("day"))
    return matching.near_surveys(s, v)


@query(f"""WITH {PRODUCTS}, n AS (SELECT *, row_number() OVER (PARTITION BY level, regexp_replace(scene, '_[0-9]+$', '') ORDER BY version DESC, file_id) AS k FROM pr) SELECT level, scene, CAST(version AS INTEGER) AS version, file_id FROM n WHERE k = 1""")
def newest_versions(spark: SparkSession, d: str) -> DataFrame:
    return matching.newest_versions(products(spark, d).drop("version")).select("level", "scene", "version", "file_id")


@query("SELECT l_suppkey AS file_id, max(l_quantity) AS bytes, list_sort(list(DISTINCT l_orderkey % 8)) AS consumers FROM lineitem GROUP BY l_suppkey")
def shared_products(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_quantity").alias("bytes"), (F.col("l_orderkey") % 8).alias("site"))
    return matching.shared_products(p)


@query("SELECT level, grp AS \"group\", count(DISTINCT scene) AS scenes FROM (SELECT CASE WHEN l_suppkey % 2 = 0 THEN 'a' ELSE 'b' END AS level, 'G' || (l_orderkey % 300) AS grp, l_orderkey AS scene FROM lineitem) GROUP BY 1, 2 HAVING count(DISTINCT scene) > 1")
def collision_check(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "lineitem")
    p = p.select(F.when(F.col("l_suppkey") % 2 == 0, "a").otherwise("b").alias("level"), F.concat(F.lit("G"), F.col("l_orderkey") % 300).alias("group"), F.col("l_orderkey").alias("scene"))
    return matching.collision_check(p)


@query("""WITH l AS (SELECT user_id % 50 AS scene, event_type AS pol, 'k' || (event_id % 6) AS leaf, CASE WHEN event_id % 2 = 0 THEN 'AMPLITUDE' ELSE 'INTERFEROMETRY' END AS level, event_id AS source FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY scene, pol, leaf ORDER BY level, source) AS k FROM l) SELECT scene, pol, leaf, level, source FROM n WHERE k = 1""")
def merge_levels(spark: SparkSession, d: str) -> DataFrame:
    e = read(spark, d, "events")
    level = F.when(F.col("event_id") % 2 == 0, "AMPLITUDE").otherwise("INTERFEROMETRY")
    layers = e.select((F.col("user_id") % 50).alias("scene"), F.col("event_type").alias("pol"), F.concat(F.lit("k"), F.col("event_id") % 6).alias("leaf"), level.alias("level"), F.col("event_id").alias("source"))
    return scenes.merge_levels(layers)


@query("""WITH e AS (SELECT 'c' || c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 5 <> 0), a AS (SELECT 'c' || c_custkey AS k, CASE WHEN c_custkey % 7 = 0 THEN c_nationkey + 1 ELSE c_nationkey END AS v FROM customer WHERE c_custkey % 3 <> 0)
SELECT coalesce(e.k, a.k) AS name, e.v AS expected, a.v AS actual, CASE WHEN a.k IS NULL THEN 'missing' WHEN e.k IS NULL THEN 'extra' WHEN e.v IS DISTINCT FROM a.v THEN 'changed' ELSE 'same' END AS status FROM e FULL JOIN a ON e.k = a.k""")
def reconcile(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.concat(F.lit("c"), "c_custkey").alias("name"), F.col("c_nationkey").alias("v"))
    e = c.filter("c_custkey % 5 <> 0")
    a = c.filter("c_custkey % 3 <> 0").withColumn("v", F.when(F.col("c_custkey") % 7 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return matching.reconcile(e, a, "name", "v")


@query("""WITH p AS (SELECT c_custkey AS id, c_custkey % 8 AS site, (c_acctbal % 500) AS x, ((c_custkey * 37) % 700) * 1.0 AS y FROM customer)
SELECT id, site, CAST(floor((y - 600) / -3.0) AS INTEGER) AS row, CAST(floor(x / 3.0) AS INTEGER) AS col FROM p WHERE floor((y - 600) / -3.0) BETWEEN 0 AND 149 AND floor(x / 3.0) BETWEEN 0 AND 99""")
def locate_points(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    p = c.select(F.col("c_custkey").alias("id"), (F.col("c_custkey") % 8).alias("site"), (F.col("c_acctbal") % 500).alias("x"), ((F.col("c_custkey") * 37) % 700).cast("double").alias("y"))
    g = p.select("site").distinct().withColumns({"left": F.lit(0.0), "top": F.lit(600.0), "dx": F.lit(3.0), "dy": F.lit(-3.0), "height": F.lit(150), "width": F.lit(100)})
    return matching.locate_points(p, g).select("id", "site", "row", "col")


@query("""WITH m AS (SELECT o_custkey % 20 AS grp, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 6 AS INTEGER) AS gap_days, o_orderstatus AS product FROM orders)
SELECT grp % 5 AS acquisition, count(DISTINCT CAST(date AS VARCHAR) || gap_days || product) AS n, min(date) AS first_date FROM m GROUP BY 1""")
def match_bridge(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    m = o.select((F.col("o_custkey") % 20).alias("group"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 6).cast("int").alias("gap_days"), F.col("o_orderstatus").alias("product"))
    g = m.select("group", (F.col("group") % 5).alias("acquisition")).distinct()
    return matching.match_bridge(m, g).select("acquisition", F.size("matches").cast("long").alias("n"), F.col("matches")[0]["date"].alias("first_date"))


@query(f"""WITH {PRODUCTS}, sp AS (SELECT 0 AS site, 'camp0' AS part UNION ALL SELECT 1, 'camp1') SELECT DISTINCT sp.site, scene AS name, ref AS date FROM pr JOIN sp ON contains(scene, part)""")
def select_granules(spark: SparkSession, d: str) -> DataFrame:
    cat = products(spark, d).select(F.col("scene").alias("name"), F.lit("SD").alias("product"), F.lit("X").alias("code"), F.col("ref").alias("begin"), F.col("sec").alias("single"), F.col("ring").alias("footprint"))
    specs = spark.createDataFrame([(0, "SD", None, "camp0"), (1, "SD", None, "camp1"), (2, "SD", "ZZ", None)], "site int, product string, code string, part string")
    return matching.select_granules(specs, cat, ["site", "name", "date"])[0]


@query("""WITH a AS (SELECT 'survey' AS kind, o_orderstatus AS product, CAST(o_orderdate AS DATE) AS first, NULL AS line, CAST(NULL AS DATE) AS second, NULL AS days FROM orders),
b AS (SELECT 'scene' AS kind, NULL AS product, min(CAST(l_shipdate AS DATE)) AS first, 'L' || l_orderkey AS line, max(CAST(l_shipdate AS DATE)) AS second, max(CAST(l_shipdate AS DATE)) - min(CAST(l_shipdate AS DATE)) AS days FROM lineitem GROUP BY l_orderkey)
SELECT kind, product, first, line, second, CAST(days AS INTEGER) AS days FROM a UNION ALL SELECT kind, product, first, line, second, CAST(days AS INTEGER) FROM b""")
def timeline(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "orders").select(F.col("o_orderstatus").alias("product"), F.col("o_orderdate").cast("date").alias("date"))
    day = F.col("l_shipdate").cast("date")
    c = read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min(day).alias("first"), F.max(day).alias("second")).withColumn("line", F.concat(F.lit("L"), "l_orderkey"))
    return scenes.timeline(s, c).select("kind", "product", "first", "line", "second", "days")


@query(f"WITH {GRANULES} SELECT site, CAST(min(x) AS DOUBLE) AS \"left\", CAST(min(y) AS DOUBLE) AS bottom, CAST(max(x) + 3 AS DOUBLE) AS \"right\", CAST(max(y) + 2 AS DOUBLE) AS top FROM gr GROUP BY site")
def site_bounds(spark: SparkSession, d: str) -> DataFrame:
    return matching.site_bounds(granules(spark, d))


@query(f"""WITH {GRANULES}, b AS (SELECT site, min(x) + 0.4 AS l, min(y) + 0.4 AS bo, max(x) + 3.7 AS r, max(y) + 2.2 AS t FROM gr GROUP BY site),
n AS (SELECT site, 0.5 + floor((l - 0.5) / 3) * 3 AS "left", 0.25 - ceil((0.25 - bo) / 3) * 3 AS bottom, 0.5 + ceil((r - 0.5) / 3) * 3 AS "right", 0.25 - floor((0.25 - t) / 3) * 3 AS top FROM b)
SELECT *, CAST(round(("right" - "left") / 3) AS INTEGER) AS width, CAST(round((top - bottom) / 3) AS INTEGER) AS height FROM n""")
def grid_from_bounds(spark: SparkSession, d: str) -> DataFrame:
    b = matching.site_bounds(granules(spark, d))
    b = b.select("site", (F.col("left") + 0.4).alias("left"), (F.col("bottom") + 0.4).alias("bottom"), (F.col("right") + 0.7).alias("right"), (F.col("top") + 0.2).alias("top"))
    return geometry.derive_grid(b, 0.5, 0.25, 3.0)


@query(f"""WITH {GRANULES}, c AS (SELECT site, x + unnest([0, 3, 3, 0]) AS x, y + unnest([0, 0, 2, 2]) AS y FROM gr), m AS (SELECT site, x, min(y) AS lo, max(y) AS hi FROM c GROUP BY site, x),
p AS (SELECT DISTINCT site, x, unnest([lo, hi]) AS y FROM m),
e AS (SELECT a.site, a.x, a.y, b.x AS tx, b.y AS ty FROM p a JOIN p b ON a.site = b.site AND (a.x <> b.x OR a.y <> b.y) JOIN p q ON a.site = q.site GROUP BY ALL
HAVING bool_and((b.x - a.x) * (q.y - a.y) - (b.y - a.y) * (q.x - a.x) > 0 OR ((b.x - a.x) * (q.y - a.y) = (b.y - a.y) * (q.x - a.x) AND (q.x - a.x) * (q.x - b.x) + (q.y - a.y) * (q.y - b.y) <= 0))),
o AS (SELECT *, (tx, ty) > (x, y) AS up FROM e)
SELECT CAST(site AS INTEGER) AS site, CAST(row_number() OVER (PARTITION BY site ORDER BY up DESC, CASE WHEN up THEN x ELSE -x END, CASE WHEN up THEN y ELSE -y END) - 1 AS INTEGER) AS n, CAST(x AS DOUBLE) AS x, CAST(y AS DOUBLE) AS y FROM o""")
def convex_hull(spark: SparkSession, d: str) -> DataFrame:
    p = granules(spark, d).select(F.col("site").cast("int").alias("site"), F.explode("ring").alias("p")).select("site", "p.x", "p.y")
    return matching.hull(p, ["site"])


@query(f"""WITH {PRODUCTS} SELECT site, CAST(count(*) FILTER (WHERE level = 'AMPLITUDE_GRD') AS BIGINT) AS "AMPLITUDE_GRD", CAST(count(*) FILTER (WHERE level = 'INTERFEROMETRY_GRD') AS BIGINT) AS "INTERFEROMETRY_GRD",
count(DISTINCT CASE WHEN bytes > 30 THEN file_id END) AS matched_granules, CAST(sum(bytes) AS BIGINT) AS bytes FROM pr GROUP BY site""")
def inventory_summary(spark: SparkSession, d: str) -> DataFrame:
    from cellframe.operators import audit

    p = products(spark, d).withColumns({"matched": F.col("bytes") > 30, "granule": F.col("file_id")})
    return audit.inventory_summary(p, ["AMPLITUDE_GRD", "INTERFEROMETRY_GRD"])


@query(f"""WITH {PRODUCTS} SELECT file_id, scene, bytes FROM pr ORDER BY bytes, file_id LIMIT 25""")
def smallest_products(spark: SparkSession, d: str) -> DataFrame:
    """A top-k report: the 25 smallest files."""
    return products(spark, d).select("file_id", "scene", "bytes").orderBy("bytes", "file_id").limit(25)


@query("SELECT c_custkey, CASE WHEN c_name LIKE '%1%' THEN 'WGS84' ELSE 'Unresolved in exact-product provider metadata' END AS reference, CASE WHEN c_name LIKE '%1%' THEN 'confirmed' ELSE 'unresolved' END AS status FROM customer")
def vertical_reference(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer").select("c_custkey", F.lit("D").alias("dataset"), F.lit("f").alias("filename"), F.col("c_name").alias("url"))
    rules = spark.createDataFrame([("D", None, "1", "WGS84", "confirmed")], "dataset string, filename string, url_part string, reference string, status string")
    return geometry.vertical_reference(c, rules).select("c_custkey", "reference", "status")


