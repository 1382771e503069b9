"""Queries on layers of cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.functions import geometry, values
from cellframe.model import finite, shape_of
from cellframe.model import rounded as r
from cellframe.operators import blocks, cleaning, compare, components, regrid, stats, stencils, tiles
from cellframe.plans.fixtures import CHANNELS, G_COMPLEX, G_EMB, G_EVENTS, G_ORDERS, SHAPE, channels, dense, g_complex, g_emb, g_events, g_orders, shaped

BLOCK_SQL = """SELECT row // 5 AS brow, col // 5 AS bcol, {0} FROM g, s WHERE row < height // 5 * 5 AND col < width // 5 * 5 GROUP BY row // 5, col // 5"""


@query(f"WITH {G_EVENTS}, {SHAPE} " + BLOCK_SQL.format("round(avg(v), 6) AS mean, count(v) / 25.0 AS coverage"))
def block_mean(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_mean(shaped(g_events(spark, d)), 5).select("brow", "bcol", r("mean").alias("mean"), "coverage")


@query(f"WITH {G_EVENTS}, {SHAPE}, b AS (" + BLOCK_SQL.format("round(avg(v), 6) AS mean, count(v) / 25.0 AS coverage") + ") SELECT * FROM b WHERE coverage >= 0.8")
def block_coverage(spark: SparkSession, d: str) -> DataFrame:
    return blocks.keep_blocks(blocks.block_mean(shaped(g_events(spark, d)), 5)).select("brow", "bcol", r("mean").alias("mean"), "coverage")


@query(f"""WITH {G_EVENTS}, {SHAPE}, b AS ({BLOCK_SQL.format("sum(sin(radians(v))) AS sn, sum(cos(radians(v))) AS cs, count(v) AS n")})
SELECT brow, bcol, n, round(CASE WHEN sqrt(sn * sn + cs * cs) > n * 1e-12 THEN ((degrees(atan2(sn, cs)) % 360) + 360) % 360 END, 6) AS direction FROM b""")
def block_circular_mean(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_circular_mean(shaped(g_events(spark, d)), 5).select("brow", "bcol", "n", r("direction").alias("direction"))


COMPLEX_SQL = f"""WITH {G_COMPLEX}, b AS (SELECT row // 4 AS brow, col // 4 AS bcol, sum(re) AS re, sum(im) AS im, avg(sqrt(re * re + im * im)) AS m
FROM z, (SELECT max(row) + 1 AS height FROM z) WHERE row < height // 4 * 4 GROUP BY row // 4, col // 4) """


@query(COMPLEX_SQL + "SELECT brow, bcol, round(CASE WHEN sqrt(re * re + im * im) >= 1e-12 THEN atan2(im, re) END, 6) AS phase FROM b")
def block_complex_phase(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_complex(shaped(g_complex(spark, d)), 4).select("brow", "bcol", r("phase").alias("phase"))


@query(COMPLEX_SQL + "SELECT brow, bcol, round(m, 6) AS magnitude FROM b")
def block_magnitude(spark: SparkSession, d: str) -> DataFrame:
    return blocks.block_complex(shaped(g_complex(spark, d)), 4).select("brow", "bcol", r("magnitude").alias("magnitude"))


@query(f"""WITH {G_EVENTS} SELECT layer, count(*) AS cells, count(v) AS valid, round(count(v) / count(*), 6) AS valid_fraction, min(v) AS least, max(v) AS most,
round(quantile_cont(v, 0.01), 6) AS p1, round(quantile_cont(v, 0.5), 6) AS median, round(quantile_cont(v, 0.99), 6) AS p99,
CASE WHEN count(v) = 0 THEN 'no_valid_values' ELSE 'computed' END AS status FROM g GROUP BY layer""")
def layer_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.layer_stats(g_events(spark, d))
    return s.withColumns({c: r(c) for c in ("valid_fraction", "p1", "median", "p99")})


@query(f"""WITH {G_EMB}, {G_COMPLEX}, h AS (SELECT *, row % 3 = 0 AND col % 5 = 0 AS hole FROM z)
SELECT 'z' || row % 4 AS layer, count(*) AS cells, count(*) FILTER (NOT hole) AS valid, round(count(*) FILTER (NOT hole) / count(*), 6) AS valid_fraction, NULL::DOUBLE AS least, NULL::DOUBLE AS most, NULL::DOUBLE AS median, 'not_applicable_complex' AS status FROM h GROUP BY row % 4
UNION ALL SELECT 'emb' || row % 4, count(*), count(v), round(count(v) / count(*), 6), min(v), max(v), round(quantile_cont(v, 0.5), 6) + 0.0, 'computed' FROM g GROUP BY row % 4""")
def complex_layer_stats(spark: SparkSession, d: str) -> DataFrame:
    """Real and complex layers in one table: the complex ones have counts but no order."""
    part = F.col("row") % 4
    hole = (F.col("row") % 3 == 0) & (F.col("col") % 5 == 0)
    z = g_complex(spark, d).select(F.concat(F.lit("z"), part).alias("layer"), "re", F.when(~hole, F.col("im")).alias("im"))
    cells = z.unionByName(g_emb(spark, d).select(F.concat(F.lit("emb"), part).alias("layer"), "v"), allowMissingColumns=True)
    s = stats.layer_stats(cells)
    return s.select("layer", "cells", "valid", r("valid_fraction").alias("valid_fraction"), "least", "most", r("median").alias("median"), "status")


@query("""SELECT event_id, event_type, CASE event_type WHEN 'click' THEN CASE WHEN value BETWEEN 0 AND 15 THEN value END WHEN 'view' THEN CASE WHEN value >= 10 THEN value END ELSE value END AS screened FROM events""")
def range_screen(spark: SparkSession, d: str) -> DataFrame:
    bounds = cleaning.ranges_table(spark, {"click": (0.0, 15.0), "view": (10.0, None)})
    e = spark.read.parquet(f"{d}/events.parquet").select("event_id", "event_type", F.col("value").alias("v"))
    return cleaning.range_screen(e, bounds, "event_type").select("event_id", "event_type", "screened")


@query(f"WITH {G_EMB} SELECT row, col, CASE WHEN v < -0.25 THEN NULL WHEN v < 0 THEN 0.0 ELSE v END AS depth FROM g")
def negative_policy(spark: SparkSession, d: str) -> DataFrame:
    return g_emb(spark, d).select("row", "col", cleaning.clean_snow_depth(F.col("v")).alias("depth"))


@query(f"WITH {G_EVENTS} SELECT row, col, CASE WHEN v IS NULL THEN 255 WHEN v / 100 >= 0.3 THEN 1 ELSE 0 END AS mask FROM g")
def coherence_mask(spark: SparkSession, d: str) -> DataFrame:
    return g_events(spark, d).select("row", "col", cleaning.coherence_mask(F.col("v") / 100).alias("mask"))


@query(f"""WITH {CHANNELS}, f AS (SELECT DISTINCT scene FROM ch), cells AS (SELECT scene, row, col, max(v) AS v FROM ch GROUP BY 1, 2, 3),
leaves AS (SELECT DISTINCT scene, leaf FROM ch),
ok AS (SELECT c.scene, c.row, c.col, bool_and(x.v IS NOT NULL AND x.v <> 0) AS inside FROM cells c JOIN leaves l USING (scene) LEFT JOIN ch x ON x.scene = c.scene AND x.leaf = l.leaf AND x.row = c.row AND x.col = c.col GROUP BY 1, 2, 3)
SELECT scene, row, col, CASE WHEN inside THEN v END AS v FROM cells JOIN ok USING (scene, row, col)""")
def swath_mask(spark: SparkSession, d: str) -> DataFrame:
    ch = channels(spark, d)
    cells = ch.groupBy("scene", "row", "col").agg(F.max("v").alias("v"))
    full = cells.drop("v").join(ch.select("scene", "leaf").distinct(), "scene").join(ch, ["scene", "leaf", "row", "col"], "left")
    return cleaning.swath_mask(full, cells).select("scene", "row", "col", "v")


@query(f"WITH {G_EVENTS}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM g) SELECT row, col, CAST(CASE WHEN v IS NULL THEN 0 ELSE 1 + round_even(CAST(least(greatest((v - lo) / (hi - lo), 0), 1) AS DOUBLE) * 254, 0) END AS INTEGER) AS code FROM g, b")
def quantise(spark: SparkSession, d: str) -> DataFrame:
    g = g_events(spark, d)
    bounds = g.groupBy("layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return g.join(bounds, "layer").select("row", "col", values.quantise(F.col("v"), F.col("lo"), F.col("hi"), 8).alias("code"))


@query(f"""WITH {G_EVENTS}, b AS (SELECT min(v) AS lo, max(v) AS hi FROM g), q AS (SELECT row, col, v, lo, hi, 1 + round_even(CAST((v - lo) / (hi - lo) AS DOUBLE) * 65534, 0) AS code FROM g, b)
SELECT row, col, round(lo + (code - 1) * (hi - lo) / 65534, 6) AS v2, coalesce(abs(lo + (code - 1) * (hi - lo) / 65534 - v) <= (hi - lo) / 65534, true) AS close FROM q""")
def dequantise_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    g = g_events(spark, d)
    g = g.join(g.groupBy("layer").agg(F.min("v").alias("lo"), F.max("v").alias("hi")), "layer")
    back = values.dequantise(values.quantise(F.col("v"), F.col("lo"), F.col("hi"), 16), F.col("lo"), F.col("hi"), 16)
    return g.select("row", "col", r(back).alias("v2"), F.coalesce(F.abs(back - F.col("v")) <= (F.col("hi") - F.col("lo")) / 65534, F.lit(True)).alias("close"))


@query(f"WITH {G_EMB} SELECT row, col, round(CASE WHEN v > 0 THEN 20 * log10(v) END, 6) AS db FROM g")
def to_db(spark: SparkSession, d: str) -> DataFrame:
    return g_emb(spark, d).select("row", "col", r(values.to_db(F.col("v"))).alias("db"))


@query("SELECT event_id, round((((value - user_id * 7 + 180) % 360) + 360) % 360 - 180, 6) AS d FROM events")
def signed_angle_diff(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    return e.select("event_id", r(values.signed_angle_difference(F.col("user_id") * 7, F.col("value"), 360.0)).alias("d"))


def _two(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    a = g_events(spark, d)
    b = g_orders(spark, d).withColumn("layer", F.lit("events"))
    return a, b


TWO = f"WITH {G_EVENTS}, o AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS row, CAST(o_orderkey % 100 AS INTEGER) AS col, o_totalprice / 1000 AS v FROM orders), p AS (SELECT g.row, g.col, g.v AS a, o.v AS b FROM g JOIN o ON g.row = o.row AND g.col = o.col WHERE g.v IS NOT NULL AND o.v IS NOT NULL) "


@query(TWO + "SELECT row, col, round(b - a, 6) AS d FROM p")
def compare_linear(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare(*_two(spark, d)).select("row", "col", r("d").alias("d"))


@query(TWO + "SELECT row, col, round((((b - a + 180) % 360) + 360) % 360 - 180, 6) AS d FROM p")
def compare_degrees(spark: SparkSession, d: str) -> DataFrame:
    return compare.compare(*_two(spark, d), "degrees").select("row", "col", r("d").alias("d"))


@query(TWO + "SELECT CAST(b >= 100 AS INTEGER) - CAST(a >= 100 AS INTEGER) AS d, count(*) AS cells FROM p GROUP BY 1")
def compare_mask(spark: SparkSession, d: str) -> DataFrame:
    return compare.transitions(compare.compare(*_two(spark, d), "mask", cutoff=100.0)).select("d", "cells")


PAIRS = f"WITH {G_EVENTS}, o AS (SELECT CAST(o_orderkey // 100 AS INTEGER) AS row, CAST(o_orderkey % 100 AS INTEGER) AS col, o_totalprice / 1000 AS v FROM orders), p AS (SELECT g.v AS a, o.v AS b FROM g LEFT JOIN o ON g.row = o.row AND g.col = o.col) "


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    a, b = _two(spark, d)
    return a.withColumnRenamed("v", "a").join(b.withColumnRenamed("v", "b"), ["layer", "row", "col"], "left")


@query(PAIRS + "SELECT count(*) AS total, count(b - a) AS n, round(count(b - a) / count(*), 6) AS coverage, round(avg(b - a), 6) AS mean, round(avg(abs(b - a)), 6) AS mae, round(sqrt(avg((b - a) * (b - a))), 6) AS rmse, round(min(b - a), 6) AS least, round(max(b - a), 6) AS most FROM p")
def difference_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.difference_stats(_pairs(spark, d))
    return s.select("total", "n", *[r(c).alias(c) for c in ("coverage", "mean", "mae", "rmse", "least", "most")])


@query(PAIRS + """, q AS (SELECT a, b, CASE WHEN a > 10 AND b IS NOT NULL THEN a - b END AS d FROM p)
SELECT round(quantile_cont(d, 0.5), 6) AS median_offset, round(avg(abs(d)), 6) AS mean_abs_offset, round(quantile_cont(abs(d), 0.99), 6) AS p99_abs_offset, round(sqrt(avg(d * d)), 6) AS rmse,
count(d) AS compared, round(count(*) FILTER (WHERE a <= 10) / count(*), 6) AS sentinel_fraction FROM q""")
def dem_offset_stats(spark: SparkSession, d: str) -> DataFrame:
    s = stats.offset_stats(_pairs(spark, d), floor=10.0)
    return s.select("compared", *[r(c).alias(c) for c in ("median_offset", "mean_abs_offset", "p99_abs_offset", "rmse", "sentinel_fraction")])


@query(f"WITH {G_EVENTS} SELECT count(*) FILTER (WHERE v >= 90) AS n, round(count(*) FILTER (WHERE v >= 90) / count(v), 6) AS fraction FROM g")
def incidence_ge_90(spark: SparkSession, d: str) -> DataFrame:
    return stats.steep_angles(g_events(spark, d)).select("n", r("fraction").alias("fraction"))


@query(f"WITH {G_EMB}, q AS (SELECT quantile_cont(v, 0.02) AS a, quantile_cont(v, 0.98) AS b FROM g) SELECT round(-greatest(abs(a), abs(b)), 6) AS lo, round(greatest(abs(a), abs(b)), 6) AS hi FROM q")
def stretch_bounds(spark: SparkSession, d: str) -> DataFrame:
    return stats.stretch(g_emb(spark, d), 2, 98, zero_centred=True).select(r("lo").alias("lo"), r("hi").alias("hi"))


HORN = """, x AS (SELECT row, col, v, {0} AS x FROM g, s),
h AS (SELECT *, coalesce(lag(x) OVER (PARTITION BY row ORDER BY col), x) AS l, coalesce(lead(x) OVER (PARTITION BY row ORDER BY col), x) AS r FROM x),
n AS (SELECT row, col, v, l AS d, r AS f, coalesce(lag(l) OVER w, l) AS a, coalesce(lag(x) OVER w, x) AS b, coalesce(lag(r) OVER w, r) AS c, coalesce(lead(l) OVER w, l) AS p, coalesce(lead(x) OVER w, x) AS q, coalesce(lead(r) OVER w, r) AS t FROM h WINDOW w AS (PARTITION BY col ORDER BY row)),
gd AS (SELECT *, ((c + 2 * f + t) - (a + 2 * d + p)) / 24.0 AS dx, ((a + 2 * b + c) - (p + 2 * q + t)) / 24.0 AS dy FROM n) """
PLAIN = "v"


@query(f"WITH {G_ORDERS}, {SHAPE}{HORN.format(PLAIN)} SELECT row, col, round(degrees(atan(sqrt(dx * dx + dy * dy))), 6) AS slope, round(CASE WHEN sqrt(dx * dx + dy * dy) >= 1e-9 THEN ((degrees(atan2(-dx, -dy)) % 360) + 360) % 360 END, 6) AS aspect FROM gd")
def horn_slope_aspect(spark: SparkSession, d: str) -> DataFrame:
    out = stencils.slope_aspect(dense(g_orders(spark, d)), 3.0)
    return out.select("row", "col", r("slope").alias("slope"), r("aspect").alias("aspect"))


FILLED = "coalesce(v, m)"


@query(f"WITH {G_EVENTS}, s AS (SELECT max(row) + 1 AS height, max(col) + 1 AS width, avg(v) AS m FROM g){HORN.format(FILLED)} SELECT row, col, round(CASE WHEN v IS NOT NULL THEN -dx / sqrt(dx * dx + dy * dy + 1) END, 6) AS nx, round(CASE WHEN v IS NOT NULL THEN -dy / sqrt(dx * dx + dy * dy + 1) END, 6) AS ny, round(CASE WHEN v IS NOT NULL THEN 1 / sqrt(dx * dx + dy * dy + 1) END, 6) AS nz FROM gd")
def surface_normals(spark: SparkSession, d: str) -> DataFrame:
    out = stencils.surface_normals(dense(g_events(spark, d)), 3.0)
    return out.select("row", "col", *[r(c).alias(c) for c in ("nx", "ny", "nz")])


@query(f"""WITH {G_EVENTS}, h AS (SELECT a.row, a.col, sum(CAST(b.v >= 50 AS INTEGER)) AS hits, count(b.v) AS seen FROM g a JOIN (SELECT row, unnest(range(col - 2, col + 3)) AS c2, v FROM g) b ON a.row = b.row AND a.col = b.c2 GROUP BY 1, 2)
SELECT a.row, a.col, round(sum(b.hits) / nullif(sum(b.seen), 0), 6) AS fraction FROM g a JOIN (SELECT unnest(range(row - 2, row + 3)) AS r2, col, hits, seen FROM h) b ON a.row = b.r2 AND a.col = b.col GROUP BY 1, 2""")
def box_fraction(spark: SparkSession, d: str) -> DataFrame:
    out = stencils.box_fraction(dense(g_events(spark, d)), F.col("v") >= 50, 4)
    return out.select("row", "col", r("fraction").alias("fraction"))


NEAR = ", {1} AS (SELECT c.row, c.col, c.v, l.v AS l, r.v AS r, u.v AS u, w.v AS w FROM {0} c LEFT JOIN {0} l ON l.row = c.row AND l.col = c.col - 1 LEFT JOIN {0} r ON r.row = c.row AND r.col = c.col + 1 LEFT JOIN {0} u ON u.row = c.row - 1 AND u.col = c.col LEFT JOIN {0} w ON w.row = c.row + 1 AND w.col = c.col)"


@query(f"WITH {G_EVENTS}{NEAR.format('g', 'n')} SELECT row, col, CASE WHEN v IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND w IS NOT NULL AND abs(v - (l + r + u + w - least(l, r, u, w) - greatest(l, r, u, w)) / 2) > 60 THEN NULL ELSE v END AS v FROM n")
def spike_screen(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.spike_screen(dense(g_events(spark, d)), F.lit(60.0)).select("row", "col", "v")


FILL = ", {1} AS (SELECT row, col, CASE WHEN v IS NULL AND (CAST(l IS NOT NULL AS INTEGER) + CAST(r IS NOT NULL AS INTEGER) + CAST(u IS NOT NULL AS INTEGER) + CAST(w IS NOT NULL AS INTEGER)) >= 3 THEN (coalesce(l, 0) + coalesce(r, 0) + coalesce(u, 0) + coalesce(w, 0)) / (CAST(l IS NOT NULL AS INTEGER) + CAST(r IS NOT NULL AS INTEGER) + CAST(u IS NOT NULL AS INTEGER) + CAST(w IS NOT NULL AS INTEGER)) ELSE v END AS v FROM {0})"


@query(f"WITH {G_EVENTS}{NEAR.format('g', 'n1')}{FILL.format('n1', 'f1')}{NEAR.format('f1', 'n2')}{FILL.format('n2', 'f2')} SELECT row, col, round(v, 6) AS v FROM f2")
def fill_gaps(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.fill_gaps(dense(g_events(spark, d))).select("row", "col", r("v").alias("v"))


@query(f"""WITH {G_EVENTS}, k AS (SELECT row, col, CASE WHEN v BETWEEN -1 AND 120 THEN v END AS v, v AS before FROM g){NEAR.format('k', 'n0')},
sp AS (SELECT row, col, CASE WHEN v IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND w IS NOT NULL AND abs(v - (l + r + u + w - least(l, r, u, w) - greatest(l, r, u, w)) / 2) > 30 THEN NULL ELSE v END AS v FROM n0)
{NEAR.format('sp', 'n1')}{FILL.format('n1', 'f1')}{NEAR.format('f1', 'n2')}{FILL.format('n2', 'f2')}
SELECT count(*) FILTER (WHERE g.v IS NOT NULL AND f2.v IS NULL) AS removed, count(*) FILTER (WHERE g.v IS NULL AND f2.v IS NOT NULL) AS filled FROM g JOIN f2 ON g.row = f2.row AND g.col = f2.col""")
def clean_layer(spark: SparkSession, d: str) -> DataFrame:
    return cleaning.cleaning_counts(cleaning.clean_layer(shaped(g_events(spark, d)), "VH")).select("removed", "filled")


@query(f"""WITH {G_EVENTS}, o AS (SELECT row, col, CASE WHEN row % 97 = 3 AND col % 7 = 0 AND v IS NOT NULL THEN -9999 WHEN row % 31 = 5 AND col % 5 = 0 THEN v + 200 ELSE v END AS v FROM g),
k AS (SELECT row, col, CASE WHEN v BETWEEN -1 AND 120 THEN v END AS v, v AS before FROM o){NEAR.format('k', 'n0')},
sp AS (SELECT row, col, CASE WHEN v IS NOT NULL AND l IS NOT NULL AND r IS NOT NULL AND u IS NOT NULL AND w IS NOT NULL AND abs(v - (l + r + u + w - least(l, r, u, w) - greatest(l, r, u, w)) / 2) > 30 THEN NULL ELSE v END AS v FROM n0)
{NEAR.format('sp', 'n1')}{FILL.format('n1', 'f1')}{NEAR.format('f1', 'n2')}{FILL.format('n2', 'f2')}
SELECT count(*) FILTER (WHERE k.before = -9999) AS sentinels, count(*) FILTER (WHERE k.before <> -9999 AND k.v IS NULL) AS out_of_range, count(*) FILTER (WHERE k.v IS NOT NULL AND sp.v IS NULL) AS spikes, count(*) FILTER (WHERE sp.v IS NULL AND f2.v IS NOT NULL) AS gaps_filled,
count(*) FILTER (WHERE k.before IS NOT NULL AND sp.v IS NULL) AS removed_total, count(f2.v) AS valid, CAST(NULL AS VARCHAR) AS empty_reason FROM k JOIN sp USING (row, col) JOIN f2 USING (row, col)""")
def cleaning_steps(spark: SparkSession, d: str) -> DataFrame:
    """What each step of cleaning did to a layer with undeclared fills and values out of range in it."""
    at = lambda c, m, k: F.col(c) % m == k
    v = F.when(at("row", 97, 3) & at("col", 7, 0) & F.col("v").isNotNull(), -9999.0).when(at("row", 31, 5) & at("col", 5, 0), F.col("v") + 200).otherwise(F.col("v"))
    cells = g_events(spark, d).withColumn("v", v)
    return cleaning.cleaning_steps(cleaning.clean_layer(shaped(cells), "VH")).drop("layer")


@query(f"""WITH {G_EVENTS}, s AS (SELECT max(row) + 1 AS height, max(col) + 1 AS width, avg(v) AS m FROM g){HORN.format(FILLED)},
q AS (SELECT a.row, a.col, a.v IS NOT NULL AND count(b.v) = count(*) AS whole FROM g a LEFT JOIN g b ON b.row BETWEEN a.row - 1 AND a.row + 1 AND b.col BETWEEN a.col - 1 AND a.col + 1 GROUP BY a.row, a.col, a.v)
SELECT row, col, round(CASE WHEN whole THEN degrees(atan(sqrt(dx * dx + dy * dy))) END, 6) AS slope, round(CASE WHEN whole AND sqrt(dx * dx + dy * dy) >= 1e-9 THEN ((degrees(atan2(-dx, -dy)) % 360) + 360) % 360 END, 6) AS aspect,
round(-dx / sqrt(dx * dx + dy * dy + 1), 6) AS nx, round(-dy / sqrt(dx * dx + dy * dy + 1), 6) AS ny, round(1 / sqrt(dx * dx + dy * dy + 1), 6) AS nz FROM gd JOIN q USING (row, col) WHERE v IS NOT NULL""")
def terrain_tiles(spark: SparkSession, d: str) -> DataFrame:
    """Slope, aspect and normals of a layer with holes, in one pass over its tiles."""
    out = tiles.terrain(shaped(g_events(spark, d)), 3.0)
    return out.select("row", "col", *[r(finite(F.col(c))).alias(c) for c in ("slope", "aspect", "nx", "ny", "nz")])


DESPECKLE = f"""WITH RECURSIVE {G_EVENTS}, ok AS (SELECT row, col FROM g WHERE v >= 20),
rn AS (SELECT row, min(col) AS c0, max(col) AS c1, count(*) AS n FROM (SELECT row, col, col - row_number() OVER (PARTITION BY row ORDER BY col) AS i FROM ok) GROUP BY row, i),
rid AS (SELECT *, row * 1000 + c0 AS id FROM rn), e AS (SELECT a.id AS a, b.id AS b FROM rid a JOIN rid b ON (b.row = a.row + 1 OR b.row = a.row - 1) AND a.c0 <= b.c1 AND b.c0 <= a.c1),
w(id, reach) AS (SELECT id, id FROM rid UNION SELECT w.id, e.b FROM w JOIN e ON w.reach = e.a),
lab AS (SELECT id, min(reach) AS label FROM w GROUP BY id), sz AS (SELECT label, sum(n) AS size FROM lab JOIN rid USING (id) GROUP BY label),
keep AS (SELECT row, c0, c1 FROM rid JOIN lab USING (id) JOIN sz USING (label) WHERE size >= 4 OR (SELECT count(*) FROM sz) = 1)
SELECT g.row, g.col, CASE WHEN keep.row IS NOT NULL THEN g.v END AS v FROM g LEFT JOIN keep ON g.row = keep.row AND g.col BETWEEN keep.c0 AND keep.c1"""


@query(DESPECKLE)
def despeckle(spark: SparkSession, d: str) -> DataFrame:
    g = g_events(spark, d).withColumn("v", F.when(F.col("v") >= 20, F.col("v")))
    return components.despeckle(g, 4).select("row", "col", "v")


def _targets(g: DataFrame) -> DataFrame:
    t = g.select("layer", F.col("row").alias("trow"), F.col("col").alias("tcol"))
    return t.select("*", (F.col("tcol") * 0.75 + 0.3).alias("x"), (F.col("trow") * 0.5 - 0.25).alias("y"))


RESAMPLE = f"WITH {G_EVENTS}, {SHAPE}, t AS (SELECT row AS trow, col AS tcol, col * 0.75 + 0.3 AS x, row * 0.5 - 0.25 AS y FROM g), i AS (SELECT *, least(greatest(CAST(floor(y + 0.5) AS INTEGER), 0), height - 1) AS nr, least(greatest(CAST(floor(x + 0.5) AS INTEGER), 0), width - 1) AS nc FROM t, s WHERE x BETWEEN -0.5 AND width - 0.5 AND y BETWEEN -0.5 AND height - 0.5) "


@query(RESAMPLE + "SELECT trow, tcol, g.v FROM i LEFT JOIN g ON i.nr = g.row AND i.nc = g.col")
def resample_nearest(spark: SparkSession, d: str) -> DataFrame:
    g = g_events(spark, d)
    return regrid.resample(_targets(g), g, shape_of(g)).select("trow", "tcol", "v")


@query(RESAMPLE + """, c AS (SELECT trow, tcol, height, width, least(greatest(x, 0), width - 1) AS cx, least(greatest(y, 0), height - 1) AS cy FROM i),
f AS (SELECT *, CAST(floor(cx) AS INTEGER) AS x0, CAST(floor(cy) AS INTEGER) AS y0, cx - floor(cx) AS tx, cy - floor(cy) AS ty, least(CAST(floor(cx) AS INTEGER) + 1, width - 1) AS x1, least(CAST(floor(cy) AS INTEGER) + 1, height - 1) AS y1 FROM c)
SELECT trow, tcol, round(CASE WHEN ((1 - tx) * (1 - ty) > 0 AND a.v IS NULL) OR (tx * (1 - ty) > 0 AND b.v IS NULL) OR ((1 - tx) * ty > 0 AND p.v IS NULL) OR (tx * ty > 0 AND q.v IS NULL) THEN NULL
ELSE coalesce(a.v, 0) * (1 - tx) * (1 - ty) + coalesce(b.v, 0) * tx * (1 - ty) + coalesce(p.v, 0) * (1 - tx) * ty + coalesce(q.v, 0) * tx * ty END, 6) AS v
FROM f LEFT JOIN g a ON a.row = y0 AND a.col = x0 LEFT JOIN g b ON b.row = y0 AND b.col = x1 LEFT JOIN g p ON p.row = y1 AND p.col = x0 LEFT JOIN g q ON q.row = y1 AND q.col = x1""")
def resample_bilinear(spark: SparkSession, d: str) -> DataFrame:
    g = g_events(spark, d)
    out = regrid.resample(_targets(g), g, shape_of(g), "bilinear")
    return out.select("trow", "tcol", r("v").alias("v"))


OVERLAP = f"""WITH {G_EVENTS}, t AS (SELECT unnest(range(0, (SELECT CAST(ceil((max(row) + 0.5) / 2.4) AS BIGINT) FROM g))) AS trow),
u AS (SELECT unnest(range(0, (SELECT CAST(ceil((max(col) + 0.75) / 2.4) AS BIGINT) FROM g))) AS tcol),
w AS (SELECT trow, tcol, v, (least(row - 0.5 + 1, (trow + 1) * 2.4) - greatest(row - 0.5, trow * 2.4)) * (least(col - 0.25 + 1, (tcol + 1) * 2.4) - greatest(col - 0.25, tcol * 2.4)) AS w
FROM g JOIN t ON row - 0.5 + 1 > trow * 2.4 AND row - 0.5 < (trow + 1) * 2.4 JOIN u ON col - 0.25 + 1 > tcol * 2.4 AND col - 0.25 < (tcol + 1) * 2.4 WHERE v IS NOT NULL) """


def covering(spark: SparkSession, d: str) -> DataFrame:
    """Overlaps of the layer with a coarser lattice that covers it from (0.5, 0.25) on."""
    cells = shaped(g_events(spark, d))
    return blocks.overlaps(cells, 2.4, 0.5, 0.25, F.ceil((F.col("height") - 0.5) / 2.4), F.ceil((F.col("width") - 0.25) / 2.4))


@query(OVERLAP + "SELECT trow, tcol, round(sum(w * v) / sum(w), 9) AS mean FROM w WHERE w > 0 GROUP BY trow, tcol")
def overlap_average(spark: SparkSession, d: str) -> DataFrame:
    w = covering(spark, d)
    return blocks.overlap_average(w).select("trow", "tcol", r("mean", 9).alias("mean"))


@query(OVERLAP + ", a AS (SELECT trow, tcol, sum(w * sin(radians(v))) AS sn, sum(w * cos(radians(v))) AS cs, sum(w) AS n FROM w WHERE w > 0 GROUP BY 1, 2) SELECT trow, tcol, round(CASE WHEN sqrt(sn * sn + cs * cs) > n * 1e-12 THEN ((degrees(atan2(sn, cs)) % 360) + 360) % 360 END, 6) AS direction FROM a")
def overlap_direction(spark: SparkSession, d: str) -> DataFrame:
    w = covering(spark, d)
    return blocks.overlap_direction(w).select("trow", "tcol", r("direction").alias("direction"))


@query(OVERLAP + "SELECT trow, tcol, CAST(sum(w * CAST(v >= 50 AS INTEGER)) / sum(w) >= 0.5 AS INTEGER) AS class FROM w WHERE w > 0 GROUP BY 1, 2")
def overlap_majority(spark: SparkSession, d: str) -> DataFrame:
    w = covering(spark, d).withColumn("v", (F.col("v") >= 50).cast("int"))
    return blocks.overlap_majority(w).select("trow", "tcol", "class")


@query(f"WITH {G_EVENTS}, {SHAPE}, b AS (" + BLOCK_SQL.format("avg(v) AS mean") + ") SELECT brow * 5 + i AS row, bcol * 5 + j AS col, round(mean, 6) AS v FROM b, (SELECT unnest(range(0, 5)) AS i), (SELECT unnest(range(0, 5)) AS j)")
def upsample(spark: SparkSession, d: str) -> DataFrame:
    b = blocks.block_mean(shaped(g_events(spark, d)), 5)
    return blocks.upsample(b, 5).select("row", "col", r("v").alias("v"))


@query(f"WITH {G_EVENTS} SELECT layer, count(v) AS valid, round(count(v) * 9 / 1e6, 9) AS area_km2 FROM g GROUP BY layer")
def area_check(spark: SparkSession, d: str) -> DataFrame:
    a = stats.area_km2(stats.layer_stats(g_events(spark, d)), 3.0)
    return a.select("layer", "valid", r("area_km2", 9).alias("area_km2"))


@query(f"WITH {G_EVENTS}, o AS (SELECT row, col, CASE WHEN row % 7 = 0 THEN v + 0.001 ELSE v END AS v FROM g), m AS (SELECT g.row, g.col, g.v AS a, o.v AS b FROM g JOIN o ON g.row = o.row AND g.col = o.col) SELECT round(max(abs(a - b)), 6) AS largest, CASE WHEN max(abs(a - b)) = 0 THEN 'identical' WHEN max(abs(a - b)) <= 1e-4 * greatest(1, max(abs(a)), max(abs(b))) THEN 'close' ELSE 'different' END AS verdict FROM m")
def layer_equality(spark: SparkSession, d: str) -> DataFrame:
    a = g_events(spark, d)
    b = a.withColumn("v", F.when(F.col("row") % 7 == 0, F.col("v") + 0.001).otherwise(F.col("v")))
    return compare.layer_equality(a, b).select(r("largest").alias("largest"), "verdict")


@query(f"WITH {G_EVENTS} SELECT layer, count(*) AS cells, count(v) AS valid, CAST(sum(CAST('0x' || substr(md5(row || ':' || col || ':' || coalesce(CAST(CAST(round(v * 100) AS BIGINT) AS VARCHAR), '')), 1, 8) AS BIGINT)) AS VARCHAR) AS content FROM g GROUP BY layer")
def fingerprint(spark: SparkSession, d: str) -> DataFrame:
    h = F.conv(F.substring(F.md5(F.concat_ws(":", "row", "col", F.coalesce(F.round(F.col("v") * 100).cast("long").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("decimal(38,0)")
    return stats.fingerprint(g_events(spark, d), hashed=h).withColumn("content", F.col("content").cast("string"))


INCIDENCE = f"""WITH {G_ORDERS}, {SHAPE}{HORN.format(PLAIN)}, q AS (SELECT row, col, v, -dx / sqrt(dx * dx + dy * dy + 1) AS nx, -dy / sqrt(dx * dx + dy * dy + 1) AS ny, 1 / sqrt(dx * dx + dy * dy + 1) AS nz, (col + 0.5) * 3 - 100.0 AS vx, (row + 0.5) * -3 + 50.0 AS vy, sin(radians(30)) AS hx, cos(radians(30)) AS hy FROM gd),
t AS (SELECT *, vx * hx + vy * hy AS al, vx * hy - vy * hx AS ac FROM q), l AS (SELECT *, al * hx - vx AS lx, al * hy - vy AS ly, 12000 - v AS lz FROM t), m AS (SELECT *, sqrt(lx * lx + ly * ly + lz * lz) AS n FROM l)
SELECT row, col, round(CASE WHEN ac < -1e-7 THEN degrees(acos(least(greatest((lx * nx + ly * ny + lz * nz) / n, -1), 1))) END, 6) AS local, round(CASE WHEN ac < -1e-7 THEN degrees(acos(least(greatest(lz / n, -1), 1))) END, 6) AS flat FROM m"""


@query(INCIDENCE)
def view_incidence(spark: SparkSession, d: str) -> DataFrame:
    n = stencils.surface_normals(dense(g_orders(spark, d)), 3.0)
    x, y = geometry.cell_center(F.col("row"), F.col("col"), F.lit(0.0), F.lit(0.0), F.lit(3.0), F.lit(-3.0))
    out = geometry.view_incidence(n.withColumns({"x": x, "y": y}), F.lit(100.0), F.lit(-50.0), F.lit(30.0), F.lit(12000.0), F.lit("Left"))
    return out.select("row", "col", r("local").alias("local"), r("flat").alias("flat"))


@query(f"WITH {G_EVENTS}, {SHAPE} SELECT g.row, g.col, v FROM g, s WHERE g.row % 4 = 0 AND g.col % 4 = 0")
def sample_preview(spark: SparkSession, d: str) -> DataFrame:
    from cellframe.operators.samples import every_nth

    return every_nth(g_events(spark, d), 4).select("row", "col", "v")


@query(f"WITH {G_EVENTS} SELECT row, col, v FROM g WHERE row BETWEEN 2 AND 7 AND col BETWEEN 12 AND 41")
def window_read(spark: SparkSession, d: str) -> DataFrame:
    return regrid.window_read(g_events(spark, d), 39.0, -21.0, 123.0, -9.0, 3.0, 0.0, 0.0, margin=1).select("row", "col", "v")
