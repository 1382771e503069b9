"""Queries for tables that reports show, and for inventories that archives are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.functions import names
from cellframe.model import rounded as r
from cellframe.operators import matching, reports, samples, scenes
from cellframe.plans.fixtures import PRODUCTS, SAMPLES, products, read
from cellframe.plans.fixtures import samples as sample_rows
from cellframe.sources import texts

AREAS = """WITH l AS (SELECT o_custkey % 20 AS site, 'LIDAR/' || CASE WHEN o_orderkey % 7 = 0 THEN 'DERIVED/' ELSE '' END || o_orderpriority AS layer, count(*) AS valid FROM orders GROUP BY 1, 2),
b AS (SELECT site, layer, valid * 9 / 1e6 AS a, (site % 5 + 1) * 0.002 AS ref FROM l WHERE layer NOT LIKE 'LIDAR/DERIVED/%' AND site < 18),
n AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY abs((a - ref) / ref * 100), layer) AS k FROM b),
w AS (SELECT site, layer, a, ref FROM n WHERE k = 1), t AS (SELECT NULL AS site, NULL AS layer, sum(a) AS a, sum(ref) AS ref FROM w),
e AS (SELECT *, (a - ref) / ref * 100 AS e, 10.0 AS most FROM w UNION ALL SELECT *, (a - ref) / ref * 100, 5.0 FROM t)
SELECT site, layer, round(a, 9) AS area_km2, round(ref, 9) AS reference, round(e, 6) AS error_percent, abs(e) < most AS fine FROM e"""


@query(AREAS)
def area_agreement(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    name = F.concat(F.lit("LIDAR/"), F.when(F.col("o_orderkey") % 7 == 0, "DERIVED/").otherwise(""), "o_orderpriority")
    layers = o.groupBy((F.col("o_custkey") % 20).alias("site"), name.alias("layer")).agg(F.count("*").alias("valid"))
    known = layers.select("site").distinct().filter("site < 18").withColumn("reference", (F.col("site") % 5 + 1) * 0.002)
    out = reports.area_agreement(layers, known, 3.0, 10.0, 5.0)
    return out.select("site", "layer", r("area_km2", 9).alias("area_km2"), r("reference", 9).alias("reference"), r("error_percent").alias("error_percent"), "fine")


RESULTS = f"""WITH {SAMPLES}, e AS (SELECT CASE WHEN site = 7 THEN 'random' ELSE 's' || site END AS site, line % 3 AS scale, CASE WHEN scene % 2 = 0 THEN 'forest' ELSE 'boost' END AS model, 'all' AS features,
avg(y) / 1000 AS r2, avg(quantity) AS rmse, avg(size) AS skill, avg(discount) AS bias FROM sm WHERE site <> 7 OR line % 3 > 0 GROUP BY 1, 2, 3) """


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Scores of held-out sites; the last site's stand for those of a random split, which one scale lacks."""
    s = sample_rows(spark, d).filter("site <> 7 or line % 3 > 0").withColumns({"scale": F.col("line") % 3, "model": F.when(F.col("scene") % 2 == 0, "forest").otherwise("boost"), "features": F.lit("all")})
    s = s.withColumn("site", F.when(F.col("site") == 7, "random").otherwise(F.concat(F.lit("s"), "site")))
    return s.groupBy("site", "scale", "model", "features").agg((F.avg("y") / 1000).alias("r2"), F.avg("quantity").alias("rmse"), F.avg("size").alias("skill"), F.avg("discount").alias("bias"))


@query(RESULTS + """, h AS (SELECT scale, model, features, avg(r2) AS mean_r2, quantile_cont(r2, 0.5) AS median_r2, avg(rmse) AS mean_rmse, avg(skill) AS mean_skill FROM e WHERE site <> 'random' GROUP BY 1, 2, 3),
s AS (SELECT scale, avg(r2) AS s FROM e WHERE site = 'random' GROUP BY 1)
SELECT h.scale, model, features, round(mean_r2, 6) AS mean_r2, round(median_r2, 6) AS median_r2, round(mean_rmse, 6) AS mean_rmse, round(mean_skill, 6) AS mean_skill, round(s, 6) AS random_split_r2 FROM h LEFT JOIN s ON h.scale = s.scale""")
def scale_table(spark: SparkSession, d: str) -> DataFrame:
    out = reports.scale_table(_results(spark, d), "random")
    return out.select("scale", "model", "features", *[r(c).alias(c) for c in ("mean_r2", "median_r2", "mean_rmse", "mean_skill", "random_split_r2")])


@query(RESULTS + "SELECT site, " + ", ".join(f"round(max({c}) FILTER (WHERE model = '{m}'), 3) AS {m}_{c}" for m in ("boost", "forest") for c in ("r2", "rmse", "bias")) + " FROM e WHERE scale = 0 GROUP BY site")
def summary_table(spark: SparkSession, d: str) -> DataFrame:
    """One scale's table of all three measures."""
    return reports.summary_table(_results(spark, d).filter("scale = 0"), ["boost", "forest"])


FEATURE_NAMES = ("HH_coherence", "VV_amp1_db", "inc_local", "canopy_fraction", "pair_days", "elevation", "slope")
INCREASE = "(y - 1500 * quantity) / 100000"


@query(f"""WITH {SAMPLES}, i AS (SELECT site % 2 AS scale, CASE WHEN scene % 2 = 0 THEN 'forest' ELSE 'boost' END AS model, line AS k, avg({INCREASE}) * 100 AS cm FROM sm WHERE line < 7 OR scene % 2 = 0 GROUP BY 1, 2, 3),
p AS (SELECT scale, k, max(cm) FILTER (WHERE model = 'boost') AS boost, max(cm) FILTER (WHERE model = 'forest') AS forest, avg(cm) AS cm FROM i GROUP BY 1, 2),
f AS (SELECT *, {list(FEATURE_NAMES)}[k] AS feature, ['Radar · HH', 'Radar · VV', 'Radar geometry', 'Canopy', 'Timing', 'Terrain', 'Terrain'][k] AS grp, ['Radar', 'Radar', 'Radar', 'Canopy', 'Timing', 'Terrain', 'Terrain'][k] AS fam FROM p),
s AS (SELECT *, coalesce(greatest(cm, 0) / nullif(sum(greatest(cm, 0)) OVER (PARTITION BY scale), 0), 0) AS share FROM f)
SELECT scale, feature, grp AS "group", round(boost, 6) AS boost, round(forest, 6) AS forest, round(cm, 6) AS cm, round(share, 6) AS share, round(sum(share) OVER (PARTITION BY scale, fam), 6) AS group_share,
CAST(row_number() OVER (PARTITION BY scale ORDER BY cm DESC, feature) AS INTEGER) AS rank FROM s""")
def importance_table(spark: SparkSession, d: str) -> DataFrame:
    """Lines of items as features; one of them only a forest has."""
    feature = F.element_at(F.array(*[F.lit(f) for f in FEATURE_NAMES]), F.col("line").cast("int"))
    s = sample_rows(spark, d).filter("line < 7 or scene % 2 = 0")
    rows = s.select((F.col("site") % 2).alias("scale"), F.when(F.col("scene") % 2 == 0, "forest").otherwise("boost").alias("model"), feature.alias("feature"), F.expr(INCREASE).alias("increase"))
    out = reports.importance_table(rows, ["boost", "forest"])
    return out.select("scale", "feature", "group", *[r(c).alias(c) for c in ("boost", "forest", "cm", "share", "group_share")], "rank")


@query("""WITH t AS (SELECT c_nationkey AS site, count(*) FILTER (WHERE c_custkey % 3 = 0) AS groups, count(*) FILTER (WHERE c_custkey % 3 > 0) AS datasets, sum(c_custkey % 4) AS a FROM customer GROUP BY 1),
l AS (SELECT s_nationkey AS site, count(*) AS layers, bool_or(s_suppkey % 6 = 0) AS depth FROM supplier GROUP BY 1)
SELECT n_nationkey AS site, coalesce(layers, 0) AS layers, coalesce(groups, 0) AS groups, coalesce(datasets, 0) AS datasets, CAST(coalesce(a, 0) + 2 AS BIGINT) AS attrs, coalesce(depth, false) AS has_depth FROM nation LEFT JOIN t ON t.site = n_nationkey LEFT JOIN l ON l.site = n_nationkey""")
def site_contents(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    attrs = F.map_from_entries(F.transform(F.filter(F.array(F.lit(1), F.lit(2), F.lit(3)), lambda i: i <= k % 4), lambda i: F.struct(i.cast("string").alias("k"), F.lit("v").alias("v"))))
    tree = read(spark, d, "customer").select(F.col("c_nationkey").alias("site"), F.when(k % 3 == 0, "group").otherwise("dataset").alias("kind"), attrs.alias("attrs"))
    own = read(spark, d, "nation").select(F.col("n_nationkey").alias("site"), F.create_map(F.lit("name"), "n_name", F.lit("state"), "n_name").alias("attrs"))
    layers = read(spark, d, "supplier").select(F.col("s_nationkey").alias("site"), F.when(F.col("s_suppkey") % 6 == 0, "snow_depth").otherwise("cor").alias("leaf"))
    return reports.site_contents(tree, own, layers)


@query(f"""WITH {SAMPLES}, m AS (SELECT site, brow, bcol, avg(quantity * retail) AS b, avg(size * 100) AS f, min(y) AS l FROM sm GROUP BY 1, 2, 3), s AS (SELECT site, avg(b) - avg(l) AS bias FROM m GROUP BY 1),
w AS (SELECT m.*, bias FROM m JOIN s ON m.site = s.site)
SELECT site, brow, bcol, band, round(v, 4) AS v FROM (SELECT site, brow, bcol, unnest(['boosting', 'forest', 'label', 'boosting_error', 'boosting_debiased']) AS band, unnest([b, f, l, b - l, b - bias]) AS v FROM w)""")
def prediction_bands(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(spark, d)
    blocks = s.groupBy("site", "brow", "bcol").agg(F.avg(F.col("quantity") * F.col("retail")).alias("boost"), F.avg(F.col("size") * 100).alias("forest"), F.min("y").alias("label"))
    return reports.prediction_bands(blocks).select("site", "brow", "bcol", "band", r("v", 4).alias("v"))


@query("""WITH g AS (SELECT s_nationkey % 8 AS site, CASE WHEN s_suppkey % 5 = 0 THEN 'SWE' WHEN s_suppkey % 9 = 0 THEN 'DENSITY' ELSE 'SD' END AS product, s_name AS filename FROM supplier),
w AS (SELECT site, count(*) FILTER (WHERE product = 'SD') AS want FROM g GROUP BY 1),
l AS (SELECT s_nationkey % 8 AS site, count(*) AS got FROM supplier WHERE s_suppkey % 5 > 0 AND s_suppkey % 9 > 0 AND s_suppkey % 10 <> 1 AND s_nationkey % 8 > 1 OR s_nationkey % 8 = 1 AND s_suppkey % 5 > 0 AND s_suppkey % 9 > 0 GROUP BY 1)
SELECT site, filename AS layer, 'omission' AS "check", 'note' AS severity, product AS detail FROM g WHERE product <> 'SD'
UNION ALL SELECT w.site, NULL, 'inventory', 'fail', coalesce(got, 0) || '/' || want FROM w LEFT JOIN l ON w.site = l.site WHERE coalesce(got, 0) <> want""")
def inventory_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as granules; site 1 holds all that it should, site 0 nothing, the others lack some."""
    k = F.col("s_suppkey")
    s = read(spark, d, "supplier").select((F.col("s_nationkey") % 8).alias("site"), k, F.col("s_name").alias("filename"), F.when(k % 5 == 0, "SWE").when(k % 9 == 0, "DENSITY").otherwise("SD").alias("product"))
    folder = F.when((k % 5 == 0) | (k % 9 == 0) | ((k % 10 == 1) & (F.col("site") > 1)), "LIDAR/DERIVED/").otherwise("LIDAR/")
    layers = s.filter("site > 0").select("site", F.concat(folder, "filename").alias("layer"))
    return reports.inventory_agreement(s, s, layers)


@query("""WITH l AS (SELECT user_id % 8 AS site, 'l' || event_id AS layer, CASE event_id % 4 WHEN 0 THEN 'int' WHEN 1 THEN 'coherence_mask' ELSE 'cor' END AS leaf, CASE WHEN event_id % 9 = 0 THEN NULL WHEN event_id % 3 = 0 THEN 'complex64' WHEN event_id % 3 = 1 THEN 'uint8' ELSE 'float32' END AS dtype FROM events),
w AS (SELECT *, CASE leaf WHEN 'int' THEN 'complex64' WHEN 'coherence_mask' THEN 'uint8' END AS want FROM l)
SELECT site, layer, 'dtype' AS "check", 'fail' AS severity, coalesce(dtype, 'none') || '/' || want AS detail FROM w WHERE want IS NOT NULL AND dtype IS DISTINCT FROM want""")
def audit_types(spark: SparkSession, d: str) -> DataFrame:
    e, k = read(spark, d, "events"), F.col("event_id")
    dtype = F.when(k % 9 == 0, None).when(k % 3 == 0, "complex64").when(k % 3 == 1, "uint8").otherwise("float32")
    layers = e.select((F.col("user_id") % 8).alias("site"), F.concat(F.lit("l"), k).alias("layer"), F.when(k % 4 == 0, "int").when(k % 4 == 1, "coherence_mask").otherwise("cor").alias("leaf"), dtype.alias("dtype"))
    return reports.stored_types(layers)


@query("""SELECT o_custkey % 8 AS site, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date, CAST(o_orderkey % 6 AS INTEGER) AS gap_days, 'L' || o_orderkey AS scene, o_orderpriority AS priority FROM orders""")
def match_records(spark: SparkSession, d: str) -> DataFrame:
    """Columns of matches as sites store them, and the rows that they stand for."""
    o = read(spark, d, "orders").select((F.col("o_custkey") % 8).alias("site"), F.floor(F.col("o_orderkey") / 1000).alias("part"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 6).cast("string").alias("gap_days"), F.concat(F.lit("L"), "o_orderkey").alias("flight"), F.col("o_orderpriority").alias("priority"))
    kept = ["date", "gap_days", "flight", "priority"]
    stored = o.groupBy("site", "part").agg(F.collect_list(F.struct(*kept)).alias("_m")).select("site", *[F.col("_m")[c].alias(c) for c in kept])
    return reports.match_records(stored).select("site", "date", "gap_days", "scene", "priority")


@query(f"""WITH {PRODUCTS} SELECT pr.file_id, CASE WHEN pr.version > 3 THEN 'catalogue' ELSE level END AS level, CASE WHEN pr.version > 3 THEN bytes + 1 ELSE bytes END AS bytes, CASE WHEN pr.version > 3 THEN md5(pr.file_id) END AS checksum, pr.version > 3 AS from_catalogue FROM pr""")
def preferred_products(spark: SparkSession, d: str) -> DataFrame:
    p = products(spark, d)
    original = p.filter("version > 3").select("file_id", F.lit("catalogue").alias("level"), (F.col("bytes") + 1).alias("bytes"), F.md5("file_id").alias("checksum"))
    return reports.preferred_products(p.select("file_id", "level", "bytes"), original)


@query("""WITH s AS (SELECT s_nationkey % 8 AS site, s_name AS filename, s_suppkey AS k FROM supplier)
SELECT site, filename, k % 4 <> 1 AS discovered FROM s WHERE k % 3 > 0""")
def recorded_granules(spark: SparkSession, d: str) -> DataFrame:
    s = read(spark, d, "supplier").select((F.col("s_nationkey") % 8).alias("site"), F.col("s_name").alias("filename"), F.col("s_suppkey").alias("k"))
    kept, unknown = reports.recorded_granules(s.filter("k % 4 <> 1"), s.filter("k % 3 > 0"))
    return kept.select("site", "filename", F.lit(True).alias("discovered")).unionByName(unknown.withColumn("discovered", F.lit(False)))


def _annotation_sql() -> str:
    shown = []
    for n, (name, kind) in enumerate(scenes.ANNOTATED.values()):
        good = {"double": "CAST(e * 7 + 0.5 AS DOUBLE)", "int": "CAST(e % 9 AS INTEGER)", "string": "'t' || e"}[kind]
        bad = "'n/a'" if kind == "string" else "NULL"
        shown.append(f"max(CASE WHEN k = {n} THEN CASE WHEN e % 5 = 0 THEN {bad} ELSE {good} END END) AS {name}")
    return f"WITH m AS (SELECT user_id AS file, event_id % {len(scenes.ANNOTATED)} AS k, max(event_id) AS e FROM events GROUP BY 1, 2) SELECT file, {', '.join(shown)} FROM m GROUP BY file"


@query(_annotation_sql())
def annotation_table(spark: SparkSession, d: str) -> DataFrame:
    """Events as lines of their user's annotation file, of which the last of each key counts."""
    e, k = read(spark, d, "events"), F.col("event_id")
    at = (k % len(scenes.ANNOTATED)).cast("int") + 1
    key = F.element_at(F.array(*[F.lit(x.title()) for x in scenes.ANNOTATED]), at)
    kind = F.element_at(F.array(*[F.lit(t) for _, t in scenes.ANNOTATED.values()]), at)
    good = F.when(kind == "double", F.concat((k * 7).cast("string"), F.lit(".5"))).when(kind == "int", (k % 9).cast("string")).otherwise(F.concat(F.lit("t"), k))
    line = F.concat(key, F.lit(" (-) =  "), F.when(k % 5 == 0, "n/a").otherwise(good), F.lit("  ; remark"))
    flat = texts.annotations(e.select(F.col("user_id").alias("file"), k.alias("n"), line.alias("line")))
    return scenes.annotation_table(flat)


LABELS = (
    ("science/UAVSAR/20200211_20200218/camp1/HH/cor", "cor", "Coherence  ·  2020-02-11 → 2020-02-18  ·  camp1  ·  HH"),
    ("science/UAVSAR/AMPLITUDE/camp2_20200211_20200211/VV/amp1", "amp1", "Amplitude, pass 1  ·  2020-02-11  ·  camp2  ·  VV"),
    ("science/LIDAR/VH/20200301/veg_height", "veg_height", "Vegetation height  ·  2020-03-01"),
    ("science/LIDAR/camp_20200301/20200302/mask_20200303", "other", "other  ·  2020-03-02"),
    ("science/LIDAR/DEM/elevation", "elevation", "Elevation"),
)


@query("SELECT event_id, CASE event_id % 5 " + " ".join(f"WHEN {n} THEN '{label}'" for n, (_, _, label) in enumerate(LABELS)) + " END AS label, CASE event_type WHEN 'error' THEN '1 = usable, 0 = decorrelated, 255 = nodata' ELSE '' END AS unit FROM events")
def layer_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels by each form of path; the mask's wording is a unit like any other on other layers."""
    e = read(spark, d, "events")
    pick = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in LABELS]), (F.col("event_id") % len(LABELS)).cast("int") + 1)
    wording = F.lit("1 = usable, 0 = decorrelated, 255 = nodata")
    unit = names.display_unit(wording, F.when(F.col("event_type") == "error", "cor").otherwise("coherence_mask"))
    return e.select("event_id", names.layer_label(pick(0), pick(1))["label"].alias("label"), unit.alias("unit"))


CANOPY = f"""WITH {SAMPLES}, d AS (SELECT *, DATE '2020-01-01' + CAST(line * 7 AS INTEGER) AS date FROM sm), sc AS (SELECT site, scene, brow, bcol, avg(quantity) AS f, count(*) / 2.0 AS inc_coverage FROM sm GROUP BY 1, 2, 3, 4), ma AS (SELECT DISTINCT site, scene, date FROM d),
la AS (SELECT site, date, brow, bcol, avg(y) AS y, count(*) / 1.0 AS label_coverage FROM d GROUP BY 1, 2, 3, 4), st AS (SELECT site, brow, bcol, avg(retail) AS elevation FROM sm GROUP BY 1, 2, 3),
ca AS (SELECT site, DATE '2020-01-01' + CAST((order_key % 4) * 14 AS INTEGER) AS date, brow, bcol, avg(size) AS veg FROM sm WHERE site > 0 GROUP BY 1, 2, 3, 4), cd AS (SELECT DISTINCT site, date FROM ca),
n AS (SELECT ma.site, ma.date, cd.date AS canopy_date, row_number() OVER (PARTITION BY ma.site, ma.date ORDER BY abs(cd.date - ma.date), cd.date) AS k FROM (SELECT DISTINCT site, date FROM ma) ma JOIN cd ON ma.site = cd.site)
SELECT ma.site, ma.scene, ma.date, sc.brow, sc.bcol, n.canopy_date, round(f, 6) AS f, round(y, 4) AS y, round(elevation, 4) AS elevation, round(veg, 6) AS veg FROM ma JOIN sc ON ma.site = sc.site AND ma.scene = sc.scene
JOIN la ON la.site = ma.site AND la.date = ma.date AND la.brow = sc.brow AND la.bcol = sc.bcol JOIN st ON st.site = sc.site AND st.brow = sc.brow AND st.bcol = sc.bcol
LEFT JOIN n ON n.site = ma.site AND n.date = ma.date AND k = 1 LEFT JOIN ca ON ca.site = ma.site AND ca.date = n.canopy_date AND ca.brow = sc.brow AND ca.bcol = sc.bcol WHERE label_coverage >= 0.8 AND inc_coverage >= 0.8"""


@query(CANOPY)
def training_samples(spark: SparkSession, d: str) -> DataFrame:
    """All matches with the canopy of the nearest date; one site has none."""
    s = sample_rows(spark, d).withColumn("date", F.date_add(F.lit("2020-01-01").cast("date"), (F.col("line") * 7).cast("int")))
    sc = s.groupBy("site", "scene", "brow", "bcol").agg(F.avg("quantity").alias("f"), (F.count("*") / 2.0).alias("inc_coverage"))
    la = s.groupBy("site", "date", "brow", "bcol").agg(F.avg("y").alias("y"), (F.count("*") / 1.0).alias("label_coverage"))
    st = s.groupBy("site", "brow", "bcol").agg(F.avg("retail").alias("elevation"))
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("order_key") % 4 * 14).cast("int"))
    ca = s.filter("site > 0").groupBy("site", day.alias("date"), "brow", "bcol").agg(F.avg("size").alias("veg"))
    out = samples.sample_table(sc, s.select("site", "scene", "date").distinct(), la, st, canopy=ca)
    return out.select("site", "scene", "date", "brow", "bcol", "canopy_date", r("f").alias("f"), r("y", 4).alias("y"), r("elevation", 4).alias("elevation"), r("veg").alias("veg"))


@query("""WITH m AS (SELECT DISTINCT o_custkey % 20 % 5 AS acquisition, CAST(o_orderdate AS DATE) AS date, CAST(o_orderkey % 6 AS INTEGER) AS gap_days, o_orderstatus AS product FROM orders)
SELECT acquisition, CAST(row_number() OVER (PARTITION BY acquisition ORDER BY date, gap_days, product) - 1 AS INTEGER) AS n, date, gap_days, product FROM m""")
def match_bridge_rows(spark: SparkSession, d: str) -> DataFrame:
    """Every match of an acquisition with its place in the order."""
    o = read(spark, d, "orders")
    m = o.select((F.col("o_custkey") % 20).alias("group"), F.col("o_orderdate").cast("date").alias("date"), (F.col("o_orderkey") % 6).cast("int").alias("gap_days"), F.col("o_orderstatus").alias("product"))
    g = m.select("group", (F.col("group") % 5).alias("acquisition")).distinct()
    return matching.match_bridge(m, g).select("acquisition", F.posexplode("matches").alias("n", "m")).select("acquisition", "n", "m.*")


@query(f"""WITH {PRODUCTS}, c AS (SELECT scene, CASE WHEN bytes % 2 = 0 THEN 'SD' ELSE 'VH' END AS product, 'K' || (version % 3) AS code, CASE WHEN version % 4 > 0 THEN ref END AS b, CASE WHEN version % 4 = 0 AND bytes % 3 > 0 THEN sec END AS s, bytes % 5 > 0 AS outlined FROM pr),
m AS (SELECT 0 AS site, * FROM c WHERE product = 'SD' AND contains(scene, 'camp0') UNION SELECT 1, * FROM c WHERE product = 'VH' AND contains(scene, 'camp1') UNION SELECT 2, * FROM c WHERE product = 'SD' AND code = 'K1' UNION SELECT 3, * FROM c WHERE product = 'VH' AND code = 'K2')
SELECT DISTINCT site, scene AS name, coalesce(b, s) AS date, CASE WHEN coalesce(b, s) IS NULL THEN 'undated' WHEN NOT outlined THEN 'no_footprint' END AS reason FROM m""")
def granule_choices(spark: SparkSession, d: str) -> DataFrame:
    """Granules by product and code and by a part of their names, and those refused, with reasons."""
    version, size = F.col("version"), F.col("bytes")
    cat = products(spark, d).select(
        F.col("scene").alias("name"), F.when(size % 2 == 0, "SD").otherwise("VH").alias("product"), F.concat(F.lit("K"), version % 3).alias("code"),
        F.when(version % 4 > 0, F.col("ref")).alias("begin"), F.when((version % 4 == 0) & (size % 3 > 0), F.col("sec")).alias("single"), F.when(size % 5 > 0, F.col("ring")).alias("footprint"),
    )
    specs = spark.createDataFrame([(0, "SD", None, "camp0"), (1, "VH", None, "camp1"), (2, "SD", "K1", None), (3, "VH", "K2", None)], "site int, product string, code string, part string")
    return matching.granule_choices(specs, cat).select("site", "name", "date", "reason").distinct()
