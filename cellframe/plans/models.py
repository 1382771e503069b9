"""Queries on sample tables and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.model import rounded as r
from cellframe.operators import boosting, learning, samples, stats
from cellframe.plans.fixtures import SAMPLES
from cellframe.plans.fixtures import samples as sample_rows

FEATURES = ["quantity", "discount", "tax", "size", "retail"]
#: Trees of forest_loso; production settings, which the other queries have, are 300.
FEW = {"numTrees": 5, "maxDepth": 5}


@query(f"WITH {SAMPLES}, n AS (SELECT site, count(*) AS n FROM sm GROUP BY site) SELECT site, n, round((SELECT count(*) FROM sm) / ((SELECT count(*) FROM n) * n), 6) AS weight FROM n")
def site_weights(spark: SparkSession, d: str) -> DataFrame:
    return samples.site_weights(sample_rows(spark, d)).groupBy("site").agg(F.count("*").alias("n"), r(F.first("weight")).alias("weight"))


WEIGHTED = f"WITH {SAMPLES}, n AS (SELECT site, count(*) AS n, avg(y) AS m FROM sm GROUP BY site), t AS (SELECT sum(m) AS s, count(*) AS k FROM n), b AS (SELECT site, (t.s - m) / (t.k - 1) AS base FROM n, t) "


@query(WEIGHTED + "SELECT site, round(base, 6) AS base FROM b")
def weighted_mean_baseline(spark: SparkSession, d: str) -> DataFrame:
    w = samples.site_weights(sample_rows(spark, d))
    return samples.weighted_mean_baseline(w).select("site", r("base").alias("base"))


def _predicted(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(spark, d).withColumn("p", F.col("quantity") * F.col("retail") * 1.05)
    return s.join(samples.weighted_mean_baseline(samples.site_weights(s)), "site")


@query(WEIGHTED + """, e AS (SELECT sm.site, y, quantity * retail * 1.05 AS p, base FROM sm JOIN b ON sm.site = b.site)
SELECT site, count(*) AS n, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(avg(abs(p - y)), 4) AS mae, round(avg(p - y), 4) AS bias, round(1 - avg((p - y) * (p - y)) / var_pop(y), 6) AS r2,
round(sqrt(avg((base - y) * (base - y))), 4) AS base_rmse, round(1 - sqrt(avg((p - y) * (p - y))) / sqrt(avg((base - y) * (base - y))), 6) AS skill FROM e GROUP BY site""")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    m = stats.regression_metrics(_predicted(spark, d), ["site"])
    return m.select("site", "n", *[r(c, 4).alias(c) for c in ("rmse", "mae", "bias", "base_rmse")], r("r2").alias("r2"), r("skill").alias("skill"))


@query(f"WITH {SAMPLES}, m AS (SELECT scene, quantile_cont(y, 0.5) AS m FROM sm GROUP BY scene) SELECT sm.order_key, sm.line, sm.scene, round(y - m, 4) AS y FROM sm JOIN m ON sm.scene = m.scene")
def rereference(spark: SparkSession, d: str) -> DataFrame:
    return stats.rereference(sample_rows(spark, d), ["scene"], "y").select("order_key", "line", "scene", r("y", 4).alias("y"))


@query(f"WITH {SAMPLES}, k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY md5(order_key || ':' || line || ':' || scene || ':' || y), order_key, line, y, scene, retail) AS n FROM sm) SELECT site, order_key, line, y FROM k WHERE n <= 200")
def sample_per_group(spark: SparkSession, d: str) -> DataFrame:
    """A sampling operator: 200 rows of each site."""
    s = sample_rows(spark, d)
    order = F.struct(F.md5(F.concat_ws(":", "order_key", "line", "scene", F.col("y").cast("string"))), "order_key", "line", "y", "scene", "retail")
    return samples.sample_per_group(s, ["site"], 200, order).select("site", "order_key", "line", "y")


MAP = f"WITH {SAMPLES}, m AS (SELECT site, brow, bcol, avg(quantity * retail) AS p, min(y) AS y, count(DISTINCT scene) AS scenes FROM sm GROUP BY 1, 2, 3) "


def _map(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(spark, d).withColumn("p", F.col("quantity") * F.col("retail"))
    return stats.map_reduce(s, ["site", "brow", "bcol"])


@query(MAP + "SELECT site, brow, bcol, round(p, 8) AS p, y, scenes FROM m")
def map_reduce(spark: SparkSession, d: str) -> DataFrame:
    return _map(spark, d).withColumn("p", r("p", 8))


@query(MAP + "SELECT site, round(avg(p - y), 4) AS bias, round(corr(p, y), 6) AS corr, round(sqrt(avg((p - y) * (p - y))), 4) AS rmse, round(sqrt(greatest(avg((p - y) * (p - y)) - avg(p - y) * avg(p - y), 0)), 4) AS rmse_debiased, round(avg(scenes), 6) AS mean_scenes FROM m GROUP BY site")
def debias(spark: SparkSession, d: str) -> DataFrame:
    o = stats.debias(_map(spark, d), ["site"])
    return o.select("site", *[r(c, 4).alias(c) for c in ("bias", "rmse", "rmse_debiased")], r("corr").alias("corr"), r("mean_scenes").alias("mean_scenes"))


RESULTS = f"WITH {SAMPLES}, e AS (SELECT site, line % 3 AS scale, CASE WHEN scene % 2 = 0 THEN 'forest' ELSE 'boost' END AS model, 'all' AS features, avg(y) / 1000 AS r2, avg(quantity) AS rmse, avg(size) AS skill FROM sm GROUP BY 1, 2, 3, 4) "


def _results(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(spark, d).withColumns({"scale": F.col("line") % 3, "model": F.when(F.col("scene") % 2 == 0, "forest").otherwise("boost"), "features": F.lit("all")})
    return s.groupBy("site", "scale", "model", "features").agg((F.avg("y") / 1000).alias("r2"), F.avg("quantity").alias("rmse"), F.avg("size").alias("skill"))


@query(RESULTS + "SELECT scale, model, features, round(avg(r2), 6) AS mean_r2, round(quantile_cont(r2, 0.5), 6) AS median_r2, round(avg(rmse), 6) AS mean_rmse, round(avg(skill), 6) AS mean_skill FROM e GROUP BY scale, model, features")
def scale_summary(spark: SparkSession, d: str) -> DataFrame:
    return samples.scale_summary(_results(spark, d)).select("scale", "model", "features", *[r(c).alias(c) for c in ("mean_r2", "median_r2", "mean_rmse", "mean_skill")])


@query(RESULTS + "SELECT site, scale, round(max(r2) FILTER (WHERE model = 'forest'), 6) AS forest, round(max(r2) FILTER (WHERE model = 'boost'), 6) AS boost FROM e GROUP BY site, scale")
def summary_pivot(spark: SparkSession, d: str) -> DataFrame:
    p = _results(spark, d).groupBy("site", "scale").pivot("model", ["forest", "boost"]).agg(F.max("r2"))
    return p.select("site", "scale", r("forest").alias("forest"), r("boost").alias("boost"))


@query(RESULTS + ", k AS (SELECT scale, model, r2, row_number() OVER (PARTITION BY scale ORDER BY r2 DESC, model DESC) AS n FROM e) SELECT scale, model, round(r2, 6) AS r2 FROM k WHERE n = 1")
def best_run(spark: SparkSession, d: str) -> DataFrame:
    return samples.best_runs(_results(spark, d), ["scale"], "r2").select("scale", "model", r("r2").alias("r2"))


@query(f"""WITH {SAMPLES}, i AS (SELECT 'f' || (line % 5) AS feature, avg(y - 1500 * quantity) AS increase FROM sm GROUP BY line % 5)
SELECT feature, round(increase, 4) AS increase, round(greatest(increase, 0) / nullif(sum(greatest(increase, 0)) OVER (), 0), 6) AS share, CAST(row_number() OVER (ORDER BY increase DESC, feature) AS INTEGER) AS rank FROM i""")
def importance_share(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(spark, d).select(F.concat(F.lit("f"), F.col("line") % 5).alias("feature"), (F.col("y") - 1500 * F.col("quantity")).alias("increase"))
    return samples.importance_share(s).select("feature", r("increase", 4).alias("increase"), r("share").alias("share"), "rank")


@query(f"""WITH {SAMPLES}, sc AS (SELECT site, scene, brow, bcol, avg(quantity) AS f, count(*) / 2.0 AS inc_coverage FROM sm GROUP BY 1, 2, 3, 4), ma AS (SELECT DISTINCT site, scene, line AS date FROM sm WHERE line <= 2),
la AS (SELECT site, line AS date, brow, bcol, avg(y) AS y, count(*) / 3.0 AS label_coverage FROM sm GROUP BY 1, 2, 3, 4), st AS (SELECT site, brow, bcol, avg(retail) AS elevation FROM sm GROUP BY 1, 2, 3)
SELECT site, scene, date, brow, bcol, round(f, 6) AS f, round(y, 4) AS y, round(elevation, 4) AS elevation FROM ma JOIN sc USING (site, scene) JOIN la USING (site, date, brow, bcol) JOIN st USING (site, brow, bcol) WHERE label_coverage >= 0.8 AND inc_coverage >= 0.8""")
def sample_table(spark: SparkSession, d: str) -> DataFrame:
    s = sample_rows(spark, d)
    sc = s.groupBy("site", "scene", "brow", "bcol").agg(F.avg("quantity").alias("f"), (F.count("*") / 2.0).alias("inc_coverage"))
    ma = s.filter("line <= 2").select("site", "scene", F.col("line").alias("date")).distinct()
    la = s.groupBy("site", F.col("line").alias("date"), "brow", "bcol").agg(F.avg("y").alias("y"), (F.count("*") / 3.0).alias("label_coverage"))
    st = s.groupBy("site", "brow", "bcol").agg(F.avg("retail").alias("elevation"))
    out = samples.sample_table(sc, ma, la, st)
    return out.select("site", "scene", "date", "brow", "bcol", r("f").alias("f"), r("y", 4).alias("y"), r("elevation", 4).alias("elevation"))


@query()
def forest_loso(spark: SparkSession, d: str) -> DataFrame:
    p = learning.leave_one_site_out(sample_rows(spark, d), {"all": FEATURES}, ("forest",), FEW, model=learning.fitted)
    return learning.scores(p)


@query()
def gbt_loso(spark: SparkSession, d: str) -> DataFrame:
    """Scores of boosting by held-out site, with all features and without the one that stands for elevation."""
    sets = {"all": range(len(FEATURES)), "no_retail": range(len(FEATURES) - 1)}
    specs = lambda sites: [boosting.Spec(boosting.Setting(), frozenset([s]), tuple(use)) for use in sets.values() for s in sites]
    p, model = boosting.held_out(sample_rows(spark, d), FEATURES, specs, most=boosting.TOGETHER)
    name = F.when(F.col("model") < len(model.sites), "all").otherwise("no_retail")
    return learning.scores(p.withColumns({"model": F.lit("boost"), "features": name}))


@query()
def permutation_importance(spark: SparkSession, d: str) -> DataFrame:
    """All features and rows, three repeats, each site by a model of the others."""
    each = learning.importances_of_sites(sample_rows(spark, d), FEATURES, ["order_key", "line", "y"])
    return samples.importance_share(each)


@query()
def grouped_tuning(spark: SparkSession, d: str) -> DataFrame:
    """All features, and production's grid, folds and rounds."""
    return learning.tune(sample_rows(spark, d), FEATURES, most=boosting.TOGETHER)


@query()
def random_contrast(spark: SparkSession, d: str) -> DataFrame:
    return learning.random_contrast(sample_rows(spark, d), FEATURES, ["order_key", "line", "y"])


@query()
def held_out_map(spark: SparkSession, d: str) -> DataFrame:
    return learning.bands(learning.held_out_map(sample_rows(spark, d), 0, FEATURES))
