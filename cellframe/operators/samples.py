"""Sample tables, weights, folds and summaries of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def sample_table(scenes: DataFrame, matches: DataFrame, labels: DataFrame, static: DataFrame, least: float = 0.8, canopy: DataFrame | None = None) -> DataFrame:
    """A row for each block, survey date and scene: features, label and terrain. Blocks count
    where label and local incidence cover enough of them.

    ``canopy`` (site, date, brow, bcol, ...) is joined at the date nearest the survey's, of two as near the earlier,
    named ``canopy_date``; blocks that it lacks, and sites without any, keep their rows with nulls.
    """
    if canopy is not None:
        from cellframe.operators.matching import nearest_date

        days = canopy.select("site", F.col("date").alias("candidate")).distinct()
        near = nearest_date(matches.select("site", F.col("date").alias("target")), days).select("site", F.col("target").alias("date"), F.col("candidate").alias("canopy_date"))
        matches = matches.join(near, ["site", "date"], "left")
    out = matches.join(scenes, ["site", "scene"]).join(labels, ["site", "date", "brow", "bcol"]).join(static, ["site", "brow", "bcol"])
    out = out.filter((F.col("label_coverage") >= least) & (F.col("inc_coverage") >= least))
    return out if canopy is None else out.join(canopy.withColumnRenamed("date", "canopy_date"), ["site", "canopy_date", "brow", "bcol"], "left")


def sample_per_group(rows: DataFrame, group: list[str], n: int, order: Column) -> DataFrame:
    """At most ``n`` rows of each group, first in a seeded order; the same at every run."""
    w = Window.partitionBy(*group).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def site_weights(samples: DataFrame, site: str = "site") -> DataFrame:
    """Weights that make sites equal and 1 on average; the counts are a row a site."""
    counts = samples.groupBy(site).agg(F.count("*").alias("_n"))
    whole = counts.agg(F.sum("_n").alias("_all"), F.count("*").alias("_sites"))
    per = counts.join(F.broadcast(whole)).select(site, (F.col("_all") / (F.col("_sites") * F.col("_n"))).alias("weight"))  # one row
    # a row a site: by equal site, a few tasks would read all samples
    return samples.join(F.broadcast(per), site)


def weighted_mean_baseline(weighted: DataFrame, y: str = "y", site: str = "site") -> DataFrame:
    """For each site the weighted mean of all others: what predicting the mean would say."""
    sums = weighted.groupBy(site).agg(F.sum(F.col("weight") * F.col(y)).alias("_wy"), F.sum("weight").alias("_w"))
    whole = sums.agg(F.sum("_wy").alias("_awy"), F.sum("_w").alias("_aw"))
    return sums.join(F.broadcast(whole)).select(site, F.try_divide(F.col("_awy") - F.col("_wy"), F.col("_aw") - F.col("_w")).alias("base"))  # one row


def balanced_folds(samples: DataFrame, folds: int = 3, site: str = "site") -> DataFrame:
    """Site to fold, the largest sites first and each to the smallest fold so far. The sites'
    counts are few and are dealt on the driver."""
    load, out = [0] * folds, []
    for s, n in samples.groupBy(site).count().orderBy(F.desc("count"), site).collect():
        f = load.index(min(load))
        load[f] += n
        out.append((s, f))
    kind = samples.schema[site].dataType.simpleString()
    return samples.sparkSession.createDataFrame(out, f"{site} {kind}, fold int")


def random_split(rows: DataFrame, keys: list[str], part: float = 0.8, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    train = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(1000)) < int(part * 1000)
    return rows.filter(train), rows.filter(~train)


def scale_summary(results: DataFrame) -> DataFrame:
    """Mean and median scores by scale, model and feature set."""
    return results.groupBy("scale", "model", "features").agg(F.avg("r2").alias("mean_r2"), F.percentile("r2", F.lit(0.5)).alias("median_r2"), F.avg("rmse").alias("mean_rmse"), F.avg("skill").alias("mean_skill"))


def importance_share(importances: DataFrame) -> DataFrame:
    """Mean increase in RMSE by feature, its share with losses as 0, and its rank."""
    mean = importances.groupBy("feature").agg(F.avg("increase").alias("increase"))
    gain = F.greatest(F.col("increase"), F.lit(0.0))
    everything = Window.partitionBy(F.lit(1))  # a row a feature
    out = mean.withColumn("share", F.try_divide(gain, F.sum(gain).over(everything)))
    return out.withColumn("rank", F.row_number().over(everything.orderBy(F.desc("increase"), "feature")))


def best_runs(results: DataFrame, by: list[str], score: str) -> DataFrame:
    return results.groupBy(*by).agg(F.max_by("model", F.struct(score, "model")).alias("model"), F.max(score).alias(score))


def every_nth(cells: DataFrame, step: int) -> DataFrame:
    return cells.filter((F.col("row") % step == 0) & (F.col("col") % step == 0))


def write_samples(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Sample tables in a folder for each site."""
    samples.repartition("site", F.pmod(F.xxhash64("scene"), F.lit(8))).write.mode(mode).partitionBy("site").parquet(path)


def read_samples(spark: SparkSession, path: str, sites: list | None = None) -> DataFrame:
    """The tables of all sites, or of some, as one."""
    out = spark.read.parquet(path)
    return out.filter(F.col("site").isin(*sites)) if sites else out
