"""Statistics of layers, differences and predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.model import KEYS
from cellframe.operators.quantiles import joined, quantiles

def layer_stats(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Counts, bounds and quantiles of each layer; missing cells count in ``cells`` alone.

    Of complex layers (re, im) only cells whose both parts are there count as valid; they have
    no order, hence neither bounds nor quantiles, and a status that says so. A table may have v, or re
    and im, or all three: a layer any of whose cells has a part is complex.
    """
    real, complex_parts = "v" in cells.columns, {"re", "im"} <= set(cells.columns)
    v = F.col("v").cast("double") if real else F.lit(None).cast("double")
    whole = F.col("re").isNotNull() & F.col("im").isNotNull() if complex_parts else F.lit(False)
    parts = F.col("re").isNotNull() | F.col("im").isNotNull() if complex_parts else F.lit(False)
    rows = cells.select(*keys, v.alias("v"), whole.alias("_whole"), parts.alias("_parts"))
    is_complex = F.bool_or("_parts") if real else F.lit(True)
    out = rows.groupBy(*keys).agg(
        F.count("*").alias("cells"), F.when(is_complex, F.count_if("_whole")).otherwise(F.count("v")).alias("valid"), is_complex.alias("_complex"),
        F.when(~is_complex, F.min("v")).alias("least"), F.when(~is_complex, F.max("v")).alias("most"),
    )
    names = {"p1": 0.01, "median": 0.5, "p99": 0.99}
    if real:
        out = joined(out, quantiles(rows, names, keys), keys).withColumns({n: F.when(~F.col("_complex"), F.col(n)) for n in names})
    else:
        out = out.withColumns({n: F.lit(None).cast("double") for n in names})
    status = F.when(F.col("valid") == 0, "no_valid_values").when(F.col("_complex"), "not_applicable_complex").otherwise("computed")
    return out.select(*keys, "cells", "valid", (F.col("valid") / F.col("cells")).alias("valid_fraction"), "least", "most", *names, status.alias("status"))


def area_km2(stats: DataFrame, res: float) -> DataFrame:
    return stats.withColumn("area_km2", F.col("valid") * (res * res / 1e6))


def nearest_area(areas: DataFrame, group: list[str], reference: str) -> DataFrame:
    """The layer of each group whose area is nearest a reference, with its error in percent."""
    err = (F.col("area_km2") - F.col(reference)) / F.col(reference) * 100
    return areas.groupBy(*group).agg(F.min_by(F.struct("layer", "area_km2", err.alias("error_percent")), F.struct(F.abs(err), F.col("layer"))).alias("_b")).select(*group, "_b.*")


def difference_stats(pairs: DataFrame, keys=KEYS) -> DataFrame:
    """Of (a, b): cells, common support, and statistics of b - a there."""
    d = F.col("b") - F.col("a")
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("total"), F.count(d).alias("n"), (F.count(d) / F.count("*")).alias("coverage"), F.avg(d).alias("mean"),
        F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"), F.min(d).alias("least"), F.max(d).alias("most"),
    )


def offset_stats(pairs: DataFrame, floor: float = -100.0, keys=KEYS) -> DataFrame:
    """How far surface a stands from b, without cells of a at or below the floor."""
    fine = (F.col("a") > floor) & F.col("b").isNotNull()
    d = F.when(fine, F.col("a") - F.col("b"))
    low = F.count_if(F.col("a") <= floor) / F.count("*")
    rows = pairs.select(*keys, "a", d.alias("_d"), F.abs(d).alias("_abs"))
    sums = rows.groupBy(*keys).agg(F.avg("_abs").alias("mean_abs_offset"), F.sqrt(F.avg(F.col("_d") * F.col("_d"))).alias("rmse"), F.count("_d").alias("compared"), low.alias("sentinel_fraction"))
    out = joined(joined(sums, quantiles(rows, {"median_offset": 0.5}, keys, "_d"), keys), quantiles(rows, {"p99_abs_offset": 0.99}, keys, "_abs"), keys)
    return out.select(*keys, "median_offset", "mean_abs_offset", "p99_abs_offset", "rmse", "compared", "sentinel_fraction")


def steep_angles(cells: DataFrame, least: float = 90.0, keys=KEYS) -> DataFrame:
    """Number and share of angles at or beyond a limit among those there."""
    n = F.count_if(F.col("v") >= least)
    return cells.groupBy(*keys).agg(n.alias("n"), F.try_divide(n.cast("double"), F.count("v")).alias("fraction"))


def regression_metrics(predictions: DataFrame, keys: list[str], y: str = "y", p: str = "p", base: str = "base") -> DataFrame:
    """n, RMSE, MAE, bias and R2 of predictions, RMSE of a baseline, and skill against it."""
    e, b = F.col(p) - F.col(y), F.col(base) - F.col(y)
    spread = F.var_pop(y)
    out = predictions.groupBy(*keys).agg(
        F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e).alias("bias"),
        (1 - F.try_divide(F.avg(e * e), spread)).alias("r2"), F.sqrt(F.avg(b * b)).alias("base_rmse"),
    )
    return out.withColumn("skill", 1 - F.try_divide(F.col("rmse"), F.col("base_rmse")))


def stretch(cells: DataFrame, lower: float, upper: float, zero_centred: bool = False, keys=KEYS) -> DataFrame:
    """Display bounds from percentiles: symmetric about zero if asked for, padded if flat."""
    if not 0 <= lower < upper <= 100:
        raise ValueError("0 <= lower < upper <= 100")
    q = quantiles(cells, {"lo": lower / 100, "hi": upper / 100}, keys)
    if zero_centred:
        largest = F.greatest(F.abs("lo"), F.abs("hi"))
        span = F.greatest(F.when(largest == 0, F.lit(1.0)).otherwise(largest), F.lit(1e-6))
        return q.select(*keys, (-span).alias("lo"), span.alias("hi"))
    pad = F.when(F.col("lo") == F.col("hi"), F.greatest(F.abs("lo") * 0.01, F.lit(1e-6))).otherwise(F.lit(0.0))
    return q.select(*keys, (F.col("lo") - pad).alias("lo"), (F.col("hi") + pad).alias("hi"))


def rereference(blocks: DataFrame, group: list[str], value: str) -> DataFrame:
    """Values less their group's median; the medians are joined back, a row a group. Blocks without a
    group drop out."""
    medians = quantiles(blocks, {"_m": 0.5}, group, value)
    return blocks.join(medians, group).withColumn(value, F.col(value) - F.col("_m")).drop("_m")


def map_reduce(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Mean prediction, label and number of scenes of each block."""
    return predictions.groupBy(*keys).agg(F.avg("p").alias("p"), F.min("y").alias("y"), F.countDistinct("scene").alias("scenes"))


def debias(predictions: DataFrame, keys: list[str]) -> DataFrame:
    """Bias, correlation, and RMSE with and without the bias, by key."""
    e = F.col("p") - F.col("y")
    out = predictions.groupBy(*keys).agg(F.avg(e).alias("bias"), F.corr("p", "y").alias("corr"), F.avg(e * e).alias("_mse"), F.avg("scenes").alias("mean_scenes"))
    return out.select(*keys, "bias", "corr", F.sqrt("_mse").alias("rmse"), F.sqrt(F.greatest(F.col("_mse") - F.col("bias") * F.col("bias"), F.lit(0.0))).alias("rmse_debiased"), "mean_scenes")


def fingerprint(cells: DataFrame, keys=KEYS, hashed: Column | None = None) -> DataFrame:
    """Identity of a layer's content whatever its order: sums of cell hashes, and counts."""
    h = hashed if hashed is not None else F.xxhash64("row", "col", "v").cast("decimal(38,0)")
    return cells.groupBy(*keys).agg(F.count("*").alias("cells"), F.count("v").alias("valid"), F.sum(h).alias("content"))
