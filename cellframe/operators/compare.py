"""Comparison of layers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.functions.values import signed_angle_difference
from cellframe.model import KEYS

PERIODS = {"degrees": 360.0, "radians": 6.283185307179586}


def compare(a: DataFrame, b: DataFrame, mode: str = "linear", keys=KEYS, cutoff: float | None = None) -> DataFrame:
    """b - a on common support: linear, degrees, radians, or the change of a mask."""
    on = [*keys, "row", "col"]
    both = a.filter("v is not null").select(*on, F.col("v").alias("a")).join(b.filter("v is not null").select(*on, F.col("v").alias("b")), on)
    if mode in PERIODS:
        return both.withColumn("d", signed_angle_difference(F.col("a"), F.col("b"), PERIODS[mode]))
    if mode == "mask":
        both = both.withColumns({c: F.when(F.col(c) >= cutoff, 1).otherwise(0) for c in ("a", "b")})
    elif mode != "linear":
        raise ValueError(f"unknown mode {mode}")
    return both.withColumn("d", F.col("b") - F.col("a"))


def transitions(compared: DataFrame, keys=KEYS) -> DataFrame:
    return compared.groupBy(*keys, "d").agg(F.count("*").alias("cells"))


def layer_equality(a: DataFrame, b: DataFrame, tolerance: float = 1e-4, keys=KEYS) -> DataFrame:
    """identical, close or different; a different missing pattern is different."""
    on = [*keys, "row", "col"]
    both = a.select(*on, F.col("v").alias("a"), F.lit(1).alias("_a")).join(b.select(*on, F.col("v").alias("b"), F.lit(1).alias("_b")), on, "full_outer")
    pattern = F.count_if(F.col("a").isNull() != F.col("b").isNull()) + F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    out = both.groupBy(*keys).agg(pattern.alias("_p"), F.coalesce(F.max(F.abs(F.col("a") - F.col("b"))), F.lit(0.0)).alias("largest"), F.greatest(F.lit(1.0), F.max(F.abs("a")), F.max(F.abs("b"))).alias("_m"))
    verdict = F.when(F.col("_p") > 0, "different").when(F.col("largest") == 0, "identical").when(F.col("largest") <= tolerance * F.col("_m"), "close").otherwise("different")
    return out.select(*keys, "largest", verdict.alias("verdict"))
