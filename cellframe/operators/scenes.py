"""Scenes put together from processing levels, and their metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_levels(layers: DataFrame, scene=("scene",)) -> DataFrame:
    """One layer of each leaf and polarisation of a scene: that of the first level in order."""
    w = Window.partitionBy(*scene, "pol", "leaf").orderBy("level", "source")
    return layers.filter("leaf != 'hgt'").withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def surfaces(layers: DataFrame) -> DataFrame:
    return layers.filter("leaf = 'hgt'")


def merge_attributes(attrs: DataFrame, scene=("scene",)) -> DataFrame:
    """A map of each scene's attributes (scene, level, key, value); where levels disagree on a
    key, each has its own, prefixed with the level."""
    w = Window.partitionBy(*scene, "key")
    split = F.size(F.collect_set("value").over(w)) > 1
    named = attrs.withColumn("_k", F.when(split, F.concat_ws("_", F.lower("level"), "key")).otherwise(F.col("key")))
    one = named.groupBy(*scene, "_k").agg(F.min("value").alias("value"))
    return one.groupBy(*scene).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_k", "value")))).alias("attrs"))


def layer_metadata(layers: DataFrame, shown: list[str]) -> DataFrame:
    """Selected attributes of each layer and, for one derived from another, of that one too."""
    keep = F.map_filter("attrs", lambda k, v: k.isin(*shown))
    few = layers.select("path", "derived_from", keep.alias("own"))
    source = few.filter("path is not null").select(F.col("path").alias("_p"), F.col("own").alias("inherited"))
    derived = few.filter("derived_from is not null").join(source, F.col("derived_from") == F.col("_p"), "left").select("path", "own", "inherited")
    # layers derived from none take no part in the join, where their nulls would be one key and one task
    return derived.union(few.filter("derived_from is null").select("path", "own", F.lit(None).cast(few.schema["own"].dataType)))


def timeline(surveys: DataFrame, scenes: DataFrame) -> DataFrame:
    """Surveys (product, date) and scenes (first, second, line) in order of time."""
    a = surveys.select(F.lit("survey").alias("kind"), "product", F.col("date").alias("first"))
    b = scenes.select(F.lit("scene").alias("kind"), "line", "first", "second", F.datediff("second", "first").alias("days"))
    return a.unionByName(b, allowMissingColumns=True).orderBy("first", "kind", "product", "line", "second")


def annotation_scalars(eav: DataFrame, keys: dict[str, str]) -> DataFrame:
    """A row for each file with the chosen keys as columns; numbers that don't parse are missing."""
    out = eav.filter(F.col("key").isin(*keys)).groupBy("file").pivot("key", list(keys)).agg(F.first("value"))
    return out.select("file", *[F.col(f"`{k}`").alias(name) for k, name in keys.items()])


# Keys of annotations that scenes keep, by name and type.
ANNOTATED = {
    "center wavelength": ("radar_wavelength_cm", "double"),
    "bandwidth": ("radar_bandwidth_mhz", "double"),
    "radar look direction": ("radar_look_direction", "string"),
    "average look angle in near range": ("look_angle_near_deg", "double"),
    "average look angle in far range": ("look_angle_far_deg", "double"),
    "global average altitude": ("platform_altitude_m", "double"),
    "global average squint angle": ("squint_angle_deg", "double"),
    "slant range data at near range": ("slant_range_near_m", "double"),
    "peg latitude": ("peg_latitude_deg", "double"),
    "peg longitude": ("peg_longitude_deg", "double"),
    "peg heading": ("peg_heading_deg", "double"),
    "start time of acquisition for pass 1": ("acquisition_start_pass1", "string"),
    "stop time of acquisition for pass 1": ("acquisition_stop_pass1", "string"),
    "start time of acquisition for pass 2": ("acquisition_start_pass2", "string"),
    "stop time of acquisition for pass 2": ("acquisition_stop_pass2", "string"),
    "number of looks in range": ("looks_range", "int"),
    "number of looks in azimuth": ("looks_azimuth", "int"),
    "residual baseline estimation method": ("baseline_estimation_method", "string"),
    "number of baseline iterations": ("baseline_iterations", "int"),
}
NUMBERS = {"double": r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$", "int": "^[+-]?[0-9]+$"}


def annotation_table(eav: DataFrame, keys: dict[str, tuple[str, str]] = ANNOTATED) -> DataFrame:
    """annotation_scalars() of all keys that scenes keep, each of its own type: what isn't written as a
    number of that type is missing, texts lose the blanks around them, and a file with none of the keys has no row."""
    wide = annotation_scalars(eav, {k: name for k, (name, _) in keys.items()})
    trimmed = lambda name: F.trim(F.col(name))
    typed = lambda name, kind: trimmed(name) if kind == "string" else F.when(trimmed(name).rlike(NUMBERS[kind]), trimmed(name).try_cast(kind))
    return wide.select("file", *[typed(name, kind).alias(name) for name, kind in keys.values()])
