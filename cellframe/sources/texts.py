"""Annotations, point tables, inventories and footprints."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of a transect table by their normalised names.
TRANSECT = {
    "date": "date", "time": "time", "longitude": "lon", "latitude": "lat", "easting": "x", "northing": "y", "elevation": "elevation",
    "twt": "two_way_time", "thickness": "thickness", "depth": "thickness", "swe": "swe", "density": "density", "utmzone": "zone",
}
POINTS = "array<struct<Longitude:double,Latitude:double>>"
GEOMETRY = (
    "struct<SpatialExtent:struct<HorizontalSpatialDomain:struct<Geometry:struct<"
    f"GPolygons:array<struct<Boundary:struct<Points:{POINTS}>>>,"
    "BoundingRectangles:array<struct<WestBoundingCoordinate:double,SouthBoundingCoordinate:double,EastBoundingCoordinate:double,NorthBoundingCoordinate:double>>>>>>"
)


def annotations(lines: DataFrame) -> DataFrame:
    """file, key, units, value, number of lines (file, n, line) ``key (units) = value ; comment``;
    of a key given twice the last counts."""
    head = F.substring_index("line", ";", 1)
    name, value = F.substring_index(head, "=", 1), F.trim(F.expr("substring(substring_index(line, ';', 1), instr(substring_index(line, ';', 1), '=') + 1)"))
    key = F.lower(F.trim(F.substring_index(name, "(", 1)))
    units = F.nullif(F.trim(F.regexp_extract(name, r"\((.*)\)", 1)), F.lit(""))
    rows = lines.filter(head.contains("=")).select("file", "n", key.alias("key"), units.alias("units"), value.alias("value")).filter("key != ''")
    last = rows.groupBy("file", "key").agg(F.max_by(F.struct("units", "value"), "n").alias("_l"))
    plain = F.col("value").rlike(r"^-*[0-9]*\.?[0-9]+\.?$")
    return last.select("file", "key", "_l.*").withColumn("number", F.when(plain, F.col("value").try_cast("double")))


def scan_annotations(spark: SparkSession, path: str) -> DataFrame:
    """annotations() of text files; each is read whole, for the order of its lines."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return annotations(files)


def normalise(name: str) -> str:
    return re.sub("[^a-z0-9]", "", name.lower())


def normalise_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Columns under their mapped names, those not mapped left out; absent ones are null text."""
    found = {}
    for c in df.columns:
        target = mapping.get(normalise(c))
        if target and target not in found:
            found[target] = F.col(f"`{c}`")
    return df.select(*[found.get(t, F.lit(None).cast("string")).alias(t) for t in dict.fromkeys(mapping.values())])


def scan_transects(spark: SparkSession, path: str) -> DataFrame:
    from cellframe.operators.cleaning import point_fill

    out = normalise_columns(spark.read.csv(path, header=True), TRANSECT)
    numbers = [c for c in out.columns if c not in ("date", "time", "zone")]
    return out.withColumns({c: point_fill(F.col(c)) for c in numbers})


def pit_table(lines: DataFrame) -> DataFrame:
    """Fields of pit summaries (file, n, line): the header is the first line without a mark that
    has PitID and more than six commas; rows whose first field is a number are column numbers."""
    body = lines.filter(~F.col("line").startswith("#"))
    commas = F.length("line") - F.length(F.replace("line", F.lit(","), F.lit("")))
    heads = body.filter(F.col("line").contains("PitID") & (commas > 6)).groupBy("file").agg(F.min("n").alias("_h"), F.min_by("line", "n").alias("header"))
    rows = body.join(heads, "file").filter("n > _h")
    fields = F.split("line", ",")
    return rows.filter(~fields[0].rlike("^[0-9]+$") & (F.trim("line") != "")).select("file", "n", F.map_from_arrays(F.split("header", ","), F.slice(F.concat(fields, F.array_repeat(F.lit(None).cast("string"), F.size(F.split("header", ",")))), F.lit(1), F.size(F.split("header", ",")))).alias("fields"))


def inventory(spark: SparkSession, path: str, part: str) -> DataFrame:
    """granules, products or matches of a nested inventory, a row each with its site."""
    raw = spark.read.json(path, multiLine=True)
    return raw.select(F.explode("sites").alias("s")).select(F.col("s.key").alias("site"), F.explode(f"s.{part}").alias("x")).select("site", "x.*")


def footprints(json_text: Column) -> Column:
    """Rings of (x, y): polygons of three points and more, and rectangles with all four sides."""
    g = F.from_json(json_text, GEOMETRY)["SpatialExtent"]["HorizontalSpatialDomain"]["Geometry"]
    empty = F.array().cast("array<array<struct<x:double,y:double>>>")
    polygon = lambda p: F.transform(p["Boundary"]["Points"], lambda q: F.struct(q["Longitude"].alias("x"), q["Latitude"].alias("y")))
    polygons = F.filter(F.transform(g["GPolygons"], polygon), lambda r: F.size(r) >= 3)
    corner = lambda b, x, y: F.struct(b[x].alias("x"), b[y].alias("y"))
    w, s, e, n = (f"{d}BoundingCoordinate" for d in ("West", "South", "East", "North"))
    whole = F.filter(g["BoundingRectangles"], lambda b: b[w].isNotNull() & b[s].isNotNull() & b[e].isNotNull() & b[n].isNotNull())
    boxes = F.transform(whole, lambda b: F.array(corner(b, w, s), corner(b, e, s), corner(b, e, n), corner(b, w, n)))
    return F.concat(F.coalesce(polygons, empty), F.coalesce(boxes, empty))


def harvest_inventory(scenes: DataFrame) -> DataFrame:
    """Product records from attributes stored with scenes (group, attrs): the level falls back to
    the group's name, a missing size is 0; each file once."""
    at = lambda k: F.try_element_at("attrs", F.lit(k))
    out = scenes.select(
        at("file_id").alias("file_id"), F.coalesce(at("processing_level"), F.split("group", "/")[0]).alias("level"),
        F.coalesce(at("bytes").try_cast("long"), F.lit(0)).alias("bytes"), at("scene").alias("scene"),
    )
    return out.filter("file_id is not null").groupBy("file_id").agg(F.min("level").alias("level"), F.max("bytes").alias("bytes"), F.min("scene").alias("scene"))


def scan_results(spark: SparkSession, path: str) -> DataFrame:
    """Result tables of all scales, the scale taken from the file's path (…/<scale>m/…)."""
    out = spark.read.option("header", True).option("inferSchema", False).csv(path)
    return out.withColumn("scale", F.regexp_extract(F.col("_metadata.file_path"), "([0-9]+)m[/_.]", 1).try_cast("int"))


def write_matches(matches: DataFrame, path: str, stored_digest: str | None) -> str:
    """Writes matches only if their content differs from what a digest stands for; the new digest."""
    digest = str(matches.agg(F.concat_ws(":", F.count("*"), F.sum(F.xxhash64(*matches.columns).cast("decimal(38,0)")))).first()[0])
    if digest != stored_digest:
        matches.write.mode("overwrite").parquet(path)
    return digest
