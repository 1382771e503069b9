"""Tables that reports show, and the inventories and totals that they are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from cellframe.functions.names import feature_group
from cellframe.operators.samples import scale_summary
from cellframe.operators.stats import area_km2, nearest_area


def area_agreement(layers: DataFrame, references: DataFrame, res: float, tolerance: float = 1.0, total_tolerance: float = 0.5) -> DataFrame:
    """By site the base layer (site, layer, valid) whose area is nearest the site's reference (site,
    reference), its error in percent and whether it is within tolerance; then, with a null site,
    the sums over these sites.

    Derived layers don't count. Of two layers as near the first by name is taken; sites without a
    reference or without a layer are left out, and with none at all the total is null.
    """
    base = area_km2(layers.filter(~F.col("layer").startswith("LIDAR/DERIVED/")), res)
    best = nearest_area(base.join(references, "site"), ["site", "reference"], "reference")
    best = best.select("site", "layer", "area_km2", "reference", "error_percent", (F.abs("error_percent") < tolerance).alias("fine"))
    sums = best.agg(F.sum("area_km2").alias("area_km2"), F.sum("reference").alias("reference"))
    error = F.try_divide(F.col("area_km2") - F.col("reference"), F.col("reference")) * 100
    total = sums.withColumn("error_percent", error).withColumn("fine", F.abs("error_percent") < total_tolerance)
    return best.unionByName(total, allowMissingColumns=True)


def scale_table(results: DataFrame, random_split: str) -> DataFrame:
    """scale_summary() of held-out sites with, beside it, R2 of the scale's random split.

    Rows whose site is ``random_split`` are that split's; where a scale has none its R2 is null, and
    a scale that has nothing else doesn't show.
    """
    held = scale_summary(results.filter(F.col("site") != random_split))
    split = results.filter(F.col("site") == random_split).groupBy("scale").agg(F.avg("r2").alias("random_split_r2"))
    return held.join(split, "scale", "left")


def summary_table(results: DataFrame, models: list[str], digits: int = 3) -> DataFrame:
    """R2, RMSE and bias of each site by model, a column each (``forest_r2``); a model that a site
    lacks is null."""
    measures = [F.round(F.avg(c), digits).alias(c) for c in ("r2", "rmse", "bias")]
    return results.groupBy("site").pivot("model", models).agg(*measures)


def importance_table(importances: DataFrame, models: list[str]) -> DataFrame:
    """Importances (scale, model, feature, increase) in centimetres of RMSE by feature: of each model and
    their mean, its share of all gains of the scale, the share of its group (radar of any
    polarisation and geometry is one group), and its rank.

    Losses have no share; where nothing gains all shares are 0. Windows hold a row a feature.
    """
    per = importances.groupBy("scale", "feature").pivot("model", models).agg(F.avg("increase") * 100)
    there = F.filter(F.array(*models), lambda x: x.isNotNull())
    mean = F.aggregate(there, F.lit(0.0), lambda a, x: a + x, lambda a: F.try_divide(a, F.size(there).cast("double")))
    out = per.withColumns({"cm": mean, "group": feature_group(F.col("feature"))})
    gain = F.greatest(F.col("cm"), F.lit(0.0))
    scale, family = Window.partitionBy("scale"), Window.partitionBy("scale", "_family")
    out = out.withColumn("_family", F.when(F.col("group").startswith("Radar"), "Radar").otherwise(F.col("group")))
    out = out.withColumn("share", F.coalesce(F.try_divide(gain, F.sum(gain).over(scale)), F.lit(0.0)))
    out = out.withColumn("group_share", F.sum("share").over(family))
    return out.withColumn("rank", F.row_number().over(scale.orderBy(F.desc_nulls_last("cm"), "feature"))).drop("_family")


def site_contents(tree: DataFrame, identification: DataFrame, layers: DataFrame) -> DataFrame:
    """What each site's archive holds, most layers first: layers (site, leaf), groups, datasets and
    attributes of its tree (site, kind, attrs), the site's own (site, attrs) among these, and whether there is snow depth."""
    entries = tree.groupBy("site").agg(F.count_if(F.col("kind") == "group").alias("groups"), F.count_if(F.col("kind") == "dataset").alias("datasets"), F.sum(F.coalesce(F.size("attrs"), F.lit(0))).alias("_a"))
    own = identification.groupBy("site").agg(F.sum(F.size("attrs")).alias("_b"))
    held = layers.groupBy("site").agg(F.count("*").alias("layers"), F.bool_or(F.col("leaf") == "snow_depth").alias("has_depth"))
    every = held.join(entries, "site", "full_outer").join(own, "site", "full_outer").na.fill(0).na.fill(False, ["has_depth"])
    return every.select("site", "layers", "groups", "datasets", (F.col("_a") + F.col("_b")).alias("attrs"), "has_depth").orderBy(F.desc("layers"), "site")


def prediction_bands(blocks: DataFrame) -> DataFrame:
    """The five bands of a prediction map of blocks (site, brow, bcol, boost, forest, label), in long form:
    both predictions, the label, the error of boosting, and boosting less the site's bias."""
    bias = blocks.groupBy("site").agg((F.avg("boost") - F.avg("label")).alias("_bias"))  # a row a site
    wide = blocks.join(bias, "site").select(
        "site", "brow", "bcol", F.col("boost").alias("boosting"), "forest", "label",
        (F.col("boost") - F.col("label")).alias("boosting_error"), (F.col("boost") - F.col("_bias")).alias("boosting_debiased"),
    )
    return wide.unpivot(["site", "brow", "bcol"], ["boosting", "forest", "label", "boosting_error", "boosting_debiased"], "band", "v")


#: Products that the first base archives are known to lack.
KNOWN_OMISSIONS = ("SWE", "DENSITY")


def inventory_agreement(sites: DataFrame, granules: DataFrame, layers: DataFrame, known: tuple[str, ...] = KNOWN_OMISSIONS) -> DataFrame:
    """Findings where a site's base layers (site, layer) aren't as many as the granules (site, product,
    filename) of its inventory. Granules of a product that is known to be left out aren't expected and get a
    note each. Derived layers don't count; sites outside the inventory aren't judged."""
    omitted = F.coalesce(F.col("product").isin(*known), F.lit(False))
    notes = granules.filter(omitted).select("site", F.col("filename").alias("layer"), F.lit("omission").alias("check"), F.lit("note").alias("severity"), F.col("product").alias("detail"))
    expected = granules.filter(~omitted).groupBy("site").agg(F.count("*").alias("_want"))
    base = F.col("layer").startswith("LIDAR/") & ~F.col("layer").startswith("LIDAR/DERIVED/")
    got = layers.filter(base).groupBy("site").agg(F.count("*").alias("_got"))
    both = sites.select("site").distinct().join(expected, "site", "left").join(got, "site", "left").na.fill(0, ["_want", "_got"])
    wrong = both.filter("_want != _got").select("site", F.lit(None).cast("string").alias("layer"), F.lit("inventory").alias("check"), F.lit("fail").alias("severity"), F.concat_ws("/", "_got", "_want").alias("detail"))
    return notes.unionByName(wrong)


#: How the cells of these layers are stored.
STORED_TYPES = {"int": "complex64", "coherence_mask": "uint8"}


def stored_types(layers: DataFrame, types: dict[str, str] = STORED_TYPES) -> DataFrame:
    """Findings on layers (site, layer, leaf, dtype) whose cells are of another type than their kind's;
    a layer without a type fails, kinds without a rule may have any."""
    want = F.try_element_at(F.create_map(*(F.lit(x) for pair in types.items() for x in pair)), F.col("leaf"))
    wrong = layers.withColumn("_want", want).filter(F.col("_want").isNotNull() & ~F.col("_want").eqNullSafe(F.col("dtype")))
    return wrong.select("site", "layer", F.lit("dtype").alias("check"), F.lit("fail").alias("severity"), F.concat(F.coalesce("dtype", F.lit("none")), F.lit("/"), "_want").alias("detail"))


def match_records(columns: DataFrame) -> DataFrame:
    """A row for each stored match from a site's columns (site, one array each): gap_days as a whole number,
    everything else as text, the flight under the name of its scene.

    Columns of unequal length give as many rows as the longest, with nulls; a null column is an empty one.
    """
    arrays = [f.name for f in columns.schema.fields if isinstance(f.dataType, ArrayType)]
    lists = [F.coalesce(F.col(c), F.array().cast(columns.schema[c].dataType)).alias(c) for c in arrays]
    rows = columns.select("site", F.explode(F.arrays_zip(*lists)).alias("_m"))
    cast = lambda c: F.col("_m")[c].cast("string").try_cast("int") if c == "gap_days" else F.col("_m")[c].cast("string")
    out = rows.select("site", *[cast(c).alias("scene" if c == "flight" else c) for c in arrays])
    return out if "flight" in arrays else out.withColumn("scene", F.lit(""))


def recorded_granules(discovered: DataFrame, recorded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of the discovered granules (site, filename, ...) those that the archive recorded, and what it
    recorded (site, filename) that was not discovered."""
    keys = ["site", "filename"]
    return discovered.join(recorded, keys, "left_semi"), recorded.select(*keys).distinct().join(discovered, keys, "left_anti")


def preferred_products(harvested: DataFrame, original: DataFrame) -> DataFrame:
    """Harvested records (file_id, ...), each replaced as a whole by the original one of its file_id if
    there is one; of several originals the least. Columns are the originals'."""
    rest = [c for c in original.columns if c != "file_id"]
    one = original.groupBy("file_id").agg(F.min(F.struct(*rest)).alias("_o"))
    mine = F.struct(*[(F.col(c) if c in harvested.columns else F.lit(None)).cast(original.schema[c].dataType).alias(c) for c in rest])
    both = harvested.join(one, "file_id", "left")
    return both.select("file_id", F.coalesce("_o", mine).alias("_r"), F.col("_o").isNotNull().alias("from_catalogue")).select("file_id", "_r.*", "from_catalogue")
