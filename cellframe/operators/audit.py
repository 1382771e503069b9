"""Data-quality jobs; each returns findings (site, layer, check, severity, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.sources.shared import delete, stored

COLUMNS = ("site", "layer", "check", "severity", "detail")


def finding(rows: DataFrame, check: str, severity: str, detail: Column) -> DataFrame:
    return rows.select("site", "layer", F.lit(check).alias("check"), F.lit(severity).alias("severity"), detail.cast("string").alias("detail"))


def required_attributes(layers: DataFrame, required: DataFrame) -> DataFrame:
    """Attributes that a layer (site, layer, attrs) of a kind lacks or has blank; ``required`` is (kind, key)."""
    asked = layers.join(required, "kind")
    there = F.try_element_at("attrs", F.col("key"))
    return finding(asked.filter(F.coalesce(F.trim(there), F.lit("")) == ""), "attribute", "fail", F.col("key"))


def grid_agreement(layers: DataFrame, grids: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Layers whose shape, transform, resolution or reference system is not their site's, or whose
    grid is not north-up."""
    both = layers.join(grids.select("site", *[F.col(c).alias("g_" + c) for c in ("epsg", "height", "width", "a", "b", "c", "d", "e", "f")]), "site")
    off = [F.when(F.col(c) != F.col("g_" + c), c) for c in ("epsg", "height", "width")]
    off += [F.when(F.abs(F.col(c) - F.col("g_" + c)) > tolerance, c) for c in ("a", "b", "c", "d", "e", "f")]
    off += [F.when((F.col("b") != 0) | (F.col("d") != 0) | (F.col("e") >= 0), "north_up"), F.when(F.col("epsg") <= 0, "epsg_positive")]
    wrong = both.withColumn("_off", F.concat_ws(",", *off)).filter("_off != ''")
    return finding(wrong, "grid", "fail", F.col("_off"))


def recorded_statistics(layers: DataFrame, stats: DataFrame, tolerance: float = 1e-9) -> DataFrame:
    """Layers whose recorded count or fraction of valid cells is not what their cells give."""
    both = layers.join(stats.select("site", "layer", F.col("valid").alias("_v"), F.col("valid_fraction").alias("_f")), ["site", "layer"])
    wrong = both.filter((F.col("valid") != F.col("_v")) | (F.abs(F.col("valid_fraction") - F.col("_f")) > tolerance))
    return finding(wrong, "statistics", "fail", F.concat_ws("/", "valid", "_v"))


def value_rules(cells: DataFrame, ranges: DataFrame, no_zero: tuple[str, ...] = ("amp1", "amp2", "cor", "unw")) -> DataFrame:
    """Cells out of range, exact zeros and mask states other than 0, 1 and 255, in one pass."""
    r = ranges.withColumnRenamed("kind", "leaf")
    out = cells.join(r, "leaf", "left").groupBy("site", "layer", "leaf").agg(
        F.count_if((F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))).alias("out_of_range"),
        F.count_if(F.col("leaf").isin(*no_zero) & (F.col("v") == 0)).alias("zeros"),
        F.count_if((F.col("leaf") == "coherence_mask") & ~F.col("v").isin(0, 1, 255)).alias("states"),
    )
    long = out.unpivot(["site", "layer"], ["out_of_range", "zeros", "states"], "check", "n").filter("n > 0")
    return long.select("site", "layer", "check", F.lit("fail").alias("severity"), F.col("n").cast("string").alias("detail"))


def swath_subset(cells: DataFrame, reference: str = "amp1") -> DataFrame:
    """By scene and leaf: cells that are there where the reference isn't (a fault), and cells
    missing where it is (a warning, but for unwrapped phase)."""
    ref = cells.filter(F.col("leaf") == reference).select("scene", "row", "col", F.col("v").alias("_r"))
    both = cells.filter(F.col("leaf") != reference).join(ref, ["scene", "row", "col"], "left")
    return both.groupBy("scene", "leaf").agg(
        F.count_if(F.col("v").isNotNull() & F.col("_r").isNull()).alias("faults"),
        F.count_if((F.col("leaf") != "unw") & F.col("v").isNull() & F.col("_r").isNotNull()).alias("warnings"),
    )


def derivation_ends(layers: DataFrame, ends: Column) -> DataFrame:
    """Where each layer's chain of sources ends: (layer, end, steps, circular).

    ``layers`` is (layer, derived_from, ...), one row a layer; rows without a name are left out. A chain goes on until
    ``ends`` holds or there is no such source; ``steps`` are the links followed. One that never ends is
    circular: its end is the circle's least layer, its steps go once around. Pointers double in length
    each round, so a chain of n links takes about log2(n) rounds, each a join by layer.
    """
    spark = layers.sparkSession
    named = layers.filter("layer is not null").select("layer", "derived_from", F.coalesce(ends, F.lit(False)).alias("_ends"))
    known = named.select(F.col("layer").alias("derived_from"), F.lit(True).alias("_known"))
    on_itself = ~F.col("_ends") & (F.col("derived_from") == F.col("layer"))  # the smallest circle, known at once
    goes = ~F.col("_ends") & F.col("_known").isNotNull() & ~F.coalesce(on_itself, F.lit(False))
    first = named.join(known, "derived_from", "left").select(
        "layer", F.when(goes, F.col("derived_from")).otherwise(F.col("layer")).alias("end"), goes.cast("long").alias("steps"), goes.alias("open"), F.col("layer").alias("least"), F.coalesce(on_itself, F.lit(False)).alias("loop"),
    )
    links, links_path = stored(first, "links")
    count = links.count()

    def doubled(state: DataFrame, path: str) -> tuple[DataFrame, str]:
        """Pointers at the ends of all chains; those in or into a circle stay open."""
        reach = 1
        while reach <= 2 * count and not state.filter("open").isEmpty():
            on = state.select(F.col("layer").alias("end"), F.col("end").alias("_end"), F.col("steps").alias("_steps"), F.col("open").alias("_open"), F.col("least").alias("_least"), F.col("loop").alias("_loop"))
            moved = state.filter("open").join(on, "end").select("layer", F.col("_end").alias("end"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open"), F.least("least", "_least").alias("least"), F.col("_loop").alias("loop"))
            last = path
            state, path = stored(state.filter("not open").unionByName(moved), "links")
            if last != links_path:
                delete(spark, last)
            reach *= 2
        return state, path

    state, path = doubled(links, links_path)
    done = state.filter("not open").select("layer", "end", "steps", F.col("loop").alias("circular"))
    if state.filter("open").isEmpty():
        return done
    # after as many steps as there are layers every open pointer is on its circle
    on_circle = state.filter("open").select(F.col("end").alias("layer")).distinct()
    circles = state.join(on_circle, "layer", "left_semi").select("layer", F.col("least").alias("circle"))
    sizes = circles.groupBy("circle").agg(F.count("*").alias("_size"))
    again = links.join(state.filter("open").select("layer"), "layer", "left_semi").join(on_circle.withColumn("_on", F.lit(True)), "layer", "left")
    stop = F.col("_on").isNotNull()
    tails = again.select("layer", F.when(stop, F.col("layer")).otherwise(F.col("end")).alias("end"), F.when(stop, 0).otherwise(F.col("steps")).cast("long").alias("steps"), (~stop).alias("open"), "least", "loop")
    reached, _ = doubled(*stored(tails, "links"))
    round_ = reached.join(circles.withColumnRenamed("layer", "end"), "end").join(sizes, "circle")
    return done.unionByName(round_.select("layer", F.col("circle").alias("end"), (F.col("steps") + F.col("_size") - 1).alias("steps"), F.lit(True).alias("circular")))


def empty_chains(layers: DataFrame) -> DataFrame:
    """Empty layers whose emptiness nothing explains. (layer, derived_from, valid, reason).

    An empty layer is explained by its own reason or by an empty source that is; a chain that
    ends in a layer with cells, that goes in a circle or that ends nowhere is not.
    """
    empty = F.coalesce(F.col("valid") == 0, F.lit(False))
    ends = derivation_ends(layers, ~empty | F.col("reason").isNotNull())
    reasons = layers.select(F.col("layer").alias("end"), (empty & F.col("reason").isNotNull()).alias("explained"))
    mine = ends.join(layers.filter(empty).select("layer"), "layer", "left_semi")
    return mine.join(reasons, "end").select("layer", (F.col("explained") & ~F.col("circular")).alias("explained"), F.col("steps").cast("int").alias("steps"))


def empty_verdicts(layers: DataFrame) -> DataFrame:
    """Findings on empty layers: a warning where a recorded step explains it, else a failure.

    ``layers`` is (site, layer, leaf, derived_from, valid, reason, zero_mask, zeros_masked). A reason of
    ``unwrapper_zero_fill`` holds for unwrapped phase whose mask of zero fills was applied and took
    cells; ``no_valid_input_cells`` where the direct source is empty, too, and the chain of empty
    sources isn't circular. Nothing else explains.
    """
    empty = F.coalesce(F.col("valid") == 0, F.lit(False))
    ends = derivation_ends(layers, ~empty).select("layer", "circular")
    sources = layers.filter(empty).select(F.col("layer").alias("derived_from"), F.lit(True).alias("_empty_source"))
    rows = layers.filter(empty).join(ends, "layer", "left").join(sources, "derived_from", "left")
    unwrapped = (F.col("reason") == "unwrapper_zero_fill") & (F.col("leaf") == "unw") & (F.col("zero_mask") == "applied") & (F.col("zeros_masked") > 0)
    derived = (F.col("reason") == "no_valid_input_cells") & F.col("_empty_source").isNotNull() & ~F.col("circular")
    fine = F.coalesce(unwrapped, F.lit(False)) | F.coalesce(derived, F.lit(False))
    return rows.select("site", "layer", F.lit("empty").alias("check"), F.when(fine, "warn").otherwise("fail").alias("severity"), F.when(fine, F.col("reason")).alias("detail"))


def unequal_columns(matches: DataFrame, columns: list[str]) -> DataFrame:
    """Rows of array columns that do not have the same length."""
    sizes = [F.size(c) for c in columns]
    return matches.filter(F.greatest(*sizes) != F.least(*sizes))


def valid_cells(cells: DataFrame, keys: list[str], parts: list[str]) -> DataFrame:
    """Cells of each layer in which every part is there: the value, or both parts of a complex one."""
    there = F.lit(True)
    for c in parts:
        there = there & F.col(c).isNotNull()
    return cells.groupBy(*keys).agg(F.count_if(there).alias("valid"))


def empty_layers(stats: DataFrame) -> DataFrame:
    return stats.filter("valid = 0")


def wavelength(scenes: DataFrame, low: float = 23.0, high: float = 25.0) -> DataFrame:
    return scenes.filter(F.col("wavelength_cm").isNull() | ~F.col("wavelength_cm").between(low, high))


def coverage(expected: DataFrame, cached: DataFrame, key: str) -> DataFrame:
    """Expected keys that are not there, and how many, by site."""
    return expected.join(cached.select(key).distinct(), key, "left_anti").groupBy("site").agg(F.count("*").alias("missing"))


def hollow_groups(groups: DataFrame, layers: DataFrame, key: str = "group") -> DataFrame:
    """Acquisitions without a layer."""
    return groups.join(layers.select(key).distinct(), key, "left_anti")


def severities(findings: DataFrame) -> DataFrame:
    """Findings by site and severity, with the sites' total."""
    return findings.rollup("site", "severity").count().withColumnRenamed("count", "n")


def first_lines(findings: DataFrame, n: int) -> DataFrame:
    """At most ``n`` findings of each severity, as a report shows them."""
    w = Window.partitionBy("severity").orderBy("site", "layer", "check", "detail")
    return findings.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def corrections(layers: DataFrame, fixes: DataFrame) -> DataFrame:
    """Metadata with exact old wordings replaced, all or none: (layer, key, value) and fixes
    (layer, key, old, new). A value that is neither old nor new is an error."""
    both = layers.join(fixes, ["layer", "key"], "left")
    odd = F.col("old").isNotNull() & (F.col("value") != F.col("old")) & (F.col("value") != F.col("new"))
    checked = F.when(odd, F.raise_error(F.concat(F.lit("unexpected wording in "), "layer"))).otherwise(F.coalesce("new", "value"))
    return both.withColumn("history", F.when(F.col("value") == F.col("old"), F.to_json(F.struct("old", "new")))).withColumn("value", checked).select("layer", "key", "value", "history")


def history_entries(stats: DataFrame, stage: str, keys=("layer",)) -> DataFrame:
    """Rows to append to a layer's processing history."""
    return stats.select(*keys, F.lit(stage).alias("stage"), F.to_json(F.struct(*[c for c in stats.columns if c not in keys])).alias("entry"))


def lineage(runs: DataFrame) -> DataFrame:
    """Runs (stage, parameters, inputs) with the hash of their recipe."""
    return runs.withColumn("recipe", F.sha2(F.to_json(F.struct("stage", "parameters", F.array_sort("inputs").alias("inputs"))), 256))


def recomputed_blocks(blocks: DataFrame, recomputed: DataFrame, keys=("layer",)) -> DataFrame:
    """Packed codes of the first, middle and last block, of one at the lower quartile of those
    there, and of one empty block, that are further than 1 from what their cells give."""
    w = Window.partitionBy(*keys, F.col("code") > 0).orderBy("brow", "bcol")
    n = F.count("*").over(Window.partitionBy(*keys, F.col("code") > 0))
    placed = blocks.withColumns({"_n": F.row_number().over(w), "_all": n})
    chosen = F.col("_n").isin(1) | (F.col("_n") == F.col("_all")) | (F.col("_n") == F.ceil(F.col("_all") / 2)) | (F.col("_n") == F.ceil(F.col("_all") / 4))
    some = placed.filter(F.when(F.col("code") > 0, chosen).otherwise(F.col("_n") == 1))
    both = some.join(recomputed.select(*keys, "brow", "bcol", F.col("code").alias("_again")), [*keys, "brow", "bcol"], "left")
    return both.withColumn("fine", F.abs(F.col("code") - F.coalesce("_again", F.lit(0))) <= 1).drop("_n", "_all")


def site_rollup(layers: DataFrame) -> DataFrame:
    """Layers, groups and whether there is snow depth, by site, most layers first."""
    return layers.groupBy("site").agg(F.count("*").alias("layers"), F.countDistinct("group").alias("groups"), F.bool_or(F.col("leaf") == "snow_depth").alias("has_depth")).orderBy(F.desc("layers"), "site")


def inventory_summary(products: DataFrame, levels: list[str]) -> DataFrame:
    """Files by level, matched granules and bytes, by site."""
    counts = products.groupBy("site").pivot("level", levels).agg(F.count(F.lit(1)))
    sums = products.groupBy("site").agg(F.countDistinct(F.when(F.col("matched"), F.col("granule"))).alias("matched_granules"), F.sum("bytes").alias("bytes"))
    return counts.na.fill(0).join(sums, "site")
