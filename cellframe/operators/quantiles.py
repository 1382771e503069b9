"""Exact quantiles of large groups by refining a histogram around their ranks.

No task ever holds a group: values are counted by bucket inside tasks, a group's buckets are at
most ``BUCKETS`` rows, and only the bucket in which a rank falls is looked at again, with its own least
and greatest value as bounds. What is left is sorted once its bucket has ``SORTED`` values or fewer.
Every third round cuts by magnitude, so that values of all scales take few rounds, too.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.model import KEYS
from cellframe.sources.shared import delete, stored

BUCKETS = 4096
SORTED = 1_000_000


def magnitude(v: Column) -> Column:
    """Grows with v, though not strictly, and as fast over each power of ten of either sign."""
    return F.when(v == 0, 0.0).otherwise(F.signum(v) * (F.log(F.abs(v)) + 750))


def bucket_of(v: Column, low: Column, high: Column, buckets: int, by_magnitude: bool = False) -> Column:
    """Which of some equal parts of low to high holds v; never less for a greater v. Halves, since
    the distance of two doubles may be beyond all doubles."""
    v, low, high = (magnitude(c) if by_magnitude else c / 2 for c in (v, low, high))
    part = F.try_divide(v - low, high - low)
    return F.least(F.floor(F.coalesce(part, F.lit(0.0)) * buckets), F.lit(buckets - 1)).cast("int")


def at_ranks(cells: DataFrame, ranks: DataFrame, keys: list[str], value: str, buckets: int, most: int) -> DataFrame:
    """(keys, rank, v): the value at each rank (from 0) among a group's values that aren't null.

    ``ranks`` has keys, rank, low and high (the group's bounds) and n, its values. Keys are not null.
    Each round counts the values of the ranges that hold a rank: bounds are joined to the cells,
    a row a range. A bucket is narrower than its range and has bounds of its own, so outliers
    go in one round; ranges of one value are done.
    """
    spark = cells.sparkSession
    cells = cells.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v"))
    within = F.col("_v").between(F.col("low"), F.col("high"))
    todo, path = stored(ranks.withColumnRenamed("n", "held").withColumn("left", F.col("rank")), "ranks")
    for turn in itertools.count():
        wide = todo.filter((F.col("low") < F.col("high")) & (F.col("held") > most))
        if wide.isEmpty():
            break
        ranges = wide.select(*keys, "low", "high").distinct()
        inside = cells.join(ranges, keys).filter(within)
        counted = inside.groupBy(*keys, "low", "high", bucket_of(F.col("_v"), F.col("low"), F.col("high"), buckets, turn % 3 == 2).alias("bucket")).agg(F.count("*").alias("here"), F.min("_v").alias("_low"), F.max("_v").alias("_high"))
        before = Window.partitionBy(*keys, "low", "high").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        counted = counted.withColumn("ahead", F.coalesce(F.sum("here").over(before), F.lit(0)))
        found = wide.join(counted, [*keys, "low", "high"]).filter((F.col("left") >= F.col("ahead")) & (F.col("left") < F.col("ahead") + F.col("here")))
        narrower = found.select(*keys, "rank", F.col("_low").alias("low"), F.col("_high").alias("high"), F.col("here").alias("held"), (F.col("left") - F.col("ahead")).alias("left"))
        rest = todo.filter((F.col("low") >= F.col("high")) | (F.col("held") <= most))
        last = path
        todo, path = stored(rest.select(narrower.columns).unionByName(narrower), "ranks")
        delete(spark, last)
    done = todo.filter("low >= high").select(*keys, "rank", F.col("low").alias("v"))
    few = todo.filter("low < high")
    ranges = few.select(*keys, "low", "high").distinct()
    counted = cells.join(ranges, keys).filter(within).groupBy(*keys, "low", "high", "_v").agg(F.count("*").alias("here"))
    before = Window.partitionBy(*keys, "low", "high").orderBy("_v").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.withColumn("ahead", F.coalesce(F.sum("here").over(before), F.lit(0)))
    last = few.join(counted, [*keys, "low", "high"]).filter((F.col("left") >= F.col("ahead")) & (F.col("left") < F.col("ahead") + F.col("here")))
    return done.unionByName(last.select(*keys, "rank", F.col("_v").alias("v")))


def quantiles(cells: DataFrame, parts: dict[str, float], keys=KEYS, value: str = "v", buckets: int = BUCKETS, most: int = SORTED) -> DataFrame:
    """Exact quantiles of each group, a column for each name of ``parts``; linear between ranks.

    Null values don't count; a group without values has nulls. NaN and infinities are none, by the
    missing-value contract. A null key is a group. ``keys`` may be empty: one row for the whole table.
    """
    keys = list(keys)
    # keys as text without null, so that joins are equalities: two columns a key
    safe = {f"_k{i}": F.col(k) for i, k in enumerate(keys)} | {f"_z{i}": F.col(k).isNull() for i, k in enumerate(keys)}
    named = cells.select(*[F.coalesce(c.cast("string"), F.lit("")).alias(n) if n.startswith("_k") else c.alias(n) for n, c in safe.items()], *[F.col(k).alias(f"_o{i}") for i, k in enumerate(keys)], F.col(value).cast("double").alias("_x"))
    by = [*safe] or ["_k"]
    if not safe:
        named = named.withColumn("_k", F.lit(0))
    groups = named.groupBy(*by).agg(*[F.first(f"_o{i}", ignorenulls=True).alias(k) for i, k in enumerate(keys)], F.count("_x").alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"))
    groups, _ = stored(groups, "groups")
    wanted = F.array(*[F.struct(F.lit(name).alias("name"), (F.lit(float(p)) * (F.col("n") - 1)).alias("place")) for name, p in parts.items()])
    each = groups.filter("n > 0").select(*by, "low", "high", "n", F.explode(wanted).alias("_w")).select(*by, "low", "high", "n", "_w.name", "_w.place")
    ends = each.select("*", F.explode(F.array(F.floor("place"), F.ceil("place"))).alias("rank"))
    values = at_ranks(named, ends.select(*by, "rank", "low", "high", "n").distinct(), by, "_x", buckets, most)
    lower = values.select(*by, F.col("rank").alias("_lower"), F.col("v").alias("_a"))
    upper = values.select(*by, F.col("rank").alias("_upper"), F.col("v").alias("_b"))
    named_ranks = each.withColumns({"_lower": F.floor("place"), "_upper": F.ceil("place")}).join(lower, [*by, "_lower"]).join(upper, [*by, "_upper"])
    share = F.col("place") - F.col("_lower")
    between = F.col("_a") * (1 - share) + F.col("_b") * share
    wide = named_ranks.groupBy(*by).agg(*[F.max(F.when(F.col("name") == name, between)).alias(name) for name in parts])
    return groups.join(wide, by, "left").select(*keys, *parts)


def joined(table: DataFrame, other: DataFrame, keys) -> DataFrame:
    """Two tables of one row a group side by side; null keys are equal."""
    keys = list(keys)
    if not keys:
        return table.join(other, F.lit(True), "left")  # one row each
    renamed = other.withColumnsRenamed({k: f"_j_{k}" for k in keys})
    fits = F.lit(True)
    for k in keys:
        fits = fits & F.col(k).eqNullSafe(F.col(f"_j_{k}"))
    return table.join(renamed, fits, "left").drop(*(f"_j_{k}" for k in keys))
