"""Removal of small patches: 4-connected components of valid cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.model import KEYS
from cellframe.sources.shared import checkpoint_dir

LEAST = 100


def ensure_checkpoints(df: DataFrame) -> None:
    """Sets the folder for checkpoints only where neither the session nor the context has one."""
    checkpoint_dir(df.sparkSession)


def runs(cells: DataFrame, keys=KEYS) -> DataFrame:
    """Stretches of valid cells along rows: (keys, row, c0, c1, n, run)."""
    w = Window.partitionBy(*keys, "row").orderBy("col")
    island = F.col("col") - F.row_number().over(w)
    found = cells.filter("v is not null").select(*keys, "row", "col").withColumn("_i", island)
    out = found.groupBy(*keys, "row", "_i").agg(F.min("col").alias("c0"), F.max("col").alias("c1"), F.count("*").alias("n"))
    return out.drop("_i").withColumn("run", F.col("row").cast("long") * (1 << 31) + F.col("c0"))


STRIP = 128


def label_strips(found: DataFrame, keys=KEYS) -> DataFrame:
    """Runs with the least run of their part of a component inside a strip of STRIP rows.

    A strip's runs are a bounded group; they are joined in Python by union and find."""
    import pandas as pd

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "c0"]).reset_index(drop=True)
        parent = list(range(len(pdf)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        row, c0, c1 = (pdf[c].tolist() for c in ("row", "c0", "c1"))
        above = 0
        for i in range(len(pdf)):
            while above < i and (row[above] < row[i] - 1 or (row[above] == row[i] - 1 and c1[above] < c0[i])):
                above += 1
            j = above
            while j < i and row[j] == row[i] - 1 and c0[j] <= c1[i]:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
                j += 1
        pdf["part"] = [pdf["run"].iat[root(i)] for i in range(len(pdf))]
        return pdf

    from pyspark.sql import types as T

    with_strip = found.withColumn("strip", F.floor(F.col("row") / STRIP).cast("int"))
    schema = T.StructType([*with_strip.schema.fields, T.StructField("part", T.LongType())])
    return with_strip.groupBy(*keys, "strip").applyInPandas(join, schema)


def label_runs(found: DataFrame, keys=KEYS, most_rounds: int = 64) -> DataFrame:
    """Runs with the least run that touching runs lead to.

    Parts of components inside strips of rows are joined first; only parts that meet at the
    border of two strips go on. Their labels go to neighbours and then to the label's own
    label, so long patches take few rounds; each round is cut off.
    """
    ensure_checkpoints(found)
    found = label_strips(found, keys).checkpoint()
    edge = found.filter(F.col("row") % STRIP == STRIP - 1).select(*keys, (F.col("row") + 1).alias("row"), F.col("c0").alias("a0"), F.col("c1").alias("a1"), F.col("part").alias("b"))
    touch = found.join(edge, [*keys, "row"]).filter("c0 <= a1 and a0 <= c1").select(*keys, F.col("part").alias("a"), "b").distinct()
    both = touch.union(touch.select(*keys, "b", "a")).checkpoint()
    labels = both.select(*keys, F.col("a").alias("part"), F.col("a").alias("label")).distinct()
    for _ in range(most_rounds):
        near = both.join(labels.withColumnRenamed("part", "b"), [*keys, "b"]).groupBy(*keys, F.col("a").alias("part")).agg(F.min("label").alias("_near"))
        stepped = labels.join(near, [*keys, "part"], "left").withColumn("_new", F.least("label", "_near"))
        root = labels.select(*keys, F.col("part").alias("_new"), F.col("label").alias("_far"))
        jumped = stepped.join(root, [*keys, "_new"], "left").select(*keys, "part", F.col("label").alias("_old"), F.least("_new", "_far").alias("label")).checkpoint()
        labels = jumped.drop("_old")
        if jumped.filter("label != _old").isEmpty():
            return found.join(labels, [*keys, "part"], "left").withColumn("label", F.coalesce("label", "part")).drop("part", "strip")
    raise ValueError("components still change")


def despeckle(cells: DataFrame, least: int = LEAST, keys=KEYS) -> DataFrame:
    """Cells of components smaller than ``least`` become missing, unless there is only one."""
    labelled = label_runs(runs(cells, keys), keys)
    sizes = labelled.groupBy(*keys, "label").agg(F.sum("n").alias("size"))
    many = sizes.groupBy(*keys).agg(F.count("*").alias("components"))
    small = labelled.join(sizes, [*keys, "label"]).join(many, list(keys)).filter((F.col("size") < least) & (F.col("components") > 1))
    gone = small.select(*keys, "row", F.explode(F.sequence(F.col("c0").cast("int"), F.col("c1").cast("int"))).alias("col"), F.lit(True).alias("_gone"))
    out = cells.join(gone, [*keys, "row", "col"], "left")
    return out.withColumn("v", F.when(F.col("_gone").isNull(), F.col("v"))).drop("_gone")
