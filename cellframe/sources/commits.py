"""Layers, their metadata and statistics stored together, by one commit.

A write goes to folders of its own name, which nothing reads. The commit is one small file in
``log``, moved into place under the next free number: before it nothing of the write shows, after it
all of it does. Readers go from the log to folders, so a write that was broken off, tried twice or is
still going on is never read; sweep() deletes what it left. Of a layer that was written more
than once, the commit with the highest number holds.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cellframe.model import KEYS
from cellframe.operators.quantiles import joined
from cellframe.operators.stats import layer_stats
from cellframe.sources.rasters import TILE
from cellframe.sources.shared import delete

LOG = "number long, folder string, kind string, items long"
#: Hex digits of a row's hash that go into one sum.
DIGITS = 15


def identity(table: DataFrame, keys=KEYS, shape: tuple[str, str] | None = ("row", "col")) -> DataFrame:
    """Identity of each group's content whatever its order: keys, ``height`` and ``width`` (of what is
    there, null without ``shape``), ``cells``, ``digest``.

    The digest covers names and types of all columns but the keys, in order of name, the shape, and
    every row with its number of repeats. Null and the empty text are told apart, as are
    0.0 and -0.0. Two sums of hashes are taken inside tasks, so nothing is sorted or gathered.
    """
    kept = sorted(c for c in table.columns if c not in keys)
    kinds = ", ".join(f"{c} {dict(table.dtypes)[c]}" for c in kept)
    text = F.concat_ws("\x1f", *[F.when(F.col(f"`{c}`").isNull(), "-").otherwise(F.concat(F.lit("+"), as_text(F.col(f"`{c}`"), dict(table.dtypes)[c]))) for c in kept])
    rows = table.withColumn("_hash", F.md5(text))
    part = lambda k: F.sum(F.conv(F.substring("_hash", 1 + k * DIGITS, DIGITS), 16, 10).cast("decimal(38,0)")).cast("string")
    most = lambda c: (F.max(c) + 1) if shape else F.lit(None).cast("int")
    height, width = shape or ("_hash", "_hash")
    out = rows.groupBy(*keys).agg(most(height).alias("height"), most(width).alias("width"), F.count("*").alias("cells"), part(0).alias("_one"), part(1).alias("_two"))
    said = F.concat_ws("|", F.lit(kinds), F.coalesce(F.col("height").cast("string"), F.lit("")), F.coalesce(F.col("width").cast("string"), F.lit("")), "cells", "_one", "_two")
    return out.select(*keys, "height", "width", "cells", F.sha2(said, 256).alias("digest"))


def as_text(c: Column, kind: str) -> Column:
    nested = kind.startswith(("array", "map", "struct"))
    return F.to_json(c) if nested else F.hex(c) if kind == "binary" else c.cast("string")


def commits(spark: SparkSession, root: str) -> DataFrame:
    """The log: number, folder, kind and items of each commit."""
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/log")
    if not place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        return spark.createDataFrame([], LOG)
    return spark.read.schema(LOG).json(f"{root}/log")


def commit(spark: SparkSession, root: str, folder: str, kind: str, items: int) -> int:
    """Adds a folder to the log; its number. Of two writers that want a number one gets the next."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop = jvm.org.apache.hadoop.fs
    log = hadoop.Path(f"{root}/log")
    fs = log.getFileSystem(conf)
    fs.mkdirs(log)
    files = hadoop.FileContext.getFileContext(fs.getUri(), conf)
    never_over = spark.sparkContext._gateway.new_array(hadoop.Options.Rename, 0)
    number = max([int(s.getPath().getName().split(".")[0]) for s in fs.listStatus(log) if s.getPath().getName()[0].isdigit()], default=0)
    while True:
        number += 1
        aside = hadoop.Path(f"{root}/log/_{folder}-{number}")
        out = fs.create(aside, True)
        out.write(bytearray(json.dumps({"number": number, "folder": folder, "kind": kind, "items": items}).encode()))
        out.close()
        try:
            files.rename(aside, hadoop.Path(f"{root}/log/{number:012d}.json"), never_over)
        except Py4JJavaError as e:
            if "FileAlreadyExists" not in str(e.java_exception.getClass().getName()):
                raise
            fs.delete(aside, False)
        else:
            return number


def write_layers(cells: DataFrame, metadata: DataFrame, root: str) -> int:
    """Stores ``cells`` (site, product, layer, row, col, v, or re and im) with ``metadata`` (layer, attrs)
    as one commit; its number.

    Statistics and identity are worked out from what was written. A layer without metadata has
    null for it; metadata of layers without cells is left out. Cells are dealt by layer and strip
    of tiles, and sorted so that windows prune row groups.
    """
    spark, folder = cells.sparkSession, uuid.uuid4().hex
    at, beside = f"{root}/cells/commit={folder}", f"{root}/layers/commit={folder}"
    tiles = {"tile_row": F.floor(F.col("row") / TILE).cast("int"), "tile_col": F.floor(F.col("col") / TILE).cast("int")}
    order = ["layer", "tile_row", "tile_col", "row", "col"]
    dealt = cells.withColumns(tiles).repartition("site", "product", "layer", "tile_row")
    dealt.sortWithinPartitions("site", "product", *order).write.partitionBy("site", "product").parquet(at)
    there = spark.read.parquet(at).drop("tile_row", "tile_col")
    plain = there.drop("site", "product")
    described = joined(layer_stats(there), identity(plain).drop("cells"), KEYS)
    described = joined(described, metadata.select("layer", "attrs"), KEYS)
    described.write.parquet(beside)
    return commit(spark, root, folder, "layers", spark.read.parquet(beside).count())


def read_layers(spark: SparkSession, root: str) -> DataFrame:
    """Metadata, statistics and identity of each layer in its last commit, with ``commit``."""
    log = commits(spark, root).filter("kind = 'layers'")
    if log.isEmpty():
        raise FileNotFoundError(f"nothing is committed below {root}")
    seen = spark.read.parquet(f"{root}/layers").join(log.select(F.col("folder").alias("commit"), "number"), "commit")
    last = Window.partitionBy("layer").orderBy(F.desc("number"))
    return seen.withColumn("_k", F.row_number().over(last)).filter("_k = 1").drop("_k", "number")


def read_cells(spark: SparkSession, root: str) -> DataFrame:
    """Cells of each layer in its last commit; folders of other commits aren't opened."""
    current = read_layers(spark, root).select("layer", "commit")
    return spark.read.parquet(f"{root}/cells").join(current, ["commit", "layer"], "left_semi").drop("commit", "tile_row", "tile_col")


def write_table(table: DataFrame, root: str, kind: str) -> int | None:
    """Stores a table of some kind (matches, findings) whole, as a commit that replaces the last of its
    kind; None, and nothing is written, if its content is that of the last one, in any order."""
    spark, folder = table.sparkSession, uuid.uuid4().hex
    found = identity(table, [], None).first()
    said = f"{kind}:{found.digest if found else ''}"
    log = commits(spark, root).filter(F.split("kind", ":")[0] == kind)
    before = log.agg(F.max_by("kind", "number")).first()[0]
    if before == said:
        return None
    table.write.parquet(f"{root}/{kind}/commit={folder}")
    return commit(spark, root, folder, said, found.cells if found else 0)


def read_table(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """The table of a kind as its last commit has it."""
    folder = commits(spark, root).filter(F.split("kind", ":")[0] == kind).agg(F.max_by("folder", "number")).first()[0]
    if folder is None:
        raise FileNotFoundError(f"no {kind} is committed below {root}")
    return spark.read.parquet(f"{root}/{kind}/commit={folder}")


def sweep(spark: SparkSession, root: str) -> list[str]:
    """Deletes folders of writes that aren't in the log; their paths. For when no write is going on."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    known = {r.folder for r in commits(spark, root).select("folder").collect()}  # a row a commit
    top = hadoop.Path(root)
    fs, gone = top.getFileSystem(conf), []
    for kind in fs.listStatus(top):
        for s in fs.listStatus(kind.getPath()) if kind.isDirectory() and kind.getPath().getName() != "log" else []:
            name = s.getPath().getName()
            if name.startswith("commit=") and name.removeprefix("commit=") not in known:
                gone.append(s.getPath().toString())
                delete(spark, gone[-1])
    return gone
