"""Resumable ingest: new cell files as a stream, each cell of a layer stored once.

A stream's checkpoint says which files have been read. Each batch goes to a folder of its own
that a second try overwrites, so a batch that was lost half-way leaves nothing twice. A small
table beside the cells says which layers are in which folder: a batch reads cells back only from
folders that hold one of its layers.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

CELL = ["layer", "content_key", "row", "col"]


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def ingest(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str) -> StreamingQuery:
    """Appends cells not yet below ``target`` from files that appear below ``source``. The cells
    have site, layer, content_key, row and col; a layer may come in several files and batches.
    read_cells() gives what is there. Ends when all files there now are read."""
    name = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]
    cells, ledger = f"{target}/cells", f"{target}/ledger"

    def store(batch: DataFrame, number: int) -> None:
        s = batch.sparkSession
        folder = f"{name}-{number}"
        new = batch.dropDuplicates(CELL)
        if exists(s, ledger):
            there = s.read.parquet(ledger).filter(f"folder != '{folder}'")
            layers = batch.select("layer", "content_key").distinct()
            known = [r.folder for r in there.join(layers, ["layer", "content_key"], "left_semi").select("folder").distinct().collect()]
            if known:
                old = s.read.parquet(cells).filter(F.col("folder").isin(known))
                new = new.join(old.select(*CELL), CELL, "left_anti")
        at = f"{cells}/folder={folder}"
        new.write.mode("overwrite").partitionBy("site").parquet(at)
        stored = s.read.schema(batch.schema).parquet(at).select("layer", "content_key").distinct()
        stored.write.mode("overwrite").parquet(f"{ledger}/folder={folder}")

    stream = spark.readStream.schema(schema).parquet(source)
    return stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_cells(spark: SparkSession, target: str) -> DataFrame:
    """The cells that ingest() has stored: of folders that the ledger names, so that a batch which was
    broken off before its ledger row shows nothing."""
    named = spark.read.parquet(f"{target}/ledger").select("folder").distinct()
    return spark.read.parquet(f"{target}/cells").join(named, "folder", "left_semi").drop("folder")
