"""Queries that write through the commit log and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.catalog import query
from cellframe.model import rounded as r
from cellframe.plans.fixtures import G_ORDERS, g_orders, read
from cellframe.sources import commits, rasters, texts
from cellframe.sources.shared import shared_path

IDENTITY_SQL = """md5(concat_ws(chr(31), '+' || col, '+' || row, CASE WHEN v IS NULL THEN '-' ELSE '+' || v::VARCHAR END))"""


@query(f"""WITH {G_ORDERS}, q AS (SELECT 'orders' || row % 4 AS layer, row, col, CASE WHEN col % 9 > 0 THEN round(v * 4) / 4 + CASE WHEN row % 4 = 1 THEN 5 ELSE 0 END END AS v FROM g),
h AS (SELECT *, {IDENTITY_SQL} AS h FROM q),
s AS (SELECT layer, max(row) + 1 AS height, max(col) + 1 AS width, count(*) AS cells, count(v) AS valid, quantile_cont(v, 0.5) AS median, sum(v) AS total,
  sum(CAST('0x' || substr(h, 1, 15) AS BIGINT))::VARCHAR AS one, sum(CAST('0x' || substr(h, 16, 15) AS BIGINT))::VARCHAR AS two FROM h GROUP BY layer)
SELECT layer, cells, valid, round(median, 6) + 0.0 AS median, CASE WHEN layer = 'orders1' THEN 'feet' WHEN layer <> 'orders3' THEN 'metres' END AS units,
  sha256(concat_ws('|', 'col int, row int, v double', height, width, cells, one, two)) AS digest, round(total, 2) AS total FROM s""")
def committed_layers(spark: SparkSession, d: str) -> DataFrame:
    """Four layers in one commit, one of them written again in a second, one write broken off before
    its commit: metadata, statistics, identity and cells of what holds."""
    root = shared_path(spark, "archive")
    v = F.when(F.col("col") % 9 > 0, F.round(F.col("v") * 4) / 4)
    cells = g_orders(spark, d).select(F.lit("s").alias("site"), F.lit("dem").alias("product"), F.concat(F.lit("orders"), F.col("row") % 4).alias("layer"), "row", "col", v.alias("v"))
    metadata = lambda units, *k: spark.createDataFrame([(f"orders{i}", {"units": units}) for i in k], "layer string, attrs map<string,string>")
    commits.write_layers(cells, metadata("metres", 0, 1, 2), root)
    again = cells.filter("layer = 'orders1'").withColumn("v", F.col("v") + 5)
    commits.write_layers(again, metadata("feet", 1), root)
    cells.withColumn("v", F.lit(0.0)).write.partitionBy("site", "product").parquet(f"{root}/cells/commit=brokenoff")
    totals = commits.read_cells(spark, root).groupBy("layer").agg(r(F.sum("v"), 2).alias("total"))
    out = commits.read_layers(spark, root).join(totals, "layer")
    return out.select("layer", "cells", "valid", r("median").alias("median"), F.col("attrs.units").alias("units"), "digest", "total")


@query("""SELECT l_suppkey AS supplier, count(*) AS n, CAST(sum(l_linenumber) AS BIGINT) AS lines, 1 AS number FROM lineitem GROUP BY l_suppkey""")
def matches_written_once(spark: SparkSession, d: str) -> DataFrame:
    """A table written twice, the second time in another order: the second write does nothing."""
    root = shared_path(spark, "matches")
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_shipdate")
    commits.write_table(rows, root, "matches")
    if commits.write_table(rows.repartition(7, "l_suppkey").select(*reversed(rows.columns)), root, "matches") is not None:
        raise AssertionError("an equal table was written again")
    number = commits.commits(spark, root).agg(F.max("number").cast("int").alias("number"))
    out = commits.read_table(spark, root, "matches").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count("*").alias("n"), F.sum("l_linenumber").cast("long").alias("lines"))
    return out.join(number, F.lit(True))


@query(f"WITH {G_ORDERS} SELECT 'strip' || row // 10 AS file, row % 10 AS row, col, CAST(v AS FLOAT)::DOUBLE AS v FROM g WHERE row % 10 BETWEEN 2 AND 6 AND col BETWEEN 30 AND 44 AND row // 10 < (SELECT max(row) // 10 FROM g)")
def fixed_width_read_back(spark: SparkSession, d: str) -> DataFrame:
    """A layer in headerless binaries of ten rows each; a window of every one is read."""
    path = shared_path(spark, "binaries")
    g = g_orders(spark, d)
    last = g.agg(F.floor(F.max("row") / 10).cast("int").alias("last"))
    whole = g.withColumn("strip", F.floor(F.col("row") / 10).cast("int")).join(last, F.col("strip") < F.col("last")).drop("last")
    rasters.write_fixed_width(whole.withColumn("row", F.col("row") % 10), path, F.concat(F.lit("strip"), "strip"), 10, 100)
    return rasters.scan_fixed_width(spark, path, 10, 100, r0=2, c0=30, nr=5, nc=15, with_file=True)


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 > 0 THEN o_totalprice END AS thickness, CAST(o_custkey AS DOUBLE) AS x, CAST(NULL AS DOUBLE) AS swe FROM orders""")
def transects_read_back(spark: SparkSession, d: str) -> DataFrame:
    path, k = shared_path(spark, "transects"), F.col("o_orderkey")
    raw = read(spark, d, "orders").select(k.alias("Time"), F.when(k % 5 == 0, -9999).otherwise(F.col("o_totalprice")).alias("Thick ness"), F.col("o_custkey").alias("EASTING"))
    raw.write.option("header", True).csv(path)
    return texts.scan_transects(spark, path).select(F.col("time").cast("long").alias("o_orderkey"), "thickness", "x", "swe")


@query("""SELECT 'site' || s_nationkey % 8 AS site, s_suppkey AS granule, s_name AS name FROM supplier""")
def inventory_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Nested inventories, a document for each site, opened again."""
    path = shared_path(spark, "inventory")
    rows = read(spark, d, "supplier").groupBy(F.concat(F.lit("site"), F.col("s_nationkey") % 8).alias("key"))
    granules = rows.agg(F.collect_list(F.struct(F.col("s_suppkey").alias("granule"), F.col("s_name").alias("name"))).alias("granules"))
    granules.select(F.col("key").alias("part"), F.array(F.struct("key", "granules")).alias("sites")).write.partitionBy("part").json(path)
    return texts.inventory(spark, path, "granules")


@query("""SELECT c_custkey AS file, 'P' || c_custkey AS pit, CASE WHEN c_custkey % 3 > 0 THEN c_mktsegment END AS note FROM customer""")
def annotations_and_pits_read_back(spark: SparkSession, d: str) -> DataFrame:
    """Annotation files, one a line of text, and the fields that their values hold."""
    path, k = shared_path(spark, "annotations"), F.col("c_custkey")
    note = F.when(k % 3 > 0, F.concat(F.lit("\nNote"), k, F.lit(" = "), "c_mktsegment")).otherwise(F.lit(""))
    read(spark, d, "customer").select((k % 16).alias("part"), F.concat(F.lit("Pit"), k, F.lit(" (id) = P"), k, F.lit(" ; first\nPit"), k, F.lit(" (id) = P"), k, note).alias("value")).write.partitionBy("part").text(path)
    found = texts.scan_annotations(spark, path)
    of = F.regexp_extract("key", "([0-9]+)$", 1).cast("long")
    return found.groupBy(of.alias("file")).agg(F.max(F.when(F.col("key").startswith("pit"), F.col("value"))).alias("pit"), F.max(F.when(F.col("key").startswith("note"), F.col("value"))).alias("note"))
