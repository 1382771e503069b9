"""Views of the given tables as layers, surveys, scenes and samples, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellframe.model import densify, shape_of

KINDS = ("click", "view", "purchase", "signup", "error")


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def g_events(spark: SparkSession, d: str) -> DataFrame:
    """A sparse layer: events in rows of 100, missing where they are errors."""
    e = read(spark, d, "events")
    v = F.when(F.col("event_type") != "error", F.col("value"))
    return e.select(F.lit("events").alias("layer"), F.floor(F.col("event_id") / 100).cast("int").alias("row"), (F.col("event_id") % 100).cast("int").alias("col"), v.alias("v"))


def g_orders(spark: SparkSession, d: str) -> DataFrame:
    """A layer without holes: order totals, as heights in metres."""
    o = read(spark, d, "orders")
    return o.select(F.lit("orders").alias("layer"), F.floor(F.col("o_orderkey") / 100).cast("int").alias("row"), (F.col("o_orderkey") % 100).cast("int").alias("col"), (F.col("o_totalprice") / 1000).alias("v"))


def g_emb(spark: SparkSession, d: str) -> DataFrame:
    """A signed layer: vectors as rows."""
    e = read(spark, d, "embeddings").select("vec_id", F.posexplode("embedding").alias("col", "v"))
    return e.select(F.lit("emb").alias("layer"), F.col("vec_id").cast("int").alias("row"), "col", F.col("v").cast("double").alias("v"))


def g_complex(spark: SparkSession, d: str) -> DataFrame:
    """Complex cells: components i and i + 32 of a vector."""
    e = read(spark, d, "embeddings").filter(F.size("embedding") == 64)
    pairs = F.arrays_zip(F.slice("embedding", 1, 32).alias("re"), F.slice("embedding", 33, 32).alias("im"))
    x = e.select("vec_id", F.posexplode(pairs).alias("col", "z"))
    return x.select(F.lit("z").alias("layer"), F.col("vec_id").cast("int").alias("row"), "col", F.col("z.re").cast("double").alias("re"), F.col("z.im").cast("double").alias("im"))


def dense(cells: DataFrame) -> DataFrame:
    return densify(cells, shape_of(cells))


def shaped(cells: DataFrame) -> DataFrame:
    return cells.join(shape_of(cells), "layer")


def channels(spark: SparkSession, d: str) -> DataFrame:
    """(scene, leaf, row, col, v): three kinds of events as channels on cells of five numbers."""
    e = read(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    leaf = F.when(F.col("event_type") == "click", "amp1").when(F.col("event_type") == "view", "amp2").otherwise("cor")
    k = F.floor(F.col("event_id") / 5)
    out = e.select((F.col("user_id") % 4).alias("scene"), leaf.alias("leaf"), F.floor(k / 20).cast("int").alias("row"), (k % 20).cast("int").alias("col"), "value")
    return out.groupBy("scene", "leaf", "row", "col").agg(F.max("value").alias("v"))


def box(x, y, w, h):
    p = lambda a, b: F.struct(a.cast("double").alias("x"), b.cast("double").alias("y"))
    return F.array(p(x, y), p(x + w, y), p(x + w, y + h), p(x, y + h))


def granules(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    begin = F.col("o_orderdate").cast("date")
    k = F.col("o_orderkey")
    return o.select(
        (F.col("o_custkey") % 8).alias("site"), k.alias("granule"), begin.alias("begin"), F.date_add(begin, (k % 3).cast("int")).alias("end"),
        box(k % 40, F.floor(k / 40) % 40, F.lit(3), F.lit(2)).alias("ring"),
    )


def products(spark: SparkSession, d: str) -> DataFrame:
    li = read(spark, d, "lineitem")
    day = F.col("l_shipdate").cast("date")
    p = li.groupBy("l_orderkey", "l_suppkey").agg(F.min(day).alias("ref"), F.max(day).alias("sec"), F.max("l_linenumber").alias("version"), F.sum("l_quantity").cast("long").alias("bytes"))
    k = F.col("l_orderkey") * 7 + F.col("l_suppkey")
    scene = F.concat(F.lit("UA_camp"), F.col("l_suppkey") % 5, F.lit("_"), F.col("l_orderkey"), F.lit("_"), F.lpad(F.col("version").cast("string"), 2, "0"))
    return p.select(
        (F.col("l_orderkey") % 8).alias("site"), scene.alias("scene"), "ref", "sec", "version", "bytes", F.concat_ws("-", "l_orderkey", "l_suppkey").alias("file_id"),
        F.when(F.col("l_suppkey") % 2 == 0, "AMPLITUDE_GRD").otherwise("INTERFEROMETRY_GRD").alias("level"), box(k % 40, F.floor(k / 40) % 40, F.lit(2), F.lit(3)).alias("ring"),
    )


def samples(spark: SparkSession, d: str) -> DataFrame:
    """Rows of items as samples of eight sites: target, features, block and scene."""
    li = read(spark, d, "lineitem").join(read(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey")).join(read(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select(
        (F.col("s_nationkey") % 8).alias("site"), F.col("l_suppkey").alias("scene"), (F.col("l_partkey") % 50).cast("int").alias("brow"), (F.col("l_orderkey") % 20).cast("int").alias("bcol"),
        F.col("l_extendedprice").alias("y"), F.col("l_quantity").alias("quantity"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("p_size").cast("double").alias("size"), F.col("p_retailprice").alias("retail"), F.col("l_orderkey").alias("order_key"), F.col("l_linenumber").alias("line"),
    )


# The same views as SQL, to begin a WITH list.
G_EVENTS = "g AS (SELECT 'events' AS layer, CAST(event_id // 100 AS INTEGER) AS row, CAST(event_id % 100 AS INTEGER) AS col, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)"
G_ORDERS = "g AS (SELECT 'orders' AS layer, CAST(o_orderkey // 100 AS INTEGER) AS row, CAST(o_orderkey % 100 AS INTEGER) AS col, o_totalprice / 1000 AS v FROM orders)"
G_EMB = "g AS (SELECT 'emb' AS layer, CAST(vec_id AS INTEGER) AS row, CAST(u - 1 AS INTEGER) AS col, CAST(embedding[u] AS DOUBLE) AS v FROM embeddings, (SELECT unnest(range(1, 65)) AS u))"
G_COMPLEX = "z AS (SELECT 'z' AS layer, CAST(vec_id AS INTEGER) AS row, CAST(u - 1 AS INTEGER) AS col, CAST(embedding[u] AS DOUBLE) AS re, CAST(embedding[u + 32] AS DOUBLE) AS im FROM embeddings, (SELECT unnest(range(1, 33)) AS u))"
SHAPE = "s AS (SELECT max(row) + 1 AS height, max(col) + 1 AS width FROM g)"
CHANNELS = """ch AS (SELECT user_id % 4 AS scene, CASE event_type WHEN 'click' THEN 'amp1' WHEN 'view' THEN 'amp2' ELSE 'cor' END AS leaf,
  CAST((event_id // 5) // 20 AS INTEGER) AS row, CAST((event_id // 5) % 20 AS INTEGER) AS col, max(value) AS v
  FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1, 2, 3, 4)"""
GRANULES = """gr AS (SELECT o_custkey % 8 AS site, o_orderkey AS granule, CAST(o_orderdate AS DATE) AS b, CAST(o_orderdate AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS e,
  o_orderkey % 40 AS x, (o_orderkey // 40) % 40 AS y FROM orders)"""
PRODUCTS = """pr AS (SELECT l_orderkey % 8 AS site, 'UA_camp' || (l_suppkey % 5) || '_' || l_orderkey || '_' || lpad(CAST(max(l_linenumber) AS VARCHAR), 2, '0') AS scene,
  min(CAST(l_shipdate AS DATE)) AS ref, max(CAST(l_shipdate AS DATE)) AS sec, max(l_linenumber) AS version, CAST(sum(l_quantity) AS BIGINT) AS bytes, l_orderkey || '-' || l_suppkey AS file_id,
  CASE WHEN l_suppkey % 2 = 0 THEN 'AMPLITUDE_GRD' ELSE 'INTERFEROMETRY_GRD' END AS level, (l_orderkey * 7 + l_suppkey) % 40 AS x, ((l_orderkey * 7 + l_suppkey) // 40) % 40 AS y
  FROM lineitem GROUP BY l_orderkey, l_suppkey)"""
SAMPLES = """sm AS (SELECT s_nationkey % 8 AS site, l_suppkey AS scene, CAST(l_partkey % 50 AS INTEGER) AS brow, CAST(l_orderkey % 20 AS INTEGER) AS bcol, l_extendedprice AS y,
  l_quantity AS quantity, l_discount AS discount, l_tax AS tax, CAST(p_size AS DOUBLE) AS size, p_retailprice AS retail, l_orderkey AS order_key, l_linenumber AS line
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey)"""
