"""Conversation prefix trie by collapsing whole sequences.

Every rebuilt conversation is walked once; a node is the digest of its prefix (chained over turns).
Equal rebuilt conversations are one weighted sequence with the digest of its end list, and only one
walk of each distinct sequence goes on. Sequences that begin another one are told from leaves by
an anti join with the inner nodes; members, leaves and savings are sums over weighted prefixes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.shared import Scratch, crc32_sql, small_batches, whole_text

FAMILY, MOST_KEPT = 20, 4
ROOT = bytes(16)
NO_ENDS = hashlib.sha256(b"").hexdigest()


def kept_turns(conv_id: Column) -> Column:
    """How many first turns of its family's first conversation a conversation takes."""
    return F.crc32(conv_id.cast("string")) % MOST_KEPT


def rebuild(conversations: DataFrame, scratch: Scratch) -> DataFrame:
    """Turns of the rebuilt conversations: conv_id, part, i, role, text, to be read in that order.
    Part -1 is one row for each conversation, turns or not. A family's first conversation gives
    at most three turns to at most 39 others."""
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), whole_text("role").alias("role"), whole_text().alias("text"))
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))).drop("turn")
    rows = scratch.write(rows, "turns")
    convs = rows.filter("i = 1").select("conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), kept_turns(F.col("conv_id")).alias("kept"))
    given = rows.filter(f"i < {MOST_KEPT} and conv_id % {FAMILY} = 0").withColumnRenamed("conv_id", "family")
    given = convs.join(given, "family").filter("i <= kept").select("conv_id", F.lit(0).alias("part"), "i", "role", "text")
    own = rows.filter(F.col("i") > kept_turns(F.col("conv_id"))).select("conv_id", F.lit(1).alias("part"), "i", "role", "text")
    none = F.lit(None).cast("string")
    heads = convs.select("conv_id", F.lit(-1).alias("part"), F.lit(0).alias("i"), none.alias("role"), none.alias("text"))
    return heads.unionByName(given).unionByName(own)


WALK = "conv_id long, depth long, node binary, parent binary, words long, last boolean"


def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The prefixes of conversations whose turns come in order. Each step holds one turn."""
    held: tuple | None = None
    for b in batches:
        out = []
        cols = [b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(3).cast(pa.binary()).to_pylist(), b.column(4).cast(pa.binary()).to_pylist()]
        for conv_id, part, role, text in zip(*cols, strict=True):
            if part < 0:
                if held:
                    out.append((*held, True))
                held = (conv_id, 0, ROOT, None, 0)
            else:
                out.append((*held, False))
                h = hashlib.blake2b(held[2], digest_size=16)
                h.update(len(role).to_bytes(8, "little"))
                h.update(role)
                h.update(text)
                held = (conv_id, held[1] + 1, h.digest(), held[2], len(text.split()))
        yield walked(out)
    yield walked([(*held, True)] if held else [])


def walked(rows: list[tuple]) -> pa.RecordBatch:
    names = ["conv_id", "depth", "node", "parent", "words", "last"]
    types = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.bool_()]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


ENDS = "node binary, first_conv long, weight long, ends_sha256 string"


def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ends sorted by node and conv_id, as one row a node: least conv_id, number, digest of the list."""
    node, first, n, h = None, 0, 0, hashlib.sha256()

    def made(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.binary(), pa.int64(), pa.int64(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=["node", "first_conv", "weight", "ends_sha256"])

    for b in batches:
        out = []
        for x, conv_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if x != node:
                if n:
                    out.append((node, first, n, h.hexdigest()))
                node, first, n, h = x, conv_id, 0, hashlib.sha256()
            h.update(f",{conv_id}".encode() if n else str(conv_id).encode())
            n += 1
        yield made(out)
    yield made([(node, first, n, h.hexdigest())] if n else [])


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of rebuilt conversations, one row each.

    Turns go by turn (null first), ties by role and text in byte order; equal rows are turns one
    after the other. Null role and text are empty. Rows without a conv_id belong to no conversation
    and take no part. A conversation without turns after rebuilding ends at the root; an empty
    table has no nodes. Other columns are ignored. The chain of digests along one conversation and
    the hash of one end list are sequential: one task each, which holds one turn or one id.
    Everything else is a partial aggregate or a join by node.
    """
    spark = conversations.sparkSession
    scratch = Scratch(spark)
    small_batches(spark)
    turns = rebuild(conversations, scratch).repartition("conv_id").sortWithinPartitions("conv_id", "part", "i")
    steps = scratch.write(turns.mapInArrow(walk, WALK), "steps")
    scratch.drop("turns")
    ends = steps.filter("last").select("node", "conv_id").repartition("node").sortWithinPartitions("node", "conv_id")
    ends = scratch.write(ends.mapInArrow(collapse, ENDS), "ends")
    # one walk for each distinct sequence, with its weight
    sequences = ends.select(F.col("node").alias("sequence"), F.col("first_conv").alias("conv_id"), "weight")
    chosen = steps.join(sequences, "conv_id").select("sequence", F.col("conv_id").alias("first_conv"), "weight", "depth", "node", "parent", "words")
    inner = chosen.filter("parent is not null").select(F.col("parent").alias("sequence")).distinct()
    leaves = sequences.join(inner, "sequence", "left_anti").select("sequence", F.lit(1).alias("leaf"))
    paths = scratch.write(chosen.join(leaves, "sequence", "left").withColumn("leaf", F.coalesce("leaf", F.lit(0))), "paths")
    scratch.drop("steps")
    nodes = paths.groupBy("node").agg(
        F.first("depth").alias("depth"),
        F.first("parent").alias("parent"),
        F.first("words").alias("words"),
        F.sum("weight").alias("n_convs"),
        F.min("first_conv").alias("conv_id"),
        F.sum("leaf").cast("long").alias("n_leaves"),
    )
    nodes = scratch.write(nodes, "nodes")
    # each node's own saving stands on the path of the sequence of its least member, once
    own = F.when(F.col("first_conv") == F.col("conv_id"), (F.col("n_convs") - 1) * F.col("words")).otherwise(0)
    below = Window.partitionBy("sequence").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    saved = paths.select("sequence", "first_conv", "depth", "node").join(nodes.select("node", "conv_id", "n_convs", "words"), "node")
    saved = saved.select("sequence", "depth", "node", own.alias("own")).withColumn("below", F.sum("own").over(below))
    saved = saved.groupBy("node").agg(F.sum("below").alias("saved_tokens"))
    children = nodes.filter("parent is not null").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    above = nodes.select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(saved, "node").join(children, "node", "left").join(ends.select("node", "ends_sha256"), "node", "left").join(above, "parent", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
        "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(NO_ENDS)).alias("ends_sha256"),
    )


def sql() -> str:
    """DuckDB SQL for trie(): prefixes as lists of turns."""
    return rf"""
WITH rows AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS i FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % {FAMILY} AS family, ({crc32_sql("conv_id::VARCHAR")} % {MOST_KEPT})::BIGINT AS kept FROM rows
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, r.i, r.role, r.text FROM convs c JOIN rows r ON r.conv_id = c.family AND r.i <= c.kept
  UNION ALL SELECT r.conv_id, 1, r.i, r.role, r.text FROM rows r JOIN convs c ON c.conv_id = r.conv_id AND r.i > c.kept
), whole AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY part, i) FILTER (role IS NOT NULL), []) AS turns
  FROM convs c LEFT JOIN rebuilt b ON b.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, len(turns) AS n, d::BIGINT AS depth, turns[1:d] AS key FROM whole, unnest(range(len(turns) + 1)) t(d)
), nodes AS (
  SELECT depth, key, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(key[-1].text, '[^\x20\x09-\x0D]+')) END AS own
  FROM prefixes GROUP BY depth, key
), family AS (
  SELECT n.depth, n.key, n.conv_id, n.n_convs, n.ends_sha256, p.conv_id AS parent_conv_id,
    (SELECT count(*) FROM nodes k WHERE k.depth = n.depth + 1 AND k.key[1:n.depth] = n.key) AS n_children
  FROM nodes n LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.key = n.key[1:n.depth - 1]
)
SELECT f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, count(*) FILTER (b.n_children = 0) AS n_leaves,
  sum(n.own)::BIGINT AS saved_tokens, f.ends_sha256
FROM family f JOIN family b ON b.depth >= f.depth AND b.key[1:f.depth] = f.key JOIN nodes n ON n.depth = b.depth AND n.key = b.key
GROUP BY f.conv_id, f.depth, f.parent_conv_id, f.n_convs, f.n_children, f.ends_sha256, f.key"""
