"""Approximate nearest neighbours by cosine: a forest of random-projection trees.

The trees are fitted on a bounded sample and kept on the driver; every vector is put into a
leaf of each tree. A query goes down all trees with one shared priority queue, nearest to a
splitting plane first, and so visits its most promising leaves of any tree. Candidates of the
visited leaves are ranked by their exact cosine. Equal vectors are held once, with their
smallest ids.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.shared import cut

#: Vectors that the trees are fitted on, at most; more vectors make leaves larger, which are
#: then searched in chunks of about CHUNK rows.
SAMPLE = 20_000
TREES, LEAF, CHUNK = 10, 128, 4096
#: Leaves are visited until they hold this part of the sample's rows, one row counted for each
#: tree: about 0.6 of distinct rows. Directions without structure need that for a recall of 0.9;
#: clustered ones do with far less.
VISIT = 0.9
LEAST_VISIT = 2000
SEED = 71


@dataclass
class Forest:
    """Nodes of all trees in arrays: a direction and a threshold, children, or a leaf number."""

    roots: list[int]
    planes: np.ndarray
    offsets: np.ndarray
    children: np.ndarray
    sizes: np.ndarray
    visit: float

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """Leaf node of each row in each tree."""
        out = np.empty((len(x), len(self.roots)), np.int32)
        for t, root in enumerate(self.roots):
            at = np.full(len(x), root)
            while True:
                inner = np.flatnonzero(self.children[at, 0] >= 0)
                if not len(inner):
                    break
                node = at[inner]
                side = (np.einsum("ij,ij->i", x[inner], self.planes[node]) > self.offsets[node]).astype(int)
                at[inner] = self.children[node, side]
            out[:, t] = at
        return out

    def search(self, q: np.ndarray) -> list[int]:
        """Leaves in order of promise until enough rows are in sight."""
        margins = self.planes @ q - self.offsets
        queue = [(-np.inf, r) for r in self.roots]
        out, seen = [], 0.0
        while queue and seen < self.visit:
            cost, node = heapq.heappop(queue)
            while self.children[node, 0] >= 0:
                m = margins[node]
                heapq.heappush(queue, (max(cost, abs(m)), int(self.children[node, int(m <= 0)])))
                node = int(self.children[node, int(m > 0)])
            out.append(node)
            seen += self.sizes[node]
        return out


def plant(x: np.ndarray) -> Forest:
    """A forest on the rows of ``x``, which have length 1."""
    rng = np.random.default_rng(SEED)
    planes, offsets, children, sizes, roots = [], [], [], [], []

    def node(size: int) -> int:
        planes.append(np.zeros(x.shape[1]))
        offsets.append(0.0)
        children.append([-1, -1])
        sizes.append(size)
        return len(sizes) - 1

    for _ in range(TREES):
        roots.append(node(len(x)))
        todo = [(roots[-1], np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if len(rows) <= LEAF:
                continue
            plane = rng.standard_normal(x.shape[1])
            along = x[rows] @ plane
            middle = float(np.median(along))
            right = along > middle
            if not right.any() or right.all():
                continue
            planes[at], offsets[at] = plane, middle
            for side, part in enumerate((rows[~right], rows[right])):
                children[at][side] = node(len(part))
                todo.append((children[at][side], part))
    size = max(LEAST_VISIT, VISIT * len(x))
    return Forest(roots, np.array(planes), np.array(offsets), np.array(children), np.array(sizes, float), size)


def usable(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """id and v of the rows that take part; -0 and 0 are one."""
    v = F.transform(F.col(vector), lambda x: x.cast("double") + F.lit(0.0))
    fine = ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    return vectors.select(F.col(key).cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.coalesce(fine, F.lit(False)))


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def rank_leaf(rows: pd.DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """The k + 1 nearest distinct vectors of one chunk of a leaf for each query that visits it."""
    if rows.empty or queries.empty:
        return pd.DataFrame({"query": pd.Series(dtype="int64"), "rep": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
    x, q = np.stack(rows["v"].to_numpy()).astype(float), np.stack(queries["v"].to_numpy()).astype(float)
    rep, most = rows["rep"].to_numpy(), min(k + 1, len(x))
    near = unit(q) @ unit(x).T
    bound = np.partition(near, -most, axis=1)[:, -most]
    i, j = np.nonzero(near >= bound[:, None] - 1e-9)
    exact = (x[j] * q[i]).sum(1) / (np.sqrt((x * x).sum(1))[j] * np.sqrt((q * q).sum(1))[i])
    order = np.lexsort((rep[j], -exact, i))
    i, j, exact = i[order], j[order], exact[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    i, j, exact = i[place < most], j[place < most], exact[place < most]
    return pd.DataFrame({"query": queries["query"].to_numpy()[i], "rep": rep[j], "score": exact})


def nearest(vectors: DataFrame, k: int = 5, every: int = 50, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` nearest vectors found of each whose id is divisible by ``every``.

    Returns query_id, rank from 1, vec_id, score; ties go to the smaller id. Vectors that are
    null, all zero, or hold null or non-finite components take no part, nor do rows without an
    id; vectors of another length than a query's are no candidates. Fewer candidates than ``k``
    give fewer rows, an empty table none. Equal vectors count each for itself.
    """
    spark = vectors.sparkSession
    rows = usable(vectors, key, vector)
    by_vector = Window.partitionBy("v").orderBy("id")
    few = rows.withColumn("n", F.row_number().over(by_vector)).filter(F.col("n") <= k + 1)
    index = cut(few.groupBy("v").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(F.col("ids")[0].alias("rep"), "v", "ids", F.size("v").alias("dim")))
    asked = rows.filter(F.col("id") % every == 0)
    asked = cut(asked.select(F.col("id").alias("query_id"), "v", F.min("id").over(Window.partitionBy("v")).alias("query")))
    forests: dict[int, Forest] = {}
    counts = {r["dim"]: r["count"] for r in index.groupBy("dim").count().orderBy(F.desc("count")).limit(16).collect()}
    for dim, n in counts.items():
        pick = index.filter(F.col("dim") == dim)
        if n > SAMPLE:
            pick = pick.filter(F.pmod(F.xxhash64("rep"), F.lit(1 << 30)) < int((1 << 30) * SAMPLE / n))
        sample = pick.select("v").limit(SAMPLE * 2).toPandas()["v"]
        forests[dim] = plant(unit(np.stack(sample.to_numpy()).astype(float)))
    chunks = {d: max(1, -(-n * LEAF // (min(n, SAMPLE) * CHUNK))) for d, n in counts.items()}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reps, vs = b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False)
            dims = np.array([len(v) for v in vs], int)
            for dim in np.unique(dims).tolist():
                at = np.flatnonzero(dims == dim)
                f = forests.get(dim)
                leaves = f.leaves(unit(np.stack(vs[at]))) if f else np.zeros((len(at), 1), np.int32)
                for t in range(leaves.shape[1]):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(at), dim, np.int32)), pa.array(leaves[:, t]), pa.array([reps[i] % chunks.get(dim, 1) for i in at], pa.int32()), pa.array([reps[i] for i in at], pa.int64()), pa.array([vs[i] for i in at], pa.list_(pa.float64()))],
                        names=["dim", "leaf", "chunk", "rep", "v"],
                    )

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for query, v in zip(b.column(0).to_pylist(), b.column(1).to_numpy(zero_copy_only=False), strict=True):
                f = forests.get(len(v))
                for leaf in f.search(unit(v[None])[0]) if f else [0]:
                    for chunk in range(chunks.get(len(v), 1)):
                        for c, x in zip(out, (len(v), leaf, chunk, query, v), strict=True):
                            c.append(x)
            types = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["dim", "leaf", "chunk", "query", "v"])

    placed = index.select("rep", "v").mapInArrow(place, "dim int, leaf int, chunk int, rep long, v array<double>")
    visits = asked.filter("query_id = query").select("query", "v").mapInArrow(visit, "dim int, leaf int, chunk int, query long, v array<double>")
    group = ("dim", "leaf", "chunk")
    found = placed.groupBy(*group).cogroup(visits.groupBy(*group)).applyInPandas(lambda a, b: rank_leaf(a, b, k), "query long, rep long, score double")
    found = found.groupBy("query", "rep").agg(F.max("score").alias("score"))
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "rep"))).filter(F.col("n") <= k + 1).join(index.select("rep", "ids"), "rep")
    pairs = asked.select("query_id", "query").join(best, "query").select("query_id", F.explode("ids").alias("vec_id"), "score").filter("query_id != vec_id")
    ranked = pairs.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
