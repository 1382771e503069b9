"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Statistics of a text are standardised and mapped to cosines of random projections, whose inner
products approximate a Gaussian kernel. Ridge scores come from normal equations that each
partition sums for itself. Isotonic regression on other labelled rows turns scores into
probabilities.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.llm.shared import append_columns, cut, small_batches

#: Labelled rows that a fit uses at most (a hash of doc_id picks them if there are more).
MAX_LABELLED = 200_000
COSINES, WIDTH, RIDGE, SEED = 192, 6.0, 1e-2, 29
#: Steps of a raw score that calibration tells apart.
BINS = 2048
PARTITIONS = 32
THRESHOLD = 0.3

KIND = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 stop, 6 symbol, 7 other byte
for _kind, _chars in (
    (1, bytes(range(65, 91))),
    (2, bytes(range(97, 123))),
    (3, b"0123456789"),
    (4, b" \t\n\r\v\f"),
    (5, b".,;:?'\"()-"),
    (6, b"!#$%&*+/<=>@[\\]^_`{|}~"),
    (7, bytes(range(128, 256))),
):
    KIND[list(_chars)] = _kind
N_STATS = 24


def stats(text: str) -> list[float]:
    """Statistics of one text; those of an empty text are all 0."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = len(raw)
    if not n:
        return [0.0] * N_STATS
    counts = np.bincount(raw, minlength=256)
    kinds = KIND[raw]
    by_kind = np.bincount(kinds, minlength=8) / n
    words, lines = text.split(), text.split("\n")
    many = Counter(words)
    w = max(1, len(words))
    p = counts[counts > 0] / n
    space = kinds == 4
    ends = np.bincount(kinds[:-1][space[1:]], minlength=8) / w
    starts = np.bincount(kinds[1:][space[:-1]], minlength=8) / w
    same = np.count_nonzero(raw[1:] == raw[:-1]) / n
    top = many.most_common(1)[0][1] if many else 0
    return [
        math.log1p(n), math.log1p(len(words)), (1 - by_kind[4]) * n / w, *by_kind[1:8],
        counts[33] / n, counts[124] / n, counts[10] / n, ends[6], ends[5], starts[1], starts[6] + starts[3],
        len(many) / w, top / w, len(set(lines)) / len(lines), math.log1p(n / len(lines)),
        float(-(p * np.log(p)).sum()), same, math.log1p(max(map(len, words), default=0)),
    ]


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learnt from."""
    return F.coalesce(remainder(doc_id) == 0, F.lit(False))


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    ridge: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def raw(self, x: np.ndarray) -> np.ndarray:
        return cosines(x, self.mean, self.scale) @ self.ridge

    def scores(self, x: np.ndarray) -> np.ndarray:
        raw = self.raw(x)
        # a small part of the raw score keeps the order inside the flat pieces
        return 0.999 * np.interp(raw, self.knots, self.values) + 0.001 * np.clip(raw, 0, 1)


def cosines(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    rng = np.random.default_rng(SEED)
    turn = rng.standard_normal((N_STATS, COSINES)) / WIDTH
    shift = rng.uniform(0, 2 * np.pi, COSINES)
    z = np.clip((x - mean) / scale, -8, 8)
    return np.hstack([np.cos(z @ turn + shift) * np.sqrt(2 / COSINES), np.ones((len(x), 1))])


def with_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    kind = T.ArrayType(T.DoubleType(), False)
    return append_columns(docs, [T.StructField("stats", kind, False)], lambda: lambda b: [[stats(t or "") for t in b.column(b.schema.get_field_index(text)).to_pylist()]])


def pool(knots: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Isotonic regression by pooling neighbours that decrease: places and values of the pools."""
    blocks: list[list[float]] = []
    for k, s, c in zip(knots, sums, counts, strict=True):
        blocks.append([k * c, s, c])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    b = np.array(blocks)
    return b[:, 0] / b[:, 2], b[:, 1] / b[:, 2]


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text") -> Model | None:
    """Learns from rows whose crc32(doc_id as text) mod 5 is not 0; those with remainder 1
    calibrate, the others fit. A document labelled more than once counts with its mean label;
    null labels and labels without a document don't count. None if there is nothing to learn."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg(F.col(label).cast("double")).alias("y"))
    there = known.count()
    if there > MAX_LABELLED:
        known = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int((1 << 30) * MAX_LABELLED * 0.98 / there))
    # at most MAX_LABELLED rows of two numbers
    rows = docs.select("doc_id", text).join(F.broadcast(known), "doc_id")
    rows = cut(with_stats(rows, text).select(remainder(F.col("doc_id")).alias("part"), "y", "stats"))
    moments = rows.filter("part > 1").select(*[F.col("stats")[i].alias(f"s{i}") for i in range(N_STATS)])
    got = moments.agg(*[f(f"s{i}") for f in (F.avg, F.stddev_pop) for i in range(N_STATS)]).first()
    if got is None or got[0] is None:
        return None
    mean = np.array(got[:N_STATS], float)
    scale = np.array([x if x and x > 1e-9 else 1.0 for x in got[N_STATS:]], float)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((COSINES + 1, COSINES + 2))
        for b in batches:
            if b.num_rows:
                z = cosines(np.stack(b.column(1).to_numpy(zero_copy_only=False)), mean, scale)
                total += z.T @ np.hstack([z, np.asarray(b.column(0))[:, None]])
        i, j = np.divmod(np.arange(total.size), COSINES + 2)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total.ravel())], names=["i", "j", "v"])

    sums = rows.filter("part > 1").select("y", "stats").coalesce(PARTITIONS).mapInArrow(normal, "i int, j int, v double")
    a = np.zeros((COSINES + 1, COSINES + 2))
    for i, j, v in sums.groupBy("i", "j").agg(F.sum("v")).collect():  # one row for each entry of the matrix
        a[i, j] = v
    ridge = np.linalg.solve(a[:, :-1] + RIDGE * np.eye(COSINES + 1), a[:, -1])
    model = Model(mean, scale, ridge, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    scored = append_columns(rows.filter("part = 1"), [T.StructField("raw", T.DoubleType(), False)], lambda: lambda b: [pa.array(model.raw(np.stack(b.column(2).to_numpy(zero_copy_only=False))) if b.num_rows else [], pa.float64())])
    step = F.round((F.least(F.greatest("raw", F.lit(-0.5)), F.lit(1.5)) + 0.5) * (BINS / 2)).cast("int").alias("step")
    bins = scored.groupBy(step).agg(F.sum("y").alias("y"), F.count("*").alias("n")).orderBy("step").collect()  # BINS rows at most
    if bins:
        k, y, n = (np.array(c, float) for c in zip(*bins, strict=True))
        model.knots, model.values = pool(k / (BINS / 2) - 0.5, y, n)
    return model


def score(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted``. Null texts count as empty and have a
    score too; equal texts have equal scores; without a model each score is 0.5."""

    def compute():
        def of(batch: pa.RecordBatch) -> list:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            if model is None or not texts:
                s = np.full(len(texts), 0.5)
            else:
                s = np.clip(model.scores(np.array([stats(t or "") for t in texts])), 0.0, 1.0)
            return [pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))]

        return of

    return append_columns(docs, [T.StructField("score", T.DoubleType(), False), T.StructField("predicted", T.IntegerType(), False)], compute)
