"""Connected components of links between numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.shared import cut


#: Links that a task holds at once.
TOGETHER = 1 << 20


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join the same numbers as (a, b): the least of each component with each other."""
    ids, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    label = np.arange(len(ids))
    while True:
        low, high = np.minimum(label[x], label[y]), np.maximum(label[x], label[y])
        if (low == high).all():
            break
        np.minimum.at(label, high, low)
        while (label[label] != label).any():
            label = label[label]
    other = np.flatnonzero(label != np.arange(len(ids)))
    return ids[label[other]], ids[other]


def thinned(links: DataFrame) -> DataFrame:
    """``links`` with those left out that others of the same task already imply."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def go() -> pa.RecordBatch:
            a, b = spanning(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1))))
            if sum(len(x[0]) for x in held) >= TOGETHER:
                yield go()
        if held:
            yield go()

    return links.mapInArrow(of, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """v, label: each linked number with the least number that links lead to.

    ``links`` is (a, b). A round moves each number into that one of itself and its neighbours
    which comes first in an order of the round's own; links between what is left are the next
    round's. The order is a hash in every second round: whatever the links' shape and the
    numbers' order, such a round leaves in expectation a fixed part of the numbers at most, so
    rounds grow with the logarithm of the largest component and all of them together with the
    links. In the others it is the number itself, which ends stars at once; links are thinned to
    stars inside each task before a round. The number that is last in the order never stays, so
    rounds end without a cap. Then labels go back from the last round to the first. Each round
    is cut off in the shared folder.
    """
    left = ready(links)
    rounds: list[DataFrame] = []
    while not left.isEmpty():
        into = cut(first_in_reach(left, len(rounds)))
        rounds.append(into)
        moved = left.join(into.select(F.col("v").alias("a"), F.col("into").alias("x")), "a")
        moved = moved.join(into.select(F.col("v").alias("b"), F.col("into").alias("y")), "b")
        left = ready(moved.select(F.col("x").alias("a"), F.col("y").alias("b")))
    if not rounds:
        return left.select(F.col("a").alias("v"), F.col("b").alias("label"))
    end = rounds.pop()
    while rounds:
        later = end.select(F.col("v").alias("into"), F.col("into").alias("end"))
        end = cut(rounds.pop().join(later, "into", "left").select("v", F.coalesce("end", "into").alias("into")))
    least = end.groupBy("into").agg(F.min("v").alias("label"))
    return cut(end.join(least, "into").select("v", "label"))


def ready(links: DataFrame) -> DataFrame:
    once = links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a != b").distinct()
    return cut(thinned(once).distinct())


def first_in_reach(links: DataFrame, turn: int) -> DataFrame:
    """v, into: the first of each number and its neighbours, in the order of round ``turn``."""

    def place(number: str) -> Column:
        # a one-to-one map of 64 bits, so there are no ties
        return F.xxhash64(F.lit(turn), number) if turn % 2 else F.col(number)

    both = links.select("a", "b").union(links.select("b", "a"))
    near = both.groupBy("a").agg(F.min(place("b")).alias("first"), F.min_by("b", place("b")).alias("into"))
    return near.select(F.col("a").alias("v"), F.when(place("a") < F.col("first"), F.col("a")).otherwise(F.col("into")).alias("into"))
