"""Windows of documents that occur more than once, found by super-k-mers.

The minimiser of a window is the least hash of the grams inside it. Consecutive windows of one
minimiser make a run (a super-k-mer), which stands for all of them. Equal windows have equal
minimisers, so only runs of a minimiser that occurs more than once matter:

* If all runs of a minimiser are the same string, by a digest of 128 bits, they are copies of
  each other, window by window, and nothing more has to travel.
* Otherwise the bucket is contested: its strings travel to it, packed, each distinct one is
  kept once with the number and the first of its occurrences, and there windows are compared
  as bytes.

A bucket with very many distinct strings is dealt out further, by single windows, so that a
task holds no unbounded one. Rows are written once with their number, which then is the same
whoever reads them again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm import tokens
from cellframe.llm.shared import Scratch, small_batches, whole_text

#: Distinct strings of a minimiser above which its windows are dealt out one by one.
CROWDED = 4000
#: Windows of a run at most; a longer one goes on as another run of its minimiser.
LONGEST = 4096
#: Bytes of packed strings that a task compares at once; only whole buckets are.
TOGETHER = 1 << 20


@dataclass(frozen=True)
class Kind:
    """Windows of ``size`` tokens (bytes or words) and grams of ``gram`` tokens."""

    size: int
    gram: int
    by_word: bool

    @property
    def width(self) -> int:
        return self.size - self.gram + 1

    def spell(self, raw: bytes, split: list[bytes] | None, start: int, n: int) -> bytes:
        """The string of ``n`` windows: bytes, or words joined by one space."""
        end = start + n + self.size - 1
        return b" ".join(split[start:end]) if self.by_word else raw[start:end]


def runs(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (row, doc_id, raw) to (h, f, g, row, doc_id, start, n, own): minimiser, digest in two
    halves, whose run it is, its first window and how many it has."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row, doc = np.asarray(b.column(0)), b.column(1)
            for first, raw, offsets in tokens.chunks(b.column(2)):
                t, at = tokens.words(raw, offsets) if kind.by_word else (raw.astype(tokens.U) + tokens.U(1), offsets)
                if len(t) < kind.size:
                    continue
                grams = tokens.Prefix(t, tokens.BASES[1])
                i = np.arange(len(t) - kind.gram + 1)
                grams = grams.of(i, i + kind.gram)
                least = tokens.sliding_min(grams, kind.width)
                text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                window = np.flatnonzero(np.arange(len(t)) + kind.size <= at[text + 1])
                if not len(window):
                    continue
                h = least[window]
                new = np.ones(len(window), bool)
                new[1:] = (h[1:] != h[:-1]) | (np.diff(window) != 1) | (text[window[1:]] != text[window[:-1]])
                i = np.arange(len(window))
                new |= (i - np.maximum.accumulate(np.where(new, i, 0))) % LONGEST == 0
                begin = np.flatnonzero(new)
                start, n = window[begin], np.diff(np.append(begin, len(window)))
                if kind.by_word:
                    other, _ = tokens.words(raw, offsets, seed=1)
                    digest = [tokens.runs_of(t, start, n + kind.size - 1), tokens.runs_of(other, start, n + kind.size - 1, 1)]
                else:
                    digest = [tokens.span_hashes(raw, start, start + n + kind.size - 1, seed) for seed in (0, 1)]
                whose = text[start]
                # does the minimiser stand twice in a run? Then its windows may repeat within it
                wide = n + kind.width - 1
                to = np.cumsum(wide)
                inside = np.arange(to[-1]) - np.repeat(to - wide - start, wide)
                own = np.add.reduceat((grams[inside] == np.repeat(h[begin], wide)).astype(np.int32), to - wide) > 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[begin].view(np.int64)), *(pa.array(x.view(np.int64)) for x in digest), pa.array(row[first + whose]), doc.take(pa.array(first + whose)), pa.array((start - at[whose]).astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(own)],
                    names=["h", "f", "g", "row", "doc_id", "start", "n", "own"],
                )

    return of


def extract(kind: Kind) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """From (row, doc_id, raw, wanted) to (h, s, row, doc_id, start, n)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
        for b in batches:
            out: list[list] = [[] for _ in types]
            for row, doc, raw, wanted in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                if wanted:
                    split = raw.split() if kind.by_word else None
                    for w in wanted:
                        for c, v in zip(out, (w["h"], kind.spell(raw, split, w["start"], w["n"]), row, doc, w["start"], w["n"]), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["h", "s", "row", "doc_id", "start", "n"])

    return of


@dataclass
class Strings:
    """Distinct strings of whole buckets, with how often and where first each occurs."""

    h: np.ndarray
    text: list[bytes]
    n: np.ndarray
    times: np.ndarray
    known: np.ndarray
    doc: np.ndarray
    row: np.ndarray
    start: np.ndarray


def buckets(compare: Callable[[Strings], tuple[np.ndarray, np.ndarray, np.ndarray]]):
    """From (string, h, s, n, times, known, doc_id, row, start) in order of h to (string, at, len).

    ``compare`` gets buckets of two strings and more, or of one that may repeat in itself, and
    says which windows are to go: string, first window, number.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[tuple] = []
        size = 0

        def go(rows: list[tuple]) -> Iterator[pa.RecordBatch]:
            if rows:
                string, h, s, *rest = zip(*rows, strict=True)
                which, at, many = compare(Strings(np.array(h), list(s), *(np.array(x, np.int64) for x in rest)))
                yield pa.RecordBatch.from_arrays([pa.array(np.array(string)[which]), pa.array(at.astype(np.int32)), pa.array(many.astype(np.int32))], names=["string", "at", "len"])

        for b in batches:
            for r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= TOGETHER and r[1] != kept[-1][1]:
                    yield from go(kept)
                    kept, size = [], 0
                kept.append(r)
                size += len(r[2])
        yield from go(kept)

    return of


def stretches(flag: np.ndarray, string: np.ndarray, window: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Flagged windows, ordered by string and window, as stretches: string, first, number."""
    string, window = string[flag], window[flag]
    if not len(string):
        return string, window, window
    new = np.ones(len(string), bool)
    new[1:] = (string[1:] != string[:-1]) | (window[1:] != window[:-1] + 1)
    begin = np.flatnonzero(new)
    return string[begin], window[begin], np.diff(np.append(begin, len(string)))


def numbered(docs: DataFrame, text: str, key: str, scratch: Scratch) -> DataFrame:
    """row, doc_id, raw, written once: rows are told apart by their number, so that equal ones are two."""
    small_batches(docs.sparkSession)
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), whole_text(text).cast("binary").alias("raw")), "rows")


def place() -> Column:
    """Order of occurrences: a null doc_id is least."""
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "row", "start")


def repeated(
    docs: DataFrame,
    kind: Kind,
    compare: Callable[[Strings], tuple[np.ndarray, np.ndarray, np.ndarray]],
    spare_first: bool,
    scratch: Scratch,
) -> DataFrame:
    """Windows to remove, as (row, at, len): first window and number of windows.

    ``docs`` is numbered(). ``spare_first``: of equal windows the first stays, in order
    of doc_id, row and place; otherwise none does.
    """
    spark = docs.sparkSession
    found = docs.mapInArrow(runs(kind), "h long, f long, g long, row long, doc_id long, start int, n int, own boolean")
    by_h = Window.partitionBy("h")
    differ = (F.min("f").over(by_h) != F.max("f").over(by_h)) | (F.min("g").over(by_h) != F.max("g").over(by_h))
    found = found.select("*", F.count("*").over(by_h).alias("times"), (differ | F.bool_or("own").over(by_h)).alias("contested"))
    found = found.filter("times > 1 or contested")
    found = scratch.write(found.select("h", "row", "doc_id", "start", "n", "contested"), "runs")

    plain = found.filter("not contested")
    if spare_first:
        # partial minima first: copies may be many
        first = plain.groupBy("h").agg(F.min(place()).alias("first"))
        plain = plain.join(first, "h").filter(~F.col("first").eqNullSafe(place()))
    gone = plain.select("row", F.col("start").alias("at"), F.col("n").alias("len"))

    contested = found.filter("contested")
    wanted = contested.groupBy("row").agg(F.collect_list(F.struct("h", "start", "n")).alias("wanted"))
    with_wanted = docs.join(wanted.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "raw", "wanted").filter("wanted is not null")
    packed = with_wanted.mapInArrow(extract(kind), "h long, s binary, row long, doc_id long, start int, n int")
    packed = scratch.write(packed, "packed")
    strings = packed.groupBy("h", "s").agg(F.first("n").alias("n"), F.count("*").alias("times"), F.min(place()).alias("first"))
    strings = scratch.write(strings.select(F.monotonically_increasing_id().alias("string"), "h", "s", "n", "times", "first"), "strings")
    seen = scratch.write(packed.join(strings.select("string", "h", "s", "times", "first"), ["h", "s"]).select("string", "times", "first", "row", "doc_id", "start", "n"), "seen")
    scratch.drop("packed")
    crowded = scratch.write(strings.groupBy("h").count().filter(F.col("count") > CROWDED).select("h"), "crowded")
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = ["string", "h", "s", "n", "times", F.col("first.known").cast("long").alias("known"), F.coalesce("first.doc_id", F.lit(0)).alias("doc_id"), "first.row", "first.start"]
    calm = strings.join(crowded, "h", "left_anti").repartition(partitions, "h").sortWithinPartitions("h")
    flags = calm.select(*flat).mapInArrow(buckets(compare), "string long, at int, len int")
    if not crowded.isEmpty():
        flags = flags.unionByName(window_by_window(strings.join(crowded, "h", "left_semi").select(*flat), kind, spare_first))
    flags = flags.groupBy("string").agg(F.collect_list(F.struct("at", "len")).alias("flags"))
    whole = ~F.col("first").eqNullSafe(place()) if spare_first else (F.col("times") > 1)
    gone = gone.unionByName(seen.filter(whole).select("row", F.col("start").alias("at"), F.col("n").alias("len")))
    part = seen.filter(~whole).join(flags, "string").select("row", "start", F.explode("flags").alias("x"))
    return gone.unionByName(part.select("row", (F.col("start") + F.col("x.at")).alias("at"), F.col("x.len").alias("len")))


def window_by_window(strings: DataFrame, kind: Kind, spare_first: bool) -> DataFrame:
    """What buckets() finds, for crowded buckets: each window is a string of its own and goes
    to its own group, in which windows are compared as bytes."""

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32())
        for b in batches:
            out: list[list] = [[] for _ in types]
            for string, _, s, n, times, known, doc, row, start in zip(*(c.to_pylist() for c in b.columns), strict=True):
                split = s.split() if kind.by_word else None
                for i in range(n):
                    for c, v in zip(out, (string, kind.spell(s, split, i, 1), i, times, known, doc, row, start + i), strict=True):
                        c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names=["string", "w", "at", "times", "known", "doc_id", "row", "start"])

    each = strings.mapInArrow(one, "string long, w binary, at int, times long, known long, doc_id long, row long, start int")
    spot = F.struct("known", "doc_id", "row", "start")
    groups = each.groupBy("w").agg(F.sum("times").alias("all"), F.min(spot).alias("first"))
    each = each.join(groups.filter("all > 1"), "w")
    if spare_first:
        each = each.filter(F.col("first") != spot)
    return each.select("string", "at", F.lit(1).alias("len"))


def with_gone(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """``docs`` (row, doc_id, raw) with its stretches of windows to remove."""
    by_row = gone.groupBy("row").agg(F.collect_list(F.struct("at", "len")).alias("gone"))
    return docs.join(by_row.hint("shuffle_hash"), "row", "left").select("row", "doc_id", "raw", "gone")


def covered(n: int, gone: list[dict] | None, size: int) -> np.ndarray:
    """Which of ``n`` tokens a removed window covers."""
    edge = np.zeros(n + 1, np.int64)
    if gone:
        at = np.array([g["at"] for g in gone])
        to = at + np.array([g["len"] for g in gone]) + size - 1
        np.add.at(edge, at, 1)
        np.add.at(edge, to, -1)
    return np.cumsum(edge[:-1]) > 0
