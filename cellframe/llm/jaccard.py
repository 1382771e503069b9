"""N-gram Jaccard join by PartEnum signatures.

Sets whose similarity is at least the threshold differ in few elements, relative to their
sizes. Sizes are cut into bands such that similar sets lie in one band or in neighbouring
ones; within two neighbouring bands at most k elements differ. The domain of elements is dealt
into partitions of two parts each, more than k / 2 of them: some partition then holds at most one
difference, and one of its two parts is equal. Each part of each partition is a signature, so
sufficiently similar sets share one. A part without elements says nothing: the partitions are
so many more than needed as empty parts are to be expected (``slack``), and a set with more of
these than that is dealt out once again, with other hashes.

Copies are one set, signed once. Sets that share a signature are compared with the least of
them (the pivot), and not all with each other: see find_links().
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm import tokens
from cellframe.llm.groups import components
from cellframe.llm.shared import Scratch, free_name, small_batches, whole_text

LEVELS = 6
#: Rows of a pivot for each copy of what they are joined with.
PER_SALT = 2048
#: Parts in which pairs are compared, one after another: shuffles hold one part's texts at a time.
PARTS = 3
#: Sets of which elements are counted for the order in which sets far from pivots meet, and how many elements,
#: most frequent first, that count keeps. The order decides how many sets meet, never what links.
SEEN, OFTEN = 20_000, 1 << 18
U = np.uint64


@dataclass(frozen=True)
class Rule:
    """Sets of shingles of ``words`` words; links where over * intersection >= part * union,
    with ``over`` 100 and ``part`` a whole number of hundredths."""

    words: int
    part: int

    def bands(self, most: int) -> list[tuple[int, int]]:
        """Least and greatest size of each band; a greatest size's partners end one band on."""
        out, low = [], 1
        while low <= most:
            high = low * 100 // self.part
            out.append((low, high))
            low = high + 1
        return out

    def differences(self, high: int) -> int:
        """Elements in which similar sets differ at most if the smaller has up to ``high``."""
        return (100 - self.part) * (high + high * 100 // self.part) // (100 + self.part)

    def slack(self, low: int, k: int) -> int:
        """Partitions beyond those needed, for sets of ``low`` elements or more."""
        need = (k + 2) // 2
        empty = 2 * need * np.exp(-low / (2 * need))
        return 0 if k < 8 else 2 + int(np.ceil(1.3 * empty))

    def shared(self, size: int) -> int:
        """Elements that a set of ``size`` has in common with any set that it links with."""
        return -(-size * self.part // 100)


def sets_of(rule: Rule, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of some texts in order, and the offsets of each text's."""
    t, at = tokens.wide_words(raw, offsets, lower=True)
    many = np.diff(at)
    each = np.where(many >= rule.words, many - rule.words + 1, np.minimum(many, 1))
    text = np.repeat(np.arange(len(many)), each)
    start = np.arange(len(text)) - np.repeat(np.cumsum(each) - each, each) + at[text]
    size = np.minimum(rule.words, at[text + 1] - start)
    shingle = tokens.wide(tokens.runs_of(t, start, size), tokens.runs_of(t, start, size, 1))
    order = np.lexsort((shingle, text))
    text, shingle = text[order], shingle[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (shingle[1:] != shingle[:-1])
    text, shingle = text[new], shingle[new]
    return shingle, np.searchsorted(text, np.arange(len(many) + 1))


def describe(rule: Rule):
    """From (row, raw) to (row, n, d1, d2, outline): size of the set, a digest of it in two numbers, and outline()."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, raw, offsets in tokens.chunks(b.column(1)):
                shingle, at = sets_of(rule, raw, offsets)
                each = [shingle[x:y] for x, y in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                d = np.frombuffer(b"".join(hashlib.blake2b(x.tobytes(), digest_size=16).digest() for x in each), np.int64).reshape(-1, 2)
                columns = [b.column(0).slice(first, len(d)), pa.array(np.diff(at).astype(np.int64)), pa.array(d[:, 0]), pa.array(d[:, 1]), pa.array([outline(x) for x in each], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=["row", "n", "d1", "d2", "outline"])

    return of


def deal(rule: Rule, shingle: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of some distinct sets: set and signature.

    Distinct sets of a band in which nothing may differ can't link and get none.
    """
    size = np.diff(at)
    bands = rule.bands(int(size.max(initial=1)))
    lows = np.array([x[0] for x in bands])
    ks = np.array([rule.differences(x[1]) for x in bands])
    slacks = np.array([rule.slack(low, int(k)) for low, k in zip(lows, ks, strict=True)])
    band = np.searchsorted(lows, size, "right") - 1
    out_set, out_sig = [], []
    for back in (0, 1):
        who = np.flatnonzero((size > 0) & (band - back >= 0))
        who = who[ks[band[who] - back] > 0]
        for level in range(LEVELS):
            if not len(who):
                break
            instance = band[who] - back
            slack = slacks[instance]
            n = (ks[instance] + 2) // 2 + slack
            base = np.cumsum(2 * n) - 2 * n
            many = size[who]
            member = np.repeat(np.arange(len(who)), many)
            element = shingle[np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many) + np.repeat(at[who], many)]
            turn = tokens.mix((instance * 64 + level + 1).astype(U))
            h = tokens.mix(element ^ turn[member])
            cell = base[member] + (h % n[member].astype(U)).astype(np.int64) * 2 + (h >> U(63)).astype(np.int64)
            total = np.zeros(int(2 * n.sum()), U)
            np.add.at(total, cell, tokens.mix(h + U(1)))
            filled = np.bincount(cell, minlength=len(total)) > 0
            owner = np.repeat(np.arange(len(who)), 2 * n)
            place = np.arange(len(owner)) - base[owner]
            sig = tokens.mix(total + tokens.mix(turn[owner] + (place * 2).astype(U)))
            spoilt = ~filled[::2] | ~filled[1::2]
            again = np.bincount(owner[::2][spoilt], minlength=len(who)) > slack
            if level == LEVELS - 1:
                filled[:] = True
            out_set.append(who[owner[filled]])
            out_sig.append(sig[filled])
            who = who[again]
    return np.concatenate(out_set or [np.zeros(0, np.int64)]), np.concatenate(out_sig or [np.zeros(0, U)])


def signatures(rule: Rule):
    """From (row, raw) to (sig, row)."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            row = np.asarray(b.column(0))
            for first, raw, offsets in tokens.chunks(b.column(1)):
                who, sig = deal(rule, *sets_of(rule, raw, offsets))
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(row[first + who])], names=["sig", "row"])

    return of


def pivot_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (sig, row) in order to (a, b, wide): the least row of each signature with the others.

    ``wide``: the signature may have more than two rows. Rows are read as a stream; of a
    signature that goes on in the next batch, its first row is carried.
    """
    last, pivot = None, None
    for b in batches:
        sig, row = np.asarray(b.column(0)), np.asarray(b.column(1))
        if not len(sig):
            continue
        new = np.ones(len(sig), bool)
        new[1:] = sig[1:] != sig[:-1]
        goes_on = last is not None and sig[0] == last
        begin = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        first = row[begin]
        if goes_on:
            first[0] = pivot
        many = np.bincount(group)
        many[-1] += 2  # more may follow
        if goes_on:
            many[0] += 2
        a = first[group]
        show = a != row
        yield pa.RecordBatch.from_arrays([pa.array(a[show]), pa.array(row[show]), pa.array(many[group[show]] > 2)], names=["a", "b", "wide"])
        last, pivot = sig[-1], first[-1]


def each_set(rule: Rule, raw: pa.Array) -> list[np.ndarray]:
    """Set of each text: sorted 64-bit hashes."""
    out: list[np.ndarray] = []
    for _, data, offsets in tokens.chunks(raw):
        shingle, at = sets_of(rule, data, offsets)
        out += np.split(shingle, at[1:-1])
    return out


def sketch_of(elements: np.ndarray) -> np.ndarray:
    """256 bits: whether the number of elements in each of 256 cells is odd. Two sets differ in
    at least as many elements as their sketches do in bits."""
    odd = np.bincount((elements >> U(56)).astype(np.int64), minlength=256) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


#: What against_pivot() gives.
COMPARED = "a long, b long, linked boolean, size long, common long, differ array<long>, first array<int>, sketch array<long>"
#: Bits in which the sketches of s and t differ.
GAP = " + ".join(f"bit_count(s_sketch[{i}] ^ t_sketch[{i}])" for i in range(4))


def outline(elements: np.ndarray) -> bytes:
    """As sketch_of(), in at least four times as many cells as there are elements."""
    cells = 1 << max(6, (4 * len(elements) - 1).bit_length())
    odd = np.bincount((elements & U(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def least_differences(x: bytes, y: bytes) -> int:
    """Elements in which the sets of two outlines differ at least; the larger one is folded."""
    size = min(len(x), len(y))
    one, other = (np.bitwise_xor.reduce(np.frombuffer(z, np.uint8).reshape(-1, size), axis=0) for z in (x, y))
    return int(np.bitwise_count(one ^ other).sum())


def sifted(rule: Rule):
    """From (a, b, wide, m, n, x, y), sizes and outlines of a and b, to (a, b, wide, ask, far).

    ``far``: b is surely further than three times a link's distance from its wide pivot a. ``ask``:
    texts must be compared, since b isn't, or since two sets that are alone with a signature may link.
    """
    apart, part = 100 - rule.part, rule.part

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ask, far = [], []
            for wide, m, n, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 7)), strict=True):
                gap = max(abs(m - n), least_differences(x, y))
                far.append(wide and 200 * gap > 3 * apart * (m + n + gap))
                ask.append(not far[-1] if wide else gap * (100 + part) <= apart * (m + n))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(ask, pa.bool_()), pa.array(far, pa.bool_())], names=["a", "b", "wide", "ask", "far"])

    return of


def against_pivot(rule: Rule, often: Broadcast | None = None):
    """From (a, b, wide, x, y) to (a, b, linked, size, common, differ, first, sketch); x and y
    are the texts of a and b, which take half the room of their sets.

    For ``wide`` pairs, ``differ`` is what b differs in from the pivot a, given unless b is far
    from it; ``first`` begins what b has beyond a, given unless b is near. Distance here is one
    minus similarity, which obeys the triangle inequality. Let T be the
    largest distance of a link. Links of a set within 2 T of a lie within 3 T: both have
    ``differ``. Two sets beyond 2 T both have ``first``. A set that has so much of a that a
    link may lie within a alone gets both. ``sketch`` is that of sketch_of() for b.

    ``first`` has as many elements, those that aren't ``often`` (counted()) first, then least first, as sets
    that link must share one of; of each 32 bits are kept, which bring together more sets than all 64
    would, and never fewer.
    """
    over, part = 100, rule.part

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            _, first, which = np.unique(np.asarray(batch.column(0)), return_index=True, return_inverse=True)
            pivots = each_set(rule, batch.column(3).take(pa.array(first)))
            for wide, at, q in zip(batch.column(2).to_pylist(), which.tolist(), each_set(rule, batch.column(4)), strict=True):
                p = pivots[at]
                common = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - common
                differ = begin = None
                if wide:
                    apart = over * (union - common)
                    need = rule.shared(len(q)) - common
                    if apart <= 3 * (over - part) * union or need <= 0:
                        differ = np.setxor1d(p, q, assume_unique=True).view(np.int64)
                    if apart > 2 * (over - part) * union:
                        outside = rarest_first(np.setdiff1d(q, p, assume_unique=True), often)
                        begin = (outside[: len(outside) - max(1, need) + 1] >> U(32)).astype(np.uint32).view(np.int32)
                for c, v in zip(out, (over * common >= part * union, len(q), common, differ, begin, sketch_of(q) if wide else None), strict=True):
                    c.append(v)
            types = (pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["a", "b", "linked", "size", "common", "differ", "first", "sketch"])

    return of


def rarest_first(elements: np.ndarray, often: Broadcast | None) -> np.ndarray:
    if often is None or not len(often.value[0]):
        return elements
    known, times = often.value
    at = np.minimum(np.searchsorted(known, elements), len(known) - 1)
    return elements[np.argsort(np.where(known[at] == elements, times[at], 0), kind="stable")]


def counted(texts: DataFrame, rule: Rule) -> Broadcast:
    """Elements that more than one of about SEEN of the sets of ``texts`` (row, raw) have, and how many have them."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in each_set(rule, batch.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64))], names=["e"])

    every = texts.count() // SEEN + 1
    seen = texts.filter(F.pmod(F.xxhash64("row"), F.lit(every)) == 0).select("raw").mapInArrow(of, "e long")
    rows = seen.groupBy("e").agg(F.count("*").alias("times")).filter("times > 1").orderBy(F.desc("times"), "e").limit(OFTEN).toArrow()
    known, times = (np.asarray(rows.column(i)) for i in (0, 1))
    order = np.argsort(known.view(U))
    return texts.sparkSession.sparkContext.broadcast((known.view(U)[order], times[order]))


def beyond_pivot(rule: Rule):
    """From (a, b, label, x, y) to (a, b, label, size, common, sketch, outside): what b has beyond a."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(4)]
            _, first, which = np.unique(np.asarray(batch.column(0)), return_index=True, return_inverse=True)
            pivots = each_set(rule, batch.column(3).take(pa.array(first)))
            for at, q in zip(which.tolist(), each_set(rule, batch.column(4)), strict=True):
                outside = np.setdiff1d(q, pivots[at], assume_unique=True)
                for c, v in zip(out, (len(q), len(q) - len(outside), sketch_of(q), outside.view(np.int64)), strict=True):
                    c.append(v)
            types = (pa.int64(), pa.int64(), *[pa.list_(pa.int64())] * 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array(c, t) for c, t in zip(out, types, strict=True))], names=["a", "b", "label", "size", "common", "sketch", "outside"])

    return of


def salted(rows: DataFrame, of_pivot: DataFrame) -> DataFrame:
    """``rows`` (a, b, times, ...) joined with the row that each pivot ``a`` has in ``of_pivot``
    (a, times, ...). The rows of a pivot are ``times`` many; its own is repeated for each PER_SALT."""
    salts = (F.col("times") / PER_SALT).cast("long")
    dealt = rows.withColumn("salt", F.pmod(F.xxhash64("b"), salts + 1))
    spread = of_pivot.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts))).drop("times")
    return dealt.join(spread, ["a", "salt"]).drop("salt")


def with_texts(pairs: DataFrame, texts: DataFrame, pivots: DataFrame) -> DataFrame:
    """``pairs`` (a, b, ...) with the texts x of a and y of b; ``pivots`` has the texts of all a, ``texts`` of all b.

    A pivot with many pairs is met in several tasks: its text is repeated for each PER_SALT of them.
    """
    salts = pairs.groupBy("a").agg((F.count("*") / PER_SALT).cast("long").alias("salts"))
    with_b = pairs.join(texts.select(F.col("row").alias("b"), F.col("raw").alias("y")), "b")
    with_b = with_b.join(salts.filter("salts > 0"), "a", "left")
    with_b = with_b.withColumn("salt", F.pmod(F.xxhash64("b"), F.coalesce("salts", F.lit(0)) + 1)).drop("salts")
    spread = pivots.select(F.col("row").alias("a"), F.col("raw").alias("x")).join(salts, "a")
    spread = spread.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), "salts"))).drop("salts")
    return with_b.join(spread, ["a", "salt"]).select(*pairs.columns, "x", "y")


def compared(pairs: DataFrame, texts: DataFrame, pivots: DataFrame, rule: Rule) -> DataFrame:
    """against_pivot() of pairs (a, b, wide)."""
    return with_texts(pairs.select("a", "b", "wide"), texts, pivots).mapInArrow(against_pivot(rule), COMPARED).select("a", "b", "linked", "size", "differ", F.col("first").isNotNull().alias("far"), "sketch")


def compared_in_parts(pairs: DataFrame, texts: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """compared() of all pairs, in PARTS by b; the shuffles of a part are gone when the next begins."""
    pivot = pairs.select(F.col("a").alias("row")).distinct()
    pivots = scratch.write(texts.join(pivot.hint("shuffle_hash"), "row", "left_semi"), "pivots")
    for part in range(PARTS):
        mine = lambda c: F.pmod(F.xxhash64(c), F.lit(PARTS)) == part  # noqa: B023, E731
        found = scratch.add(compared(pairs.filter(mine("b")), texts.filter(mine("row")), pivots, rule), "found")
    scratch.drop("pivots")
    return found


def recentre(rule: Rule):
    """From (a, b, size, differ, centre, sketch, times) to (a, b, size, w, away, sketch, times).

    ``away`` is what b differs in from the pivot's centre, the set that has what most of the
    sets around the pivot have. Two sets whose w add up to 0 or less link, since they can't
    differ in more than both differ from the centre. If w add up to more, they link if and only
    if they share enough of what they are away in: 2 (100 + part) times its size is at least
    the sum.
    """

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            away, w = [], []
            for size, differ, centre in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                d = np.setxor1d(np.array(differ, np.int64), np.array(centre or [], np.int64), assume_unique=True)
                away.append(d)
                w.append((100 + rule.part) * len(d) - (100 - rule.part) * size)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(w, pa.int64()), pa.array(away, pa.list_(pa.int64())), batch.column(5), batch.column(6)], names=["a", "b", "size", "w", "away", "sketch", "times"])

    return of


def apart(each: DataFrame, *also: Column) -> DataFrame:
    """(a, e, times) of the elements by which sets of different labels around a pivot could meet.

    Counts, least and greatest labels are summed up before anything is dealt out.
    """
    sums = each.groupBy("a", "e").agg(F.count("*").alias("times"), F.min("label").alias("low"), F.max("label").alias("high"), *also)
    met = sums.filter("times > 1 and low != high")
    return met.filter("asks") if also else met


def size_fits(rule: Rule) -> Column:
    return F.least("s_size", "t_size") * 100 >= F.greatest("s_size", "t_size") * rule.part


def met_pairs(met: DataFrame, fits: Column, rule: Rule) -> DataFrame:
    """(a, b), their labels ``one`` and ``other``, and ``gap``, the bits in which their sketches
    differ, of pairs s and t that fit; sketches that differ too much don't."""
    small = F.expr(f"({GAP}) * {100 + rule.part} <= (s_size + t_size) * {100 - rule.part}")
    pair = [F.least("s_b", "t_b").alias("a"), F.greatest("s_b", "t_b").alias("b")]
    return met.filter(fits & small).select(*pair, F.least("s_label", "t_label").alias("one"), F.greatest("s_label", "t_label").alias("other"), F.expr(GAP).alias("gap"))


def near_pairs(centred: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets around one pivot, not yet under one label, that may link by what
    they both are away in from its centre. ``centred`` is recentre() with ``label`` and ``least``,
    the least w around the pivot.

    Elements are ordered rarest first. Sets that link share so many that one of them is among
    the first few of each: how few depends on the other's w, so a set shows, to each class of w
    (its number of binary digits) that stands around the pivot, as many as that class asks for.
    """
    two = 2 * (100 + rule.part)
    digits = F.when(F.col("w") <= 0, F.lit(0)).otherwise(F.length(F.bin("w")))
    sets = centred.withColumns({"kind": digits, "asks": F.col("w") + F.col("least") > 0})
    around = sets.groupBy("a", "times").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.bool_or("asks").alias("any_asks"), F.collect_set("kind").alias("kinds"))
    sets = scratch.write(salted(sets, around.filter("any_asks and low != high").select("a", "times", "kinds")).drop("times"), "around")
    met = apart(sets.select("a", "label", "asks", F.explode("away").alias("e")), F.bool_or("asks").alias("asks")).select("a", "e", "times")
    each = sets.select("a", "b", F.explode("away").alias("e")).join(met, ["a", "e"])
    each = each.join(sets.withColumn("n", F.size("away")).drop("away"), ["a", "b"])
    by = Window.partitionBy("a", "b")
    each = each.withColumn("place", F.col("n") - F.count("*").over(by) + F.row_number().over(by.orderBy("times", "e")))
    each = each.withColumn("partner", F.explode("kinds"))
    low = F.when(F.col("partner") == 0, F.col("least")).otherwise(F.expr("shiftleft(1L, partner - 1)"))
    need = F.greatest(F.lit(1), F.ceil((F.col("w") + low) / two))
    each = each.filter(F.col("place") <= F.col("n") - need + 1)
    each = scratch.write(each.select("a", "e", "kind", "partner", "asks", "b", "label", "size", "w", "n", "place", "sketch"), "shown")
    t = each.filter("asks").select("a", "e", "kind", "partner", *(F.col(c).alias(f"t_{c}") for c in ("b", "label", "size", "w", "n", "place", "sketch")))
    s = each.select("a", "e", F.col("partner").alias("kind"), F.col("kind").alias("partner"), *(F.col(c).alias(f"s_{c}") for c in ("b", "label", "size", "w", "n", "place", "sketch")))
    left = 1 + F.least(F.col("s_n") - F.col("s_place"), F.col("t_n") - F.col("t_place"))
    fits = (F.col("s_label") != F.col("t_label")) & size_fits(rule) & (left * two >= F.col("s_w") + F.col("t_w"))
    return met_pairs(t.join(s, ["a", "e", "kind", "partner"]), fits, rule)


def meeting(far: DataFrame) -> DataFrame:
    """(a, b, label) of those sets of ``far`` (a, b, label, first) that meet one of another label around
    their pivot. A pivot and an element of it are one number here, as a few more that meet do no harm."""
    first = far.select("a", "b", "label", F.explode("first").alias("e")).select("a", "b", "label", F.xxhash64("a", "e").alias("e"))
    met = first.groupBy("e").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low != high")
    return first.join(met.select("e"), "e", "left_semi").select("a", "b", "label").distinct()


def far_pairs(far: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """Pairs (a, b) of sets far from pivots, not yet under one label, that may link: they
    share an element outside the pivot among the first few, rarest around the pivot first, so
    that what a whole family has brings nobody together. ``far`` is beyond_pivot(). Any order would do,
    so only sets of meeting(), those that meet by the first few in order of hash, need be given."""
    n = F.col("size") - F.col("common")
    need = F.greatest(F.lit(1), F.ceil(F.col("size") * rule.part / 100) - F.col("common"))
    met = apart(far.select("a", "label", F.explode("outside").alias("e"))).select("a", "e", "times")
    each = far.select("a", "b", F.explode("outside").alias("e")).join(met, ["a", "e"])
    each = each.join(far.select("a", "b", "label", "size", "common", "sketch"), ["a", "b"])
    by = Window.partitionBy("a", "b")
    each = each.withColumn("place", n - F.count("*").over(by) + F.row_number().over(by.orderBy("times", "e")))
    each = scratch.write(each.filter(F.col("place") <= n - need + 1).drop("times"), "beyond")
    t, s = (each.select("a", "e", *(F.col(c).alias(f"{x}_{c}") for c in ("b", "label", "size", "common", "place", "sketch"))) for x in "ts")
    # what is left to share outside the pivot, and what must be shared there
    beyond = lambda x: F.col(f"{x}_size") - F.col(f"{x}_common") - F.col(f"{x}_place") + 1
    share = (F.col("s_size") + F.col("t_size")) * rule.part
    enough = (F.least(beyond("s"), beyond("t")) + F.least("s_common", "t_common")) * (100 + rule.part) >= share
    fits = (F.col("s_b") < F.col("t_b")) & (F.col("s_label") != F.col("t_label")) & size_fits(rule) & enough
    return met_pairs(t.join(s, ["a", "e"]), fits, rule)


def find_links(texts: DataFrame, pairs: DataFrame, outlines: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """v, label of the linked sets, from the pairs (a, b, wide) of pivots with the others, their
    texts (row, raw) and their outlines (row, n, outline).

    Each pair is compared, by texts if the outlines leave it open. Two sets around one pivot that both link with it need no more. What
    else may link is found around the pivot's centre, where the many copies of one text that
    each have a few changes of their own are each away by their own changes alone: most
    of them are known to link by their distances from it, and the others meet only by
    changes that they share (near_pairs). Sets far from a pivot, that share little with it,
    meet around the empty set, each once for all of its pivots (far_pairs). Only pairs under different
    labels are asked for.
    """
    sized = lambda end, n, x: outlines.select(F.col("row").alias(end), F.col("n").alias(n), F.col("outline").alias(x))
    kinds = pairs.join(sized("a", "m", "x"), "a").join(sized("b", "n", "y"), "b").select("a", "b", "wide", "m", "n", "x", "y")
    kinds = scratch.write(kinds.mapInArrow(sifted(rule), "a long, b long, wide boolean, ask boolean, far boolean"), "sifted")
    found = compared_in_parts(kinds.filter("ask"), texts, rule, scratch)
    links = found.filter("linked").select("a", "b")
    close = found.filter("differ is not null").groupBy("a").agg(F.count("*").alias("times"), F.bool_and("linked").alias("done")).filter("times > 1 and not done").drop("done")
    near = found.filter("differ is not null").join(close, "a").select("a", "b", "size", "differ", "times", "sketch")
    toggled = near.select("a", "times", F.explode("differ").alias("e")).groupBy("a", "e", "times").agg(F.count("*").alias("n")).filter("2 * n > times")
    centre = close.join(toggled.groupBy("a").agg(F.collect_list("e").alias("centre")), "a", "left").select("a", "times", "centre")
    centred = salted(near, centre).select("a", "b", "size", "differ", "centre", "sketch", "times")
    centred = scratch.write(centred.mapInArrow(recentre(rule), "a long, b long, size long, w long, away array<long>, sketch array<long>, times long"), "centred")
    middle = scratch.write(centred.groupBy("a", "times").agg(F.min(F.struct("w", "b")).alias("m")).select("a", "times", F.col("m.w").alias("least"), F.col("m.b").alias("middle")), "middle")
    by_centre = salted(centred.select("a", "b", "w", "times"), middle).filter((F.col("w") + F.col("least") <= 0) & (F.col("b") != F.col("middle")))
    label = components(links.union(by_centre.select("middle", "b")))
    of = label.select(F.col("v").alias("b"), "label")
    placed = salted(centred, middle.select("a", "times", "least")).join(of, "b", "left").withColumn("label", F.coalesce("label", "b"))
    more = scratch.write(near_pairs(placed, rule, scratch), "near-pairs")
    scratch.drop("centred", "middle", "around", "shown")
    outer = kinds.filter("far").select("a", "b").union(found.filter("far").select("a", "b"))
    lonely = outer.groupBy("a").agg(F.count("*").alias("times")).filter("times > 1")
    outer = outer.join(lonely.select("a"), "a", "left_semi").select(F.col("b").alias("row")).distinct()
    outer = scratch.write(texts.join(outer.hint("shuffle_hash"), "row", "left_semi"), "outer")
    around_none = lambda rows, *also: rows.select(F.lit(0).cast("long").alias("a"), F.col("row").alias("b"), *also, F.lit(b"").alias("x"), F.col("raw").alias("y"))
    first = around_none(outer, F.lit(True).alias("wide")).mapInArrow(against_pivot(rule, counted(outer, rule)), COMPARED).select("a", "b", "first")
    some = scratch.write(meeting(first.join(of, "b", "left").withColumn("label", F.coalesce("label", "b"))), "meeting")
    # only now whole sets, made from the texts again
    schema = "a long, b long, label long, size long, common long, sketch array<long>, outside array<long>"
    alive = around_none(outer.join(some.select(F.col("b").alias("row"), "label"), "row"), "label")
    alive = scratch.write(alive.mapInArrow(beyond_pivot(rule), schema), "alive")
    more = more.union(scratch.write(far_pairs(alive, rule, scratch), "far-pairs"))
    scratch.drop("sifted", "found", "outer", "meeting", "alive", "beyond")
    more = more.distinct().join(pairs.select("a", "b"), ["a", "b"], "left_anti")
    more = scratch.write(more.withColumn("wide", F.lit(False)), "more")
    # of two labels the likeliest pair first; most of the others are then under one label
    best = scratch.write(more.groupBy("one", "other").agg(F.min(F.struct("gap", "a", "b", "wide")).alias("p")).select("p.a", "p.b", "p.wide"), "best")
    rest = more
    for step in ("best", "rest"):
        if best.isEmpty():
            break
        late = scratch.write(compared(best, texts, texts, rule).filter("linked").select("a", "b"), f"links-{step}")
        label = components(label.select(F.col("v").alias("a"), F.col("label").alias("b")).union(late))
        scratch.drop(f"links-{step}")
        if step == "best":
            rest = more.select("a", "b", "wide").join(best.select("a", "b"), ["a", "b"], "left_anti")
            for end in ("a", "b"):
                rest = rest.join(label.select(F.col("v").alias(end), F.col("label").alias(f"label_{end}")), end, "left")
            rest = rest.filter(F.coalesce("label_a", "a") != F.coalesce("label_b", "b"))
            best = scratch.write(rest.select("a", "b", "wide"), "rest")
            scratch.drop("best")
    scratch.drop(*scratch.paths.keys() & {"best", "rest"})
    scratch.drop("near-pairs", "far-pairs", "more")
    return label


def numbered(docs: DataFrame, text: str, columns: list[Column], scratch: Scratch) -> DataFrame:
    """row, raw and ``columns``, written once: a row keeps its number whoever reads it again."""
    small_batches(docs.sparkSession)
    return scratch.write(docs.select(F.monotonically_increasing_id().alias("row"), whole_text(text).cast("binary").alias("raw"), *columns), "rows")


def classes(docs: DataFrame, rule: Rule, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_shingles and component_id (least doc_id that links lead to) of each row.

    Words are stretches without the bytes 0x20 and 0x09 to 0x0D, with A-Z in lower case. Null
    and blank texts have an empty set, link with nothing and are their own component; texts of
    fewer words than a shingle have one shingle of all their words. Equal rows link with each
    other, as do rows that repeat a doc_id with near texts. A null doc_id counts as the least of
    all and stays null as a component. Texts of any length are read whole. An empty table gives
    an empty result. Columns other than key and text aren't read, whatever their names.
    """
    scratch = Scratch(docs.sparkSession)
    rows = numbered(docs, text, [F.col(key).cast("long").alias("doc_id")], scratch)
    found = by_row(rows.select("row", "raw"), rule, scratch)
    all_rows = rows.select("row", "doc_id").join(found, "row")
    # null first: a component that holds one has it as its least
    least = all_rows.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id")).alias("least")).filter("label is not null")
    least = least.select("label", F.col("least.doc_id").alias("component_id"), F.lit(True).alias("has"))
    out = all_rows.join(least, "label", "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("has"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each component of classes(), though components may have one
    component_id: the row of the least doc_id (null first), of equal ones the first. Rows with an
    empty set all stay. Other columns stay as they are, whatever their names."""
    scratch = Scratch(docs.sparkSession)
    small_batches(docs.sparkSession)
    row = free_name("row", docs)
    kept = scratch.write(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    found = by_row(kept.select(F.col(row).alias("row"), whole_text(text).cast("binary").alias("raw")), rule, scratch)
    ids = kept.select(F.col(row).alias("row"), F.col(key).cast("long").alias("id")).join(found, "row")
    first = ids.filter("n_shingles > 0").groupBy("label").agg(F.min(F.struct(F.col("id").isNotNull().alias("known"), "id", "row")).alias("first"))
    stay = first.select(F.col("first.row").alias(row)).union(ids.filter("n_shingles = 0").select("row"))
    return kept.join(stay, row, "left_semi").select(*docs.columns)


def by_row(rows: DataFrame, rule: Rule, scratch: Scratch) -> DataFrame:
    """row, n_shingles, label of (row, raw): a number of each component, null where the set is
    empty. ``rows`` is read from files more than once and so must have lasting numbers."""
    spark = rows.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sets = scratch.write(rows.mapInArrow(describe(rule), "row long, n long, d1 long, d2 long, outline binary"), "set-digests")
    same = ["n", "d1", "d2"]
    reps = scratch.write(sets.filter("n > 0").groupBy(*same).agg(F.min("row").alias("rep")), "representatives")
    # written, so that the texts' shuffle is gone when signatures are dealt out
    once = scratch.write(rows.join(reps.select(F.col("rep").alias("row")).hint("shuffle_hash"), "row", "left_semi").select("row", "raw"), "once")
    dealt = once.mapInArrow(signatures(rule), "sig long, row long").repartition(partitions, "sig").sortWithinPartitions("sig", "row")
    pairs = dealt.mapInArrow(pivot_pairs, "a long, b long, wide boolean").groupBy("a", "b").agg(F.bool_or("wide").alias("wide"))
    pairs = scratch.write(pairs, "pairs")
    involved = pairs.select(F.col("a").alias("row")).union(pairs.select("b")).distinct()
    texts = scratch.write(once.join(involved.hint("shuffle_hash"), "row", "left_semi"), "texts")
    scratch.drop("once")
    label = find_links(texts, pairs, sets.select("row", "n", "outline"), rule, scratch)
    scratch.drop("pairs", "texts")
    whole = reps.join(label, F.col("rep") == F.col("v"), "left").select(*same, F.coalesce("label", "rep").alias("label"))
    return sets.drop("outline").join(whole, same, "left").select("row", F.col("n").alias("n_shingles"), "label")
