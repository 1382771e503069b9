"""Suffix-array dedup: strings of 100 bytes that start earlier too are removed.

Each bucket of strings (see superkmers) is cut into shards. A shard sorts its own suffixes and
keeps, for each, the block of bytes before it: its Burrows-Wheeler transform over blocks. The
transforms are merged without comparing or sorting suffixes of different shards: an interleave of shards,
at first arbitrary, is refined round by round. A round reads each shard's transform in the
order that the interleave says and deals the entries out, stably, by block; then suffixes are
in order of one block more. Where block or group of the entry before differ for the first time,
the common prefix of two neighbours ends, at as many blocks as rounds before it. Stretches of
neighbours with common prefixes of LENGTH or more are the repeated intervals.

Shards have only the alphabet in common: a number for each distinct block of 20 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm import superkmers
from cellframe.llm.shared import Scratch

LENGTH, GRAM = 100, 31
#: Bytes that a round refines by; LENGTH is a multiple of it.
BLOCK = 20
SHARDS = 4


#: Bits of a rank or place in packed sort keys; larger numbers are sorted another way.
BITS = 21


def order_of(rank: np.ndarray) -> np.ndarray:
    """Places in order of ranks, equal ones in order of place: one sort of packed keys."""
    key = rank << 32 | np.arange(len(rank))
    key.sort()
    return key & 0xFFFFFFFF


def dense(key: np.ndarray) -> np.ndarray:
    """Ranks of keys from 1 on."""
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def dense_pairs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Ranks of pairs of ranks."""
    if len(first) >= 1 << BITS:
        return dense(first << 32 | second)
    key = (first << BITS | second) << BITS | np.arange(len(first))
    key.sort()
    pair, order = key >> BITS, key & (1 << BITS) - 1
    new = np.ones(len(key), bool)
    new[1:] = pair[1:] != pair[:-1]
    out = np.empty(len(key), np.int64)
    out[order] = np.cumsum(new)
    return out


def sort_suffixes(rank: np.ndarray, end: np.ndarray, deep: int, longest: int) -> np.ndarray:
    """Places of a shard's suffixes in order, equal ones in order of place. ``rank`` orders them
    by their first ``deep`` bytes, ``end`` is where the string of each ends."""
    place = np.arange(len(rank))
    while deep < longest and rank.max(initial=0) < len(rank):
        after = np.where(place + deep < end, rank[np.minimum(place + deep, len(rank) - 1)], 0)
        rank, deep = dense_pairs(rank, after), 2 * deep
    return order_of(rank)


class Shard:
    """Strings with their suffixes in order and the block before each.

    A string of length n has suffixes 0 .. n-1 and BLOCK empty ones after it, which follow the
    last blocks; the empty ones of all strings come first, in order of strings. ``at`` is the
    place of each suffix in the joined strings, ``blocks`` its preceding block (0: none).
    ``first`` is where the shard's strings begin there, ``eight`` and ``block`` are numbers of the
    8 and BLOCK bytes at each place.
    """

    def __init__(self, first: np.ndarray, lengths: np.ndarray, eight: np.ndarray, block: np.ndarray):
        size = lengths + BLOCK
        begin = np.cumsum(lengths) - lengths
        text = np.arange(int(lengths.sum())) - np.repeat(begin - first, lengths)
        order = sort_suffixes(dense(eight[text]), np.repeat(begin + lengths, lengths), 8, int(lengths.max(initial=0)))
        gap = np.arange(BLOCK * len(first)) - np.repeat(np.arange(len(first)) * BLOCK - first - lengths, BLOCK)
        self.at = np.concatenate([gap, text[order]])
        self.empties = len(gap)
        start = np.zeros(int((first + size).max(initial=0)), np.int64)
        start[np.concatenate([gap, text])] = np.concatenate([np.repeat(first, BLOCK), np.repeat(first, lengths)])
        before = self.at - BLOCK
        self.blocks = np.where(before >= start[self.at], block[np.maximum(before, 0)], 0)


def merge(shards: list[Shard], rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of all suffixes in order of their first ``rounds`` blocks, and of each the blocks
    that it has in common with the one before it, at most ``rounds``.

    Suffixes that agree in their first blocks keep one stretch of the interleave while they are
    told apart within it, so a common prefix that has ended stays as it is.
    """
    fixed = np.repeat(np.arange(len(shards)), [s.empties for s in shards]).astype(np.uint8)
    z = np.concatenate([fixed, np.repeat(np.arange(len(shards)), [len(s.at) - s.empties for s in shards]).astype(np.uint8)])
    group = np.zeros(len(z), np.int64)
    common = np.full(len(z), rounds)
    common[:1] = 0
    block = np.empty(len(z), np.int64)
    for done in range(rounds):
        for s, shard in enumerate(shards):
            block[z == s] = shard.blocks
        inner = np.flatnonzero(block)
        inner = inner[order_of(block[inner])]
        b, g = block[inner], group[inner]
        new = np.ones(len(inner), bool)
        new[1:] = (b[1:] != b[:-1]) | (g[1:] != g[:-1])
        z = np.concatenate([fixed, z[inner]])
        group = np.concatenate([np.zeros(len(fixed), np.int64), np.cumsum(new)])
        ends = len(fixed) + np.flatnonzero(new)
        common[ends] = np.minimum(common[ends], done)
    at = np.empty(len(z), np.int64)
    for s, shard in enumerate(shards):
        at[z == s] = shard.at
    return at, common


def repeated_intervals(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of LENGTH bytes of some strings: string, place in it, and class of equal ones."""
    lengths = np.array([len(t) for t in texts])
    space = lengths + BLOCK
    first = np.cumsum(space) - space
    total = int(space.sum())
    joined = np.zeros(total + BLOCK + 8, np.uint64)
    # bytes of UTF-8 plus 1, so that 0 is free for what follows the end
    joined[:total] = np.frombuffer((b"\xff" * BLOCK).join([*texts, b""]), np.uint8).astype(np.uint64) + 1 & 255
    packed = np.zeros(total + BLOCK, np.uint64)
    for i in range(8):
        packed |= joined[i : total + BLOCK + i] << np.uint64(56 - 8 * i)
    eight = dense(packed)
    # 8, 8 and 4 more bytes, the last as the end of another 8; 20 free places follow each string
    block = dense_pairs(dense_pairs(eight[:total], eight[8 : total + 8]), eight[12 : total + 12])
    order = np.array_split(np.arange(len(texts)), min(SHARDS, len(texts)))
    at, common = merge([Shard(first[o], lengths[o], eight, block) for o in order], LENGTH // BLOCK)
    string = np.repeat(np.arange(len(texts)), space)[at]
    window = at - first[string]
    whole = window + LENGTH <= lengths[string]
    return string[whole], window[whole], np.cumsum(common < LENGTH // BLOCK)[whole]


def later_windows(s: superkmers.Strings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of each string that occur earlier than the string's own first occurrence."""
    string, window, cls = repeated_intervals(s.text)
    order = np.lexsort((s.start[string] + window, s.row[string], s.doc[string], s.known[string], cls))
    late = np.zeros(len(order), bool)
    late[1:] = cls[order[1:]] == cls[order[:-1]]
    string, window = string[order], window[order]
    order = np.lexsort((window, string))
    return superkmers.stretches(late[order], string[order], window[order])


def remove_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and ``kept`` (the other bytes) of each row.

    A byte goes if a string of 100 bytes covers it that starts earlier too: in a document of
    smaller doc_id (null is least), or in the same one at an earlier place. Equal doc_ids are
    told apart, and ordered, by their rows' places. Null and empty texts have no bytes, texts
    shorter than the string stay. Columns other than key and text aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = superkmers.numbered(docs, text, key, scratch)
    gone = superkmers.repeated(rows, superkmers.Kind(LENGTH, GRAM, False), later_windows, spare_first=True, scratch=scratch)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], [], []]
            for raw, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                removed = spans = 0
                kept = raw
                if gone:
                    off = superkmers.covered(len(raw), gone, LENGTH)
                    removed = int(off.sum())
                    spans = int(np.count_nonzero(np.diff(off.astype(np.int8), prepend=0) == 1))
                    kept = np.frombuffer(raw, np.uint8)[~off].tobytes()
                for c, v in zip(out, (len(raw), removed, spans, kept), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    done = superkmers.with_gone(rows, gone).select("doc_id", "raw", "gone").mapInArrow(finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")
    return done
