"""Substring dedup by words: windows that occur more than once are removed everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellframe.llm import superkmers, tokens
from cellframe.llm.shared import Scratch

WINDOW, GRAM = 35, 4


def count_windows(s: superkmers.Strings, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorts the windows of all strings and counts equal ones: those counted more than once.

    Words become numbers by a dictionary; windows are sorted by a hash of their numbers, and
    neighbours of one hash are compared number by number.
    """
    split = [x.split() for x in s.text]
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for x in split for w in x], np.int64)
    windows = np.array([len(x) - size + 1 for x in split])
    string = np.repeat(np.arange(len(split)), windows)
    window = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    at = window + np.repeat(np.cumsum(windows + size - 1) - (windows + size - 1), windows)
    hashes = tokens.Prefix(tokens.mix(ids.astype(tokens.U) + tokens.U(1)), tokens.BASES[0]).of(at, at + size)
    order = np.argsort(hashes, kind="stable")
    equal = hashes[order[1:]] == hashes[order[:-1]]
    a, b = at[order[1:]][equal], at[order[:-1]][equal]
    if all((ids[a + i] == ids[b + i]).all() for i in range(size)):
        group = np.cumsum(np.append(True, ~equal))
        cls = np.empty(len(order), np.int64)
        cls[order] = group
    else:  # two windows share a hash: tell them apart by their words
        seen: dict[bytes, int] = {}
        cls = np.array([seen.setdefault(ids[i : i + size].tobytes(), len(seen)) for i in at])
    total = np.bincount(cls, s.times[string])
    return superkmers.stretches(total[cls] > 1, string, window)


def remove_repeated(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, n_words, n_removed and ``kept`` (the other words, joined by one space) of each row.

    Words are stretches without the bytes 0x20 and 0x09 to 0x0D. A word goes if a window of 35
    words covers it that starts anywhere else too. Null and empty texts have no words; equal
    rows are two documents and so copies of each other; texts of fewer words than a window stay;
    a null doc_id stays null. Columns other than key and text aren't read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = superkmers.numbered(docs, text, key, scratch)
    gone = superkmers.repeated(rows, superkmers.Kind(WINDOW, GRAM, True), count_windows, spare_first=False, scratch=scratch)

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[list] = [[], [], []]
            for raw, gone in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                words = raw.split()
                if gone:
                    stay = ~superkmers.covered(len(words), gone, WINDOW)
                    kept = [words[i] for i in np.flatnonzero(stay)]
                else:
                    kept = words
                for c, v in zip(out, (len(words), len(words) - len(kept), b" ".join(kept)), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True))], names=["doc_id", "n_words", "n_removed", "kept"])

    done = superkmers.with_gone(rows, gone).select("doc_id", "raw", "gone").mapInArrow(finish, "doc_id long, n_words long, n_removed long, kept binary")
    return done.withColumn("kept", F.col("kept").cast("string"))
