"""Document fingerprints by consistent weighted sampling.

A text's terms are its words, weighted by how often they stand in it. For each of ``SAMPLES``
places, each term draws gamma(2, 1) numbers r and c and a uniform b from its own hash; its weight
is rounded down on the term's grid of logarithms, t = floor(ln w / r + b), and the term with the
least ln a = ln c - r (t - b) - r is the sample (term, t). Two texts agree in a place with a probability of their
generalised Jaccard similarity, the sum of lesser over the sum of greater weights. The least
value stands for (term, t), since each of these has a value of its own: a place keeps 32 bits of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellframe.llm.shared import Scratch, small_batches, whole_text
from cellframe.llm.tokens import BASES, U, mix, wide_words

SAMPLES = 64
#: Terms whose numbers are worked out at a time.
BLOCK = 4096
#: Part of a text that an edit replaces.
EDITED = 4


def uniform(term: np.ndarray, place: np.ndarray, draw: int) -> np.ndarray:
    """Uniform numbers in (0, 1) for each term and place."""
    seed = mix(place * U(8) + U(draw) + U(BASES[1]))
    return ((mix(term[:, None] ^ seed[None, :]) >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def sampled(term: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """ln a of each term with its weight, for each place."""
    place = np.arange(SAMPLES, dtype=U)
    out = np.empty((len(term), SAMPLES))
    for k in range(0, len(term), BLOCK):
        x = term[k : k + BLOCK]
        r = -np.log(uniform(x, place, 0) * uniform(x, place, 1))
        c = -np.log(uniform(x, place, 2) * uniform(x, place, 3))
        b = uniform(x, place, 4)
        t = np.floor(np.log(weight[k : k + BLOCK, None]) / r + b)
        out[k : k + BLOCK] = np.log(c) - r * (t - b) - r
    return out


def term_weights(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the distinct words of each text, their counts, and the offsets of each text's."""
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    raw = np.frombuffer(b"".join(texts), np.uint8)
    term, at = wide_words(raw, offsets)
    doc = np.repeat(np.arange(len(texts)), np.diff(at))
    order = np.lexsort((term, doc))
    term, doc = term[order], doc[order]
    first = np.ones(len(term), bool)
    first[1:] = (term[1:] != term[:-1]) | (doc[1:] != doc[:-1])
    where = np.flatnonzero(first)
    count = np.diff(np.append(where, len(term)))
    return term[where], count, np.searchsorted(doc[where], np.arange(len(texts) + 1))


def signatures(texts: list[bytes]) -> np.ndarray:
    """A row of ``SAMPLES`` 32-bit numbers for each text; zeros for a text without words."""
    term, count, at = term_weights(texts)
    out = np.zeros((len(texts), SAMPLES), np.uint32)
    if not len(term):
        return out
    # each pair of a term and a count is sampled once, numbered so that plain numbers are sorted
    terms, which = np.unique(term, return_inverse=True)
    most = int(count.max()) + 1
    distinct, which = np.unique(which * most + count, return_inverse=True)
    values = sampled(terms[distinct // most], (distinct % most).astype(np.float64))
    some = np.flatnonzero(np.diff(at))
    for k in range(0, len(some), 64):
        docs = some[k : k + 64]
        begin, end = at[docs[0]], at[docs[-1] + 1]
        if end - begin <= 1 << 16:
            least = np.minimum.reduceat(values[which[begin:end]], at[docs] - begin, axis=0)
        else:  # long texts by blocks of terms
            least = np.stack([np.min([values[which[a : min(a + BLOCK, at[d + 1])]].min(axis=0) for a in range(at[d], at[d + 1], BLOCK)], axis=0) for d in docs])
        out[docs] = (mix(np.ascontiguousarray(least).view(U)) >> U(32)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Part of the places in which fingerprints agree; 1 for two texts without words, 0 for one."""
    empty = (~a.any(axis=1)).astype(int) + ~b.any(axis=1)
    return np.where(empty == 1, 0.0, (a == b).mean(axis=1))


def edit(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of the following text."""
    n = len(text) // EDITED
    return text[: len(text) - n] + following[:n]


COLUMNS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: A partition's first row, and its last one, which waits for the next partition.
FIRST, LAST = 0, 1
EDGES = f"{RESULT}, edge int, part long, text string"


def compared(ids: list, texts: list[str], following: list[str]) -> list[list]:
    """Result columns for texts and the ones that follow them."""
    edited = [edit(t, f) for t, f in zip(texts, following, strict=True)]
    # texts and following ones share all but a few: sign each once
    place = {t: k for k, t in enumerate(dict.fromkeys([*texts, *following, *edited]))}
    sign = signatures([t.encode() for t in place])
    a, b, c = (sign[[place[t] for t in x]] for x in (texts, edited, following))
    said = [np.ascontiguousarray(x.astype(">u4")) for x in (a, b)]
    return [
        ids,
        [len(t) for t in texts],
        [hashlib.sha256(t.encode()).hexdigest() for t in edited],
        *([row.tobytes().hex() for row in x] for x in said),
        likeness(a, b).tolist(),
        likeness(a, c).tolist(),
    ]


def along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Results of all rows of a sorted partition but the last, which goes out as an edge, as does the first."""
    part, held = TaskContext.get().partitionId(), None

    def edge(kind: int, doc_id: int | None, text: str) -> pa.RecordBatch:
        cols = [pa.array([doc_id], pa.int64()), *(pa.nulls(1, t) for _, t in COLUMNS[1:]), pa.array([kind], pa.int32()), pa.array([part], pa.int64()), pa.array([text], pa.string())]
        return pa.RecordBatch.from_arrays(cols, names=[*(x for x, _ in COLUMNS), "edge", "part", "text"])

    for b in batches:
        ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
        if not ids:
            continue
        if held is None:
            yield edge(FIRST, ids[0], texts[0])
        else:
            ids, texts = [held[0], *ids], [held[1], *texts]
        held = ids[-1], texts[-1]
        if len(ids) > 1:
            made = compared(ids[:-1], texts[:-1], texts[1:])
            cols = [pa.array(v, t) for v, (_, t) in zip(made, COLUMNS, strict=True)]
            n = len(ids) - 1
            yield pa.RecordBatch.from_arrays([*cols, pa.nulls(n, pa.int32()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.string())], names=[*(x for x, _ in COLUMNS), "edge", "part", "text"])
    if held is not None:
        yield edge(LAST, *held)


def over_edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        made = compared(*(b.column(k).to_pylist() for k in range(3)))
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, (_, t) in zip(made, COLUMNS, strict=True)], names=[x for x, _ in COLUMNS])


def next_part(part: Column, parts: list[int]) -> Column:
    """The number of the partition after ``part`` that has rows; after the last comes the first."""
    return F.element_at(F.create_map(*[F.lit(x).cast("long") for k, p in enumerate(parts) for x in (p, parts[(k + 1) % len(parts)])]), part)


def compare_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of texts and of their edited forms, and how alike they and the next texts are.

    Documents stand in ascending order of doc_id (null first), equal ones by text; the next of the
    last is the first, and a single document is its own next. A null text is empty. Repeated rows
    are documents of their own. A text without words has a fingerprint of zeros and is like another
    such text (1) and no other (0). Very long texts are signed in blocks of terms; a table without rows
    gives none; columns other than doc_id and text are ignored. Texts are shuffled once, into
    sorted ranges; only a range's first and last text meet those of its neighbours, by a join
    on the ranges' numbers, of which the driver sees one a partition.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long"), whole_text().alias("text"))
    rows = rows.repartitionByRange("doc_id", F.substring("text", 1, 16)).sortWithinPartitions("doc_id", "text")
    made = Scratch(spark).write(rows.mapInArrow(along, EDGES), "fingerprints")
    first, last = made.filter(f"edge = {FIRST}"), made.filter(f"edge = {LAST}")
    parts = sorted(r.part for r in first.select("part").collect())
    done = made.filter("edge is null").select(*(x for x, _ in COLUMNS))
    if not parts:
        return done
    ends = last.select("doc_id", "text", next_part(F.col("part"), parts).alias("part")).join(first.select("part", F.col("text").alias("following")), "part")
    return done.unionByName(ends.select("doc_id", "text", "following").mapInArrow(over_edges, RESULT))
