"""Consistent weighted sampling against exact generalised Jaccard and plain loops."""

import collections
import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from cellframe.llm import fingerprints

SCHEMA = "doc_id long, text string"


def jaccard(a, b):
    """Sum of lesser over sum of greater weights."""
    x, y = (collections.Counter(t.encode().split()) for t in (a, b))
    both = x.keys() | y.keys()
    return sum(min(x[k], y[k]) for k in both) / sum(max(x[k], y[k]) for k in both) if both else 1.0


def text(rng, n, of=300):
    return " ".join(f"w{int(rng.paretovariate(0.7)) % of}" for _ in range(n))


def test_collisions_are_generalised_jaccard(monkeypatch):
    """Over many pairs the part of equal places is the similarity, within its standard error."""
    monkeypatch.setattr(fingerprints, "SAMPLES", 1024)
    rng = random.Random(2)
    base = [text(rng, rng.randrange(2, 400)) for _ in range(60)]
    often = [[0, 1, 1, 1, 2], [0, 0, 0, 1], [1] * 20 + [2]]
    other = [" ".join(w for w in t.split() for _ in range(rng.choice(often[k % 3]))) or "w1" for k, t in enumerate(base)]
    sign = fingerprints.signatures([t.encode() for t in base + other])
    got = fingerprints.likeness(sign[:60], sign[60:])
    want = np.array([jaccard(a, b) for a, b in zip(base, other, strict=True)])
    error = (got - want) / np.sqrt(np.maximum(want * (1 - want), 1e-3) / 1024)
    assert np.abs(error).max() < 4.5 and abs(error.mean()) < 0.5 and 0.7 < error.std() < 1.3
    assert want.min() < 0.6 < 0.9 < want.max()


def test_samples_follow_the_scheme_term_by_term(monkeypatch):
    """One term at a time, as the scheme is written; long texts in blocks come out the same."""
    rng = random.Random(3)
    texts = [text(rng, n, 10**6).encode() for n in (1, 7, 300)] + [b"a a a b", b"", b" \n"]
    want = fingerprints.signatures(texts)
    place = np.arange(fingerprints.SAMPLES, dtype=np.uint64)
    for t, row in zip(texts, want, strict=True):
        term, count, _ = fingerprints.term_weights([t])
        best = np.full(fingerprints.SAMPLES, np.inf)
        for x, w in zip(term, count, strict=True):
            u = [fingerprints.uniform(np.array([x]), place, k)[0] for k in range(5)]
            r, c = -np.log(u[0] * u[1]), -np.log(u[2] * u[3])
            grid = np.floor(np.log(float(w)) / r + u[4])
            best = np.minimum(best, np.log(c) - r * (grid - u[4]) - r)
        if len(term):
            assert (row == (fingerprints.mix(best.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)).all()
        else:
            assert not row.any()
    assert collections.Counter(term_counts(b"a a a b")) == collections.Counter([3, 1])
    long = text(rng, 150_000, 10**6).encode()
    sign = fingerprints.signatures([long, texts[2]])
    monkeypatch.setattr(fingerprints, "BLOCK", 10**9)
    assert (fingerprints.signatures([long, texts[2]]) == sign).all()
    assert (sign[1] == want[2]).all()


def term_counts(raw):
    return fingerprints.term_weights([raw])[1].tolist()


def test_words_of_cancelling_steps_are_apart():
    term, count, _ = fingerprints.term_weights([b"xxfpoltkaaaaaaab pqhdnrscisawtpyc"])
    assert len(term) == 2 and count.tolist() == [1, 1]


def brute(rows):
    rows = sorted(((d, t or "") for d, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    sign = {t: fingerprints.signatures([t.encode()])[0] for _, t in rows}
    out = []
    for k, (d, t) in enumerate(rows):
        following = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + following[:n]
        e = fingerprints.signatures([edited.encode()])[0]
        near = [1.0 if not t_sign.any() and not sign[t].any() else 0.0 if not t_sign.any() or not sign[t].any() else float((t_sign == sign[t]).mean()) for t_sign in (e, sign[following])]
        out.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), *("".join(f"{int(x):08x}" for x in s) for s in (sign[t], e)), *near))
    return out


def test_compare_edits(spark):
    rng = random.Random(6)
    rows = [(rng.choice([None, -(1 << 63), (1 << 63) - 1, *range(-5, 200)]), text(rng, rng.randrange(0, 60))) for _ in range(180)]
    rows += [(7, None), (8, ""), (9, " \t"), (10, "é語ß 𝄞x"), (11, rows[0][1]), (12, rows[0][1]), (12, rows[0][1]), (300, text(rng, 20_000)), (None, "tie"), (None, "tie")]
    clash = ["edge", "part", "following", "fingerprint", "n_chars"]
    df = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in clash})
    for parts in (1, 7):
        got = [tuple(r) for r in fingerprints.compare_edits(df.repartition(parts)).collect()]
        assert sorted(map(repr, got)) == sorted(map(repr, brute(rows)))
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        assert sorted(repr(tuple(r)) for r in fingerprints.compare_edits(df).collect()) == sorted(map(repr, brute(rows)))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_few_documents(spark):
    assert fingerprints.compare_edits(spark.createDataFrame([], SCHEMA)).count() == 0
    (row,) = fingerprints.compare_edits(spark.createDataFrame([(1, "one two three four")], SCHEMA)).collect()
    assert (row.n_chars, row.near_next) == (18, 1.0) and row.edited_sha256 == hashlib.sha256(b"one two three one ").hexdigest()
