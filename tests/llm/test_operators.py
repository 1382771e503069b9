"""The training-data operators against brute force, on small and awkward tables."""

import collections
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from cellframe.llm import bpe, groups, jaccard, media, mixing, neighbours, pii, quality, sstable, substrings, suffixes, superkmers, webp
from cellframe.llm.shared import Scratch, shared_path

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: A column whose name clashes with one that operators make.
EXTRA = ["score", "kept", "token_ids", "media", "row", "copies"]


def words(rng, n, of=40):
    return " ".join(f"w{rng.randrange(of)}" for _ in range(n))


def texts():
    rng = random.Random(5)
    base = [words(rng, 120) for _ in range(12)]
    shared = words(rng, 45, 500)
    out = [*base, base[0], base[0], base[1].replace("w3 ", "w9 ", 1), base[2] + " " + shared, shared + "\n" + base[3], "a " * 80, "a" * 350, "", " \n\t", "one", "two words"]
    out += [words(rng, 30) + " " + shared for _ in range(6)] + ["é" * 130 + base[4][:150], base[4][100:330]]
    return [*out, None, words(rng, 4000)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, None if i % 9 == 0 else "en", None if i % 7 == 0 else f"src{i % 3}", 0) for i, t in enumerate(texts())]
    out = spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit("x") for c in EXTRA}).repartition(3).cache()
    out.count()
    return out


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def brute_words(rows):
    count, split = collections.Counter(), [(d, (t or "").encode().split()) for d, t in rows]
    for _, w in split:
        count.update(tuple(w[k : k + 35]) for k in range(len(w) - 34))
    out = []
    for d, w in split:
        off = [False] * len(w)
        for k in range(len(w) - 34):
            if count[tuple(w[k : k + 35])] > 1:
                off[k : k + 35] = [True] * 35
        out.append((d, len(w), sum(off), b" ".join(x for x, o in zip(w, off, strict=True) if not o).decode()))
    return out


def brute_bytes(rows):
    seen, out = set(), []
    for d, t in rows:
        raw = (t or "").encode()
        off = np.zeros(len(raw), bool)
        for k in range(len(raw) - 99):
            s = raw[k : k + 100]
            if s in seen:
                off[k : k + 100] = True
            seen.add(s)
        spans = int((np.diff(off.astype(int), prepend=0) == 1).sum())
        out.append((d, len(raw), int(off.sum()), spans, bytes(np.frombuffer(raw, np.uint8)[~off])))
    return out


@pytest.mark.parametrize("crowded", [4000, 1])
def test_substrings_and_suffixes(docs, empty, monkeypatch, crowded):
    monkeypatch.setattr(superkmers, "CROWDED", crowded)
    rows = list(enumerate(texts()))
    got = sorted(tuple(r) for r in substrings.remove_repeated(docs).collect())
    assert got == brute_words(rows)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeated(docs).collect())
    assert got == brute_bytes(rows)
    assert substrings.remove_repeated(empty).count() == suffixes.remove_repeated(empty).count() == 0


def test_repeated_intervals_are_classes_of_equal_windows():
    rng = random.Random(1)
    base = bytes(rng.choice(b"abcdef ") for _ in range(400))
    strings = [base[a : a + 99 + rng.randrange(1, 60)] for a in [rng.randrange(200) for _ in range(40)]] + [b"a" * 300]
    string, window, cls = suffixes.repeated_intervals(strings)
    of = {}
    for s, w, c in zip(string, window, cls, strict=True):
        assert of.setdefault(strings[s][w : w + 100], c) == c
    assert len(set(of.values())) == len(of)
    assert len(string) == sum(len(s) - 99 for s in strings)


def thue_morse(n, a="a", b="b"):
    s = a
    while len(s) < n:
        s += s.translate(str.maketrans(a + b, b + a))
    return s


def test_words_that_polynomials_cannot_tell_apart(spark):
    """Words of 1,024 letters that hash alike by any polynomial modulo 2**64 are different words."""
    one, other = thue_morse(1024), thue_morse(1024, "b", "a")
    rng = random.Random(9)
    tail = words(rng, 34, 10**6)
    rows = [(0, f"{one} {tail}"), (1, f"{other} {tail}"), (2, f"{one} x y"), (3, f"{other} x y")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in substrings.remove_repeated(df).collect()) == brute_words(rows)
    got = sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffixes.remove_repeated(df).collect())
    assert got == brute_bytes(rows)
    rule = jaccard.Rule(3, 90)
    assert sorted(tuple(r) for r in jaccard.classes(df, rule).collect()) == brute_classes(rows, rule)


def test_null_and_extreme_ids_stay_apart(spark):
    """A null doc_id is least; the least long is an id like any other; other columns don't clash."""
    rng = random.Random(12)
    text = words(rng, 60, 1000)
    rows = [(None, text), (-(1 << 63), text), (5, "")]
    clash = ["row", "raw", "h", "s", "gone", "start", "n", "label", "known", "first", "string"]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("x") for c in clash})
    got = {r.doc_id: (r.n_bytes, r.n_removed) for r in suffixes.remove_repeated(df).collect()}
    assert got == {None: (len(text), 0), -(1 << 63): (len(text), len(text)), 5: (0, 0)}
    assert {r.doc_id: r.n_removed for r in substrings.remove_repeated(df).collect()} == {None: 60, -(1 << 63): 60, 5: 0}
    rule = jaccard.Rule(5, 80)
    assert {r.doc_id: r.component_id for r in jaccard.classes(df, rule).collect()} == {None: None, -(1 << 63): None, 5: 5}
    kept = jaccard.keep_one(df, rule)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} == {None, 5}


def test_jaccard_families(spark, monkeypatch):
    """Families of near copies that overlap, about centres that no document is; pivots are hot."""
    monkeypatch.setattr(jaccard, "PER_SALT", 5)
    for seed, rule in ((0, jaccard.Rule(3, 90)), (1, jaccard.Rule(5, 80))):
        rng = random.Random(seed)
        rows, ids, before = [], rng.sample(range(5000), 200), []
        for family in range(4):
            base = words(rng, (60, 150, 300, 20)[family], 1000).split()
            if family % 2:
                base = before[: len(before) // 2] + base
            before = base
            for _ in range(50):
                copy = list(base)
                for _ in range(rng.choice([0, 1, 2, 3, 4, 6, 9, 14])):
                    copy[rng.randrange(len(copy))] = f"n{rng.randrange(rng.choice([5, 10**6]))}"
                rows.append((ids.pop(), " ".join(copy)))
        df = spark.createDataFrame(rows, "doc_id long, text string")
        assert sorted(tuple(r) for r in jaccard.classes(df, rule).collect()) == brute_classes(rows, rule)


def test_far_sets_meet_by_rare_elements(spark):
    """Sets far from a pivot that share what their whole family has, and else differ, aren't paired; two that link are."""
    rule, scratch = jaccard.Rule(5, 80), Scratch(spark)
    rows = [(0, b, b, 100, 0, [*range(60), *range(1000 * b, 1000 * b + 40)], [0, 0, 0, 0]) for b in range(1, 41)]
    rows += [(0, b, b, 100, 0, [*range(60), *range(10**6, 10**6 + 36), *range(1000 * b, 1000 * b + 4)], [0, 0, 0, 0]) for b in (50, 51)]
    far = spark.createDataFrame(rows, "a long, b long, label long, size long, common long, outside array<long>, sketch array<long>")
    found = jaccard.far_pairs(far, rule, scratch).select("a", "b").distinct().collect()
    assert [tuple(r) for r in found] == [(50, 51)]


def test_far_sets_are_kept_by_their_beginnings(spark):
    """What is kept of a set far from its pivot is a prefix, and sets that share nothing in it are left out."""
    rule, rng = jaccard.Rule(5, 80), random.Random(3)
    pivot, shared = words(rng, 100, 10**6), words(rng, 100, 10**6).split()
    near = [" ".join([*shared[:-1], f"own{i}"]) for i in range(2)]
    y = [*near, *(words(rng, 100, 10**6) for _ in range(30))]
    rows = [(0, b, True, pivot.encode(), t.encode()) for b, t in enumerate(y, 1)]
    pairs = spark.createDataFrame(rows, "a long, b long, wide boolean, x binary, y binary")
    schema = "a long, b long, linked boolean, size long, common long, differ array<long>, first array<int>, sketch array<long>"
    far = pairs.mapInArrow(jaccard.against_pivot(rule), schema).withColumn("label", F.col("b"))
    assert all(len(r.first) == r.size - -(-r.size * 80 // 100) + 1 for r in far.collect())
    assert sorted(r.b for r in jaccard.meeting(far).collect()) == [1, 2]
    again = pairs.select("a", "b", F.col("b").alias("label"), "x", "y").mapInArrow(jaccard.beyond_pivot(rule), "a long, b long, label long, size long, common long, sketch array<long>, outside array<long>")
    assert all(r.size - r.common == len(r.outside) == r.size for r in again.collect())


def test_outlines_tell_far_sets(spark):
    """Outlines never say more differences than there are; unrelated sets around a pivot are far without their texts."""
    rng, rule = np.random.default_rng(4), jaccard.Rule(5, 80)
    for n, m, common in ((1, 1, 0), (5, 900, 3), (200, 200, 190), (300, 280, 0), (3000, 2500, 1000)):
        x = rng.integers(0, 2**63, n + m - common, dtype=np.uint64)
        assert jaccard.least_differences(jaccard.outline(x[:n]), jaccard.outline(x[n - common :])) <= n + m - 2 * common
    sets = [rng.integers(0, 2**63, 300, dtype=np.uint64) for _ in range(2)]
    sets.append(np.concatenate([sets[0][:290], sets[1][:10]]))
    rows = [(0, b, wide, 300, 300, jaccard.outline(sets[0]), jaccard.outline(sets[b])) for b in (1, 2) for wide in (True, False)]
    pairs = spark.createDataFrame(rows, "a long, b long, wide boolean, m long, n long, x binary, y binary")
    got = pairs.mapInArrow(jaccard.sifted(rule), "a long, b long, wide boolean, ask boolean, far boolean").collect()
    assert sorted((r.b, r.wide, r.ask, r.far) for r in got) == [(1, False, False, False), (1, True, False, True), (2, False, True, False), (2, True, True, False)]


def brute_classes(rows, rule):
    lower = {i: i + 32 for i in range(65, 91)}
    sets = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        sets[d] = {tuple(w[i : i + rule.words]) for i in range(max(len(w) - rule.words + 1, 1))} if w else set()
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= rule.part * len(sets[a] | sets[b]):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return sorted((d, len(s), root(d)) for d, s in sets.items())


@pytest.mark.parametrize("rule", [jaccard.Rule(3, 90), jaccard.Rule(5, 80)])
def test_jaccard_classes(spark, docs, empty, rule):
    rng = random.Random(3)
    base = words(rng, 150, 1000).split()
    rows = list(enumerate(texts()))
    for k in range(40):  # near copies, about half of which link with the first
        copy = list(base)
        for _ in range(k % 6):
            copy[rng.randrange(150)] = f"n{rng.randrange(10**6)}"
        rows.append((1000 + k, " ".join(copy)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard.classes(df, rule).collect()) == brute_classes(rows, rule)
    kept = jaccard.keep_one(df, rule)
    want = {c for _, n, c in brute_classes(rows, rule) if n} | {d for d, n, _ in brute_classes(rows, rule) if not n}
    assert sorted(r.doc_id for r in kept.collect()) == sorted(want)
    assert jaccard.classes(empty, rule).count() == 0


def test_keep_one_with_null_and_repeated_ids(spark):
    """Components with one component_id are still apart: each keeps a row."""
    rng = random.Random(11)
    a, b, c, d = (words(rng, 60, 1000) for _ in range(4))
    rows = [(None, a), (None, b), (7, c), (7, d), (9, a), (8, c)]
    kept = jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), jaccard.Rule(5, 80)).collect()
    assert collections.Counter(map(tuple, kept)) == collections.Counter(rows[:4])


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = {r.v: r.label for r in groups.components(links).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_components_of_chains_in_any_order(spark):
    """Least numbers at both ends meet in the middle, which is far from either."""
    ids = list(range(2, 400))
    random.Random(7).shuffle(ids)
    chains = [[0, *ids, 1], random.Random(8).sample(range(1000, 1300), 300)]
    links = spark.createDataFrame([x for c in chains for x in itertools.pairwise(c)], "a long, b long")
    got = {r.v: r.label for r in groups.components(links).collect()}
    assert got == {v: min(c) for c in chains for v in c}


ODD = ["", "  ", "ΑΣ ΣΑΣ. İstanbul", "a<|endoftext|>b <|startoftext|>", "it's WE'LL 'Sx", "日本語 テスト ０１２ ½", "x\x1cy \x1d z\x85w", "é ́a", "ﬀ ß ẞ Ǆ", "\U0001f600 🤷🏽‍♀️", "a\x00b", "x" * 3000]


def test_bpe_is_the_librarys(spark, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    rows = [(i, x) for i, x in enumerate([*ODD, *texts()])]
    out = bpe.encode_and_decode(spark.createDataFrame(rows, "doc_id long, text string").withColumn("DECODED", F.lit(1)), PATH)
    assert out.columns == ["doc_id", "text", "token_ids", "decoded"]
    for r in out.collect():
        ids = t.encode(r.text or "", add_special_tokens=False).ids
        assert list(r.token_ids) == ids
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert bpe.encode_and_decode(empty, PATH).count() == 0


def test_forced_cuts_are_never_inside_a_vocabulary_entry():
    e = bpe.encoder(PATH)
    of = {c: b for b, c in enumerate(e.symbol)}
    for token in itertools.islice(e.names.values(), 0, None, 97):
        if token.endswith(bpe.END) and len(token) > len(bpe.END):
            assert e.cuts(bytes(of[c] for c in token[: -len(bpe.END)])) == []


def test_token_shards(spark, docs, empty):
    path = shared_path(spark, "test-shards")
    more = docs.select("doc_id", "text").union(docs.select("doc_id", "text").limit(2)).union(spark.createDataFrame([(None, "none"), (-5, "minus")], "doc_id long, text string"))
    shards = sstable.write_shards(more, path, PATH, 2)
    got = sstable.read_shards(shards, path).orderBy("start").collect()
    e, start, last = bpe.encoder(PATH), 0, None
    text = dict(enumerate(texts())) | {None: "none", -5: "minus"}
    for r in got:
        ids = np.frombuffer(bytes(r.ids), "<u4").tolist()
        assert (r.start, ids) == (start, [*e.encode(text[r.doc_id] or "").tolist(), 2])
        key = sstable.key_of(r.doc_id)
        assert last is None or last <= key
        start, last = start + len(ids), key
    assert len(got) == len(texts()) + 4
    hits = sum(len(sstable.lookup(spark, path, s.shard, 7)) for s in shards.collect())
    assert hits == sum(r.doc_id == 7 for r in got)
    assert not any(sstable.lookup(spark, path, s.shard, 10**9) for s in shards.collect())
    assert sstable.token_store(empty, PATH, 2).count() == 0


@pytest.mark.parametrize("how", [{}, {"palette": True}, {"cache_bits": 4}, {"copies": True}, {"copies": True, "cache_bits": 6}, {"green": True}])
def test_webp_round_trips(how):
    rng = np.random.default_rng(0)
    for shape, colours in itertools.product(((1, 1), (3, 5), (17, 23), (64, 9)), (1, 2, 16, 250)):
        pixels = rng.integers(0, 2**32, colours, dtype=np.uint32)[rng.integers(0, colours, shape)]
        extra = [{}]
        if "palette" not in how:
            n = (-(-shape[0] // 4), -(-shape[1] // 4))
            extra.append({"modes": rng.integers(0, 14, n), "elements": rng.integers(0, 2**32, n, dtype=np.uint32)})
        for more in extra:
            assert (webp.decode(webp.encode(pixels, **how, **more)) == pixels).all()


def test_media_have_back_references(monkeypatch):
    """Texts with repeats are written with back-references, near and far, and read back."""
    rng = random.Random(2)
    line = words(rng, 30, 10**6)
    for text in (line * 9, "a" * 9000, "\n".join(words(rng, 12, 900) for _ in range(400)), line + words(rng, 3000, 10**6) + line, "ab" * 700, "x", line):
        payload = media.payload_of(text)
        stored = media.to_media(payload)
        assert b"".join((x >> 8 & 255).astype(np.uint8).tobytes() for x in media.images(stored)) == payload
    repeated = media.payload_of(words(rng, 400, 10**6) * 2)
    pixels = np.frombuffer(repeated, np.uint8).astype(np.uint32).reshape(-1, 64) << 8 | np.uint32(webp.BLACK)
    stored = media.to_media(repeated)
    assert len(stored) < 0.6 * len(webp.encode(pixels))
    seen = []
    monkeypatch.setattr(webp, "read_green_copies", lambda *x: seen.append(x) or np.zeros(x[3], np.uint32))
    webp.decode(stored)
    assert seen


def test_media_columns(docs, empty):
    for r in media.read(media.store(docs)).collect():
        want = (r.text or "").encode()
        assert bytes(r.payload) == want + bytes(max(64 - len(want), -len(want) % 64))
    assert media.read(media.store(empty)).count() == 0


def test_neighbours_find_most(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1200, 16))
    x[700] = x[50]
    x[701] = x[50] * 2
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5050, [0.0] * 16), (5100, [float("nan")] * 16), (5150, [1.0]), (None, [1.0] * 16)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = collections.defaultdict(list)
    for r in neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 1200, 50):
        s = u[q] @ u.T
        s[q] = -9
        hit += len({v for v, _ in got[q]} & set(np.lexsort((np.arange(1200), -np.round(s, 12)))[:5].tolist()))
    assert hit >= 0.9 * 24 * 5
    assert [v for v, _ in got[50]][:2] == [700, 701]
    assert set(got) == set(range(0, 1200, 50))
    assert neighbours.nearest(df.filter("vec_id = 0")).count() == 0


def test_quality_on_held_out(spark, empty):
    rng = random.Random(2)
    good = [(i, words(rng, 60) + ".", 1) for i in range(300)]
    bad = [(1000 + i, (words(rng, 60).upper().replace(" ", "!! ")), 0) for i in range(300)]
    df = spark.createDataFrame([*good, *bad, (5000, None, None), (5001, "", None)], "doc_id long, text string, quality int")
    model = quality.fit(df, df.filter("quality is not null").select("doc_id", "quality").withColumn("toxic", F.lit(0)))
    out = quality.score(df, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    test = [r for r in out if r.held and r.quality is not None]
    assert sum(r.predicted == r.quality for r in test) >= 0.97 * len(test) > 50
    assert all(0 <= r.score <= 1 for r in out) and len(out) == 602
    none = quality.fit(empty, df.select("doc_id", "quality").limit(0))
    assert none is None and [r.score for r in quality.score(df.limit(1), none).collect()] == [0.5]


def test_surrogates(spark, empty):
    text = "Mr. John Smith met Frau Müller, Mr John Smith. Call +1 (017) 555-7713; card 4111 1111 1111 1111; UND.34@MAIL7.EXAMPLE.COM und.34@mail7.example.com; 10.0.0.1 Apache 2.0. v1.2.3.4.5 госпожа Иванова"
    rows = [(1, text), (1, text), (2, None), (None, ""), (3, "clean text, version 3."), (4, "10.0.0.1 +1 (017) 555-7713")]
    out = pii.replace(spark.createDataFrame(rows, "doc_id long, text string"), count="n").collect()
    got = {r.doc_id: r.text for r in out}
    assert got[2] is None and got[None] == "" and got[3] == rows[4][1]
    new = got[1]
    for secret in ("Smith", "Müller", "555-7713", "4111", "und.34", "10.0.0.1", "Иванова"):
        assert secret not in new
    assert re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}; card (\d{4} ){3}\d{4}; ", new)
    mails = re.findall(r"\S+@\S+\.[A-Za-z]+", new)
    assert mails[0].lower() == mails[1] and mails[0].isupper()
    men = re.findall(r"Mr\.? (\w+ \w+)", new)
    assert len(men) == 2 and men[0] == men[1] and men[0].split()[0] in pii.GIVEN["male", "latin"]
    assert re.search("госпожа [А-Я][а-я]+$", new) and "v1.2.3.4.5" in new
    assert got[4].split()[0] in new
    assert pii.replace(empty).count() == 0


def test_surrogates_are_distinct(spark):
    # one-word names have 4,096 first derivations, so some of 3,000 collide
    rows = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat_ws("", F.lit("Frau "), F.initcap(F.concat(F.lit("n"), F.translate(F.col("id").cast("string"), "0123456789", "abcdefghij")))).alias("text"))
    named = pii.derive(pii.entities(rows)).collect()
    assert len({r.surrogate for r in named}) == len(named) == 3000
    assert max(r.attempt for r in named) > 0
    new = pii.replace(rows).select("text").distinct().count()
    assert new == 3000


def test_luhn_is_kept(spark):
    df = spark.createDataFrame([("4111111111111111",), ("4111111111111112",)], "c string")
    s = df.select("c", pii.surrogate(F.lit("card"), F.col("c"), F.lit(0)).alias("s")).withColumn("ok", pii.luhn_sum(F.col("s")) % 10 == 0)
    assert df.select(pii.luhn_sum(F.col("c")) % 10).first()[0] == 0
    assert [r.ok for r in s.orderBy("c").collect()][0] is True


def test_budgets_go_to_siblings_first(spark):
    leaves = spark.createDataFrame([("a", "x", "s1", 10), ("a", "x", "s2", 1000), ("a", "y", "s3", 1000), ("b", "x", "s4", 1000)], "domain string, language string, source_leaf string, tokens long")
    got = {r.source_leaf: r.leaf_budget for r in mixing.allocate(leaves, 400.0, 1, {}).collect()}
    assert got == {"s1": 10, "s2": 90, "s3": 100, "s4": 200}


def test_mixture_takes_its_budget(docs, empty):
    out = mixing.mix(docs, budget_share=0.5)
    rows = out.collect()
    assert len(rows) == len(texts())
    total = sum(r.n_tokens for r in rows)
    taken = sum(r.n_tokens * r.copies + r.prefix_tokens for r in rows)
    assert total // 2 - 30 <= taken <= total // 2
    assert all(0 <= r.prefix_tokens <= r.n_tokens for r in rows)
    assert mixing.mix(empty).count() == 0


def test_mixture_clashes_and_epochs(docs):
    """Names that the operator uses inside stay the user's; each epoch has an order of its own."""
    clash = ["prefix", "edge", "bucket", "ahead", "order", "id", "doc", "tokens", "weight", "room"]
    out = mixing.mix(docs.withColumns({c: F.lit("x") for c in clash}), budget_share=0.5)
    assert {out.select(c).distinct().first()[0] for c in clash} == {"x"}
    assert len({mixing_order(docs, epoch) for epoch in range(3)}) == 3


def mixing_order(docs, epoch):
    order = mixing.order_hash(17, F.col("doc_id").cast("string"), F.lit(epoch))
    return tuple(r.doc_id for r in docs.orderBy(order).select("doc_id").collect())


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    base = words(rng, 150, 1000)
    rows = [(i, words(rng, 150, 1000) + ".", "en", f"src{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, base.replace("w1 ", "w2 ", i), "en", "src1", 1) for i in range(3)] + [(200 + i, words(rng, 60).upper().replace(" ", "!! "), "en", "src2", 1) for i in range(40)]
    rows[0] = (0, rows[0][1] + " mail me@example.com", "en", "src0", 1)
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(r[0], int(r[0] < 200)) for r in rows], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    d = spark.read.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r.doc_id for r in df.collect()}
    fine = corpus_pipeline.quality_classifier(spark, d, str(tmp_path))
    assert fine.columns == d.columns and ids(fine) == {r[0] for r in rows if r[0] < 200}
    one = corpus_pipeline.near_duplicates(spark, d, "")
    assert one.columns == d.columns and ids(one) == {r[0] for r in rows} - {101, 102}
    safe = corpus_pipeline.surrogates(spark, d, "")
    assert safe.columns == d.columns and "me@example.com" not in safe.filter("doc_id = 0").first().text
    mixed = corpus_pipeline.mixture(spark, d, "")
    assert mixed.columns == d.columns and 0 < mixed.count() < len(rows)
    ends = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in ends} <= ids(one) and all(r.n_tokens == len(r.token_ids) for r in ends)


def test_surrogates_keep_columns_of_any_name(spark):
    own = ["_id", "_found", "_gaps", "_later"]
    rows = spark.createDataFrame([(1, "to Ann@example.org"), (None, None)], "doc_id long, text string").withColumns({c: F.lit("x") for c in own})
    got = pii.replace(rows).collect()
    assert all(r[c] == "x" for r in got for c in own) and len(got) == 2
    assert {r.text is None for r in got} == {True, False} and all("Ann@" not in (r.text or "") for r in got)


def test_mixing_moves_no_texts(spark, docs):
    """The table of leaves is small, so documents are joined with it where they stand."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "65536")
    try:
        plan = mixing.mix(docs.select("doc_id", "text", "lang", "source"))._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
