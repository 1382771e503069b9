"""Conversation repair and the prefix trie against brute force and their SQL, on awkward tables."""

import collections
import functools
import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from cellframe.llm import repair, trie

SCHEMA = "conv_id long, turn long, role string, text string"
CLASH = ["n", "at", "piece", "kind", "said", "i", "part", "node", "depth", "weight", "words", "cost", "audit"]


def table():
    """Conversations with nulls, ties, repeated rows, blank, empty and very long texts, odd roles."""
    rng = random.Random(4)
    says = ["Hi there.", "What is it?", "no end", "", " \t\n", "Fine!", "a b  c.", "tail. \n", "ß é 語.", "x" * 300_000 + "."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "u"]
    rows = []
    for c in [*range(60), 200, 201, 399, -3, -20, None]:
        for t in range(rng.choice([1, 2, 3, 5, 8])):
            role = rng.choice(roles) if rng.random() < 0.2 else ("user", "assistant")[t % 2]
            text = None if rng.random() < 0.05 else rng.choice(says[:9])
            rows.append((c, None if rng.random() < 0.1 else t + (5 if rng.random() < 0.1 else 0), role, text))
            if rng.random() < 0.1:
                rows.append(rows[-1])
    rows += [(500, t, ("user", "assistant")[t % 2], f"turn {t % 7}.") for t in range(600)]
    rows += [(501, 0, "user", says[9]), (501, 1, "assistant", says[9][:-1])]
    # a family whose conversations begin alike, and copies of whole ones
    rows += [(c, t, ("user", "assistant")[t % 2], f"common {t}.") for c in range(600, 640) for t in range(3 + c % 3)]
    rows += [(700, t, "user", "x") for t in range(2)] + [(719, 0, "user", "x"), (731, 0, None, None)]
    return rows


def crc(text):
    return zlib.crc32(text.encode())


def brute_repair(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        by[c]
        d = crc(f"{' ' if c is None else c}:{' ' if t is None else t}") % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d:
            row = (t is not None, t, "user" if d == 4 else role, "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text)
            by[c] += [row] * (2 if d == 3 else 1)
    out = []
    for c, got in by.items():
        got.sort(key=lambda r: (r[0], r[1] or 0, r[2].encode(), r[3].encode()))
        kinds, seen = [], set()
        for _, _, role, text in got:
            bare = text.strip(repair.SPACE)
            kinds.append("b" if not bare else "d" if (role, text) in seen else "c" if bare[-1] in ".!?" else "t")
            seen.add((role, text))
        inits = [r[2][:1] for r in got]
        turns = [r[1] for r in got if r[1] is not None]

        @functools.cache
        def best(i, q, left=2, got=got, kinds=kinds, inits=inits):
            """From the end: least (cost, audit, lines) of what is left, at most two insertions before each row."""
            found = [(0, "", ())] if i == len(got) and q in "0a" else []
            follow = {"0": "su", "s": "u", "u": "a", "a": "u"}[q]
            role = "assistant" if q == "u" else "user"
            if left:
                w = best(i, role[0], left - 1)
                found.append((w[0] + 3, "I" + w[1], (f"{role}:", *w[2])))
            if i < len(got):
                w = best(i + 1, q)
                found.append((w[0] + 4, "D" + w[1], w[2]))
                if kinds[i] in "ct":
                    more = 3 * (kinds[i] == "t")
                    if inits[i] and inits[i] in follow:
                        w = best(i + 1, inits[i])
                        found.append((w[0] + more, "K" + w[1], (f"{got[i][2]}:{got[i][3]}", *w[2])))
                    w = best(i + 1, role[0])
                    found.append((w[0] + 3 + more, "R" + w[1], (f"{role}:{got[i][3]}", *w[2])))
            return min(found, default=(10**9, "", ()))

        for i in range(len(got), -1, -50):
            for q in "0sua":
                best(i, q)
        cost, audit, lines = best(0, "0")
        pairs = sum(a + b not in ("su", "ua", "au") for a, b in zip(inits, inits[1:], strict=False))
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((c, gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), pairs, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return out


def brute_trie(rows):
    by = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            by[c].append((t is not None, t or 0, (role or "").encode(), (text or "").encode()))
    turns = {c: [r[2:] for r in sorted(got)] for c, got in by.items()}
    rebuilt = {}
    for c in turns:
        h, base = crc(str(c)) % 4, c - int(c / 20) * 20
        rebuilt[c] = tuple(turns.get(c - base, [])[:h] + turns[c][h:])
    nodes = collections.defaultdict(list)
    for c, seq in rebuilt.items():
        for d in range(len(seq) + 1):
            nodes[seq[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for key in nodes:
        if key:
            kids[key[:-1]] += 1
    for key, members in nodes.items():
        own = (len(members) - 1) * len(key[-1][1].split()) if key else 0
        for d in range(len(key) + 1):
            leaves[key[:d]] += kids[key] == 0
            saved[key[:d]] += own
    out = []
    for key, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(rebuilt[c]) == len(key))
        parent = min(nodes[key[:-1]]) if key else None
        out.append((min(members), len(key), parent, len(members), kids[key], leaves[key], saved[key], hashlib.sha256(ends.encode()).hexdigest()))
    return out


def ordered(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: [(x is None, x) for x in r])


@pytest.fixture(scope="module")
def conversations(spark):
    df = spark.createDataFrame(table(), SCHEMA).withColumns({c: F.lit("x") for c in CLASH}).repartition(5).cache()
    df.count()
    return df


def by_sql(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
    con.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", rows)
    out = con.execute(sql)
    names = [d[0] for d in out.description]
    return names, out.fetchall()


def test_repair(conversations):
    got = repair.repair(conversations)
    rows = got.collect()
    assert ordered(rows) == ordered(brute_repair(table()))
    few = [r for r in table() if r[0] != 500]
    names, by = by_sql(few, repair.sql())
    assert names == got.columns
    assert ordered(by) == ordered(r for r in rows if r.conv_id != 500)


def test_pieces_of_one_derivation():
    """Costs and audits don't depend on where a conversation is cut."""
    rng = random.Random(8)
    for _ in range(40):
        rows = [(rng.choice("cccctbd"), rng.choice(["u", "a", "s", "x", "", "u", "a"])) for _ in range(rng.randrange(1, 25))]
        cost, audit = repair.through([repair.spans(rows)])
        for size in (1, 3, 7):
            parts = [repair.spans(rows[k : k + size]) for k in range(0, len(rows), size)]
            c, said = repair.through(parts)
            assert (c, "".join(said)) == (cost, "".join(audit))
            assert [sum(x != "I" for x in s) for s in said] == [len(rows[k : k + size]) for k in range(0, len(rows), size)]


def test_trie(conversations):
    got = trie.trie(conversations)
    rows = got.collect()
    assert ordered(rows) == ordered(brute_trie(table()))
    few = [r for r in table() if r[0] != 500]
    names, by = by_sql(few, trie.sql())
    assert names == got.columns
    assert ordered(by) == ordered(trie.trie(conversations.filter("conv_id is null or conv_id <> 500")).collect())


def test_no_conversations(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert repair.repair(none).count() == trie.trie(none).count() == 0
    gone = next(c for c in range(1000) if crc(f"{c}:0") % 20 == 0)
    (row,) = repair.repair(spark.createDataFrame([(gone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row) == (gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    alone = next(c for c in range(1, 1000) if c % 20 and crc(str(c)) % 4 == 3)
    (root,) = trie.trie(spark.createDataFrame([(alone, 0, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(root) == (alone, 0, None, 1, 0, 1, 0, hashlib.sha256(str(alone).encode()).hexdigest())
