"""Conversation structure repair as a lightest derivation.

Rows of a conversation are kept, given another role, deleted, or stand beside inserted turns, so
that the initials of the roles read ``(s?(ua)+)?``. Items ``at(i, q)`` say that the first i rows
are settled and the automaton of that pattern is in state q. Each edit is a deduction from one
item to the next; its weight function adds a cost and a letter, so it is superior (never less than
what it is applied to) and monotone in (cost, audit): equal costs have audits of which none begins
another, since a longer one would hold more insertions and cost more. Knuth's agenda pops the least
item first, and an item popped once is final.

A conversation of any length is cut into pieces of at most ``PIECE`` rows. A piece derives
``span(k, q, q')`` for each pair of states; ``at(k, q)`` and ``span(k, q, q')`` together give
``at(k + 1, q')`` by the same agenda, up to the goal.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cellframe.llm.shared import Scratch, append_columns, small_batches

#: White space of words, as everywhere in this subpackage.
SPACE = " \t\n\x0b\x0c\r"
PIECE_BITS = 9
PIECE = 1 << PIECE_BITS
KEEP, REROLE, DELETE, INSERT, CUT_SHORT = 0, 3, 4, 3, 3
#: States: nothing yet, after s, after u, after a. A conversation may end in the first or the last.
START, SYSTEM, USER, ASSISTANT = range(4)
GOALS = (START, ASSISTANT)
STEPS = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (ASSISTANT, "u"): USER, (USER, "a"): ASSISTANT}
#: The role that an insertion or a new role has to be in each state.
NEXT_ROLE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "c"
LEGAL = ("su", "ua", "au")
MOST = (1 << 63) - 1

Weight = tuple[int, str]
Rules = Callable[[int, int], list[tuple[int, int, int, str]]]


def lightest(start: int, length: int, rules: Rules, goals: tuple[int, ...]) -> tuple[dict[int, Weight], dict]:
    """Weights of the items at(length, q) for q of ``goals``, from the axiom at(0, start).

    ``rules(i, q)`` gives the deductions from at(i, q): rows settled by it, next state, cost and
    letters. Also returned: for each final item the one that it was deduced from and by what letters.
    """
    agenda: list = [(0, "", 0, start, None, "")]
    final: dict[tuple[int, int], Weight] = {}
    source: dict = {}
    wanted = set(goals)
    while agenda and wanted:
        cost, audit, i, q, came, letters = heapq.heappop(agenda)
        if (i, q) in final:
            continue
        final[i, q], source[i, q] = (cost, audit), (came, letters)
        if i == length:
            wanted.discard(q)
        for step, to, more, said in rules(i, q):
            if (i + step, to) not in final:
                heapq.heappush(agenda, (cost + more, audit + said, i + step, to, (i, q), said))
    return {q: final[length, q] for q in goals if (length, q) in final}, source


def edits(rows: list[tuple[str, str]], i: int, q: int) -> list[tuple[int, int, int, str]]:
    """Deductions from at(i, q) over rows of (kind, initial)."""
    role = NEXT_ROLE[q]
    out = [(0, STEPS[q, role[0]], INSERT, "I")]
    if i < len(rows):
        kind, initial = rows[i]
        out.append((1, q, DELETE, "D"))
        if kind in (SOUND, TRUNCATED):
            extra = CUT_SHORT if kind == TRUNCATED else 0
            if (q, initial) in STEPS:
                out.append((1, STEPS[q, initial], KEEP + extra, "K"))
            out.append((1, STEPS[q, role[0]], REROLE + extra, "R"))
    return out


def spans(rows: list[tuple[str, str]]) -> list[tuple[int, int, int, str]]:
    """The items span(q, q') of a piece: both states, cost and audit."""
    every = (START, SYSTEM, USER, ASSISTANT)
    return [(q, to, *w) for q in every for to, w in lightest(q, len(rows), partial(edits, rows), every)[0].items()]


def through(pieces: list[list[tuple[int, int, int, str]]]) -> tuple[int, list[str]]:
    """Least cost of a conversation and the audit of each of its pieces."""
    by = [{q: [(1, to, c, a) for p, to, c, a in piece if p == q] for q in range(4)} for piece in pieces]
    ends, source = lightest(START, len(pieces), lambda k, q: by[k][q] if k < len(by) else [], GOALS)
    (cost, _), q = min((w, q) for q, w in ends.items())
    audits, item = [], (len(pieces), q)
    while item != (0, START):
        item, letters = source[item]
        audits.append(letters)
    return cost, audits[::-1]


def initial(role: Column) -> Column:
    return F.substring(role, 1, 1)


def trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(SPACE))


def damage(conversations: DataFrame) -> DataFrame:
    """Rows damaged by crc32(`conv_id:turn`) % 20, a null of any column written as one space:
    0 drops, 1 empties the text, 2 removes its sentence ends, 3 doubles the row, 4 makes its role
    user. Equal rows of a turn are one row with ``n``, their number."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    d, text, role = F.crc32(key) % 20, F.coalesce("text", space), F.coalesce("role", space)
    return (
        conversations.filter(d != 0)
        .select(
            F.col("conv_id").cast("long"),
            F.col("turn").cast("long"),
            F.when(d == 4, "user").otherwise(role).alias("role"),
            F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
            F.when(d == 3, 2).otherwise(1).alias("n"),
        )
        .groupBy("conv_id", "turn", "role", "text")
        .agg(F.sum("n").alias("n"))
    )


def with_kinds(rows: DataFrame) -> DataFrame:
    """``rows`` with ``kind``, the first fault that counts for a row; of n equal rows of a turn, those
    after the first are duplicates besides, unless blank. The earliest turn of each role and text
    is found by a partial aggregate, so that a line said everywhere is no hot group."""
    key = F.sha2(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", F.lit(":"), "text"), 256)
    rows = rows.withColumn("said", key)
    first = rows.groupBy("said").agg(F.min("turn").alias("first_turn"), F.bool_or(F.col("turn").isNull()).alias("in_null"))
    bare = trimmed(F.col("text"))
    seen = F.col("turn").isNotNull() & (F.col("in_null") | (F.col("turn") > F.col("first_turn")))
    kind = F.when(bare == "", BLANK).when(seen, DUPLICATE).when(F.substring(bare, -1, 1).isin(".", "!", "?"), SOUND).otherwise(TRUNCATED)
    return rows.join(first, "said").select("conv_id", "turn", "role", "text", "n", kind.alias("kind"))


def in_pieces(rows: DataFrame) -> DataFrame:
    """``rows`` in their order with ``at``, which grows along it, and ``piece``. A range partition
    deals out a long conversation; the beginning of the text splits turns with many rows."""
    rows = rows.repartitionByRange("conv_id", "turn", "role", F.substring("text", 1, 16)).sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.withColumn("at", F.monotonically_increasing_id()).withColumn("piece", F.shiftrightunsigned("at", PIECE_BITS))


SPAN = T.StructType([T.StructField("from_state", T.IntegerType()), T.StructField("to_state", T.IntegerType()), T.StructField("cost", T.LongType()), T.StructField("audit", T.StringType())])
PART = T.StructType([T.StructField("piece", T.LongType()), T.StructField("audit", T.StringType())])


def derive(rows: DataFrame) -> DataFrame:
    """For each conversation and piece the audit of its part of the cheapest derivation, and the
    conversation's ``cost``. What meets in a task is one letter a row, never texts."""
    letters = F.struct("at", "n", "kind", initial(F.col("role")).alias("initial"))
    pieces = rows.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(letters)).alias("rows"))

    def derive_pieces() -> Callable[[pa.RecordBatch], list]:
        def of(b: pa.RecordBatch) -> list:
            out = []
            for rows in b.column("rows").to_pylist():
                each: list[tuple[str, str]] = []
                for r in rows:
                    each += [(r["kind"], r["initial"])] + [(BLANK if r["kind"] == BLANK else DUPLICATE, r["initial"])] * (r["n"] - 1)
                out.append([dict(zip(("from_state", "to_state", "cost", "audit"), s, strict=True)) for s in spans(each)])
            return [out]

        return of

    spanned = append_columns(pieces, [T.StructField("spans", T.ArrayType(SPAN))], derive_pieces).drop("rows")
    whole = spanned.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("piece", "spans"))).alias("pieces"))

    def derive_whole() -> Callable[[pa.RecordBatch], list]:
        def of(b: pa.RecordBatch) -> list:
            costs, audits = [], []
            for pieces in b.column("pieces").to_pylist():
                cost, said = through([[(s["from_state"], s["to_state"], s["cost"], s["audit"]) for s in p["spans"]] for p in pieces])
                costs.append(cost)
                audits.append([{"piece": p["piece"], "audit": a} for p, a in zip(pieces, said, strict=True)])
            return [costs, audits]

        return of

    fields = [T.StructField("cost", T.LongType()), T.StructField("audits", T.ArrayType(PART))]
    return append_columns(whole, fields, derive_whole).select("conv_id", "cost", F.inline("audits"))


class Report:
    """The result row of one conversation, from its rows and audits as they stream by."""

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.count = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.turns, self.low, self.high, self.turn = 0, None, None, None
        self.illegal, self.before = 0, None
        self.cost, self.audit, self.left, self.state = 0, [], iter(""), START
        self.hash, self.begun = hashlib.sha256(), False

    def line(self, role: str, text: str) -> None:
        self.hash.update((f"\n{role}:{text}" if self.begun else f"{role}:{text}").encode())
        self.begun, self.state = True, STEPS[self.state, role[0]]

    def edit(self) -> str | None:
        """The letter for the next row; insertions before it are carried out."""
        for letter in self.left:
            if letter != "I":
                return letter
            self.line(NEXT_ROLE[self.state], "")
        return None

    def piece(self, cost: int, audit: str) -> None:
        self.edit()
        self.cost, self.left = cost, iter(audit)
        self.audit.append(audit)

    def row(self, turn: int | None, role: str, text: str, n: int, kind: str) -> None:
        if turn is not None and turn != self.turn:
            self.turn, self.turns, self.high = turn, self.turns + 1, turn
            self.low = turn if self.low is None else self.low
        first = role[:1]
        self.illegal += (self.before is not None and self.before + first not in LEGAL) + (n - 1)
        self.before = first
        if kind != SOUND:
            self.count[kind] += 1
        self.count[BLANK if kind == BLANK else DUPLICATE] += n - 1
        for _ in range(n):
            letter = self.edit()
            if letter != "D":
                self.line(role if letter == "K" else NEXT_ROLE[self.state], text)

    def result(self) -> tuple:
        self.edit()
        gaps = 0 if self.low is None else min(MOST, self.high - self.low + 1 - self.turns)
        c = self.count
        return self.conv_id, gaps, c[BLANK], c[DUPLICATE], c[TRUNCATED], self.illegal, self.cost, "".join(self.audit), self.hash.hexdigest()


RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Reports of the conversations in rows sorted by conversation, piece and place; one row at a time."""
    names = [field.split()[0] for field in RESULT.split(", ")]
    schema = pa.schema([(x, pa.string() if x in ("audit", "repaired_sha256") else pa.int64()) for x in names])
    now, done, held = None, [], 0
    for b in batches:
        for conv_id, piece, at, turn, role, text, n, kind, cost, audit in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if piece == -1:
                if now is not None:
                    done.append(now.result())
                    held += len(done[-1][7]) + 100
                now = Report(conv_id)
            elif at == -1:
                now.piece(cost, audit)
            else:
                now.row(turn, role, text, n, kind)
            if held > 1 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
                done, held = [], 0
    if now is not None:
        done.append(now.result())
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)


def repair(conversations: DataFrame) -> DataFrame:
    """Each conversation damaged, judged and repaired at least cost; one row for every conv_id.

    Rows go by turn (null first), ties by role and text in byte order, after the damage. Null role
    and text are one space, whose initial is not legal, nor is that of an empty role. Equal rows of
    a turn are duplicates but for the first. A null conv_id is a conversation by itself. An empty
    table gives no rows; other columns are ignored. Texts of any length stream through the hash
    one at a time. A conversation's lines are hashed in order, hence by one task, which holds one
    row and the audit (a letter a row); everything before that is dealt out by rows. ``gaps`` above
    the largest long is written as that.
    """
    scratch = Scratch(conversations.sparkSession)
    small_batches(conversations.sparkSession)
    rows = scratch.write(in_pieces(with_kinds(damage(conversations))), "conversation-rows")
    none = {c: F.lit(None).cast(t) for c, t in (("turn", "long"), ("role", "string"), ("text", "string"), ("n", "long"), ("kind", "string"))}
    empty = {"cost": F.lit(None).cast("long"), "audit": F.lit(None).cast("string")}
    order = ["conv_id", "piece", "at", *none, *empty]
    heads = conversations.select(F.col("conv_id").cast("long")).distinct().withColumns({"piece": F.lit(-1).cast("long"), "at": F.lit(-1).cast("long")} | none | empty)
    audits = derive(rows).withColumns({"at": F.lit(-1).cast("long")} | none)
    stream = heads.select(order).unionByName(audits.select(order)).unionByName(rows.withColumns(empty).select(order))
    return stream.repartition("conv_id").sortWithinPartitions("conv_id", "piece", "at").mapInArrow(reports, RESULT)


def sql() -> str:
    """DuckDB SQL for repair(): the same costs by a recursion over rows in place of the agenda."""
    from cellframe.llm.shared import crc32_sql

    return f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    {crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS d FROM conversations
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM src, unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) WHERE d <> 0
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i,
    rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare, substr(role, 1, 1) AS ini FROM damaged
), judged AS (
  SELECT *, CASE WHEN bare = '' THEN 'b' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
    WHEN right(bare, 1) IN ('.', '!', '?') THEN 'c' ELSE 't' END AS kind,
    lag(ini) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM placed
), steps(q, sym, q2) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)
), inserts(q, q2, cost, audit, lines) AS (
  SELECT q, q, 0, '', []::VARCHAR[] FROM (VALUES (0), (1), (2), (3)) t(q)
  UNION ALL SELECT q, q2, {INSERT}, 'I', [CASE sym WHEN 'u' THEN 'user:' ELSE 'assistant:' END] FROM steps WHERE sym <> 's'
  UNION ALL SELECT q, 3, {2 * INSERT}, 'II', ['user:', 'assistant:'] FROM (VALUES (0), (1)) t(q)
), convs AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)
), numbered AS (SELECT convs.c, judged.* FROM judged JOIN convs ON judged.conv_id IS NOT DISTINCT FROM convs.conv_id
), walk AS (
  SELECT c, 0::BIGINT AS i, q2 AS q, cost::BIGINT AS cost, audit, lines FROM convs, inserts WHERE q = 0
  UNION ALL
  SELECT c, i, q, min({{'cost': cost, 'audit': audit}}).cost, min({{'cost': cost, 'audit': audit}}).audit, arg_min(lines, {{'cost': cost, 'audit': audit}})
  FROM (
    SELECT w.c, w.i + 1 AS i, n.q2 AS q, w.cost + e.cost + n.cost AS cost, w.audit || e.letter || n.audit AS audit, w.lines || e.line || n.lines AS lines
    FROM walk w JOIN (
      SELECT c, i, 'D' AS letter, p AS q, p AS q2, {DELETE} AS cost, []::VARCHAR[] AS line FROM numbered, (VALUES (0), (1), (2), (3)) t(p)
      UNION ALL SELECT c, i, 'K', q, q2, {CUT_SHORT} * (kind = 't')::INT, [role || ':' || text] FROM numbered JOIN steps ON sym = ini WHERE kind IN ('c', 't')
      UNION ALL SELECT c, i, 'R', q, q2, {REROLE} + {CUT_SHORT} * (kind = 't')::INT, [CASE sym WHEN 'u' THEN 'user' ELSE 'assistant' END || ':' || text]
        FROM numbered, steps WHERE kind IN ('c', 't') AND sym <> 's'
    ) e ON e.c = w.c AND e.i = w.i + 1 AND e.q = w.q JOIN inserts n ON n.q = e.q2
  ) GROUP BY c, i, q
), facts AS (
  SELECT convs.c, convs.conv_id, count(i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (kind = 'b') AS blank, count(*) FILTER (kind = 'd') AS duplicate, count(*) FILTER (kind = 't') AS truncated,
    count(*) FILTER (before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM convs LEFT JOIN numbered ON numbered.c = convs.c GROUP BY convs.c, convs.conv_id
)
SELECT f.conv_id, f.gaps::BIGINT AS gaps, f.blank, f.duplicate, f.truncated, f.illegal, min({{'cost': cost, 'audit': audit}}).cost AS cost,
  min({{'cost': cost, 'audit': audit}}).audit AS audit, sha256(coalesce(array_to_string(arg_min(lines, {{'cost': cost, 'audit': audit}}), chr(10)), '')) AS repaired_sha256
FROM facts f JOIN walk w ON w.c = f.c AND w.i = f.n WHERE w.q IN (0, 3)
GROUP BY f.conv_id, f.gaps, f.blank, f.duplicate, f.truncated, f.illegal"""
