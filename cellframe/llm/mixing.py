"""Mixing sources to target weights.

Leaves of a domain-language-source tree get shares of a token budget. A budget goes down the
tree level by level: the children of a node share its budget by weight, none beyond what its
subtree can give (its tokens times the allowed epochs). What a child cannot take goes to its
siblings; only what the whole subtree cannot take is left to the ancestor's other children,
since a node's own budget was bounded by its subtree in the same way. A leaf's budget of some
whole epochs and a rest is then taken from seeded permutations of its documents, one for each
epoch: whole epochs, and of the next epoch a prefix by tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.llm.shared import whole_text, written

LEVELS = ("domain", "language", "source_leaf")
#: Hex digits of an order hash that say its bucket: only one bucket a leaf is ever sorted.
BUCKET_DIGITS = 4


def source_domain(source: Column, domains: tuple[str, ...]) -> Column:
    """Domain by the number that ends a source name, in turn; others are in the first."""
    n = F.try_to_number(F.regexp_extract(source, "([0-9]{1,6})$", 1), F.lit("999999"))
    which = F.coalesce(n.cast("int"), F.lit(0)) % len(domains)
    return F.element_at(F.array(*[F.lit(d) for d in domains]), which + 1)


def token_count(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).cast("long")


def weight_of(key: Column, weights: dict[str, float]) -> Column:
    """A node's weight among its siblings; 1 where none is given."""
    out = F.lit(1.0)
    for k, w in weights.items():
        out = F.when(key == k, F.lit(float(w))).otherwise(out)
    return out


def is_full(parent: list[str], budget: str, capacity: str, weight: str, order: str) -> Column:
    """Whether a child takes all it can hold, filling up from the child soonest full.

    Children stand in order of capacity over weight. One is full when its capacity is at most
    its share, by weight, of what those before it have left.
    """
    w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    by = w.orderBy(F.col(capacity) / F.col(weight), F.col(order))
    before = F.coalesce(F.sum(capacity).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum(weight).over(by.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    return F.col(capacity) * rest <= F.col(weight) * (F.col(budget) - before)


def allocate(leaves: DataFrame, budget: float, epochs: int, weights: dict[str, dict[str, float]]) -> DataFrame:
    """``leaves`` (a row for each domain, language and source_leaf, with ``tokens``) with
    ``leaf_budget`` in whole tokens. The table has one row a leaf, not a document."""
    tree = leaves.withColumn("room", F.col("tokens").cast("double") * epochs)
    given: DataFrame | None = None
    for depth, level in enumerate(LEVELS):
        parent = list(LEVELS[:depth])
        nodes = tree.groupBy(*parent, level).agg(F.sum("room").alias("room"))
        nodes = nodes.withColumn("weight", weight_of(F.col(level), weights.get(level, {})))
        if given is None:
            total = F.sum("room").over(Window.partitionBy(F.lit(0)))
            nodes = nodes.withColumn("from_above", F.least(F.lit(float(budget)), total))
        else:
            nodes = nodes.join(given, parent)
        nodes = nodes.withColumn("full", is_full(parent, "from_above", "room", "weight", level))
        # the children that are not full share what is left by weight
        w = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
        heavy = F.sum(F.when(~F.col("full"), F.col("weight"))).over(w)
        part = (F.col("from_above") - F.coalesce(F.sum(F.when(F.col("full"), F.col("room"))).over(w), F.lit(0.0))) * F.col("weight") / heavy
        got = F.when(F.col("full"), F.col("room")).otherwise(F.floor(part).cast("double"))
        given = nodes.select(*parent, level, got.alias("from_above"))
    return leaves.join(given, list(LEVELS)).withColumn("leaf_budget", F.col("from_above").cast("long")).drop("from_above")


def mix(
    docs: DataFrame,
    budget_share: float = 0.6,
    epochs: int = 4,
    seed: int = 17,
    domains: tuple[str, ...] = ("web", "books", "code", "forum"),
    weights: dict[str, dict[str, float]] | None = None,
) -> DataFrame:
    """``docs`` with ``domain``, ``language``, ``source_leaf``, ``n_tokens``, ``copies`` (whole
    epochs), ``prefix_tokens`` (tokens taken in the last, partial epoch: all of a document
    inside the prefix, the start of the one that crosses its end, 0 beyond) and ``taken``.

    The budget is ``budget_share`` of all tokens. Each epoch of a leaf has an order of its own,
    since its number is in the seed. Null language, source or text count as empty; an empty text
    has 0 tokens and is taken if it stands inside the prefix; a leaf without tokens gets
    nothing. Equal documents count each for itself; rows with one doc_id and text tie and are
    taken in any order. Long texts are counted whole. An empty table gives an empty result. A
    column that has one of the new names is replaced; no other name clashes.

    The documents are scanned once and written with their leaves. Only sums go through a
    shuffle: tokens by leaf and by bucket of the order hash, and documents only if the table of
    leaves is too large for Spark to broadcast. Rows are sorted in the one bucket of each leaf in
    which its prefix ends.
    """
    weights = WEIGHTS if weights is None else weights
    new = [*LEVELS, "n_tokens", "copies", "prefix_tokens", "taken"]
    kept = [c for c in docs.columns if c.lower() not in new]
    rows = written(
        docs.select(
            F.struct(*[F.col(f"`{c}`") for c in kept]).alias("doc"),
            F.col("doc_id").cast("string").alias("id"),
            source_domain(whole_text("source"), domains).alias("domain"),
            whole_text("lang").alias("language"),
            whole_text("source").alias("source_leaf"),
            token_count(whole_text()).alias("n_tokens"),
        ),
        "leaves",
    )
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = leaves.agg(F.sum("tokens")).first()[0] or 0
    shared = allocate(leaves, float(int(total * budget_share)), epochs, weights)
    full_epochs = F.col("leaf_budget").cast("double") / F.greatest(F.col("tokens"), F.lit(1))
    shared = shared.withColumn("copies", F.when(F.col("tokens") > 0, F.floor(full_epochs)).otherwise(F.lit(0)).cast("int"))
    # a row a leaf, written, so that Spark knows the size before it plans joins with documents and moves no texts for a small one
    shared = written(shared.select(*LEVELS, "copies", (F.col("leaf_budget") - F.col("copies") * F.col("tokens")).alias("prefix")), "shares")
    order = order_hash(seed, F.col("id"), F.col("copies"))
    bucket = F.substring(order, 1, BUCKET_DIGITS)
    sums = rows.select(*LEVELS, "id", "n_tokens").join(shared, list(LEVELS)).groupBy(*LEVELS, "prefix", bucket.alias("bucket")).agg(F.sum("n_tokens").alias("tokens_in"))
    running = Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    edges = sums.withColumn("ahead", F.coalesce(F.sum("tokens_in").over(running), F.lit(0)))
    edge = F.max_by(F.struct("bucket", "ahead"), F.when(F.col("ahead") < F.col("prefix"), F.col("bucket")))
    leaf = written(shared.join(edges.groupBy(*LEVELS).agg(edge.alias("edge")), list(LEVELS)), "edges")
    placed = rows.join(leaf, list(LEVELS)).withColumn("order", order).withColumn("bucket", F.substring("order", 1, BUCKET_DIGITS))
    at_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    before = F.coalesce(F.col("bucket") < F.col("edge.bucket"), F.lit(False))
    inside = placed.filter(~at_edge).withColumns({"prefix_tokens": F.when(before, F.col("n_tokens")).otherwise(F.lit(0)).cast("long"), "taken": before})
    along = Window.partitionBy(*LEVELS).orderBy("order", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.col("edge.ahead") + F.coalesce(F.sum("n_tokens").over(along), F.lit(0))
    crossing = placed.filter(at_edge).withColumn("ahead", ahead)
    crossing = crossing.withColumns({"prefix_tokens": F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("prefix") - F.col("ahead"))).cast("long"), "taken": F.col("ahead") < F.col("prefix")})
    out = inside.unionByName(crossing, allowMissingColumns=True).withColumn("taken", F.col("taken") | (F.col("copies") > 0))
    return out.select("doc.*", *new)


def order_hash(seed: int, doc_id: Column, epoch: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id, F.lit("")), F.lit(":"), epoch.cast("string")))


#: Production weights by level: shares among siblings.
WEIGHTS = {
    "domain": {"web": 40.0, "books": 30.0, "code": 20.0, "forum": 10.0},
    "language": {"en": 50.0, "fr": 20.0, "de": 15.0, "es": 15.0},
}


def sql(budget_share: float = 0.6, epochs: int = 4, seed: int = 17, domains: tuple[str, ...] = ("web", "books", "code", "forum")) -> str:
    """The same result in SQL, for the columns doc_id, domain, language, source_leaf, n_tokens,
    copies and prefix_tokens."""
    case = lambda level: "CASE " + level + "".join(f" WHEN '{k}' THEN {w}" for k, w in WEIGHTS.get(level, {"": 1.0}).items()) + " ELSE 1.0 END"
    steps = []
    for depth, level in enumerate(LEVELS):
        cols = ", ".join(LEVELS[: depth + 1])
        part = "PARTITION BY " + ", ".join(LEVELS[:depth]) if depth else ""
        above = f"JOIN s{depth - 1} USING ({', '.join(LEVELS[:depth])})" if depth else f"CROSS JOIN (SELECT least(CAST(floor(CAST(coalesce(sum(tokens), 0) AS DOUBLE) * {budget_share}) AS DOUBLE), CAST(coalesce(sum(tokens), 0) AS DOUBLE) * {epochs}) AS from_above FROM leaves)"
        steps.append(f"""
n{depth} AS (SELECT *, CAST({case(level)} AS DOUBLE) AS weight FROM (SELECT {cols}, sum(CAST(tokens AS DOUBLE) * {epochs}) AS room FROM leaves GROUP BY {cols}) {above}),
f{depth} AS (SELECT *, room * sum(weight) OVER ({part} ORDER BY room / weight, {level} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
  <= weight * (from_above - coalesce(sum(room) OVER ({part} ORDER BY room / weight, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS is_full FROM n{depth}),
s{depth} AS (SELECT {cols}, CASE WHEN is_full THEN room ELSE floor((from_above - coalesce(sum(CASE WHEN is_full THEN room END) OVER ({part}), 0)) * weight
  / sum(CASE WHEN NOT is_full THEN weight END) OVER ({part})) END AS from_above FROM f{depth})""")
    names = ", ".join(f"'{d}'" for d in domains)
    return f"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS language, coalesce(source, '') AS source_leaf,
  list_extract([{names}], 1 + coalesce(try_cast(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,6}})$', 1), '') AS INTEGER), 0) % {len(domains)}) AS domain,
  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS n_tokens FROM documents),
leaves AS (SELECT domain, language, source_leaf, sum(n_tokens) AS tokens FROM d GROUP BY ALL),{",".join(steps)},
b AS (SELECT *, CASE WHEN tokens > 0 THEN CAST(floor(from_above / tokens) AS INTEGER) ELSE 0 END AS copies FROM leaves JOIN s2 USING (domain, language, source_leaf)),
o AS (SELECT d.*, b.copies, from_above - b.copies * tokens AS prefix,
  coalesce(sum(n_tokens) OVER (PARTITION BY domain, language, source_leaf
    ORDER BY md5('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || copies), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN b USING (domain, language, source_leaf))
SELECT doc_id, domain, language, source_leaf, n_tokens, copies, CAST(greatest(0, least(n_tokens, prefix - ahead)) AS BIGINT) AS prefix_tokens FROM o
"""
