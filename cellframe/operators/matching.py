"""Matching of surveys and scenes in time and space, and reconciliation of inventories."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cellframe.functions.geometry import Crs, bind
from cellframe.sources.shared import stored

DAYS = 5
#: Outlines of a group, at most 63.
GROUP = 32


def _edges(ring: Column) -> Column:
    """Edges of a closed ring of (x, y)."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("ax"), p["y"].alias("ay"), q["x"].alias("bx"), q["y"].alias("by")))


def _side(ax, ay, bx, by, px, py) -> Column:
    return (bx - ax) * (py - ay) - (by - ay) * (px - ax)


def _crosses(e, f) -> Column:
    """Segments e and f share a point (end points count)."""
    d1, d2 = _side(e["ax"], e["ay"], e["bx"], e["by"], f["ax"], f["ay"]), _side(e["ax"], e["ay"], e["bx"], e["by"], f["bx"], f["by"])
    d3, d4 = _side(f["ax"], f["ay"], f["bx"], f["by"], e["ax"], e["ay"]), _side(f["ax"], f["ay"], f["bx"], f["by"], e["bx"], e["by"])
    apart = (F.greatest(e["ax"], e["bx"]) < F.least(f["ax"], f["bx"])) | (F.greatest(f["ax"], f["bx"]) < F.least(e["ax"], e["bx"])) | (F.greatest(e["ay"], e["by"]) < F.least(f["ay"], f["by"])) | (F.greatest(f["ay"], f["by"]) < F.least(e["ay"], e["by"]))
    return ~apart & (d1 * d2 <= 0) & (d3 * d4 <= 0)


def _holds(ring: Column, p: Column) -> Column:
    """Whether a ring is around a point, by counting the edges to its right."""
    right = lambda e: ((e["ay"] > p["y"]) != (e["by"] > p["y"])) & (p["x"] < (e["bx"] - e["ax"]) * (p["y"] - e["ay"]) / F.nullif(e["by"] - e["ay"], F.lit(0.0)) + e["ax"])
    return F.size(F.filter(_edges(ring), right)) % 2 == 1


def intersects(a: Column, b: Column) -> Column:
    """Whether two polygons (rings of x, y; any shape) share a point."""
    cross = F.exists(_edges(a), lambda e: F.exists(_edges(b), lambda f: _crosses(e, f)))
    return cross | _holds(a, b[0]) | _holds(b, a[0])


def gap_days(a: list[Column], b: list[Column]) -> Column:
    """Least distance in days between any of two lists of dates."""
    return F.least(*[F.abs(F.datediff(x, y)) for x in a for y in b])


def clean_rings(rings: Column) -> Column:
    """Rings without points that lack a coordinate, repeat the one before, or close the ring; those
    with fewer than three points left go. A ring may cross itself: what it goes around an odd number
    of times is inside. Each ring is walked once: what is bound by a lambda isn't worked out again."""
    none = F.array().cast("array<struct<x:double,y:double>>")

    def add(kept: Column, p: Column) -> Column:
        skip = p["x"].isNull() | p["y"].isNull() | F.coalesce((F.get(kept, F.size(kept) - 1)["x"] == p["x"]) & (F.get(kept, F.size(kept) - 1)["y"] == p["y"]), F.lit(False))
        return F.when(skip, kept).otherwise(F.concat(kept, F.array(F.struct(p["x"].cast("double").alias("x"), p["y"].cast("double").alias("y")))))

    def opened(r: Column) -> Column:
        first, last = F.get(r, F.lit(0)), F.get(r, F.size(r) - 1)
        return F.when((F.size(r) > 1) & (first["x"] == last["x"]) & (first["y"] == last["y"]), F.slice(r, F.lit(1), F.size(r) - 1)).otherwise(r)

    return F.filter(F.transform(F.transform(rings, lambda r: F.aggregate(r, none, add)), opened), lambda r: F.size(r) >= 3)


def outlines(table: DataFrame, prefix: str) -> DataFrame:
    """``table`` with its clean outlines (``ring``, or ``rings`` of several parts) and their common box."""
    rings = F.col("rings") if "rings" in table.columns else F.array("ring")
    clean = bind(table, {f"{prefix}rings": F.coalesce(clean_rings(rings), F.array().cast("array<array<struct<x:double,y:double>>>"))}).drop("ring", "rings")
    side = lambda f, c: f(F.transform(f"{prefix}rings", lambda r: f(F.transform(r, lambda p: p[c]))))
    box = {f"{prefix}{c}{k}": side(f, c) for c in "xy" for k, f in ((0, F.array_min), (1, F.array_max))}
    return bind(bind(clean.filter(F.size(f"{prefix}rings") > 0), box), {f"{prefix}box": is_box(prefix)})


def is_box(prefix: str) -> Column:
    """Whether outlines are one ring of four points that is its own box: two such meet where their boxes do."""
    x0, x1, y0, y1 = (F.col(f"{prefix}{c}{k}") for c in "xy" for k in (0, 1))
    ring = F.col(f"{prefix}rings")[0]
    at = lambda n, x, y: (ring[n]["x"] == x) & (ring[n]["y"] == y)
    around = at(0, x0, y0) & at(1, x1, y0) & at(2, x1, y1) & at(3, x0, y1)
    return F.when((F.size(f"{prefix}rings") == 1) & (F.size(ring) == 4), around).otherwise(False)


def tile_level(prefix: str) -> Column:
    """The power of two that is at least four times the larger side of a box: it touches at most 2 x 2
    such tiles, and mostly one."""
    side = F.greatest(F.col(f"{prefix}x1") - F.col(f"{prefix}x0"), F.col(f"{prefix}y1") - F.col(f"{prefix}y0"))
    return F.when(side > 0, F.greatest(F.ceil(F.log2(side)) + 2, F.lit(-1000))).otherwise(F.lit(-1000)).cast("int")


def tiled(table: DataFrame, prefix: str, levels: list[int]) -> DataFrame:
    """``table`` with a row for each tile that its box touches, at its own level (``home``) and at each
    coarser one of ``levels``."""
    own = table.withColumn("_own", tile_level(prefix))
    at = own.withColumn("_level", F.explode(F.filter(F.array(*[F.lit(x) for x in levels]), lambda x: x >= F.col("_own"))))
    cell = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    across = at.withColumn("_tx", F.explode(F.sequence(cell(f"{prefix}x0"), cell(f"{prefix}x1"))))
    both = across.withColumn("_ty", F.explode(F.sequence(cell(f"{prefix}y0"), cell(f"{prefix}y1"))))
    return both.withColumn(f"{prefix}home", F.col("_own") == F.col("_level")).drop("_own")


def match_scenes(granules: DataFrame, products: DataFrame, days: int = DAYS) -> DataFrame:
    """match_surveys() with equal rows once: those of products that have site and scene in common. Only their
    rows are made distinct."""
    twice = F.count("*").over(Window.partitionBy("site", "scene")) > 1
    return match_surveys(granules, products.withColumn("_twice", twice), days, ["_twice"])


def _distinct_scenes(right: DataFrame, met: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``met`` of products; of those whose scene occurs twice, if they are told, distinct rows."""
    if "_twice" not in right.columns:
        return met(right)
    few, _ = stored(right.filter("_twice").drop("_twice").withColumn("_few", F.lit(True)), "twice")
    return met(right.filter("not _twice").drop("_twice")).unionByName(met(few).distinct())


def match_surveys(granules: DataFrame, products: DataFrame, days: int = DAYS, also: list[str] = ()) -> DataFrame:
    """Granules (site, granule, begin, end, ring or rings) and products (site, scene, ref, sec, ring or
    rings) that lie at most ``days`` apart and whose outlines meet; each pair once, with the columns ``also`` of
    products. Records without a usable outline match nothing.

    Where outlines repeat, so that fewer pairs of different outlines have a site in common than pairs of
    records have a site and bucket of days in common, outlines are compared first, each pair of them once, and
    records meet by outline and bucket; else records meet by bucket and tile.
    """
    rings = lambda t: F.col("rings") if "rings" in t.columns else F.array("ring")
    bucket = lambda c: F.floor(F.datediff(c, F.lit("1970-01-01").cast("date")) / days)
    # written once: read for their outlines, counts and rows
    left, _ = stored(granules.select("site", "granule", "begin", "end", F.xxhash64(rings(granules)).alias("_h"), rings(granules).alias("rings")), "granules")
    right, _ = stored(products.select("site", "scene", *also, "ref", "sec", F.xxhash64(rings(products)).alias("_h"), rings(products).alias("rings")), "products")
    near = F.array_distinct(F.flatten(F.array(*[F.array(bucket(F.col(c)) - 1, bucket(F.col(c)), bucket(F.col(c)) + 1) for c in ("begin", "end")])))
    left = left.withColumn("_gb", F.filter(near, lambda b: b.isNotNull()))
    right = right.withColumn("_pb", F.filter(F.array_distinct(F.array(bucket(F.col("ref")), bucket(F.col("sec")))), lambda b: b.isNotNull()))
    shapes = [t.select("site", "_h", "rings").distinct() for t in (left, right)]
    count = lambda t, by, n: t.groupBy(*by).agg(F.count("*").cast("double").alias(n))
    met = lambda one, two, by: count(one, by, "_l").join(count(two, by, "_r"), by).agg(F.coalesce(F.sum(F.col("_l") * F.col("_r")), F.lit(0.0))).first()[0]
    shapes = [stored(t, "shapes")[0] for t in shapes]
    if met(*shapes, ["site"]) <= met(left.select("site", F.explode("_gb").alias("_b")), right.select("site", F.explode("_pb").alias("_b")), ["site", "_b"]):
        return _by_outline(left, right, *shapes, days, also)
    return _by_tile(left, right, days, also)


def _levels(left: DataFrame, right: DataFrame) -> list[int]:
    sizes = left.select(tile_level("g").alias("l")).union(right.select(tile_level("p"))).distinct()
    return sorted(r.l for r in sizes.collect())  # powers of two that occur: a few dozen at most


def _meeting(pairs: DataFrame, *also: Column) -> DataFrame:
    """Of pairs by level and tile those whose outlines meet, in the first tile that they share."""
    corner = lambda c: F.floor(F.greatest(f"g{c}0", f"p{c}0") / F.pow(F.lit(2.0), F.col("_level"))).cast("long")
    boxes = (F.col("gx0") <= F.col("px1")) & (F.col("px0") <= F.col("gx1")) & (F.col("gy0") <= F.col("py1")) & (F.col("py0") <= F.col("gy1"))
    # numbers are compared before arrays
    first = (F.col("_tx") == corner("x")) & (F.col("_ty") == corner("y")) & (F.col("ghome") | F.col("phome"))
    for c in also:
        first = first & c
    meet = F.exists("grings", lambda a: F.exists("prings", lambda b: intersects(a, b)))
    return pairs.filter(boxes & first & ((F.col("gbox") & F.col("pbox")) | meet))


def _by_tile(left: DataFrame, right: DataFrame, days: int, also: list[str]) -> DataFrame:
    """match_surveys() by site, bucket of ``days`` days and tile.

    A box stands in tiles of its own size, and in the tiles of each larger size that occurs, so a large outline
    costs no more rows than a small one; a pair meets at the size of the larger. Of the buckets and tiles that a
    pair has in common only the first one yields it, so nothing is made distinct.
    """
    left, _ = stored(outlines(left, "g"), "granules")
    right, _ = stored(outlines(right, "p"), "products")
    levels = _levels(left, right)
    left = tiled(left, "g", levels).withColumn("_b", F.explode("_gb"))
    right = tiled(right, "p", levels).withColumn("_b", F.explode("_pb"))
    # of stored tables the planner knows sizes before rows are dealt to tiles and buckets, and would broadcast them
    gap = gap_days([F.col("begin"), F.col("end")], [F.col("ref"), F.col("sec")])

    def met(right: DataFrame) -> DataFrame:
        pairs = left.hint("merge").join(right, ["site", "_b", "_level", "_tx", "_ty"])
        found = _meeting(pairs, gap <= days, F.col("_b") == F.array_min(F.array_intersect("_gb", "_pb")))
        return found.select("site", "granule", "scene", gap.alias("gap_days"))

    return _distinct_scenes(right, met)


def _by_outline(left: DataFrame, right: DataFrame, left_shapes: DataFrame, right_shapes: DataFrame, days: int, also: list[str]) -> DataFrame:
    """match_surveys() by pairs of different outlines.

    Outlines of products are put into groups of ``GROUP`` that lie side by side. What a granule's outline meets of a
    group is a number of as many bits, so records meet by group and bucket of days, and are compared as numbers alone.
    """
    number = lambda shapes, k: stored(outlines(shapes.withColumn("_rings", F.col("rings")), k).withColumn(f"{k}no", F.monotonically_increasing_id()), "outlines")[0]
    ours, theirs = number(left_shapes, "g"), number(right_shapes, "p")
    levels = _levels(ours, theirs)
    # products' outlines in order inside the tile of their lower left corner, by eighths of it
    theirs = theirs.withColumn("_own", tile_level("p"))
    part = lambda c: F.floor(F.col(c) / F.pow(F.lit(2.0), F.col("_own")) * 8).cast("long")
    bits = lambda c: F.shiftleft(c.bitwiseAND(4), 2) + F.shiftleft(c.bitwiseAND(2), 1) + c.bitwiseAND(1)
    placed = theirs.withColumns({"_px": part("px0"), "_py": part("py0")})
    order = Window.partitionBy("site", "_own", F.floor(F.col("_px") / 8), F.floor(F.col("_py") / 8)).orderBy(2 * bits(F.col("_px")) + bits(F.col("_py")), "px0", "py0", "pno")
    placed = placed.withColumn("_n", F.row_number().over(order) - 1)
    first = F.min("pno").over(Window.partitionBy("site", "_own", F.floor(F.col("_px") / 8), F.floor(F.col("_py") / 8), F.floor(F.col("_n") / GROUP)))
    theirs, _ = stored(placed.select("site", "_h", "_rings", "pno", "prings", "pbox", "px0", "px1", "py0", "py1", first.alias("_group"), (F.col("_n") % GROUP).cast("int").alias("_bit")), "outlines")
    met = _meeting(tiled(ours, "g", levels).hint("merge").join(tiled(theirs.drop("_h", "_rings"), "p", levels), ["site", "_level", "_tx", "_ty"]))
    one = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("_bit"))
    masks, _ = stored(met.select("gno", "_group", one.alias("_one")).groupBy("gno", "_group").agg(F.bit_or("_one").alias("_mask")), "outline-pairs")
    day = lambda c, other: F.datediff(F.coalesce(c, other), F.lit("1970-01-01").cast("date"))
    by = ["site", "_h", "_rings"]
    g = left.withColumnRenamed("rings", "_rings").join(ours.select(*by, "gno"), by).select("site", "granule", "gno", F.explode("_gb").alias("_b"), day("begin", "end").alias("_g0"), day("end", "begin").alias("_g1"))
    of = lambda c: F.floor(F.col(c) / days).cast("int").alias(f"{c}b")
    g = g.join(masks, "gno").select("site", "granule", "_b", "_g0", "_g1", of("_g0"), of("_g1"), "_group", "_mask")
    p = right.withColumnRenamed("rings", "_rings").join(theirs.select(*by, "_group", "_bit"), by).select("scene", *also, "_group", "_bit", "_pb", day("ref", "sec").alias("_p0"), day("sec", "ref").alias("_p1"))
    # the earlier bucket of two, which yields the pair if the granule has it, too
    p = p.select("scene", *also, "_group", "_bit", "_p0", "_p1", F.explode("_pb").alias("_b"), F.array_min("_pb").alias("_first"))
    (g, _), (p, _) = stored(g, "granules"), stored(p, "products")
    gap = F.least(*[F.abs(F.col(a) - F.col(b)) for a in ("_g0", "_g1") for b in ("_p0", "_p1")])
    has = lambda c: (F.col("_first") >= F.col(c) - 1) & (F.col("_first") <= F.col(c) + 1)
    once = (F.col("_first") == F.col("_b")) | ~(has("_g0b") | has("_g1b"))

    def met(p: DataFrame) -> DataFrame:
        # a table of few rows is broadcast, if its size on disk says so; the others are sorted
        pairs = (g if "_few" in p.columns else g.hint("merge")).join(p, ["_group", "_b"])
        return pairs.filter((F.col("_mask").bitwiseAND(one) != 0) & (gap <= days) & once).select("site", "granule", "scene", gap.alias("gap_days"))

    return _distinct_scenes(p, met)


def with_snow_off(matches: DataFrame, surfaces: DataFrame) -> DataFrame:
    """Matches with a verdict, and a row for each bare-ground survey, of which none is expected."""
    none = surfaces.select("site", "granule", F.lit(None).cast("string").alias("scene"), F.lit(-1).alias("gap_days"), F.lit("snow_off_no_match_expected").alias("verdict"))
    return matches.withColumn("verdict", F.lit("match")).unionByName(none)


def nearest_date(targets: DataFrame, candidates: DataFrame, site: str = "site") -> DataFrame:
    """For each (site, target) the site's nearest (site, candidate), of two as near the earlier.

    An as-of join: the last candidate not after a target and the first after it come from one
    sort by date, so no pairs are formed.
    """
    t = targets.select(site, F.col("target").alias("at"), F.lit(1).alias("is_target"), "target").distinct()
    c = candidates.select(site, F.col("candidate").alias("at"), F.lit(0).alias("is_target"), F.lit(None).cast("date").alias("target")).distinct()
    day = F.when(F.col("is_target") == 0, F.col("at"))
    back = Window.partitionBy(site).orderBy("at", "is_target").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(site).orderBy(F.desc("at"), "is_target").rowsBetween(Window.unboundedPreceding, 0)
    both = t.unionByName(c).withColumns({"_p": F.last(day, True).over(back), "_n": F.last(day, True).over(ahead)}).filter("is_target = 1")
    earlier = F.col("_p").isNotNull() & (F.col("_n").isNull() | (F.datediff("target", "_p") <= F.datediff("_n", "target")))
    return both.select(site, "target", F.when(earlier, F.col("_p")).otherwise(F.col("_n")).alias("candidate"))


def near_surveys(surveys: DataFrame, visits: DataFrame) -> DataFrame:
    """Visits (site, day) within, and at most 3 and 7 days from, each survey (site, survey, begin, end).

    A survey is spread over its own days and 7 on either side, which meet the visits by equal
    site and day: no survey meets all days of its site.
    """
    counted = visits.groupBy("site", "day").agg(F.count("*").alias("times"))
    days = surveys.withColumn("day", F.explode(F.sequence(F.date_sub("begin", 7), F.date_add("end", 7))))
    off = F.greatest(F.datediff("begin", "day"), F.datediff("day", "end"), F.lit(0))
    pairs = days.join(counted, ["site", "day"], "left").withColumn("_off", off)
    upto = lambda n: F.coalesce(F.sum(F.when(F.col("_off") <= n, F.col("times"))), F.lit(0)).cast("long")
    return pairs.groupBy("site", "survey").agg(upto(0).alias("within"), upto(3).alias("within_3"), upto(7).alias("within_7"))


def locate_points(points: DataFrame, grids: DataFrame, site: str = "site") -> DataFrame:
    """Points (x, y) with the row and column of their site's grid; those outside are left out."""
    from cellframe.functions.geometry import cell_of

    row, col = cell_of(*(F.col(c) for c in ("x", "y", "left", "top", "dx", "dy")))
    out = points.join(grids, site).withColumns({"row": row, "col": col})
    return out.filter((F.col("row") >= 0) & (F.col("row") < F.col("height")) & (F.col("col") >= 0) & (F.col("col") < F.col("width")))


def point_values(points: DataFrame, grids: DataFrame, cells: DataFrame, crs: Crs, site: str = "site") -> DataFrame:
    """Points (site, lon, lat) projected onto their site's grid, each with the value of the cell (site,
    row, col, v) that holds it; null in a hole. Points off the grid or without a position are left out."""
    x, y = crs.of_lonlat(F.col("lon"), F.col("lat"))
    located = locate_points(bind(points, {"x": x, "y": y}), grids, site)
    return located.join(cells.select(site, "row", "col", "v"), [site, "row", "col"], "left")


def match_bridge(matches: DataFrame, groups: DataFrame) -> DataFrame:
    """Per merged acquisition its (date, gap, product) matches, distinct and in order."""
    entry = F.struct("date", "gap_days", "product")
    return matches.join(groups, "group").groupBy("acquisition").agg(F.array_sort(F.collect_set(entry)).alias("matches"))


def reconcile(expected: DataFrame, actual: DataFrame, key: str, value: str) -> DataFrame:
    """missing, extra, changed or same, for every key of two inventories."""
    e, a = expected.select(key, F.col(value).alias("expected")), actual.select(key, F.col(value).alias("actual"))
    e, a = e.withColumn("_e", F.lit(1)), a.withColumn("_a", F.lit(1))
    status = F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "extra").when(~F.col("expected").eqNullSafe(F.col("actual")), "changed").otherwise("same")
    return e.join(a, key, "full_outer").select(key, "expected", "actual", status.alias("status"))


def collisions(names: DataFrame, name: str) -> DataFrame:
    """Names that differ in letter case alone."""
    return names.groupBy(F.lower(name).alias("key")).agg(F.countDistinct(name).alias("names")).filter("names > 1")


def shared_products(products: DataFrame) -> DataFrame:
    """Each file once, with the sites that need it and its bytes."""
    return products.groupBy("file_id").agg(F.max("bytes").alias("bytes"), F.array_sort(F.collect_set("site")).alias("consumers"))


def granule_choices(specs: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Granules that a spec (site, product, code, part) names by product and code or by a part of the
    file name, once for each spec that does, with ``date`` and the ``reason`` if they are refused for want of a date or footprint.

    Specs are a list that people write, and are broadcast: by equal product, a task would read all granules of it.
    """
    by_code = catalogue.join(F.broadcast(specs.filter("code is not null").select("site", "product", "code")), ["product", "code"])
    parts = specs.filter("part is not null").select("site", "part", F.col("product").alias("_p"))
    by_part = catalogue.join(F.broadcast(parts), F.col("name").contains(F.col("part")) & (F.col("product") == F.col("_p"))).drop("part", "_p")
    both = by_code.unionByName(by_part.select(*by_code.columns)).withColumn("date", F.coalesce("begin", "single"))
    return both.withColumn("reason", F.when(F.col("date").isNull(), "undated").when(F.col("footprint").isNull(), "no_footprint"))


def select_granules(specs: DataFrame, catalogue: DataFrame, keep: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Granules of granule_choices(), and those refused, each once. With ``keep``, the first have these columns alone,
    and are made distinct by them, so that outlines nobody asks for aren't dealt out."""
    both = granule_choices(specs, catalogue)
    fine = both.filter("reason is null").drop("reason")
    return (fine.select(*keep) if keep else fine).distinct(), both.filter("reason is not null").select("site", "name", "reason").distinct()


def newest_versions(products: DataFrame) -> DataFrame:
    """The highest version of each scene and level; of equal ones the first in order of file_id."""
    from cellframe.functions.names import scene_stem, scene_version

    w = Window.partitionBy("level", "_stem").orderBy(F.desc("version"), "file_id")
    out = products.withColumns({"_stem": scene_stem(F.col("scene")), "version": scene_version(F.col("scene"))})
    return out.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n", "_stem")


def collision_check(products: DataFrame) -> DataFrame:
    """Group names that more than one scene of a level claims."""
    return products.groupBy("level", "group").agg(F.countDistinct("scene").alias("scenes")).filter("scenes > 1")


def ring(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, counter-clockwise from the least point; without points on its edges."""
    points = sorted(set(points))

    def half(points: list) -> list:
        out: list = []
        for q in points:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out

    return points if len(points) < 3 else half(points)[:-1] + half(points[::-1])[:-1]


def hull(points: DataFrame, keys: list[str], kinds: str = "site int", fan: int = 32) -> DataFrame:
    """Convex hull (keys, n, x, y), counter-clockwise, of each key's points (x, y).

    Each batch of rows is thinned to its own hulls before anything moves; a key's partial hulls then meet in
    ``fan`` groups, and these in one, so no task holds a key's points, only hulls. Points with a null
    coordinate don't count; a null key is a key; one or two different points are their own hull.
    """
    import pandas as pd

    def thinned(pdf: pd.DataFrame, by: list[str]) -> pd.DataFrame:
        out = []
        for _, group in pdf.groupby(by, dropna=False, sort=False):
            some = pd.DataFrame(ring(list(zip(group["x"], group["y"], strict=True))), columns=["x", "y"])
            for k in by:
                some[k] = pd.Series([group[k].iat[0]] * len(some), dtype=object)
            out.append(some)
        return pd.concat(out)[[*by, "x", "y"]] if out else pdf

    def batches(frames):
        for pdf in frames:
            yield thinned(pdf, keys)

    def walk(pdf: pd.DataFrame) -> pd.DataFrame:
        out = thinned(pdf[[*keys, "x", "y"]], keys)
        out.insert(len(keys), "n", range(len(out)))
        return out

    some = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).filter("x is not null and y is not null")
    partial = some.mapInPandas(batches, f"{kinds}, x double, y double")
    dealt = partial.withColumn("_part", F.pmod(F.xxhash64("x", "y"), F.lit(fan)).cast("int"))
    merged = dealt.groupBy(*keys, "_part").applyInPandas(lambda pdf: thinned(pdf[[*keys, "x", "y"]], keys), f"{kinds}, x double, y double")
    return merged.groupBy(*keys).applyInPandas(walk, f"{kinds}, n int, x double, y double")


def site_bounds(footprints: DataFrame, key: str = "site") -> DataFrame:
    p = footprints.select(key, F.explode("ring").alias("p"))
    return p.groupBy(key).agg(F.min("p.x").alias("left"), F.min("p.y").alias("bottom"), F.max("p.x").alias("right"), F.max("p.y").alias("top"))


def level_filter(products: DataFrame, levels: list[str], ring: str = "ring") -> DataFrame:
    """Products of the wanted processing levels that have a usable outline: three points or more,
    none of them without a coordinate."""
    whole = (F.size(ring) >= 3) & ~F.exists(ring, lambda p: p["x"].isNull() | p["y"].isNull())
    return products.filter(F.col("level").isin(*levels) & F.coalesce(whole, F.lit(False)))


def shared_names(first: DataFrame, second: DataFrame, name: str) -> DataFrame:
    """Names that both tables have."""
    return first.select(name).intersect(second.select(name))
