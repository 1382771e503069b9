"""Binaries read by byte range, and matching by tiles, against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import matching
from cellframe.sources import binary, rasters


@pytest.mark.parametrize("dtype", ["<f4", ">i2", "<f8"])
def test_windows_of_binaries(spark, tmp_path, monkeypatch, dtype):
    """Every window of a file is what slicing gives, in one partition or many, narrow or whole."""
    monkeypatch.setattr(binary, "SPLIT", 200)
    rng = np.random.default_rng(2)
    values = (rng.normal(size=(11, 13)) * 100).astype(dtype)
    if values.dtype.kind == "f":
        values[2, 3], values[4, 5] = np.nan, np.inf
    path = tmp_path / "x.grd"
    path.write_bytes(values.tobytes())
    for r0, c0, nr, nc in ((0, 0, None, None), (3, 2, 4, 5), (10, 12, 1, 1), (0, 6, 11, 1), (5, 0, 0, 3)):
        got = {(r.row, r.col): r.v for r in rasters.scan_fixed_width(spark, str(path), 11, 13, dtype, r0, c0, nr, nc).collect()}
        part = values[r0 : None if nr is None else r0 + nr, c0 : None if nc is None else c0 + nc]
        want = {(r0 + r, c0 + c): float(v) if np.isfinite(v) else None for (r, c), v in np.ndenumerate(part)}
        assert got == want
    with pytest.raises(Exception, match="does not hold"):
        rasters.scan_fixed_width(spark, str(path), 11, 12, dtype).count()


def test_conditions_reach_the_bytes():
    r = binary.FixedWidthReader({"path": "/none", "rows": "100", "cols": "50", "dtype": "<f4"})
    left = list(r.pushFilters([binary.GreaterThanOrEqual(("row",), 10), binary.LessThan(("row",), 20), binary.EqualTo(("col",), 7), binary.LessThan(("v",), 1), binary.GreaterThan(("col",), 2.5)]))
    assert r.bounds == {"row": [10, 20], "col": [7, 8]}
    assert [f.attribute for f in left] == [("v",), ("col",)]


def test_binaries_written_and_read(spark, tmp_path):
    cells = spark.createDataFrame([(f, r, c, None if c == 2 else float(r * 10 + c)) for f in ("a", "b") for r in (0, 2, 3) for c in range(4)], "f string, row int, col int, v double")
    rasters.write_fixed_width(cells, str(tmp_path / "out"), F.col("f"), 5, 4)
    got = rasters.scan_fixed_width(spark, str(tmp_path / "out"), 5, 4, with_file=True).collect()
    assert len(got) == 40 and {r.file for r in got} == {"a", "b"}
    assert {(r.row, r.col): r.v for r in got if r.file == "a"} == {(r, c): float(r * 10 + c) if r in (0, 2, 3) and c != 2 else None for r in range(5) for c in range(4)}


def crosses(a, b, c, d):
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sign = lambda v: (v > 0) - (v < 0)
    apart = any(max(p[k], q[k]) < min(r[k], s[k]) for k in (0, 1) for p, q, r, s in ((a, b, c, d), (c, d, a, b)))
    return not apart and sign(side(a, b, c)) * sign(side(a, b, d)) <= 0 and sign(side(c, d, a)) * sign(side(c, d, b)) <= 0


def holds(ring, p):
    return sum((a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0] for a, b in zip(ring, ring[1:] + ring[:1], strict=True)) % 2 == 1


def meet(one, two):
    edges = lambda r: list(zip(r, r[1:] + r[:1], strict=True))
    return any(crosses(*e, *f) for e in edges(one) for f in edges(two)) or holds(one, two[0]) or holds(two, one[0])


def test_pairs_of_outlines_of_all_sizes(spark):
    """Tiny to huge outlines, crossing themselves, of several parts, with gaps and faults: each pair once."""
    rng = random.Random(7)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(25))

    def ring(faulty=True):
        x, y, s = rng.uniform(-40, 40), rng.uniform(-40, 40), rng.choice([0.0, 0.3, 1, 4, 30, 500])
        points = [(x + rng.uniform(0, s), y + rng.uniform(0, s)) for _ in range(rng.choice([3, 4, 5]))]
        if faulty and rng.random() < 0.3:
            points = [points[0], points[0], *points[1:], points[0]]
        return points

    granules = [(rng.randrange(2), k, d := day(), d + dt.timedelta(rng.randrange(4)), [ring() for _ in range(rng.choice([1, 1, 2]))]) for k in range(70)]
    products = [(rng.randrange(2), f"s{k}", day(), day(), [ring() for _ in range(rng.choice([1, 1, 2]))]) for k in range(70)]
    granules += [(0, 900, day(), day(), []), (0, 901, None, None, [ring()]), (0, 902, day(), day(), None), (0, 903, day(), day(), [[(0.0, 0.0), (None, 1.0), (1.0, 1.0)]]), (None, 904, day(), day(), [ring()])]
    kind = "rings array<array<struct<x:double,y:double>>>"
    g = spark.createDataFrame(granules, f"site int, granule int, begin date, end date, {kind}")
    p = spark.createDataFrame(products, f"site int, scene string, ref date, sec date, {kind}")
    got = sorted((r.site, r.granule, r.scene, r.gap_days) for r in matching.match_surveys(g, p).collect())
    want = []
    for site, granule, begin, end, rings in granules[:70]:
        for other, scene, ref, sec, parts in products:
            gap = min(abs((a - b).days) for a in (begin, end) for b in (ref, sec))
            tidy = lambda r: [q for k, q in enumerate(r) if k == 0 or q != r[k - 1]]
            opened = lambda r: r[:-1] if r[0] == r[-1] else r
            shapes = [[s for r in x if len(s := opened(tidy(r))) >= 3] for x in (rings, parts)]
            if site == other and gap <= 5 and any(meet(a, b) for a in shapes[0] for b in shapes[1]):
                want.append((site, granule, scene, gap))
    assert got == sorted(want)
    assert len(want) > 50
    assert matching.match_surveys(g.limit(0), p).count() == 0


def test_matching_sends_no_outlines_through_the_driver(spark):
    """Small tables on disk are many rows once they are dealt to tiles: they are sorted, not broadcast. Boxes and
    rings with a box's corners in another order match alike."""
    kind = "ring array<struct<x:double,y:double>>"
    box = [(0.0, 0.0), (3.0, 0.0), (3.0, 2.0), (0.0, 2.0)]
    g = spark.createDataFrame([(0, k, dt.date(2020, 1, k), dt.date(2020, 1, k), box) for k in range(1, 9)], f"site int, granule int, begin date, end date, {kind}")
    rings = {"box": [(3.0, 2.0), (4.0, 2.0), (4.0, 3.0), (3.0, 3.0)], "far": [(3.1, 2.0), (4.0, 2.0), (4.0, 3.0), (3.1, 3.0)], "bow": [(1.0, 1.0), (9.0, 9.0), (9.0, 1.0), (1.0, 9.0)]}
    p = spark.createDataFrame([(0, k, dt.date(2020, 1, 1), dt.date(2020, 1, 1), r) for k, r in rings.items()], f"site int, scene string, ref date, sec date, {kind}")
    out = matching.match_surveys(g, p)
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.granule, r.scene) for r in out.collect()) == [(k, s) for k in range(1, 7) for s in ("bow", "box")]


def test_fixed_width_lines_packed_a_few_at_a_time(spark, tmp_path, monkeypatch):
    """Two lines at once: holes, absent cells and lines, a batch of more lines than that."""
    monkeypatch.setattr(rasters, "PACKED", 2 * 8 * 3)
    cells = [(f, r, c, None if (r, c) == (1, 1) else float(100 * f + 10 * r + c)) for f in range(2) for r in range(5) for c in range(3) if (r, c) != (2, 0) and r != 3]
    df = spark.createDataFrame(cells, "f int, row int, col int, v double").coalesce(1)
    path = f"file://{tmp_path}/lines"
    rasters.write_fixed_width(df, path, F.concat(F.lit("n"), "f"), 5, 3)
    got = {(r.file, r.row, r.col): r.v for r in rasters.scan_fixed_width(spark, path, 5, 3, with_file=True).collect()}
    known = {(f"n{f}", r, c): v for f, r, c, v in cells}
    assert got == {(f"n{f}", r, c): known.get((f"n{f}", r, c)) for f in range(2) for r in range(5) for c in range(3)}


def test_outlines_that_repeat_are_compared_once(spark, monkeypatch):
    """Records of repeated outlines meet by pairs of outlines, with the rows that tiles and days give; equal scenes give a row once."""
    rng = random.Random(5)
    day = lambda: dt.date(2020, 1, 1) + dt.timedelta(rng.randrange(60))
    shapes = [[(x, y), (x + 3.0, y), (x + 3.0, y + 2.0), (x, y + 2.0)] if k % 2 else [(x, y), (x + 3.0, y + 2.0), (x + 3.0, y), (x, y + 2.0)] for k in range(12) for x, y in [(float(k % 5 * 2 - 4), float(k % 3 * 3 - 3))]]
    granules = [(rng.randrange(2), k, d := day(), rng.choice([None, d, d + dt.timedelta(9)]), rng.choice(shapes)) for k in range(250)] + [(0, 999, None, None, shapes[0]), (0, 998, day(), day(), None)]
    products = [(rng.randrange(2), f"s{k // 2}", rng.choice([day(), None]), day(), rng.choice(shapes)) for k in range(250)]
    products += products[:20]
    kind = "ring array<struct<x:double,y:double>>"
    g = spark.createDataFrame(granules, f"site int, granule int, begin date, end date, {kind}")
    p = spark.createDataFrame(products, f"site int, scene string, ref date, sec date, {kind}")
    taken, whole = [], matching._by_outline
    monkeypatch.setattr(matching, "_by_outline", lambda *a: (taken.append(1), whole(*a))[1])
    monkeypatch.setattr(matching, "GROUP", 4)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    got, once = rows(matching.match_surveys(g, p)), rows(matching.match_scenes(g, p))
    assert len(taken) == 2
    monkeypatch.setattr(matching, "_by_outline", lambda left, right, a, b, days, also: matching._by_tile(left, right, days, also))
    assert got == rows(matching.match_surveys(g, p)) and len(got) > 1000
    assert once == sorted(set(got)) == rows(matching.match_scenes(g, p)) and len(once) < len(got)
