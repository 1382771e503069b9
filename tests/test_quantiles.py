"""Exact quantiles by refined histograms against plain sorting, at bounds small enough to refine often."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellframe.operators import stats
from cellframe.operators.quantiles import bucket_of, quantiles

PARTS = {"least": 0.0, "p1": 0.01, "median": 0.5, "p99": 0.99, "most": 1.0}


def groups():
    rng = random.Random(5)
    return {
        "normal": [rng.gauss(0, 1) for _ in range(700)],
        "outliers": [rng.random() for _ in range(300)] + [1e300, -1e300, 1.7e308, -1.7e308],
        "scales": [rng.choice([-1, 1]) * 10.0 ** rng.randrange(-300, 300) for _ in range(200)],
        "ties": [float(rng.randrange(3)) for _ in range(400)],
        "flat": [7.25] * 50,
        "tiny": [5e-324 * rng.randrange(9) for _ in range(40)],
        "one": [-0.0],
        "two": [1.0, 2.0],
        None: [1.0, 4.0, 9.0],
        "": [2.0, 3.0],
        "none": [None, None],
    }


@pytest.mark.parametrize(("buckets", "most"), [(4096, 1_000_000), (64, 5)])
def test_quantiles_are_those_of_sorted_values(spark, buckets, most):
    wanted = groups()
    rows = [(k, v) for k, vs in wanted.items() for v in [*vs, None]]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "layer string, v double").repartition(5)
    got = {r.layer: r for r in quantiles(df, PARTS, buckets=buckets, most=most).collect()}
    assert got.keys() == wanted.keys()
    for k, vs in wanted.items():
        vs = sorted(v for v in vs if v is not None)
        for name, p in PARTS.items():
            if not vs:
                assert got[k][name] is None
                continue
            at = p * (len(vs) - 1)
            low, high = vs[math.floor(at)], vs[math.ceil(at)]
            want = low * (1 - (at - math.floor(at))) + high * (at - math.floor(at))
            assert got[k][name] == pytest.approx(want, rel=1e-12, abs=0), (k, name)


def test_buckets_keep_order(spark):
    values = sorted([-1.7e308, 1.7e308, 0.0, 1e-300, *np.random.default_rng(1).normal(size=50).tolist()])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = [r.b for r in df.select("v", bucket_of(F.col("v"), F.lit(values[0]), F.lit(values[-1]), 4096).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 4095
    got = [r.b for r in df.select("v", bucket_of(F.col("v"), F.lit(values[0]), F.lit(values[-1]), 64, True).alias("b")).orderBy("v").collect()]
    assert got == sorted(got) and got[0] == 0 and got[-1] == 63


def test_whole_table_and_empty(spark):
    df = spark.createDataFrame([(float(k),) for k in range(101)], "v double")
    assert [tuple(r) for r in quantiles(df, {"q": 0.25}, []).collect()] == [(25.0,)]
    assert quantiles(df.limit(0).withColumn("layer", F.lit("x")), PARTS).count() == 0


def test_complex_layers_have_no_order(spark):
    rows = [("z", None, 1.0, 2.0), ("z", None, 1.0, None), ("r", 3.0, None, None), ("r", 5.0, None, None), ("e", None, None, None)]
    df = spark.createDataFrame(rows, "layer string, v double, re double, im double")
    got = {r.layer: r for r in stats.layer_stats(df).collect()}
    assert (got["z"].status, got["z"].cells, got["z"].valid, got["z"].median) == ("not_applicable_complex", 2, 1, None)
    assert (got["r"].status, got["r"].median, got["r"].most) == ("computed", 4.0, 5.0)
    assert (got["e"].status, got["e"].valid) == ("no_valid_values", 0)
    only = stats.layer_stats(df.select("layer", "re", "im").filter("layer = 'z'")).first()
    assert (only.status, only.valid, only.p99) == ("not_applicable_complex", 1, None)


def test_no_group_is_held_whole(spark):
    """The plan has no percentile of a layer; windows are over buckets or what a bucket holds."""
    df = spark.createDataFrame([("a", float(k)) for k in range(50)], "layer string, v double")
    plan = stats.layer_stats(df)._jdf.queryExecution().toString()
    assert "percentile" not in plan.lower()
