"""Places without a window over all rows, and what shuffling a feature costs."""

import pytest
from pyspark.sql import functions as F

from cellframe.operators import learning


def test_places_number_every_row_once(spark):
    rows = spark.range(5000).select("id", (F.col("id") % 3).alias("k")).repartition(6)
    order = F.xxhash64(F.lit(4), "id")
    got = learning.places(rows, order, ["id"], "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(5000))
    expected = [r.id for r in rows.withColumn("o", F.shiftrightunsigned(order, 56)).withColumn("o2", order).orderBy("o", "o2").collect()]
    assert [r.id for r in got] == expected
    assert got[0].asDict().keys() == {"id", "k", "n"}
    assert learning.places(rows.limit(0), order, ["id"], "n").count() == 0
    same = spark.createDataFrame([(1,)] * 50, "id long")
    assert sorted(r.n for r in learning.places(same, order, ["id"], "n").collect()) == list(range(50))


def test_only_the_feature_in_use_matters(spark):
    k = F.col("id")
    rows = spark.range(1200).select(k.alias("key"), (k % 3).alias("site"), (k % 17).cast("double").alias("a"), F.when(k % 10 > 0, (k % 7).cast("double")).alias("b"), ((k % 17) * 10.0).alias("y"))
    got = {(r.site, r.feature): r.increase for r in learning.importances_of_sites(rows, ["a", "b"], ["key"], numTrees=5, maxDepth=6, minInstancesPerNode=2, featureSubsetStrategy="all").collect()}
    assert set(got) == {(s, f) for s in (0, 1, 2) for f in ("a", "b")}
    for s in (0, 1, 2):
        assert got[s, "a"] > 30  # two unlike values of y differ by 68 at the root of the mean square
        assert got[s, "b"] == pytest.approx(0, abs=3)


def test_weights_do_not_deal_samples_out_by_site(spark):
    from cellframe.operators import samples

    rows = spark.createDataFrame([(k % 3, float(k)) for k in range(30)], "site int, y double")
    out = samples.site_weights(rows)
    assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.weight for r in out.collect()} == {1.0}


def test_models_of_whole_features_need_no_medians(spark, monkeypatch):
    """Predictions are those with medians; a missing feature, even of one site alone, brings the medians back."""
    rows = spark.range(160).select((F.col("id") % 2).alias("site"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"), F.col("id").cast("double").alias("y"))
    how = {"numTrees": 2, "maxDepth": 3}
    made, fit = [], learning.Fitted.__init__

    def spy(self, *args, **kw):
        fit(self, *args, **kw)
        made.append(self.imputer is not None)

    monkeypatch.setattr(learning.Fitted, "__init__", spy)
    out = lambda df: sorted((r.site, r.y, r.p) for r in learning.leave_one_site_out(df, {"all": ["a", "b"]}, ("forest",), how).collect())
    fast = out(rows)
    assert made == [False, False]
    monkeypatch.setattr(learning, "complete", lambda *_: False)
    assert out(rows) == fast and made[2:] == [True, True]
    monkeypatch.undo()
    for gap in (F.lit(None).cast("double"), F.lit(float("nan"))):
        assert not learning.complete(rows.withColumn("b", F.when(F.col("y") == 3, gap).otherwise(F.col("b"))), ["a", "b"])
