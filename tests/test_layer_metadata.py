"""Metadata of layers and of those that they are derived from."""

from __future__ import annotations

from cellframe.operators import scenes


def test_layers_derived_from_none_take_no_part_in_the_join(spark):
    rows = [("a", None, {"units": "m", "x": "1"}), ("b", "a", {"units": "ft"}), ("c", "gone", {"x": "2"}), (None, "a", {}), ("d", None, None), ("e", "d", {"units": "s"})]
    out = scenes.layer_metadata(spark.createDataFrame(rows, "path string, derived_from string, attrs map<string,string>"), ["units"])
    got = sorted(((r.path or "", r.own, r.inherited) for r in out.collect()), key=str)
    assert got == sorted([("a", {"units": "m"}, None), ("b", {"units": "ft"}, {"units": "m"}), ("c", {}, None), ("", {}, {"units": "m"}), ("d", None, None), ("e", {"units": "s"}, None)], key=str)
    assert "isnotnull(derived_from" in out._jdf.queryExecution().executedPlan().toString()
