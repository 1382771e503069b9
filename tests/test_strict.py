"""JSON with every key once."""

import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellframe.functions import strict


def once(pairs):
    if len({k for k, _ in pairs}) != len(pairs):
        raise KeyError
    return dict(pairs)


def expected(text):
    def refuse(_):
        raise ValueError

    try:
        json.loads(text, object_pairs_hook=once, parse_constant=refuse)
    except KeyError:
        return "duplicate_key"
    except ValueError:
        return "malformed"
    return None


TEXTS = [
    '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', '[{"k":1},{"k":2}]', '{"a":NaN}', "{bad", "", '{"a":1} x', "1,2", '1,"y":2', '{"a":1}], [', '{"a":1}}, {"b":2', "null", "1", '"t"', '{"a":1,"A":2}',
    "{'a':1}", '{"a":1,"\\u0061":2}', '{"a":01}', "[1,]", '[{"x":[{"y":1,"y":1}]}]', "{}", "[]", "  {} ", '{"a":-Infinity}', "true", "tru", '{"a":1}/*c*/', '{a:1}',
]


def test_faults_are_those_of_a_strict_parser(spark):
    got = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", strict.json_fault(F.col("t")).alias("f")).collect()
    assert {r.t: r.f for r in got} == {t: expected(t) for t in TEXTS}
    assert spark.createDataFrame([(None,)], "t string").select(strict.json_fault(F.col("t")).alias("f")).first().f is None


values = st.recursive(st.none() | st.booleans() | st.integers(-9, 9) | st.sampled_from(["", "a", '"', "]", "}"]), lambda inner: st.lists(inner, max_size=3) | st.lists(st.tuples(st.sampled_from(["a", "b", "c", ""]), inner), max_size=3).map(lambda p: ("object", p)), max_leaves=8)


def written(v):
    if isinstance(v, tuple):
        return "{" + ",".join(f"{json.dumps(k)}:{written(x)}" for k, x in v[1]) + "}"
    return "[" + ",".join(map(written, v)) + "]" if isinstance(v, list) else json.dumps(v)


@given(st.lists(values.map(written), min_size=20, max_size=40))
@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture, HealthCheck.too_slow])
def test_any_value_of_json(spark, texts):
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", strict.json_fault(F.col("t")).alias("f")).collect()
    assert [(r.t, r.f) for r in got] == [(t, expected(t)) for t in texts]


def test_strict_json_is_the_value_or_an_error(spark):
    read = strict.strict_json(F.col("t"))
    good = spark.createDataFrame([('{"a":[1,2]}',), (None,)], "t string").select(F.to_json(read).alias("v"))
    assert [r.v for r in good.collect()] == ['{"a":[1,2]}', None]
    with pytest.raises(Exception, match="duplicate_key"):
        spark.createDataFrame([('{"a":1,"a":1}',)], "t string").select(F.to_json(read)).collect()


def test_numbers_and_snapshots(spark):
    rows = spark.createDataFrame([(float("nan"), {"value_a": "1", "x": "2", "n": None}), (-float("inf"), {}), (0.5, None), (None, {"n": "3"})], "v double, m map<string,string>")
    got = rows.select(strict.finite_text(F.col("v")).alias("v"), strict.snapshot(F.col("m"), ("value_",), ("n",)).alias("m")).collect()
    assert [tuple(r) for r in got] == [('"nan"', '{"n":null,"value_a":"1"}'), ('"-inf"', "{}"), ("0.5", "{}"), (None, '{"n":"3"}')]
