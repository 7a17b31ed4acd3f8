import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callframe.functions import jsonx

VALUES = st.recursive(
    st.none() | st.booleans() | st.integers(-(10**6), 10**6) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=8),
    lambda inner: st.lists(inner, max_size=3) | st.dictionaries(st.text(max_size=5), inner, max_size=3),
    max_leaves=10,
)


@pytest.mark.parametrize(
    "text, kind, canon",
    [
        ('{"b":1,"a":[1.0]}', "object", '{"a":[1.0],"b":1}'),
        ("1", "integer", "1"),
        ("1.0", "number", "1.0"),
        ("true", "boolean", "true"),
        ("null", "null", "null"),
        ('{"a":1,"a":2}', "object", '{"a":2}'),
        ('"é"', "string", '"é"'),
        ("NaN", "number", "NaN"),
    ],
)
def test_strict_values(text, kind, canon):
    ok, value, _, _ = jsonx.loads(text)
    assert ok and jsonx.kind_of(value) == kind and jsonx.canon(value) == canon


@pytest.mark.parametrize("text", ["{'a':1}", '{"a":1} x', "", " ", '{"a":1,}', None, "[" * 100_000, "1" * 5000])
def test_strict_failures(text):
    assert jsonx.loads(text)[0] is False


def test_constants_refused_on_the_prediction_side():
    assert jsonx.loads('{"a":NaN}')[0] and not jsonx.loads('{"a":NaN}', constants=False)[0]


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_canonical_form_round_trips(value):
    text = jsonx.canon(value)
    ok, back, _, _ = jsonx.loads(text)
    assert ok and jsonx.canon(back) == text


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_leaves_are_all_scalars(value):
    def count(v):
        return sum(map(count, v.values())) if isinstance(v, dict) else sum(map(count, v)) if isinstance(v, list) else 1

    assert len(jsonx.leaves(value)) == count(value)


def test_literals():
    assert jsonx.literal("{'a': (1, None)}") == (True, {"a": (1, None)})
    for bad in ("{[1]: 2}", "__import__('os')", "(" * 5000, "a\x00"):
        assert jsonx.literal(bad) == (False, None)


def test_columns(spark):
    rows = spark.createDataFrame([('{"b":{"c":1},"a":[1]}',), ("x",), (None,)], "t string")
    got = rows.select(jsonx.json_strict("t").alias("p"), jsonx.json_nodes("t").alias("n"), jsonx.py_literal("t").alias("l")).collect()
    assert [r.p.ok for r in got] == [True, False, False]
    assert [(n.path, n.parent, n.kind) for n in got[0].n] == [("", None, "object"), ("a", "", "array"), ("b", "", "object"), ("b.c", "b", "integer")]
    assert got[2].p.error_type == "TypeError" and got[1].n == []
