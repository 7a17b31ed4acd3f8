import pytest

from callframe.llm import copies


def found(df):
    return {(r.keep_id, r.copy_id) for r in copies.copies(df).collect()}


@pytest.mark.parametrize(
    "a, b, same",
    [
        ('{"x": 1, "y": "A b"}', '{"y":"a, B!","x":1.0}', True),
        ('{"x": 1}', '{"x": true}', False),
        ('{"x": "1"}', '{"x": 1}', False),
        ('{"x": [1, 2]}', '{"x": [2, 1]}', False),
        ('{"x": null}', "{}", False),
        ('{"X": 1}', '{"x": 1}', False),
        ('{"x": "a b"}', '{"x": "ab"}', False),
        ('{"x": "中文"}', '{"x": "中 文"}', True),
        ("{bad", "{bad", True),
        (None, None, True),
        (None, "null", False),
        ("[" * 50_000, "[" * 50_001, False),
    ],
)
def test_arguments(samples, row, a, b, same):
    df = samples(row(1, "b", calls=[("f", a)]), row(2, "a", calls=[("f", b)]))
    assert found(df) == ({("a", "b")} if same else set())


def test_texts_repeats_and_nulls(samples, row):
    df = samples(
        row(1, "c", text="Find  the CAFÉ!"),
        row(2, "a", text="find the café"),
        row(3, "a", text="find the café"),
        row(4, "d", text="find the cafe"),
        row(5, "e", text=None),
        row(6, "f", text="--"),
        row(7, None, text="find the café"),
        row(8, "g", text="find the café", calls=[("f", "{}")]),
        row(9, "h", text="find the café", calls=[("f", "{}"), ("f", "{}")]),
        row(10, "i", text="find the café", calls=[("F", "{}")]),
    )
    assert found(df) == {("a", "c"), ("e", "f")}
    counts = {r.keep_id: r.copies for r in copies.copy_classes(copies.one_per_sample(copies.fingerprints(df))).collect()}
    assert counts == {"a": 2, "d": 1, "e": 2, "g": 1, "h": 1, "i": 1}
    assert copies.collisions(copies.fingerprints(df)).count() == 0


def test_hot_record(samples, row, spark, monkeypatch):
    from callframe.functions import skew

    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.002, 10))
    df = samples(*[row(i, f"s{i:03d}", text="same" if i % 3 else f"t{i}") for i in range(90)])
    assert found(df) == {("s001", f"s{i:03d}") for i in range(2, 90) if i % 3}


def test_empty_and_clashing_columns(samples, row, spark):
    assert found(samples()) == set()
    df = samples(row(1, "b"), row(2, "a")).selectExpr("*", "'x' AS keep_id", "1 AS key", "2 AS n")
    assert found(df) == {("a", "b")}


def test_a_shared_key_never_merges_records(spark):
    prints = spark.createDataFrame([("a", 1, bytearray(b"k"), 1), ("b", 2, bytearray(b"k"), 2)], "sample_id string, line_number bigint, key binary, check bigint")
    assert copies.copy_classes(prints).count() == 2 and copies.collisions(prints).count() == 1
