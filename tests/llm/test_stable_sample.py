import pytest
from pyspark.sql import functions as F

from callframe.llm import stable_sample as ss


def members(df, rate):
    return {r[0] for r in ss.select_sample(df, "k", rate).collect()}


def test_stable_and_nested(spark):
    keys = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("k"))
    small = keys.filter("substr(k, 2) % 2 = 0")
    base = members(small, 0.1)
    assert members(small.repartition(9), 0.1) == base == members(small.union(small), 0.1)
    assert base <= members(keys, 0.1) and members(keys, 0.1) & {r.k for r in small.collect()} == base
    assert members(keys, 0.05) <= members(keys, 0.1) <= members(keys, 1.0)
    assert len(members(keys, 1.0)) == 4000 and not members(keys, 0.0)
    assert abs(len(members(keys, 0.1)) - 400) < 80


def test_permutation_is_one(spark):
    slots = spark.range(1 << 12).select(ss.slot(F.col("id") * 256)).distinct().count()
    assert slots == 1 << 12 and ss.ODD % 2 == 1


def test_bad_rate_nulls_empty(spark):
    df = spark.createDataFrame([("a", 1), (None, 2), ("", 3), ("x" * 100_000, 4)], "k string, slot int")
    with pytest.raises(ValueError):
        ss.select_sample(df, "k", 1.5)
    assert len(members(df, 1.0)) == 3
    assert members(df.limit(0), 0.5) == set()


def test_growth(spark):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(300)] + [(f"k{i}", 2) for i in range(50)] + [("n", None), (None, 1)], "k string, b int")
    got = ss.growth(df, "k", "b", [0.5, 1.0]).orderBy("rate", "batch_no").collect()
    assert [r.members for r in got if r.rate == 1.0] == [100, 200, 300]
    half = [r for r in got if r.rate == 0.5]
    assert [r.members for r in half] == [sum(x.added for x in half[: i + 1]) for i in range(3)]
    assert all(r.lost == 0 for r in got) and ss.growth(df.limit(0), "k", "b", [0.5]).count() == 0


def test_growth_sees_a_lost_member(spark, monkeypatch):
    df = spark.createDataFrame([(f"k{i}", i % 3) for i in range(90)], "k string, b int")
    real = ss.select_sample
    # A sampler that depends on the number of rows: not stable.
    monkeypatch.setattr(ss, "select_sample", lambda rows, key, rate: real(rows, key, rate).orderBy("slot").limit(20))
    assert sum(r.lost for r in ss.growth(df, "k", "b", [1.0]).collect()) > 0
