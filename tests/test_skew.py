import pytest
from pyspark.sql import functions as F

from callframe.functions import skew
from callframe.functions.staging import release, shared_dir, spread, stage


@pytest.fixture
def sides(spark):
    big = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").when(F.col("id") % 7 == 0, None).otherwise(F.concat(F.lit("k"), F.col("id") % 50)).alias("k"), F.col("id").alias("n"))
    small = spark.createDataFrame([("hot", 1)] + [(f"k{i}", i) for i in range(0, 50, 2)] + [(None, 9)], "k string, v int")
    return big, small


@pytest.mark.parametrize("how", ["inner", "left"])
def test_salted_join_is_a_join(sides, monkeypatch, how):
    big, small = sides
    want = sorted(map(str, big.join(small, "k", how).collect()))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.01, 100))
    assert "hot" in skew.hot_keys(big, "k") and len(skew.hot_keys(big, "k")) <= 100
    assert sorted(map(str, skew.lookup_join(big, small, "k", how).collect())) == want


def test_hot_rows_are_spread(sides, monkeypatch):
    big, small = sides
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.01, 100))
    joined = skew.lookup_join(big, small, "k")
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan


def test_no_hot_key_no_salt(spark, sides):
    big, small = sides
    assert skew.hot_keys(big, "k") == [] and skew.hot_keys(big.limit(0), "k") == []


def test_stage_and_spread(spark):
    df = spark.createDataFrame([(1, ["a"], None)], "n int, a array<string>, s string")
    kept = stage(df)
    assert kept.collect() == df.collect() and kept.schema == df.schema
    assert all(f.startswith(shared_dir(spark)) for f in kept.inputFiles())
    assert spread(stage(df.coalesce(1))).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    wide = spark.range(100, numPartitions=50)
    assert spread(wide).rdd.getNumPartitions() == 50


def test_counting_hot_keys_leaves_the_big_side_alone(spark, sides):
    big, small = sides
    keys = big.select("k")
    joined = skew.lookup_join(big.withColumn("x", F.raise_error(F.lit("read"))), small, "k", counted=keys)
    assert joined.columns


def test_a_shared_folder_is_needed_on_a_cluster():
    class Unset:
        conf = type("C", (), {"get": staticmethod(lambda *a: None)})
        sparkContext = type("S", (), {"getConf": staticmethod(lambda: Unset.conf), "master": "spark://host:7077"})

    with pytest.raises(ValueError):
        shared_dir(Unset)
    Unset.sparkContext.master = "local[4]"
    assert shared_dir(Unset).startswith("file:///")


def test_release(spark):
    kept = stage(spark.range(3))
    release(spark)
    with pytest.raises(Exception):
        spark.read.parquet(*kept.inputFiles()).count()
