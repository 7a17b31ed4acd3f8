"""Reproducible sample that is stable as data grows: nested hash buckets.

A key belongs for ever to one of 2^20 fine buckets (the first 20 bits of its SHA-256). The
buckets stand in one order, a fixed permutation, and a sample of rate r is the first
r * 2^20 of that list. The list is only ever appended to: a higher rate keeps all members
of a lower one, and rows that arrive later change no member.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 20
BUCKETS = 1 << BITS
#: The permutation of the buckets, slot = (bucket * ODD + SHIFT) mod 2^20.
ODD, SHIFT = 654_321, 271_828


def bucket(key: Column) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, BITS // 4), 16, 10).cast("bigint")


def slot(bucket_: Column) -> Column:
    """Place of a bucket in the append-only list."""
    return (bucket_ * F.lit(ODD) + F.lit(SHIFT)) % F.lit(BUCKETS)


def select_sample(rows: DataFrame, key: str, rate: float) -> DataFrame:
    """(key, slot) of the selected keys, each once. Narrow but for the distinct; NULL keys are never selected."""
    if not 0 <= rate <= 1:
        raise ValueError("the rate is a share from 0 to 1")
    marked = rows.select(F.col(key)).filter(F.col(key).isNotNull()).withColumn("slot", slot(bucket(F.col(key))))
    return marked.filter(F.col("slot") < F.lit(round(rate * BUCKETS))).distinct()


def growth(rows: DataFrame, key: str, batch: str, rates: list[float]) -> DataFrame:
    """(batch_no, rate, members, added, lost) of the samples drawn anew after each load batch.

    The sample of every prefix of batches is selected by itself, and compared with those of the
    earlier prefixes: `lost` counts members of an earlier one that are missing. Rows with a NULL
    batch belong to no prefix. The list of batches is bounded by the loads, not by the rows.
    """
    batches = sorted(r[0] for r in rows.select(batch).filter(F.col(batch).isNotNull()).distinct().collect())
    spark = rows.sparkSession
    grid = spark.createDataFrame([(b, i, float(r), round(r * BUCKETS)) for i, b in enumerate(batches) for r in rates], "batch_no bigint, at int, rate double, cut bigint")
    if not batches:
        return grid.select("batch_no", "rate", F.lit(0).cast("bigint").alias("members"), F.lit(0).cast("bigint").alias("added"), F.lit(0).cast("bigint").alias("lost"))
    drawn = None
    for i, b in enumerate(batches):
        for r in rates:
            one = select_sample(rows.filter(F.col(batch) <= b), key, r).select(key, F.lit(i).alias("at"), F.lit(float(r)).alias("rate"))
            drawn = one if drawn is None else drawn.unionByName(one)
    # At most one number per batch is gathered for a key.
    held = drawn.groupBy(key, "rate").agg(F.collect_set("at").alias("held"))
    each = held.select("rate", "held", F.array_min("held").alias("since"), F.explode(F.sequence(F.lit(0), F.lit(len(batches) - 1))).alias("at"))
    now = F.array_contains("held", F.col("at"))
    sums = each.groupBy("at", "rate").agg(F.count_if(now).alias("members"), F.count_if(now & (F.col("since") == F.col("at"))).alias("added"), F.count_if(~now & (F.col("since") < F.col("at"))).alias("lost"))
    return grid.join(sums, ["at", "rate"], "left").select("batch_no", "rate", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("members", "added", "lost")])
