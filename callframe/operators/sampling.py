"""Seeded samples, quotas and top rows per group."""

from __future__ import annotations

import hashlib
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def exact_lines(total: int, count: int, seed: int) -> list[int]:
    """Exact mode: sorted 0-based indices drawn without replacement by Python's generator."""
    if not 0 <= count <= total:
        raise ValueError(f"cannot draw {count} of {total}")
    return sorted(random.Random(seed).sample(range(total), count))


def hash_rank(key, seed: int):
    return F.sha2(F.concat(F.lit(f"{seed}:"), key.cast("string")), 256)


def hash_sample(rows: DataFrame, key: str, count: int, seed: int) -> DataFrame:
    """The `count` rows with the lowest seeded hash of their key, a top-k without a full sort. NULL keys are never drawn."""
    ranked = rows.filter(F.col(key).isNotNull()).withColumn("_h", hash_rank(F.col(key), seed))
    return ranked.orderBy("_h", key).limit(count).drop("_h")


def quotas(sizes: dict[str, int], count: int) -> dict[str, int]:
    """Proportional quotas: one per stratum if count allows, then always to the least filled share; ties by name."""
    if not 0 <= count <= sum(sizes.values()):
        raise ValueError(f"cannot draw {count} of {sum(sizes.values())}")
    got = {s: int(count >= len(sizes)) for s in sizes}
    while sum(got.values()) < count:
        s = min((s for s in sizes if got[s] < sizes[s]), key=lambda s: (got[s] / sizes[s], s))
        got[s] += 1
    return got


def balanced(single: int, multi: int, count: int) -> tuple[int, int]:
    """Half single, half multi, each shortfall handed to the other."""
    a = min(single, count // 2)
    b = min(multi, count - a)
    return min(single, count - b), b


def stable_random(seed: int, label: str) -> random.Random:
    return random.Random(int.from_bytes(hashlib.sha256(f"{seed}:{label}".encode()).digest()[:8], "big"))


def stratified_sample(rows: DataFrame, stratum: str, key: str, count: int, seed: int) -> DataFrame:
    """Quota rows of each stratum with the lowest seeded hash; strata are few (their counts reach the driver).

    The highest quota is a literal limit first, so every task keeps no more rows of a stratum than that before the shuffle.
    """
    sizes = {r[0]: r[1] for r in rows.filter(F.col(stratum).isNotNull()).groupBy(stratum).count().collect()}
    wanted = quotas(sizes, count)
    quota = rows.sparkSession.createDataFrame([*wanted.items()], f"`{stratum}` string, quota bigint")
    hashed = rows.filter(F.col(stratum).isNotNull()).withColumn("_h", hash_rank(F.col(key), seed))
    most = top_per_group(hashed, [stratum], ["_h", key], max(wanted.values(), default=0), "_rank")
    return most.join(F.broadcast(quota), stratum).filter("_rank <= quota").drop("_h", "_rank", "quota")  # one row a stratum


def top_per_group(rows: DataFrame, by: list[str], order: list, n: int, rank: str | None = None) -> DataFrame:
    """The first n rows of each group, with their rank if a name is given.

    n is a literal, so the window limits each group per task before the shuffle, and groups may be large.
    """
    out = rows.withColumn(rank or "_rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank or "_rank") <= n)
    return out if rank else out.drop("_rank")


def top_labels(rows: DataFrame, label: str, n: int) -> DataFrame:
    """(label, n): the most frequent labels, ties by name."""
    return rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "label").limit(n)


def most_common(rows: DataFrame, label: str, order: str, n: int) -> DataFrame:
    """(label, n): the most frequent labels, ties by first appearance."""
    agg = rows.filter(F.col(label).isNotNull()).groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), F.min(order).alias("_first"))
    return agg.orderBy(F.desc("n"), "_first").limit(n).drop("_first")


def by_priority(rows: DataFrame, label: str, priority: tuple[str, ...], order: str) -> DataFrame:
    """rows with queue_position: by the place of their label in `priority` (others last), then by input order."""
    place = F.array_position(F.array(*map(F.lit, priority)), F.col(label))
    key = F.when(F.coalesce(place, F.lit(0)) == 0, len(priority) + 1).otherwise(place)
    return rows.withColumn("priority", key).orderBy("priority", order)
