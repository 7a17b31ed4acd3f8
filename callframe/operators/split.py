"""Splits that hold tools out and keep requests together."""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callframe.functions.skew import lookup_join
from callframe.functions.staging import stage
from callframe.functions.text import group_key, user_text
from callframe.operators.calls import tool_names

SEED, LEAST_SAMPLES, UNSEEN_SHARE, TRAIN_SHARE = 42, 10, 0.05, 0.9
SPLITS = ("train", "dev_seen", "test_seen", "test_unseen_tools")


def keyed(samples: DataFrame) -> DataFrame:
    """samples with group_key (SHA-256 of the collapsed user text) and tool_names."""
    return samples.withColumn("group_key", group_key(user_text("messages"))).withColumn("tool_names", tool_names(F.col("tools")))


def tool_frequency(samples: DataFrame) -> DataFrame:
    """(tool_name, samples): number of samples that list a tool; twice in a sample counts once."""
    return samples.select(F.explode(tool_names(F.col("tools"))).alias("tool_name")).groupBy("tool_name").agg(F.count("*").alias("samples"))


def hold_out(tool_groups: dict[str, dict[str, int]], frequency: dict[str, int], total: int, seed: int = SEED, least: int = LEAST_SAMPLES, share: float = UNSEEN_SHARE) -> tuple[list[str], set[str]]:
    """(held-out tools, unseen groups): eligible tools in seeded order, taken iff that comes strictly closer to the target.

    tool_groups: tool -> {group: samples in it}. Groups move whole, so a group that an earlier
    tool took adds nothing for a later one.
    """
    order = sorted(t for t, n in frequency.items() if n >= least)
    random.Random(seed).shuffle(order)
    target, held, unseen, n = round(total * share), [], set(), 0
    for tool in order:
        if n >= target and held:
            break
        new = {g: k for g, k in tool_groups.get(tool, {}).items() if g not in unseen}
        if new and abs(target - n - sum(new.values())) < abs(target - n):
            held.append(tool)
            unseen |= new.keys()
            n += sum(new.values())
    return held, unseen


def select_unseen(samples: DataFrame, seed: int = SEED, least: int = LEAST_SAMPLES, share: float = UNSEEN_SHARE) -> tuple[list[str], DataFrame]:
    """(held-out tools, unseen group keys) of keyed samples, by the rule of `hold_out`.

    The greedy walk over the tools runs on the driver with one number a tool: how many samples of
    groups that are not yet unseen list it. That is one aggregation for each tool that is
    accepted; no group reaches the driver. The tools themselves are taken to be a bounded list.
    """
    total = samples.count()
    order = sorted(r[0] for r in tool_frequency(samples).filter(F.col("samples") >= least).collect())
    random.Random(seed).shuffle(order)
    sizes = samples.groupBy("group_key").agg(F.count("*").alias("n"))
    listed = stage(samples.select("group_key", F.explode("tool_names").alias("tool_name")).distinct(), "listed")
    pairs = stage(lookup_join(listed, sizes, "group_key"), "tool-groups")
    target, held, n, at = round(total * share), [], 0, 0
    left = pairs
    while at < len(order) and (n < target or not held):
        new = {r[0]: r[1] for r in left.groupBy("tool_name").agg(F.sum("n").alias("n")).collect()}
        while at < len(order) and not (new.get(order[at], 0) and abs(target - n - new[order[at]]) < abs(target - n)):
            at += 1
        if at < len(order):
            tool = order[at]
            held.append(tool)
            n += new[tool]
            at += 1
            left = stage(left.join(left.filter(F.col("tool_name") == tool).select("group_key").distinct(), "group_key", "left_anti"), "tool-groups")
    chosen = samples.sparkSession.createDataFrame([(t,) for t in held], "tool_name string")
    return held, listed.join(F.broadcast(chosen), "tool_name").select("group_key").distinct()  # one row a tool


def shuffled_90_5_5(groups: list[str], seed: int = SEED) -> dict[str, str]:
    """Exact mode on a list: a seeded permutation of the distinct sorted groups, cut 90/10, and the rest again in halves."""
    names = sorted(set(groups))
    train, dev, _ = _cuts(len(names), seed)
    return {g: SPLITS[0] if i in train else SPLITS[1] if i in dev else SPLITS[2] for i, g in enumerate(names)}


def _cuts(n: int, seed: int) -> tuple[set[int], set[int], set[int]]:
    """Ranks of the sorted groups that go to train, dev_seen and test_seen."""
    if n < 3:
        raise ValueError("at least three groups are needed")
    order = np.random.RandomState(seed).permutation(n)
    rest = np.sort(order[: n - int(np.floor(TRAIN_SHARE * n))])
    again = np.random.RandomState(seed + 1).permutation(len(rest))
    cut = len(rest) - int(np.floor(0.5 * len(rest)))
    return {*order[len(rest) :].tolist()}, {*rest[again[cut:]].tolist()}, {*rest[again[:cut]].tolist()}


def seeded_split(samples: DataFrame, seed: int = SEED) -> DataFrame:
    """keyed samples with `split`: per source, the distinct groups in sorted order permuted by numpy's seeded generator and cut 90/5/5.

    A group that spans sources, a NULL source and a source with fewer than three groups are
    errors. Ranks of the groups come from a range-partitioned sort; the permutation depends on
    their number alone and is made once per source in a task (a few bytes a group), so no group
    reaches the driver.
    """
    if not samples.filter(F.col("source").isNull()).isEmpty():
        raise ValueError("a sample has no source")
    torn = cross_source_groups(samples).count()
    if torn:
        raise ValueError(f"{torn} groups span several sources")
    groups = stage(samples.select("source", "group_key").distinct().repartitionByRange("source", "group_key").sortWithinPartitions("source", "group_key").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id()), "groups")
    sizes = groups.groupBy("source").count()
    few = sizes.filter("count < 3").limit(5).collect()
    if few:
        raise ValueError(f"sources with fewer than three groups: {[r[0] for r in few]}")
    # Partitions are in order: a rank is the number of groups of the source in those before, and the place within.
    before = groups.groupBy("source", "_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_low"))
    base = before.withColumn("_base", F.sum("_n").over(Window.partitionBy("source").orderBy("_p")) - F.col("_n"))
    ranked = groups.join(base, ["source", "_p"]).select("source", "group_key", (F.col("_base") + F.col("_i") - F.col("_low")).alias("rank"))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for source, n in zip(frame["source"], frame["count"]):
                for split, ranks in zip(SPLITS, _cuts(n, seed)):
                    ranks = np.array(sorted(ranks), np.int64)
                    for at in range(0, len(ranks), 100_000):
                        yield pd.DataFrame({"source": source, "rank": ranks[at : at + 100_000], "split": split})

    places = sizes.repartition("source").mapInPandas(cut, "source string, rank bigint, split string")
    return lookup_join(samples, ranked.join(places, ["source", "rank"]).select("group_key", "split"), "group_key")


def split_dataset(samples: DataFrame, seed: int = SEED, **options) -> tuple[list[str], DataFrame]:
    """(held-out tools, keyed samples with `split`): groups of held-out tools are unseen, the others are split per source by `seeded_split`."""
    k = stage(keyed(samples), "keyed")
    held, unseen = select_unseen(k, seed, **options)
    unseen = stage(unseen, "unseen")
    marked = lookup_join(k, unseen.withColumn("_unseen", F.lit(True)), "group_key", "left")
    seen = seeded_split(marked.filter(F.col("_unseen").isNull()).drop("_unseen"), seed)
    out = marked.filter("_unseen").drop("_unseen").withColumn("split", F.lit(SPLITS[3]))
    return held, seen.select(out.columns).unionByName(out)


def hash_split(samples: DataFrame, seed: int = SEED, by: str = "group_key") -> DataFrame:
    """samples with `split` from a hash of the group: about 90/5/5, narrow, stable as data grow."""
    place = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(by)), 256), 1, 8), 16, 10).cast("bigint")
    share = place / F.lit(float(1 << 32))
    return samples.withColumn("split", F.when(share < TRAIN_SHARE, SPLITS[0]).when(share < (1 + TRAIN_SHARE) / 2, SPLITS[1]).otherwise(SPLITS[2]))


def split_by_tools(samples: DataFrame, heldout: DataFrame, seed: int = SEED) -> DataFrame:
    """samples with `split`: whole groups with a held-out tool are unseen, the others split by hash."""
    k = keyed(samples)
    hit = k.select("group_key", F.explode("tool_names").alias("tool_name")).join(heldout.select("tool_name").distinct(), "tool_name", "left_semi")
    unseen = hit.select("group_key").distinct().withColumn("_unseen", F.lit(True))
    out = lookup_join(hash_split(k, seed), unseen, "group_key", "left", counted=k.select("group_key"))
    return out.withColumn("split", F.when(F.col("_unseen"), SPLITS[3]).otherwise(F.col("split"))).drop("_unseen")


def cross_source_groups(samples: DataFrame) -> DataFrame:
    """(group_key, sources): groups that span sources and cannot be split by source."""
    return samples.groupBy("group_key").agg(F.count_distinct("source").alias("sources")).filter("sources > 1")


def split_overlaps(assigned: DataFrame, key: str, splits: tuple[str, ...] = SPLITS) -> DataFrame:
    """(left_split, right_split, shared): keys that two splits share, every pair of splits, zero filled."""
    pairs = [(a, b) for i, a in enumerate(splits) for b in splits[i + 1 :]]
    held = assigned.filter(F.col("split").isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("split").alias("s"))  # at most one per split
    sums = held.agg(*[F.count_if(F.array_contains("s", a) & F.array_contains("s", b)).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.array(*[F.struct(F.lit(a).alias("left_split"), F.lit(b).alias("right_split"), F.col(f"c{i}").alias("shared")) for i, (a, b) in enumerate(pairs)])
    return sums.select(F.explode(rows).alias("r")).select("r.*")


def leaked_tools(assigned: DataFrame, heldout: DataFrame, splits: tuple[str, ...] = SPLITS[:3]) -> DataFrame:
    """(split, samples): samples of seen splits that list a held-out tool, zero filled."""
    rows = assigned.filter(F.col("split").isin(*splits)).select("split", "sample_id", F.explode(tool_names(F.col("tools"))).alias("tool_name"))
    hit = rows.join(heldout.select("tool_name").distinct(), "tool_name", "left_semi").groupBy("split").agg(F.count_distinct("sample_id").alias("samples"))
    fixed = assigned.sparkSession.createDataFrame([(s,) for s in splits], "split string")
    return fixed.join(hit, "split", "left").na.fill(0, ["samples"])


def source_distribution(assigned: DataFrame) -> DataFrame:
    """(split, source, samples)."""
    return assigned.groupBy("split", "source").agg(F.count("*").alias("samples"))


def first_delivery(samples: DataFrame, key: str = "sample_id", order: str = "line_number") -> DataFrame:
    """The first row of each key in the order of a unique column; later ones are dropped, rows with a NULL key all stay.

    Only keys and order are shuffled to find the first; the rows meet it in a salted join.
    """
    first = samples.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_first"))
    met = lookup_join(samples, first, key, "left")
    return met.filter(F.col(key).isNull() | (F.col(order) == F.col("_first"))).drop("_first").select(samples.columns)
