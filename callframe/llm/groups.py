"""Splits that keep related records together.

Distributed union-find: every task folds its edges into local forests, the forests are
merged where they share a node, and the contracted graph goes through the same step over
fewer, larger forests until no node has two roots. What is left of the graph is folded in one
forest as soon as it fits; if it is larger and does not shrink (long chains over all
tasks), rounds of star operations contract it without gathering it. Then whole groups go,
largest first, to the split furthest below its target.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callframe.functions.skew import lookup_join
from callframe.functions.staging import partitions, stage
from callframe.functions.text import group_key, user_text

#: Nodes that one local forest may hold before it is written and a new one begun.
FOREST_NODES = 400_000
#: A level that leaves more than this share of the torn roots does not shrink the graph.
SHRINK = 0.7
#: Sorts after every record id, so that the smallest node of a group is a record.
HUB = "\U0010ffff"
#: Groups of one size that a task orders when ranks are counted.
RANK_ROWS = 100_000


def local_forests(edges: DataFrame) -> DataFrame:
    """(node, root) of forests built over the edges of each task; roots are the smallest node of their tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        up: dict[str, str] = {}

        def root(x: str) -> str:
            r = x
            while (p := up[r]) != r:
                r = p
            while (p := up[x]) != r:
                up[x] = r
                x = p
            return r

        def flush() -> Iterator[pa.RecordBatch]:
            nodes = [*up]
            for at in range(0, len(nodes), 50_000):
                part = nodes[at : at + 50_000]
                yield pa.RecordBatch.from_pydict({"node": part, "root": [root(n) for n in part]})
            up.clear()

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                up.setdefault(a, a)
                up.setdefault(b, b)
                x, y = root(a), root(b)
                if x != y:
                    up[max(x, y)] = min(x, y)
            if len(up) > FOREST_NODES:
                yield from flush()
        yield from flush()

    return edges.select("a", "b").mapInArrow(run, "node string, root string")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of the connected component of every node of the edges (a, b).

    Edges with a NULL end are ignored; a node alone can be given as an edge to itself. A node
    that every task has seen comes once from each forest, not once per edge, so a hub does
    not gather its edges. Rounds end when no forest disagrees with another.
    """
    links = stage(local_forests(edges.filter(F.col("a").isNotNull() & F.col("b").isNotNull())), "forest")
    return _merge(links, partitions(links))


def _merge(links: DataFrame, parts: int, before: int | None = None) -> DataFrame:
    least = links.groupBy("node").agg(F.min("root").alias("least"), F.max("root").alias("most"))
    torn = least.filter("least < most").select("node", "least")
    seams = stage(links.join(torn, "node").filter("root > least").select(F.col("root").alias("a"), F.col("least").alias("b")).distinct(), "seams")
    n = seams.count()
    if not n:
        return least.select("node", F.col("least").alias("root"))
    if n <= FOREST_NODES // 2:  # one forest holds all of it
        above = local_forests(seams.repartition(1))
    elif before is not None and n > SHRINK * before:
        above = _stars(seams)
    else:  # forests local to the lower root, fewer by half at each level
        parts = max(2, parts // 2)
        above = _merge(stage(local_forests(seams.repartition(parts, "b")), "forest"), parts, n)
    above = above.select(F.col("node").alias("least"), F.col("root").alias("top"))
    mine = stage(least.select("node", "least"), "roots")
    return lookup_join(mine, stage(above, "tops"), "least", "left").select("node", F.coalesce("top", "least").alias("root"))


def _stars(edges: DataFrame) -> DataFrame:
    """(node, root) of any graph (a, b) by alternating large and small stars, which needs about log^2 rounds and gathers nothing.

    Large star: every larger neighbour of a node goes to the least of its neighbourhood; small star: every
    smaller one, and the node itself. When neither changes anything, each node hangs on its component's least.
    """

    def star(e: DataFrame, large: bool) -> DataFrame:
        both = e.select("a", "b").unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        both = stage(both if large else both.filter("b < a"), "star")
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        met = lookup_join(both, low, "a")
        moved = met.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")) if large else met.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b")))
        return stage(moved.filter("a <> b").distinct(), "star")

    def digest(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    now, seen = edges, None
    while (mark := digest(now)) != seen:
        now, seen = star(star(now, True), False), mark
    roots = now.select("b").distinct().select(F.col("b").alias("node"), F.col("b").alias("root"))
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(roots)


def request_groups(samples: DataFrame, heldout: DataFrame) -> DataFrame:
    """(sample_id, group_id, members, pool): one row per sample.

    Samples are linked by equal user text up to case and white space (an empty text is a text
    like any other). group_id is the smallest sample_id; pool is `unseen` if a member lists a
    held-out tool, else `seen`. Re-deliveries count once; NULL ids, tools and tool names are ignored.
    """
    ids = samples.filter(F.col("sample_id").isNotNull())
    edges = ids.select(F.col("sample_id").alias("a"), F.concat(F.lit(HUB), group_key(user_text("messages"))).alias("b"))
    found = components(edges)
    member = stage(found.filter(~F.col("node").startswith(HUB)).select(F.col("node").alias("sample_id"), F.col("root").alias("group_id")), "members")
    listed = ids.select("sample_id", F.explode("tools.function.name").alias("tool_name"))
    unseen = listed.join(heldout.select("tool_name").distinct(), "tool_name", "left_semi").select("sample_id").distinct()
    marked = member.join(unseen.withColumn("held", F.lit(1)), "sample_id", "left")
    groups = marked.groupBy("group_id").agg(F.count("*").alias("members"), F.max("held").alias("held"))
    groups = groups.select("group_id", "members", F.when(F.col("held") == 1, "unseen").otherwise("seen").alias("pool"))
    return lookup_join(member, groups, "group_id")


def greedy_quota(sizes: list[tuple[int, int]], targets: dict[str, float]) -> dict[int, list[tuple[str, int]]]:
    """size -> [(split, groups of that size)]: largest first, each to the split furthest below its target.

    sizes has (size, number of groups), so its length is the number of different sizes, at
    most the square root of twice the rows. Groups of one size are interchangeable, so runs
    of them are dealt by counts. Ties go to the split named first.
    """
    total = sum(s * n for s, n in sizes)
    order = {s: i for i, s in enumerate(targets)}
    lack = {s: t * total for s, t in targets.items()}
    out: dict[int, list[tuple[str, int]]] = {}
    for size, n in sorted(sizes, reverse=True):
        dealt = dict.fromkeys(targets, 0)
        # While all but a few are left, deal what brings every split to a common level.
        if n > 64:
            low, high = min(lack.values()) - size * n, max(lack.values())
            for _ in range(100):
                mid = (low + high) / 2
                take = sum(max(0, int((lack[s] - mid) // size)) for s in targets)
                low, high = (mid, high) if take > n - len(targets) else (low, mid)
            for s in targets:
                k = max(0, int((lack[s] - high) // size))
                dealt[s], lack[s] = k, lack[s] - k * size
        heap = [(-lack[s], order[s], s) for s in targets]
        heapq.heapify(heap)
        for _ in range(n - sum(dealt.values())):
            d, i, s = heap[0]
            heapq.heapreplace(heap, (d + size, i, s))
            dealt[s] += 1
            lack[s] -= size
        out[size] = [(s, k) for s, k in dealt.items() if k]
    return out


def assign_splits(grouped: DataFrame, targets: dict[str, float], unseen: str = "test_unseen_tools") -> DataFrame:
    """(sample_id, group_id, split): unseen groups to their own split, the others greedily.

    Groups of one size are taken in the order of a hash of their id, so reruns agree. Ranks
    within a size come from counts per hash range, not from one ordered task.
    """
    groups = grouped.filter("sample_id = group_id").select("group_id", "members", "pool")
    seen = stage(groups.filter("pool = 'seen'").select("group_id", "members", F.sha2("group_id", 256).alias("h")), "groups")
    sizes = [(r[0], r[1]) for r in seen.groupBy("members").count().collect()]
    spark = grouped.sparkSession
    deals, at = [], {}
    for size, splits in greedy_quota(sizes, targets).items():
        start = 0
        for split, k in splits:
            deals.append((size, split, start, start + k))
            start += k
        at[size] = start
    deal = spark.createDataFrame(deals or [(0, "", 0, 0)], "members bigint, split string, first bigint, last bigint")
    most = max([n for _, n in sizes], default=1)
    ranges = max(1, most // RANK_ROWS)
    ranged = seen.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)))
    counts = ranged.groupBy("members", "range").count()
    before = counts.withColumn("base", F.sum("count").over(Window.partitionBy("members").orderBy("range")) - F.col("count")).drop("count")
    inside = F.row_number().over(Window.partitionBy("members", "range").orderBy("h", "group_id"))
    ranked = ranged.withColumn("n", inside).join(before, ["members", "range"]).withColumn("rank", F.col("base") + F.col("n") - 1)
    chosen = ranked.join(deal, "members").filter("rank >= first AND rank < last").select("group_id", "split")
    chosen = chosen.unionByName(groups.filter("pool = 'unseen'").select("group_id", F.lit(unseen).alias("split")))
    return lookup_join(grouped.select("sample_id", "group_id"), chosen, "group_id")
