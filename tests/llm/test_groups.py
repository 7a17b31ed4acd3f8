import random

import pytest

from callframe.llm import groups


def plain_components(edges):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    return {n: find(n) for n in up}


@pytest.mark.parametrize("shape", ["random", "chain", "star", "pairs", "loops"])
def test_components(spark, shape):
    r = random.Random(3)
    name = lambda i: f"n{i:05d}"
    edges = {
        "random": [(name(r.randrange(300)), name(r.randrange(300))) for _ in range(220)],
        "chain": [(name(i), name(i + 1)) for i in range(400)],
        "star": [("hub", name(i)) for i in range(400)],
        "pairs": [(name(2 * i), name(2 * i + 1)) for i in range(100)],
        "loops": [(name(i), name(i)) for i in range(20)] * 2,
    }[shape]
    r.shuffle(edges)
    df = spark.createDataFrame(edges, "a string, b string").repartition(7)
    assert {x.node: x.root for x in groups.components(df).collect()} == plain_components(edges)


def test_small_forests_agree_with_large_ones(spark, monkeypatch):
    edges = [(f"n{i}", f"n{i * 7 % 101}") for i in range(300)]
    monkeypatch.setattr(groups, "FOREST_NODES", 5)
    got = groups.components(spark.createDataFrame(edges, "a string, b string").repartition(5))
    assert {x.node: x.root for x in got.collect()} == plain_components(edges)


@pytest.mark.parametrize("shape", ["chain", "random", "star"])
def test_stars_contract_any_graph(spark, shape):
    r = random.Random(9)
    name = lambda i: f"n{i:05d}"
    order = r.sample(range(60), 60)
    edges = {
        "chain": [(name(order[i]), name(order[i + 1])) for i in range(59)],
        "random": [(name(r.randrange(60)), name(r.randrange(60))) for _ in range(40)],
        "star": [(name(7), name(i)) for i in range(60) if i != 7],
    }[shape]
    edges = [(a, b) for a, b in edges if a != b]
    got = groups._stars(spark.createDataFrame(edges, "a string, b string"))
    rows = got.collect()
    assert len(rows) == len({x.node for x in rows}) and {x.node: x.root for x in rows} == plain_components(edges)


def test_a_graph_that_does_not_shrink_goes_to_the_stars(spark, monkeypatch):
    called = []
    real = groups._stars
    monkeypatch.setattr(groups, "_stars", lambda e: called.append(1) or real(e))
    monkeypatch.setattr(groups, "FOREST_NODES", 4)
    monkeypatch.setattr(groups, "SHRINK", 0.0)
    order = random.Random(2).sample(range(120), 120)
    edges = [(f"n{order[i]:03d}", f"n{order[i + 1]:03d}") for i in range(119)]
    got = groups.components(spark.createDataFrame(edges, "a string, b string").repartition(6))
    assert {x.node: x.root for x in got.collect()} == plain_components(edges) and called


def test_null_ends_and_empty(spark):
    assert groups.components(spark.createDataFrame([], "a string, b string")).count() == 0
    assert groups.components(spark.createDataFrame([(None, "x"), ("y", None)], "a string, b string")).count() == 0


def test_request_groups(spark, samples, row):
    held = spark.createDataFrame([("web", 1), (None, 1)], "tool_name string, split_seed int")
    df = samples(
        row(1, "b", text="Hello  World"),
        row(2, "a", text="hello　world "),
        row(3, "a", text="hello　world "),
        row(4, "c", text="alone", tools=[("web", "{}")]),
        row(5, "d", text="alone2", tools=[("web_2", "{}"), (None, None)]),
        row(6, "e", text=None),
        row(7, "f", text=""),
        row(8, None, text="hello world"),
    )
    got = {(r.group_id, r.sample_id, r.members, r.pool) for r in groups.request_groups(df, held).collect()}
    assert got == {("a", "a", 2, "seen"), ("a", "b", 2, "seen"), ("c", "c", 1, "unseen"), ("d", "d", 1, "seen"), ("e", "e", 2, "seen"), ("e", "f", 2, "seen")}
    assert groups.request_groups(samples(), held).count() == 0


def test_quota_is_the_greedy_rule():
    targets = {"train": 0.9, "dev": 0.05, "test": 0.05}
    r = random.Random(1)
    sizes = {s: r.randrange(1, 400) for s in (1, 2, 3, 7, 50)}
    total = sum(s * n for s, n in sizes.items())
    lack = {s: t * total for s, t in targets.items()}
    for size in sorted(sizes, reverse=True):
        for _ in range(sizes[size]):
            s = max(targets, key=lambda t: (lack[t], -[*targets].index(t)))
            lack[s] -= size
    got = groups.greedy_quota([*sizes.items()], targets)
    assert {s: sum(k for _, k in v) for s, v in got.items()} == sizes
    dealt = {t: sum(size * k for size, v in got.items() for s, k in v if s == t) for t in targets}
    for t in targets:
        assert abs(dealt[t] - (targets[t] * total - lack[t])) <= max(sizes)


@pytest.mark.parametrize("ranges", [100_000, 10])
def test_splits_keep_groups_together(spark, samples, row, monkeypatch, ranges):
    monkeypatch.setattr(groups, "RANK_ROWS", ranges)
    rows = [row(i, f"s{i:04d}", text=f"text {i if i < 300 else i % 20}", tools=[("web" if i % 50 == 0 else "t", "{}")]) for i in range(500)]
    held = spark.createDataFrame([("web", 1)], "tool_name string, split_seed int")
    grouped = groups.request_groups(samples(*rows), held)
    targets = {"train": 0.9, "dev_seen": 0.05, "test_seen": 0.05}
    got = groups.assign_splits(grouped, targets).collect()
    assert len({r.sample_id for r in got}) == len(got) == 500
    by = {}
    for r in got:
        by.setdefault(r.group_id, set()).add(r.split)
    assert all(len(s) == 1 for s in by.values())
    pools = {r.sample_id: r.pool for r in grouped.collect()}
    assert all((r.split == "test_unseen_tools") == (pools[r.sample_id] == "unseen") for r in got)
    seen = [r.split for r in got if r.split != "test_unseen_tools"]
    assert abs(seen.count("train") / len(seen) - 0.9) < 0.05
    again = groups.assign_splits(groups.request_groups(samples(*reversed(rows)).repartition(3), held), targets).collect()
    assert {(r.sample_id, r.split) for r in got} == {(r.sample_id, r.split) for r in again}
