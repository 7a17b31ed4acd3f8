import json

from hypothesis import given, settings

from callframe.functions.jsonx import leaves
from callframe.operators import shred
from callframe.plans import training
from tests.test_jsonx import VALUES


def all_members(value):
    return shred.members(value, shred.identities(value))


def test_schema_paths():
    schema = {"properties": {"a": {"properties": {"b": {}}}, "c": {"items": {"items": {"properties": {"d": {}}}}}, "e": None}, "items": {"properties": {"f": 1}}}
    assert {p for _, _, p in shred.schema_paths(schema)} == {"a", "a.b", "c", "c[][].d", "e", "[].f"}
    for odd in (None, 1, [], {"properties": []}, {"items": 5}):
        assert shred.schema_paths(odd) == []


@settings(max_examples=150, deadline=None)
@given(VALUES)
def test_leaf_paths(value):
    got = [p for _, _, p in shred.leaf_paths(value)]
    assert sorted(got) == sorted({p for p, _ in leaves(value)})
    assert {m.path for m in all_members(value) if m.kind not in ("object", "array")} == set(got)


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_identity_ignores_key_order_only(value):
    def turned(v):
        return {k: turned(v[k]) for k in reversed(v)} if isinstance(v, dict) else [turned(x) for x in v] if isinstance(v, list) else v

    other = turned(value)
    assert shred.identities(value)[id(value)][0] == shred.identities(other)[id(other)][0]
    assert sorted(map(str, all_members(value))) == sorted(map(str, all_members(other)))


def test_identity_tells_values_apart():
    roots = [1, 1.0, True, "1", None, [], {}, [1], {"a": 1}, {"a": [1]}, [[]], [{}], ["a"], {"a": None}]
    assert len({shred.identities(v)[id(v)][0] for v in roots}) == len(roots)


def rebuild(nodes, root):
    """The value back from the store of distinct nodes."""
    kind, body = nodes[root]
    if kind == "object":
        return {k: rebuild(nodes, h) for k, h in json.loads(body).items()}
    if kind == "array":
        return [rebuild(nodes, h) for h in json.loads(body)]
    return json.loads(body)


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_round_trip(value):
    ids = shred.identities(value)
    store = {h.hex(): (k, b) for h, k, b in ids.values()}
    assert rebuild(store, ids[id(value)][0].hex()) == value


@settings(max_examples=100, deadline=None)
@given(VALUES)
def test_members_hold_every_place(value):
    rows = all_members(value)

    def places(v):
        return 1 + sum(map(places, v.values() if isinstance(v, dict) else v if isinstance(v, list) else ()))

    assert len(rows) == places(value) and {m.node for m in rows} == {n for n, _, _ in shred.identities(value).values()}
    assert [m.path for m in rows if m.parent is None] == [""] and {m.parent for m in rows[1:]} <= {m.node for m in rows}


def stored(s):
    return {r.node.hex(): (r.kind, r.body) for r in s.nodes.collect()}


def test_store_rebuilds_every_text(spark, samples, row):
    schema = '{"type":"object","description":"d","properties":{"q":{"type":"string","enum":["x",null]},"r":{"type":"array","items":{"properties":{"s":{"type":"integer"}}}}},"required":["q"]}'
    texts = {("param", 0): schema, ("param", 1): "{}", ("param", 2): '"odd"', ("argument", 0): '{"a":{"b":1},"a.b":2.0}', ("argument", 1): "[]", ("argument", 2): "7"}
    of = lambda child: [("f", t) for (c, _), t in texts.items() if c == child]
    s = shred.shred(shred.occurrences(samples(row(1, "s1", tools=of("param"), calls=of("argument")))))
    store, rows = stored(s), shred.bridge(s).collect()
    roots = {(r.child, r.parent_index): rebuild(store, r.node.hex()) for r in rows if r.parent is None}
    assert roots == {k: json.loads(t) for k, t in texts.items()}
    assert all(r.parent is None or r.parent.hex() in store for r in rows)
    # Two places whose paths read the same stay two places.
    assert [r.path for r in rows if (r.child, r.parent_index) == ("argument", 0)].count("a.b") == 2


def test_store_query_is_whole(spark, data):
    nodes = {r.node: (r.kind, r.body, r.occurrences) for r in training.p2_nodes(spark, data).collect()}
    named = {h for kind, body, _ in nodes.values() if kind in ("object", "array") for x in [json.loads(body)] for h in (x.values() if kind == "object" else x)}
    assert named and named <= nodes.keys()
    rows = training.p2_bridge(spark, data).collect()
    assert {r.node for r in rows} == set(nodes) and {r.parent for r in rows} - {None} <= set(nodes)
    assert len(rows) == sum(n for _, _, n in nodes.values())


def test_every_record_comes_back(spark, data):
    samples, audits = spark.read.parquet(f"{data}/canonical_samples.parquet"), spark.read.parquet(f"{data}/tool_call_audits.parquet")
    texts = {(r.child, r.record_id, r.parent_index): r.text for r in shred.all_texts(samples, audits).collect() if r.text is not None}
    nodes = {r.node: (r.kind, r.body) for r in training.p2_nodes(spark, data).collect()}
    roots = {(r.child, r.record_id, r.parent_index): r.node for r in training.p2_bridge(spark, data).filter("parent IS NULL").collect()}
    assert {k: rebuild(nodes, n) for k, n in roots.items()} == {k: json.loads(t) for k, t in texts.items()}


def test_found_rows_come_through_the_trees(spark, data, monkeypatch):
    want = {tuple(r) for r in training.p2_found(spark, data).collect()}
    real = shred.shred
    monkeypatch.setattr(shred, "shred", lambda t: (lambda s: s._replace(trees=s.trees.limit(0)))(real(t)))
    assert want and training.p2_found(spark, data).count() == 0


def test_hot_trees_are_salted(spark, samples, row, monkeypatch):
    from callframe.functions import skew

    df = samples(*[row(i, f"s{i}", calls=[("t", '{"a":1}' if i % 3 else f'{{"a":{i}}}')]) for i in range(300)])
    want = sorted(map(tuple, shred.flat_paths(shred.shred(shred.occurrences(df))).collect()))
    monkeypatch.setattr(skew.hot_keys, "__defaults__", (0.01, 50))
    got = shred.flat_paths(shred.shred(shred.occurrences(df)))
    assert "_salt" in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(map(tuple, got.collect())) == want and len(want) == 300


def test_odd_texts(spark, samples, row):
    args = '{"a":{"x":1},"b":[{"x":1},null]}'
    df = samples(
        row(1, "s1", tools=[("t", '{"properties":{"q":{"type":"string"},"r":{"type":"string"}}}'), ("u", None)], calls=[("t", args), ("t", args), ("t", "{bad")]),
        row(2, "s1", calls=[("t", "{}"), ("t", None), ("t", "[" * 50_000), ("t", '{"a\\ud800":"\\ud800"}')]),
        row(3, None, text=None),
    )
    s = shred.shred(shred.occurrences(df))
    flat = sorted((r.child, r.record_id, r.parent_index, r.node_path) for r in shred.flat_paths(s).collect())
    assert flat == sorted([("argument", 1, i, p) for i in (0, 1) for p in ("a.x", "b[0].x", "b[1]")] + [("argument", 2, 3, "a\\ud800")] + [("param", 1, 0, p) for p in "qr"])
    assert {(r.record_id, r.parent_index, r.error.split(":")[0]) for r in s.rejects.collect()} == {(1, 2, "JSONDecodeError"), (2, 2, "RecursionError")} or {
        (r.record_id, r.parent_index) for r in s.rejects.collect()
    } == {(1, 2), (2, 2)}
    counts = {(r.kind, r.body): r.occurrences for r in shred.distinct_nodes(s).collect()}
    assert counts[("integer", "1")] == 4 and counts[("null", "null")] == 2


AUDIT = "audit_id bigint, argument_schema_validation struct<schema_checked boolean, issue_details array<struct<issue string, argument_path string, allowed_values array<string>, schema_errors array<struct<schema_path string, reason string>>>>>"


def test_audits(spark):
    rows = [
        (1, (True, [("i", "$.a", ['a"b', "c"], None), ("j", None, None, [("$.p", "r"), ("$.p", "s"), (None, "t"), ("$.q", None)]), None])),
        (2, (None, None)),
        (3, None),
        (4, (False, [])),
    ]
    s = shred.shred(shred.audit_occurrences(spark.createDataFrame(rows, AUDIT)))
    got = sorted((r.child, r.record_id, r.parent_index, r.node_path) for r in shred.flat_paths(s).collect())
    assert got == [("issue", 1, 0, "$.a"), ("schema_error", 1, 1, "$.p"), ("schema_error", 1, 1, "$.q")]
    store = stored(s)
    roots = {r.record_id: rebuild(store, r.node.hex()) for r in shred.bridge(s).collect() if r.parent is None}
    assert roots[2] == {"schema_checked": None, "issue_details": None} and roots[4] == {"schema_checked": False, "issue_details": []} and 3 not in roots
    assert roots[1]["issue_details"][0]["allowed_values"] == ['a"b', "c"] and roots[1]["issue_details"][2] is None


def test_empty_table(samples):
    s = shred.shred(shred.occurrences(samples()))
    assert shred.bridge(s).count() == 0 and shred.flat_paths(s).count() == 0 and s.rejects.count() == 0
