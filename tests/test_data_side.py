import json

import pytest
from pyspark.sql import functions as F

from callframe.functions.schema_check import enum_sites, name_tokens, schema_faults, step, value_issues
from callframe.operators import calls, export, normalize, profile, repair, sampling, split, validate


def test_extraction_numbers_calls_across_messages(spark):
    tag = lambda b: f"<tool_call>{b}</tool_call>"
    conv = [("human", tag("no")), ("gpt", tag(" a ") + "x" + tag("b\nc")), ("tool", "t"), ("gpt", tag("d")), ("gpt", None)]
    df = spark.createDataFrame([("s", conv), ("t", None), ("u", [])], "sample_id string, conversations array<struct<`from` string, value string>>")
    assert [tuple(r) for r in calls.extract_calls(df).orderBy("tool_call_index").collect()] == [("s", 1, 0, " a "), ("s", 1, 1, "b\nc"), ("s", 3, 2, "d")]


@pytest.mark.parametrize(
    "value, tools, want",
    [
        ('{"name":"f","arguments":{}}', ["f"], ("f", "top_level_name", True, [])),
        ('{"arguments":{"name":"f"}}', ["f"], ("f", "nested_arguments_name", True, [])),
        ('{"name":"f","arguments":{"name":"g"}}', ["g"], ("f", "top_level_name", False, ["unknown_tool"])),
        ('{"arguments":{}}', ["f"], (None, None, False, ["missing_tool_name"])),
        ('{"name":"f"}', [], ("f", "top_level_name", False, ["missing_tools"])),
        ('{"name":null}', ["f"], (None, "top_level_name", False, ["unknown_tool"])),
        ("[1]", ["f"], (None, None, False, ["missing_tool_name"])),
        ('{"arguments":"{\\"name\\":\\"f\\"}"}', ["f"], (None, None, False, ["missing_tool_name"])),
        (None, None, (None, None, False, ["missing_tool_name"])),
    ],
)
def test_name_layer(spark, value, tools, want):
    r = calls.audit_names(spark.createDataFrame([(value, tools)], "value string, tool_names array<string>")).first()
    assert (r.candidate_name, r.name_source, r.verified, r.name_issues) == want


def test_recovery():
    t = '[{"type": "function", "function": {"name": "f", "parameters": {}}}]'
    one = calls.recover_tools([f"x <tools>{t}</tools>"])
    assert (one["candidates"], one["names"], one["methods"], one["malformed"]) == (1, ["f"], ["strict_system_tools_json"], False)
    assert calls.recover_tools([f"<tools>{t}</tools><tools>{t.replace(chr(34) + 'f' + chr(34), chr(34) + 'g' + chr(34))}</tools>"])["tools"] is None
    split_off = 'pre {"type": "function", "function": <tools>[{"name": "f", "description": "a\tb", "parameters": {}}}]</tools>'
    got = calls.recover_tools([split_off])
    assert got["names"] == ["f"] and got["methods"] == ["stitch_split_function_wrapper_and_escape_controls"] and got["malformed"]
    assert calls.recover_tools(["<tools> </tools>", "none"]) | {"methods": 0} == {"tag_count": 1, "present": False, "malformed": False, "candidates": 0, "tools": None, "names": [], "methods": 0}


def test_escape_controls_inside_strings_only():
    assert calls.escape_controls('{\n"a\tb": "c\\\n", "d\\"\x01": 1}\n') == '{\n"a\\tb": "c\\\n", "d\\"\\u0001": 1}\n'


SCHEMA = {"type": "object", "properties": {"q": {"type": "string", "enum": ["a"]}, "n": {"type": "array", "items": {"type": "integer"}}}, "required": ["q"]}


@pytest.mark.parametrize(
    "value, want",
    [
        ({"q": "a", "n": [1]}, []),
        ({"q": "b"}, [("enum_mismatch", "$.q")]),
        ({"q": "a", "n": [1.0, True]}, [("argument_type_mismatch", "$.n[0]"), ("argument_type_mismatch", "$.n[1]")]),
        ({"a b": 1}, [("unexpected_argument", '$["a b"]'), ("missing_required_argument", "$.q")]),
        ([], [("argument_type_mismatch", "$")]),
    ],
)
def test_value_issues(value, want):
    assert [(d["issue"], d["argument_path"]) for d in value_issues(value, SCHEMA, "$")] == want


def test_rename_hint():
    schema = {"type": "object", "properties": {"userQuestion": {"type": "string"}}, "required": ["userQuestion"]}
    assert [d["issue"] for d in value_issues({"query": "x"}, schema, "$")][-1] == "argument_name_mismatch"
    assert name_tokens("userQueries_ID") == {"user", "question", "id"} and step("$", "é") == "$.é"


def test_schema_faults_and_enum_sites():
    bad = {"type": "dict", "properties": {"a": {"enum": []}, "b": {"type": "integer", "enum": [None]}, "c": 1}, "required": ["a", "a"], "items": {"enum": ["x"], "type": "string"}, "additionalProperties": 3}
    assert [r for _, r in schema_faults(bad)] == [
        "invalid_type",
        "enum_must_be_nonempty_array",
        "enum_has_no_value_matching_declared_type",
        "schema_must_be_object",
        "required_must_be_unique_string_array",
        "additional_properties_must_be_boolean_or_schema",
    ]
    assert [(p, at) for p, _, at, _ in enum_sites(bad)] == [("$.properties.a", ("a",)), ("$.properties.b", ("b",))]


def test_whole_audit(spark, samples, row):
    good = json.dumps(SCHEMA)
    df = samples(row(1, "s", tools=[("f", good)]), row(2, "none"))
    bodies = [
        ('{"name":"f","arguments":{"q":"a"}}', "s", []),
        ('{"name":"f","arguments":{"q":"z"}}', "s", ["enum_mismatch"]),
        ("{'arguments':{'name':'f','q':'a'}}", "s", ["python_literal_syntax", "nested_tool_name"]),
        ('{"name":"g","arguments":{}}', "s", ["unknown_tool"]),
        ('{"name":"f","arguments":{}}', "none", ["missing_tools", "missing_system_tool_definition"]),
        ("{", None, ["unclassified_parse_failure", "missing_tool_name"]),
    ]
    made = spark.createDataFrame([(i, s, b) for i, (b, s, _) in enumerate(bodies)], "call_id bigint, sample_id string, raw_content string")
    got = {r.call_id: r.issues for r in calls.audit_all(made, df).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(bodies)}


def test_enum_investigation(spark):
    defs = spark.createDataFrame([("f", '{"properties":{"a":{"type":"string","enum":[null]},"b":{"type":"integer","enum":["x"]}}}')], "tool_name string, parameters string")
    made = spark.createDataFrame([("f", '{"a":"u"}'), ("f", '{"a":"v","b":1}'), ("g", '{"a":1}')], "tool_name string, arguments string")
    got = {r.schema_path: r for r in calls.investigate_enums(defs, made).collect()}
    a, b = got["$.properties.a"], got["$.properties.b"]
    assert (a.kind, a.observed, a.compatible, a.removable) == ("null_placeholder", 2, 2, True)
    assert (b.kind, b.observed, b.removable) == ("meaningful", 1, False)
    fixed = repair.repair_schemas(defs, calls.investigate_enums(defs, made)).first()
    assert fixed.removed == 1 and "null" not in fixed.parameters and '"x"' in fixed.parameters


def test_repairs(spark):
    rows = [
        ('{"arguments":{"name":"f","x":1}}', ["nested_tool_name"], "f", True),
        ('{"arguments":{"name":"f"}}', ["nested_tool_name"], "f", False),
        ('{"name":"f","arguments":{}}', ["boundary_literal_escape"], "f", True),
        (None, ["unclassified_parse_failure"], None, False),
    ]
    df = spark.createDataFrame([(str(i), *r) for i, r in enumerate(rows)], "sample_id string, value string, issues array<string>, candidate_name string, verified boolean")
    done = repair.repair_calls(df)
    got = [(r.repaired, r.repairs, r.failure) for r in done.orderBy("sample_id").collect()]
    assert got == [
        ('{"arguments":{"x":1},"name":"f"}', ["nested_tool_name"], None),
        ('{"arguments":{"name":"f"}}', [], "nested_name_not_verified"),
        ('{"name":"f","arguments":{}}', ["boundary_literal_escape"], None),
        (None, [], "no_object"),
    ]
    assert [r.status for r in repair.repair_log(done).orderBy("sample_id").collect()] == ["repaired", "repair_failed", "repaired", "repair_failed"]


@pytest.mark.parametrize(
    "name, want",
    [
        ("str", {"type": "string"}),
        ("int, optional", {"type": "integer"}),
        ("str, default 'x'", {"type": "string"}),
        ("set", {"type": "array", "uniqueItems": True}),
        ("Callable[[float], float]", {"type": "string"}),
        ("List[Union[int, float]]", {"type": "array", "items": {"type": "number"}}),
        ("List[List[int]]", {"type": "array", "items": {"type": "array", "items": {"type": "integer"}}}),
        ("Tuple[int, int]", {"type": "array", "items": {"type": "integer"}, "minItems": 2, "maxItems": 2}),
    ],
)
def test_type_grammar(name, want):
    assert normalize.type_schema(name) == want


@pytest.mark.parametrize("name", ["Tuple[int, str]", "", "Foo", "List[", "Tuple[int]]", None, 3])
def test_unknown_types(name):
    with pytest.raises(ValueError):
        normalize.type_schema(name)


def test_normalise_flat(spark):
    tools = '[{"name":"t","description":"d","parameters":{"a":{"type":"int"},"b":{"type":"str","default":"x"},"c":{"type":"str, optional"}}}]'
    rows = [("1", "q", '[{"name":"t","arguments":{"a":1}}]', tools), ("2", "q", "{", tools), ("3", None, "[]", tools), (None, "q", "[]", tools), ("5", "q", "[]", '[{"name":"t"}]')]
    got = normalize.from_flat(spark.createDataFrame(rows, "id string, query string, answers string, tools string")).collect()
    assert json.loads(got[0].tools[0].function.parameters)["required"] == ["a"] and got[0].sample_id == "xlam_1"
    assert got[0].assistant.tool_calls[0].function.arguments == '{"a":1}'
    assert [r.error is None for r in got] == [True, False, False, False, False]
    good, bad = normalize.split_errors(normalize.from_flat(spark.createDataFrame(rows, "id string, query string, answers string, tools string")))
    assert (good.count(), bad.count()) == (1, 4)


def test_normalise_conversations(spark):
    tool = '[{"type":"function","function":{"name":"t","parameters":{"x":1}}}]'
    kind = "id string, category string, subcategory string, task string, tools string, conversations array<struct<`from` string, value string>>, call_items string"
    talk = lambda *roles: [(r, f"v{i}") for i, r in enumerate(roles)]
    rows = [
        ("1", "c", None, "k", tool, talk("system", "human", "gpt"), '[{"name":"t","arguments":{}}]'),
        ("2", "c", None, "k", tool, talk("human", "gpt"), None),
        ("3", "c", None, "k", tool, talk("human", "gpt", "gpt"), None),
        ("4", "c", None, "k", tool, talk("gpt"), None),
        ("5", "c", None, "k", tool, talk("human", "bot", "gpt"), None),
        ("6", "c", None, "k", '[{"type":"x","function":{}}]', talk("human", "gpt"), None),
    ]
    got = normalize.from_conversations(spark.createDataFrame(rows, kind)).collect()
    assert got[0].assistant.content is None and [m.role for m in got[0].messages] == ["system", "user"]
    assert got[0].messages[0].content == normalize.UNIFIED_SYSTEM and got[1].assistant.content == "v1"
    assert [r.error for r in got][2:5] == ["exactly one gpt message is required", "a human message is required", "unknown role"] and got[5].error


def test_validation(spark, samples, row):
    df = samples(
        row(1, "a", tools=[("f", json.dumps(SCHEMA))], calls=[("f", '{"q":"a"}')]),
        row(2, "b", tools=[("f", json.dumps(SCHEMA))], calls=[("f", '{"q":1}')]),
        row(3, "c", calls=[("g", "{}")]),
        row(4, "d"),
        row(5, "a", content="text"),
        row(6, "e", tools=[("f", '{"type":"dict"}')], content="x"),
        row(7, "f", text=None, content="x"),
        row(8, "g", content="x", source=None),
    )
    fixed = spark.createDataFrame([("a",)], "sample_id string")
    lines = validate.canonical_lines(df).unionByName(spark.createDataFrame([(9, "{"), (10, "[]")], "line_number bigint, value string"))
    got = {r.line_number: (r.status, r.issues, r.first) for r in validate.validate(lines, fixed).collect()}
    assert got == {
        1: ("repaired_keep", [], True),
        2: ("manual_review", ["arguments_schema_mismatch"], True),
        3: ("drop", ["unknown_tool"], True),
        4: ("drop", ["empty_assistant_output"], True),
        5: ("repaired_keep", [], False),
        6: ("drop", ["invalid_tool_schema"], True),
        7: ("drop", ["invalid_canonical_structure"], True),
        8: ("drop", ["invalid_canonical_structure"], True),
        9: ("drop", ["invalid_canonical_json"], True),
        10: ("drop", ["invalid_canonical_structure"], True),
    }
    total = validate.summarize(validate.validate(lines)).filter("source IS NULL").first()
    assert (total.keep, total.manual_review, total["drop"], total.total) == (2, 1, 7, 10)


def test_lines_round_trip(spark, samples, row):
    df = samples(row(1, 'q"\\\n', text="t\t ", tools=[('n"', None)], calls=[("c", '{"a": [1.0, null]}')]))
    r = json.loads(validate.canonical_lines(df).first().value)
    assert r["sample_id"] == 'q"\\\n' and r["messages"][1]["content"] == "t\t " and r["tools"][0]["function"]["parameters"] is None
    assert r["assistant"] == {"content": None, "tool_calls": [{"type": "function", "function": {"name": "c", "arguments": {"a": [1.0, None]}}}]}


def test_training_rows(samples, row):
    df = samples(row(1, "a", calls=[("f", '{"x": 1}')]), row(2, "b", calls=[("f", "{}"), ("g", "{}")]), row(3, "c", content="t"), row(4, "d"), row(5, "e", content="t", calls=[("f", "{}")]))
    got = export.to_training(df).orderBy("line_number").collect()
    assert got[0].conversations[-1] == ("function_call", '{"name":"f","arguments":{"x": 1}}')
    assert json.loads(got[1].conversations[-1].value) == [{"name": "f", "arguments": {}}, {"name": "g", "arguments": {}}]
    assert got[2].conversations[-1] == ("gpt", "t") and got[2].conversations[0]["from"] == "human"
    assert [r.error for r in got[3:]] == ["empty answer", "content and calls together"]


def test_benchmark_results(spark):
    queue = spark.createDataFrame([(0, "b"), (1, "a")], "ordinal int, id string")
    p = spark.createDataFrame([("a", "x", 3), ("b", "y", 4)], "id string, raw_prediction string, prompt_tokens int")
    assert [tuple(r) for r in export.benchmark_results(queue, p).collect()] == [(0, "b", "y", 4), (1, "a", "x", 3)]
    with pytest.raises(ValueError):
        export.benchmark_results(queue, p.filter("id = 'a'"))
    assert export.benchmark_results(queue, p.filter("id = 'a'"), partial=True).count() == 1
    with pytest.raises(ValueError):
        export.benchmark_results(queue, p.union(p))


def test_hold_out_moves_groups_whole():
    groups = {"t1": {"g1": 10, "g2": 10}, "t2": {"g2": 10, "g3": 5}, "big": {f"x{i}": 100 for i in range(10)}}
    held, unseen = split.hold_out(groups, {"t1": 20, "t2": 15, "big": 1000}, 500, share=0.05)
    assert "big" not in held and unseen == {g for t in held for g in groups[t]}


def test_select_unseen_matches_the_plain_loop(spark, samples, row):
    rows = [row(i, f"s{i}", text=f"request {i // 2}", tools=[(f"t{i % 13}", "{}"), (f"u{i % 4}", "{}")]) for i in range(200)]
    k = split.keyed(samples(*rows)).cache()
    held, keys = split.select_unseen(k, least=5, share=0.2)
    groups, freq = {}, {}
    for r in k.collect():
        for t in r.tool_names:
            groups.setdefault(t, {}).setdefault(r.group_key, 0)
            freq[t] = freq.get(t, 0) + 1
    size = {r.group_key: 0 for r in k.collect()}
    for r in k.collect():
        size[r.group_key] += 1
    want, unseen = split.hold_out({t: {g: size[g] for g in gs} for t, gs in groups.items()}, freq, 200, least=5, share=0.2)
    assert held == want and {r.group_key for r in keys.collect()} == unseen and held


def test_exact_group_split():
    parts = split.shuffled_90_5_5([f"g{i}" for i in range(100)])
    n = [sum(s == x for s in parts.values()) for x in split.SPLITS[:3]]
    assert n == [90, 5, 5] and parts == split.shuffled_90_5_5([f"g{i}" for i in reversed(range(100))])


def test_seeded_split_is_the_list_function(spark):
    rows = [(i, "ab"[i % 2], f"g{i * 7 % 90}{'ab'[i % 2]}") for i in range(400)]
    got = split.seeded_split(spark.createDataFrame(rows, "line_number int, source string, group_key string").repartition(5)).collect()
    want = {}
    for s in "ab":
        want |= split.shuffled_90_5_5([g for _, x, g in rows if x == s])
    assert len(got) == 400 and all(r.split == want[r.group_key] for r in got) and len({r.split for r in got}) == 3
    for bad in ([(1, "a", "g"), (2, "b", "g")], [(1, None, "g")], [(1, "a", "g"), (2, "a", "h")]):
        with pytest.raises(ValueError):
            split.seeded_split(spark.createDataFrame(bad, "line_number int, source string, group_key string"))


def test_whole_split(spark, samples, row):
    rows = [row(i, f"s{i}", text=f"request {i // 2} {i % 2}", tools=[(f"t{i % 13}", "{}")], source="xlam" if i % 2 else "hermes") for i in range(300)]
    held, out = split.split_dataset(samples(*rows), least=5, share=0.2)
    out = out.collect()
    assert held and len(out) == 300
    for r in out:
        assert (r.split == "test_unseen_tools") == bool(set(r.tool_names) & set(held))
    assert len({(r.group_key, r.split) for r in out}) == len({r.group_key for r in out})


def test_first_delivery(spark):
    df = spark.createDataFrame([(3, "a", 1), (1, "a", 2), (2, None, 3), (4, None, 4), (5, "b", 5)], "line_number int, sample_id string, _x int")
    assert sorted(r.line_number for r in split.first_delivery(df).collect()) == [1, 2, 4, 5]


def test_plans_have_no_group_in_one_task(spark, samples, row):
    df = samples(row(1, "a"), row(2, "a"))
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan(split.first_delivery(df))
    assert "Window" not in plan(profile.repeated_later(df.select("line_number", "sample_id"), "sample_id", "line_number"))
    assert "WindowGroupLimit" in plan(sampling.top_per_group(df, ["source"], ["line_number"], 2))
    docs = spark.createDataFrame([(i, "xy"[i % 2]) for i in range(20)], "k int, s string")
    assert "WindowGroupLimit" in plan(sampling.stratified_sample(docs, "s", "k", 4, 1))


def test_all_repairs_of_samples(spark, samples, row):
    tool = '{"type":"object","properties":{"q":{"type":"string","enum":[null]}}}'
    text = '<tools>[{"type":"function","function":{"name":"g","parameters":{}}}]</tools>'
    df = samples(row(1, "a", tools=[("f", tool)], calls=[("f", '{"q":"x"}')]), row(2, "b"), row(3, "c"), row(4, "d", tools=[("f", "{}")]), row(9, "a"))
    df = df.withColumn("system_texts", F.when(F.col("sample_id").isin("b", "c"), F.array(F.lit(text))).otherwise(F.array().cast("array<string>")))
    bodies = [
        (1, "a", '\\n{"name":"f","arguments":{"q":"x"}}'),
        (2, "a", "{'arguments':{'name':'f'}}"),
        (3, "b", '{"arguments":{"name":"g"}}'),
        (4, "c", '{"name":"other","arguments":{}}'),
        (5, "d", "broken"),
        (6, "e", '{"arguments":{"name":"g"}}'),
        (7, None, "{}"),
    ]
    made = spark.createDataFrame(bodies, "call_id bigint, sample_id string, raw_content string")
    evidence = calls.investigate_enums(spark.createDataFrame([("f", tool)], "tool_name string, parameters string"), spark.createDataFrame([("f", '{"q":"x"}')], "tool_name string, arguments string"))
    done, tools, log = repair.repair_samples(made, df, evidence)
    got = {r.sample_id: (r.status, dict(r.repair_counts), r.failure) for r in log.collect()}
    assert got == {
        "a": ("repaired", {"boundary_literal_escape": 1, "python_literal_syntax": 1, "nested_tool_name": 1, "removed_enum": 1}, None),
        "b": ("repaired", {"recovered_tools": 1, "nested_tool_name": 1}, None),
        "c": ("unchanged", {}, None),
        "d": ("repair_failed", {}, "no_object"),
        "e": ("repair_failed", {}, "nested_name_not_verified"),
    }
    assert done.count() == 7 and tools.filter("removed > 0").count() == 1
    assert sorted(r.sample_id for r in repair.repaired_ids(log).collect()) == ["a", "b"]
    assert {r.repair: (r.repairs, r.samples) for r in repair.log_summary(log).collect()}["nested_tool_name"] == (2, 2)
    known = spark.createDataFrame([(x,) for x in "abcde"], "sample_id string")
    repair.require_repaired(log, known)
    with pytest.raises(ValueError):
        repair.require_repaired(log, known.filter("sample_id <> 'b'"))
    twice = evidence.unionByName(evidence.withColumn("removable", ~F.col("removable")))
    with pytest.raises(ValueError):
        repair.repair_samples(made, df, twice)


def test_unions_and_buckets(spark):
    a, b = spark.createDataFrame([(1, "x")], "k int, s string"), spark.createDataFrame([(2,)], "k int")
    got = profile.union_in_order(first=a, second=b).collect()
    assert sorted((r.k, r.s, r.candidate_source, r.source_order) for r in got) == [(1, "x", "first", 0), (2, None, "second", 1)]
    df = spark.createDataFrame([("p", "x"), ("p", "x"), ("p", None), ("q", "z")], "g string, b string")
    assert sorted((r.g, r.bucket, r.n, r.share) for r in profile.semantic_distribution(df, "b", ("x", "y"), "g").collect()) == [("p", "x", 2, 1.0), ("p", "y", 0, 0.0), ("q", "x", 0, 0.0), ("q", "y", 0, 0.0)]


def test_ids_and_numbers_have_types(spark):
    with pytest.raises(ValueError):
        normalize.from_flat(spark.createDataFrame([(True, "q", "[]", "[]")], "id boolean, query string, answers string, tools string"))
    queue = spark.createDataFrame([(0, "a")], "ordinal int, id string")
    with pytest.raises(ValueError):
        export.benchmark_results(queue, spark.createDataFrame([("a", "x", True)], "id string, raw_prediction string, latency boolean"))


def test_split_checks(spark):
    df = spark.createDataFrame([("a", "train"), ("a", "test_seen"), ("b", "train"), ("b", "train"), (None, "train"), ("c", None)], "sample_id string, split string")
    got = {(r.left_split, r.right_split): r.shared for r in split.split_overlaps(df, "sample_id").collect()}
    assert len(got) == 6 and sum(got.values()) == 1 and got[("train", "test_seen")] == 1


def test_quotas_and_samples(spark):
    assert sampling.quotas({"a": 8, "b": 2}, 5) == {"a": 4, "b": 1}
    assert sampling.balanced(10, 2, 8) == (6, 2) and sampling.balanced(1, 10, 8) == (1, 7)
    assert sampling.exact_lines(20, 8, 42) == sampling.exact_lines(20, 8, 42) == sorted(sampling.exact_lines(20, 8, 42))
    with pytest.raises(ValueError):
        sampling.exact_lines(3, 4, 1)
    df = spark.range(50).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 40, "x").otherwise("y").alias("s"))
    got = sampling.stratified_sample(df, "s", "k", 10, 1)
    assert {r.s: r["count"] for r in got.groupBy("s").count().collect()} == {"x": 8, "y": 2}
    again = sampling.stratified_sample(df.repartition(7), "s", "k", 10, 1)
    assert {r.k for r in got.collect()} == {r.k for r in again.collect()}


def test_order_rules(spark):
    df = spark.createDataFrame([(1, "b"), (2, "a"), (3, "a"), (4, "b"), (5, None)], "line int, x string")
    assert [tuple(r) for r in sampling.top_labels(df, "x", 1).collect()] == [("a", 2)]
    assert [tuple(r) for r in sampling.most_common(df, "x", "line", 1).collect()] == [("b", 2)]
    assert [r.line for r in sampling.by_priority(df, "x", ("a",), "line").collect()] == [2, 3, 1, 4, 5]
    assert [r.line for r in profile.repeated_later(df, "x", "line").orderBy("line").collect()] == [3, 4]


def test_description(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, None]], "v int")
    r = profile.describe(df, F.col("v")).first()
    assert (r["count"], r["min"], r["mean"], r["median"], r["p90"], r["max"]) == (10, 1, 5.5, 5.5, 9.0, 10)
    assert profile.describe(df.limit(0), F.col("v")).first()["count"] == 0
