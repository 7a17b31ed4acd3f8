import json

import pytest

from callframe.functions.schema_check import violations, well_formed
from callframe.operators import align, diff, evidence, predict, score

CALL = '<tool_call>\n{"name": "A", "arguments": {"x": 1}}\n</tool_call>'


def calls(*pairs):
    return [(n, json.dumps(a, sort_keys=True, separators=(",", ":"))) for n, a in pairs]


@pytest.mark.parametrize(
    "text, mode, n, errors",
    [
        (CALL, "tool", 1, []),
        (f"{CALL}\n{CALL} ", "tool", 2, []),
        ("prose", "text", 0, []),
        (f"prose {CALL}", "mixed", 1, ["prose_outside_tool_calls"]),
        ("<tool_call>{'name':'A','arguments':{}}</tool_call>", "invalid", 0, ["call_0:invalid_json"]),
        (f'{CALL}<tool_call>{{"name":"A","arguments":"x"}}</tool_call>', "invalid", 1, ["call_1:arguments_not_object"]),
        ("<tool_call>{}", "invalid", 0, ["malformed_tool_call_tags"]),
        (f"{CALL}<tool_call", "invalid", 1, ["malformed_tool_call_tags"]),
        ('<tool_call>{"name":"A","arguments":{"v":NaN}}</tool_call>', "invalid", 0, ["call_0:invalid_json"]),
        ('<tool_call>{"name":"A","arguments":{},"id":1}</tool_call>', "invalid", 0, ["call_0:invalid_fields"]),
        ('<tool_call>{"name":"","arguments":{}}</tool_call>', "invalid", 0, ["call_0:invalid_name"]),
        ("<tool_call>[]</tool_call>", "invalid", 0, ["call_0:body_not_object"]),
        (" \n ", "invalid", 0, ["empty_prediction"]),
        (None, "invalid", 0, ["empty_prediction"]),
    ],
)
def test_prediction(spark, text, mode, n, errors):
    r = predict.parse_predictions(spark.createDataFrame([(text,)], "raw_prediction string")).first()
    assert (r.mode, len(r.calls), r.parse_errors, r.strict_format_valid) == (mode, n, errors, mode == "tool")


SCORED = "sample_id string, gold array<struct<name string, arguments string>>, calls array<struct<name string, arguments string>>, mode string, tools array<struct<type string, function struct<name string, description string, parameters string>>>"
A1, A2, A5, B = ("A", {"x": 1}), ("A", {"x": 2}), ("A", {"x": 5}), ("B", {"city": "Beijing"})
TOOLS = [("function", (n, None, '{"type":"object"}')) for n in "AB"]


@pytest.mark.parametrize(
    "gold, got, mode, want",
    [
        ([A1, B], [B, A1], "tool", {"full_call_exact": True, "tool_name_exact": True, "errors": []}),
        ([A1, A1], [A1], "tool", {"full_call_exact": False, "errors": ["missing_tool"]}),
        ([A1, A2, B], [A2, A5, B], "tool", {"argument_exact_matches": 2, "tool_name_tp": 3, "errors": ["argument_mismatch"]}),
        ([B], [("B", {"city": "Shanghai"})], "tool", {"schema_valid": True, "errors": ["argument_mismatch"]}),
        ([], [], "text", {"no_tool_correct": True, "full_call_exact": False, "argument_exact": None, "call_kind": "text", "errors": []}),
        ([A1], [A1], "mixed", {"schema_valid": True, "full_call_exact": False, "errors": ["format_error"]}),
        ([A1], [], "text", {"errors": ["wrong_mode", "format_error", "missing_tool", "schema_invalid"], "no_tool_correct": None}),
        ([A1], [("C", {})], "tool", {"errors": ["wrong_tool", "missing_tool", "extra_tool", "schema_invalid"]}),
        ([A1], [A1, A1], "tool", {"errors": ["extra_tool"], "full_call_exact": False}),
        ([A1], [A1], "invalid", {"schema_valid": False, "argument_exact": True}),
    ],
)
def test_scores(spark, gold, got, mode, want):
    df = spark.createDataFrame([("s", calls(*gold), calls(*got), mode, TOOLS)], SCORED)
    r = score.score(df.selectExpr("*", "mode = 'tool' AS strict_format_valid")).first().asDict()
    assert {k: r[k] for k in want} == want


def test_summary_null_rules(spark):
    def summary(*rows):
        df = spark.createDataFrame([("s", calls(*g), calls(*p), m, TOOLS) for g, p, m in rows], SCORED)
        return score.summarize(score.score(df.selectExpr("*", "mode = 'tool' AS strict_format_valid"))).first()

    only_text = summary(([], [], "text"))
    assert only_text.tool_name_f1 is None and only_text.full_call_success_rate is None and only_text.no_tool_accuracy == 1.0
    nothing = summary(([A1], [], "text"))
    assert (nothing.tool_name_precision, nothing.tool_name_recall, nothing.tool_name_f1) == (0.0, 0.0, 0.0)


def test_histogram_is_zero_filled(spark):
    df = spark.createDataFrame([(["x", "a"],), (["a"],), ([],)], "errors array<string>")
    assert [tuple(r) for r in score.histogram(df, "errors", ("b", "a")).orderBy("ord", "label").collect()] == [("b", 0, 0), ("a", 1, 2), ("x", 2, 1)]


@pytest.mark.parametrize(
    "gold, pred, want",
    [
        ({"a": 1}, {}, [("a", "missing_argument")]),
        ({}, {"a": 1}, [("a", "extra_argument")]),
        ({"a": "x"}, {"a": "y"}, [("a", "wrong_value")]),
        ({"a": 2025}, {"a": "2025"}, [("a", "type_mismatch")]),
        ({"a": 1.0}, {"a": 1}, [("a", "type_mismatch")]),
        ({"f": {"p": {"max": 3}}}, {"f": {"p": {"max": 4}}}, [("f.p.max", "wrong_value")]),
        ({"a": [1, 2]}, {"a": [2, 1]}, [("a", "nested_structure_mismatch")]),
        ({"f": {"p": {"x": 1}}}, {"f": {}}, [("f.p", "missing_argument")]),
        ({"f": {"p": 1}}, {"f": [1]}, [("f", "type_mismatch")]),
        ({"a": None}, {}, [("a", "missing_argument")]),
        ({"a": 0.0}, {"a": -0.0}, []),
        ({"b": 1, "a": {"y": 1, "x": 2}}, {"a": {"x": 2, "y": 1}, "b": 1}, []),
    ],
)
def test_argument_diff(spark, gold, pred, want):
    df = spark.createDataFrame([("s", calls(("T", gold)), calls(("T", pred)), "tool", [])], SCORED)
    got = sorted((r.path, r.type) for r in diff.argument_diffs(diff.pair_calls(df)).collect())
    assert got == sorted(want)


@pytest.mark.parametrize(
    "gold, pred, status, diagnostics",
    [
        ([A1, B], [B, A1], "analyzable", []),
        ([A1, A2], [A1, A5], "analyzable", ["wrong_value"]),
        ([A1, A2], [A5, ("A", {"x": 6})], "ambiguous_or_confounded", ["ambiguous_call_pairing"]),
        ([A1, B], [A2], "partially_analyzable", ["wrong_value", "partial_argument_analysis"]),
        ([A1], [B], "ambiguous_or_confounded", ["partial_argument_analysis"]),
    ],
)
def test_diagnosis(spark, gold, pred, status, diagnostics):
    df = spark.createDataFrame([("s", calls(*gold), calls(*pred), "tool", [])], SCORED)
    r = diff.diagnose(diff.pair_calls(df)).first()
    assert (r.analysis_status, r.diagnostics) == (status, diagnostics)


def test_alignment_needs_the_same_keys(spark):
    left, right = spark.createDataFrame([("a",), ("b",)], "sample_id string"), spark.createDataFrame([("b",), ("c",), ("c",)], "sample_id string")
    assert [tuple(r) for r in align.key_faults(left, right).orderBy("sample_id").collect()] == [("a", 1, 0), ("c", 0, 2)]
    with pytest.raises(ValueError):
        align.require_same_keys(left, right)
    align.require_same_keys(left, left)


def test_transitions(spark):
    rows = [(True, True), (True, False), (False, True), (False, False), (False, True)]
    side = lambda i: spark.createDataFrame([(str(k), r[i], []) for k, r in enumerate(rows)], "sample_id string, full_call_exact boolean, errors array<string>")
    r = align.transition_summary(align.align(side(0), side(1))).first()
    assert (r.both_correct, r.fixed, r.regressed, r.both_wrong, r.net) == (1, 2, 1, 1, 1)
    assert r.fix_rate == pytest.approx(2 / 3) and r.regression_rate == 0.5


@pytest.mark.parametrize(
    "value, kind, query, plain, bounded",
    [
        ("70", "integer", "It costs 70.", False, True),
        ("70", "integer", "It costs 70 now", True, True),
        ("7", "integer", "70", False, False),
        ("cat", "string", "concatenate", True, False),
        ("", "string", "any", True, False),
        ("all", "string", "take all of it", True, False),
        ("all", "string", 'take "all" of it', True, True),
        ("and", "string", "this and that", True, False),
        ("café", "string", "ein Café!", True, True),
        ("a.b", "string", "axb", False, False),
    ],
)
def test_literals(spark, value, kind, query, plain, bounded):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value, kind, query)], "v string, k string, q string")
    cols = F.col("v"), F.col("k"), F.col("q")
    assert tuple(df.select(evidence.plain_literal(*cols), evidence.bounded_literal(*cols)).first()) == (plain, bounded)


@pytest.mark.parametrize(
    "value, kind, query, schema, want",
    [
        ("800", "integer", "take 8% off", "rate in hundredths", "percentage"),
        ("0.08", "number", "take 8 percent off", "a fraction", "percentage"),
        ("0.08", "number", "take 8 percent off", "", None),
        ("36", "integer", "send Three dozen", "", "dozen"),
        ("24", "integer", "send 2 dozen", "", "dozen"),
        ("20", "integer", "the second page, 20 rows", "offset of rows", "pagination"),
        ("40", "integer", "page 3 with 20 rows", "offset of rows", "pagination"),
        ("NO", "string", "weather in Norway", "iso 3166 code", "iso_country"),
        ("NO", "string", "weather in Norway", "country", None),
        ("2024-05-03", "string", "on May 3rd, 2024", "yyyy-mm-dd", "date"),
        ("2024-05-03", "string", "on 2024-05-03", "any", "query_literal"),
        ("false", "boolean", "without archived items", "archived items too", "boolean"),
        ("true", "boolean", "include archived items", "archived items too", "boolean"),
        ("true", "boolean", "include archived items", "other words", None),
        (None, "null", "null", "", None),
        ("5", "integer", "", "", None),
    ],
)
def test_evidence(spark, value, kind, query, schema, want):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(value, kind, query, schema)], "v string, k string, q string, s string")
    cols = (F.col(c) for c in "vkqs")
    assert df.select(evidence.evidence(*cols, F.lit("filter.offset"), F.lit("20"))).first()[0] == want


@pytest.mark.parametrize(
    "value, kind, query, want",
    [
        ("hi", "string", "say hi", True),
        ("lo", "string", "say lo", False),  # named only as a default
        ("x1", "string", "give the storm warning now", True),
        ("x1", "string", "give it now", False),
        ("", "string", "x", False),
        ("true", "boolean", "true", False),
        ("gusts", "string", "any gust today", True),
        ("7", "integer", "find severe coastal flooding", True),
        ("7", "integer", "say 7", False),  # options count for strings
        ("hidden", "string", "say hidden", False),  # stands below a default
        (None, "null", "x", False),
    ],
)
def test_schema_mapping(spark, value, kind, query, want):
    from pyspark.sql import functions as F

    s = {
        "description": "Use hi for very strong wind. Default is lo. Also gusts, and 7 means severe coastal flooding.",
        "oneOf": [{"const": "x1", "title": "storm warning level"}, {"const": "y"}],
        "default": {"description": "hidden"},
    }
    df = spark.createDataFrame([(value, kind, query, json.dumps(s))], "v string, k string, q string, s string").withColumn("l", evidence.json_leaves("s"))
    hit = evidence.schema_mapping(F.col("v"), F.col("k"), F.col("q"), F.col("l"))
    assert df.select(hit).first()[0] is want


@pytest.mark.parametrize(
    "path, value, loose, strict",
    [
        ("user.id", "7", True, True),
        ("security", "7", True, False),
        ("a.b", "mailto:x@y", True, True),
        ("a.b", "abcdefgh12", True, True),
        ("a.b", "abcd efgh 12", True, False),
        ("a.b", "abcdefghij", False, False),
        ("stock_symbol", "A", True, True),
        (None, None, False, False),
    ],
)
def test_opaque(spark, path, value, loose, strict):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(path, value)], "p string, v string")
    assert tuple(df.select(evidence.opaque(F.col("p"), F.col("v")), evidence.opaque(F.col("p"), F.col("v"), True)).first()) == (loose, strict)


def test_default_equivalence(spark, samples, row):
    tool = '{"properties":{"n":{"default":5},"s":{"default":"New York"},"o":{},"z":{"default":null}}}'
    df = samples(row(1, "s", tools=[("t", tool), ("t", '{"properties":{"n":{"default":6}}}')]))
    kind = "sample_id string, tool string, gold_call_index int, path string, type string, gold string, pred string"
    rows = [
        ("n", "missing_argument", "5.0", None, True),
        ("n", "extra_argument", None, "6", True),
        ("n", "missing_argument", "7", None, False),
        ("n", "wrong_value", "5", "6", False),
        ("s", "extra_argument", None, '"new-york"', True),
        ("o", "missing_argument", "null", None, False),
        ("z", "missing_argument", "null", None, True),
    ]
    got = evidence.default_equivalent(spark.createDataFrame([("s", "t", i, p, t, g, q) for i, (p, t, g, q, _) in enumerate(rows)], kind), df)
    assert {r.gold_call_index for r in got.collect()} == {i for i, r in enumerate(rows) if r[-1]}


def test_page_and_limit_of_the_call(spark, samples, row):
    tool = '{"properties":{"offset":{"type":"integer","description":"records to skip"}}}'
    calls = [("t", '{"limit":25,"offset":25}'), ("t", '{"limit":"25","offset":25}'), ("t", '{"offset":25}')]
    df = samples(row(1, "s", text="the second page with a limit of 25", tools=[("t", tool)], calls=calls), row(2, "u", text="the second page", tools=[("t", tool)], calls=calls[:1]))
    kind = "sample_id string, tool string, gold_call_index int, path string, type string, gold_present boolean, gold string"
    rows = [("s", "t", 0, "offset", "wrong_value", True, "25"), ("u", "t", 0, "offset", "wrong_value", True, "25"), ("s", "t", 9, "offset", "wrong_value", True, "75")]
    got = {(r.sample_id, r.gold_call_index): r.evidence for r in evidence.ground_diffs(spark.createDataFrame(rows, kind), df).collect()}
    assert got == {("s", 0): ["pagination"], ("u", 0): [], ("s", 9): []}


def test_schema_at(spark):
    p = '{"properties":{"a":{"properties":{"b":{"type":"string","default":"Q"}}}},"required":["a"]}'
    df = spark.createDataFrame([(p, "a.b"), (p, "z"), (None, "a"), (p, "a.b.c")], "p string, path string")
    got = [(r.x.schema is not None, r.x.optional) for r in df.select(evidence.schema_at("p", "path").alias("x")).collect()]
    assert got == [(True, False), (False, True), (False, False), (False, False)]
    assert "q" not in df.select(evidence.schema_text(evidence.schema_at("p", "path")["schema"])).first()[0]


def test_grounding(spark, samples, row):
    tool = '{"properties":{"city":{"type":"string"},"n":{"type":"integer"}},"required":["city"]}'
    df = samples(row(1, "s", text="Weather in Oslo", tools=[("t", tool)]))
    kind = "sample_id string, tool string, gold_call_index int, path string, type string, gold_present boolean, gold string"
    rows = [
        ("s", "t", 0, "city", "wrong_value", True, '"Oslo"'),
        ("s", "t", 1, "city", "wrong_value", True, '"Rome"'),
        ("s", "t", 2, "n", "extra_argument", False, None),
        ("s", "t", 3, "city", "extra_argument", False, None),
        ("s", "t", 4, "city", "wrong_value", True, "[]"),
    ]
    g = evidence.ground_diffs(spark.createDataFrame(rows, kind), df)
    assert {r.gold_call_index: r.passed for r in g.collect()} == {0: True, 1: False, 2: True, 3: False, 4: False}
    case = evidence.ground_cases(g).first()
    assert (case.passed, case.failed, case.evidence_counts) == (False, 3, {"query_literal": 1})


@pytest.mark.parametrize(
    "a, b, same",
    [("1", "1.0", True), ("true", "1", False), ('"New-York!"', '"new york"', True), ('[1,"A"]', '[1.0,"a"]', True), ('{"a":null}', '{"a":null}', True), ('{"a":1}', '{"b":1}', False), ('"1"', "1", False), ("x", "x", False)],
)
def test_equivalence(spark, a, b, same):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(evidence.equivalent_json("a", "b")).first()[0] is same


def test_similarity_is_not_levenshtein(spark):
    df = spark.createDataFrame([("abcd", "bcde"), (None, "x")], "a string, b string")
    assert [r[0] for r in df.select(evidence.similarity("a", "b")).collect()] == [0.75, None]


@pytest.mark.parametrize(
    "schema, value, bad",
    [
        ({"type": "integer"}, 1.0, False),
        ({"type": "integer"}, True, True),
        ({"type": ["string", "null"]}, None, False),
        ({"enum": [1]}, True, True),
        ({"enum": [1]}, 1.0, False),
        ({"properties": {"a": {"type": "string"}}, "required": ["a"]}, {"a": 1}, True),
        ({"additionalProperties": False, "properties": {"a": {}}}, {"a": 1, "b": 2}, True),
        ({"items": {"minimum": 2}}, [2, 1], True),
        ({"uniqueItems": True}, [1, True], False),
        ({"uniqueItems": True}, [{"a": 1}, {"a": 1.0}], True),
        ({"minItems": 2, "maxItems": 2}, [1], True),
        ({"pattern": "^a"}, "ba", True),
        ({"anyOf": [{"type": "string"}, {"minimum": 3}]}, 2, True),
        ({"oneOf": [{"minimum": 1}, {"minimum": 2}]}, 3, True),
        ({"not": {"type": "null"}}, None, True),
        ({"const": {"a": 1}}, {"a": 1.0}, False),
        (True, 5, False),
        (False, 5, True),
    ],
)
def test_validator(schema, value, bad):
    assert bool([*violations(value, schema)]) is bad


def test_schema_form():
    assert well_formed({"type": "object", "properties": {"a": {"type": ["string", "null"], "enum": []}}, "x-any": 1})
    for bad in (1, {"type": "dict"}, {"required": ["a", "a"]}, {"properties": []}, {"pattern": "("}, {"items": {"minLength": -1}}, {"anyOf": []}):
        assert not well_formed(bad)
