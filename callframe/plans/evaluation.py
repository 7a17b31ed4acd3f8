"""Queries of the evaluation side: strict parse, scores, alignment, differences, evidence.

The tables hold no model predictions, so each sample gets one that is written from its
answer: exact, with prose, unclosed, broken, doubled, plain text or with another tool,
by its line number. The SQL writes the same texts and parses them on its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callframe.functions.staging import stage
from callframe.operators import align, diff, evidence, predict, score
from callframe.plans.checks_sql import walk
from callframe.sources.tables import table


def _variant(run: int):
    return F.pmod(F.col("line_number") * (2 * run + 1) + run, F.lit(7))


def predictions(spark: SparkSession, d: str, run: int = 0) -> DataFrame:
    """canonical_samples with raw_prediction."""
    c = F.col("assistant.tool_calls")
    body = lambda name, args: F.concat(F.lit('<tool_call>\n{"name": "'), name, F.lit('", "arguments": '), args, F.lit("}\n</tool_call>"))
    plain = F.transform(c, lambda x: body(x["function"]["name"], x["function"]["arguments"]))
    other = F.transform(c, lambda x: body(F.concat(x["function"]["name"], F.lit("_x")), x["function"]["arguments"]))
    text = F.array_join(plain, "\n")
    v = F.col("variant")
    raw = (
        F.when(F.coalesce(F.size(c), F.lit(0)) <= 0, F.coalesce("assistant.content", F.lit("")))
        .when(v == 1, F.concat(F.lit("Sure. "), text))
        .when(v == 2, F.replace(text, F.lit("</tool_call>"), F.lit("")))
        .when(v == 3, F.replace(text, F.lit('"arguments": '), F.lit('"arguments" ')))
        .when(v == 4, F.concat(F.try_element_at(plain, F.lit(1)), F.lit("\n"), text))
        .when(v == 5, F.lit("I cannot help."))
        .when(v == 6, F.array_join(other, "\n"))
        .otherwise(text)
    )
    return table(spark, d, "canonical_samples").withColumn("variant", _variant(run)).withColumn("raw_prediction", raw)


def scored(spark: SparkSession, d: str, run: int = 0) -> DataFrame:
    p = predict.parse_predictions(predictions(spark, d, run)).withColumn("gold", score.gold_calls())
    return score.score(p)


def prediction_modes(spark: SparkSession, d: str) -> DataFrame:
    p = predict.parse_predictions(predictions(spark, d))
    return p.select("line_number", "mode", F.size("calls").alias("calls"), "strict_format_valid", F.array_join("parse_errors", ",").alias("errors"))


NUMBERS = ["gold_call_count", "predicted_call_count", "tool_name_tp", "argument_exact_matches"]
FLAGS = ["response_mode_correct", "format_valid", "schema_valid", "tool_name_exact", "argument_exact", "full_call_exact", "no_tool_correct"]


def score_samples(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select("line_number", "call_kind", *NUMBERS, *FLAGS, F.array_join("errors", ",").alias("errors"))


def score_summary(spark: SparkSession, d: str) -> DataFrame:
    return score.summarize(scored(spark, d))


def score_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return score.summarize(scored(spark, d), "call_kind")


def schema_validity(spark: SparkSession, d: str) -> DataFrame:
    """Schema validity of the predicted calls, by kind of answer."""
    return scored(spark, d).groupBy("call_kind", "schema_valid").agg(F.count("*").alias("samples"))


def error_histogram(spark: SparkSession, d: str) -> DataFrame:
    return score.histogram(scored(spark, d), "errors", score.ERRORS)


def mode_histogram(spark: SparkSession, d: str) -> DataFrame:
    return score.histogram(predict.parse_predictions(predictions(spark, d)), "mode", score.MODES)


def failure_summary(spark: SparkSession, d: str) -> DataFrame:
    return align.failure_summary(scored(spark, d).filter("NOT full_call_exact AND gold_mode = 'tool'"))


def _aligned(spark: SparkSession, d: str) -> DataFrame:
    keep = ("source", "call_kind")
    return align.align(scored(spark, d), scored(spark, d, 1), keep=keep, key="line_number")


def transitions(spark: SparkSession, d: str) -> DataFrame:
    return align.transition_summary(_aligned(spark, d), "source", "call_kind")


def transition_errors(spark: SparkSession, d: str) -> DataFrame:
    return align.transition_errors(_aligned(spark, d), score.ERRORS)


def _altered(spark: SparkSession, d: str) -> DataFrame:
    """Samples with calls whose predicted arguments are changed by rule: other strings, numbers as text, other names."""
    v = F.pmod(F.col("line_number"), F.lit(4))
    change = lambda a: (
        F.when(v == 0, F.regexp_replace(a, r'": ?"[^"]*"', '": "changed"'))
        .when(v == 1, F.regexp_replace(a, r'": ?([0-9]+)([,}])', '": "$1"$2'))
        .when(v == 2, F.regexp_replace(a, r'"(city|format|page|limit|status|notes)":', '"x_$1":'))
        .otherwise(a)
    )
    s = table(spark, d, "canonical_samples").withColumn("gold", score.gold_calls())
    changed = score.canon_all(F.transform("assistant.tool_calls.function.arguments", change))
    names = F.col("assistant.tool_calls.function.name")
    calls = F.transform(F.arrays_zip(names.alias("name"), changed.alias("arguments")), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
    return s.withColumn("calls", F.coalesce(calls, F.array().cast("array<struct<name:string,arguments:string>>")))


def call_pairing(spark: SparkSession, d: str) -> DataFrame:
    p = diff.pair_calls(_altered(spark, d))
    return p.select("line_number", "analysis_status", "exact_pairs", F.size("pairs").alias("pairs"), F.size("ambiguous_names").alias("ambiguous"))


def argument_diffs(spark: SparkSession, d: str) -> DataFrame:
    found = diff.argument_diffs(diff.pair_calls(_altered(spark, d)), "line_number")
    return found.select("line_number", "tool", "gold_call_index", "path", "type", "gold_present", "pred_present")


def diff_summary(spark: SparkSession, d: str) -> DataFrame:
    paired = diff.pair_calls(_altered(spark, d))
    diffs = stage(diff.argument_diffs(paired, "line_number"), "diffs")
    return diff.summarize(diff.diagnose(paired, "line_number", diffs), diffs, "line_number")


def diff_cooccurrence(spark: SparkSession, d: str) -> DataFrame:
    """Diagnostics that occur together in a row."""
    return diff.cooccurrence(diff.diagnose(diff.pair_calls(_altered(spark, d)), "line_number"))


def wrong_value_types(spark: SparkSession, d: str) -> DataFrame:
    return diff.value_types(diff.argument_diffs(diff.pair_calls(_altered(spark, d)), "line_number"), "line_number")


def literal_in_query(spark: SparkSession, d: str) -> DataFrame:
    """Scalar arguments at the top of each call that the user text holds literally, by both rules."""
    from callframe.functions.jsonx import json_nodes
    from callframe.functions.text import user_text

    s = table(spark, d, "canonical_samples").select("line_number", user_text("messages").alias("query"), F.posexplode("assistant.tool_calls.function.arguments").alias("call", "args"))
    one = s.withColumn("n", F.explode(F.filter(json_nodes("args"), lambda n: (n["parent"] == "") & n["kind"].isin("string", "integer", "number"))))
    text = F.when(F.col("n.kind") == "string", F.get_json_object(F.concat(F.lit('{"v":'), F.col("n.canon"), F.lit("}")), "$.v")).otherwise(F.col("n.canon"))
    v = one.select("line_number", "call", F.col("n.key").alias("argument"), F.col("n.kind").alias("kind"), text.alias("value"), "query")
    return v.select("line_number", "call", "argument", evidence.plain_literal(F.col("value"), F.col("kind"), F.col("query")).alias("literal"))


def bounded_in_query(spark: SparkSession, d: str) -> DataFrame:
    """Scalars of each call at any depth that the user text holds by the rule of the grounding."""
    from callframe.functions.text import user_text

    s = table(spark, d, "canonical_samples").select("line_number", user_text("messages").alias("query"), F.posexplode("assistant.tool_calls.function.arguments").alias("call", "args"))
    one = s.withColumn("x", F.explode(evidence.json_leaves("args"))).filter("x.kind <> 'null'")
    return one.select("line_number", "call", "x.path", evidence.bounded_literal(F.col("x.text"), F.col("x.kind"), F.col("query")).alias("literal"))


def evidence_rules(spark: SparkSession, d: str) -> DataFrame:
    """First rule that grounds a value in a sentence written from lineitem numbers; the values of every third line are off by one."""
    line = table(spark, d, "lineitem")
    k = F.pmod(F.col("l_orderkey") + F.col("l_linenumber"), F.lit(4))
    pct, n = F.round(F.col("l_discount") * 100).cast("int"), F.pmod(F.col("l_orderkey"), F.lit(9)).cast("int") + 2
    text = (
        F.when(k == 0, F.concat(F.lit("take "), pct.cast("string"), F.lit("% off")))
        .when(k == 1, F.concat(F.lit("send "), n.cast("string"), F.lit(" dozen boxes")))
        .when(k == 2, F.concat(F.lit("show page "), n.cast("string"), F.lit(" with 20 rows each")))
        .otherwise(F.concat(F.lit("ship it on "), F.date_format("l_shipdate", "MMMM d, yyyy"), F.lit(" please")))
    )
    off = F.when(F.col("l_linenumber") % 3 == 0, 1).otherwise(0)
    day = F.date_add(F.col("l_shipdate").cast("date"), off)
    value = F.when(k == 0, ((pct + off) / 100).cast("decimal(4,2)").cast("string")).when(k == 1, (n * 12 + off).cast("string")).when(k == 2, ((n - 1) * 20 + off).cast("string")).otherwise(F.date_format(day, "yyyy-MM-dd"))
    kind = F.when(k == 0, "number").when(k == 3, "string").otherwise("integer")
    schema = F.element_at(F.array(*map(F.lit, ("a fraction", "", "offset of the first row", "format yyyy-mm-dd"))), (k + 1).cast("int"))
    rows = line.select(k.alias("k"), text.alias("query"), value.alias("value"), kind.alias("kind"), schema.alias("schema"))
    hit = evidence.evidence(F.col("value"), F.col("kind"), F.col("query"), F.col("schema"), F.lit("offset"), F.lit("20"))
    return rows.withColumn("rule", F.coalesce(hit, F.lit("none"))).groupBy("k", "rule").agg(F.count("*").alias("n"))


def grounded_diffs(spark: SparkSession, d: str) -> DataFrame:
    """Which differences the request or the schema grounds, by type."""
    found = diff.argument_diffs(diff.pair_calls(_altered(spark, d)), "line_number")
    g = evidence.ground_diffs(found, table(spark, d, "canonical_samples"), "line_number")
    return g.groupBy("type", "passed").agg(F.count("*").alias("diffs"), F.sum("ungrounded").alias("ungrounded"))


def default_equivalents(spark: SparkSession, d: str) -> DataFrame:
    """Missing and surplus arguments written from the listed defaults, every other line with another value: which equal a default."""
    tools = table(spark, d, "canonical_samples").select("line_number", F.posexplode("tools.function").alias("i", "f")).select("line_number", "i", F.col("f.name").alias("tool"), evidence.json_leaves("f.parameters").alias("leaves"))
    one = tools.withColumn("x", F.explode("leaves")).withColumn("path", F.regexp_extract("x.path", r"^properties\.([^.\[]+)\.default$", 1)).filter("path <> '' AND tool IS NOT NULL")
    value = F.when(F.col("line_number") % 2 == 0, F.col("x.canon")).otherwise(F.lit('"other value"'))
    kind = F.when(F.col("line_number") % 4 < 2, "missing_argument").otherwise("extra_argument")
    diffs = one.select("line_number", "tool", F.col("i").alias("gold_call_index"), "path", kind.alias("type"), value.alias("gold"), value.alias("pred"))
    return evidence.default_equivalent(diffs, table(spark, d, "canonical_samples"), "line_number")


def identifier_values(spark: SparkSession, d: str) -> DataFrame:
    """Argument values that look like identifiers, by the loose and the strict rule."""
    s = table(spark, d, "canonical_samples").select("line_number", F.posexplode("assistant.tool_calls.function.arguments").alias("call", "args"))
    one = s.withColumn("x", F.explode(evidence.json_leaves("args"))).filter("x.kind = 'string'").select("line_number", "call", "x.path", "x.text")
    loose, strict = (evidence.opaque(F.col("path"), F.col("text"), k) for k in (False, True))
    return one.select("line_number", "call", "path", loose.alias("loose"), strict.alias("strict")).filter("loose OR strict")


def enriched_wrong_values(spark: SparkSession, d: str) -> DataFrame:
    """Wrong values with the schema type at their path."""
    found = diff.argument_diffs(diff.pair_calls(_altered(spark, d)), "line_number")
    e = evidence.enrich(found, table(spark, d, "canonical_samples"), "line_number")
    return e.groupBy("value_type", "schema_type", "enum_field", "schema_ambiguous").agg(F.count("*").alias("diffs"))


def repr_equivalence(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    copy = F.when(F.col("p_partkey") % 3 == 0, F.upper(F.replace("p_name", F.lit(" "), F.lit("-")))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit("!"))).otherwise(F.concat("p_name", F.lit(" x")))
    return p.select("p_partkey", evidence.equivalent_text(F.col("p_name"), copy).alias("same"))


def argument_equivalence(spark: SparkSession, d: str) -> DataFrame:
    """Arguments against a copy that is written otherwise (marks between words, 1.0 for 1) or differs (1 as text), by the rule for JSON values."""
    s = table(spark, d, "canonical_samples").select("line_number", F.posexplode("assistant.tool_calls.function.arguments").alias("call", "a"))
    k = F.col("line_number") % 4
    copy = (
        F.when(k == 0, F.regexp_replace("a", r'": "([a-z]+) ([a-z]+)"', '": "$1-$2!"'))
        .when(k == 1, F.regexp_replace("a", r'": ?([0-9]+)([,}])', '": $1.0$2'))
        .when(k == 2, F.regexp_replace("a", r'": ?([0-9]+)([,}])', '": "$1"$2'))
        .otherwise(F.col("a"))
    )
    return s.select("line_number", "call", evidence.equivalent_json("a", copy).alias("same"))


QUERIES = {
    f.__name__: f
    for f in (
        prediction_modes,
        score_samples,
        score_summary,
        score_by_kind,
        schema_validity,
        error_histogram,
        mode_histogram,
        failure_summary,
        transitions,
        transition_errors,
        call_pairing,
        argument_diffs,
        diff_summary,
        diff_cooccurrence,
        wrong_value_types,
        literal_in_query,
        bounded_in_query,
        evidence_rules,
        grounded_diffs,
        default_equivalents,
        identifier_values,
        enriched_wrong_values,
        repr_equivalence,
        argument_equivalence,
    )
}


def _pred_sql(run: int = 0) -> str:
    body = lambda name: f"""'<tool_call>' || chr(10) || '{{"name": "' || {name} || '", "arguments": ' || x.function.arguments || '}}' || chr(10) || '</tool_call>'"""
    text = f"array_to_string(list_transform(assistant.tool_calls, lambda x: {body('x.function.name')}), chr(10))"
    return f"""
SELECT line_number, source, assistant, CASE
  WHEN coalesce(len(assistant.tool_calls), 0) = 0 THEN coalesce(assistant.content, '')
  WHEN v = 1 THEN 'Sure. ' || txt WHEN v = 2 THEN replace(txt, '</tool_call>', '')
  WHEN v = 3 THEN replace(txt, '"arguments": ', '"arguments" ')
  WHEN v = 4 THEN list_transform(assistant.tool_calls, lambda x: {body('x.function.name')})[1] || chr(10) || txt
  WHEN v = 5 THEN 'I cannot help.'
  WHEN v = 6 THEN array_to_string(list_transform(assistant.tool_calls, lambda x: {body("(x.function.name || '_x')")}), chr(10))
  ELSE txt END AS raw
FROM (SELECT *, (line_number * {2 * run + 1} + {run}) % 7 AS v, {text} AS txt FROM canonical_samples)
"""


_TAG = r"(?s)<tool_call>\s*(.*?)\s*</tool_call>"
_SIG = "(SELECT string_agg(t.fullkey || ':' || t.type || ':' || coalesce(t.atom::VARCHAR, ''), '|' ORDER BY t.fullkey) FROM json_tree({a}) t)"


def _score_sql(run: int = 0) -> str:
    """CTEs up to sc{run}, the score columns."""
    r = str(run)
    return f"""
pr{r} AS ({_pred_sql(run)}),
pb{r} AS (SELECT line_number, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS body FROM (SELECT line_number, regexp_extract_all(raw, '{_TAG}', 1) AS b FROM pr{r})),
pc{r} AS (SELECT line_number, i, body, json_valid(body) AS ok FROM pb{r}),
pk{r} AS (SELECT line_number, i, ok, CASE WHEN ok THEN TRY_CAST(body AS JSON)->>'$.name' END AS name, CASE WHEN ok THEN {_SIG.format(a="TRY_CAST(body AS JSON)->'$.arguments'")} END AS sig FROM pc{r}),
gk{r} AS (SELECT line_number, c.function.name AS name, {_SIG.format(a="c.function.arguments::JSON")} AS sig FROM (SELECT line_number, unnest(assistant.tool_calls) AS c FROM canonical_samples)),
pa{r} AS (SELECT line_number, count(*) AS tags, count(*) FILTER (NOT ok) AS bad, string_agg('call_' || i || ':invalid_json', ',' ORDER BY i) FILTER (NOT ok) AS bads FROM pk{r} GROUP BY 1),
md{r} AS (SELECT p.line_number, p.source, coalesce(a.tags, 0) AS tags, coalesce(a.tags - a.bad, 0) AS calls, bads,
  regexp_replace(raw, '{_TAG}', '', 'g') AS outside, raw, coalesce(a.bad, 0) AS bad FROM pr{r} p LEFT JOIN pa{r} a USING (line_number)),
mo{r} AS (SELECT *, CASE WHEN trim(raw, ' ' || chr(10) || chr(9)) = '' THEN 'invalid' WHEN bad > 0 OR regexp_matches(outside, '</?tool_call') THEN 'invalid' WHEN tags = 0 THEN 'text'
  WHEN trim(outside, ' ' || chr(10)) <> '' THEN 'mixed' ELSE 'tool' END AS mode FROM md{r}),
gn{r} AS (SELECT line_number, name, count(*) AS n FROM gk{r} GROUP BY ALL), pn{r} AS (SELECT line_number, name, count(*) AS n FROM pk{r} WHERE ok GROUP BY ALL),
gs{r} AS (SELECT line_number, name, sig, count(*) AS n FROM gk{r} GROUP BY ALL), ps{r} AS (SELECT line_number, name, sig, count(*) AS n FROM pk{r} WHERE ok GROUP BY ALL),
tp{r} AS (SELECT coalesce(g.line_number, p.line_number) AS line_number, sum(least(coalesce(g.n, 0), coalesce(p.n, 0))) AS tp, sum(g.n) AS gn, sum(p.n) AS pn, bool_or(g.n IS NULL) AS wrong
  FROM gn{r} g FULL JOIN pn{r} p ON g.line_number = p.line_number AND g.name = p.name GROUP BY 1),
ar{r} AS (SELECT g.line_number, sum(least(g.n, p.n)) AS am FROM gs{r} g JOIN ps{r} p ON g.line_number = p.line_number AND g.name = p.name AND g.sig IS NOT DISTINCT FROM p.sig GROUP BY 1),
s0{r} AS (SELECT m.line_number, m.source, m.mode, coalesce(gn, 0)::INTEGER AS gold_call_count, coalesce(pn, 0)::INTEGER AS predicted_call_count, coalesce(tp, 0)::INTEGER AS tool_name_tp,
  coalesce(am, 0)::INTEGER AS argument_exact_matches, coalesce(wrong, false) AS wrong FROM mo{r} m LEFT JOIN tp{r} USING (line_number) LEFT JOIN ar{r} USING (line_number)),
s1{r} AS (SELECT *, gold_call_count > 0 AS tool, CASE WHEN mode IN ('tool', 'mixed') THEN 'tool' ELSE mode END AS pm, mode = 'tool' AS format_valid,
  CASE gold_call_count WHEN 0 THEN 'text' WHEN 1 THEN 'single' ELSE 'multi' END AS call_kind FROM s0{r}),
s2{r} AS (SELECT *, (CASE WHEN tool THEN 'tool' ELSE 'text' END) = pm AS response_mode_correct, gold_call_count = predicted_call_count AND tool_name_tp = gold_call_count AS tool_name_exact,
  CASE WHEN tool_name_tp > 0 THEN argument_exact_matches = tool_name_tp END AS argument_exact,
  tool AND format_valid AND gold_call_count = predicted_call_count AND argument_exact_matches = gold_call_count AS full_call_exact,
  CASE WHEN NOT tool THEN pm = 'text' END AS no_tool_correct FROM s1{r}),
si{r} AS (SELECT k.line_number * 1000 + k.i AS id, k.line_number, list_filter(tools, lambda t: t.function.name = k.name) AS mine, TRY_CAST(b.body AS JSON)->'$.arguments' AS args,
  len(list_filter(tools, lambda t: coalesce(t.function.name, '') = '' OR coalesce(json_type(t.function.parameters::JSON), '') <> 'OBJECT')) = 0 AS formed
  FROM pk{r} k JOIN pb{r} b ON b.line_number = k.line_number AND b.i = k.i JOIN canonical_samples c ON c.line_number = k.line_number WHERE k.ok),
{walk(f"SELECT id, mine[1].function.parameters::JSON AS s, args AS v FROM si{r} WHERE formed AND len(mine) = 1", r)},
sw{r} AS (SELECT DISTINCT id FROM found{r} WHERE bad),
sv{r} AS (SELECT line_number, bool_and(formed AND len(mine) = 1 AND sw{r}.id IS NULL) AS good FROM si{r} LEFT JOIN sw{r} USING (id) GROUP BY 1),
s3{r} AS (SELECT s2{r}.*, mode <> 'invalid' AND coalesce(good, false) AS schema_valid FROM s2{r} LEFT JOIN sv{r} USING (line_number)),
sc{r} AS (SELECT *, list_filter([CASE WHEN NOT response_mode_correct THEN 'wrong_mode' END, CASE WHEN tool AND NOT format_valid THEN 'format_error' END, CASE WHEN wrong THEN 'wrong_tool' END,
  CASE WHEN tool_name_tp < gold_call_count THEN 'missing_tool' END, CASE WHEN tool_name_tp < predicted_call_count THEN 'extra_tool' END,
  CASE WHEN argument_exact_matches < tool_name_tp THEN 'argument_mismatch' END, CASE WHEN tool AND NOT schema_valid THEN 'schema_invalid' END], lambda x: x IS NOT NULL) AS errs FROM s3{r})"""


_METRICS = """count(*) AS rows, count(*) FILTER (tool) AS tool_rows, count(*) FILTER (NOT tool) AS text_rows,
  count(*) FILTER (tool AND full_call_exact) / nullif(count(*) FILTER (tool), 0) AS full_call_success_rate,
  count(*) FILTER (NOT tool AND no_tool_correct) / nullif(count(*) FILTER (NOT tool), 0) AS no_tool_accuracy,
  count(*) FILTER (response_mode_correct) / count(*) AS response_mode_accuracy,
  count(*) FILTER (tool AND format_valid) / nullif(count(*) FILTER (tool), 0) AS tool_format_valid_rate,
  count(*) FILTER (tool AND tool_name_exact) / nullif(count(*) FILTER (tool), 0) AS tool_name_exact_match,
  CASE WHEN coalesce(sum(gold_call_count) FILTER (tool), 0) > 0 THEN coalesce(sum(tool_name_tp) FILTER (tool) / nullif(sum(predicted_call_count) FILTER (tool), 0), 0) END::DOUBLE AS tool_name_precision,
  (sum(tool_name_tp) FILTER (tool) / nullif(sum(gold_call_count) FILTER (tool), 0))::DOUBLE AS tool_name_recall,
  CASE WHEN coalesce(sum(gold_call_count) FILTER (tool), 0) > 0 THEN coalesce(2.0 * sum(tool_name_tp) FILTER (tool) / nullif(sum(predicted_call_count) FILTER (tool) + sum(gold_call_count) FILTER (tool), 0), 0) END::DOUBLE AS tool_name_f1,
  (sum(argument_exact_matches) FILTER (tool) / nullif(sum(tool_name_tp) FILTER (tool), 0))::DOUBLE AS argument_exact_match,
  count(*) FILTER (tool AND schema_valid) / nullif(count(*) FILTER (tool), 0) AS schema_valid_rate"""

_ALTERED = r"""
al AS (SELECT line_number, generate_subscripts(assistant.tool_calls, 1) - 1 AS i, unnest(assistant.tool_calls).function AS f, line_number % 4 AS v FROM canonical_samples),
ac AS (SELECT line_number, i, f.name AS name, f.arguments::JSON AS g, (CASE v WHEN 0 THEN regexp_replace(f.arguments, '": ?"[^"]*"', '": "changed"', 'g')
  WHEN 1 THEN regexp_replace(f.arguments, '": ?([0-9]+)([,}])', '": "\1"\2', 'g') WHEN 2 THEN regexp_replace(f.arguments, '"(city|format|page|limit|status|notes)":', '"x_\1":', 'g') ELSE f.arguments END)::JSON AS p FROM al),
ag AS (SELECT *, {g} AS gs, {p} AS ps FROM ac),
an AS (SELECT *, row_number() OVER (PARTITION BY line_number, name, gs ORDER BY i) AS gr, row_number() OVER (PARTITION BY line_number, name, ps ORDER BY i) AS pr FROM ag),
lg AS (SELECT line_number, i, name, g FROM an a WHERE NOT EXISTS (SELECT 1 FROM an b WHERE b.line_number = a.line_number AND b.name = a.name AND b.ps IS NOT DISTINCT FROM a.gs AND b.pr = a.gr)),
lp AS (SELECT line_number, i, name, p FROM an a WHERE NOT EXISTS (SELECT 1 FROM an b WHERE b.line_number = a.line_number AND b.name = a.name AND b.gs IS NOT DISTINCT FROM a.ps AND b.gr = a.pr)),
nm AS (SELECT coalesce(x.line_number, y.line_number) AS line_number, coalesce(x.name, y.name) AS name, coalesce(gn, 0) AS gn, coalesce(pn, 0) AS pn
  FROM (SELECT line_number, name, count(*) AS gn FROM lg GROUP BY ALL) x FULL JOIN (SELECT line_number, name, count(*) AS pn FROM lp GROUP BY ALL) y ON x.line_number = y.line_number AND x.name = y.name),
pp AS (SELECT n.line_number, n.name, lg.i AS gi, lg.g, lp.p FROM nm n JOIN lg USING (line_number, name) JOIN lp USING (line_number, name) WHERE gn = 1 AND pn = 1),
st AS (SELECT s.line_number, coalesce(len(assistant.tool_calls), 0) - coalesce((SELECT count(*) FROM lg WHERE lg.line_number = s.line_number), 0) AS exact_pairs,
  count(*) FILTER (gn = 1 AND pn = 1) AS pairs, count(*) FILTER (gn > 0 AND pn > 0 AND NOT (gn = 1 AND pn = 1)) AS ambiguous, coalesce(bool_or((gn = 0) <> (pn = 0)), false) AS unmatched
  FROM canonical_samples s LEFT JOIN nm n USING (line_number) GROUP BY s.line_number, assistant),
ss AS (SELECT *, CASE WHEN ambiguous > 0 THEN 'ambiguous_or_confounded' WHEN unmatched THEN CASE WHEN pairs > 0 THEN 'partially_analyzable' ELSE 'ambiguous_or_confounded' END ELSE 'analyzable' END AS analysis_status FROM st),
nd AS (SELECT line_number, name, gi, 'g' AS side, substr(t.fullkey, 3) AS path, t.type AS ty, t.value AS val FROM pp, json_tree(pp.g) t WHERE t.fullkey <> '$' AND NOT contains(t.fullkey, '[')
  UNION ALL SELECT line_number, name, gi, 'p', substr(t.fullkey, 3), t.type, t.value FROM pp, json_tree(pp.p) t WHERE t.fullkey <> '$' AND NOT contains(t.fullkey, '[')),
nk AS (SELECT *, CASE WHEN ty IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN ty = 'DOUBLE' THEN 'number' WHEN ty = 'VARCHAR' THEN 'string' ELSE lower(ty) END AS kind,
  CASE WHEN contains(path, '.') THEN regexp_replace(path, '\.[^.]*$', '') ELSE '' END AS parent FROM nd),
ob AS (SELECT line_number, name, gi, path FROM nk WHERE kind = 'object' GROUP BY ALL HAVING count(DISTINCT side) = 2),
rp AS (SELECT nk.* FROM nk WHERE parent = '' OR EXISTS (SELECT 1 FROM ob WHERE ob.line_number = nk.line_number AND ob.name = nk.name AND ob.gi = nk.gi AND ob.path = nk.parent)),
mt AS (SELECT line_number, name AS tool, gi AS gold_call_index, path, max(kind) FILTER (side = 'g') AS gk, max(kind) FILTER (side = 'p') AS pk,
  max(CASE WHEN kind = 'array' THEN {v} ELSE val::VARCHAR END) FILTER (side = 'g') AS gv, max(CASE WHEN kind = 'array' THEN {v} ELSE val::VARCHAR END) FILTER (side = 'p') AS pv FROM rp GROUP BY ALL),
df AS (SELECT line_number, tool, gold_call_index, path, CASE WHEN pk IS NULL THEN 'missing_argument' WHEN gk IS NULL THEN 'extra_argument' WHEN gk <> pk THEN 'type_mismatch'
  WHEN gk = 'array' AND gv <> pv THEN 'nested_structure_mismatch' WHEN gk NOT IN ('array', 'object') AND gv <> pv THEN 'wrong_value' END AS type, gk, gk IS NOT NULL AS gold_present, pk IS NOT NULL AS pred_present, gv, pv FROM mt)
""".replace("{g}", _SIG.format(a="g")).replace("{p}", _SIG.format(a="p")).replace("{v}", _SIG.format(a="val"))

_LABELS = "(VALUES " + ", ".join(f"('{x}', {i})" for i, x in enumerate(score.ERRORS)) + ") AS f(label, ord)"
_TRANS = f"""
ta AS (SELECT a.line_number, a.source, a.call_kind, a.errs AS be, b.errs AS ce, CASE WHEN a.full_call_exact AND b.full_call_exact THEN 'both_correct' WHEN b.full_call_exact THEN 'fixed'
  WHEN a.full_call_exact THEN 'regressed' ELSE 'both_wrong' END AS transition FROM sc0 a JOIN sc1 b USING (line_number))"""

ORACLES = {
    "prediction_modes": f"""WITH RECURSIVE {_score_sql()}
SELECT line_number, mode, calls::INTEGER AS calls, mode = 'tool' AS strict_format_valid, CASE WHEN trim(raw, ' ' || chr(10) || chr(9)) = '' THEN 'empty_prediction'
  WHEN mode = 'invalid' THEN concat_ws(',', bads, CASE WHEN regexp_matches(outside, '</?tool_call') THEN 'malformed_tool_call_tags' END)
  WHEN mode = 'mixed' THEN 'prose_outside_tool_calls' ELSE '' END AS errors FROM mo0""",
    "score_samples": f"""WITH RECURSIVE {_score_sql()}
SELECT line_number, call_kind, {', '.join(NUMBERS + FLAGS)}, array_to_string(errs, ',') AS errors FROM sc0""",
    "score_summary": f"WITH RECURSIVE {_score_sql()} SELECT {_METRICS} FROM sc0",
    "score_by_kind": f"WITH RECURSIVE {_score_sql()} SELECT call_kind, {_METRICS} FROM sc0 GROUP BY call_kind",
    "schema_validity": f"WITH RECURSIVE {_score_sql()} SELECT call_kind, schema_valid, count(*) AS samples FROM sc0 GROUP BY ALL",
    "enriched_wrong_values": f"""WITH {_ALTERED},
wv AS (SELECT d.line_number, d.tool, d.gold_call_index, d.path, d.gk FROM df d WHERE type = 'wrong_value'),
dn AS (SELECT line_number, t.function.name AS tool, t.function.parameters AS p FROM (SELECT line_number, unnest(tools) AS t FROM canonical_samples)),
seen AS (SELECT w.line_number, w.tool, w.gold_call_index, w.path, w.gk, json_extract(dn.p::JSON, '$.properties.' || replace(w.path, '.', '.properties.'))::VARCHAR AS s FROM wv w JOIN dn ON dn.line_number = w.line_number AND dn.tool = w.tool),
one AS (SELECT line_number, tool, gold_call_index, path, gk, count(DISTINCT s) AS n, min(s) AS s FROM seen GROUP BY ALL)
SELECT CASE WHEN gk IN ('integer', 'number') THEN 'number' ELSE gk END AS value_type, CASE WHEN n = 1 THEN s::JSON->>'$.type' END AS schema_type, coalesce(CASE WHEN n = 1 THEN json_type(s::JSON, '$.enum') END IS NOT NULL, false) AS enum_field,
  n > 1 AS schema_ambiguous, count(*) AS diffs FROM one GROUP BY ALL""",
    "default_equivalents": """
WITH t AS (SELECT line_number, generate_subscripts(tools, 1) - 1 AS i, unnest(tools).function AS f FROM canonical_samples),
p AS (SELECT line_number, i, f.name AS tool, e.key AS path, json_type(e.value, '$.default') AS ty FROM t, json_each(CASE WHEN json_type(f.parameters::JSON, '$.properties') = 'OBJECT' THEN f.parameters::JSON->'$.properties' ELSE '{}'::JSON END) e)
SELECT DISTINCT line_number, tool, i::INTEGER AS gold_call_index, path, CASE WHEN line_number % 4 < 2 THEN 'missing_argument' ELSE 'extra_argument' END AS type FROM p
WHERE line_number % 2 = 0 AND ty NOT IN ('OBJECT', 'ARRAY') AND tool IS NOT NULL""",
    "identifier_values": rf"""
WITH c AS (SELECT line_number, generate_subscripts(assistant.tool_calls, 1) - 1 AS call, unnest(assistant.tool_calls).function.arguments::JSON AS a FROM canonical_samples),
l AS (SELECT line_number, call, substr(t.fullkey, 3) AS path, t.atom->>'$' AS v FROM c, json_tree(c.a) t WHERE t.type = 'VARCHAR'),
f AS (SELECT *, regexp_replace(lower(path), '[^a-z0-9]', '', 'g') AS name, regexp_matches(v, '^(?i)[a-z][a-z0-9+.-]*:\S+$') AS uri, regexp_matches(v, '[A-Za-z]') AND regexp_matches(v, '[0-9]') AS mixed FROM l),
r AS (SELECT line_number, call::INTEGER AS call, path, uri OR (mixed AND length(v) >= 10) OR regexp_matches(name, '{"|".join(evidence.OPAQUE_PARTS)}') AS loose,
  uri OR (mixed AND regexp_matches(v, '^[A-Za-z0-9_.:+/-]{{10,}}$')) OR name IN {evidence.OPAQUE_PARTS} OR regexp_matches(name, '({"|".join(evidence.OPAQUE_ENDS)})$') AS strict FROM f)
SELECT * FROM r WHERE loose OR strict""",
    "error_histogram": f"""WITH RECURSIVE {_score_sql()}, e AS (SELECT unnest(errs) AS label FROM sc0)
SELECT f.label, f.ord, (SELECT count(*) FROM e WHERE e.label = f.label) AS n FROM {_LABELS}""",
    "mode_histogram": f"""WITH RECURSIVE {_score_sql()}
SELECT f.label, f.ord, (SELECT count(*) FROM mo0 WHERE mode = f.label) AS n FROM (VALUES ('tool', 0), ('text', 1), ('mixed', 2), ('invalid', 3)) AS f(label, ord)""",
    "failure_summary": f"""WITH RECURSIVE {_score_sql()}
SELECT count(*) AS failures, count(*) FILTER (len(errs) > 1) AS multi_label, count(*) FILTER (len(errs) = 0) AS unlabeled FROM sc0 WHERE tool AND NOT full_call_exact""",
    "transitions": f"""WITH RECURSIVE {_score_sql()}, {_score_sql(1)}, {_TRANS},
g AS (SELECT source, call_kind, count(*) AS samples, count(*) FILTER (transition = 'both_correct') AS both_correct, count(*) FILTER (transition = 'fixed') AS fixed,
  count(*) FILTER (transition = 'regressed') AS regressed, count(*) FILTER (transition = 'both_wrong') AS both_wrong FROM ta GROUP BY ROLLUP (source, call_kind))
SELECT *, fixed - regressed AS net, fixed / nullif(fixed + both_wrong, 0) AS fix_rate, regressed / nullif(regressed + both_correct, 0) AS regression_rate FROM g""",
    "transition_errors": f"""WITH RECURSIVE {_score_sql()}, {_score_sql(1)}, {_TRANS},
e AS (SELECT transition, unnest(CASE transition WHEN 'fixed' THEN be ELSE ce END) AS label FROM ta WHERE transition IN ('fixed', 'regressed'))
SELECT t.transition, f.label, (SELECT count(*) FROM e WHERE e.transition = t.transition AND e.label = f.label) AS n FROM (VALUES ('fixed'), ('regressed')) AS t(transition), {_LABELS}""",
    "call_pairing": f"WITH {_ALTERED} SELECT line_number, analysis_status, exact_pairs::INTEGER AS exact_pairs, pairs::INTEGER AS pairs, ambiguous::INTEGER AS ambiguous FROM ss",
    "argument_diffs": f"WITH {_ALTERED} SELECT line_number, tool, gold_call_index::INTEGER AS gold_call_index, path, type, gold_present, pred_present FROM df WHERE type IS NOT NULL",
    "diff_summary": f"""WITH {_ALTERED}, d AS (SELECT line_number, type AS label FROM df WHERE type IS NOT NULL UNION ALL SELECT line_number, 'ambiguous_call_pairing' FROM ss WHERE ambiguous > 0
  UNION ALL SELECT line_number, 'partial_argument_analysis' FROM ss WHERE unmatched)
SELECT f.label, f.ord, (SELECT count(DISTINCT line_number) FROM d WHERE d.label = f.label) AS samples, (SELECT count(*) FROM df WHERE df.type = f.label) AS occurrences
FROM (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(diff.DIAGNOSTICS))}) AS f(label, ord)""",
    "diff_cooccurrence": f"""WITH {_ALTERED}, d AS (SELECT DISTINCT line_number, type AS label FROM df WHERE type IS NOT NULL UNION ALL SELECT line_number, 'ambiguous_call_pairing' FROM ss WHERE ambiguous > 0
  UNION ALL SELECT line_number, 'partial_argument_analysis' FROM ss WHERE unmatched), o AS (SELECT line_number, label, ord FROM d JOIN (VALUES {', '.join(f"('{x}', {i})" for i, x in enumerate(diff.DIAGNOSTICS))}) AS f(label, ord) USING (label))
SELECT a.label AS left, b.label AS right, count(*) AS samples FROM o a JOIN o b ON a.line_number = b.line_number AND a.ord < b.ord GROUP BY ALL""",
    "wrong_value_types": f"""WITH {_ALTERED}
SELECT CASE WHEN gk IN ('integer', 'number') THEN 'number' ELSE gk END AS value_type, count(DISTINCT line_number) AS samples, count(*) AS diffs FROM df WHERE type = 'wrong_value' GROUP BY 1""",
    "literal_in_query": r"""
WITH s AS (SELECT line_number, lower(array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content), chr(10))) AS q,
  generate_subscripts(assistant.tool_calls, 1) - 1 AS call, unnest(assistant.tool_calls).function.arguments::JSON AS a FROM canonical_samples),
n AS (SELECT line_number, call, q, t.key AS argument, t.type AS ty, t.atom AS atom FROM s, json_each(s.a) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL', 'BOOLEAN'))
SELECT line_number, call::INTEGER AS call, argument, CASE WHEN ty = 'VARCHAR' THEN contains(q, lower(atom->>'$'))
  ELSE regexp_matches(q, '(^|[^0-9.])' || replace(replace(atom::VARCHAR, '.', '\.'), '-', '\-') || '($|[^0-9.])') END AS literal FROM n""",
    "bounded_in_query": rf"""
WITH s AS (SELECT line_number, trim(regexp_replace(lower(array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content), chr(10))), '[\x{{9}}-\x{{D}}\x{{1C}}-\x{{20}}\x{{85}}\x{{A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', ' ', 'g')) AS q,
  generate_subscripts(assistant.tool_calls, 1) - 1 AS call, unnest(assistant.tool_calls).function.arguments::JSON AS a FROM canonical_samples),
l AS (SELECT line_number, call, q, t.fullkey, t.type AS ty, CASE WHEN t.type = 'VARCHAR' THEN lower(trim(regexp_replace(t.atom->>'$', '\s+', ' ', 'g'))) ELSE t.atom::VARCHAR END AS v FROM s, json_tree(s.a) t WHERE t.type NOT IN ('OBJECT', 'ARRAY', 'NULL')),
e AS (SELECT *, regexp_replace(v, '([^\p{{L}}\p{{N}}_ ])', '\\\1', 'g') AS x FROM l),
n AS (SELECT *, '(^|[^0-9.])' AS lead, '($|[^0-9.]|\.$|\.[^0-9])' AS tail FROM e)
SELECT line_number, call::INTEGER AS call, CASE WHEN fullkey = '$' THEN '' ELSE replace(regexp_replace(fullkey, '^\$\.?', ''), '"', '') END AS path, CASE
  WHEN ty = 'VARCHAR' THEN v <> '' AND CASE WHEN v IN {evidence.AMBIGUOUS} THEN contains(q, '''' || v || '''') OR contains(q, '"' || v || '"') OR contains(q, '`' || v || '`')
    WHEN regexp_full_match(v, '[\p{{L}}\p{{N}}_-]+') THEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])' || x || '($|[^\p{{L}}\p{{N}}_])') ELSE contains(q, v) END
  WHEN ty = 'BOOLEAN' THEN regexp_matches(q, '(^|[^\p{{L}}\p{{N}}_])' || x || '($|[^\p{{L}}\p{{N}}_])')
  ELSE regexp_matches(q, lead || x || tail) OR (regexp_matches(v, '^-?[0-9]+\.0+$') AND regexp_matches(q, lead || regexp_replace(x, '\\\.0+$', '') || tail)) END AS literal FROM n""",
    "evidence_rules": """
WITH r AS (SELECT (l_orderkey + l_linenumber) % 4 AS k, l_linenumber % 3 = 0 AS off FROM lineitem)
SELECT k, CASE WHEN off THEN 'none' WHEN k = 0 THEN 'percentage' WHEN k = 1 THEN 'dozen' WHEN k = 2 THEN 'pagination' ELSE 'date' END AS rule, count(*) AS n FROM r GROUP BY ALL""",
    "argument_equivalence": r"""
WITH s AS (SELECT line_number, generate_subscripts(assistant.tool_calls, 1) - 1 AS call, unnest(assistant.tool_calls).function.arguments AS a FROM canonical_samples),
x AS (SELECT line_number, call, a::JSON AS g, (CASE line_number % 4 WHEN 0 THEN upper_text WHEN 1 THEN regexp_replace(a, '": ?([0-9]+)([,}])', '": \1.0\2', 'g') WHEN 2 THEN regexp_replace(a, '": ?([0-9]+)([,}])', '": "\1"\2', 'g') ELSE a END)::JSON AS p
  FROM (SELECT *, regexp_replace(a, '": "([a-z]+) ([a-z]+)"', '": "\1-\2!"', 'g') AS upper_text FROM s)),
n AS (SELECT *, (SELECT string_agg(t.fullkey || ':' || CASE t.type WHEN 'VARCHAR' THEN 's' || regexp_replace(lower(t.atom->>'$'), '[^\p{L}\p{N}]+', '', 'g') WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' WHEN 'BOOLEAN' THEN t.atom::VARCHAR WHEN 'NULL' THEN 'null'
  ELSE 'n' || (t.atom::VARCHAR::DOUBLE)::VARCHAR END, '|' ORDER BY t.fullkey) FROM json_tree(g) t) AS gs,
  (SELECT string_agg(t.fullkey || ':' || CASE t.type WHEN 'VARCHAR' THEN 's' || regexp_replace(lower(t.atom->>'$'), '[^\p{L}\p{N}]+', '', 'g') WHEN 'OBJECT' THEN 'o' WHEN 'ARRAY' THEN 'a' WHEN 'BOOLEAN' THEN t.atom::VARCHAR WHEN 'NULL' THEN 'null'
  ELSE 'n' || (t.atom::VARCHAR::DOUBLE)::VARCHAR END, '|' ORDER BY t.fullkey) FROM json_tree(p) t) AS ps FROM x)
SELECT line_number, call::INTEGER AS call, gs = ps AS same FROM n""",
    "repr_equivalence": """
SELECT p_partkey, regexp_replace(lower(p_name), '[^\\p{L}\\p{N}]+', '', 'g') = regexp_replace(lower(CASE p_partkey % 3 WHEN 0 THEN upper(replace(p_name, ' ', '-')) WHEN 1 THEN p_name || '!' ELSE p_name || ' x' END),
  '[^\\p{L}\\p{N}]+', '', 'g') AS same FROM part""".replace("\\\\", "\\"),
}
