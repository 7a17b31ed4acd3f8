"""SQL of the audit and the validation: tool lookups, and a walk over schema and value together."""

from __future__ import annotations

from callframe.plans.training import VALUES

#: Kind of a JSON value by its type name.
KIND = "CASE WHEN {0} IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN {0} = 'DOUBLE' THEN 'number' WHEN {0} = 'VARCHAR' THEN 'string' ELSE lower({0}) END"

#: Tools of the first delivery of a sample, and the different definitions of each name.
TOOLS = """
ft AS (SELECT sample_id, tools, list_transform(tools, lambda t: t.function.name) AS names FROM canonical_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY line_number) = 1)"""


def walk(start: str, run: str = "") -> str:
    """CTEs up to `found` (id, path, issue, expected, actual, bad), with `run` at the end of their names, from rows (id, s, v) of schemas and values.

    issue is a label of the audit; bad says that the validator objects, too.
    """
    return f"""
chk{run}(id, s, v, path) AS (
  SELECT id, s, v, '$.arguments' FROM ({start})
  UNION ALL
  SELECT c.id, x.s, x.v, x.path FROM chk{run} c, LATERAL (
    SELECT json_extract(c.s, '$.properties."' || e.key || '"') AS s, e.value AS v, c.path || '.' || e.key AS path
    FROM json_each(CASE WHEN json_type(c.v) = 'OBJECT' AND c.s->>'$.type' = 'object' THEN c.v ELSE '{{}}'::JSON END) e
    WHERE json_type(c.s, '$.properties."' || e.key || '"') IS NOT NULL
    UNION ALL
    SELECT c.s->'$.items', e.value, c.path || '[' || e.key || ']'
    FROM json_each(CASE WHEN json_type(c.v) = 'ARRAY' AND c.s->>'$.type' = 'array' AND json_type(c.s, '$.items') IS NOT NULL THEN c.v ELSE '[]'::JSON END) e
  ) x
),
typed{run} AS (SELECT *, {KIND.format('json_type(v)')} AS kind, s->>'$.type' AS want FROM chk{run} WHERE json_type(s) = 'OBJECT'),
fit{run} AS (SELECT *, want IS NULL OR kind = want OR (want = 'number' AND kind = 'integer') AS ok FROM typed{run}),
lists{run} AS (SELECT *, CASE WHEN ok AND want = 'object' THEN json_keys(v) ELSE [] END AS ks, coalesce(json_keys(s, '$.properties'), []) AS ps,
  CASE WHEN ok AND want = 'object' THEN coalesce((s->'$.required')::VARCHAR[], []) ELSE [] END AS rs FROM fit{run}),
lacks{run} AS (SELECT *, list_filter(ks, lambda k: NOT list_contains(ps, k)) AS extra, list_filter(rs, lambda k: NOT list_contains(ks, k)) AS missing FROM lists{run}),
found{run} AS (
  SELECT id, path, 'argument_type_mismatch' AS issue, want AS expected, kind AS actual, NOT coalesce(want = 'integer' AND kind = 'number' AND TRY_CAST(v::VARCHAR AS DOUBLE) = floor(TRY_CAST(v::VARCHAR AS DOUBLE)), false) AS bad FROM lacks{run} WHERE NOT ok
  UNION ALL SELECT id, path, 'enum_mismatch', NULL, NULL, true FROM lacks{run} WHERE ok AND json_type(s, '$.enum') = 'ARRAY' AND NOT list_contains(list_transform((s->'$.enum')::JSON[], lambda x: x::VARCHAR), v::VARCHAR)
  UNION ALL SELECT id, path || '.' || unnest(extra), 'unexpected_argument', NULL, NULL, false FROM lacks{run}
  UNION ALL SELECT id, path || '.' || unnest(missing), 'missing_required_argument', NULL, NULL, true FROM lacks{run}
)"""


def definitions(calls: str) -> str:
    """CTEs up to `judged` and `found` for calls (id, name, args JSON, tools): layer 5 of the audit.

    judged (id, state): `none` without a definition of the name, `bad` with different ones or one that is no object schema, else `checked`.
    """
    return f"""
named AS (SELECT id, args, list_distinct(list_transform(list_filter(tools, lambda t: t.function.name = name), lambda t: coalesce(json(t.function.parameters)::VARCHAR, 'null'))) AS defs FROM ({calls})),
judged AS (SELECT *, CASE WHEN coalesce(len(defs), 0) = 0 THEN 'none' WHEN len(defs) > 1 OR coalesce(json_extract_string(defs[1]::JSON, '$.type'), '') <> 'object' THEN 'bad' ELSE 'checked' END AS state FROM named),
{walk("SELECT id, defs[1]::JSON AS s, args AS v FROM judged WHERE state = 'checked' AND json_type(args) IS NOT NULL")}"""


_NAMED = f"""{VALUES}, {TOOLS},
n AS (SELECT i.*, ft.sample_id IS NOT NULL AS known, tools, names, CASE WHEN tn IS NOT NULL THEN 'top_level_name' WHEN ta = 'OBJECT' AND tan IS NOT NULL THEN 'nested_arguments_name' END AS name_source FROM i LEFT JOIN ft USING (sample_id)),
c AS (SELECT *, CASE name_source WHEN 'top_level_name' THEN v->>'$.name' WHEN 'nested_arguments_name' THEN v->>'$.arguments.name' END AS candidate_name FROM n),
l AS (SELECT *, CASE WHEN name_source IS NULL THEN 'missing_tool_name' WHEN coalesce(len(names), 0) = 0 THEN 'missing_tools' WHEN NOT coalesce(list_contains(names, candidate_name), false) THEN 'unknown_tool' END AS layer_3 FROM c)"""

_CALL_ARGS = """SELECT call_id AS id, tools, CASE WHEN tn = 'VARCHAR' OR tan = 'VARCHAR' THEN candidate_name END AS name,
  CASE WHEN name_source = 'nested_arguments_name' THEN json_merge_patch(v->'$.arguments', '{"name":null}') ELSE coalesce(v->'$.arguments', 'null'::JSON) END AS args FROM l WHERE v IS NOT NULL"""

_CANONICAL = """SELECT line_number * 1000 + i AS id, tools, c.function.name AS name, c.function.arguments::JSON AS args
FROM (SELECT line_number, tools, generate_subscripts(assistant.tool_calls, 1) - 1 AS i, unnest(assistant.tool_calls) AS c FROM canonical_samples)"""

_CONTRACT = f"""
own AS (SELECT line_number, generate_subscripts(assistant.tool_calls, 1) - 1 AS i, unnest(assistant.tool_calls) AS c, tools FROM canonical_samples),
good AS (SELECT line_number * 1000 + i AS id, line_number, c, list_filter(tools, lambda t: t.type = 'function' AND t.function.name <> '' AND coalesce(json_type(t.function.parameters::JSON), '') = 'OBJECT' AND t.function.name = c.function.name) AS mine FROM own),
{walk("SELECT id, mine[1].function.parameters::JSON AS s, c.function.arguments::JSON AS v FROM good WHERE len(mine) = 1")},
wrong AS (SELECT DISTINCT id FROM found WHERE bad),
called AS (SELECT line_number, bool_or(c.type IS DISTINCT FROM 'function' OR coalesce(c.function.name, '') = '') AS odd, bool_or(json_type(c.function.arguments::JSON) IS DISTINCT FROM 'OBJECT') AS args,
  bool_or(len(mine) = 0) AS unknown, bool_or(len(mine) > 1) AS twice, bool_or(wrong.id IS NOT NULL) AS mismatch FROM good LEFT JOIN wrong USING (id) GROUP BY 1),
rules AS (SELECT s.line_number, s.sample_id, s.source, list_filter([
  CASE WHEN coalesce(s.sample_id, '') = '' OR coalesce(s.source, '') = '' OR coalesce(len(messages), 0) = 0 OR metadata IS NULL OR tools IS NULL OR assistant IS NULL
    OR len(list_filter(messages, lambda m: coalesce(m.role, '') NOT IN ('system', 'user', 'assistant') OR m.content IS NULL)) > 0
    OR assistant.tool_calls IS NULL OR (assistant.content IS NOT NULL AND len(assistant.tool_calls) > 0) THEN 'invalid_canonical_structure' END,
  CASE WHEN len(list_filter(tools, lambda t: t.type IS DISTINCT FROM 'function' OR coalesce(t.function.name, '') = '')) > 0 THEN 'invalid_tool_structure' END,
  CASE WHEN len(list_filter(tools, lambda t: t.type = 'function' AND t.function.name <> '' AND coalesce(json_type(t.function.parameters::JSON), '') <> 'OBJECT')) > 0 THEN 'invalid_tool_schema' END,
  CASE WHEN assistant.content IS NULL AND len(assistant.tool_calls) = 0 THEN 'empty_assistant_output' END,
  CASE WHEN odd THEN 'invalid_tool_call_structure' END, CASE WHEN NOT odd AND args THEN 'invalid_arguments_type' END, CASE WHEN unknown THEN 'unknown_tool' END, CASE WHEN twice THEN 'ambiguous_tool_definition' END], lambda x: x IS NOT NULL) AS drops,
  coalesce(mismatch, false) AS mismatch FROM canonical_samples s LEFT JOIN called USING (line_number)),
status AS (SELECT *, CASE WHEN len(drops) > 0 THEN 'drop' WHEN mismatch THEN 'manual_review' ELSE 'keep' END AS status,
  list_sort(drops || CASE WHEN mismatch THEN ['arguments_schema_mismatch'] ELSE [] END) AS issues FROM rules)"""

_REPAIRED = f"""{_NAMED},
r AS (SELECT *, list_contains(layer_2, 'nested_tool_name') AS nested, layer_3 IS NULL AS verified FROM l)"""

_ENUMS = f"""
planted AS (SELECT line_number, t.function.name AS tool_name, i, CASE WHEN line_number % 3 = 0 THEN regexp_replace(t.function.parameters, '"type": ?"integer"', '"type":"integer","enum":[null]', 'g') ELSE t.function.parameters END AS parameters
  FROM (SELECT line_number, generate_subscripts(tools, 1) AS i, unnest(tools) AS t FROM canonical_samples WHERE line_number % 5 <> 0)),
defs AS (SELECT DISTINCT tool_name, parameters FROM planted WHERE parameters IS NOT NULL),
site(tool_name, parameters, s, path, args) AS (
  SELECT tool_name, parameters, parameters::JSON, '$', '$' FROM defs
  UNION ALL
  SELECT w.tool_name, w.parameters, x.s, x.path, x.args FROM site w, LATERAL (
    SELECT e.value AS s, w.path || '.properties.' || e.key AS path, w.args || '.' || e.key AS args FROM json_each(CASE WHEN json_type(w.s, '$.properties') = 'OBJECT' THEN w.s->'$.properties' ELSE '{{}}'::JSON END) e
    UNION ALL SELECT w.s->'$.items', w.path || '.items', w.args || '[*]' WHERE json_type(w.s, '$.items') = 'OBJECT'
  ) x
),
places AS (SELECT *, s->>'$.type' AS declared_type FROM site WHERE (s->'$.enum')::VARCHAR = '[null]'),
broken AS (SELECT DISTINCT tool_name, path, args, declared_type FROM places),
made AS (SELECT c.function.name AS tool_name, c.function.arguments::JSON AS a FROM (SELECT unnest(assistant.tool_calls) AS c FROM canonical_samples)),
seen AS (SELECT b.tool_name, b.path, t.ty FROM (SELECT tool_name, regexp_replace(t.fullkey, '\\[[0-9]+\\]', '[*]', 'g') AS at, t.type AS ty FROM made, json_tree(made.a) t) t JOIN broken b ON b.tool_name = t.tool_name AND b.args = t.at),
counted AS (SELECT tool_name, path, count(*) AS observed, count(*) FILTER (ty IN ('UBIGINT', 'BIGINT', 'HUGEINT')) AS compatible FROM seen GROUP BY ALL),
enums AS (SELECT b.tool_name, b.path, declared_type, coalesce(observed, 0) AS observed, coalesce(compatible, 0) AS compatible FROM broken b LEFT JOIN counted USING (tool_name, path))"""

_SAMPLE_REPAIRS = f"""{VALUES}, {_ENUMS},
fd AS (SELECT sample_id, line_number, list_transform(tools, lambda t: t.function.name) AS names, line_number % 5 = 0 AND len(tools) > 0 AS moved FROM canonical_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY line_number) = 1),
cn AS (SELECT *, CASE WHEN tn IS NOT NULL THEN v->>'$.name' WHEN ta = 'OBJECT' AND tan IS NOT NULL THEN v->>'$.arguments.name' END AS candidate FROM i),
ex AS (SELECT sample_id, list(DISTINCT candidate) AS expected FROM cn WHERE candidate IS NOT NULL GROUP BY 1),
rd AS (SELECT fd.*, moved AND list_has_all(names, coalesce(expected, [])) AS restored FROM fd LEFT JOIN ex USING (sample_id)),
vr AS (SELECT cn.*, list_contains(layer_2, 'nested_tool_name') AS nested, coalesce(list_contains(CASE WHEN moved AND NOT restored THEN [] ELSE names END, candidate), false) AS verified FROM cn LEFT JOIN rd USING (sample_id)),
per AS (
  SELECT sample_id, count(*) FILTER (layer_1 = 'boundary_literal_escape') AS a, count(*) FILTER (layer_1 = 'python_literal_syntax') AS b, count(*) FILTER (nested AND verified) AS c, 0 AS d, 0 AS e,
    max(CASE WHEN ty IS DISTINCT FROM 'OBJECT' THEN 'no_object' WHEN nested AND NOT verified THEN 'nested_name_not_verified' END) AS failure FROM vr WHERE sample_id IS NOT NULL GROUP BY 1
  UNION ALL SELECT sample_id, 0, 0, 0, 1, 0, NULL FROM rd WHERE restored
  UNION ALL SELECT sample_id, 0, 0, 0, 0, count(*), NULL FROM rd JOIN planted p USING (line_number) JOIN places USING (tool_name, parameters) JOIN enums n USING (tool_name, path) WHERE observed = compatible GROUP BY 1),
log AS (SELECT sample_id, sum(a)::INTEGER AS boundary_literal_escape, sum(b)::INTEGER AS python_literal_syntax, sum(c)::INTEGER AS nested_tool_name, sum(d)::INTEGER AS recovered_tools, sum(e)::INTEGER AS removed_enum, max(failure) AS failure FROM per GROUP BY 1)"""

ORACLES = {
    "sample_repairs": f"""WITH RECURSIVE {_SAMPLE_REPAIRS}
SELECT *, CASE WHEN failure IS NOT NULL THEN 'repair_failed' WHEN boundary_literal_escape + python_literal_syntax + nested_tool_name + recovered_tools + removed_enum > 0 THEN 'repaired' ELSE 'unchanged' END AS status FROM log""",
    "sample_repair_summary": f"""WITH RECURSIVE {_SAMPLE_REPAIRS}
SELECT repair, sum(n)::BIGINT AS repairs, count(*) FILTER (n > 0) AS samples FROM (UNPIVOT (SELECT boundary_literal_escape, python_literal_syntax, nested_tool_name, recovered_tools, removed_enum FROM log) ON COLUMNS(*) INTO NAME repair VALUE n) GROUP BY 1""",
    "enum_investigation": f"""WITH RECURSIVE {_ENUMS}
SELECT tool_name, path AS schema_path, 'enum_has_no_value_matching_declared_type' AS reason, 'null_placeholder' AS kind, declared_type, observed, compatible, observed = compatible AS removable FROM enums""",
    "audit_calls": f"""WITH RECURSIVE {_NAMED}, {definitions(_CALL_ARGS)},
five AS (SELECT id, list(DISTINCT issue) AS x FROM found GROUP BY 1)
SELECT call_id, candidate_name, name_source, layer_3 IS NULL AS verified, array_to_string(list_sort(list_distinct(list_filter([layer_1, layer_3, CASE WHEN layer_3 = 'missing_tools' AND known THEN 'missing_system_tool_definition' END,
  CASE WHEN state = 'bad' THEN 'invalid_tool_schema' END] || layer_2 || coalesce(five.x, []), lambda x: x IS NOT NULL))), ',') AS issues
FROM l LEFT JOIN judged ON judged.id = call_id LEFT JOIN five ON five.id = call_id""",
    "argument_audit": f"""WITH RECURSIVE {definitions(_CANONICAL)}
SELECT id // 1000 AS line_number, (id % 1000)::INTEGER AS call, issue, path AS argument_path, expected AS expected_type, actual AS actual_type FROM found
UNION ALL SELECT id // 1000, (id % 1000)::INTEGER, 'invalid_tool_schema', NULL, NULL, NULL FROM judged WHERE state = 'bad'""",
    "repaired_calls": f"""WITH {_REPAIRED}
SELECT call_id, array_to_string(list_filter([CASE WHEN layer_1 <> 'unclassified_parse_failure' THEN layer_1 END, CASE WHEN nested AND verified THEN 'nested_tool_name' END], lambda x: x IS NOT NULL), ',') AS repairs,
  CASE WHEN ty IS DISTINCT FROM 'OBJECT' THEN 'no_object' WHEN nested AND NOT verified THEN 'nested_name_not_verified' END AS failure,
  CASE WHEN ty = 'OBJECT' THEN CASE WHEN nested AND verified THEN candidate_name ELSE v->>'$.name' END END AS name,
  CASE WHEN ta = 'OBJECT' THEN len(json_keys(v, '$.arguments')) - CASE WHEN nested AND verified THEN 1 ELSE 0 END END::INTEGER AS arguments FROM r""",
    "repair_summary": f"""WITH {_REPAIRED}
SELECT x.repair, CASE x.repair WHEN 'nested_tool_name' THEN (SELECT count(*) FROM r WHERE nested AND verified) ELSE (SELECT count(*) FROM r WHERE layer_1 = x.repair) END AS calls
FROM (VALUES ('boundary_literal_escape'), ('python_literal_syntax'), ('nested_tool_name'), ('recovered_tools'), ('removed_enum')) AS x(repair)""",
    "validation_status": f"""WITH RECURSIVE {_CONTRACT}
SELECT line_number, status, array_to_string(issues, ',') AS issues, row_number() OVER (PARTITION BY sample_id ORDER BY line_number) = 1 AS first FROM status""",
    "validation_summary": f"""WITH RECURSIVE {_CONTRACT}
SELECT src AS source, count(*) FILTER (status = 'keep') AS keep, 0::BIGINT AS repaired_keep, count(*) FILTER (status = 'manual_review') AS manual_review, count(*) FILTER (status = 'drop') AS drop, count(*) AS total
FROM (SELECT coalesce(source, 'unknown') AS src, status FROM status) GROUP BY ROLLUP (src)""",
}
