"""Queries of the general training-data problems (p1, p2)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callframe.functions.staging import shared_dir
from callframe.operators import shred
from callframe.sources import rejects
from callframe.sources.tables import table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    calls = rejects.split_calls(table(spark, d, "tool_call_parses"))
    return rejects.rejected_calls(calls).select("call_id", "reason")


def p1_loaded(spark: SparkSession, d: str) -> DataFrame:
    return rejects.usable_calls(rejects.split_calls(table(spark, d, "tool_call_parses")))


def p1_csv(spark: SparkSession, d: str) -> DataFrame:
    """CSV files of all parts, of which four lines in ten are spoilt: typed rows and rejects with their reason, joined to the raw record."""
    k = F.col("p_partkey") % 10
    name = F.regexp_replace("p_name", '[",]', " ")
    line = F.when(k == 3, F.concat_ws(",", "p_partkey", "p_size"))
    line = line.when(k == 5, F.concat_ws(",", "p_partkey", "p_size", name, F.lit("more"))).when(k == 7, F.concat_ws(",", "p_partkey", F.lit("x"), name))
    line = line.when(k == 9, F.concat_ws(",", "p_partkey", "p_size", F.concat(F.lit('"'), name, F.lit('" x')))).otherwise(F.concat_ws(",", "p_partkey", "p_size", name))
    path = f"{shared_dir(spark)}/parts-{uuid.uuid4().hex}"
    table(spark, d, "part").select(line.alias("value")).repartition(4, "p_partkey").write.text(path)
    # The shared folder is mounted on the machines.
    good, bad = rejects.read_csv_rejects(spark, f"{path.removeprefix('file://').removeprefix('file:')}/part-*", {"part": "BIGINT", "size": "INTEGER", "name": "VARCHAR"})
    loaded = good.select("part", F.lit("loaded").alias("reason"), "size", "name")
    # Of the errors of a line the first counts, as the reader meets them.
    rejected = bad.groupBy("file", "line").agg(F.min_by("error_type", F.coalesce("column_name", F.lit(""))).alias("reason"), F.min("raw").alias("raw"))
    parts = rejected.select(F.regexp_extract("raw", r"^(\d+)", 1).cast("bigint").alias("part"), "reason", F.lit(None).cast("int").alias("size"), F.lit(None).cast("string").alias("name"))
    return loaded.unionByName(parts)


def _shredded(spark: SparkSession, d: str) -> shred.Shredded:
    return shred.shred(shred.all_texts(table(spark, d, "canonical_samples"), table(spark, d, "tool_call_audits")))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """The four flat child tables, each row through the occurrence of a distinct tree."""
    return shred.flat_paths(_shredded(spark, d))


def p2_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The store of distinct subtrees of parameters, arguments and audit validations: identity, kind, body and number of occurrences."""
    return shred.distinct_nodes(_shredded(spark, d)).select(F.lower(F.hex("node")).alias("node"), "kind", "body", "occurrences")


def p2_bridge(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of every subtree with its parent, ordinal and path."""
    hexed = lambda c: F.lower(F.hex(c)).alias(c)
    return shred.bridge(_shredded(spark, d)).select("child", "record_id", "parent_index", hexed("node"), hexed("parent"), "ordinal", "path", "kind")


def p2_places(spark: SparkSession, d: str) -> DataFrame:
    """Every place of every record with its path and kind, from the bridge."""
    return shred.bridge(_shredded(spark, d)).select("child", "record_id", "parent_index", "path", "kind")


def p2_values(spark: SparkSession, d: str) -> DataFrame:
    """The scalars of the store with how often each occurs in all records."""
    return shred.distinct_nodes(_shredded(spark, d)).filter(~F.col("kind").isin("object", "array")).select("kind", "body", "occurrences")


QUERIES = {"p1_found": p1_found, "p1_loaded": p1_loaded, "p1_csv": p1_csv, "p2_found": p2_found, "p2_nodes": p2_nodes, "p2_bridge": p2_bridge, "p2_places": p2_places, "p2_values": p2_values}

#: A Python literal written as JSON: quotes, constants, tuples and commas before a bracket; what that makes no JSON was no literal of a dict.
AS_JSON = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(b, '''([^''"\\]*)''', '"\1"', 'g'),
  '\bTrue\b', 'true', 'g'), '\bFalse\b', 'false', 'g'), '\bNone\b', 'null', 'g'), '([:,\[(]\s*)\(([^()]*)\)', '\1[\2]', 'g'), ',\s*([}\]])', '\1', 'g')"""

#: Value of a body as JSON and the issue of layer 1: strict, without the escaped line breaks at its ends, or as a Python literal.
VALUES = rf"""
p AS (SELECT call_id, sample_id, raw_content AS raw, regexp_replace(regexp_replace(raw_content, '^\\n', ''), '\\n$', '') AS b FROM tool_call_parses),
q AS (SELECT *, coalesce(json_valid(raw), false) AS strict, raw <> b AND coalesce(json_valid(b), false) AS edged, {AS_JSON} AS j FROM p),
v AS (SELECT *, NOT strict AND NOT edged AND coalesce(json_valid(j) AND json_type(CASE WHEN json_valid(j) THEN j END) = 'OBJECT', false) AS lit FROM q),
w AS (SELECT call_id, sample_id, CASE WHEN strict THEN NULL WHEN edged THEN 'boundary_literal_escape' WHEN lit THEN 'python_literal_syntax' ELSE 'unclassified_parse_failure' END AS layer_1,
  CASE WHEN strict THEN raw WHEN edged THEN b WHEN lit THEN j END::JSON AS v FROM v),
t AS (SELECT *, json_type(v) AS ty, json_type(v, '$.name') AS tn, json_type(v, '$.arguments') AS ta, json_type(v, '$.arguments.name') AS tan FROM w),
i AS (SELECT *, CASE WHEN v IS NULL THEN [] WHEN ty <> 'OBJECT' THEN ['invalid_tool_call_type'] ELSE list_filter([
  CASE WHEN tn IS NULL THEN CASE WHEN ta = 'OBJECT' AND tan IS NOT NULL THEN 'nested_tool_name' ELSE 'missing_tool_name' END END,
  CASE WHEN ta IS NULL THEN 'missing_arguments' WHEN ta <> 'OBJECT' THEN 'invalid_arguments_type' END], lambda x: x IS NOT NULL) END AS layer_2 FROM t)"""

#: Every JSON text of the records as a document (child, record_id, parent_index, doc).
_DOCS = """
docs AS (
  SELECT 'param' AS child, line_number AS record_id, i::INTEGER AS parent_index, t.function.parameters::JSON AS doc FROM (SELECT line_number, generate_subscripts(tools, 1) - 1 AS i, unnest(tools) AS t FROM canonical_samples)
  UNION ALL SELECT 'argument', line_number, i::INTEGER, c.function.arguments::JSON FROM (SELECT line_number, generate_subscripts(assistant.tool_calls, 1) - 1 AS i, unnest(assistant.tool_calls) AS c FROM canonical_samples)
  UNION ALL SELECT 'audit', audit_id, 0, to_json(argument_schema_validation) FROM tool_call_audits WHERE argument_schema_validation IS NOT NULL
), places AS (
  SELECT child, record_id, parent_index, t.fullkey, t.atom, CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number' WHEN t.type = 'VARCHAR' THEN 'string' ELSE lower(t.type) END AS kind
  FROM docs, json_tree(doc) t WHERE doc IS NOT NULL)"""

ORACLES = {
    "p1_found": f"""WITH {VALUES}
SELECT call_id, layer_1 AS reason FROM i WHERE layer_1 IS NOT NULL UNION ALL SELECT call_id, unnest(layer_2) FROM i""",
    "p1_loaded": f"""WITH {VALUES}
SELECT call_id, CASE WHEN tn = 'VARCHAR' THEN v->>'$.name' END AS name, (v->'$.arguments')::VARCHAR AS arguments FROM i WHERE layer_1 IS NULL AND len(layer_2) = 0""",
    "p1_csv": """
SELECT p_partkey AS part, CASE p_partkey % 10 WHEN 3 THEN 'MISSING COLUMNS' WHEN 5 THEN 'TOO MANY COLUMNS' WHEN 7 THEN 'CAST' WHEN 9 THEN 'UNQUOTED VALUE' ELSE 'loaded' END AS reason,
  CASE WHEN p_partkey % 10 NOT IN (3, 5, 7, 9) THEN p_size END AS size, CASE WHEN p_partkey % 10 NOT IN (3, 5, 7, 9) THEN regexp_replace(p_name, '[",]', ' ', 'g') END AS name FROM part""",
    "p2_places": f"""WITH {_DOCS}
SELECT child, record_id, parent_index, CASE WHEN fullkey = '$' THEN '' ELSE replace(regexp_replace(fullkey, '^\\$\\.?', ''), '"', '') END AS path, kind FROM places""",
    "p2_values": f"""WITH {_DOCS}
SELECT kind, atom::VARCHAR AS body, count(*) AS occurrences FROM (SELECT kind, coalesce(atom, 'null'::JSON) AS atom FROM places WHERE kind NOT IN ('object', 'array')) GROUP BY ALL""",
    "p2_found": """
WITH RECURSIVE texts AS (
  SELECT DISTINCT t.tool.function.parameters AS txt
  FROM (SELECT unnest(tools) AS tool FROM canonical_samples) t WHERE t.tool.function.parameters IS NOT NULL
), walk(txt, path, node, named) AS (
  SELECT txt, '', txt::JSON, false FROM texts
  UNION ALL
  SELECT w.txt, x.path, x.node, x.named
  FROM walk w, LATERAL (
    SELECT CASE WHEN w.path = '' THEN e.key ELSE w.path || '.' || e.key END AS path, e.value AS node, true AS named
    FROM json_each(CASE WHEN json_type(w.node, '$.properties') = 'OBJECT' THEN w.node->'$.properties' ELSE '{}'::JSON END) e
    UNION ALL
    SELECT w.path || '[]', w.node->'$.items', false WHERE json_type(w.node, '$.items') = 'OBJECT'
  ) x
), params AS (SELECT DISTINCT txt, path FROM walk WHERE named),
tools AS (
  SELECT line_number, generate_subscripts(tools, 1) - 1 AS i, unnest(tools) AS tool FROM canonical_samples
), calls AS (
  SELECT line_number, generate_subscripts(assistant.tool_calls, 1) - 1 AS i, unnest(assistant.tool_calls) AS c FROM canonical_samples
), details AS (
  SELECT audit_id, generate_subscripts(argument_schema_validation.issue_details, 1) - 1 AS i,
         unnest(argument_schema_validation.issue_details) AS d FROM tool_call_audits
)
SELECT 'param' AS child, line_number AS record_id, i::INTEGER AS parent_index, path AS node_path
FROM tools JOIN params ON tool.function.parameters = txt
UNION ALL
SELECT DISTINCT 'argument', line_number, i::INTEGER, replace(regexp_replace(e.fullkey, '^\\$\\.?', ''), '"', '')
FROM calls, json_tree(c.function.arguments::JSON) e WHERE e.type NOT IN ('OBJECT', 'ARRAY')
UNION ALL
SELECT 'issue', audit_id, i::INTEGER, d.argument_path FROM details WHERE d.argument_path IS NOT NULL
UNION ALL
SELECT DISTINCT 'schema_error', audit_id, i::INTEGER, e.schema_path
FROM (SELECT audit_id, i, unnest(d.schema_errors) AS e FROM details) WHERE e.schema_path IS NOT NULL
""",
}
