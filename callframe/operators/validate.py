"""The final contract of canonical samples: structure, schemas, status."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callframe.functions.batched import batched
from callframe.functions.jsonx import loads
from callframe.functions.schema_check import violations, well_formed

#: Statuses in their order, and the exact fields of each object.
STATUSES = ("keep", "repaired_keep", "manual_review", "drop")
FIELDS = {
    "sample": {"sample_id", "source", "messages", "tools", "assistant", "metadata"},
    "message": {"role", "content"},
    "tool": {"type", "function"},
    "tool.function": {"name", "description", "parameters"},
    "assistant": {"content", "tool_calls"},
    "call": {"type", "function"},
    "call.function": {"name", "arguments"},
    "metadata": {"category", "subcategory", "task"},
}
ROLES = ("system", "user", "assistant")
STRUCTURE = "invalid_canonical_structure"
ERROR = "array<struct<issue string, field string, keyword string>>"


def _shape(value, of: str) -> bool:
    return isinstance(value, dict) and value.keys() == FIELDS[of]


def _text(value) -> bool:
    return isinstance(value, str) and bool(value)


def contract_errors(sample, known: dict) -> tuple[list[tuple], list[tuple]]:
    """(errors that drop the sample, schema mismatches) as (issue, field, keyword)."""
    drop: list[tuple] = []
    bad = lambda issue, field: drop.append((issue, field, None))
    if not _shape(sample, "sample"):
        bad(STRUCTURE, "sample")
        if not isinstance(sample, dict):
            return drop, []
    if not _text(sample.get("sample_id")):
        bad(STRUCTURE, "sample_id")
    if not _text(sample.get("source")):
        bad(STRUCTURE, "source")
    messages = sample.get("messages")
    if not isinstance(messages, list) or not messages:
        bad(STRUCTURE, "messages")
    for i, m in enumerate(messages if isinstance(messages, list) else ()):
        if not _shape(m, "message") or m["role"] not in ROLES or not isinstance(m["content"], str):
            bad(STRUCTURE, f"messages[{i}]")
    if not _shape(sample.get("metadata"), "metadata"):
        bad(STRUCTURE, "metadata")
    tools: dict[str, list] = {}
    listed = sample.get("tools")
    if not isinstance(listed, list):
        bad(STRUCTURE, "tools")
    for i, t in enumerate(listed if isinstance(listed, list) else ()):
        f = t.get("function") if isinstance(t, dict) else None
        if not _shape(t, "tool") or t["type"] != "function" or not _shape(f, "tool.function"):
            bad("invalid_tool_structure", f"tools[{i}]")
            continue
        if not _text(f["name"]) or not (f["description"] is None or isinstance(f["description"], str)):
            bad("invalid_tool_structure", f"tools[{i}].function")
            continue
        key = json.dumps(f["parameters"], sort_keys=True)
        if key not in known:
            known[key] = isinstance(f["parameters"], dict) and well_formed(f["parameters"])
        if not known[key]:
            bad("invalid_tool_schema", f"tools[{i}].function.parameters")
            continue
        tools.setdefault(f["name"], []).append(f["parameters"])
    return drop, _answer_errors(sample.get("assistant"), tools, bad)


def _answer_errors(answer, tools: dict[str, list], bad) -> list[tuple]:
    """Reports structural errors to bad and returns the schema mismatches."""
    if not _shape(answer, "assistant"):
        bad(STRUCTURE, "assistant")
        return []
    content, calls = answer["content"], answer["tool_calls"]
    if content is not None and not isinstance(content, str):
        bad(STRUCTURE, "assistant.content")
    if not isinstance(calls, list):
        bad(STRUCTURE, "assistant.tool_calls")
        return []
    if content is not None and calls:
        bad(STRUCTURE, "assistant")
    if content is None and not calls:
        bad("empty_assistant_output", "assistant")
    mismatches: list[tuple] = []
    for i, c in enumerate(calls):
        at = f"assistant.tool_calls[{i}]"
        f = c.get("function") if isinstance(c, dict) else None
        if not _shape(c, "call") or c["type"] != "function" or not _shape(f, "call.function") or not _text(f["name"]):
            bad("invalid_tool_call_structure", at)
        elif not isinstance(f["arguments"], dict):
            bad("invalid_arguments_type", at)
        elif len(mine := tools.get(f["name"], [])) != 1:
            bad("ambiguous_tool_definition" if mine else "unknown_tool", at)
        else:
            mismatches += [("arguments_schema_mismatch", at + p.removeprefix("$"), k) for k, p in sorted(violations(f["arguments"], mine[0]), key=lambda e: (e[1], e[0]))]
    return mismatches


@batched(f"sample_id string, source string, dropped boolean, mismatched boolean, errors {ERROR}")
def checked_lines(lines: pd.Series) -> pd.DataFrame:
    """Contract check of raw JSON lines; a line that is no JSON is dropped as invalid_canonical_json."""
    rows, known = [], {}
    for line in lines:
        if len(known) > 50_000:
            known.clear()
        ok, sample, _, _ = loads(line)
        drop, mismatch = contract_errors(sample, known) if ok else ([("invalid_canonical_json", None, None)], [])
        take = lambda k: sample.get(k) if ok and isinstance(sample, dict) and isinstance(sample.get(k), str) else None  # noqa: E731, B023
        errors = [dict(zip(("issue", "field", "keyword"), e)) for e in drop + mismatch]
        rows.append((take("sample_id"), take("source") or "unknown", bool(drop), bool(mismatch), errors))
    return pd.DataFrame(rows, columns=["sample_id", "source", "dropped", "mismatched", "errors"])


def canonical_lines(samples: DataFrame) -> DataFrame:
    """(line_number, value): samples of the table as JSON lines, with parameters and arguments as objects again.

    NULL fields are written, as the contract asks for every field; a NULL struct is null.
    """
    quote = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    raw = lambda c: F.coalesce(c, F.lit("null"))

    def obj(*pairs):
        parts = []
        for i, (k, v) in enumerate(pairs):
            parts += [F.lit((", " if i else "{") + json.dumps(k) + ": "), v]
        return F.concat(*parts, F.lit("}"))

    def arr(c, f):
        return F.when(c.isNull(), "null").otherwise(F.concat(F.lit("["), F.array_join(F.transform(c, f), ", "), F.lit("]")))

    message = lambda m: obj(("role", quote(m["role"])), ("content", quote(m["content"])))
    tool = lambda t: obj(("type", quote(t["type"])), ("function", obj(("name", quote(t["function"]["name"])), ("description", quote(t["function"]["description"])), ("parameters", raw(t["function"]["parameters"])))))
    call = lambda c: obj(("type", quote(c["type"])), ("function", obj(("name", quote(c["function"]["name"])), ("arguments", raw(c["function"]["arguments"])))))
    a, m = F.col("assistant"), F.col("metadata")
    whole = obj(
        ("sample_id", quote(F.col("sample_id"))),
        ("source", quote(F.col("source"))),
        ("messages", arr(F.col("messages"), message)),
        ("tools", arr(F.col("tools"), tool)),
        ("assistant", F.when(a.isNull(), "null").otherwise(obj(("content", quote(a["content"])), ("tool_calls", arr(a["tool_calls"], call))))),
        ("metadata", F.when(m.isNull(), "null").otherwise(obj(*((k, quote(m[k])) for k in ("category", "subcategory", "task"))))),
    )
    return samples.select("line_number", whole.alias("value"))


def validate(lines: DataFrame, repaired_ids: DataFrame | None = None) -> DataFrame:
    """(line_number, sample_id, source, status, issues, errors, first): one row per line.

    status: drop before manual_review before repaired_keep before keep. first is true for the
    first line of a sample_id, later ones are duplicates; lines without an id are never duplicates.
    """
    c = lines.withColumn("_c", checked_lines("value")).select("line_number", "_c.*")
    if repaired_ids is not None:
        c = c.join(repaired_ids.select("sample_id").distinct().withColumn("_fixed", F.lit(True)), "sample_id", "left")
    else:
        c = c.withColumn("_fixed", F.lit(None).cast("boolean"))
    status = F.when(F.col("dropped"), "drop").when(F.col("mismatched"), "manual_review").when(F.col("_fixed"), "repaired_keep").otherwise("keep")
    n = F.row_number().over(Window.partitionBy(F.coalesce("sample_id", F.concat(F.lit("\x00"), F.col("line_number").cast("string")))).orderBy("line_number"))
    return c.select("line_number", "sample_id", "source", status.alias("status"), F.array_distinct(F.transform("errors", lambda e: e["issue"])).alias("issues"), "errors", (n == 1).alias("first"))


def summarize(validated: DataFrame) -> DataFrame:
    """(source, keep, repaired_keep, manual_review, drop, total): overall (NULL source) and per source."""
    return validated.rollup("source").agg(*[F.count_if(F.col("status") == s).alias(s) for s in STATUSES], F.count("*").alias("total"))


def violations_of(df: DataFrame, **rules) -> DataFrame:
    """(rule, n): how many rows break each named predicate; NULL counts as broken."""
    counts = df.agg(*[F.count_if(~F.coalesce(p, F.lit(False))).alias(k) for k, p in rules.items()])
    return counts.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.col(k).alias("n")) for k in rules])).alias("r")).select("r.*")


def require(df: DataFrame, predicate, message: str, show: int = 5) -> None:
    """Raises with up to `show` examples if a row breaks the predicate."""
    broken = df.filter(~F.coalesce(predicate, F.lit(False))).limit(show).collect()
    if broken:
        raise ValueError(f"{message}: {[r.asDict(True) for r in broken]}")
