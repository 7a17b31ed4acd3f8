"""Tool calls out of raw conversations, and the layers of their audit.

Calls are numbered across the messages of a sample inside the row, without a shuffle. The
audit layers are columns of one calls frame; only the tools of a sample come by a join.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, is_object, kind_of, loads
from callframe.functions.schema_check import ENUM_EMPTY, ENUM_MISFIT, enum_sites, observed, schema_faults, value_issues
from callframe.functions.skew import lookup_join
from callframe.operators.predict import DATA_TAG, tag_bodies
from callframe.sources.rejects import split_calls


def extract_calls(samples: DataFrame, conversations: str = "conversations", speaker: str = "from", text: str = "value", role: str = "gpt", key: str = "sample_id") -> DataFrame:
    """(sample_id, message_index, tool_call_index, raw_content): one row per tag body of the messages of `role`.

    message_index is the place of the message in the conversation, tool_call_index runs
    over all messages of the sample, both from 0. Samples without calls give no row.
    """
    numbered = F.filter(F.transform(F.col(conversations), lambda m, i: F.struct(i.alias("i"), m[speaker].alias("who"), m[text].alias("t"))), lambda m: m["who"] == role)
    bodies = F.flatten(F.transform(numbered, lambda m: F.transform(tag_bodies(m["t"], DATA_TAG), lambda b: F.struct(m["i"].alias("message_index"), b.alias("raw_content")))))
    out = samples.select(F.col(key).alias("sample_id"), F.posexplode(bodies).alias("tool_call_index", "c"))
    return out.select("sample_id", "c.message_index", "tool_call_index", "c.raw_content")


def parse_calls(calls: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Calls with ok, kind, name, arguments, value, method and the issues of layers 1 and 2 (see split_calls), and the columns `keep`.

    One narrow pass; the calls are not joined to themselves.
    """
    return split_calls(calls, key, keep=keep).withColumnRenamed("call_id", key)


def has_key(value: Column, key: str) -> Column:
    """Whether a canonical JSON object has a member; false for other values and NULL."""
    return F.coalesce(F.array_contains(F.json_object_keys(value), key), F.lit(False))


def tool_names(tools: Column) -> Column:
    """Distinct names of a sample's tools; NULL names are left out."""
    return F.array_distinct(F.filter(F.coalesce(F.transform(tools, lambda t: t["function"]["name"]), F.array().cast("array<string>")), lambda n: n.isNotNull()))


def audit_names(parsed: DataFrame, names: str = "tool_names") -> DataFrame:
    """Layer 3: parsed with candidate_name, name_source, verified and name_issues.

    The name at the top, else one nested in the arguments. Without a name the issue is
    missing_tool_name, without tools missing_tools, with a name that no tool has unknown_tool.
    """
    v = F.col("value")
    args = F.get_json_object(v, "$.arguments")
    source = F.when(has_key(v, "name"), "top_level_name").when(is_object(v, "$.arguments") & has_key(args, "name"), "nested_arguments_name")
    candidate = F.when(F.col("name_source") == "top_level_name", F.get_json_object(v, "$.name")).when(F.col("name_source").isNotNull(), F.get_json_object(args, "$.name"))
    out = parsed.withColumn("name_source", source).withColumn("candidate_name", candidate)
    known = F.coalesce(F.array_contains(F.col(names), F.col("candidate_name")), F.lit(False))
    issue = (
        F.when(F.col("name_source").isNull(), "missing_tool_name")
        .when(F.coalesce(F.size(names), F.lit(0)) <= 0, "missing_tools")
        .when(~known, "unknown_tool")
    )
    return out.withColumn("verified", issue.isNull()).withColumn("name_issues", F.array_compact(F.array(issue)))


# Layer 4: definitions recovered from system texts

TOOLS_TAG = re.compile(r"<tools>(.*?)</tools>", re.DOTALL)
WRAPPER = re.compile(r'\{\s*"type"\s*:\s*"function"')
RECOVERED = T.StructType(
    [
        T.StructField("tag_count", T.IntegerType()),
        T.StructField("present", T.BooleanType()),
        T.StructField("malformed", T.BooleanType()),
        T.StructField("candidates", T.IntegerType()),
        T.StructField("tools", T.StringType()),
        T.StructField("names", T.ArrayType(T.StringType())),
        T.StructField("methods", T.ArrayType(T.StringType())),
    ]
)
_STRING = re.compile(r'"(?:[^"\\]|\\.)*(?:"|$)', re.DOTALL)


def escape_controls(text: str) -> str:
    """Raw control characters inside JSON strings as escapes; all else as it was."""
    fix = lambda m: re.sub(r"(\\.)|([\x00-\x1f])", lambda c: c[1] or json.dumps(c[2])[1:-1], m[0], flags=re.DOTALL)
    return _STRING.sub(fix, text)


def definition_names(tools) -> list[str]:
    """Names in a list of tools, wrapped or direct; what is no tool is passed over."""
    found = set()
    for t in tools if isinstance(tools, list) else ():
        if isinstance(t, dict):
            f = t.get("function")
            n = f.get("name") if isinstance(f, dict) else t.get("name")
            if isinstance(n, str):
                found.add(n)
    return sorted(found)


def recover_tools(texts: list[str]) -> dict:
    """Tools in the <tools> tags of system texts; available only if exactly one distinct candidate remains.

    Tried are the strict body, and, where a wrapper was split off before the tag, the stitched
    text with and without raw control characters escaped.
    """
    tags, bodies, strict, found = 0, 0, False, {}

    def offer(method: str, text: str) -> bool:
        ok, value, _, _ = loads(text)
        if ok and definition_names(value):
            found.setdefault(canon(value), set()).add(method)
        return ok

    for text in texts:
        for m in TOOLS_TAG.finditer(text):
            tags += 1
            inner = m[1].strip()
            if not inner:
                continue
            bodies += 1
            strict |= offer("strict_system_tools_json", m[1])
            for w in WRAPPER.finditer(text, 0, m.start()) if inner.startswith("[") else ():
                joined = "[" + text[w.start() : m.start()] + inner[1:]
                offer("stitch_split_function_wrapper", joined)
                offer("stitch_split_function_wrapper_and_escape_controls", escape_controls(joined))
    one = next(iter(found)) if len(found) == 1 else None
    return {
        "tag_count": tags,
        "present": bodies > 0,
        "malformed": bodies > 0 and not strict,
        "candidates": len(found),
        "tools": one,
        "names": definition_names(json.loads(one)) if one else [],
        "methods": sorted(found[one]) if one else [],
    }


@batched(RECOVERED)
def recovered_tools(texts: pd.Series) -> pd.DataFrame:
    """recover_tools for an array of system texts per row; NULL is an empty array."""
    return pd.DataFrame([recover_tools([x for x in (t if t is not None else []) if x is not None]) for t in texts])


def audit_missing_tools(samples: DataFrame, system_texts: str = "system_texts") -> DataFrame:
    """Layer 4: samples with `recovery` and the issues missing_ or malformed_system_tool_definition.

    Meant for the samples whose calls lack tools, each once.
    """
    r = F.col("recovery")
    issue = F.when(~r["present"], "missing_system_tool_definition").when(r["malformed"], "malformed_system_tool_definition")
    return samples.withColumn("recovery", recovered_tools(system_texts)).withColumn("recovery_issues", F.array_compact(F.array(issue)))


# Layer 5: arguments against the definition

DETAIL = "issue string, argument_path string, expected_type string, actual_type string, argument_name string, renamed_to string, allowed_values array<string>, schema_errors array<struct<schema_path string, reason string>>"
AUDITED = f"schema_checked boolean, tool_name string, tool_name_source string, tool_definition_source string, valid_against_schema boolean, not_checked_reason string, issues array<string>, issue_details array<struct<{DETAIL}>>"


def _named(tools: list, name: str) -> set[str]:
    """Distinct canonical definitions of a name."""
    out = set()
    for t in tools:
        d = t.get("function", t) if isinstance(t, dict) else None
        if isinstance(d, dict) and d.get("name") == name:
            out.add(canon(d))
    return out


def audit_arguments(value, tools: list, recovered: list) -> dict:
    """Checks one call against the single definition of its name; listed tools come before recovered ones.

    Different definitions of the name are an invalid_tool_schema. If a schema's only faults are
    enums that cannot be met, the rest of it is still checked.
    """
    name = args = where = None
    if isinstance(value, dict):
        args = value.get("arguments")
        if isinstance(value.get("name"), str):
            name, where = value["name"], "top_level_name"
        elif isinstance(args, dict) and isinstance(args.get("name"), str):
            name, where = args["name"], "nested_arguments_name"
            args = {k: v for k, v in args.items() if k != "name"}
    own, other = (_named(tools, name), _named(recovered, name)) if name is not None else (set(), set())
    out = {"schema_checked": False, "tool_name": name, "tool_name_source": where, "tool_definition_source": "top_level_tools" if own else "diagnostic_system_tools" if other else None}
    out |= {"valid_against_schema": False, "not_checked_reason": None, "issues": [], "issue_details": []}
    some = own or other
    if not some:
        return out | {"not_checked_reason": "tool_definition_unavailable"}
    bad = lambda faults: dict.fromkeys(DETAIL_KEYS) | {"issue": "invalid_tool_schema", "schema_errors": [{"schema_path": p, "reason": r} for p, r in faults]}
    if len(some) > 1:
        return out | {"issues": ["invalid_tool_schema"], "issue_details": [bad([("$", "conflicting_tool_definitions")])]}
    schema = json.loads(next(iter(some))).get("parameters")
    faults = [*schema_faults(schema)]
    if isinstance(schema, dict) and schema.get("type") != "object":
        faults.append(("$.type", "tool_parameters_root_must_be_object"))
    details = [bad(faults)] if faults else []
    if not faults or (schema.get("type") == "object" if isinstance(schema, dict) else False) and all(r in (ENUM_EMPTY, ENUM_MISFIT) for _, r in faults):
        details += value_issues(args, schema, "$.arguments")
    issues = [*dict.fromkeys(d["issue"] for d in details)]
    if faults:
        return out | {"not_checked_reason": "invalid_tool_schema", "issues": issues, "issue_details": details}
    return out | {"schema_checked": True, "valid_against_schema": not issues, "issues": issues, "issue_details": details}


DETAIL_KEYS = tuple(f.split()[0] for f in DETAIL.split(", ")[:8])


def _tools_of(text: str | None) -> list:
    ok, v, _, _ = loads(text)
    return v if ok and isinstance(v, list) else []


@batched(AUDITED)
def audited_arguments(values: pd.Series, tools: pd.Series, recovered: pd.Series) -> pd.DataFrame:
    rows, known = [], {}
    for v, t, r in zip(values, tools, recovered):
        ok, value, _, _ = loads(v)
        for text in (t, r):
            if text not in known:  # calls of one sample come with the same text
                if len(known) > 2_000:
                    known.clear()
                known[text] = _tools_of(text)
        rows.append(audit_arguments(value if ok else None, known[t] if t in known else _tools_of(t), known[r]))
    return pd.DataFrame(rows)


def tools_json(tools: Column) -> Column:
    """A sample's tools as a JSON array whose parameters are objects again."""
    one = lambda t: F.concat(
        F.lit('{"function":{"name":'),
        F.coalesce(F.get_json_object(F.to_json(F.array(t["function"]["name"])), "$"), F.lit("[null]")),
        F.lit(',"parameters":'),
        F.coalesce(t["function"]["parameters"], F.lit("null")),
        F.lit("}}"),
    )
    # to_json of a one-element array quotes the name; its brackets are taken off.
    return F.concat(F.lit("["), F.array_join(F.transform(tools, lambda t: F.regexp_replace(one(t), r'"name":\[(.*?)\],"parameters":', r'"name":$1,"parameters":')), ","), F.lit("]"))


def sample_tools(samples: DataFrame, **columns: Column) -> DataFrame:
    """(sample_id, columns...) of the first delivery of each sample: the row with the lowest line_number."""
    order = F.coalesce("line_number", F.lit(1 << 62)) if "line_number" in samples.columns else F.lit(0)
    rows = samples.filter(F.col("sample_id").isNotNull()).select("sample_id", order.alias("_n"), F.struct(*[c.alias(k) for k, c in columns.items()]).alias("_v"))
    return rows.groupBy("sample_id").agg(F.min_by("_v", "_n").alias("_v")).select("sample_id", "_v.*")


def audit_all(calls: DataFrame, samples: DataFrame, key: str = "call_id") -> DataFrame:
    """Layers 1 to 5 of every call: issues in layer order, each once, and the payloads of layers 3 and 5.

    calls (key, sample_id, raw_content); samples (sample_id, tools, and optionally
    system_texts for recovery and line_number), of which the first delivery counts. A call whose
    sample is unknown has no tools. One runaway sample_id may hold any share of the calls; the
    hot ones are counted on the raw ids, so no body is parsed for it, and each is parsed once.
    """
    parsed = parse_calls(calls, key, ("sample_id",))
    system = F.col("system_texts") if "system_texts" in samples.columns else F.array().cast("array<string>")
    known = audit_missing_tools(sample_tools(samples, tools_json=tools_json(F.col("tools")), tool_names=tool_names(F.col("tools")), system_texts=system))
    joined = audit_names(lookup_join(parsed, known, "sample_id", "left", counted=calls))
    checked = joined.withColumn("arguments_audit", audited_arguments("value", "tools_json", F.col("recovery.tools")))
    lacking = F.array_contains("name_issues", "missing_tools")
    none = F.array().cast("array<string>")
    later = F.concat("issues", "name_issues", F.when(lacking, F.coalesce("recovery_issues", none)).otherwise(none), F.coalesce("arguments_audit.issues", none))
    return checked.select(key, "sample_id", "ok", "method", "candidate_name", "name_source", "verified", "arguments_audit", F.array_distinct(later).alias("issues"))


# Layer 6: enums that cannot be met

SITE = "array<struct<schema_path string, reason string, kind string, segments array<string>, declared_type string>>"


@batched(SITE)
def unmeetable_enums(schemas: pd.Series) -> pd.Series:
    """Sites of enums that cannot be met; kind is null_placeholder ([null]), empty ([]) or meaningful."""
    out = []
    for text in schemas:
        ok, schema, _, _ = loads(text)
        sites = []
        for path, reason, at, node in enum_sites(schema) if ok else ():
            e = node.get("enum")
            kind = "null_placeholder" if e == [None] else "empty" if e == [] else "meaningful"
            sites.append({"schema_path": path, "reason": reason, "kind": kind, "segments": ["[]" if s is None else s for s in at], "declared_type": str(node.get("type"))})
        out.append(sites)
    return pd.Series(out)


@batched("array<string>")
def observed_kinds(arguments: pd.Series, segments: pd.Series) -> pd.Series:
    """Kinds of the values that a call has at a site."""
    out = []
    for text, at in zip(arguments, segments):
        ok, value, _, _ = loads(text)
        out.append([kind_of(v) for v in observed(value, tuple(None if s == "[]" else s for s in at))] if ok and at is not None else [])
    return pd.Series(out)


def investigate_enums(definitions: DataFrame, calls: DataFrame) -> DataFrame:
    """(tool_name, schema_path, reason, kind, declared_type, observed, compatible, removable).

    definitions (tool_name, parameters), calls (tool_name, arguments). observed counts the values
    that calls have at the site, compatible those of the declared type; a placeholder enum is
    removable if no observed value contradicts the declared type. Sites are few, calls many:
    sites go to the calls by their tool name, and counts are combined on the map side.
    """
    sites = definitions.select("tool_name", "parameters").distinct().select("tool_name", F.explode(unmeetable_enums("parameters")).alias("s")).select("tool_name", "s.*").distinct()
    met = calls.select("tool_name", "arguments").join(sites, "tool_name").withColumn("k", F.explode(observed_kinds("arguments", "segments")))
    fits = (F.col("k") == F.col("declared_type")) | ((F.col("declared_type") == "number") & (F.col("k") == "integer"))
    counts = met.groupBy("tool_name", "schema_path").agg(F.count("*").alias("observed"), F.count_if(fits).alias("compatible"))
    out = sites.join(counts, ["tool_name", "schema_path"], "left").na.fill(0, ["observed", "compatible"])
    return out.withColumn("removable", (F.col("kind") != "meaningful") & (F.col("observed") == F.col("compatible"))).drop("segments")
