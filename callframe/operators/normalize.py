"""Raw rows of the two source formats to canonical samples."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, loads

#: Source type names and their JSON Schema types.
TYPE_NAMES = {
    "str": "string",
    "string": "string",
    "int": "integer",
    "integer": "integer",
    "float": "number",
    "number": "number",
    "bool": "boolean",
    "boolean": "boolean",
    "list": "array",
    "List": "array",
    "array": "array",
    "dict": "object",
    "Dict": "object",
    "object": "object",
}
#: Source types that are no plain name.
SPECIAL = {"set": {"type": "array", "uniqueItems": True}, "Callable[[float], float]": {"type": "string"}}
ITEM_UNIONS = {"Union[int, float]": {"type": "number"}}
UNIFIED_SYSTEM = "You can call the listed functions. Call one when it fits the request; otherwise answer in plain text."
OPTIONAL = r"(?i),\s*optional\b"
DEFAULT = r"(?i),\s*default(\s*=\s*|\s+).*$"


def bare_type(name: Column) -> Column:
    """Type name without its `, optional` and `, default ...` qualifiers."""
    return F.trim(F.regexp_replace(F.regexp_replace(name, OPTIONAL, ""), DEFAULT, ""))


def scalar_type(name: Column) -> Column:
    """JSON Schema type of a plain source type name; NULL for all others."""
    pairs = [F.lit(x) for kv in TYPE_NAMES.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), bare_type(name))


def top_level_parts(text: str) -> list[str]:
    """Comma-separated parts outside brackets; unbalanced brackets are an error."""
    parts, depth = [""], 0
    for c in text:
        depth += (c == "[") - (c == "]")
        if depth < 0:
            raise ValueError(f"unbalanced brackets: {text}")
        if c == "," and not depth:
            parts.append("")
        else:
            parts[-1] += c
    if depth:
        raise ValueError(f"unbalanced brackets: {text}")
    return [p.strip() for p in parts]


def type_schema(name) -> dict:
    """Schema of a source type string; an unknown type is a ValueError."""
    if not isinstance(name, str) or not name.strip():
        raise ValueError(f"unsupported type: {name!r}")
    bare = re.sub(DEFAULT, "", re.sub(OPTIONAL, "", name)).strip()
    if bare in TYPE_NAMES:
        return {"type": TYPE_NAMES[bare]}
    if bare in SPECIAL:
        return dict(SPECIAL[bare])
    generic = re.fullmatch(r"(List|Tuple)\[(.*)\]", bare, re.DOTALL)
    if not generic:
        raise ValueError(f"unsupported type: {name}")
    if generic[1] == "List":
        inner = generic[2].strip()
        return {"type": "array", "items": dict(ITEM_UNIONS[inner]) if inner in ITEM_UNIONS else type_schema(inner)}
    items = [type_schema(p) for p in top_level_parts(generic[2])]
    if any(i != items[0] for i in items):
        raise ValueError(f"unsupported type: {name}")
    return {"type": "array", "items": items[0], "minItems": len(items), "maxItems": len(items)}


@batched("schema string, error string")
def type_schemas(names: pd.Series) -> pd.DataFrame:
    rows = []
    for n in names:
        try:
            rows.append((canon(type_schema(n)), None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["schema", "error"])


def _text(value, what: str) -> str:
    if not isinstance(value, str):
        raise ValueError(f"{what} must be a string")
    return value


def _object(value, what: str) -> dict:
    if not isinstance(value, dict):
        raise ValueError(f"{what} must be an object")
    return value


def flat_parameters(raw) -> dict:
    """{name: {type, description, default}} to an object schema; required is what is neither optional nor has a default."""
    props, need = {}, []
    for name, p in _object(raw, "parameters").items():
        p = _object(p, f"parameters.{name}")
        schema = type_schema(p.get("type"))
        if "description" in p:
            schema["description"] = _text(p["description"], f"parameters.{name}.description")
        if "default" in p:
            schema["default"] = p["default"]
        elif not re.search(OPTIONAL, p["type"]):
            need.append(name)
        props[name] = schema
    return {"type": "object", "properties": props, "required": need}


def flat_tool(tool) -> dict:
    t = _object(tool, "tool")
    return {"name": _text(t.get("name"), "tool.name"), "description": _text(t.get("description"), "tool.description"), "parameters": canon(flat_parameters(t.get("parameters")))}


def wrapped_tool(tool) -> dict:
    """A tool given directly or in a `function` wrapper; its schema is kept as it is."""
    t = _object(tool, "tool")
    if "function" in t:
        if t.get("type") != "function":
            raise ValueError("tool.type must be function")
        t = _object(t["function"], "tool.function")
    d = t.get("description")
    return {"name": _text(t.get("name"), "tool.name"), "description": None if d is None else _text(d, "tool.description"), "parameters": canon(_object(t.get("parameters"), "tool.parameters"))}


def call(raw) -> dict:
    c = _object(raw, "call")
    return {"name": _text(c.get("name"), "call.name"), "arguments": canon(_object(c.get("arguments"), "call.arguments"))}


TOOLS = "array<struct<name string, description string, parameters string>>"
CALLS = "array<struct<name string, arguments string>>"


def _converted(texts: pd.Series, one) -> pd.DataFrame:
    rows = []
    for t in texts:
        ok, value, kind, message = loads(t)
        try:
            if not ok:
                raise ValueError(f"{kind}: {message}")
            if not isinstance(value, list):
                raise ValueError("not an array")
            rows.append(([one(x) for x in value], None))
        except ValueError as e:
            rows.append((None, str(e)))
    return pd.DataFrame(rows, columns=["items", "error"])


@batched(f"items {TOOLS}, error string")
def flat_tools(texts: pd.Series) -> pd.DataFrame:
    return _converted(texts, flat_tool)


@batched(f"items {TOOLS}, error string")
def wrapped_tools(texts: pd.Series) -> pd.DataFrame:
    return _converted(texts, wrapped_tool)


@batched(f"items {CALLS}, error string")
def calls(texts: pd.Series) -> pd.DataFrame:
    return _converted(texts, call)


def _wrap(items: Column) -> Column:
    return F.transform(items, lambda x: F.struct(F.lit("function").alias("type"), x.alias("function")))


def canonical_id(source: str, raw: Column) -> Column:
    return F.concat(F.lit(source + "_"), raw.cast("string"))


def _require_id(raw: DataFrame) -> None:
    """Ids are texts or integers; a boolean or a fraction is an error of the whole input."""
    kind = raw.schema["id"].dataType
    if not isinstance(kind, (T.StringType, T.IntegralType, T.NullType)):
        raise ValueError(f"id must be a text or an integer, not {kind.simpleString()}")


def from_flat(raw: DataFrame, source: str = "xlam") -> DataFrame:
    """(id, query, answers, tools) rows to canonical columns and `error`.

    Rows that cannot be converted keep their id and have the first reason in error and NULL elsewhere.
    """
    _require_id(raw)
    out = raw.withColumn("_t", flat_tools("tools")).withColumn("_c", calls("answers"))
    error = F.coalesce(F.when(F.col("id").isNull(), "id is missing"), F.when(F.col("query").isNull(), "query must be a string"), F.col("_t.error"), F.col("_c.error"))
    good = lambda c: F.when(F.col("error").isNull(), c)
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    nothing = F.lit(None).cast("string")
    return out.withColumn("error", error).select(
        canonical_id(source, F.col("id")).alias("sample_id"),
        F.lit(source).alias("source"),
        good(F.array(message("system", F.lit(UNIFIED_SYSTEM)), message("user", F.col("query")))).alias("messages"),
        good(_wrap(F.col("_t.items"))).alias("tools"),
        good(F.struct(nothing.alias("content"), _wrap(F.col("_c.items")).alias("tool_calls"))).alias("assistant"),
        F.struct(nothing.alias("category"), nothing.alias("subcategory"), nothing.alias("task")).alias("metadata"),
        "error",
    )


def from_conversations(raw: DataFrame, source: str = "hermes") -> DataFrame:
    """(id, category, subcategory, task, tools, conversations, call_items) rows to canonical columns and `error`.

    call_items is a JSON array of the repaired calls of the answer. Exactly one gpt message, at
    least one human message and no other roles than these and system are required. The
    source's system text gives way to the unified one; the answer's text is kept only if it
    has no call.
    """
    _require_id(raw)
    roles = F.transform("conversations", lambda m: m["from"])
    n = lambda r: F.size(F.filter(roles, lambda x: x == r))
    out = raw.withColumn("_t", wrapped_tools("tools")).withColumn("_c", calls(F.coalesce("call_items", F.lit("[]"))))
    error = F.coalesce(
        F.when(F.col("id").isNull(), "id is missing"),
        F.when(F.size(F.array_except(roles, F.array(*map(F.lit, ("system", "human", "gpt"))))) > 0, "unknown role"),
        F.when(n("gpt") != 1, "exactly one gpt message is required"),
        F.when(n("human") < 1, "a human message is required"),
        F.col("_t.error"),
        F.col("_c.error"),
    )
    users = F.transform(F.filter("conversations", lambda m: m["from"] == "human"), lambda m: F.struct(F.lit("user").alias("role"), m["value"].alias("content")))
    system = F.array(F.struct(F.lit("system").alias("role"), F.lit(UNIFIED_SYSTEM).alias("content")))
    answer = F.element_at(F.filter("conversations", lambda m: m["from"] == "gpt"), 1)["value"]
    good = lambda c: F.when(F.col("error").isNull(), c)
    return out.withColumn("error", error).select(
        canonical_id(source, F.col("id")).alias("sample_id"),
        F.lit(source).alias("source"),
        good(F.concat(system, users)).alias("messages"),
        good(_wrap(F.col("_t.items"))).alias("tools"),
        good(F.struct(F.when(F.size("_c.items") == 0, answer).alias("content"), _wrap(F.col("_c.items")).alias("tool_calls"))).alias("assistant"),
        F.struct("category", "subcategory", "task").alias("metadata"),
        "error",
    )


def split_errors(converted: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(canonical rows, error log): a row that fails never stops the others."""
    return converted.filter("error IS NULL").drop("error"), converted.filter("error IS NOT NULL").select("sample_id", "source", "error")
