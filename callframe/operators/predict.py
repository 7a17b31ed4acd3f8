"""Strict parse of model predictions into text, tool, mixed or invalid. Nothing is repaired."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, loads
from callframe.functions.text import SPACES

#: Tag of the prediction side: white space inside the tags does not belong to the body.
TAG = r"(?sU)<tool_call>\s*(.*?)\s*</tool_call>"
#: Tag of the data side: the body is taken as it stands.
DATA_TAG = r"(?s)<tool_call>(.*?)</tool_call>"
MARKER = r"</?tool_call"

CALL = T.StructType([T.StructField("name", T.StringType()), T.StructField("arguments", T.StringType()), T.StructField("error", T.StringType())])


def body_call(body: str) -> tuple[str | None, str | None, str | None]:
    """(name, canonical arguments, error code) of one body; exactly the fields name and arguments are allowed."""
    ok, value, _, _ = loads(body, constants=False)
    if not ok:
        return None, None, "invalid_json"
    if not isinstance(value, dict):
        return None, None, "body_not_object"
    if value.keys() != {"name", "arguments"}:
        return None, None, "invalid_fields"
    if not isinstance(value["name"], str) or not value["name"]:
        return None, None, "invalid_name"
    if not isinstance(value["arguments"], dict):
        return None, None, "arguments_not_object"
    return value["name"], canon(value["arguments"]), None


@batched(T.ArrayType(CALL))
def body_calls(bodies: pd.Series) -> pd.Series:
    keys = ("name", "arguments", "error")
    return pd.Series([None if b is None else [dict(zip(keys, body_call(x))) for x in b] for b in bodies])


def parse_predictions(df: DataFrame, raw: str = "raw_prediction") -> DataFrame:
    """df with mode, calls array<struct<name, arguments>>, strict_format_valid and parse_errors.

    NULL and blank predictions are invalid (`empty_prediction`). A bad body makes the
    prediction invalid, but its good calls are kept. Order of errors: by body, then tags.
    """
    text = F.coalesce(F.col(raw), F.lit(""))
    bodies = F.regexp_extract_all(text, F.lit(TAG), F.lit(1))
    outside = F.regexp_replace(text, TAG, "")
    blank = lambda c: ~c.rlike(f"[^{SPACES[1:-2]}]")
    parsed = df.withColumn("_bodies", bodies).withColumn("_outside", outside).withColumn("_calls", body_calls("_bodies"))
    bad = F.filter(
        F.transform("_calls", lambda c, i: F.when(c["error"].isNotNull(), F.concat(F.lit("call_"), i.cast("string"), F.lit(":"), c["error"]))),
        lambda e: e.isNotNull(),
    )
    any_tag, broken = F.size("_bodies") > 0, F.col("_outside").rlike(MARKER)
    errors = (
        F.when(blank(text), F.array(F.lit("empty_prediction")))
        .when((F.size(bad) > 0) | broken, F.concat(bad, F.when(broken, F.array(F.lit("malformed_tool_call_tags"))).otherwise(F.array().cast("array<string>"))))
        .when(any_tag & ~blank(F.col("_outside")), F.array(F.lit("prose_outside_tool_calls")))
        .otherwise(F.array().cast("array<string>"))
    )
    mode = (
        F.when(blank(text) | (F.size(bad) > 0) | broken, "invalid")
        .when(~any_tag, "text")
        .when(~blank(F.col("_outside")), "mixed")
        .otherwise("tool")
    )
    calls = F.transform(F.filter("_calls", lambda c: c["error"].isNull()), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
    out = parsed.withColumn("mode", mode).withColumn("calls", calls).withColumn("parse_errors", errors)
    return out.withColumn("strict_format_valid", F.col("mode") == "tool").drop("_bodies", "_outside", "_calls")


def tag_bodies(text: Column, pattern: str = DATA_TAG) -> Column:
    """Bodies of all tags in order; NULL text has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(1))
