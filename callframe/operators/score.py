"""Scores of parsed predictions against canonical answers, and their aggregates.

Calls are compared as multisets inside the row (a row has few calls), so scoring is narrow:
no call is exploded or shuffled. Only the aggregates shuffle, after map-side combining.
"""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, loads
from callframe.functions.schema_check import violations, well_formed

#: Error labels in their order.
ERRORS = ("wrong_mode", "format_error", "wrong_tool", "missing_tool", "extra_tool", "argument_mismatch", "schema_invalid")
KINDS = ("single", "multi", "text")
MODES = ("tool", "text", "mixed", "invalid")


@batched(T.ArrayType(T.StringType()))
def canon_all(texts: pd.Series) -> pd.Series:
    """Canonical form of each JSON text of an array; what is no JSON is NULL."""

    def one(t):
        ok, v, _, _ = loads(t)
        return canon(v) if ok else None

    return pd.Series([None if a is None else [one(t) for t in a] for a in texts])


def gold_calls(assistant: str = "assistant") -> Column:
    """array<struct<name, arguments>> of a canonical answer, arguments in canonical form."""
    raw = F.col(f"{assistant}.tool_calls.function")
    names, args = F.col(f"{assistant}.tool_calls.function.name"), canon_all(F.col(f"{assistant}.tool_calls.function.arguments"))
    both = F.transform(F.arrays_zip(names.alias("name"), args.alias("arguments")), lambda c: F.struct(c["name"].alias("name"), c["arguments"].alias("arguments")))
    return F.when(raw.isNull(), F.array().cast("array<struct<name:string,arguments:string>>")).otherwise(both)


def _checker():
    seen: dict[str, object] = {}

    def schema_of(text: str | None):
        if text not in seen:
            if len(seen) > 20_000:
                seen.clear()
            ok, v, _, _ = loads(text)
            seen[text] = v if ok and well_formed(v) else None
        return seen[text]

    return schema_of


@batched("boolean")
def calls_valid(tools: pd.Series, calls: pd.Series) -> pd.Series:
    """Every call names exactly one tool and meets its schema; a bad definition anywhere, or no call, is false.

    tools and calls are JSON arrays of [name, parameters] and [name, arguments].
    """
    schema_of, out = _checker(), []
    for t, c in zip(tools, calls):
        t, c = json.loads(t or "[]"), json.loads(c or "[]")
        schemas = [(n, schema_of(p)) for n, p in t]
        good = bool(c) and all(isinstance(n, str) and n and s is not None for n, s in schemas)
        for name, args in c if good else ():
            mine = [s for n, s in schemas if n == name]
            ok, v, _, _ = loads(args)
            if len(mine) != 1 or not ok or next(violations(v, mine[0]), None) is not None:
                good = False
                break
        out.append(good)
    return pd.Series(out)


def _pairs(items: Column, field: str) -> Column:
    """JSON array of [name, text]."""
    return F.to_json(F.transform(items, lambda x: F.array(x["name"], x[field])))


def overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two string arrays."""
    times = lambda xs, k: F.size(F.filter(xs, lambda x: x.eqNullSafe(k)))
    return F.aggregate(F.array_distinct(a), F.lit(0), lambda n, k: n + F.least(times(a, k), times(b, k)))


def score(df: DataFrame, tools: str = "tools") -> DataFrame:
    """df (gold, tools, and the columns of parse_predictions) with the score columns.

    gold is array<struct<name, arguments>>. Null rules: argument_exact is NULL if no name
    matches, no_tool_correct is NULL for tool answers.
    """
    g, p = F.col("gold"), F.col("calls")
    names = lambda c: F.transform(c, lambda x: x["name"])
    keys = lambda c: F.transform(c, lambda x: F.concat(x["name"], F.lit("\x00"), F.coalesce(x["arguments"], F.lit(""))))
    out = df.withColumn("_gn", names(g)).withColumn("_pn", names(p)).withColumn("_gk", keys(g)).withColumn("_pk", keys(p))
    out = out.withColumn("gold_call_count", F.size(g)).withColumn("predicted_call_count", F.size(p))
    out = out.withColumn("tool_name_tp", overlap(F.col("_gn"), F.col("_pn"))).withColumn("argument_exact_matches", overlap(F.col("_gk"), F.col("_pk")))
    out = out.withColumn("gold_mode", F.when(F.col("gold_call_count") > 0, "tool").otherwise("text"))
    out = out.withColumn("predicted_mode", F.when(F.col("mode").isin("tool", "mixed"), "tool").otherwise(F.col("mode")))
    out = out.withColumn("call_kind", F.when(F.col("gold_call_count") == 0, "text").when(F.col("gold_call_count") == 1, "single").otherwise("multi"))
    defs = F.transform(F.coalesce(F.col(tools), F.array()), lambda t: F.struct(t["function"]["name"].alias("name"), t["function"]["parameters"].alias("text")))
    valid = calls_valid(_pairs(defs, "text"), _pairs(p, "arguments"))
    out = out.withColumn("schema_valid", (F.col("mode") != "invalid") & valid)
    tool = F.col("gold_mode") == "tool"
    full = F.col("argument_exact_matches")
    out = out.withColumn("format_valid", F.col("strict_format_valid"))
    out = out.withColumn("response_mode_correct", F.col("gold_mode") == F.col("predicted_mode"))
    same = lambda n: (F.col("gold_call_count") == n) & (F.col("predicted_call_count") == n)
    out = out.withColumn("tool_name_exact", same(F.col("tool_name_tp")))
    out = out.withColumn("argument_exact", F.when(F.col("tool_name_tp") > 0, full == F.col("tool_name_tp")))
    out = out.withColumn("full_call_exact", tool & F.col("format_valid") & same(full))
    out = out.withColumn("no_tool_correct", F.when(~tool, F.col("predicted_mode") == "text"))
    flags = (
        ~F.col("response_mode_correct"),
        tool & ~F.col("format_valid"),
        F.size(F.array_except("_pn", "_gn")) > 0,
        F.col("tool_name_tp") < F.col("gold_call_count"),
        F.col("tool_name_tp") < F.col("predicted_call_count"),
        full < F.col("tool_name_tp"),
        tool & ~F.col("schema_valid"),
    )
    labels = F.array_compact(F.array(*[F.when(f, name) for f, name in zip(flags, ERRORS)]))
    return out.withColumn("errors", labels).drop("_gn", "_pn", "_gk", "_pk")


def rate(numerator: Column, denominator: Column) -> Column:
    """numerator / denominator, NULL over 0."""
    return F.try_divide(numerator.cast("double"), denominator.cast("double"))


def summarize(scored: DataFrame, *by: str) -> DataFrame:
    """One row of metrics, or one per group, from one aggregation over flat score columns.

    Denominators: tool rows for the call metrics, text rows for no-tool accuracy, all rows
    for mode accuracy, name-matched calls for arguments. F1 is NULL without gold calls and 0
    without predicted ones.
    """
    tool, text = F.col("gold_mode") == "tool", F.col("gold_mode") == "text"
    n_if = lambda c: F.count_if(c)
    total = lambda c: F.coalesce(F.sum(F.when(tool, F.col(c))), F.lit(0))
    agg = scored.groupBy(*by).agg(
        F.count("*").alias("rows"),
        n_if(tool).alias("tool_rows"),
        n_if(text).alias("text_rows"),
        n_if(tool & F.col("full_call_exact")).alias("full_exact"),
        n_if(text & F.coalesce("no_tool_correct", F.lit(False))).alias("no_tool"),
        n_if("response_mode_correct").alias("mode_ok"),
        n_if(tool & F.col("format_valid")).alias("format_ok"),
        n_if(tool & F.col("tool_name_exact")).alias("name_exact"),
        n_if(tool & F.col("schema_valid")).alias("schema_ok"),
        total("tool_name_tp").alias("tp"),
        total("predicted_call_count").alias("predicted"),
        total("gold_call_count").alias("expected"),
        total("argument_exact_matches").alias("argument_ok"),
    )
    c = F.col
    precision = F.when(c("expected") > 0, F.coalesce(rate(c("tp"), c("predicted")), F.lit(0.0)))
    recall = rate(c("tp"), c("expected"))
    f1 = F.when(c("expected") > 0, F.coalesce(F.try_divide(2 * precision * recall, precision + recall), F.lit(0.0)))
    return agg.select(
        *by,
        "rows",
        "tool_rows",
        "text_rows",
        rate(c("full_exact"), c("tool_rows")).alias("full_call_success_rate"),
        rate(c("no_tool"), c("text_rows")).alias("no_tool_accuracy"),
        rate(c("mode_ok"), c("rows")).alias("response_mode_accuracy"),
        rate(c("format_ok"), c("tool_rows")).alias("tool_format_valid_rate"),
        rate(c("name_exact"), c("tool_rows")).alias("tool_name_exact_match"),
        precision.alias("tool_name_precision"),
        recall.alias("tool_name_recall"),
        f1.alias("tool_name_f1"),
        rate(c("argument_ok"), c("tp")).alias("argument_exact_match"),
        rate(c("schema_ok"), c("tool_rows")).alias("schema_valid_rate"),
    )


def histogram(df: DataFrame, column: str, labels: tuple[str, ...]) -> DataFrame:
    """(label, ord, n) with a row for every label, in the fixed order, zero filled; other labels follow by name.

    column may be an array, whose elements count one each.
    """
    spark = df.sparkSession
    one = F.explode(column) if df.schema[column].dataType.typeName() == "array" else F.col(column)
    seen = df.select(one.alias("label")).filter(F.col("label").isNotNull()).groupBy("label").agg(F.count("*").alias("n"))
    fixed = spark.createDataFrame([(x, i) for i, x in enumerate(labels)], "label string, ord int")
    return fixed.join(seen, "label", "full").select("label", F.coalesce("ord", F.lit(len(labels))).alias("ord"), F.coalesce("n", F.lit(0)).alias("n"))
