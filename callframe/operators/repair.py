"""Evidence-gated repairs: nothing is changed that the audit has not found and verified."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, loads
from callframe.functions.schema_check import enum_sites
from callframe.functions.skew import lookup_join
from callframe.functions.staging import stage
from callframe.operators.calls import audit_missing_tools, audit_names, parse_calls, sample_tools, tool_names

#: Names of the repairs.
REPAIRS = ("boundary_literal_escape", "python_literal_syntax", "nested_tool_name", "recovered_tools", "removed_enum")


def move_name(value: dict, verified: str | None) -> dict | None:
    """The call with the nested name at its top, if that name was verified; else NULL."""
    args = value.get("arguments") if isinstance(value, dict) else None
    if "name" in (value or {}) or not isinstance(args, dict) or verified is None or args.get("name") != verified:
        return None
    return {**value, "name": verified, "arguments": {k: v for k, v in args.items() if k != "name"}}


@batched("value string, moved boolean, failure string")
def repaired_call(values: pd.Series, issues: pd.Series, verified: pd.Series) -> pd.DataFrame:
    rows = []
    for text, found, name in zip(values, issues, verified):
        ok, v, _, _ = loads(text)
        found = [] if found is None else [*found]
        if not ok or not isinstance(v, dict):
            rows.append((None, False, "no_object"))
        elif "nested_tool_name" in found:
            moved = move_name(v, name)
            rows.append((canon(moved) if moved else text, moved is not None, None if moved else "nested_name_not_verified"))
        else:
            rows.append((text, False, None))
    return pd.DataFrame(rows, columns=["value", "moved", "failure"])


def repair_calls(audited: DataFrame) -> DataFrame:
    """audited (value, issues, candidate_name, verified, method ...) with `repaired`, `repairs` and `failure`.

    A syntax repair is the diagnosed value itself (one boundary escape taken off, or a Python
    dict read as JSON). A nested name moves up only if a listed tool verifies it.
    """
    fixed = audited.withColumn("_r", repaired_call("value", "issues", F.when(F.col("verified"), F.col("candidate_name"))))
    syntax = F.when(F.array_contains("issues", REPAIRS[0]), REPAIRS[0]).when(F.array_contains("issues", REPAIRS[1]), REPAIRS[1])
    names = F.array_compact(F.array(syntax, F.when(F.col("_r.moved"), REPAIRS[2])))
    return fixed.withColumn("repaired", F.col("_r.value")).withColumn("repairs", names).withColumn("failure", F.col("_r.failure")).drop("_r")


@batched("schema string, removed int")
def without_enums(schemas: pd.Series, paths: pd.Series) -> pd.DataFrame:
    """Schemas without the enums at the given schema paths; only enums that cannot be met are removed."""
    rows = []
    for text, gone in zip(schemas, paths):
        ok, schema, _, _ = loads(text)
        gone, n = set() if gone is None else {*gone}, 0
        for path, _, _, node in [*enum_sites(schema)] if ok else ():
            if path in gone:
                del node["enum"]
                n += 1
        rows.append((canon(schema) if n else text, n))
    return pd.DataFrame(rows, columns=["schema", "removed"])


def repair_schemas(definitions: DataFrame, evidence: DataFrame) -> DataFrame:
    """definitions (tool_name, parameters) with repaired parameters and the number of removed enums.

    evidence (tool_name, schema_path, removable): only removable sites count. Definitions
    without evidence come back as they are.
    """
    allowed = evidence.filter("removable").groupBy("tool_name").agg(F.collect_set("schema_path").alias("paths"))
    done = definitions.join(allowed, "tool_name", "left").withColumn("_r", without_enums("parameters", "paths"))
    return done.withColumn("parameters", F.col("_r.schema")).withColumn("removed", F.col("_r.removed")).drop("_r", "paths")


def restore_tools(samples: DataFrame) -> DataFrame:
    """samples (tools, recovery, expected_names) with empty tools filled from the recovered ones.

    Only if exactly one candidate was recovered and it has all expected names.
    """
    fit = (F.coalesce(F.size("tools"), F.lit(0)) <= 0) & F.col("recovery.tools").isNotNull() & (F.size(F.array_except("expected_names", "recovery.names")) == 0)
    return samples.withColumn("restored_tools", F.when(fit, F.col("recovery.tools")))


def repair_log(repaired: DataFrame, key: str = "sample_id") -> DataFrame:
    """Per sample: status (repaired, repair_failed, unchanged), its repairs with their counts, its failures."""
    one = repaired.select(key, F.explode_outer("repairs").alias("repair"), "failure")
    per = one.groupBy(key, "repair").agg(F.count("repair").alias("n"), F.max("failure").alias("failure"))
    pairs = F.filter(F.collect_list(F.struct("repair", "n")), lambda p: p["repair"].isNotNull())
    log = per.groupBy(key).agg(F.array_sort(pairs).alias("repairs"), F.max("failure").alias("failure"))
    status = F.when(F.col("failure").isNotNull(), "repair_failed").when(F.size("repairs") > 0, "repaired").otherwise("unchanged")
    return log.select(key, status.alias("status"), F.map_from_entries("repairs").alias("repair_counts"), "failure")


def repair_summary(repaired: DataFrame) -> DataFrame:
    """(repair, calls): every kind of repair with its number, zero filled."""
    seen = repaired.select(F.explode("repairs").alias("repair")).groupBy("repair").agg(F.count("*").alias("calls"))
    fixed = repaired.sparkSession.createDataFrame([(r,) for r in REPAIRS], "repair string")
    return fixed.join(seen, "repair", "left").na.fill(0, ["calls"])


def expected_names(parsed: DataFrame) -> DataFrame:
    """(sample_id, expected_names): different names that the calls of a sample use; a sample of any number of calls has few of them."""
    name = F.coalesce(F.col("candidate_name"), F.lit(None).cast("string"))
    return parsed.filter(name.isNotNull() & F.col("sample_id").isNotNull()).groupBy("sample_id").agg(F.array_sort(F.collect_set(name)).alias("expected_names"))


def repair_samples(calls: DataFrame, samples: DataFrame, evidence: DataFrame, key: str = "call_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(repaired calls, repaired tools, log): all five repairs of every sample, each only with its evidence.

    calls (key, sample_id, raw_content); samples (sample_id, tools, system_texts, line_number), of
    which the first delivery counts; evidence of `investigate_enums`, in which two verdicts on one
    site are an error. Syntax and nested names are repaired in the calls; empty tools are
    filled from the system texts if they name all tools that the calls use; enums that cannot
    be met are removed from the tools. The log has a row per sample with its repairs and their
    number; a sample with any failure is `repair_failed`, whatever else was repaired.
    """
    conflicts = evidence.groupBy("tool_name", "schema_path").agg(F.count_distinct("removable").alias("n")).filter("n > 1").limit(5).collect()
    if conflicts:
        raise ValueError(f"conflicting evidence: {[(r[0], r[1]) for r in conflicts]}")
    parsed = stage(parse_calls(calls, key, ("sample_id",)), "parsed")
    known = audit_missing_tools(sample_tools(samples, tools=F.col("tools"), tool_names=tool_names(F.col("tools")), system_texts=F.col("system_texts")))
    named = audit_names(parsed.withColumn("tool_names", F.array().cast("array<string>")))
    ready = restore_tools(lookup_join(known, expected_names(named), "sample_id", "left").withColumn("expected_names", F.coalesce("expected_names", F.array().cast("array<string>"))))
    ready = stage(ready.withColumn("tool_names", F.when(F.col("restored_tools").isNotNull(), F.col("recovery.names")).otherwise(F.col("tool_names"))), "tools")
    done = repair_calls(audit_names(lookup_join(parsed, ready.select("sample_id", "tool_names"), "sample_id", "left")))
    listed = ready.select("sample_id", F.posexplode("tools.function").alias("tool_index", "f")).select("sample_id", "tool_index", F.col("f.name").alias("tool_name"), "f.parameters")
    tools = repair_schemas(listed, evidence)
    rows = [
        done.select("sample_id", "repairs", "failure"),
        ready.filter("restored_tools IS NOT NULL").select("sample_id", F.array(F.lit(REPAIRS[3])).alias("repairs"), F.lit(None).cast("string").alias("failure")),
        tools.filter("removed > 0").select("sample_id", F.array_repeat(F.lit(REPAIRS[4]), F.col("removed")).alias("repairs"), F.lit(None).cast("string").alias("failure")),
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    return done, tools, repair_log(every.filter(F.col("sample_id").isNotNull()))


def repaired_ids(log: DataFrame) -> DataFrame:
    """(sample_id) of the samples whose repairs all went well."""
    return log.filter("status = 'repaired'").select("sample_id")


def require_repaired(log: DataFrame, samples: DataFrame) -> None:
    """Acceptance: every sample is logged at most once and exists; a repaired one has repairs, a failed one a reason."""
    bad = log.groupBy("sample_id").count().filter("count > 1").select("sample_id")
    bad = bad.unionByName(log.join(samples, "sample_id", "left_anti").select("sample_id"))
    bad = bad.unionByName(log.filter("(status = 'repaired' AND cardinality(repair_counts) = 0) OR (status = 'repair_failed') <> (failure IS NOT NULL)").select("sample_id"))
    some = bad.limit(5).collect()
    if some:
        raise ValueError(f"repair log: {[r[0] for r in some]}")


def log_summary(log: DataFrame) -> DataFrame:
    """(repair, repairs, samples): every kind of repair with its number and its samples, zero filled."""
    seen = log.select("sample_id", F.explode("repair_counts").alias("repair", "n")).groupBy("repair").agg(F.sum("n").alias("repairs"), F.count("*").alias("samples"))
    fixed = log.sparkSession.createDataFrame([(r,) for r in REPAIRS], "repair string")
    return fixed.join(seen, "repair", "left").na.fill(0, ["repairs", "samples"])
