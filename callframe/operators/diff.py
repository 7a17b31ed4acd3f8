"""Which argument differs: pairing of calls and structural differences of their arguments.

Calls pair inside the row: identical calls are taken off one against one, then a name left
exactly once on both sides pairs. Only the paired arguments are exploded to nodes, and the
nodes of the two sides meet by path in one aggregation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from callframe.functions.jsonx import json_nodes

#: Diagnostics in their order, and the states of an analysis.
DIAGNOSTICS = (
    "missing_argument",
    "extra_argument",
    "type_mismatch",
    "wrong_value",
    "nested_structure_mismatch",
    "ambiguous_call_pairing",
    "partial_argument_analysis",
)
STATES = ("analyzable", "partially_analyzable", "ambiguous_or_confounded")


def _numbered(calls: Column) -> Column:
    """calls with their index, key, and the ordinal among identical calls."""
    k = F.transform(calls, lambda c, i: F.struct(i.alias("i"), c["name"].alias("name"), c["arguments"].alias("arguments"), F.concat(c["name"], F.lit("\x00"), F.coalesce(c["arguments"], F.lit(""))).alias("key")))
    return F.transform(k, lambda c: c.withField("n", F.size(F.filter(k, lambda d: (d["key"] == c["key"]) & (d["i"] < c["i"])))))


def pair_calls(rows: DataFrame, gold: str = "gold", predicted: str = "calls") -> DataFrame:
    """rows with left_gold, left_pred (what identical calls leave over), pairs, ambiguous names and analysis_status."""
    out = rows.withColumn("_g", _numbered(F.col(gold))).withColumn("_p", _numbered(F.col(predicted)))
    rest = lambda a, b: F.filter(a, lambda c: ~F.exists(F.col(b), lambda d: (d["key"] == c["key"]) & (d["n"] == c["n"])))
    out = out.withColumn("left_gold", rest(F.col("_g"), "_p")).withColumn("left_pred", rest(F.col("_p"), "_g"))
    out = out.withColumn("exact_pairs", F.size("_g") - F.size("left_gold"))
    names = lambda c: F.transform(F.col(c), lambda x: x["name"])
    times = lambda c, n: F.size(F.filter(names(c), lambda x: x == n))
    every = F.array_sort(F.array_union(names("left_gold"), names("left_pred")))
    once = F.filter(every, lambda n: (times("left_gold", n) == 1) & (times("left_pred", n) == 1))
    pick = lambda c, n: F.element_at(F.filter(F.col(c), lambda x: x["name"] == n), 1)
    out = out.withColumn("pairs", F.transform(once, lambda n: F.struct(pick("left_gold", n).alias("gold"), pick("left_pred", n).alias("pred"))))
    both = F.filter(every, lambda n: (times("left_gold", n) > 0) & (times("left_pred", n) > 0))
    out = out.withColumn("ambiguous_names", F.array_except(both, once))
    alone = F.exists(every, lambda n: (times("left_gold", n) == 0) | (times("left_pred", n) == 0))
    out = out.withColumn("unmatched", alone)
    state = (
        F.when(F.size("ambiguous_names") > 0, STATES[2])
        .when(F.col("unmatched"), F.when(F.size("pairs") > 0, STATES[1]).otherwise(STATES[2]))
        .otherwise(STATES[0])
    )
    return out.withColumn("analysis_status", state).drop("_g", "_p")


def argument_diffs(paired: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, tool, gold_call_index, pred_call_index, path, type, gold_present, pred_present, gold, pred): one row per difference.

    A member is compared where its parent is an object on both sides. Arrays are compared as a
    whole; 1 and 1.0 differ in type; 0.0 and -0.0 do not differ.
    """
    one = paired.select(key, F.explode("pairs").alias("p")).select(
        key,
        F.col("p.gold.name").alias("tool"),
        F.col("p.gold.i").alias("gold_call_index"),
        F.col("p.pred.i").alias("pred_call_index"),
        F.col("p.gold.arguments").alias("g"),
        F.col("p.pred.arguments").alias("q"),
    )
    nodes = one.withColumn("gn", json_nodes("g")).withColumn("qn", json_nodes("q"))
    objects = lambda c: F.transform(F.filter(c, lambda x: x["kind"] == "object"), lambda x: x["path"])
    shared = F.array_intersect(objects(F.col("gn")), objects(F.col("qn")))
    both = nodes.withColumn("shared", shared)
    side = lambda c, s: F.transform(F.filter(F.col(c), lambda x: x["parent"].isNull() | F.array_contains("shared", x["parent"])), lambda x: F.struct(F.lit(s).alias("side"), x["path"].alias("path"), x["kind"].alias("kind"), x["canon"].alias("canon")))
    ids = [key, "tool", "gold_call_index", "pred_call_index"]
    flat = both.select(*ids, F.explode(F.concat(side("gn", "g"), side("qn", "q"))).alias("n")).select(*ids, "n.*")
    of = lambda s, c: F.max(F.when(F.col("side") == s, F.col(c)))
    met = flat.groupBy(*ids, "path").agg(of("g", "kind").alias("gk"), of("g", "canon").alias("gold"), of("q", "kind").alias("qk"), of("q", "canon").alias("pred"))
    zero = lambda c: F.when(F.col(c) == "-0.0", "0.0").otherwise(F.col(c))
    differs = zero("gold") != zero("pred")
    kind = (
        F.when(F.col("qk").isNull(), "missing_argument")
        .when(F.col("gk").isNull(), "extra_argument")
        .when(F.col("gk") != F.col("qk"), "type_mismatch")
        .when((F.col("gk") == "array") & differs, "nested_structure_mismatch")
        .when((F.col("gk") != "object") & differs, "wrong_value")
    )
    return met.withColumn("type", kind).filter("type IS NOT NULL").select(*ids, "path", "type", F.col("gk").isNotNull().alias("gold_present"), F.col("qk").isNotNull().alias("pred_present"), "gold", "pred", F.col("gk").alias("gold_kind"))


def diagnose(paired: DataFrame, key: str = "sample_id", diffs: DataFrame | None = None) -> DataFrame:
    """(key, analysis_status, diagnostics): the distinct diagnostics of each row in their fixed order; diffs are its argument_diffs where they are at hand."""
    types = (argument_diffs(paired, key) if diffs is None else diffs).groupBy(key).agg(F.collect_set("type").alias("types"))  # at most five per row
    none = F.array().cast("array<string>")
    out = paired.select(key, "analysis_status", "ambiguous_names", "unmatched").join(types, key, "left")
    has = F.concat(
        F.coalesce("types", none),
        F.when(F.size("ambiguous_names") > 0, F.array(F.lit(DIAGNOSTICS[5]))).otherwise(none),
        F.when(F.col("unmatched"), F.array(F.lit(DIAGNOSTICS[6]))).otherwise(none),
    )
    fixed = F.array(*map(F.lit, DIAGNOSTICS))
    return out.select(key, "analysis_status", F.array_intersect(fixed, has).alias("diagnostics"))


def summarize(diagnosed: DataFrame, diffs: DataFrame, key: str = "sample_id") -> DataFrame:
    """(label, ord, samples, occurrences): samples per diagnostic, and differences of that type, zero filled."""
    spark = diagnosed.sparkSession
    fixed = spark.createDataFrame([(x, i) for i, x in enumerate(DIAGNOSTICS)], "label string, ord int")
    samples = diagnosed.select(F.explode("diagnostics").alias("label")).groupBy("label").agg(F.count("*").alias("samples"))
    occurs = diffs.groupBy(F.col("type").alias("label")).agg(F.count("*").alias("occurrences"))
    return fixed.join(samples, "label", "left").join(occurs, "label", "left").na.fill(0, ["samples", "occurrences"])


def value_types(diffs: DataFrame, key: str = "sample_id") -> DataFrame:
    """(value_type, samples, diffs) of wrong values: distinct samples and differences per type of the expected value."""
    kind = F.when(F.col("gold_kind").isin("integer", "number"), "number").otherwise(F.col("gold_kind"))
    return diffs.filter("type = 'wrong_value'").groupBy(kind.alias("value_type")).agg(F.count_distinct(key).alias("samples"), F.count("*").alias("diffs"))


def cooccurrence(diagnosed: DataFrame) -> DataFrame:
    """(left, right, samples): rows that have two diagnostics together, each pair once, in their fixed order."""
    n = F.size("diagnostics")
    pairs = F.flatten(F.transform("diagnostics", lambda a, i: F.transform(F.slice("diagnostics", i + 2, F.greatest(n - i - 1, F.lit(0))), lambda b: F.struct(a.alias("left"), b.alias("right")))))
    return diagnosed.select(F.explode(pairs).alias("p")).groupBy("p.left", "p.right").agg(F.count("*").alias("samples"))
