"""Profiles: descriptive statistics, histograms, problem categories, bounded error samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from callframe.functions.jsonx import json_nodes
from callframe.functions.skew import lookup_join


def describe(rows: DataFrame, value: Column, *by: str) -> DataFrame:
    """count, min, mean (3 places), median, p90 by nearest rank, max; NULL values are left out, an empty input gives count 0 and NULLs."""
    v = rows.withColumn("_v", value).filter(F.col("_v").isNotNull())
    return v.groupBy(*by).agg(
        F.count("_v").alias("count"),
        F.min("_v").alias("min"),
        F.round(F.avg("_v"), 3).alias("mean"),
        F.percentile("_v", F.lit(0.5)).alias("median"),
        F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY _v)").alias("p90"),
        F.max("_v").alias("max"),
    )


def role_sequences(samples: DataFrame) -> DataFrame:
    """(roles, samples): sequences of message roles joined by ' -> '."""
    roles = F.array_join(F.transform("messages", lambda m: m["role"]), " -> ")
    return samples.groupBy(roles.alias("roles")).agg(F.count("*").alias("samples"))


def counters(samples: DataFrame, **flags: Column) -> DataFrame:
    """(counter, n): many flags counted in one pass."""
    agg = samples.agg(*[F.count_if(c).alias(k) for k, c in flags.items()])
    return agg.select(F.explode(F.array(*[F.struct(F.lit(k).alias("counter"), F.col(k).alias("n")) for k in flags])).alias("r")).select("r.*")


def call_counters(samples: DataFrame) -> DataFrame:
    """(counter, n): the counters of a data set of tool calls, all in one pass.

    Rows, answers, tools and calls per row, calls of unlisted tools, repeated names, missing
    parts of tools, parameters, messages and metadata, and requests by their first and last role.
    """
    n_calls, n_tools = F.coalesce(F.size("assistant.tool_calls"), F.lit(0)), F.coalesce(F.size("tools"), F.lit(0))
    called, listed = F.coalesce("assistant.tool_calls.function.name", F.array().cast("array<string>")), F.coalesce("tools.function.name", F.array().cast("array<string>"))
    roles, texts = F.coalesce("messages.role", F.array().cast("array<string>")), F.coalesce("messages.content", F.array().cast("array<string>"))
    some = lambda a, f: F.size(F.filter(a, f)) > 0
    role = lambda r: F.size(F.filter(roles, lambda x: x == r))
    flags = {
        "rows": F.lit(True),
        "null_source": F.col("source").isNull(),
        "null_id": F.col("sample_id").isNull(),
        "no_messages": F.size(roles) <= 0,
        "no_system": role("system") == 0,
        "one_system": role("system") == 1,
        "several_systems": role("system") > 1,
        "no_user": role("user") == 0,
        "one_user": role("user") == 1,
        "several_users": role("user") > 1,
        "has_assistant_turn": role("assistant") > 0,
        "unknown_role": some(roles, lambda x: ~x.isin("system", "user", "assistant")),
        "null_content": some(texts, lambda x: x.isNull()),
        "empty_content": some(texts, lambda x: x == ""),
        "starts_with_system": F.try_element_at(roles, F.lit(1)) == "system",
        "ends_with_user": F.try_element_at(roles, F.lit(-1)) == "user",
        "no_tools": n_tools == 0,
        "one_tool": n_tools == 1,
        "several_tools": n_tools > 1,
        "repeated_tool": F.size(F.array_distinct(listed)) < n_tools,
        "null_description": some(F.col("tools"), lambda t: t["function"]["description"].isNull()),
        "null_parameters": some(F.col("tools"), lambda t: t["function"]["parameters"].isNull()),
        "empty_parameters": some(F.col("tools"), lambda t: t["function"]["parameters"] == "{}"),
        "text_answer": n_calls == 0,
        "null_answer": F.col("assistant.content").isNull() & (n_calls == 0),
        "text_and_calls": F.col("assistant.content").isNotNull() & (n_calls > 0),
        "single_call": n_calls == 1,
        "several_calls": n_calls > 1,
        "same_tool_twice": F.size(F.array_distinct(called)) < n_calls,
        "unlisted_call": F.size(F.array_except(called, listed)) > 0,
        "calls_without_tools": (n_calls > 0) & (n_tools == 0),
        "unused_tools": F.size(F.array_except(listed, called)) > 0,
        "empty_arguments": some(F.col("assistant.tool_calls"), lambda c: c["function"]["arguments"] == "{}"),
        "null_arguments": some(F.col("assistant.tool_calls"), lambda c: c["function"]["arguments"].isNull()),
        "null_metadata": F.col("metadata").isNull(),
        "null_category": F.col("metadata.category").isNull(),
    }
    return counters(samples, **flags)


def problems(samples: DataFrame, key: str, **categories: Column) -> DataFrame:
    """(key, category, occurrences): one row per sample and category that occurs; each category is an integer column."""
    pairs = F.array(*[F.struct(F.lit(k).alias("category"), F.coalesce(c.cast("bigint"), F.lit(0)).alias("occurrences")) for k, c in categories.items()])
    return samples.select(key, F.explode(F.filter(pairs, lambda p: p["occurrences"] > 0)).alias("p")).select(key, "p.*")


def problem_summary(found: DataFrame, key: str) -> DataFrame:
    """(category, samples, occurrences): a sample counts once per category, its occurrences are summed."""
    return found.groupBy("category").agg(F.count_distinct(key).alias("samples"), F.sum("occurrences").alias("occurrences"))


def error_sample(errors: DataFrame, order: str, most: int = 200) -> DataFrame:
    """The first `most` errors in input order, a top-k."""
    return errors.orderBy(order).limit(most)


def repeated_later(rows: DataFrame, by: str, order: str) -> DataFrame:
    """Rows whose value occurred before, in the order of a unique column; NULL values are never repeats.

    The first occurrence of each value is found with map-side combining; rows of a frequent
    value meet it in a salted join, not in one window.
    """
    first = rows.filter(F.col(by).isNotNull()).groupBy(by).agg(F.min(order).alias("_first"))
    return lookup_join(rows, first, by).filter(F.col(order) > F.col("_first")).drop("_first")


def value_kinds(rows: DataFrame, column: str) -> DataFrame:
    """(path, kind, n): kinds of JSON values at each path reached through objects; text that does not parse is left out."""
    return rows.select(F.explode(json_nodes(column)).alias("n")).groupBy("n.path", "n.kind").agg(F.count("*").alias("n"))


def decision_cube(rows: DataFrame, decision: str, labels: tuple[str, ...], *by: str) -> DataFrame:
    """Number of rows and of each decision for every combination of the columns in `by` (CUBE), zero filled."""
    return rows.cube(*by).agg(F.count("*").alias("rows"), *[F.count_if(F.col(decision) == x).alias(x) for x in labels])


def retention(rows: DataFrame, passed: Column, *by: str) -> DataFrame:
    """(by..., before, after, dropped, rate) overall and per prefix of `by` (ROLLUP)."""
    n = rows.rollup(*by).agg(F.count("*").alias("before"), F.count_if(F.coalesce(passed, F.lit(False))).alias("after"))
    return n.withColumn("dropped", F.col("before") - F.col("after")).withColumn("rate", F.try_divide(F.col("after").cast("double"), F.col("before").cast("double")))


def funnel(rows: DataFrame, **stages: Column) -> DataFrame:
    """(stage, ord, n): rows that reach each stage, every stage on top of the ones before, in one pass."""
    so_far, counts = F.lit(True), []
    for name, c in stages.items():
        so_far = so_far & F.coalesce(c, F.lit(False))
        counts.append(F.count_if(so_far).alias(name))
    agg = rows.agg(*counts)
    pairs = F.array(*[F.struct(F.lit(k).alias("stage"), F.lit(i).alias("ord"), F.col(k).alias("n")) for i, k in enumerate(stages)])
    return agg.select(F.explode(pairs).alias("s")).select("s.*")


def compare_yields(first: DataFrame, second: DataFrame, hit: Column) -> DataFrame:
    """One row: yields of two strategies and the uplift of the second over the first; NULL over nothing."""
    side = lambda d, p: d.agg(F.count("*").alias(f"{p}_rows"), F.count_if(F.coalesce(hit, F.lit(False))).alias(f"{p}_hits"))
    both = side(first, "first").crossJoin(side(second, "second"))  # one row each
    rate = lambda p: F.try_divide(F.col(f"{p}_hits").cast("double"), F.col(f"{p}_rows").cast("double"))
    return both.withColumn("first_yield", rate("first")).withColumn("second_yield", rate("second")).withColumn("uplift", F.try_divide(F.col("second_yield"), F.col("first_yield")))


def threshold_band(value: Column, *bands: tuple[int, str]) -> Column:
    """Name of the first band whose bound the value reaches; bands run from high to low, the last has no bound."""
    out = F.lit(bands[-1][1])
    for bound, name in reversed(bands[:-1]):
        out = F.when(value >= bound, name).otherwise(out)
    return out


def semantic_distribution(annotated: DataFrame, bucket: str, buckets: tuple[str, ...], *by: str) -> DataFrame:
    """(by..., bucket, n, share): annotated rows per bucket with a row for every bucket of every group, zero filled; rows without a bucket are left out."""
    rows = annotated.filter(F.col(bucket).isNotNull())
    flags = [F.count_if(F.col(bucket) == b).alias(f"b{i}") for i, b in enumerate(buckets)]
    total = rows.groupBy(*by).agg(F.count("*").alias("_n"), *flags)
    pairs = F.array(*[F.struct(F.lit(b).alias("bucket"), F.col(f"b{i}").alias("n")) for i, b in enumerate(buckets)])
    one = total.select(*by, "_n", F.explode(pairs).alias("p"))
    return one.select(*by, "p.bucket", "p.n", F.try_divide(F.col("p.n").cast("double"), F.col("_n").cast("double")).alias("share"))


def union_in_order(**sources: DataFrame) -> DataFrame:
    """Union of candidate sets with their `source` name and its place in the order given; columns meet by name, missing ones are NULL."""
    out = None
    for i, (name, d) in enumerate(sources.items()):
        d = d.withColumns({"candidate_source": F.lit(name), "source_order": F.lit(i)})
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out
