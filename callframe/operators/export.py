"""Canonical samples to training rows, chat requests and benchmark records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Role names of the training format and of chat requests.
TRAINING_ROLES = {"user": "human", "assistant": "gpt"}
REQUEST_ROLES = {"tool": "observation"}


def _role(role: Column, names: dict[str, str]) -> Column:
    pairs = [F.lit(x) for kv in names.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), role), role)


def calls_text(calls: Column) -> Column:
    """One call as a JSON object, several as an array, compact; the arguments stand as they are."""
    name = lambda c: F.regexp_extract(F.to_json(F.struct(c["function"]["name"].alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    one = lambda c: F.concat(F.lit('{"name":'), name(c), F.lit(',"arguments":'), c["function"]["arguments"], F.lit("}"))
    all_ = F.transform(calls, one)
    return F.when(F.size(all_) == 1, all_[0]).when(F.size(all_) > 1, F.concat(F.lit("["), F.array_join(all_, ","), F.lit("]")))


def tools_text(tools: Column) -> Column:
    """Tools as a JSON array of {name, description, parameters}; NULL descriptions and parameters are null."""
    q = lambda c: F.coalesce(F.regexp_extract(F.to_json(F.struct(c.alias("x")), {"ignoreNullFields": "false"}), r'(?s)^\{"x":(.*)\}$', 1), F.lit("null"))
    f = lambda t: t["function"]
    one = lambda t: F.concat(F.lit('{"name":'), q(f(t)["name"]), F.lit(',"description":'), q(f(t)["description"]), F.lit(',"parameters":'), F.coalesce(f(t)["parameters"], F.lit("null")), F.lit("}"))
    return F.concat(F.lit("["), F.array_join(F.transform(tools, one), ","), F.lit("]"))


def to_training(samples: DataFrame) -> DataFrame:
    """(line_number, sample_id, conversations, system, tools, error): one row per sample, in no other order than line_number.

    Exactly one system message is required, and either content or calls. Rows that fail have
    the reason in error and NULL elsewhere.
    """
    system = F.filter("messages", lambda m: m["role"] == "system")
    n_calls = F.coalesce(F.size("assistant.tool_calls"), F.lit(0))
    has_text = F.col("assistant.content").isNotNull()
    error = F.when(F.size(system) != 1, "exactly one system message is required").when(has_text & (n_calls > 0), "content and calls together").when(~has_text & (n_calls <= 0), "empty answer")
    turns = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.struct(_role(m["role"], TRAINING_ROLES).alias("from"), m["content"].alias("value")))
    answer = F.when(has_text, F.struct(F.lit("gpt").alias("from"), F.col("assistant.content").alias("value"))).otherwise(F.struct(F.lit("function_call").alias("from"), calls_text(F.col("assistant.tool_calls")).alias("value")))
    good = lambda c: F.when(error.isNull(), c)
    return samples.select("line_number", "sample_id", good(F.concat(turns, F.array(answer))).alias("conversations"), good(system[0]["content"]).alias("system"), good(tools_text(F.col("tools"))).alias("tools"), error.alias("error"))


def to_request(samples: DataFrame) -> DataFrame:
    """(sample_id, system, messages, tools): the request a model gets, without the answer."""
    system = F.filter("messages", lambda m: m["role"] == "system")
    turns = F.transform(F.filter("messages", lambda m: m["role"] != "system"), lambda m: F.struct(_role(m["role"], REQUEST_ROLES).alias("role"), m["content"].alias("content")))
    return samples.select("sample_id", F.try_element_at(system, F.lit(1))["content"].alias("system"), turns.alias("messages"), tools_text(F.col("tools")).alias("tools"))


def benchmark_request(entries: DataFrame) -> DataFrame:
    """(id, system, messages, error) of (id, question array<array<message>>): one turn, one leading system message at most, a user message last."""
    turn = F.try_element_at("question", F.lit(1))
    lead = F.try_element_at(turn, F.lit(1))["role"] == "system"
    rest = F.filter(turn, lambda m, i: ~((i == 0) & (m["role"] == "system")))
    error = (
        F.when(F.coalesce(F.size("question"), F.lit(0)) != 1, "single-turn entries only")
        .when(F.exists(rest, lambda m: m["role"] == "system"), "one leading system message at most")
        .when(F.coalesce(F.try_element_at(rest, F.lit(-1))["role"] != "user", F.lit(True)), "must end with a user message")
    )
    turns = F.transform(rest, lambda m: F.struct(_role(m["role"], REQUEST_ROLES).alias("role"), m["content"].alias("content")))
    good = lambda c: F.when(error.isNull(), c)
    return entries.select("id", good(F.when(lead, turn[0]["content"])).alias("system"), good(turns).alias("messages"), error.alias("error"))


def benchmark_results(queue: DataFrame, predictions: DataFrame, partial: bool = False) -> DataFrame:
    """(ordinal, id, result, input_token_count, output_token_count, latency) in the order of the queue (ordinal, id).

    Unknown or repeated prediction ids are an error; missing ones are unless partial. The optional
    numbers must be of a numeric type; a boolean is none.
    """
    for c in ("prompt_tokens", "response_tokens", "latency"):
        if c in predictions.columns and not isinstance(predictions.schema[c].dataType, T.NumericType):
            raise ValueError(f"{c} must be a number, not {predictions.schema[c].dataType.simpleString()}")
    unknown = predictions.join(queue, "id", "left_anti").select("id")
    twice = predictions.groupBy("id").count().filter("count > 1").select("id")
    bad = unknown.unionByName(twice).limit(5).collect()
    if bad:
        raise ValueError(f"unknown or repeated ids: {[r[0] for r in bad]}")
    if not partial and not queue.join(predictions, "id", "left_anti").isEmpty():
        raise ValueError("predictions are missing")
    p = predictions.select("id", F.col("raw_prediction").alias("result"), *[F.col(c).alias(n) for c, n in (("prompt_tokens", "input_token_count"), ("response_tokens", "output_token_count"), ("latency", "latency")) if c in predictions.columns])
    return queue.select("id", "ordinal").join(p, "id").select("ordinal", *p.columns).orderBy("ordinal")


def preference_pairs(rejected: DataFrame, training: DataFrame) -> DataFrame:
    """(sample_id, conversations, chosen, rejected, system, tools): the answer of the training row against a rejected one.

    rejected (sample_id, rejected_text, rejected_role); rows without a training row, or whose texts agree, give no pair.
    """
    t = training.filter("error IS NULL").withColumn("chosen", F.element_at("conversations", -1)).withColumn("conversations", F.expr("slice(conversations, 1, size(conversations) - 1)"))
    bad = F.struct(F.col("rejected_role").alias("from"), F.col("rejected_text").alias("value"))
    return rejected.join(t, "sample_id").filter(F.col("chosen.value") != F.col("rejected_text")).select("sample_id", "conversations", "chosen", bad.alias("rejected"), "system", "tools")
