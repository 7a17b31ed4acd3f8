"""Queries of the data side: extraction, audit, repair, normalising, validation, splits, samples, profiles, exports."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callframe.functions.skew import lookup_join
from callframe.functions.staging import put, shared_dir, stage
from callframe.functions.text import group_key, user_text
from callframe.operators import align, calls, export, legacy, normalize, predict, profile, repair, sampling, split, validate
from callframe.plans.evaluation import predictions
from callframe.sources import files
from callframe.sources.tables import table
from callframe.streaming import resume


def _samples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "canonical_samples")


def _conversations(spark: SparkSession, d: str) -> DataFrame:
    """Samples as raw conversations: user turns, and the answer's tags in two gpt turns."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    users = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: turn("human", m["content"]))
    raw = F.col("raw_prediction")
    return predictions(spark, d).select("line_number", "sample_id", F.concat(users, F.array(turn("gpt", raw), turn("tool", F.lit("ok")), turn("gpt", F.concat(F.lit("again "), raw)))).alias("conversations"))


def tag_calls(spark: SparkSession, d: str) -> DataFrame:
    return calls.extract_calls(_conversations(spark, d), key="line_number").withColumnRenamed("sample_id", "line_number")


def audit_calls(spark: SparkSession, d: str) -> DataFrame:
    """Layers 1 to 5 of every parsed call: the issues by name."""
    audited = calls.audit_all(table(spark, d, "tool_call_parses"), _samples(spark, d))
    return audited.select("call_id", "candidate_name", "name_source", "verified", F.array_join(F.array_sort("issues"), ",").alias("issues"))


def _canonical_calls(spark: SparkSession, d: str) -> DataFrame:
    one = _samples(spark, d).select("line_number", calls.tool_names(F.col("tools")).alias("tool_names"), calls.tools_json(F.col("tools")).alias("tools_json"), F.posexplode("assistant.tool_calls").alias("call", "c"))
    value = F.concat(F.lit('{"name":"'), F.col("c.function.name"), F.lit('","arguments":'), F.col("c.function.arguments"), F.lit("}"))
    return one.withColumn("value", value)


def name_audit(spark: SparkSession, d: str) -> DataFrame:
    """Layer 3 of the canonical calls."""
    a = calls.audit_names(_canonical_calls(spark, d))
    return a.select("line_number", "call", "candidate_name", "name_source", "verified", F.array_join("name_issues", ",").alias("issue"))


def argument_audit(spark: SparkSession, d: str) -> DataFrame:
    """Layer 5 of the canonical calls: one row per issue."""
    a = _canonical_calls(spark, d).withColumn("a", calls.audited_arguments("value", "tools_json", F.lit(None).cast("string")))
    return a.select("line_number", "call", F.explode("a.issue_details").alias("i")).select("line_number", "call", "i.issue", "i.argument_path", "i.expected_type", "i.actual_type")


def recovered_tools(spark: SparkSession, d: str) -> DataFrame:
    """Layer 4: the tools of each sample written into a system text and recovered from it."""
    text = F.concat(F.lit("You are a function caller. <tools>"), calls.tools_json(F.col("tools")), F.lit("</tools>"))
    s = _samples(spark, d).filter(F.size("tools") > 0).select("line_number", F.array(text).alias("system_texts"))
    r = calls.audit_missing_tools(s)
    return r.select("line_number", F.array_join("recovery.names", ",").alias("names"), F.size("recovery_issues").alias("issues"))


def _planted(spark: SparkSession, d: str) -> DataFrame:
    """Samples with faults planted by rule: integer properties of every third line can only be null; every fifth lists its tools in the system text alone."""
    s = _samples(spark, d)
    broken = lambda t: t["function"].withField("parameters", F.regexp_replace(t["function"]["parameters"], r'"type": ?"integer"', '"type":"integer","enum":[null]'))
    tools = F.when(F.col("line_number") % 3 == 0, F.transform("tools", lambda t: t.withField("function", broken(t)))).otherwise(F.col("tools"))
    moved = (F.col("line_number") % 5 == 0) & (F.size("tools") > 0)
    texts = F.when(moved, F.array(F.concat(F.lit("<tools>"), calls.tools_json(F.col("tools")), F.lit("</tools>")))).otherwise(F.array().cast("array<string>"))
    return s.withColumns({"system_texts": texts, "tools": F.when(moved, F.array().cast(s.schema["tools"].dataType)).otherwise(tools)})


def _enum_evidence(spark: SparkSession, d: str) -> DataFrame:
    s = _planted(spark, d)
    defs = s.select(F.explode("tools.function").alias("f")).select(F.col("f.name").alias("tool_name"), "f.parameters").filter("parameters IS NOT NULL")
    made = s.select(F.explode("assistant.tool_calls.function").alias("f")).select(F.col("f.name").alias("tool_name"), "f.arguments")
    return calls.investigate_enums(defs, made)


def enum_investigation(spark: SparkSession, d: str) -> DataFrame:
    """Layer 6 on planted definitions: enums that no value can meet, with what the calls show at their place."""
    return _enum_evidence(spark, d)


def _sample_repairs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return repair.repair_samples(table(spark, d, "tool_call_parses"), _planted(spark, d), stage(_enum_evidence(spark, d), "evidence"))


def sample_repairs(spark: SparkSession, d: str) -> DataFrame:
    """Repair log of every sample that has calls or repaired tools, on planted faults."""
    log = _sample_repairs(spark, d)[2]
    count = lambda r: F.coalesce(F.try_element_at("repair_counts", F.lit(r)), F.lit(0)).alias(r)
    return log.select("sample_id", "status", "failure", *map(count, repair.REPAIRS))


def sample_repair_summary(spark: SparkSession, d: str) -> DataFrame:
    return repair.log_summary(_sample_repairs(spark, d)[2])


def _repaired(spark: SparkSession, d: str) -> DataFrame:
    parses = table(spark, d, "tool_call_parses")
    tools = calls.sample_tools(_samples(spark, d), tool_names=calls.tool_names(F.col("tools")))
    named = calls.audit_names(lookup_join(calls.parse_calls(parses, "call_id", ("sample_id",)), tools, "sample_id", "left", counted=parses))
    return repair.repair_calls(named)


def repaired_calls(spark: SparkSession, d: str) -> DataFrame:
    """Repairs of every parsed call that its audit allows, and the name and number of arguments of the repaired call."""
    name, args = F.get_json_object("repaired", "$.name"), F.when(~F.array_contains("issues", "invalid_arguments_type"), F.size(F.json_object_keys(F.get_json_object("repaired", "$.arguments"))))
    return _repaired(spark, d).select("call_id", F.array_join("repairs", ",").alias("repairs"), "failure", name.alias("name"), args.alias("arguments"))


def repair_summary(spark: SparkSession, d: str) -> DataFrame:
    return repair.repair_summary(_repaired(spark, d))


def normalized_flat(spark: SparkSession, d: str) -> DataFrame:
    """Samples written in the flat source format and normalised again."""
    answers = F.concat(F.lit("["), F.array_join(F.transform("assistant.tool_calls", lambda c: F.concat(F.lit('{"name":"'), c["function"]["name"], F.lit('","arguments":'), c["function"]["arguments"], F.lit("}"))), ","), F.lit("]"))
    kind = F.element_at(F.array(*map(F.lit, ("int, optional", "List[int]", "str", "Foo"))), (F.pmod("line_number", F.lit(4)) + 1).cast("int"))
    tools = F.concat(F.lit('[{"name":"t","description":"d","parameters":{"x":{"type":"'), kind, F.lit('","description":"n"}}}]'))
    raw = _samples(spark, d).select(F.col("line_number").alias("id"), user_text("messages").alias("query"), answers.alias("answers"), tools.alias("tools"))
    n = normalize.from_flat(raw)
    return n.select("sample_id", F.size("messages").alias("messages"), F.col("tools")[0]["function"]["parameters"].alias("parameters"), F.size("assistant.tool_calls").alias("calls"), F.col("error").isNotNull().alias("failed"))


def _array_file(spark: SparkSession, rows: DataFrame) -> str:
    """Path of a file with one JSON array of the rows, which are few."""
    path = f"{shared_dir(spark)}/array-{uuid.uuid4().hex}.json"
    texts = [r[0] for r in rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).collect()]
    put(spark, path, ("[" + ",\n".join(texts) + "]").encode())
    return path


def _loaded(spark: SparkSession, rows: DataFrame, schema: str) -> DataFrame:
    return files.read_json_array(spark, _array_file(spark, rows)).select(F.from_json("value", schema).alias("r")).select("r.*")


def loaded_flat(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items (240, fixed) as a file of the flat source: read as an array, parsed and normalised; every seventh has broken answers."""
    answers = F.when(F.col("item_id") % 7 == 0, "[{").otherwise('[{"name":"f","arguments":{"n":1}}]')
    tools = F.lit('[{"name":"f","description":"d","parameters":{"n":{"type":"int","description":"n"}}}]')
    rows = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.col("text").alias("query"), answers.alias("answers"), tools.alias("tools"))
    n = normalize.from_flat(_loaded(spark, rows, "id bigint, query string, answers string, tools string"))
    return n.select("sample_id", F.try_element_at("messages", F.lit(2))["content"].alias("query"), F.size("assistant.tool_calls").alias("calls"), F.col("error").isNotNull().alias("failed"))


def loaded_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items (240, fixed) as a file of conversations: read as an array, their calls extracted, parsed and normalised; every seventh call is broken."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    body = F.when(F.col("item_id") % 7 == 0, "{bad").otherwise('{"name":"f","arguments":{"n":1}}')
    tag = F.concat(F.lit("<tool_call>"), body, F.lit("</tool_call>"))
    tools = F.lit('[{"type":"function","function":{"name":"f","description":"d","parameters":{"type":"object","properties":{}}}}]')
    rows = table(spark, d, "eval_items").select(F.col("item_id").cast("string").alias("id"), tools.alias("tools"), F.array(turn("human", F.coalesce("text", F.lit(""))), turn("gpt", tag)).alias("conversations"))
    raw = stage(_loaded(spark, rows, "id string, tools string, conversations array<struct<`from` string, value string>>"), "raw")
    nothing = F.lit(None).cast("string")
    made = calls.extract_calls(raw, key="id").withColumn("call_id", F.col("sample_id").cast("bigint"))
    parsed = calls.parse_calls(made, "call_id", ("sample_id",)).filter("ok").groupBy("sample_id").agg(F.concat(F.lit("["), F.array_join(F.collect_list("value"), ","), F.lit("]")).alias("call_items"))
    joined = raw.join(parsed.withColumnRenamed("sample_id", "id"), "id", "left").withColumns({"category": nothing, "subcategory": nothing, "task": nothing})
    n = normalize.from_conversations(joined)
    return n.select("sample_id", F.size("assistant.tool_calls").alias("calls"), F.col("assistant.content").isNotNull().alias("text_left"), F.col("error").isNotNull().alias("failed"))


def normalized_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Samples written as raw conversations and normalised again; every sixth has a second answer, which is an error."""
    turn = lambda who, text: F.struct(F.lit(who).alias("from"), text.alias("value"))
    users = F.transform(F.filter("messages", lambda m: m["role"] == "user"), lambda m: turn("human", m["content"]))
    answer = F.array(turn("gpt", F.coalesce("assistant.content", F.lit(""))))
    twice = F.when(F.col("line_number") % 6 == 0, answer).otherwise(F.array().cast("array<struct<`from`:string,value:string>>"))
    items = F.concat(F.lit("["), F.array_join(F.transform("assistant.tool_calls", lambda c: F.concat(F.lit('{"name":"'), c["function"]["name"], F.lit('","arguments":'), c["function"]["arguments"], F.lit("}"))), ","), F.lit("]"))
    nothing = F.lit(None).cast("string")
    tool = F.lit('[{"type":"function","function":{"name":"t","description":"d","parameters":{"type":"object","properties":{}}}}]')
    raw = _samples(spark, d).select(F.col("line_number").alias("id"), nothing.alias("category"), nothing.alias("subcategory"), nothing.alias("task"), tool.alias("tools"), F.concat(users, answer, twice).alias("conversations"), items.alias("call_items"))
    n = normalize.from_conversations(raw)
    return n.select("sample_id", F.size("messages").alias("messages"), F.size("tools").alias("tools"), F.size("assistant.tool_calls").alias("calls"), "assistant.content", F.col("error").isNotNull().alias("failed"))


def benchmark_records(spark: SparkSession, d: str) -> DataFrame:
    """Result records of the evaluation items, with the length of the text as the number of prompt tokens."""
    items = table(spark, d, "eval_items")
    queue = items.select(F.col("item_id").alias("ordinal"), F.col("entry_id").alias("id")).groupBy("id").agg(F.min("ordinal").alias("ordinal"))
    made = items.groupBy(F.col("entry_id").alias("id")).agg(F.min("text").alias("raw_prediction")).withColumn("prompt_tokens", F.length("raw_prediction"))
    return export.benchmark_results(queue, made)


def written_lines(spark: SparkSession, d: str) -> DataFrame:
    """Splits written as JSON lines and read again: lines, errors and the highest line number, by split."""
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    files.write_lines(table(spark, d, "sample_splits").select("sample_id", "split", "source"), path)
    lines = files.read_lines(spark, path, blank="reject")
    return lines.groupBy(F.get_json_object("canon", "$.split").alias("split")).agg(F.count("*").alias("lines"), F.count("error").alias("errors"), F.count_distinct(F.get_json_object("canon", "$.sample_id")).alias("samples"))


def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """Calls whose sample was loaded in the same batch, by the key of both."""
    keys = _samples(spark, d).select("batch_no", "sample_id", "source").groupBy("batch_no", "sample_id").agg(F.min("source").alias("source"))
    rows = table(spark, d, "tool_call_parses").select("call_id", "batch_no", "sample_id")
    return rows.join(keys, ["batch_no", "sample_id"]).select("call_id", "batch_no", "source")


TYPES = ("str", "string", "int", "integer", "float", "number", "bool", "boolean", "list", "List", "array", "dict", "Dict", "object", "int, optional", "str, default 'x'", "Foo")


def type_grammar(spark: SparkSession, d: str) -> DataFrame:
    """Plain source types, for every region, as JSON Schema types."""
    r = table(spark, d, "region").select("r_regionkey", F.explode(F.array(*map(F.lit, TYPES))).alias("source_type"))
    return r.withColumn("schema_type", normalize.scalar_type(F.col("source_type")))


def _validated(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate(validate.canonical_lines(_samples(spark, d)))


def validation_status(spark: SparkSession, d: str) -> DataFrame:
    """Contract status of every sample row."""
    return _validated(spark, d).select("line_number", "status", F.array_join(F.array_sort("issues"), ",").alias("issues"), "first")


def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.summarize(_validated(spark, d))


def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    """How many sample rows break each plain rule."""
    roles = F.transform("messages", lambda m: m["role"])
    return validate.violations_of(
        _samples(spark, d),
        has_source=F.col("source").isNotNull(),
        has_messages=F.size("messages") > 0,
        one_system=F.size(F.filter(roles, lambda r: r == "system")) == 1,
        has_tools=F.size("tools") > 0,
        tool_names_differ=F.size(F.array_distinct("tools.function.name")) == F.size("tools"),
        answer=F.col("assistant.content").isNotNull() | (F.size("assistant.tool_calls") > 0),
        metadata=F.col("metadata").isNotNull(),
    )


def first_deliveries(spark: SparkSession, d: str) -> DataFrame:
    return split.first_delivery(_samples(spark, d)).select("line_number", "sample_id")


def repeated_requests(spark: SparkSession, d: str) -> DataFrame:
    """Sample rows whose request occurred before."""
    rows = _samples(spark, d).select("line_number", group_key(user_text("messages")).alias("group_key"))
    return profile.repeated_later(rows, "group_key", "line_number").select("line_number")


def request_group_keys(spark: SparkSession, d: str) -> DataFrame:
    return _samples(spark, d).select("line_number", group_key(user_text("messages")).alias("group_key"))


def tool_frequency(spark: SparkSession, d: str) -> DataFrame:
    return split.tool_frequency(_samples(spark, d))


def hash_split(spark: SparkSession, d: str) -> DataFrame:
    """Split of every sample row by held-out tools and the hash of its request."""
    return split.split_by_tools(_samples(spark, d), table(spark, d, "heldout_tools")).select("line_number", "split")


def held_out_tools(spark: SparkSession, d: str) -> DataFrame:
    """Tools that the seeded greedy rule holds out."""
    held, _ = split.select_unseen(split.keyed(split.first_delivery(_samples(spark, d))))
    return spark.createDataFrame([(t,) for t in held], "tool_name string")


def seeded_split(spark: SparkSession, d: str) -> DataFrame:
    """Seeded 90/5/5 split per source, groups being the equal requests of one source."""
    rows = split.keyed(_samples(spark, d)).withColumn("source", F.coalesce("source", F.substring_index("sample_id", "_", 1)))
    rows = rows.withColumn("group_key", F.sha2(F.concat_ws("|", "source", "group_key"), 256)).select("line_number", "source", "group_key")
    return split.seeded_split(stage(rows, "keyed")).select("line_number", "split")


def split_overlaps(spark: SparkSession, d: str) -> DataFrame:
    return split.split_overlaps(table(spark, d, "sample_splits"), "sample_id")


def request_overlaps(spark: SparkSession, d: str) -> DataFrame:
    """Requests that two splits share."""
    keys = _samples(spark, d).select("sample_id", group_key(user_text("messages")).alias("group_key")).distinct()
    return split.split_overlaps(table(spark, d, "sample_splits").join(keys, "sample_id"), "group_key")


def leaked_tools(spark: SparkSession, d: str) -> DataFrame:
    assigned = table(spark, d, "sample_splits").select("sample_id", "split").join(_samples(spark, d).select("sample_id", "tools"), "sample_id")
    return split.leaked_tools(assigned, table(spark, d, "heldout_tools"))


def cross_source_groups(spark: SparkSession, d: str) -> DataFrame:
    return split.cross_source_groups(split.keyed(_samples(spark, d)))


def source_distribution(spark: SparkSession, d: str) -> DataFrame:
    return split.source_distribution(table(spark, d, "sample_splits"))


def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 documents drawn by seeded hash."""
    return sampling.hash_sample(table(spark, d, "documents"), "doc_id", 100, 42).select("doc_id")


def exact_sample(spark: SparkSession, d: str) -> DataFrame:
    """100 sample lines drawn by Python's seeded generator."""
    s = _samples(spark, d)
    lines = spark.createDataFrame([(i + 1,) for i in sampling.exact_lines(s.count(), 100, 42)], "line_number bigint")
    return s.join(F.broadcast(lines), "line_number").select("line_number", "sample_id")  # 100 rows


def stratified_sample(spark: SparkSession, d: str) -> DataFrame:
    """60 documents over the languages, least filled share first."""
    return sampling.stratified_sample(table(spark, d, "documents"), "lang", "doc_id", 60, 42).select("doc_id", "lang")


def top_tools(spark: SparkSession, d: str) -> DataFrame:
    one = _samples(spark, d).select(F.explode("assistant.tool_calls.function.name").alias("tool"))
    return sampling.top_labels(one, "tool", 3)


def common_categories(spark: SparkSession, d: str) -> DataFrame:
    rows = _samples(spark, d).select("line_number", F.col("metadata.category").alias("category"))
    return sampling.most_common(rows, "category", "line_number", 10)


def shortest_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The two shortest documents of each source, ties by id."""
    rows = table(spark, d, "documents").filter("text IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", F.length("text").alias("n"))
    return sampling.top_per_group(rows, ["source"], ["n", "doc_id"], 2)


def review_queue(spark: SparkSession, d: str) -> DataFrame:
    """Audit details in review order: by priority of the issue, then by id."""
    order = ("invalid_tool_schema", "argument_type_mismatch", "enum_mismatch")
    rows = table(spark, d, "tool_call_audits").select("audit_id", F.posexplode("argument_schema_validation.issue_details").alias("n", "x")).select("audit_id", "n", F.col("x.issue").alias("issue"))
    return sampling.by_priority(rows, "issue", order, "audit_id").select("audit_id", "n", "issue", "priority")


def pending_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples without any split."""
    return align.pending(_samples(spark, d).select("sample_id").distinct(), table(spark, d, "sample_splits"), "sample_id")


def assigned_samples(spark: SparkSession, d: str) -> DataFrame:
    """Sample rows whose id was assigned to train."""
    train = table(spark, d, "sample_splits").filter("split = 'train'")
    return _samples(spark, d).join(train, "sample_id", "left_semi").select("line_number")


def annotation_coverage(spark: SparkSession, d: str) -> DataFrame:
    return align.coverage(_samples(spark, d).select("sample_id").distinct(), table(spark, d, "sample_splits").select("sample_id"), "sample_id")


def run_key_faults(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are not exactly once on both sides."""
    return align.key_faults(_samples(spark, d), table(spark, d, "sample_splits"))


def ordinal_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Lines of two exports zipped by number that differ: every fifth answer of the second was changed."""
    left = export.to_training(_samples(spark, d)).select("line_number", F.element_at("conversations", -1)["value"].alias("value"))
    right = left.withColumn("value", F.when(F.col("line_number") % 5 == 0, F.concat("value", F.lit(" "))).otherwise(F.col("value")))
    return align.ordinal_faults(left, right, "line_number", "value").select("line_number")


def manifest_digests(spark: SparkSession, d: str) -> DataFrame:
    """Tree digest of the distinct ids of each split."""
    ids = table(spark, d, "sample_splits").select("split", "sample_id").distinct()
    return files.tree_digest(ids, "sample_id", "split")


def selection_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the held-out tools' names in order."""
    return files.sequence_digest(table(spark, d, "heldout_tools").select("split_seed", "tool_name"), "tool_name", "tool_name", "split_seed")


def training_export(spark: SparkSession, d: str) -> DataFrame:
    t = export.to_training(_samples(spark, d))
    last = F.element_at("conversations", -1)
    return t.select("line_number", F.size("conversations").alias("turns"), last["from"].alias("role"), last["value"].alias("answer"), "system", F.col("error").isNotNull().alias("failed"))


def chat_requests(spark: SparkSession, d: str) -> DataFrame:
    r = export.to_request(_samples(spark, d).withColumn("sample_id", F.col("line_number").cast("string")))
    return r.select("sample_id", F.size("messages").alias("turns"), F.element_at("messages", -1)["role"].alias("last_role"), "system")


def benchmark_requests(spark: SparkSession, d: str) -> DataFrame:
    """Evaluation items as benchmark entries; every third has a system message, every seventh ends with the assistant."""
    m = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    none = F.array().cast("array<struct<role:string,content:string>>")
    turn = F.concat(
        F.when(F.col("item_id") % 3 == 0, F.array(m("system", F.lit("s")))).otherwise(none),
        F.array(m("user", F.col("text"))),
        F.when(F.col("item_id") % 7 == 0, F.array(m("assistant", F.lit("a")))).otherwise(none),
    )
    entries = table(spark, d, "eval_items").select(F.col("item_id").alias("id"), F.array(turn).alias("question"))
    return export.benchmark_request(entries).select("id", "system", F.size("messages").alias("turns"), "error")


def preference_pairs(spark: SparkSession, d: str) -> DataFrame:
    """The canonical answer against each written prediction that differs from it."""
    p = predictions(spark, d).filter("assistant.content IS NULL").select(F.col("line_number").cast("string").alias("sample_id"), F.col("raw_prediction").alias("rejected_text"), F.lit("gpt").alias("rejected_role"))
    t = export.to_training(_samples(spark, d)).withColumn("sample_id", F.col("line_number").cast("string")).drop("line_number")
    return export.preference_pairs(p, t).select("sample_id", F.size("conversations").alias("turns"), "chosen.value", F.col("rejected.value").alias("rejected"))


def role_sequences(spark: SparkSession, d: str) -> DataFrame:
    return profile.role_sequences(_samples(spark, d))


def length_profile(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of document texts by source."""
    return profile.describe(table(spark, d, "documents"), F.length("text"), "source")


def sample_counters(spark: SparkSession, d: str) -> DataFrame:
    """The counters of the sample rows, all in one pass."""
    return profile.call_counters(_samples(spark, d))


def audit_semantics(spark: SparkSession, d: str) -> DataFrame:
    """Issue details of the recorded audits per bucket and tool source, zero filled."""
    x = table(spark, d, "tool_call_audits").select(F.col("argument_schema_validation.tool_definition_source").alias("defined"), F.explode("argument_schema_validation.issue_details.issue").alias("bucket"))
    return profile.semantic_distribution(x, "bucket", ("argument_type_mismatch", "enum_mismatch", "missing_required_argument", "unexpected_argument", "invalid_tool_schema"), "defined")


def candidate_union(spark: SparkSession, d: str) -> DataFrame:
    """Ids that are candidates for review, from three sources in a fixed order."""
    s = _samples(spark, d)
    parts = {
        "unlisted": s.filter(F.size(F.array_except("assistant.tool_calls.function.name", "tools.function.name")) > 0),
        "no_tools": s.filter(F.size("tools") == 0),
        "no_source": s.filter("source IS NULL"),
    }
    return profile.union_in_order(**{k: v.select("line_number") for k, v in parts.items()})


def _problems(spark: SparkSession, d: str) -> DataFrame:
    listed, called = F.col("tools.function.name"), F.col("assistant.tool_calls.function.name")
    return profile.problems(
        _samples(spark, d),
        "sample_id",
        unlisted_call=F.size(F.filter(called, lambda n: ~F.array_contains(listed, n))),
        repeated_tool=F.size("tools") - F.size(F.array_distinct(listed)),
        missing_description=F.size(F.filter("tools", lambda t: t["function"]["description"].isNull())),
        missing_parameters=F.size(F.filter("tools", lambda t: t["function"]["parameters"].isNull())),
    )


def problem_summary(spark: SparkSession, d: str) -> DataFrame:
    return profile.problem_summary(_problems(spark, d), "sample_id")


def error_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first 200 recorded parse errors."""
    bad = table(spark, d, "tool_call_parses").filter("parse_success = false").select("call_id", "error_type")
    return profile.error_sample(bad, "call_id")


def _resumed(spark: SparkSession, d: str, partition: str | None) -> DataFrame:
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    # A stream reads folders: the pattern matches the one file or the files below a folder.
    path = source if os.path.isdir(source) else f"{d}/event[s].parquet"
    for _ in range(2):
        resume.stream_once(spark, path, schema, f"{base}/out", f"{base}/state", "event_id", partition)
    return spark.read.parquet(f"{base}/out").groupBy("event_type").agg(F.count("*").alias("events"), F.count_distinct("event_id").alias("ids"))


def resumed_stream(spark: SparkSession, d: str) -> DataFrame:
    """events appended by two runs of a resumable stream, the second of which finds nothing to do."""
    return _resumed(spark, d, None)


def resumed_by_category(spark: SparkSession, d: str) -> DataFrame:
    """The same with a folder for each type of event."""
    return _resumed(spark, d, "event_type")


def generated(spark: SparkSession, d: str) -> DataFrame:
    """Answers of a stand-in for a model to every evaluation item; it fails on every tenth, which keeps its row."""

    def backend():
        def answer(row: dict) -> str:
            if row["item_id"] % 10 == 0:
                raise RuntimeError("refused")
            return f"{row['item_id']}:{len(row['text'])}"

        return answer

    items = table(spark, d, "eval_items").select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    return resume.generate(items, backend, ["item_id", "text"]).select("item_id", "raw_prediction", "error")


def json_arguments(spark: SparkSession, d: str) -> DataFrame:
    """Strict parse of events.props: kind and number of members."""
    from callframe.functions.jsonx import json_strict

    p = table(spark, d, "events").select(json_strict("props").alias("p"))
    return p.groupBy(F.col("p.ok").alias("ok"), F.col("p.kind").alias("kind"), F.size(F.json_object_keys("p.canon")).alias("members")).agg(F.count("*").alias("events"))


def data_tags(spark: SparkSession, d: str) -> DataFrame:
    """Tag bodies per sample by the three tag rules."""
    p = predictions(spark, d)
    count = lambda pattern: F.size(predict.tag_bodies(F.col("raw_prediction"), pattern))
    chars = lambda pattern: F.aggregate(predict.tag_bodies(F.col("raw_prediction"), pattern), F.lit(0), lambda a, b: a + F.length(b))
    return p.select("line_number", count(predict.DATA_TAG).alias("bodies"), chars(predict.DATA_TAG).alias("data_chars"), chars(predict.TAG).alias("trimmed_chars"))


def legacy_modes(spark: SparkSession, d: str) -> DataFrame:
    """How the older profiler reads each body, and the state of its call."""
    bodies = table(spark, d, "tool_call_parses").select("call_id", "sample_id", legacy.lenient_call("raw_content").alias("c"))
    tools = calls.sample_tools(_samples(spark, d), tool_names=calls.tool_names(F.col("tools")))
    known = lookup_join(bodies, tools, "sample_id", "left", counted=table(spark, d, "tool_call_parses"))
    state = legacy.structure(F.col("c.value"), F.col("tool_names"))
    return known.groupBy(F.col("c.mode").alias("mode"), state.alias("structure")).agg(F.count("*").alias("calls"))


def value_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of the argument values at each path."""
    args = _samples(spark, d).select(F.explode("assistant.tool_calls.function.arguments").alias("args"))
    return profile.value_kinds(args, "args")


def size_breakdown(spark: SparkSession, d: str) -> DataFrame:
    """Short, middle and long documents for every combination of source and language."""
    size = F.when(F.col("n_chars") < 300, "short").when(F.col("n_chars") < 1500, "middle").otherwise("long")
    rows = table(spark, d, "documents").select("source", "lang", size.alias("size"))
    return profile.decision_cube(rows, "size", ("short", "middle", "long"), "source", "lang")


def parse_retention(spark: SparkSession, d: str) -> DataFrame:
    """Recorded parse outcomes kept per load batch."""
    return profile.retention(table(spark, d, "tool_call_parses"), F.col("parse_success"), "batch_no")


def document_funnel(spark: SparkSession, d: str) -> DataFrame:
    return profile.funnel(
        table(spark, d, "documents"),
        all=F.lit(True),
        has_text=F.length("text") > 0,
        has_lang=F.col("lang").isNotNull(),
        has_source=F.col("source").isNotNull(),
        long_enough=F.length("text") >= 500,
    )


def yield_comparison(spark: SparkSession, d: str) -> DataFrame:
    """English documents among those of even and of odd ids."""
    docs = table(spark, d, "documents")
    return profile.compare_yields(docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1"), F.col("lang") == "en")


def supplier_bands(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("n"))
    return n.select("l_suppkey", profile.threshold_band(F.col("n"), (620, "high"), (580, "middle"), (0, "low")).alias("band"))


QUERIES = {
    f.__name__: f
    for f in (
        tag_calls,
        data_tags,
        audit_calls,
        name_audit,
        argument_audit,
        recovered_tools,
        enum_investigation,
        sample_repairs,
        sample_repair_summary,
        repaired_calls,
        repair_summary,
        normalized_flat,
        loaded_flat,
        loaded_conversations,
        normalized_conversations,
        benchmark_records,
        written_lines,
        batch_lookup,
        type_grammar,
        validation_status,
        validation_summary,
        contract_violations,
        first_deliveries,
        repeated_requests,
        request_group_keys,
        tool_frequency,
        hash_split,
        held_out_tools,
        seeded_split,
        split_overlaps,
        request_overlaps,
        leaked_tools,
        cross_source_groups,
        source_distribution,
        hash_sample,
        exact_sample,
        stratified_sample,
        top_tools,
        common_categories,
        shortest_per_source,
        review_queue,
        pending_samples,
        assigned_samples,
        annotation_coverage,
        run_key_faults,
        ordinal_alignment,
        manifest_digests,
        selection_digest,
        training_export,
        chat_requests,
        benchmark_requests,
        preference_pairs,
        role_sequences,
        length_profile,
        sample_counters,
        audit_semantics,
        candidate_union,
        problem_summary,
        error_sample,
        resumed_stream,
        resumed_by_category,
        generated,
        json_arguments,
        legacy_modes,
        value_kinds,
        size_breakdown,
        parse_retention,
        document_funnel,
        yield_comparison,
        supplier_bands,
    )
}

_USER = "array_to_string(list_transform(list_filter(messages, lambda m: m.role = 'user'), lambda m: m.content), chr(10))"
_SPACE = r"[\x{9}-\x{D}\x{1C}-\x{20}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_KEY = f"sha256(trim(regexp_replace(lower({_USER}), '{_SPACE}', ' ', 'g')))"
_HELD = "list_has_any(list_transform(tools, lambda t: t.function.name), (SELECT list(tool_name) FROM heldout_tools))"
_CALLS = """CASE WHEN len(assistant.tool_calls) = 1 THEN list_transform(assistant.tool_calls, lambda c: '{"name":"' || c.function.name || '","arguments":' || c.function.arguments || '}')[1]
  ELSE '[' || array_to_string(list_transform(assistant.tool_calls, lambda c: '{"name":"' || c.function.name || '","arguments":' || c.function.arguments || '}'), ',') || ']' END"""
_NSYS = "len(list_filter(messages, lambda m: m.role = 'system'))"
_FAILED = f"({_NSYS} <> 1 OR (assistant.content IS NOT NULL AND coalesce(len(assistant.tool_calls), 0) > 0) OR (assistant.content IS NULL AND coalesce(len(assistant.tool_calls), 0) = 0))"


_HAS = "len(list_filter({0}, lambda x: {1})) > 0"
_ROLE = "len(list_filter(r, lambda x: x = '{0}'))"
_COUNTERS = [
    ("rows", "true"),
    ("null_source", "source IS NULL"),
    ("null_id", "sample_id IS NULL"),
    ("no_messages", "len(r) = 0"),
    ("no_system", _ROLE.format("system") + " = 0"),
    ("one_system", _ROLE.format("system") + " = 1"),
    ("several_systems", _ROLE.format("system") + " > 1"),
    ("no_user", _ROLE.format("user") + " = 0"),
    ("one_user", _ROLE.format("user") + " = 1"),
    ("several_users", _ROLE.format("user") + " > 1"),
    ("has_assistant_turn", _ROLE.format("assistant") + " > 0"),
    ("unknown_role", _HAS.format("r", "x NOT IN ('system', 'user', 'assistant')")),
    ("null_content", _HAS.format("tx", "x IS NULL")),
    ("empty_content", _HAS.format("tx", "x = ''")),
    ("starts_with_system", "r[1] = 'system'"),
    ("ends_with_user", "r[-1] = 'user'"),
    ("no_tools", "nt = 0"),
    ("one_tool", "nt = 1"),
    ("several_tools", "nt > 1"),
    ("repeated_tool", "len(list_distinct(l)) < nt"),
    ("null_description", _HAS.format("tools", "x.function.description IS NULL")),
    ("null_parameters", _HAS.format("tools", "x.function.parameters IS NULL")),
    ("empty_parameters", _HAS.format("tools", "x.function.parameters = '{}'")),
    ("text_answer", "nc = 0"),
    ("null_answer", "assistant.content IS NULL AND nc = 0"),
    ("text_and_calls", "assistant.content IS NOT NULL AND nc > 0"),
    ("single_call", "nc = 1"),
    ("several_calls", "nc > 1"),
    ("same_tool_twice", "len(list_distinct(c)) < nc"),
    ("unlisted_call", _HAS.format("c", "NOT list_contains(l, x)")),
    ("calls_without_tools", "nc > 0 AND nt = 0"),
    ("unused_tools", _HAS.format("l", "NOT list_contains(c, x)")),
    ("empty_arguments", _HAS.format("assistant.tool_calls", "x.function.arguments = '{}'")),
    ("null_arguments", _HAS.format("assistant.tool_calls", "x.function.arguments IS NULL")),
    ("null_metadata", "metadata IS NULL"),
    ("null_category", "metadata.category IS NULL"),
]


def _oracles() -> dict[str, str]:
    from callframe.plans import checks_sql
    from callframe.plans.evaluation import _pred_sql
    from callframe.plans.training import AS_JSON

    pairs = [("train", "dev_seen"), ("train", "test_seen"), ("train", "test_unseen_tools"), ("dev_seen", "test_seen"), ("dev_seen", "test_unseen_tools"), ("test_seen", "test_unseen_tools")]
    grid = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in pairs) + ") AS g(left_split, right_split)"
    types = "(VALUES " + ", ".join("('" + t.replace("'", "''") + "')" for t in TYPES) + ") AS t(source_type)"
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in normalize.TYPE_NAMES.items())
    return checks_sql.ORACLES | {
        "tag_calls": f"""
WITH p AS (SELECT line_number, raw, (SELECT len(list_filter(messages, lambda m: m.role = 'user')) FROM canonical_samples c WHERE c.line_number = q.line_number) AS users FROM ({_pred_sql()}) q),
t AS (SELECT line_number, users AS message_index, raw AS txt FROM p UNION ALL SELECT line_number, users + 2, 'again ' || raw FROM p),
b AS (SELECT line_number, message_index, generate_subscripts(x, 1) AS i, unnest(x) AS raw_content FROM (SELECT *, regexp_extract_all(txt, '(?s)<tool_call>(.*?)</tool_call>', 1) AS x FROM t))
SELECT line_number, message_index::INTEGER AS message_index, (row_number() OVER (PARTITION BY line_number ORDER BY message_index, i) - 1)::INTEGER AS tool_call_index, raw_content FROM b""",
        "data_tags": rf"""
WITH p AS (SELECT line_number, regexp_extract_all(raw, '(?s)<tool_call>(.*?)</tool_call>', 1) AS a, regexp_extract_all(raw, '(?s)<tool_call>\s*(.*?)\s*</tool_call>', 1) AS b FROM ({_pred_sql()}))
SELECT line_number, len(a)::INTEGER AS bodies, coalesce(list_sum(list_transform(a, lambda x: length(x))), 0)::INTEGER AS data_chars,
  coalesce(list_sum(list_transform(b, lambda x: length(x))), 0)::INTEGER AS trimmed_chars FROM p""",
        "name_audit": """
WITH c AS (SELECT line_number, list_transform(tools, lambda t: t.function.name) AS names, generate_subscripts(assistant.tool_calls, 1) - 1 AS call, unnest(assistant.tool_calls).function.name AS n FROM canonical_samples)
SELECT line_number, call::INTEGER AS call, n AS candidate_name, 'top_level_name' AS name_source, coalesce(list_contains(names, n), false) AS verified,
  CASE WHEN coalesce(len(names), 0) = 0 THEN 'missing_tools' WHEN NOT list_contains(names, n) THEN 'unknown_tool' ELSE '' END AS issue FROM c""",
        "recovered_tools": """
SELECT line_number, array_to_string(list_sort(list_distinct(list_transform(tools, lambda t: t.function.name))), ',') AS names, 0 AS issues FROM canonical_samples WHERE len(tools) > 0""",
        "normalized_flat": """
WITH s AS (SELECT *, line_number % 4 AS k FROM canonical_samples)
SELECT 'xlam_' || line_number AS sample_id, CASE WHEN k < 3 THEN 2 END AS messages, CASE k WHEN 0 THEN '{"properties":{"x":{"description":"n","type":"integer"}},"required":[],"type":"object"}'
  WHEN 1 THEN '{"properties":{"x":{"description":"n","items":{"type":"integer"},"type":"array"}},"required":["x"],"type":"object"}'
  WHEN 2 THEN '{"properties":{"x":{"description":"n","type":"string"}},"required":["x"],"type":"object"}' END AS parameters,
  CASE WHEN k < 3 THEN coalesce(len(assistant.tool_calls), 0) END::INTEGER AS calls, k = 3 AS failed FROM s""",
        "loaded_flat": """
SELECT 'xlam_' || item_id AS sample_id, CASE WHEN ok THEN text END AS query, CASE WHEN ok THEN 1 END::INTEGER AS calls, NOT ok AS failed FROM (SELECT *, item_id % 7 <> 0 AND text IS NOT NULL AS ok FROM eval_items)""",
        "loaded_conversations": "SELECT 'hermes_' || item_id AS sample_id, CASE WHEN item_id % 7 = 0 THEN 0 ELSE 1 END::INTEGER AS calls, item_id % 7 = 0 AS text_left, false AS failed FROM eval_items",
        "normalized_conversations": """
SELECT 'hermes_' || line_number AS sample_id, CASE WHEN ok THEN users + 1 END::INTEGER AS messages, CASE WHEN ok THEN 1 END::INTEGER AS tools, CASE WHEN ok THEN nc END::INTEGER AS calls, CASE WHEN ok AND nc = 0 THEN coalesce(assistant.content, '') END AS content, NOT ok AS failed
FROM (SELECT *, line_number % 6 <> 0 AND users > 0 AS ok FROM (SELECT *, len(list_filter(messages, lambda m: m.role = 'user')) AS users, coalesce(len(assistant.tool_calls), 0) AS nc FROM canonical_samples))""",
        "benchmark_records": "SELECT min(item_id) AS ordinal, entry_id AS id, min(text) AS result, length(min(text))::INTEGER AS input_token_count FROM eval_items GROUP BY entry_id",
        "written_lines": "SELECT split, count(*) AS lines, 0::BIGINT AS errors, count(DISTINCT sample_id) AS samples FROM sample_splits GROUP BY split",
        "batch_lookup": """
SELECT call_id, batch_no, source FROM tool_call_parses JOIN (SELECT batch_no, sample_id, min(source) AS source FROM canonical_samples GROUP BY ALL) USING (batch_no, sample_id)""",
        "type_grammar": f"""
SELECT r_regionkey, source_type, CASE trim(regexp_replace(regexp_replace(source_type, ',\\s*optional\\b', '', 'i'), ',\\s*default(\\s*=\\s*|\\s+).*$', '', 'i')) {names} END AS schema_type FROM region, {types}""",
        "contract_violations": """
WITH s AS (SELECT source, messages, tools, assistant, metadata, len(list_filter(messages, lambda m: m.role = 'system')) AS sys, list_transform(tools, lambda t: t.function.name) AS names FROM canonical_samples)
SELECT unnest(['has_source', 'has_messages', 'one_system', 'has_tools', 'tool_names_differ', 'answer', 'metadata']) AS rule,
  unnest([count(*) FILTER (source IS NULL), count(*) FILTER (coalesce(len(messages), 0) = 0), count(*) FILTER (coalesce(sys, 0) <> 1), count(*) FILTER (coalesce(len(tools), 0) = 0),
  count(*) FILTER (len(list_distinct(names)) <> len(names)), count(*) FILTER (assistant.content IS NULL AND coalesce(len(assistant.tool_calls), 0) = 0), count(*) FILTER (metadata IS NULL)]) AS n FROM s""",
        "first_deliveries": "SELECT min(line_number) AS line_number, sample_id FROM canonical_samples GROUP BY sample_id",
        "repeated_requests": f"SELECT line_number FROM (SELECT line_number, row_number() OVER (PARTITION BY {_KEY} ORDER BY line_number) AS n FROM canonical_samples) WHERE n > 1",
        "request_group_keys": f"SELECT line_number, {_KEY} AS group_key FROM canonical_samples",
        "tool_frequency": "SELECT n AS tool_name, count(*) AS samples FROM (SELECT line_number, unnest(list_distinct(list_transform(tools, lambda t: t.function.name))) AS n FROM canonical_samples) GROUP BY 1",
        "hash_split": f"""
WITH k AS (SELECT line_number, {_KEY} AS g, coalesce({_HELD}, false) AS held FROM canonical_samples), u AS (SELECT *, bool_or(held) OVER (PARTITION BY g) AS unseen FROM k),
p AS (SELECT *, ('0x' || substr(sha256('42:' || g), 1, 8))::BIGINT / 4294967296.0 AS x FROM u)
SELECT line_number, CASE WHEN unseen THEN 'test_unseen_tools' WHEN x < 0.9 THEN 'train' WHEN x < 0.95 THEN 'dev_seen' ELSE 'test_seen' END AS split FROM p""",
        "split_overlaps": f"""
SELECT left_split, right_split, (SELECT count(*) FROM (SELECT sample_id FROM sample_splits WHERE split = left_split INTERSECT SELECT sample_id FROM sample_splits WHERE split = right_split)) AS shared FROM {grid}""",
        "request_overlaps": f"""
WITH k AS (SELECT DISTINCT split, g FROM sample_splits JOIN (SELECT DISTINCT sample_id, {_KEY} AS g FROM canonical_samples) USING (sample_id))
SELECT left_split, right_split, (SELECT count(*) FROM k a JOIN k b USING (g) WHERE a.split = left_split AND b.split = right_split) AS shared FROM {grid}""",
        "leaked_tools": f"""
WITH h AS (SELECT DISTINCT sample_id FROM canonical_samples WHERE {_HELD})
SELECT g.split, (SELECT count(DISTINCT s.sample_id) FROM sample_splits s JOIN h USING (sample_id) WHERE s.split = g.split) AS samples FROM (VALUES ('train'), ('dev_seen'), ('test_seen')) AS g(split)""",
        "cross_source_groups": f"SELECT {_KEY} AS group_key, count(DISTINCT source) AS sources FROM canonical_samples GROUP BY 1 HAVING count(DISTINCT source) > 1",
        "source_distribution": "SELECT split, source, count(*) AS samples FROM sample_splits GROUP BY ALL",
        "hash_sample": "SELECT doc_id FROM documents ORDER BY sha256('42:' || doc_id), doc_id LIMIT 100",
        "stratified_sample": """
WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('42:' || doc_id), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents WHERE lang IS NOT NULL)
SELECT doc_id, lang FROM r ORDER BY (k - 1) / n, lang LIMIT 60""",
        "top_tools": "SELECT n AS label, count(*) AS n FROM (SELECT unnest(assistant.tool_calls).function.name AS n FROM canonical_samples) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3",
        "common_categories": """
SELECT metadata.category AS label, count(*) AS n FROM canonical_samples WHERE metadata.category IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, min(line_number) LIMIT 10""",
        "shortest_per_source": """
SELECT doc_id, source, length(text)::INTEGER AS n FROM documents WHERE text IS NOT NULL AND source IS NOT NULL QUALIFY row_number() OVER (PARTITION BY source ORDER BY length(text), doc_id) <= 2""",
        "review_queue": """
WITH x AS (SELECT audit_id, generate_subscripts(argument_schema_validation.issue_details, 1) - 1 AS n, unnest(argument_schema_validation.issue_details).issue AS issue FROM tool_call_audits)
SELECT audit_id, n::INTEGER AS n, issue, CASE issue WHEN 'invalid_tool_schema' THEN 1 WHEN 'argument_type_mismatch' THEN 2 WHEN 'enum_mismatch' THEN 3 ELSE 4 END::BIGINT AS priority FROM x""",
        "pending_samples": "SELECT DISTINCT sample_id FROM canonical_samples WHERE sample_id NOT IN (SELECT sample_id FROM sample_splits)",
        "assigned_samples": "SELECT line_number FROM canonical_samples WHERE sample_id IN (SELECT sample_id FROM sample_splits WHERE split = 'train')",
        "annotation_coverage": """
SELECT (SELECT count(DISTINCT sample_id) FROM canonical_samples WHERE sample_id NOT IN (SELECT sample_id FROM sample_splits)) AS missing,
  (SELECT count(*) FROM sample_splits WHERE sample_id NOT IN (SELECT sample_id FROM canonical_samples)) AS unknown,
  (SELECT count(*) FROM (SELECT sample_id FROM sample_splits GROUP BY 1 HAVING count(*) > 1)) AS repeated""",
        "run_key_faults": """
SELECT coalesce(a.sample_id, b.sample_id) AS sample_id, coalesce(l, 0) AS left_rows, coalesce(r, 0) AS right_rows FROM (SELECT sample_id, count(*) AS l FROM canonical_samples GROUP BY 1) a
FULL JOIN (SELECT sample_id, count(*) AS r FROM sample_splits GROUP BY 1) b ON a.sample_id = b.sample_id WHERE coalesce(l, 0) <> 1 OR coalesce(r, 0) <> 1""",
        "ordinal_alignment": f"SELECT line_number FROM canonical_samples WHERE line_number % 5 = 0 AND NOT {_FAILED}",
        "manifest_digests": """
WITH h AS (SELECT DISTINCT split, sha256(sample_id) AS h FROM sample_splits WHERE sample_id IS NOT NULL), r AS (SELECT split, h, ('0x' || substr(h, 1, 8))::BIGINT % 4096 AS r FROM h),
d AS (SELECT split, r, count(*) AS n, sha256(string_agg(h, chr(10) ORDER BY h)) AS d FROM r GROUP BY ALL)
SELECT split, sum(n)::BIGINT AS n, sha256(string_agg(r || ':' || d, chr(10) ORDER BY r)) AS sha256 FROM d GROUP BY split""",
        "selection_digest": "SELECT split_seed, count(*) AS n, sha256(string_agg(tool_name, chr(10) ORDER BY tool_name)) AS sha256 FROM heldout_tools GROUP BY 1",
        "audit_semantics": """
WITH x AS (SELECT argument_schema_validation.tool_definition_source AS defined, unnest(argument_schema_validation.issue_details).issue AS bucket FROM tool_call_audits),
t AS (SELECT coalesce(defined, '') AS defined, count(*) AS all_rows FROM x WHERE bucket IS NOT NULL GROUP BY 1), c AS (SELECT coalesce(defined, '') AS defined, bucket, count(*) AS n FROM x GROUP BY ALL)
SELECT nullif(t.defined, '') AS defined, b.bucket, coalesce(n, 0) AS n, coalesce(n, 0) / all_rows AS share
FROM t CROSS JOIN (VALUES ('argument_type_mismatch'), ('enum_mismatch'), ('missing_required_argument'), ('unexpected_argument'), ('invalid_tool_schema')) AS b(bucket) LEFT JOIN c ON c.defined = t.defined AND c.bucket = b.bucket""",
        "candidate_union": """
SELECT line_number, 'unlisted' AS candidate_source, 0 AS source_order FROM canonical_samples WHERE len(list_filter(list_transform(assistant.tool_calls, lambda c: c.function.name), lambda n: NOT list_contains(list_transform(tools, lambda t: t.function.name), n))) > 0
UNION ALL SELECT line_number, 'no_tools', 1 FROM canonical_samples WHERE len(tools) = 0 UNION ALL SELECT line_number, 'no_source', 2 FROM canonical_samples WHERE source IS NULL""",
        "training_export": f"""
SELECT line_number, CASE WHEN NOT {_FAILED} THEN len(messages) END::INTEGER AS turns, CASE WHEN NOT {_FAILED} THEN CASE WHEN assistant.content IS NULL THEN 'function_call' ELSE 'gpt' END END AS role,
  CASE WHEN NOT {_FAILED} THEN coalesce(assistant.content, {_CALLS}) END AS answer, CASE WHEN NOT {_FAILED} THEN list_filter(messages, lambda m: m.role = 'system')[1].content END AS system, {_FAILED} AS failed
FROM canonical_samples""",
        "chat_requests": f"""
SELECT line_number::VARCHAR AS sample_id, (len(messages) - {_NSYS})::INTEGER AS turns, list_filter(messages, lambda m: m.role <> 'system')[-1].role AS last_role,
  list_filter(messages, lambda m: m.role = 'system')[1].content AS system FROM canonical_samples""",
        "benchmark_requests": """
SELECT item_id AS id, CASE WHEN item_id % 7 <> 0 AND item_id % 3 = 0 THEN 's' END AS system, CASE WHEN item_id % 7 <> 0 THEN 1 END AS turns,
  CASE WHEN item_id % 7 = 0 THEN 'must end with a user message' END AS error FROM eval_items""",
        "preference_pairs": f"""
SELECT p.line_number::VARCHAR AS sample_id, (len(c.messages) - 1)::INTEGER AS turns, chosen AS value, raw AS rejected FROM ({_pred_sql()}) p
JOIN (SELECT line_number, messages, {_CALLS} AS chosen, {_FAILED} AS failed FROM canonical_samples) c USING (line_number)
WHERE p.assistant.content IS NULL AND NOT failed AND chosen <> raw""",
        "role_sequences": "SELECT array_to_string(list_transform(messages, lambda m: m.role), ' -> ') AS roles, count(*) AS samples FROM canonical_samples GROUP BY 1",
        "length_profile": """
SELECT source, count(text) AS count, min(length(text))::INTEGER AS min, round(avg(length(text)), 3) AS mean, median(length(text)) AS median, quantile_disc(length(text), 0.9)::DOUBLE AS p90,
  max(length(text))::INTEGER AS max FROM documents WHERE text IS NOT NULL GROUP BY 1""",
        "sample_counters": f"""
WITH s AS (SELECT *, coalesce(len(assistant.tool_calls), 0) AS nc, coalesce(len(tools), 0) AS nt, coalesce(list_transform(tools, lambda t: t.function.name), []) AS l, coalesce(list_transform(assistant.tool_calls, lambda t: t.function.name), []) AS c,
  coalesce(list_transform(messages, lambda m: m.role), []) AS r, coalesce(list_transform(messages, lambda m: m.content), []) AS tx FROM canonical_samples)
SELECT unnest({[k for k, _ in _COUNTERS]}) AS counter, unnest([{', '.join(f"count(*) FILTER ({v})" for _, v in _COUNTERS)}]) AS n FROM s""",
        "problem_summary": """
WITH s AS (SELECT sample_id, tools, list_transform(tools, lambda t: t.function.name) AS l, list_transform(assistant.tool_calls, lambda t: t.function.name) AS c FROM canonical_samples),
p AS (SELECT sample_id, 'unlisted_call' AS category, len(list_filter(c, lambda x: NOT list_contains(l, x))) AS n FROM s UNION ALL SELECT sample_id, 'repeated_tool', len(l) - len(list_distinct(l)) FROM s
  UNION ALL SELECT sample_id, 'missing_description', len(list_filter(tools, lambda t: t.function.description IS NULL)) FROM s
  UNION ALL SELECT sample_id, 'missing_parameters', len(list_filter(tools, lambda t: t.function.parameters IS NULL)) FROM s)
SELECT category, count(DISTINCT sample_id) AS samples, sum(n)::BIGINT AS occurrences FROM p WHERE n > 0 GROUP BY 1""",
        "error_sample": "SELECT call_id, error_type FROM tool_call_parses WHERE parse_success = false ORDER BY call_id LIMIT 200",
        "resumed_by_category": "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
        "generated": "SELECT item_id, CASE WHEN item_id % 10 <> 0 THEN item_id || ':' || length(coalesce(text, '')) END AS raw_prediction, CASE WHEN item_id % 10 = 0 THEN 'RuntimeError: refused' END AS error FROM eval_items",
        "resumed_stream": "SELECT event_type, count(*) AS events, count(DISTINCT event_id) AS ids FROM events GROUP BY 1",
        "legacy_modes": rf"""
WITH p AS (SELECT call_id, sample_id, raw_content AS raw, regexp_extract(raw_content, '^(?s)((?:\s|\\[rnt])*)(.*?)((?:\s|\\[rnt])*)$', ['lead', 'b', 'tail']) AS x FROM tool_call_parses),
e AS (SELECT call_id, sample_id, raw, x.b AS b, x.lead || x.tail AS ends FROM p),
j AS (SELECT *, coalesce(json_valid(b), false) AS strict, {AS_JSON} AS j FROM e),
v AS (SELECT *, CASE WHEN strict THEN b WHEN coalesce(json_valid(j), false) THEN j END::JSON AS v FROM j),
k AS (SELECT sample_id, CASE WHEN coalesce(json_type(v), '') <> 'OBJECT' THEN 'failed' WHEN NOT strict THEN 'python_literal' WHEN regexp_matches(ends, '\\[rnt]') THEN 'escaped_boundary_json' ELSE 'strict_json' END AS mode, v FROM v),
t AS (SELECT sample_id, list_transform(tools, lambda t: t.function.name) AS names FROM canonical_samples QUALIFY row_number() OVER (PARTITION BY sample_id ORDER BY line_number) = 1),
s AS (SELECT mode, CASE WHEN mode = 'failed' OR coalesce(json_type(v, '$.arguments'), '') <> 'OBJECT' THEN 'invalid' WHEN json_type(v, '$.name') = 'VARCHAR' THEN 'normal' WHEN json_type(v, '$.arguments.name') IS DISTINCT FROM 'VARCHAR' THEN 'invalid'
  WHEN list_contains(names, v->>'$.arguments.name') THEN 'nested_name_repaired' WHEN coalesce(len(names), 0) = 0 THEN 'nested_name_unverifiable' ELSE 'nested_name_not_in_candidates' END AS structure FROM k LEFT JOIN t USING (sample_id))
SELECT mode, structure, count(*) AS calls FROM s GROUP BY ALL""",
        "value_kinds": """
WITH a AS (SELECT unnest(assistant.tool_calls).function.arguments::JSON AS a FROM canonical_samples)
SELECT CASE WHEN t.fullkey = '$' THEN '' ELSE substr(t.fullkey, 3) END AS path, CASE WHEN t.type IN ('UBIGINT', 'BIGINT', 'HUGEINT', 'UHUGEINT') THEN 'integer' WHEN t.type = 'DOUBLE' THEN 'number'
  WHEN t.type = 'VARCHAR' THEN 'string' ELSE lower(t.type) END AS kind, count(*) AS n FROM a, json_tree(a.a) t WHERE NOT contains(t.fullkey, '[') GROUP BY ALL""",
        "size_breakdown": """
SELECT source, lang, count(*) AS rows, count(*) FILTER (n_chars < 300) AS short, count(*) FILTER (n_chars >= 300 AND n_chars < 1500) AS middle,
  count(*) FILTER (n_chars >= 1500 OR n_chars IS NULL) AS long FROM documents GROUP BY CUBE (source, lang)""",
        "parse_retention": """
SELECT batch_no, count(*) AS before, count(*) FILTER (parse_success) AS after, count(*) - count(*) FILTER (parse_success) AS dropped, count(*) FILTER (parse_success) / count(*) AS rate
FROM tool_call_parses GROUP BY ROLLUP (batch_no)""",
        "document_funnel": """
WITH d AS (SELECT coalesce(length(text) > 0, false) AS a, lang IS NOT NULL AS b, source IS NOT NULL AS c, coalesce(length(text) >= 500, false) AS e FROM documents)
SELECT unnest(['all', 'has_text', 'has_lang', 'has_source', 'long_enough']) AS stage, unnest([0, 1, 2, 3, 4]) AS ord,
  unnest([count(*), count(*) FILTER (a), count(*) FILTER (a AND b), count(*) FILTER (a AND b AND c), count(*) FILTER (a AND b AND c AND e)]) AS n FROM d""",
        "yield_comparison": """
SELECT f.r AS first_rows, f.h AS first_hits, s.r AS second_rows, s.h AS second_hits, f.h / f.r AS first_yield, s.h / s.r AS second_yield, (s.h / s.r) / (f.h / f.r) AS uplift
FROM (SELECT count(*) AS r, count(*) FILTER (lang = 'en') AS h FROM documents WHERE doc_id % 2 = 0) f, (SELECT count(*) AS r, count(*) FILTER (lang = 'en') AS h FROM documents WHERE doc_id % 2 = 1) s""",
        "supplier_bands": "SELECT l_suppkey, CASE WHEN count(*) >= 620 THEN 'high' WHEN count(*) >= 580 THEN 'middle' ELSE 'low' END AS band FROM lineitem GROUP BY 1",
        "json_arguments": """
SELECT json_valid(props) AS ok, lower(json_type(props)) AS kind, len(json_keys(props))::INTEGER AS members, count(*) AS events FROM events GROUP BY ALL""",
    }


ORACLES = _oracles()
