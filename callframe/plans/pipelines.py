"""Whole programs as one lazy plan each: DataFrames and options in, DataFrames out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callframe.functions.skew import lookup_join
from callframe.functions.staging import stage
from callframe.functions.text import group_key, user_text
from callframe.operators import align, calls, diff, export, normalize, predict, profile, repair, sampling, score, split, validate

PROTOCOL = {"tags": "<tool_call>", "repair": False, "case_sensitive": True, "matching": "multiset", "array_order": "strict"}


def _unique(rows: DataFrame, key: str, what: str) -> None:
    bad = rows.groupBy(key).count().filter(F.col(key).isNull() | (F.col("count") > 1)).limit(5).collect()
    if bad:
        raise ValueError(f"{what}: missing or repeated {key}: {[r[0] for r in bad]}")


def evaluate(predictions: DataFrame, canonical: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(per-sample scores, summary, error histogram) of (sample_id, raw_prediction, and optionally gold) rows.

    Every prediction needs its canonical sample, once; a gold answer that a prediction carries must be
    the canonical one (key order aside). Scores are written once and read by both aggregates.
    """
    _unique(predictions, "sample_id", "predictions")
    _unique(canonical, "sample_id", "canonical samples")
    strange = predictions.join(canonical, "sample_id", "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"unknown samples: {[r['sample_id'] for r in strange]}")
    joined = predictions.join(canonical.select("sample_id", "source", "tools", score.gold_calls().alias("_gold")), "sample_id")
    if "gold" in predictions.columns:
        validate.require(joined, F.col("gold") == F.col("_gold"), "gold differs from the canonical answer")
        joined = joined.drop("gold")
    scored = stage(score.score(predict.parse_predictions(joined.withColumnRenamed("_gold", "gold"))), "scores")
    return scored, score.summarize(scored), score.histogram(scored, "errors", score.ERRORS)


def compare_runs(base: DataFrame, candidate: DataFrame, keep: tuple[str, ...] = ("call_kind",)) -> dict[str, DataFrame]:
    """Transitions, their errors, argument diagnoses and differences of two scored runs with the same samples."""
    align.require_same_keys(base, candidate)
    aligned = stage(align.align(base, candidate, keep=keep), "aligned")
    wrong = diff.pair_calls(candidate.filter(F.array_contains("errors", "argument_mismatch")))
    diffs = stage(diff.argument_diffs(wrong), "diffs")
    diagnosed = diff.diagnose(wrong, diffs=diffs)
    return {
        "transitions": align.transition_summary(aligned, *keep),
        "transition_errors": align.transition_errors(aligned, score.ERRORS),
        "diagnoses": diagnosed,
        "diffs": diffs,
        "diff_summary": diff.summarize(diagnosed, diffs),
    }


def audit(raw_calls: DataFrame, samples: DataFrame, key: str = "call_id") -> tuple[DataFrame, DataFrame]:
    """(audited calls, number of calls per issue); every call comes out exactly once."""
    audited = stage(calls.audit_all(raw_calls, samples, key), "audit")
    if audited.count() != raw_calls.count():
        raise ValueError("the audit lost or repeated calls")
    return audited, audited.select(F.explode("issues").alias("issue")).groupBy("issue").agg(F.count("*").alias("calls"))


def repaired(raw_calls: DataFrame, samples: DataFrame, key: str = "call_id") -> tuple[DataFrame, DataFrame]:
    """(repaired calls, number per kind of repair)."""
    names = calls.sample_tools(samples, tool_names=calls.tool_names(F.col("tools")))
    done = repair.repair_calls(calls.audit_names(lookup_join(calls.parse_calls(raw_calls, key, ("sample_id",)), names, "sample_id", "left", counted=raw_calls)))
    return done, repair.repair_summary(done)


def prepare(samples: DataFrame, heldout: DataFrame, repaired_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """Validate, take first deliveries that are usable, split, and export: status summary, splits, overlaps, training rows."""
    checked = stage(validate.validate(validate.canonical_lines(samples), repaired_ids), "validated")
    usable = checked.filter(F.col("status").isin("keep", "repaired_keep") & F.col("first")).select("line_number")
    good = stage(split.split_by_tools(samples.join(usable, "line_number"), heldout), "splits")
    return {
        "status": validate.summarize(checked),
        "splits": good,
        "overlaps": split.split_overlaps(good, "group_key"),
        "leaks": split.leaked_tools(good, heldout),
        "training": export.to_training(good).join(good.select("line_number", "split"), "line_number"),
    }


def profile_samples(samples: DataFrame) -> dict[str, DataFrame]:
    """Everything a first look at a data set needs: counters, role sequences, categories, kinds of arguments, repeated requests."""
    keyed = samples.select("line_number", group_key(user_text("messages")).alias("group_key"))
    return {
        "counters": profile.call_counters(samples),
        "roles": profile.role_sequences(samples),
        "categories": sampling.most_common(samples.select("line_number", F.col("metadata.category").alias("category")), "category", "line_number", 10),
        "arguments": profile.value_kinds(samples.select(F.explode("assistant.tool_calls.function.arguments").alias("a")), "a"),
        "tools": split.tool_frequency(samples),
        "repeated": profile.repeated_later(keyed, "group_key", "line_number"),
    }


def accept_parsed(converted: DataFrame, raw: DataFrame, key: str = "id") -> dict[str, DataFrame]:
    """Acceptance of a parser: every raw row comes out once, good or in the error log, and good rows meet the contract."""
    good, errors = normalize.split_errors(converted)
    if good.count() + errors.count() != raw.count():
        raise ValueError("rows were lost or repeated")
    _unique(good, "sample_id", "parsed samples")
    numbered = good.withColumn("line_number", F.monotonically_increasing_id())
    return {"status": validate.summarize(validate.validate(validate.canonical_lines(numbered))), "errors": errors}


def requests(samples: DataFrame) -> DataFrame:
    """(sample_id, request): user texts of samples."""
    return samples.select("sample_id", user_text("messages").alias("request"))
