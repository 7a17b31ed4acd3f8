"""Duplicates hidden by formatting: one record each, with the number of its copies.

A record is brought to a canonical form (words of the user text; names and arguments of the
calls with sorted keys, numbers by value and strings as their words), hashed to 128 bits,
and counted with map-side combining. A second, independent hash is part of the key, so a
collision of the first cannot merge different records; `collisions` reports any.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callframe.functions.jsonx import loads, same_number
from callframe.functions.skew import lookup_join
from callframe.functions.staging import spread, stage
from callframe.functions.text import user_text, words


def plain(value: Any) -> Any:
    """A JSON value with strings as their words, numbers by value; keys are kept (the dump sorts them)."""
    if isinstance(value, str):
        return " ".join(words(value))
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    if isinstance(value, list):
        return [plain(v) for v in value]
    return same_number(value)


def canonical_record(text: str | None, calls: list[tuple[str | None, str | None]]) -> bytes:
    """Canonical bytes; arguments that are no JSON, or too deep, stand as their own text."""
    out: list[Any] = [words(text)]
    for name, args in calls:
        ok, value, _, _ = loads(args)
        try:
            out.append([name, [plain(value)] if ok else args])
        except RecursionError:
            out.append([name, args])
    return json.dumps(out, sort_keys=True, separators=(",", ":")).encode()


def fingerprints(samples: DataFrame) -> DataFrame:
    """(sample_id, key binary(16), check bigint, line_number), one row per delivered row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, lines, texts, names, args = (c.to_pylist() for c in batch.columns)
            forms = [canonical_record(t, [*zip(n or [], a or [])]) for t, n, a in zip(texts, names, args)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.string()),
                    pa.array(lines, pa.int64()),
                    pa.array([hashlib.blake2b(f, digest_size=16).digest() for f in forms], pa.binary()),
                    pa.array([xxhash.xxh3_64_intdigest(f) - (1 << 63) for f in forms], pa.int64()),
                ],
                names=["sample_id", "line_number", "key", "check"],
            )

    calls = F.col("assistant.tool_calls")
    rows = samples.filter(F.col("sample_id").isNotNull()).select(
        "sample_id",
        F.col("line_number").cast("bigint").alias("line_number"),
        user_text("messages").alias("text"),
        F.transform(calls, lambda c: c["function"]["name"]).alias("names"),
        F.transform(calls, lambda c: c["function"]["arguments"]).alias("args"),
    )
    return spread(rows).mapInArrow(run, "sample_id string, line_number bigint, key binary, check bigint")


def one_per_sample(prints: DataFrame) -> DataFrame:
    """Deliveries of one sample_id count once: the one with the lowest line_number."""
    first = F.min(F.struct(F.coalesce("line_number", F.lit(1 << 62)), "key", "check")).alias("f")
    return prints.groupBy("sample_id").agg(first).select("sample_id", "f.key", "f.check")


def copy_classes(prints: DataFrame) -> DataFrame:
    """(key, check, keep_id, copies): one row per different record; keep_id is the smallest sample_id."""
    return prints.groupBy("key", "check").agg(F.min("sample_id").alias("keep_id"), F.count("*").alias("copies"))


def copies(samples: DataFrame) -> DataFrame:
    """(keep_id, copy_id) of every sample that is a copy of another; keep_id itself is left out.

    NULL messages and calls are empty ones. A record that a third of all rows share is
    counted with map-side combining and found again through a salted lookup.
    """
    mine = stage(one_per_sample(fingerprints(samples)), "prints")
    both = mine.withColumn("key", F.concat("key", F.to_binary(F.hex("check"), F.lit("hex")))).select("sample_id", "key")
    several = both.groupBy("key").agg(F.min("sample_id").alias("keep_id"), F.count("*").alias("n")).filter("n > 1").select("key", "keep_id")
    return lookup_join(both, several, "key").filter("sample_id <> keep_id").select("keep_id", F.col("sample_id").alias("copy_id"))


def collisions(prints: DataFrame) -> DataFrame:
    """Keys that different records share (none is expected): (key, records)."""
    return prints.groupBy("key").agg(F.min("check").alias("a"), F.max("check").alias("b")).filter("a <> b").select("key")
