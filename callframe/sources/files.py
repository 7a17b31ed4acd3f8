"""JSON files in and out: arrays, lines, digests and manifests."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from callframe.functions.batched import batched
from callframe.functions.jsonx import canon, json_strict, loads
from callframe.functions.staging import put, stage


@batched("items array<string>, error string")
def array_items(texts):
    """Elements of a JSON array as canonical texts; anything else is an error."""
    import pandas as pd

    rows = []
    for t in texts:
        ok, v, kind, message = loads((t or "").removeprefix("﻿"))
        if not ok:
            rows.append((None, f"{kind}: {message}"))
        elif not isinstance(v, list):
            rows.append((None, "TypeError: the top level must be an array"))
        else:
            rows.append(([canon(x) for x in v], None))
    return pd.DataFrame(rows, columns=["items", "error"])


def array_values(chunks: Iterator[str]) -> Iterator[Any]:
    """Values of a JSON array that comes in chunks of text; what is held is one value and one chunk.

    A byte order mark is skipped, and a missing final bracket is taken for the end. Anything else
    that is no array is a TypeError, broken values and separators are a ValueError.
    """
    decoder = json.JSONDecoder()
    text, ended, begun, wants = "", False, False, "value or end"
    chunks = iter(chunks)
    while True:
        text = text.lstrip(" \t\r\n﻿" if not begun else " \t\r\n")
        if not text and not ended:
            text, ended = _more(chunks, text)
            continue
        if not begun:
            if not text.startswith("["):
                raise TypeError("the top level must be an array")
            text, begun = text[1:], True
            continue
        if not text or (text[0] == "]" and wants != "value"):
            if text[1:].strip() or (not ended and "".join(chunks).strip()):
                raise ValueError("text after the array")
            return
        if wants == "separator":
            if text[0] != ",":
                raise ValueError(f"a comma is missing before {text[:20]!r}")
            text, wants = text[1:], "value"
            continue
        try:
            value, at = decoder.raw_decode(text)
        except json.JSONDecodeError:
            at = len(text)
            if ended:
                raise
        # A number at the end of a chunk may go on in the next one.
        if not ended and not text[at:].strip("0123456789.eE+-"):
            text, ended = _more(chunks, text)
            continue
        yield value
        text, wants = text[at:], "separator"


def _more(chunks: Iterator[str], text: str) -> tuple[str, bool]:
    """The text with as much again of what follows, so a long value is not decoded once a chunk, and whether that was all."""
    parts, size = [text], 0
    for c in chunks:
        parts.append(c)
        size += len(c)
        if size >= len(text):
            return "".join(parts), False
    return "".join(parts), not size


def _chunks(path: str, chunk: int) -> Iterator[str]:
    with open(path, encoding="utf-8") as f:
        while part := f.read(chunk):
            yield part


def _local(path: str) -> str | None:
    """A path that every machine can open as a file (a mounted folder), else NULL."""
    return path.removeprefix("file://").removeprefix("file:") if path.startswith("file:") or "://" not in path else None


def read_json_array(spark: SparkSession, path: str, chunk: int = 1 << 20) -> DataFrame:
    """(file, ordinal, value) of files that hold one JSON array each; a file that does not raises with its name.

    One task reads one file, in chunks and value by value where files are mounted on the machines;
    elsewhere a file is one text. Values come as canonical texts.
    """
    files = spark.read.format("binaryFile").load(path).select("path")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows: list[str] = []
                done = 0
                try:
                    for v in array_values(_chunks(_local(unquote(name)), chunk)):
                        rows.append(canon(v))
                        if len(rows) == 1_000:
                            yield _array_batch(name, done, rows)
                            done, rows = done + len(rows), []
                except (TypeError, ValueError) as e:
                    raise TypeError(f"{name}: {type(e).__name__}: {e}") from e
                if rows:
                    yield _array_batch(name, done, rows)

    names = [r[0] for r in files.limit(1).collect()]
    if names and _local(names[0]) is not None:
        return files.repartition(max(1, files.count())).mapInArrow(scan, "file string, ordinal int, value string")
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    parsed = whole.withColumn("_a", array_items("value"))
    bad = parsed.filter("_a.error IS NOT NULL").select("file", "_a.error").limit(5).collect()
    if bad:
        raise TypeError(f"{[(r[0], r[1]) for r in bad]}")
    return parsed.select("file", F.posexplode("_a.items").alias("ordinal", "value"))


def _array_batch(name: str, done: int, rows: list[str]) -> pa.RecordBatch:
    n = len(rows)
    return pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(range(done, done + n), pa.int32()), pa.array(rows, pa.string())], names=["file", "ordinal", "value"])


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, value): lines of text files with their number in the file, from 1.

    Splits of a file are numbered by themselves; how many lines stand before a split is a sum over
    the splits of its file, so no file is ordered in one task.
    """
    m = F.col("_metadata")
    raw = spark.read.text(path).select(m["file_path"].alias("file"), m["file_block_start"].alias("_b"), F.monotonically_increasing_id().alias("_i"), "value")
    splits = raw.groupBy("file", "_b").agg(F.count("*").alias("_n"), F.min("_i").alias("_low"))
    base = splits.withColumn("_base", F.sum("_n").over(Window.partitionBy("file").orderBy("_b")) - F.col("_n"))
    return raw.join(base, ["file", "_b"]).select("file", (F.col("_base") + F.col("_i") - F.col("_low") + 1).alias("line"), "value")


def read_lines(spark: SparkSession, path: str, blank: str = "skip") -> DataFrame:
    """(file, line, value, ok, kind, canon, error): one row per line, strictly parsed.

    blank: `skip` leaves blank lines out, `reject` makes them errors. line is the number of the line in its file.
    Lines that are no JSON object have an error; `require_objects` raises on them.
    """
    lines = numbered_lines(spark, path)
    empty = ~F.col("value").rlike(r"\S")
    rows = (lines.filter(~empty) if blank == "skip" else lines).withColumn("_p", json_strict("value"))
    error = F.when(empty, "blank line").when(~F.col("_p.ok"), F.concat_ws(": ", "_p.error_type", "_p.error")).when(F.col("_p.kind") != "object", "not an object")
    return rows.select("file", "line", "value", F.col("_p.ok").alias("ok"), F.col("_p.kind").alias("kind"), F.col("_p.canon").alias("canon"), error.alias("error"))


def require_objects(lines: DataFrame) -> DataFrame:
    bad = lines.filter("error IS NOT NULL").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['file']}:{r['line']}: {r['error']}" for r in bad))
    return lines


def inspect_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, lines, bytes, sha256) of files of JSON objects; a blank, broken or other line raises with its place."""
    counted = require_objects(read_lines(spark, path, blank="reject")).groupBy("file").agg(F.count("*").alias("lines"))
    return file_digests(spark, path).join(counted, "file", "left").select("file", F.coalesce("lines", F.lit(0)).alias("lines"), "bytes", "sha256")


def load_keyed(lines: DataFrame, key: str) -> DataFrame:
    """Lines with their key; empty input, missing, blank and repeated keys raise."""
    keyed = require_objects(lines).withColumn("key", F.get_json_object("canon", f"$.{key}"))
    if keyed.isEmpty():
        raise ValueError("no rows")
    bad = keyed.groupBy("key").count().filter("key IS NULL OR key = '' OR count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"missing or repeated {key}: {[r[0] for r in bad]}")
    return keyed


def first_value(spark: SparkSession, path: str, chunk: int = 1 << 16) -> tuple[str, str]:
    """(`array` or `lines`, first value) of a file, read no further than the value goes where the file can be opened, else line by line."""
    name = _local(path)
    if name is None:
        lines = spark.read.text(path).filter(F.col("value").rlike(r"\S")).limit(1).collect()
        head = lines[0][0].lstrip("\ufeff \t") if lines else ""
        return ("array", read_json_array(spark, path).filter("ordinal = 0").first()["value"]) if head.startswith("[") else ("lines", head)
    for part in _chunks(name, chunk):
        head = part.lstrip("\ufeff \t\r\n")
        if head:
            break
    else:
        return "lines", ""
    if head.startswith("["):
        return "array", canon(next(array_values(_chunks(name, chunk))))
    with open(name, encoding="utf-8") as f:
        return "lines", next(x for line in f if (x := line.strip("\ufeff \t\r\n")))


def write_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines, NULL fields written; the committer makes the write atomic."""
    df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value")).write.mode(mode).text(path)


def write_selected(lines: DataFrame, selected: DataFrame, path: str, ordinal: str = "line_number", value: str = "value") -> str:
    """The selected lines byte for byte, in the order of their ordinal; returns the SHA-256 of what was written, lines ended by newlines.

    Meant for a chosen subset: one task reads it for the digest.
    """
    some = stage(lines.join(selected.select(ordinal).distinct(), ordinal, "left_semi").select(ordinal, value), "selected")
    some.orderBy(ordinal).select(value).write.text(path)
    ended = some.withColumn("_v", F.concat(value, F.lit("\n")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, "_v"))), lambda x: x["_v"]), "")
    return ended.agg(F.sha2(joined, 256)).first()[0]


def write_partitioned(df: DataFrame, path: str, *by: str, mode: str = "errorifexists") -> None:
    """One folder per value of each column in `by`."""
    df.write.mode(mode).partitionBy(*by).json(path)


def write_summary(row: DataFrame, path: str) -> None:
    """A one-row frame as pretty JSON, in any file system the cluster knows."""
    put(row.sparkSession, path, json.dumps(row.first().asDict(True), ensure_ascii=False, indent=2, default=str).encode())


def save_first(rows: DataFrame, order: str, path: str) -> None:
    """The first row, for inspection; an empty frame writes null."""
    first = rows.orderBy(order).limit(1).collect()
    put(rows.sparkSession, path, json.dumps(first[0].asDict(True) if first else None, ensure_ascii=False, indent=2, default=str).encode())


def merge_state(state: DataFrame, update: DataFrame, key: list[str]) -> DataFrame:
    """state with the columns of update written over it where update has a row; what update does not have stays.

    An update without a record of the state, or with two for one key, is an error.
    """
    twice = update.groupBy(*key).count().filter("count > 1").select(*key)
    orphan = update.join(state, key, "left_anti").select(*key)
    bad = twice.unionByName(orphan).limit(5).collect()
    if bad:
        raise ValueError(f"orphan or repeated records: {[tuple(r) for r in bad]}")
    new = [c for c in update.columns if c not in key]
    renamed = update.select(*key, F.lit(True).alias("_new"), *[F.col(c).alias(f"_u_{c}") for c in new])
    met = state.join(renamed, key, "left")
    columns = [F.when(F.col("_new"), F.col(f"_u_{c}")).otherwise(F.col(c) if c in state.columns else F.lit(None)).alias(c) if c in new else F.col(c) for c in [*state.columns, *[c for c in new if c not in state.columns]]]
    return met.select(*columns)


def write_state(state: DataFrame, path: str) -> DataFrame:
    """Overwrite a cumulative state that may itself be read from path: the new one is written beside it first."""
    kept = stage(state, "state")
    kept.write.mode("overwrite").parquet(path)
    return state.sparkSession.read.parquet(path)


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(file, bytes, sha256) of whole files."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def sequence_digest(rows: DataFrame, value: str, order: str, *by: str) -> DataFrame:
    """SHA-256 of the values joined by newlines in order, and their number, per group.

    One task reads a group, so this is for manifests of selected ids; `tree_digest` is for whole tables.
    """
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("_v")))), lambda x: x["_v"].cast("string")), "\n")
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.sha2(joined, 256).alias("sha256"))


def tree_digest(rows: DataFrame, value: str, *by: str, ranges: int = 4_096) -> DataFrame:
    """(by..., n, sha256) of the distinct values of each group in sorted order, as a tree: a digest of the digests of fixed hash ranges.

    A range is the values whose SHA-256 begins with the same bits, sorted by that hash and joined by
    newlines; the group's digest joins its ranges' digests in order. Which rows fall together depends on
    the values alone, so any partitioning gives the same digest, and a task holds one range.
    """
    h = rows.filter(F.col(value).isNotNull()).select(*by, F.sha2(F.col(value).cast("string"), 256).alias("_h")).distinct()
    part = F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), F.lit(ranges))
    one = h.groupBy(*by, part.alias("_r")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("_h")), "\n"), 256).alias("_d"))
    pairs = F.array_sort(F.collect_list(F.struct("_r", "_d")))  # at most `ranges` of them
    return one.groupBy(*by).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(pairs, lambda p: F.concat(p["_r"].cast("string"), F.lit(":"), p["_d"])), "\n"), 256).alias("sha256"))


def multiset_digest(rows: DataFrame, value: str) -> DataFrame:
    """(n, digest): an order-free digest for any number of rows, combined on the map side."""
    h = F.xxhash64(value).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("n"), F.sum(h).alias("digest"))
