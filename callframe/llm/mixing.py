"""Mixing sources to target weights: a low-discrepancy schedule of equal-token blocks.

The documents of a source, in a fixed shuffled order, are one stream of tokens that may be
gone through max_repeats times. Slot i of the mix takes the next block of BLOCK tokens of
the source whose stretch of the cumulative weights holds the i-th golden-ratio point, so
after any number of slots each source is within a few blocks of its share. The mix ends at
the first slot whose source is used up; every other source then has its share, too. With a
`deviation` it goes on: a source that is used up stays at its limit and the others grow, until
some share would be off its target by more than that.

No step orders a source in one task: offsets of documents and ranks of slots are
prefix sums over hash ranges and chunks, whose totals are few.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callframe.functions.staging import spread, stage

#: Vocabulary file (ranks) of a public tokenizer; a parameter, never part of the repository.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
BLOCK = 1_024
#: Documents of one hash range, and slots of one chunk, that a task orders.
RANGE_ROWS, CHUNK_SLOTS = 50_000, 1 << 16
#: Sources that the driver plans for.
SOURCES = 100_000
#: Fixed value: the golden ratio's fraction in units of 2^-64, so that points of any slot are exact.
GOLDEN = 0x9E3779B97F4A7C15


def encoding(path: str):
    import tiktoken
    from public_tokenizers import PATTERN

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, tokenizer: str = TOKENIZER) -> DataFrame:
    """(doc_id, source, tokens) of documents with a source and a token; whole texts, narrow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoding(tokenizer)
        for batch in batches:
            n = [len(own.encode_ordinary(t.encode("utf-8", "replace").decode())) if t else 0 for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], names=["doc_id", "source", "tokens"])

    rows = documents.filter(F.col("source").isNotNull()).select(F.col("doc_id").cast("bigint"), "source", "text")
    return spread(rows).mapInArrow(run, "doc_id bigint, source string, tokens bigint").filter("tokens > 0")


def offsets(counted: DataFrame) -> DataFrame:
    """counted with `first`, the offset of the document in its source's shuffled stream."""
    n = counted.count()
    ranges = max(1, n // RANGE_ROWS)
    h = counted.withColumn("h", F.sha2(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), 256))
    h = h.withColumn("range", F.floor(F.conv(F.substring("h", 1, 8), 16, 10).cast("bigint") * ranges / F.lit(1 << 32)))
    sums = h.groupBy("source", "range").agg(F.sum("tokens").alias("sum"))
    before = sums.withColumn("base", F.sum("sum").over(Window.partitionBy("source").orderBy("range")) - F.col("sum")).drop("sum")
    inside = Window.partitionBy("source", "range").orderBy("h", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = h.withColumn("upto", F.sum("tokens").over(inside)).join(before, ["source", "range"])
    return placed.select("doc_id", "source", "tokens", (F.col("base") + F.col("upto") - F.col("tokens")).alias("first"))


def plan(counted: DataFrame, targets: DataFrame) -> list[dict]:
    """One dict per target: source, target_share, max_repeats, available tokens, weight among the sources that have documents.

    Targets with NULL source, a share or a number of repeats that is not positive have weight 0;
    of targets given several times the first by share counts.
    """
    have = counted.groupBy("source").agg(F.sum("tokens").alias("available"))
    rows = targets.filter(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").join(have, "source", "left").select("source", "target_share", "max_repeats", F.coalesce("available", F.lit(0)).alias("available"))
    rows = rows.limit(SOURCES + 1).collect()
    if len(rows) > SOURCES:
        raise ValueError(f"more than {SOURCES} sources")
    unique: dict[str, dict] = {}
    for r in sorted(rows, key=lambda r: (r["source"], -(r["target_share"] or 0), -(r["max_repeats"] or 0))):
        unique.setdefault(r["source"], r.asDict())
    out = [*unique.values()]
    for r in out:
        usable = r["available"] > 0 and (r["target_share"] or 0) > 0 and (r["max_repeats"] or 0) > 0
        r["weight"] = float(r["target_share"]) if usable else 0.0
    total = sum(r["weight"] for r in out)
    for r in out:
        r["weight"] = r["weight"] / total if total else 0.0
    return out


def extend(planned: list[dict], deviation: float, block: int = BLOCK) -> list[dict]:
    """planned with the weights of the longest mix in which no share is off its weight by more than `deviation`.

    Sources at their limit stay there and the others keep their proportions: of a level L, source s
    gives min(limit, L * weight). The level is found by bisection, as the deviation grows with it.
    """
    live = [(r["weight"], r["available"] * r["max_repeats"] // block) for r in planned if r["weight"] > 0]
    if not live:
        return planned
    given = lambda level: [min(cap, level * w) for w, cap in live]

    def off(level: float) -> float:
        u = given(level)
        total = sum(u)
        return max(abs(x / total - w) for x, (w, _) in zip(u, live)) if total else 0.0

    low, high = min(cap / w for w, cap in live), max(cap / w for w, cap in live)
    for _ in range(100):
        middle = (low + high) / 2
        low, high = (middle, high) if off(middle) <= deviation else (low, middle)
    u = iter(given(low))
    total = sum(given(low)) or 1.0
    return [r | {"weight": next(u) / total if r["weight"] > 0 else 0.0} for r in planned]


def schedule(spark, planned: list[dict], block: int = BLOCK) -> DataFrame:
    """(slot, source, rank): the slots up to the first whose source has no full block left.

    A task finds the sources of a chunk of slots by binary search in the cumulative weights (at
    most SOURCES numbers); ranks within a source add up over the chunks.
    """
    live = [r for r in planned if r["weight"] > 0]
    if not live:
        return spark.createDataFrame([], "slot bigint, source string, rank bigint")
    caps = [r["available"] * r["max_repeats"] // block for r in live]
    # Discrepancy of the golden-ratio points is logarithmic; a few slots more than the ratio show where a source ends.
    slots = int(min(cap / r["weight"] for cap, r in zip(caps, live))) + 64 * len(live)
    high = np.cumsum([r["weight"] for r in live])
    shared = spark.sparkContext.broadcast(np.minimum(high[:-1] / high[-1] * 2.0**64, 2.0**64 - 2048).astype(np.uint64))  # at most SOURCES numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                slot = np.arange(chunk * CHUNK_SLOTS, min((chunk + 1) * CHUNK_SLOTS, slots), dtype=np.int64)
                with np.errstate(over="ignore"):
                    point = slot.astype(np.uint64) * np.uint64(GOLDEN) + np.uint64(GOLDEN >> 1)
                of = np.searchsorted(shared.value, point, side="right")
                order = np.argsort(of, kind="stable")
                first = np.searchsorted(of[order], of[order], side="left")
                yield pa.RecordBatch.from_pydict({"chunk": np.full(len(slot), chunk), "slot": slot[order], "source_no": of[order].astype(np.int32), "n": np.arange(len(slot)) - first})

    chunks = spark.range(-(-slots // CHUNK_SLOTS))
    placed = stage(chunks.mapInArrow(run, "chunk bigint, slot bigint, source_no int, n bigint"), "slots")
    counts = placed.groupBy("chunk", "source_no").count()
    base = counts.withColumn("base", F.sum("count").over(Window.partitionBy("source_no").orderBy("chunk")) - F.col("count")).drop("count")
    names = spark.createDataFrame([(i, r["source"], cap) for i, (r, cap) in enumerate(zip(live, caps))], "source_no int, source string, cap bigint")
    ranked = placed.join(base, ["chunk", "source_no"]).join(F.broadcast(names), "source_no")  # at most SOURCES rows
    ranked = stage(ranked.select("slot", "source", "cap", (F.col("base") + F.col("n")).alias("rank")), "ranks")
    end = ranked.filter("rank >= cap").agg(F.min("slot")).first()[0]
    return ranked.filter(F.col("slot") < F.lit(slots if end is None else end)).select("slot", "source", "rank")


def mix(documents: DataFrame, targets: DataFrame, tokenizer: str = TOKENIZER, block: int = BLOCK, deviation: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(pieces, report).

    pieces (slot, source, doc_id, epoch, from_token, to_token): what each slot holds, in tokens of
    the document; epoch is the repeat, from 0. report, one row per target: shares, tokens and repeats
    reached. Documents without source, target or token are not used; neither is a source
    that has no document, whose share goes to the others in proportion. A share may be off by
    `deviation` if that makes the mix longer.
    """
    spark = documents.sparkSession
    wanted = documents.join(targets.select("source").distinct(), "source", "left_semi")  # before any text is tokenised
    counted = stage(token_counts(wanted, tokenizer), "tokens")
    planned = plan(counted, targets)
    if deviation:
        planned = extend(planned, deviation, block)
    slots = stage(schedule(spark, planned, block), "schedule")
    used = {r["source"]: r["n"] * block for r in slots.groupBy("source").agg(F.count("*").alias("n")).collect()}
    rows = [(r["source"], r["target_share"], r["max_repeats"], r["available"], used.get(r["source"], 0)) for r in planned]
    total = sum(used.values()) or 1
    report = spark.createDataFrame(
        [(s, t, m, a, u, u / total, u / a if a else 0.0) for s, t, m, a, u in rows],
        "source string, target_share double, max_repeats int, available_tokens bigint, used_tokens bigint, reached_share double, repeats double",
    )
    limits = spark.createDataFrame([(s, a, u) for s, _, _, a, u in rows if u], "source string, available bigint, used bigint")
    stream = offsets(counted).join(F.broadcast(limits), "source")  # at most SOURCES rows
    turns = stream.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.floor((F.col("used") - 1) / F.col("available")).cast("int"))))
    turns = turns.withColumn("start", F.col("epoch") * F.col("available") + F.col("first")).filter("start < used")
    turns = turns.withColumn("stop", F.least(F.col("start") + F.col("tokens"), F.col("used")))
    cut = turns.withColumn("rank", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("stop") - 1) / block))))
    part = cut.select(
        "source",
        "rank",
        "doc_id",
        "epoch",
        (F.greatest("start", F.col("rank") * block) - F.col("start")).alias("from_token"),
        (F.least("stop", (F.col("rank") + 1) * block) - F.col("start")).alias("to_token"),
    )
    return part.join(slots, ["source", "rank"]).select("slot", "source", "doc_id", "epoch", "from_token", "to_token"), report
