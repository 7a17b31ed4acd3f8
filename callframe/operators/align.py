"""Alignment of runs on sample_id, transitions between them, and error histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Transitions from a base run to a candidate run.
TRANSITIONS = ("both_correct", "fixed", "regressed", "both_wrong")


def key_faults(left: DataFrame, right: DataFrame, key: str = "sample_id") -> DataFrame:
    """(key, left_rows, right_rows) of every key that is not exactly once on both sides."""
    l, r = left.groupBy(key).agg(F.count("*").alias("left_rows")), right.groupBy(key).agg(F.count("*").alias("right_rows"))
    both = l.join(r, key, "full").na.fill(0, ["left_rows", "right_rows"])
    return both.filter((F.col("left_rows") != 1) | (F.col("right_rows") != 1))


def require_same_keys(left: DataFrame, right: DataFrame, key: str = "sample_id", show: int = 5) -> None:
    """Raises with a few examples unless both sides have the same keys, each once."""
    bad = key_faults(left, right, key).orderBy(key).limit(show).collect()
    if bad:
        raise ValueError(f"keys differ: {[r.asDict() for r in bad]}")


def transition(base: Column, candidate: Column) -> Column:
    return F.when(base & candidate, TRANSITIONS[0]).when(candidate, TRANSITIONS[1]).when(base, TRANSITIONS[2]).otherwise(TRANSITIONS[3])


def align(base: DataFrame, candidate: DataFrame, correct: str = "full_call_exact", keep: tuple[str, ...] = (), key: str = "sample_id") -> DataFrame:
    """Inner join of two runs: base_* and candidate_* of `correct` and errors, the columns `keep` of base, and transition."""
    side = lambda d, p, more: d.select(key, F.col(correct).alias(f"{p}_correct"), F.col("errors").alias(f"{p}_errors"), *more)
    both = side(base, "base", keep).join(side(candidate, "candidate", ()), key)
    return both.withColumn("transition", transition(F.col("base_correct"), F.col("candidate_correct")))


def transition_summary(aligned: DataFrame, *by: str) -> DataFrame:
    """Counts and rates overall and by each prefix of `by` (ROLLUP): fix rate among base failures, regression rate among successes."""
    c = F.col
    agg = aligned.rollup(*by) if by else aligned.groupBy()
    n = agg.agg(F.count("*").alias("samples"), *[F.count_if(c("transition") == t).alias(t) for t in TRANSITIONS])
    return n.withColumns(
        {
            "net": c("fixed") - c("regressed"),
            "fix_rate": F.try_divide(c("fixed").cast("double"), (c("fixed") + c("both_wrong")).cast("double")),
            "regression_rate": F.try_divide(c("regressed").cast("double"), (c("regressed") + c("both_correct")).cast("double")),
        }
    )


def failure_summary(failures: DataFrame, errors: str = "errors") -> DataFrame:
    """(failures, multi_label, unlabeled): counted per sample, before labels are exploded."""
    return failures.agg(F.count("*").alias("failures"), F.count_if(F.size(errors) > 1).alias("multi_label"), F.count_if(F.size(errors) == 0).alias("unlabeled"))


def label_order(errors: DataFrame, column: str, fixed: tuple[str, ...]) -> DataFrame:
    """(label, ord): the fixed labels in their order, then all others by name."""
    spark = errors.sparkSession
    known = spark.createDataFrame([(x, i) for i, x in enumerate(fixed)], "label string, ord int")
    extra = errors.select(F.explode(column).alias("label")).distinct().join(known, "label", "left_anti").withColumn("ord", F.lit(len(fixed)))
    return known.unionByName(extra)


def label_counts(rows: DataFrame, column: str, fixed: tuple[str, ...], denominator: int | None = None) -> DataFrame:
    """(label, ord, n, rate): samples per label, zero filled; rate over `denominator` rows, NULL if none."""
    seen = rows.select(F.explode(column).alias("label")).groupBy("label").agg(F.count("*").alias("n"))
    out = label_order(rows, column, fixed).join(seen, "label", "left").na.fill(0, ["n"])
    return out.withColumn("rate", F.try_divide(F.col("n").cast("double"), F.lit(denominator).cast("double")))


def transition_errors(aligned: DataFrame, fixed: tuple[str, ...]) -> DataFrame:
    """(transition, label, n): errors of the base run for fixed samples, of the candidate for regressed ones."""
    one = F.when(F.col("transition") == "fixed", F.col("base_errors")).when(F.col("transition") == "regressed", F.col("candidate_errors"))
    rows = aligned.filter(F.col("transition").isin("fixed", "regressed")).select("transition", F.explode(one).alias("label"))
    seen = rows.groupBy("transition", "label").agg(F.count("*").alias("n"))
    spark = aligned.sparkSession
    grid = spark.createDataFrame([(t, x) for t in ("fixed", "regressed") for x in fixed], "transition string, label string")
    return grid.join(seen, ["transition", "label"], "full").na.fill(0, ["n"])


def coverage(queue: DataFrame, annotations: DataFrame, key: str) -> DataFrame:
    """(missing, unknown, repeated): queue rows without annotation, annotations outside the queue, keys annotated twice."""
    count = lambda d, name: d.agg(F.count("*").alias(name))
    missing = count(queue.join(annotations, key, "left_anti"), "missing")
    unknown = count(annotations.join(queue, key, "left_anti"), "unknown")
    twice = count(annotations.groupBy(key).count().filter("count > 1"), "repeated")
    return missing.crossJoin(unknown).crossJoin(twice)  # one row each


def ordinal_faults(left: DataFrame, right: DataFrame, ordinal: str, value: str) -> DataFrame:
    """(ordinal, left_value, right_value) where two files zipped by ordinal differ or one is longer."""
    l, r = left.select(ordinal, F.col(value).alias("left_value"), F.lit(1).alias("_l")), right.select(ordinal, F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    both = l.join(r, ordinal, "full")
    return both.filter(F.col("_l").isNull() | F.col("_r").isNull() | ~F.col("left_value").eqNullSafe(F.col("right_value"))).drop("_l", "_r")


def pending(queue: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows of the queue whose key is not done."""
    return queue.join(done.select(key), key, "left_anti")
