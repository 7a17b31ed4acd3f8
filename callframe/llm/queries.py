"""Queries of the language-model training-data problems."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callframe.llm import copies, groups, leakage, mixing, overlap, repetition, stable_sample
from callframe.llm.sql import ORACLES  # noqa: F401
from callframe.sources.tables import table

SPLIT_TARGETS = {"train": 0.90, "dev_seen": 0.05, "test_seen": 0.05}
SAMPLE_RATE = 0.10
GROWTH_RATES = [0.01, 0.05, 0.10]


def _groups(spark: SparkSession, d: str) -> DataFrame:
    return groups.request_groups(table(spark, d, "canonical_samples"), table(spark, d, "heldout_tools"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return _groups(spark, d).filter("members >= 2 OR pool = 'unseen'").select("group_id", "sample_id", "pool")


def p3_split(spark: SparkSession, d: str) -> DataFrame:
    """Every sample with its group and split."""
    return groups.assign_splits(_groups(spark, d), SPLIT_TARGETS).select("sample_id", "group_id", "split")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.copies(table(spark, d, "canonical_samples"))


def p4_counts(spark: SparkSession, d: str) -> DataFrame:
    """One row per different record with the number of its copies."""
    prints = copies.one_per_sample(copies.fingerprints(table(spark, d, "canonical_samples")))
    return copies.copy_classes(prints).select("keep_id", "copies")


def p5_sample(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample.select_sample(table(spark, d, "canonical_samples"), "sample_id", SAMPLE_RATE)


def p5_growth(spark: SparkSession, d: str) -> DataFrame:
    return stable_sample.growth(table(spark, d, "canonical_samples"), "sample_id", "batch_no", GROWTH_RATES)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    members, pairs = overlap.class_pairs(table(spark, d, "canonical_samples"), table(spark, d, "sample_splits"))
    return overlap.expand(members, pairs)


def p6_links(spark: SparkSession, d: str) -> DataFrame:
    """Similar classes of equal word sets, one row a pair of classes, named by their smallest sample_id."""
    return overlap.represented(*overlap.class_pairs(table(spark, d, "canonical_samples"), table(spark, d, "sample_splits")))[1]


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The class of every sample that has a split; with p6_links all pairs of p6_found follow."""
    return overlap.represented(*overlap.class_pairs(table(spark, d, "canonical_samples"), table(spark, d, "sample_splits")))[0]


def p6_report(spark: SparkSession, d: str) -> DataFrame:
    samples, splits = table(spark, d, "canonical_samples"), table(spark, d, "sample_splits")
    return overlap.report(samples, splits, *overlap.class_pairs(samples, splits))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    found = leakage.search(table(spark, d, "documents"), table(spark, d, "eval_items"))
    return found.filter("run").select("doc_id", "item_id")


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the documents that hold a run of them, by source."""
    docs = table(spark, d, "documents")
    found = leakage.search(docs, table(spark, d, "eval_items")).filter("run").select("doc_id", "item_id")
    return found.join(docs.select("doc_id", "source"), "doc_id").groupBy("item_id", "source").agg(F.count("*").alias("documents"))


def p7_recall(spark: SparkSession, d: str) -> DataFrame:
    """Leaked pairs by an exact search, and how many the latent search finds."""
    return leakage.recall(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p7_paraphrases(spark: SparkSession, d: str) -> DataFrame:
    """Documents that hold most of an item's words in order."""
    found = leakage.search(table(spark, d, "documents"), table(spark, d, "eval_items"), paraphrases=True)
    return found.filter(F.col("lcs_share").isNotNull()).select("doc_id", "item_id", "run", F.round("lcs_share", 6).alias("lcs_share"))


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The whole mix: which tokens of which document stand in which slot."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_report(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p8_extended(spark: SparkSession, d: str) -> DataFrame:
    """Report of the mix that goes on until a share is off by two points of a hundred."""
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), deviation=0.02)[1]


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return repetition.repetitive(table(spark, d, "documents"))


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Documents above the limit with their number of words and the share that repeats."""
    found = repetition.scores(table(spark, d, "documents")).filter((F.col("band") == "repetitive") & (F.col("share") >= repetition.SHARE - 1e-12))
    return found.select("doc_id", "n_words", F.round("share", 9).alias("share"))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    scored = repetition.scores(table(spark, d, "documents"))
    return scored.withColumns({c: F.round(c, 6) for c in ("ratio", "chunk_ratio", "raw_ratio", "share")})


QUERIES = {
    "p3_found": p3_found,
    "p3_split": p3_split,
    "p4_found": p4_found,
    "p4_counts": p4_counts,
    "p5_sample": p5_sample,
    "p5_growth": p5_growth,
    "p6_found": p6_found,
    "p6_links": p6_links,
    "p6_members": p6_members,
    "p6_report": p6_report,
    "p7_found": p7_found,
    "p7_report": p7_report,
    "p7_recall": p7_recall,
    "p7_paraphrases": p7_paraphrases,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p8_extended": p8_extended,
    "p9_found": p9_found,
    "p9_shares": p9_shares,
    "p9_scores": p9_scores,
}
