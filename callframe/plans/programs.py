"""Queries that run whole programs of `pipelines` over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callframe.plans import checks_sql, evaluation, pipelines
from callframe.sources.tables import table


def _scored(spark: SparkSession, d: str, run: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Evaluation of one run; lines stand for samples, since a sample_id is delivered several times."""
    by_line = lambda rows: rows.withColumn("sample_id", F.col("line_number").cast("string"))
    made = by_line(evaluation.predictions(spark, d, run)).select("sample_id", "raw_prediction")
    return pipelines.evaluate(made, by_line(table(spark, d, "canonical_samples")))


def evaluated_run(spark: SparkSession, d: str) -> DataFrame:
    """Summary of an evaluation from its inputs on."""
    return _scored(spark, d, 0)[1]


def compared_runs(spark: SparkSession, d: str) -> DataFrame:
    """Transitions between two evaluations, overall and by kind of answer."""
    return pipelines.compare_runs(_scored(spark, d, 0)[0], _scored(spark, d, 1)[0])["transitions"]


def prepared_status(spark: SparkSession, d: str) -> DataFrame:
    """Contract status of the samples that the preparation of training data starts from."""
    return pipelines.prepare(table(spark, d, "canonical_samples"), table(spark, d, "heldout_tools"))["status"]


def audited_issues(spark: SparkSession, d: str) -> DataFrame:
    """Number of calls for each issue of a whole audit."""
    return pipelines.audit(table(spark, d, "tool_call_parses"), table(spark, d, "canonical_samples"))[1]


QUERIES = {f.__name__: f for f in (evaluated_run, compared_runs, prepared_status, audited_issues)}

ORACLES = {
    "evaluated_run": evaluation.ORACLES["score_summary"],
    "compared_runs": evaluation.ORACLES["transitions"].replace("SELECT source, call_kind, count(*) AS samples", "SELECT call_kind, count(*) AS samples").replace("ROLLUP (source, call_kind)", "ROLLUP (call_kind)"),
    "prepared_status": checks_sql.ORACLES["validation_summary"],
    "audited_issues": f"WITH a AS ({checks_sql.ORACLES['audit_calls']}) SELECT issue, count(*) AS calls FROM (SELECT unnest(string_split(issues, ',')) AS issue FROM a WHERE issues <> '') GROUP BY 1",
}
