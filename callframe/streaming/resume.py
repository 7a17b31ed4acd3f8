"""Resumable append by id: what a restart has done already is not done again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream_once(spark: SparkSession, source: str, schema, sink: str, checkpoint: str, key: str, partition: str | None = None, transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Append new rows of a folder of Parquet files to a Parquet sink, each key once, and stop.

    The checkpoint remembers files and keys, so a rerun appends only what is new. The state
    holds one key per record; use a key that arrives within a bounded time and a watermark for endless streams.
    """
    rows = spark.readStream.schema(schema).parquet(source).dropDuplicates([key])
    out = transform(rows) if transform else rows
    writer = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True)
    (writer.partitionBy(partition) if partition else writer).start().awaitTermination()


def pending(queue: DataFrame, done: DataFrame, key: str, order: str, start: int = 0, most: int | None = None) -> DataFrame:
    """Batch form: the slice [start, start + most) of the queue (by its 0-based order column) without what is done.

    Done keys that are not in the queue are an error.
    """
    strange = done.join(queue, key, "left_anti").limit(5).collect()
    if strange:
        raise ValueError(f"done but not queued: {[r[key] for r in strange]}")
    cut = queue.filter(F.col(order) >= start)
    cut = cut if most is None else cut.filter(F.col(order) < start + most)
    return cut.join(done.select(key), key, "left_anti")


def generate(requests: DataFrame, backend: Callable[[], Callable[[dict], str]], columns: list[str]) -> DataFrame:
    """requests with raw_prediction and error from a pluggable generator, made once per task.

    A request that the backend fails on keeps its row, with the reason in error.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for frame in frames:
            out, errors = [], []
            for row in frame[columns].to_dict("records"):
                try:
                    out.append(model(row))
                    errors.append(None)
                except Exception as e:  # whatever a backend raises is that row's error
                    out.append(None)
                    errors.append(f"{type(e).__name__}: {e}")
            yield frame.assign(raw_prediction=out, error=errors)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields)
    return requests.mapInPandas(run, f"{fields}, raw_prediction string, error string")
