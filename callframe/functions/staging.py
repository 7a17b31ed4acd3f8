"""Cut lineage with tables written in the shared folder of the cluster."""

from __future__ import annotations

import atexit
import io
import os
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_STAGED: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Only in local mode (one machine, as in tests) may it be unset: then one below the working directory.

    On a cluster it must be set, since only the cluster knows a folder that all machines share.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        named = "file://" + os.path.join(os.getcwd(), "spark-warehouse", "shared")
    return named.rstrip("/")


def stage(df: DataFrame, name: str = "stage", by: str | None = None) -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back.

    The copy is held by the shared storage, not by executors, so losing one costs
    only the tasks that ran on it. `by` keeps each value of a column in a folder of its own. The
    table is removed by `release`, at the latest when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/callframe-{name}-{uuid.uuid4().hex}"
    out = df.write.option("compression", "zstd")
    (out.partitionBy(by) if by else out).parquet(path)
    if not _STAGED:
        atexit.register(release, spark, True)
    _STAGED[path] = spark.sparkContext.applicationId
    kept = spark.read.schema(df.schema).parquet(path)
    return kept.select(df.columns) if by else kept


def release(spark: SparkSession, ending: bool = False) -> None:
    """Remove the tables staged so far; call it between jobs of a long session, when their results have been written."""
    for path in [p for p in _STAGED if ending or not p.endswith("-package")]:
        del _STAGED[path]
        _remove(spark, path)


def put(spark: SparkSession, path: str, data: bytes) -> None:
    """Write a small file in any file system that the cluster knows."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once a session, as a zip in the shared folder."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(os.path.join(root, "callframe")):
            for n in sorted(names):
                if n.endswith(".py"):
                    z.write(os.path.join(folder, n), os.path.relpath(os.path.join(folder, n), root))
    path = f"{shared_dir(spark)}/callframe-{context.applicationId}-{uuid.uuid4().hex}-package/callframe.zip"
    put(spark, path, held.getvalue())
    context.addPyFile(path if "://" in path else f"file://{path}")
    _SHIPPED.add(context.applicationId)
    _STAGED[path.rsplit("/", 1)[0]] = context.applicationId


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone already
        pass


def partitions(df: DataFrame) -> int:
    """Splits that the scans below df have in all, from the plan alone: nothing is run, whatever stands above them."""
    leaves = df._jdf.queryExecution().sparkPlan().collectLeaves()
    return sum(leaves.apply(i).execute().getNumPartitions() for i in range(leaves.size()))


def spread(df: DataFrame) -> DataFrame:
    """df in at least as many partitions as there are cores, for work that Python does row by row.

    Only inputs of fewer splits than cores are moved (a file of one row group cannot be
    split), so what is shuffled is bounded by cores times the split size. Meant for narrow
    plans over files, whose splits are known without running anything.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if partitions(df) < cores else df
