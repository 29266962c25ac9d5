"""Session settings, the shared folder, and size checks before anything is broadcast."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, Row, SparkSession

# Settings that matter for right results (time zone) or for large runs (adaptive plans).
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM does not compile methods above this size; longer stages run better operator by operator.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Texts may be very long, so that batches for Python are small.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    # Stateful stream operators need a state store with column families.
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
# All intermediates of one process lie under one folder, which a retention rule of the store can drop.
RUN = f"emberline-{uuid.uuid4().hex[:12]}"
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def build_session(name: str = "emberline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the library's settings; ``master`` is only for local runs."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **conf}.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Hand the package to the executors' Python, wherever the driver was started from; once per application."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        # the driver's own folder will do: Spark serves the archive from there; it goes when the process ends
        folder = tempfile.TemporaryDirectory(prefix="emberline-")
        package = os.path.dirname(os.path.abspath(__file__))
        context.addPyFile(shutil.make_archive(f"{folder.name}/package", "zip", os.path.dirname(package), os.path.basename(package)))
        _shipped[context.applicationId] = folder
    return spark


def apply_settings(spark: SparkSession) -> SparkSession:
    """Bring a session that somebody else made to the same settings."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return ship(spark)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local master, where one machine is all there is, may fall back to a temporary folder.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if root:
        return root
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    root = tempfile.mkdtemp(prefix="emberline-")
    context.setCheckpointDir(root)
    return context.getCheckpointDir()


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_folder(spark).rstrip('/')}/{RUN}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str, *partition_by: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage at a table that outlives any executor, so that several consumers of one
    expensive intermediate neither recompute it nor depend on cached blocks.  ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    writer = df.write.mode("error").options(**options)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def rows_within(df: DataFrame, limit: int) -> list[Row] | None:
    """All rows of ``df`` if there are at most ``limit``, otherwise None.

    The check reads at most ``limit + 1`` rows, so that the driver never holds more than that.
    """
    rows = df.limit(limit + 1).collect()
    return rows if len(rows) <= limit else None


def spread(df: DataFrame, rows: int | None = None) -> DataFrame:
    """Spread an input of few splits over all cores before heavy row-wise work.

    Large inputs have more splits than cores and pass unchanged, without a shuffle.  Where a row is short and
    its work long, splits hold too many of them: with ``rows`` there is a task for so many, about, and the
    rows of a file are counted first, which reads its footers.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    if rows is not None:
        tasks = max(tasks, -(-df.count() // rows))
    return df.repartition(tasks) if df.rdd.getNumPartitions() < tasks else df
