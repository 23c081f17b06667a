"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; a temporary one only for a local session that sets none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="spark-")


def scratch_dir(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables below :func:`shared_dir`; Spark's exit deletes it."""
    context = spark.sparkContext
    folder = getattr(context, "_lattica_scratch", None)
    if folder is None:
        folder = f"{shared_dir(spark)}/lattica-{context.applicationId}"
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(context._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        context._lattica_scratch = folder
    return folder


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as Parquet to the scratch folder and read back, which cuts its lineage and gives it a known size."""
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Rows that a task sorts or groups, on average, where the number of tasks goes by the number of rows.
TASK_ROWS = 500_000


def tasks_for(spark: SparkSession, rows: int | None) -> int:
    """Tasks of about TASK_ROWS rows, one per core at least, so what a task holds doesn't grow with the table."""
    return max(spark.sparkContext.defaultParallelism, -(-(rows or 0) // TASK_ROWS))
