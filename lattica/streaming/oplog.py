"""Streaming twins of the operation log and of swarm progress."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import oplog

#: Buckets of authors that a batch of the log lies in.
BUCKETS = 64


def read_ops(spark: SparkSession, folder: str, schema, files_per_trigger: int = 1000) -> DataFrame:
    """Operations that arrive as Parquet files in ``folder``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deduplicated(ops: DataFrame, delay: str = "1 day") -> DataFrame:
    """Each (author, author_seq) once while it comes within ``delay`` of the first; state beyond that is dropped."""
    return ops.withWatermark("created_at", delay).dropDuplicatesWithinWatermark(["author", "author_seq"])


def held_log(spark: SparkSession, log: str) -> DataFrame | None:
    """The operations of a log with the columns that its folders name; None if there are none yet."""
    try:
        return spark.read.parquet(log)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def append_log(ops: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append new operations to the Parquet log: what a batch repeats, or the log holds, is left out.

    Each batch of a query has a folder of its own, with one below it per bucket of authors. A batch that runs again after
    a failure compares itself with the other folders, never with its own, and writes the same rows there again. The
    comparison reads only what can match: of the buckets that the batch has authors of, row groups from its smallest
    author_seq there on. So a new author makes it read one bucket from the start, not the log.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        query = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        bucket = F.pmod(F.xxhash64("author"), F.lit(BUCKETS)).cast("int")
        fresh = oplog.deduplicated(batch).withColumn("author_bucket", bucket)
        held = held_log(spark, log)
        least = fresh.groupBy("author_bucket").agg(F.min("author_seq").alias("least")).collect()  # BUCKETS at most
        if held is not None and least:
            own = (F.col("query") == query) & (F.col("batch") >= number)
            near = [(F.col("author_bucket") == r["author_bucket"]) & (F.col("author_seq") >= r["least"]) for r in least if r["least"] is not None]
            held = held.filter(~own).filter(reduce(or_, near, F.lit(False))).select("author", "author_seq")
            fresh = fresh.join(held, ["author", "author_seq"], "left_anti")
        if least:
            out = fresh.select(*batch.columns, "author_bucket").write.mode("overwrite").partitionBy("author_bucket")
            out.parquet(f"{log}/query={query}/batch={number}")

    return ops.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def version_vector(ops: DataFrame) -> DataFrame:
    """The version vector as it grows; for the update or complete output mode."""
    return oplog.version_vector(ops)


def progress(results: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Results per task and minute; a minute is final when the watermark has passed it."""
    minute = F.window("created_at", "1 minute")
    counted = results.withWatermark("created_at", delay).groupBy("task_id", minute).agg(
        F.count_if("passed").alias("passed"), F.count("*").alias("total")
    )
    return counted.select("task_id", F.col("window.start").alias("minute"), "passed", "total")
