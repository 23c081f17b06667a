"""The fold of an operation log kept up batch by batch.

The state of the nodes lies in buckets by node id. A batch of operations is folded to states of its own, which are merged
with the buckets that they touch; only these are written again, in a folder of the batch. A manifest per batch
says which batch wrote each bucket last and is written when all buckets are, so readers see whole batches. Merging the
same operations again changes nothing, so a batch that runs again after a failure does no harm.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lattica.operators import oplog
from lattica.tables import written

BUCKETS = 256
_CLOCK = "struct<lamport_ts: bigint, author: string, author_seq: bigint>"
_VALUE = f"struct<clock: {_CLOCK}, value: string>"
STATE = f"node_id string, inserted {_CLOCK}, deleted {_CLOCK}, kind {_VALUE}, content {_VALUE}, parent_id {_VALUE}, position {_VALUE}"


def bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("node_id"), F.lit(buckets)).cast("int")


def newest_batch(spark: SparkSession, folder: str) -> int:
    """The last batch whose manifest is written; -1 without any."""
    try:
        newest = spark.read.schema("bucket int, written long, batch long").parquet(f"{folder}/manifest").agg(F.max("batch")).first()[0]
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        newest = None
    return -1 if newest is None else newest


def manifest(spark: SparkSession, folder: str) -> dict[int, int]:
    """{bucket: the batch that wrote it last} of the newest manifest, a row per bucket; empty if there is none yet."""
    newest = newest_batch(spark, folder)
    if newest < 0:
        return {}
    rows = spark.read.schema("bucket int, written long").parquet(f"{folder}/manifest/batch={newest}")
    return {row["bucket"]: row["written"] for row in rows.collect()}


def _read(spark: SparkSession, folder: str, chosen: dict[int, int]) -> DataFrame:
    """The state in the ``chosen`` buckets; the filter is on folders, so no other files are read."""
    if not chosen:
        return spark.createDataFrame([], STATE)
    batches: dict[int, list[int]] = {}
    for number, batch in chosen.items():
        batches.setdefault(batch, []).append(number)
    wanted = F.lit(False)
    for batch, numbers in batches.items():
        wanted = wanted | ((F.col("batch") == batch) & F.col("bucket").isin(numbers))
    paths = [f"{folder}/state/batch={batch}" for batch in batches]
    rows = spark.read.schema(f"{STATE}, batch long, bucket int").option("basePath", f"{folder}/state").parquet(*paths)
    return rows.filter(wanted).drop("batch", "bucket")


def merge(ops: DataFrame, folder: str, batch: int, buckets: int = BUCKETS) -> list[int]:
    """Fold ``ops`` into the state in ``folder`` as batch ``batch``; the buckets that were written again.

    Batches must grow: one that isn't beyond the newest was merged before, and nothing is done. Reads the operations and
    the buckets that they touch, nothing else. A folder keeps its number of buckets.
    """
    spark = ops.sparkSession
    if batch <= newest_batch(spark, folder):
        return []
    delta = oplog.node_state(ops).withColumn("bucket", bucket(buckets))
    delta = written(delta.repartition("bucket"), "fold-delta")
    touched = sorted(row["bucket"] for row in delta.select("bucket").distinct().collect())
    held = manifest(spark, folder)
    old = _read(spark, folder, {number: held[number] for number in touched if number in held})
    state = oplog.merged_state(delta.drop("bucket").unionByName(old)).withColumn("bucket", bucket(buckets))
    state.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{folder}/state/batch={batch}")
    now = held | dict.fromkeys(touched, batch)
    rows = spark.createDataFrame(list(now.items()), "bucket int, written long").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{folder}/manifest/batch={batch}")
    return touched


def state(spark: SparkSession, folder: str) -> DataFrame:
    """The state that the newest manifest names."""
    return _read(spark, folder, manifest(spark, folder))


def nodes(spark: SparkSession, folder: str) -> DataFrame:
    """The nodes that all merged operations leave."""
    return oplog.nodes_of(state(spark, folder))


def vacuum(spark: SparkSession, folder: str) -> int:
    """Delete bucket folders that the newest manifest doesn't name, once nobody reads earlier ones; how many went."""
    held = manifest(spark, folder)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/state/batch=*/bucket=*")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    gone = 0
    for found in files.globStatus(path) or []:
        place = found.getPath()
        number, batch = (int(p.getName().split("=")[1]) for p in (place, place.getParent()))
        if held.get(number) != batch:
            gone += files.delete(place, True)
    return gone


def keep_folded(ops: DataFrame, folder: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Fold a stream of operations into ``folder`` as it arrives."""

    def fold(rows: DataFrame, number: int) -> None:
        merge(rows, folder, number, buckets)

    return ops.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
