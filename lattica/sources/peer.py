"""The operation log of a peer as a Python data source: batch and stream readers that go by version vectors.

A peer publishes its log below a folder that others can read: ``ops/batch=N/bucket=B`` holds operations, and
``vector/batch=N``, written after them, holds how far each author has come with the batch. Only batches whose vector is
complete are read. A folder has one publisher at a time; a batch that was cut short is written again under its number.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lattica.operators import oplog
from lattica.streaming.oplog import held_log
from lattica.tables import written

#: The name under which the source is registered.
FORMAT = "oplog_peer"
#: Authors that a vector may have in an offset, which the driver and the checkpoint hold; beyond it vectors are joined.
MAX_AUTHORS = 100_000
#: Parts of a batch that authors are dealt to.
BUCKETS = 64
SCHEMA = "id long, op_type string, node_id string, author string, author_seq long, lamport_ts long, payload string"


# Publishing


def _last_batch(spark: SparkSession, folder: str) -> int:
    held = held_log(spark, f"{folder}/vector")
    return 0 if held is None else held.agg(F.coalesce(F.max("batch"), F.lit(0))).first()[0]


def publish(ops: DataFrame, folder: str, buckets: int = BUCKETS) -> int:
    """Add ``ops`` (author, author_seq, ...) to the log of a peer as its next batch; the batch's number.

    Rows lie in ranges of bucket, author and author_seq, so one author's many operations are several tasks' work and a
    reader skips row groups. Operations without author or author_seq name no place in a log and are left out.
    """
    number = _last_batch(ops.sparkSession, folder) + 1
    order = ["bucket", "author", "author_seq"]
    placed = ops.filter("author IS NOT NULL AND author_seq IS NOT NULL").withColumn("bucket", F.pmod(F.xxhash64("author"), F.lit(buckets)))
    placed = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    path = f"{folder}/ops/batch={number}"
    placed.write.mode("overwrite").partitionBy("bucket").parquet(path)
    added = ops.sparkSession.read.schema(placed.schema).parquet(path)
    oplog.version_vector(added).write.mode("overwrite").parquet(f"{folder}/vector/batch={number}")
    return number


def operations(spark: SparkSession, folder: str) -> DataFrame | None:
    """All operations that a peer has published, with ``batch`` and ``bucket``; None if there are none."""
    ops, last = held_log(spark, f"{folder}/ops"), _last_batch(spark, folder)
    return None if ops is None or not last else ops.filter(F.col("batch") <= last)


def vector(spark: SparkSession, folder: str) -> DataFrame:
    """The version vector of a peer: (author, max_seq)."""
    held = held_log(spark, f"{folder}/vector")
    if held is None:
        return spark.createDataFrame([], "author string, max_seq long")
    return held.groupBy("author").agg(F.max("max_seq").alias("max_seq"))


# Reading


@dataclass
class Span(InputPartition):
    """One file of a log, and of which authors what is wanted: beyond ``since`` and up to ``until``, where they name one."""

    path: str
    since: dict[str, int] | None = None
    until: dict[str, int] | None = None


class Folder:
    """What a peer has published, as files in any store that Arrow reaches by its URI."""

    def __init__(self, path: str) -> None:
        self.path = path if "://" in path else "file://" + path.removeprefix("file:")

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path)

    def batches(self, after: int = 0) -> list[int]:
        """The numbers of complete batches beyond ``after``."""
        store, root = self._open()
        found = store.get_file_info(fs.FileSelector(f"{root}/vector", allow_not_found=True))
        numbers = [int(f.base_name.removeprefix("batch=")) for f in found if f.base_name.startswith("batch=")]
        done = {n: store.get_file_info(f"{root}/vector/batch={n}/_SUCCESS").is_file for n in numbers if n > after}
        return sorted(n for n, complete in done.items() if complete)

    def advance(self, held: dict[str, int], batches: list[int]) -> dict[str, int]:
        """``held`` with what batches add."""
        store, root = self._open()
        out = dict(held)
        for number in batches:
            table = ds.dataset(f"{root}/vector/batch={number}", filesystem=store, format="parquet")
            for batch in table.to_batches(columns=["author", "max_seq"]):
                for author, most in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    out[author] = max(most, out.get(author, 0))
            if len(out) > MAX_AUTHORS:
                raise ValueError(f"the log has over {MAX_AUTHORS} authors: join the vectors, as pull() does")
        return out

    def files(self, batches: list[int]) -> list[str]:
        store, root = self._open()
        chosen = []
        for number in batches:
            found = store.get_file_info(fs.FileSelector(f"{root}/ops/batch={number}", recursive=True, allow_not_found=True))
            chosen += sorted(f.path for f in found if f.is_file and f.extension == "parquet")
        return chosen

    def read(self, span: Span, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        """The wanted rows of a file. ``since`` and ``until`` of the span are by author; None is no limit."""
        store, _ = self._open()
        since, until = span.since or {}, span.until
        wanted = None
        if until is not None:  # only the authors that moved
            least = min((since.get(a, 0) for a in until), default=0)
            wanted = ds.field("author").isin(list(until)) & (ds.field("author_seq") > least)
        table = ds.dataset(span.path, filesystem=store, format="parquet")
        columns = [n for n in schema.names if n in table.schema.names]
        for batch in table.to_batches(columns=list(dict.fromkeys([*columns, "author", "author_seq"])), filter=wanted):
            beyond = pc.greater(batch.column("author_seq"), _limits(batch.column("author"), since, 0))
            if until is not None:
                beyond = pc.and_(beyond, pc.less_equal(batch.column("author_seq"), _limits(batch.column("author"), until, 0)))
            batch = batch.filter(beyond)
            if batch.num_rows:
                held = {n: batch.column(n).cast(schema.field(n).type, safe=False) for n in columns}
                yield pa.RecordBatch.from_arrays(
                    [held.get(n, pa.nulls(batch.num_rows, schema.field(n).type)) for n in schema.names], schema=schema
                )


def _limits(authors: pa.Array, limits: dict[str, int], default: int) -> pa.Array:
    """The limit of each author."""
    coded = authors.dictionary_encode()
    each = pa.array([limits.get(a, default) for a in coded.dictionary.to_pylist()], pa.int64())
    return each.take(coded.indices)


def _schema(schema: StructType) -> pa.Schema:
    return to_arrow_schema(schema)


class PeerReader(DataSourceReader):
    """What a peer has beyond ``since``, a task per file."""

    def __init__(self, path: str, since: dict[str, int], schema: StructType) -> None:
        self.folder, self.since, self.schema = Folder(path), since, _schema(schema)

    def partitions(self) -> list[Span]:
        """The files of the batches that bring some author further."""
        ahead = [n for n in self.folder.batches() if any(m > self.since.get(a, 0) for a, m in self.folder.advance({}, [n]).items())]
        return [Span(path) for path in self.folder.files(ahead)]

    def read(self, partition: Span | None) -> Iterator[pa.RecordBatch]:
        if partition is not None:
            yield from self.folder.read(Span(partition.path, self.since), self.schema)


class PeerStreamReader(DataSourceStreamReader):
    """The operations that a peer goes on to publish; an offset is a version vector and the batch that it was reached with."""

    def __init__(self, path: str, since: dict[str, int], schema: StructType) -> None:
        self.folder, self.since, self.schema = Folder(path), since, _schema(schema)
        self.seen = {"batch": 0, "vector": dict(since)}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"batch": 0, "vector": dict(self.since)}

    def latestOffset(self) -> dict:  # noqa: N802
        new = self.folder.batches(self.seen["batch"])
        if new:
            self.seen = {"batch": new[-1], "vector": self.folder.advance(self.seen["vector"], new)}
        return self.seen

    def partitions(self, start: dict, end: dict) -> list[Span]:
        since, until = start["vector"], end["vector"]
        moved = {a: n for a, n in until.items() if n > since.get(a, 0)}
        if not moved:
            return []
        behind = {a: since.get(a, 0) for a in moved}
        numbers = [n for n in self.folder.batches(start["batch"]) if n <= end["batch"]]
        return [Span(path, behind, moved) for path in self.folder.files(numbers)]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        return self.folder.read(partition, self.schema)


class PeerSource(DataSource):
    """``oplog_peer``: options ``path``, the folder of a peer, and ``since``, a version vector as JSON.

    Columns that a file lacks are null; columns that the schema lacks aren't read.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def _since(self) -> dict[str, int]:
        return {a: int(n) for a, n in json.loads(self.options.get("since", "{}")).items()}

    def reader(self, schema: StructType) -> PeerReader:
        return PeerReader(self.options["path"], self._since(), schema)

    def streamReader(self, schema: StructType) -> PeerStreamReader:  # noqa: N802
        return PeerStreamReader(self.options["path"], self._since(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PeerSource)


# Exchange


def _few(vector: DataFrame) -> bool:
    return vector.limit(MAX_AUTHORS + 1).count() <= MAX_AUTHORS


def pull(spark: SparkSession, folder: str, seen: DataFrame, schema: str | StructType = SCHEMA) -> DataFrame:
    """The operations that a peer has beyond the version vector ``seen`` (author, max_seq), each once.

    Vectors of up to MAX_AUTHORS go through the data source, which reads only batches that bring an author further;
    larger ones are joined with the peer's log. Both give the same rows.
    """
    seen = written(seen.select("author", "max_seq").filter("author IS NOT NULL"), "peer-vector")
    if _few(seen) and _few(vector(spark, folder)):
        register(spark)
        since = json.dumps({r["author"]: r["max_seq"] for r in seen.collect()})  # MAX_AUTHORS at most
        found = spark.read.format(FORMAT).schema(schema).option("path", folder).option("since", since).load()
    else:
        ops = operations(spark, folder)
        if ops is None:
            return spark.createDataFrame([], schema)
        behind = ops.join(seen.withColumnRenamed("max_seq", "seen"), "author", "left").filter("author_seq > coalesce(seen, 0)")
        names = spark.createDataFrame([], schema).columns
        found = behind.select(*[F.col(n) for n in names])
    return found.dropDuplicates(["author", "author_seq"])


def sync(spark: SparkSession, mine: str, theirs: str, schema: str | StructType = SCHEMA) -> dict[str, int]:
    """Pull from a peer and push to it what either log lacks; how many operations went each way.

    What goes either way is found before any is published and each way is one batch, so a run that was cut short can
    be repeated: it finds what is still missing.
    """
    ours, peers = written(vector(spark, mine), "peer-ours"), written(vector(spark, theirs), "peer-theirs")
    pulled = written(pull(spark, theirs, ours, schema), "peer-pulled")
    pushed = written(pull(spark, mine, peers, schema), "peer-pushed")
    counts = {"pulled": pulled.count(), "pushed": pushed.count()}
    if counts["pulled"]:
        publish(pulled, mine)
    if counts["pushed"]:
        publish(pushed, theirs)
    return counts
