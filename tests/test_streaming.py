"""Streams of operations: numbers that survive restarts, and the fold that is kept up batch by batch."""

import random

import pytest
from pyspark.sql import functions as F

from lattica.operators import oplog
from lattica.streaming import clock, fold

REQUESTS = "author string, arrived long, lamport_ts long, op_type string"
OPS = "id long, op_type string, node_id string, author string, author_seq long, lamport_ts long, payload string"


def numbered(rows, vector=None, start=0):
    """(author, arrived): (author_seq, lamport_ts) by going through each author's rows one by one."""
    made, time, out = dict(vector or {}), {}, {}
    for author, arrived, seen, *_ in sorted(rows, key=lambda r: r[1]):
        if seen is None:
            made[author] = made.get(author, 0) + 1
            time[author] = time.get(author, start) + 1
            out[author, arrived] = (made[author], time[author])
        else:
            time[author] = max(time.get(author, start), seen)
    return out


def requests(seed, n=80, first=0):
    draw = random.Random(seed)
    return [(draw.choice("abbb"), first + k, draw.choice([None, None, None, draw.randrange(120)]), "insert_node") for k in range(n)]


def found(df):
    return {(r["author"], r["arrived"]): (r["author_seq"], r["lamport_ts"]) for r in df.collect()}


def test_assigned_numbers_equal_a_count_one_by_one(spark):
    log = spark.createDataFrame([(1, "x", "n", "a", 4, 30, "{}"), (2, "x", "n", "z", 9, 41, "{}")], OPS)
    rows = requests(1)
    assert found(oplog.assigned(spark.createDataFrame(rows, REQUESTS), log)) == numbered(rows, {"a": 4, "z": 9}, 41)
    assert found(oplog.assigned(spark.createDataFrame(rows, REQUESTS), log.limit(0))) == numbered(rows)


@pytest.fixture
def rocksdb(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", clock.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_a_stream_goes_on_gapless_after_a_crash(spark, tmp_path, rocksdb):
    source, log, checkpoint = (f"file://{tmp_path}/{name}" for name in ("source", "log", "checkpoint"))
    fail = [True]

    def sink(batch, number):
        if number == 1 and fail:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{log}/batch={number}")

    def run():
        stream = spark.readStream.schema(REQUESTS).parquet(source)
        query = clock.assigned(stream).writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
        query.trigger(availableNow=True).start().awaitTermination()

    first, second = requests(2, 60), requests(3, 60, first=100)
    spark.createDataFrame(first, REQUESTS).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame(second, REQUESTS).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="lost"):
        run()
    fail.clear()
    run()
    assert found(spark.read.parquet(log)) == numbered(first + second)


def test_a_stream_begins_where_a_log_ends(spark, tmp_path, rocksdb):
    rows = [(a, k, None, "x") for k, a in enumerate("aabab")]
    log = spark.createDataFrame([(k, "x", "n", a, k, k * 10, "{}") for k, a in ((3, "a"), (2, "b"))], OPS)
    spark.createDataFrame(rows, REQUESTS).write.parquet(f"{tmp_path}/source")
    stream = spark.readStream.schema(REQUESTS).parquet(f"{tmp_path}/source")
    query = clock.assigned(stream, log).writeStream.format("memory").queryName("begun").option("checkpointLocation", f"{tmp_path}/c")
    query.trigger(availableNow=True).start().awaitTermination()
    assert found(spark.table("begun")) == numbered(rows, {"a": 3, "b": 2}, 30)


def operations(seed, n, first=0):
    draw = random.Random(seed)
    kinds = ("insert_node", "update_content", "move_node", "delete_node")
    payload = '{{"kind":"k{0}","content":"c{0}","new_content":"n{0}","parent_id":"p{1}","new_parent_id":"q{1}","position":"{1}"}}'
    return [
        (k, draw.choice(kinds), f"n{draw.randrange(12)}", draw.choice("ab"), k, draw.randrange(50), payload.format(k, k % 4))
        for k in range(first, first + n)
    ]


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "kind", "content", "parent_id", "position").collect())


def test_the_kept_fold_equals_the_whole_fold_and_reads_what_it_touches(spark, tmp_path):
    folder, log = f"file://{tmp_path}/state", []
    assert fold.nodes(spark, folder).count() == 0
    for batch in range(3):
        new = operations(batch, 15, first=batch * 15)
        log += new
        touched = fold.merge(spark.createDataFrame(new, OPS), folder, batch, buckets=32)
        assert rows(fold.nodes(spark, folder)) == rows(oplog.fold_nodes(spark.createDataFrame(log, OPS)))
        assert {k for k, b in fold.manifest(spark, folder).items() if b == batch} == set(touched)
    before = rows(fold.nodes(spark, folder))
    assert fold.merge(spark.createDataFrame(log, OPS), folder, 2) == []  # merged before
    fold.merge(spark.createDataFrame(log[:20], OPS), folder, 3, buckets=32)  # operations come again
    assert rows(fold.nodes(spark, folder)) == before
    # one node: only the files of its bucket are read
    one = spark.createDataFrame([(99, "delete_node", "n3", "a", 99, 99, "{}")], OPS)
    number = one.select(fold.bucket(32)).first()[0]
    assert fold.merge(one, folder, 4, buckets=32) == [number]
    read = fold._read(spark, folder, {number: 4})
    assert {f.split("/")[-3:-1] == ["batch=4", f"bucket={number}"] or f for f in read.inputFiles()} == {True}
    assert "n3" not in {r[0] for r in rows(fold.nodes(spark, folder))}
    kept = rows(fold.nodes(spark, folder))
    assert fold.vacuum(spark, folder) > 0 and rows(fold.nodes(spark, folder)) == kept and fold.vacuum(spark, folder) == 0


def test_a_stream_is_folded_as_it_arrives(spark, tmp_path):
    source, folder = f"file://{tmp_path}/source", f"file://{tmp_path}/state"
    log = []
    for k in range(2):
        log += operations(k + 7, 20, first=k * 20)
        spark.createDataFrame(log[-20:], OPS).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(OPS).parquet(source)
        fold.keep_folded(stream, folder, f"file://{tmp_path}/checkpoint", buckets=8).awaitTermination()
        assert rows(fold.nodes(spark, folder)) == rows(oplog.fold_nodes(spark.createDataFrame(log, OPS)))
    assert spark.read.parquet(f"{folder}/manifest").agg(F.count_distinct("batch")).first()[0] == 2
