"""The log of a peer as a data source: exactly what is missing, resumed streams, exchange in both directions."""

import random

import pytest

from lattica.operators import oplog
from lattica.sources import peer


def ops(seed, authors, first, last):
    draw = random.Random(seed)
    return [(s * 10, draw.choice(["insert_node", "move_node"]), f"n{s}", a, s, s + 3, None) for a in authors for s in range(first, last + 1)]


def frame(spark, rows):
    return spark.createDataFrame(rows, peer.SCHEMA)


def keys(df):
    return sorted((r["author"], r["author_seq"]) for r in df.select("author", "author_seq").collect())


@pytest.mark.parametrize("most", [peer.MAX_AUTHORS, 1])
def test_pull_gives_what_to_pull_gives(spark, tmp_path, monkeypatch, most):
    monkeypatch.setattr(peer, "MAX_AUTHORS", most)
    folder = f"file://{tmp_path}/peer"
    theirs = ops(1, "abc", 1, 20) + ops(2, "d", 1, 5)
    assert peer.publish(frame(spark, theirs[:40] + theirs[:3]), folder) == 1  # rows come twice
    assert peer.publish(frame(spark, theirs[40:] + [(0, "x", "n", None, 3, 1, None), (0, "x", "n", "a", None, 1, None)]), folder) == 2
    mine = frame(spark, ops(1, "a", 1, 20) + ops(1, "b", 1, 7) + ops(1, "z", 1, 2))
    found = peer.pull(spark, folder, oplog.version_vector(mine))
    want = oplog.to_pull(mine, frame(spark, theirs))
    assert keys(found) == keys(want)
    assert sorted(map(tuple, found.collect()), key=str) == sorted(map(tuple, want.select(*found.columns).collect()), key=str)
    assert keys(peer.pull(spark, folder, oplog.version_vector(frame(spark, theirs)))) == []


def test_only_batches_that_bring_an_author_further_are_read(spark, tmp_path):
    folder = f"file://{tmp_path}/peer"
    for k in range(3):
        peer.publish(frame(spark, ops(k, "ab", k * 10 + 1, k * 10 + 10)), folder)
    reader = peer.PeerReader(folder, {"a": 20, "b": 20}, frame(spark, []).schema)
    assert {p.path.split("batch=")[1][0] for p in reader.partitions()} == {"3"}
    assert peer.PeerReader(folder, {"a": 30, "b": 30}, frame(spark, []).schema).partitions() == []


def test_an_unfinished_batch_is_not_read_and_written_again(spark, tmp_path):
    folder = f"file://{tmp_path}/peer"
    frame(spark, ops(1, "a", 1, 3)).selectExpr("*", "1 AS bucket").write.partitionBy("bucket").parquet(f"{folder}/ops/batch=1")
    nothing = peer.vector(spark, folder)
    assert nothing.count() == 0 and keys(peer.pull(spark, folder, nothing)) == []
    assert peer.publish(frame(spark, ops(1, "a", 1, 5)), folder) == 1
    assert keys(peer.pull(spark, folder, nothing)) == [("a", k) for k in range(1, 6)]


def test_a_stream_goes_on_where_it_stopped(spark, tmp_path):
    folder, out = f"file://{tmp_path}/peer", f"file://{tmp_path}/out"
    peer.register(spark)

    def run():
        stream = spark.readStream.format(peer.FORMAT).option("path", folder).option("since", '{"a": 4}').load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"file://{tmp_path}/c")
        query.trigger(availableNow=True).start().awaitTermination()
        return keys(spark.read.schema(peer.SCHEMA).parquet(out))

    peer.publish(frame(spark, ops(1, "ab", 1, 6)), folder)
    first = [("a", 5), ("a", 6)] + [("b", k) for k in range(1, 7)]
    assert run() == first
    assert run() == first  # nothing new
    peer.publish(frame(spark, ops(2, "b", 5, 9) + ops(2, "c", 1, 1)), folder)  # two of b come again
    assert run() == first + [("b", 7), ("b", 8), ("b", 9), ("c", 1)]


def test_sync_leaves_both_with_all(spark, tmp_path):
    mine, theirs = f"file://{tmp_path}/mine", f"file://{tmp_path}/theirs"
    peer.publish(frame(spark, ops(1, "a", 1, 9) + ops(1, "b", 1, 2)), mine)
    peer.publish(frame(spark, ops(1, "a", 1, 4) + ops(1, "b", 1, 6) + ops(1, "c", 1, 3)), theirs)
    assert peer.sync(spark, mine, theirs) == {"pulled": 7, "pushed": 5}
    assert peer.sync(spark, mine, theirs) == {"pulled": 0, "pushed": 0}
    everything = keys(frame(spark, ops(1, "a", 1, 9) + ops(1, "b", 1, 6) + ops(1, "c", 1, 3)))
    assert keys(peer.operations(spark, mine)) == everything == keys(peer.operations(spark, theirs))
    assert peer.sync(spark, f"file://{tmp_path}/new", theirs) == {"pulled": 18, "pushed": 0}
