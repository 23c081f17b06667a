import base64
import hashlib
import io

import zstandard

from lattica.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, salt int"


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1) for i, u, h in rows], SCHEMA)


def read(spark, rows, **kw):
    return warc.read_bundles(warc.write_bundles(pages(spark, rows), **kw)).toPandas()


def sha(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


def test_round_trip_with_copies_nulls_and_long_texts(spark):
    long = "é" * 700_000
    rows = [(5, "http://a/1", "same"), (2, "http://a/2", "same"), (9, None, "same"), (1, "u", None), (3, "u\r\nx", ""), (4, "v", long)]
    out = read(spark, rows).set_index("page_id")
    assert len(out) == 6
    assert out.loc[2, "record_type"] == "response" and out.loc[[5, 9], "record_type"].tolist() == ["revisit"] * 2
    assert out.loc[[5, 9], "refers_to"].tolist() == [2, 2]
    assert out.loc[3, "refers_to"] == 1  # null and empty html are equal payloads
    assert out.loc[4, "payload_bytes"] == 1_400_000 and out.loc[4, "payload"].decode() == long
    assert out.loc[5, "payload_digest"] == sha("same") and out.loc[5, "payload_bytes"] == 4


def test_small_payloads_are_all_responses(spark):
    out = read(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], min_bytes=4)
    assert out.set_index("page_id")["record_type"].to_dict() == {1: "response", 2: "response", 3: "response", 4: "revisit"}


def test_repeated_rows_and_null_ids(spark):
    out = read(spark, [(1, "u", "x")] * 3 + [(None, "u", "x"), (None, "u", "y"), (None, "u", "y")])
    one = out[out.page_id == 1]
    assert sorted(one.record_type) == ["response", "revisit", "revisit"]
    unknown = out[out.page_id.isna()]
    assert sorted(unknown.record_type) == ["response", "revisit", "revisit"]
    assert unknown[unknown.payload_digest == sha("x")].refers_to.tolist() == [1]


def test_every_record_can_be_found_by_its_id(spark):
    rows = [(1, "u", "x"), (1, "u", "y"), (None, "u", "x"), (None, "u", "z"), (2, "u", "x")]
    bundles = warc.write_bundles(pages(spark, rows))
    readers = [warc.BundleReader(bytes(r["content"])) for r in bundles.collect()]
    names = [name for reader in readers for name in reader.places]
    assert len(names) == len(set(names)) == 5
    blocks = sorted(warc.parse_record(reader.record(name))[1] for reader in readers for name in reader.places)
    assert blocks == [b"", b"", b"x", b"y", b"z"]
    of = {h["WARC-Refers-To"] for r in readers for h in [warc.parse_record(r.record(n))[0] for n in r.places] if "WARC-Refers-To" in h}
    assert of <= set(names) and len(of) == 1


def test_against_brute_force_broadcast_and_salted(spark, monkeypatch):
    rows = [(i, "u", f"text {i * i % 23}" if i % 3 else "hot") for i in range(1, 300)] + [(500, None, None), (501, "", "")]
    want = {}
    for i, _, html in rows:
        same = [j for j, _, h in rows if (h or "") == (html or "")]
        want[i] = (len((html or "").encode()), sha(html or ""), None if min(same) == i else min(same))
    for limit in (100, 0):
        monkeypatch.setattr(warc, "BROADCAST_DIGESTS", limit)
        out = warc.read_bundles(warc.write_bundles(pages(spark, rows))).collect()
        assert {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["refers_to"]) for r in out} == want
        assert all((r["record_type"] == "revisit") == (r["refers_to"] is not None) for r in out)


def test_empty_table(spark):
    assert len(read(spark, [])) == 0


def test_many_copies_are_spread_and_refer_to_the_smallest(spark):
    out = read(spark, [(i, "u", "copy") for i in range(10, 400)])
    assert (out.record_type == "response").sum() == 1
    assert set(out.refers_to.dropna()) == {10} and out.loc[out.record_type == "response", "page_id"].tolist() == [10]


def test_bundle_is_seekable_and_plain_zstandard(spark, tmp_path):
    bundles = warc.write_bundles(pages(spark, [(i, "u", f"text {i} " * 3000) for i in range(40)]).coalesce(1))
    contents = [bytes(r["content"]) for r in bundles.collect()]
    for content in contents:
        reader = warc.BundleReader(content)
        plain = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(content), read_across_frames=True).read()
        assert plain == b"".join(reader.records())
        name = reader.index[-1][0]
        headers, block = warc.parse_record(reader.record(name))
        assert headers["WARC-Record-ID"] == name and block.startswith(b"text ")
    assert sum(len(warc.BundleReader(c).at) for c in contents) > 1
    index = warc.bundle_index(bundles).toPandas()
    assert len(index) == 40 and index.frame.max() >= 1
    warc.export_bundles(bundles, f"file://{tmp_path}")
    files = spark.read.format("binaryFile").load(f"{tmp_path}/*.warc.zst")
    assert warc.read_bundles(files).count() == 40
