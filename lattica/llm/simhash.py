"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits: bit b is set if it is set in over half of the hashes of the 3-word shingles. Fingerprints
that differ in 3 bits or fewer agree in one of their two 32-bit segments up to one bit. So each fingerprint is stored
under both segments and looked up under the 33 values of the Hamming ball of radius 1 around each; what is found is
verified over all 64 bits. Texts with equal fingerprints are one entry, so copies cost nothing here.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import HOT_ROWS, hot_join, is_empty, shared_table

SHINGLE_WORDS = 3
MAX_DISTANCE = 3
SEED = 42
SEGMENTS = 2
SEGMENT_BITS = 64 // SEGMENTS
#: Fingerprints with one segment beyond which their lookups are split over several tasks.
SEGMENT_ROWS = 20_000


def fingerprint(text: bytes) -> int:
    """The fingerprint of UTF-8 text. bytes.lower and bytes.split know ASCII alone: A-Z, and the six white spaces."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = list(accumulate(map(len, words), lambda at, size: at + 1 + size))
    starts = [0, *(end + 1 for end in ends[: -SHINGLE_WORDS])]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[SHINGLE_WORDS - 1 :], strict=True)], "<u8")
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    counts = bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint as a signed long) per document; null and empty text have 0."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text")
            values = np.fromiter((fingerprint(t.as_py() or b"") for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(values.view(np.int64))], names)

    names = ["doc_id", "fingerprint"]
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(digest, f"doc_id {id_type}, fingerprint long")


def _segment(column: str, number: int):
    shifted = F.shiftrightunsigned(column, number * SEGMENT_BITS) if number else F.col(column)
    return shifted.bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def links(distinct: DataFrame, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(a, b), a < b: each pair of different fingerprints that differ in ``max_distance`` bits or fewer, once.

    The radius of the balls is ``max_distance // SEGMENTS``, 1 for a distance of 2 or 3 (0 for less). A pair that
    both segments find is kept by the first. The join compares the whole fingerprints as it runs, so it puts out
    links alone, not candidates.
    """
    radius = max_distance // SEGMENTS
    if radius > 1:
        raise ValueError(f"distances over {2 * SEGMENTS - 1} need larger balls")
    flips = [0, *(1 << k for k in range(SEGMENT_BITS))] if radius else [0]
    many = distinct.count() > SEGMENT_ROWS
    found = []
    for number in range(SEGMENTS):
        stored = distinct.select(F.col("fingerprint").alias("b"), _segment("fingerprint", number).alias("key"))
        probes = distinct.select(
            F.col("fingerprint").alias("a"),
            F.explode(F.array(*[F.lit(flip).cast("long") for flip in flips])).alias("flip"),
            _segment("fingerprint", number).alias("key"),
        ).withColumn("key", F.col("key").bitwiseXOR(F.col("flip")))
        hot = stored.groupBy("key").agg(F.ceil(F.count("*") / SEGMENT_ROWS).cast("int").alias("parts")).filter("parts > 1")
        if not many or is_empty(hot := shared_table(hot, "simhash-hot-segments")):
            # The sizes that Spark expects don't count what explode adds, so it must not broadcast the lookups
            pairs = probes.join(stored.hint("merge"), "key")
        else:  # the stored ones of a frequent segment lie in parts, and each part gets all its lookups
            hot = F.broadcast(hot)  # a row per SEGMENT_ROWS fingerprints at most
            parts = F.coalesce("parts", F.lit(1))
            stored = stored.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("b"), parts)).drop("parts")
            probes = probes.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
            probes = probes.drop("parts").withColumn("part", F.col("part").cast("long"))
            pairs = probes.join(stored.hint("merge"), ["key", "part"])
        near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_distance)
        for earlier in range(number):
            near &= F.bit_count(_segment("a", earlier).bitwiseXOR(_segment("b", earlier))) > radius
        found.append(pairs.filter(near).select("a", "b"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _with_smallest(edges: DataFrame, most: int) -> DataFrame:
    """``edges`` (a, b) with m, the smallest of a and its neighbours; ``most`` is a bound of their number."""
    smallest = edges.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    smallest = smallest.withColumn("m", F.least("a", "m"))
    if most <= HOT_ROWS:  # then no node can have more
        return edges.join(smallest.drop("n"), "a")
    smallest = shared_table(smallest, "component-smallest")
    return hot_join(edges, smallest.drop("n"), "a", smallest.filter(F.col("n") > HOT_ROWS))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): root is the smallest node that links reach.

    Large-star and small-star rounds, each a grouping and a join by node, until nothing changes; their number grows
    with the logarithm of the longest chain. Nodes of very many links are joined where their links lie. Each round is
    written to the shared folder, so a lost executor costs no more than the round it is in.
    """
    edges = shared_table(edges.select("a", "b").filter("a != b").distinct(), "component-links")
    before, number = None, edges.count()
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _with_smallest(both, 2 * number).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        if 2 * number > HOT_ROWS:
            down = shared_table(down, "component-large")
        small = _with_smallest(down, 2 * number)
        small = small.select("b", "m").unionByName(small.select(F.col("a").alias("b"), "m"))
        edges = shared_table(small.filter("b != m").distinct().select(F.col("b").alias("a"), F.col("m").alias("b")), "component-round")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
                edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            )
        before, number = state, state[0]


def _rooted(docs: DataFrame, id_col: str, text_col: str, max_distance: int = MAX_DISTANCE) -> DataFrame:
    """(doc_id, fingerprint, root, component_id) per document; root, a fingerprint, tells components apart."""
    prints = shared_table(fingerprints(docs, id_col, text_col), "simhash-prints")
    classes = prints.groupBy("fingerprint").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    classes = shared_table(classes, "simhash-classes")
    roots = shared_table(components(links(classes, max_distance)), "simhash-roots")
    rooted = classes.join(roots, classes["fingerprint"] == roots["node"], "left")
    rooted = rooted.select("fingerprint", "first", F.coalesce("root", "fingerprint").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("n"))
    smallest = shared_table(smallest, "simhash-components")
    named = hot_join(rooted, smallest.drop("n"), "root", smallest.filter(F.col("n") > HOT_ROWS))
    named = shared_table(named.select("fingerprint", "root", "component_id"), "simhash-named")
    joined = hot_join(prints, named, "fingerprint", classes.filter(F.col("n") > HOT_ROWS))
    return joined.select("doc_id", "fingerprint", "root", "component_id")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_distance: int = MAX_DISTANCE
) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hexadecimal digits), component_id (smallest doc_id reachable).

    Texts without words have fingerprint zero and are linked like any other. Rows that repeat an id each get a row.
    A null id never is a component_id, unless all of its component are null. Texts are read to their end, however
    long. An empty table gives no rows. Other columns are ignored, whatever their names.
    """
    rooted = _rooted(docs, id_col, text_col, max_distance)
    return rooted.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def _first_rows(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows of ``docs`` with an id and a fingerprint of ``chosen`` (doc_id, fingerprint), one of each."""
    keyed = docs.select(F.struct(F.struct("*").alias("row"), F.col(id_col).alias("id")).alias("doc_id"), F.col(text_col).alias("text"))
    printed = fingerprints(keyed, "doc_id", "text").select("doc_id.*", "fingerprint")
    same = printed["fingerprint"].eqNullSafe(chosen["fingerprint"]) & printed["id"].eqNullSafe(chosen["doc_id"])
    found = printed.join(chosen, same, "left_semi")
    text = F.col("row").getField(text_col)
    rows = found.groupBy("id", "fingerprint").agg(F.min_by("row", F.coalesce(F.sha2(text, 256), F.lit(""))).alias("row"))
    return rows.select("row.*")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component: that with the smallest id. The columns stay as they are.

    Rows that repeat an id are told apart by their fingerprints: of those with the smallest id of a component the one
    with the smallest fingerprint stays, and of equal ones one. So an id stays more than once if texts that are not
    alike share it. Rows with null id stay one per component without other ids.
    """
    named = shared_table(_rooted(docs, id_col, text_col), "simhash-documents")
    counted = named.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.max(F.col("doc_id") == F.col("component_id")).alias("kept")
    )
    # Only ids that go, or that are there more than once, are joined to the texts.
    special = counted.filter("doc_id IS NOT NULL AND (n > 1 OR NOT kept)").select("doc_id", "kept")
    special = shared_table(special, "simhash-special")
    # Conditions name columns by their tables, so columns of docs may have any names
    with_id = docs.filter(docs[id_col].isNotNull())
    kept = with_id.join(special, with_id[id_col] == special["doc_id"], "left_anti")

    def one_of_each(rows: DataFrame) -> DataFrame:
        return rows.groupBy("root").agg(F.min("doc_id").alias("doc_id"), F.min("fingerprint").alias("fingerprint"))

    twice = special.filter("kept").select("doc_id")
    if not is_empty(twice):
        repeated = with_id.join(twice, with_id[id_col] == twice["doc_id"], "left_semi")
        smallest = named.filter("doc_id = component_id").join(twice, "doc_id", "left_semi")
        chosen = shared_table(one_of_each(smallest), "simhash-chosen")
        kept = kept.unionByName(_first_rows(repeated, chosen, id_col, text_col))
    alone = named.filter("doc_id IS NULL AND component_id IS NULL")
    if not is_empty(alone):
        chosen = shared_table(one_of_each(alone), "simhash-nameless")
        kept = kept.unionByName(_first_rows(docs.filter(docs[id_col].isNull()), chosen, id_col, text_col))
    return kept
