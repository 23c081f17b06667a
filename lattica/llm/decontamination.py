"""Benchmark decontamination: a broadcast set of normalised test n-grams, scanned over the windows of all documents.

Words are runs of ASCII letters and digits and of any other characters beyond ASCII, with A-Z in lower case. A window
is ``n`` consecutive words of a benchmark item; an item of fewer words, but not none, is one window. A document word
is hit if it lies in an occurrence of a window.

The items are broadcast while their texts and windows are few (``Bounds``); each task makes its window set of them.
Beyond that documents are scanned against a Bloom filter of the windows' keys, of fixed size, and what passes it is
joined to the windows and verified, see :func:`joined_hits`.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import HOT_ROWS, is_empty, shared_table, slices

N = 10
#: Bits of the Bloom filter of the joined form: 16 MB.
BLOOM_BITS = 1 << 27
#: Parts that the occurrences of a hot window are joined in.
SALTS = 64
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = re.compile(WORD)
_LOWER = str.maketrans(UPPER, LOWER)
#: Words that are scanned at a time.
CHUNK_WORDS = 1 << 19


@dataclass(frozen=True)
class Bounds:
    """Up to how many windows, and bytes of item texts, the items are broadcast."""

    windows: int = 1_000_000
    bytes: int = 32 << 20


def words(text: str) -> list[str]:
    return _WORDS.findall(text.translate(_LOWER))


def words_column(text: Column) -> Column:
    """The words of a text; null has none."""
    lowered = F.translate(text, UPPER, LOWER)
    return F.coalesce(F.regexp_extract_all(lowered, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _items(benchmark: DataFrame, n: int) -> DataFrame:
    """(item_id, text, windows) of the distinct items; windows is how many an item has."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").filter("text IS NOT NULL").distinct()
    count = F.size(words_column(F.col("text")))
    return items.withColumn("windows", F.when(count > 0, F.greatest(count - n + 1, F.lit(1))).otherwise(0))


def _few(items: DataFrame, bounds: Bounds) -> bool:
    total = items.agg(F.coalesce(F.sum("windows"), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return total[0] <= bounds.windows and total[1] <= bounds.bytes


def item_windows(items: DataFrame, n: int = N) -> DataFrame:
    """(item_id, window): every distinct window of each item, its words with a space between. Null texts have none."""
    split = items.select("item_id", words_column(F.col("text")).alias("w")).filter(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - n + 1, F.lit(1)))
    exploded = split.select("item_id", "w", F.explode(starts).alias("start"))
    window = F.array_join(F.slice("w", F.col("start"), n), " ").alias("window")
    return exploded.select("item_id", F.least(F.size("w"), F.lit(n)).alias("length"), window).distinct()


FACTOR = np.uint64(0x9E3779B97F4A7C15)


def rolling(ids: np.ndarray, length: int, starts: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of ``length`` ids, or of those at ``starts``."""
    mixed = ids.astype(np.uint64)
    starts = np.arange(max(0, len(ids) - length + 1)) if starts is None else starts
    out = np.zeros(len(starts), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(length):
            out = out * FACTOR + mixed[starts + k]
    return out


class WindowSet:
    """Finds the occurrences of the items' windows in runs of words, many documents at a time.

    The items lie one after the other in one array of word numbers; a window is a place in it. Windows are sorted by
    their hashes, and what has a window's hash is compared with it word by word.
    """

    def __init__(self, items: list[tuple[str | None, str]], n: int = N) -> None:
        self.number: dict[str, int] = {}
        runs = [[self.number.setdefault(word, len(self.number) + 1) for word in words(text)] for _, text in items]
        self.names = [name for name, _ in items]
        self.all = np.array([k for run in runs for k in run], dtype=np.int64)
        at, places = 0, defaultdict(list)
        for item, run in enumerate(runs):
            if run:
                length = min(n, len(run))
                places[length].append((item, at, len(run) - length + 1))
            at += len(run)
        self.tables = {}
        for length, parts in places.items():
            item = np.repeat([p[0] for p in parts], [p[2] for p in parts])
            start = np.concatenate([np.arange(p[1], p[1] + p[2]) for p in parts])
            hashes = rolling(self.all, length, start)
            order = np.argsort(hashes, kind="stable")
            self.tables[length] = hashes[order], start[order], item[order]

    def ids(self, text: str) -> np.ndarray:
        """The words of a text as numbers, 0 for words that no window has."""
        get = self.number.get
        return np.array([get(word, 0) for word in words(text)], dtype=np.int64)

    def occurrences(self, ids: np.ndarray) -> Iterator[tuple[int, int, set[str | None]]]:
        """(start, length, items) of the windows in ``ids``."""
        run = np.cumsum(np.concatenate(([0], ids > 0)))
        for length, (hashes, starts, items) in self.tables.items():
            if len(ids) < length:
                continue
            full = np.flatnonzero(run[length:] - run[:-length] == length)
            near = rolling(ids, length, full)
            low = np.searchsorted(hashes, near)
            for place in np.flatnonzero(hashes[np.minimum(low, len(hashes) - 1)] == near):
                high = np.searchsorted(hashes, near[place], side="right")
                here, found = ids[full[place] : full[place] + length], set()
                for k in range(low[place], high):
                    if np.array_equal(self.all[starts[k] : starts[k] + length], here):
                        found.add(items[k])
                if found:
                    yield int(full[place]), length, {self.names[k] for k in found}

    def scan(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, set[str | None]]]:
        """For each text the number of words, a mask of those hit, and the items that occur."""
        waiting: list[np.ndarray] = []
        size = 0
        for text in texts:
            waiting.append(self.ids(text) if text else np.zeros(0, dtype=np.int64))
            size += len(waiting[-1])
            if size >= CHUNK_WORDS:
                yield from self._scan(waiting)
                waiting, size = [], 0
        yield from self._scan(waiting)

    def _scan(self, documents: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray, set[str | None]]]:
        if not documents:
            return
        gap = np.zeros(1, dtype=np.int64)
        ids = np.concatenate([part for document in documents for part in (document, gap)])
        starts = np.cumsum([0, *(len(document) + 1 for document in documents)])
        change = np.zeros(len(ids) + 1, dtype=np.int64)
        found: dict[int, set[str | None]] = defaultdict(set)
        for start, length, items in self.occurrences(ids):
            change[start] += 1
            change[start + length] -= 1
            found[int(np.searchsorted(starts, start, side="right")) - 1] |= items
        hit = np.cumsum(change[:-1]) > 0
        for k, document in enumerate(documents):
            yield len(document), hit[starts[k] : starts[k] + len(document)], found.get(k, set())


def items_digest(items) -> str:
    """SHA-256 of the item ids, sorted as strings and comma-joined."""
    return hashlib.sha256(",".join(sorted(i for i in items if i is not None)).encode()).hexdigest()


def without_hits(text: str, hit: np.ndarray) -> str:
    """``text`` without its hit words and what stands between two of them."""
    out, last, previous = [], 0, False
    for word, bad in zip(_WORDS.finditer(text.translate(_LOWER)), hit, strict=True):
        if bad:
            if not previous:
                out.append(text[last : word.start()])
            last = word.end()
        previous = bool(bad)
    out.append(text[last:])
    return "".join(out)


REPORT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _reported(docs: DataFrame, found, n: int) -> DataFrame:
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows_of = WindowSet(found.value, n)
        for batch in slices(batches):
            rows = [
                (count, int(hit.sum()), len(items), items_digest(items), bool(hit.any()))
                for count, hit, items in windows_of.scan(batch.column("text").to_pylist())
            ]
            columns = [pa.array(column) for column in zip(*rows, strict=True)] if rows else [[]] * 5
            names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(scan, f"doc_id {id_type}, {REPORT}")


def _broadcast(items: DataFrame):
    """The items on all executors; the caller has checked their bounds."""
    return items.sparkSession.sparkContext.broadcast([(r[0], r[1]) for r in items.select("item_id", "text").collect()])


def report(docs: DataFrame, benchmark: DataFrame, n: int = N, bounds: Bounds = Bounds()) -> DataFrame:  # noqa: B008
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    Null and empty texts have no words and are clean; items_sha256 of no items is that of empty text. Long texts are
    read to their end. Items with null id occur like others and count, but add nothing to items_sha256. Repeated
    documents each get a row and repeated items count once. An empty benchmark leaves all documents clean, an empty
    table gives no rows. Other columns are ignored, whatever their names.
    """
    items = shared_table(_items(benchmark, n), "benchmark-items")
    docs = docs.select("doc_id", "text")
    if _few(items, bounds):
        return _reported(docs, _broadcast(items), n)
    keyed = docs.select(F.struct("doc_id").alias("row"), "text", F.monotonically_increasing_id().alias("at"))
    keyed = shared_table(keyed, "benchmark-documents")
    hits = shared_table(joined_hits(keyed.select("at", "text"), items, n), "benchmark-hits")
    return joined_report(keyed, hits)


def word_hashes(found: list[str]) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w.encode()) for w in found), np.uint64, len(found))


def _window_keys(windows: DataFrame) -> DataFrame:
    """``windows`` with ``key``, the hash of the window's words."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("window").to_pylist()
            key = [rolling(h, len(h))[0] for h in (word_hashes(t.split(" ")) for t in texts)]
            yield batch.append_column("key", pa.array(np.array(key, np.uint64).view(np.int64)))

    return windows.mapInArrow(keys, "item_id string, length int, window string, key long")


def _bloom(keys: DataFrame) -> np.ndarray:
    """One bit per value of the keys' last bits: at most BLOOM_BITS, whatever their number."""
    place = F.pmod("key", F.lit(BLOOM_BITS)) + 1  # the functions count from 1
    bits = keys.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("bits")
    )
    out = np.zeros(BLOOM_BITS, dtype=bool)
    for row in bits.toLocalIterator():  # buckets of 32,768 bits
        held = np.unpackbits(np.frombuffer(row["bits"], np.uint8), bitorder="little")
        begin = (row["bucket"] - 1) * len(held)
        out[begin : begin + len(held)] = held[: len(out[begin : begin + len(held)])]
    return np.packbits(out)


def joined_hits(docs: DataFrame, items: DataFrame, n: int = N) -> DataFrame:
    """(at, start, length, item_id) of the items' windows in ``docs`` (at, text), for items too many to broadcast.

    Documents are scanned where they are; only the windows that pass the Bloom filter move, to be joined by key and
    compared by their words. A window that documents hold very often is joined in parts.
    """
    windows = shared_table(_window_keys(item_windows(items, n)), "benchmark-windows")
    lengths = [row[0] for row in windows.select("length").distinct().collect()]  # n of them at most
    bloom = docs.sparkSession.sparkContext.broadcast(_bloom(windows.select("key")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = bloom.value
        for batch in slices(batches):
            for at, text in zip(batch.column("at").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words(text) if text else []
                hashes = word_hashes(found)
                for length in lengths:
                    keys = rolling(hashes, length)
                    place = (keys.view(np.int64) % BLOOM_BITS).astype(np.int64)
                    passed = np.flatnonzero(bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8) & 1)
                    if len(passed):
                        yield pa.RecordBatch.from_pydict(
                            {
                                "at": np.full(len(passed), at, np.int64),
                                "start": passed.astype(np.int32),
                                "length": np.full(len(passed), length, np.int32),
                                "key": keys[passed].view(np.int64),
                                "words": [" ".join(found[k : k + length]) for k in passed],
                            }
                        )

    places = docs.mapInArrow(scan, "at long, start int, length int, key long, words string")
    places = shared_table(places, "benchmark-places")
    held = windows.select("item_id", "key", "window")
    hot = places.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") > HOT_ROWS).select("key")
    hot = shared_table(hot, "benchmark-hot")
    on = ["key"]
    if not is_empty(hot):  # a key per HOT_ROWS places at most
        marked = F.broadcast(hot.withColumn("hot", F.lit(True)))
        salts = F.when(F.col("hot"), F.lit(SALTS)).otherwise(F.lit(1)).cast("long")
        places = places.join(marked, "key", "left").withColumn("salt", F.pmod(F.xxhash64("at", "start"), salts)).drop("hot")
        salt = F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))
        held = held.join(marked, "key", "left").select("item_id", "key", "window", salt.alias("salt"))
        on = ["key", "salt"]
    joined = places.join(held, on).filter(F.col("words") == F.col("window"))
    return joined.select("at", "start", "length", "item_id")


def _hit_places(hits: DataFrame) -> DataFrame:
    """(at, place) of every hit word, once."""
    return hits.select("at", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("place")).distinct()


def joined_report(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """:func:`report` for documents ``keyed`` (row, text, at) and their hits."""
    n_hit = _hit_places(hits).groupBy("at").agg(F.count("*").alias("n_hit"))
    items = hits.select("at", "item_id").distinct().groupBy("at")
    items = items.agg(F.count("*").alias("n_items"), F.sort_array(F.collect_list("item_id")).alias("items"))
    rows = keyed.select("row", "at", F.size(words_column(F.col("text"))).cast("long").alias("n_words"))
    rows = rows.join(n_hit, "at", "left").join(items, "at", "left")
    digest = F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256)
    return rows.select(
        "row.doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        digest.alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )


def decontaminated(
    docs: DataFrame, benchmark: DataFrame, n: int = N, spans: bool = False, bounds: Bounds = Bounds()  # noqa: B008
) -> DataFrame:
    """``docs`` without its contaminated documents, or with ``spans`` all of them without their hit words.

    The columns stay as they are; texts without hits stay byte for byte. Nulls, repeated rows, long texts and empty
    tables are treated as in :func:`report`. Items beyond ``bounds`` aren't broadcast but joined.
    """
    items = shared_table(_items(benchmark, n), "benchmark-items")
    if not _few(items, bounds):
        return joined_decontaminated(docs, items, n, spans)
    found = _broadcast(items)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows_of = WindowSet(found.value, n)
        for batch in slices(batches):
            masks = [hit for _, hit, _ in windows_of.scan(batch.column("text").to_pylist())]
            if spans:
                yield _cut(batch, masks)
            else:
                yield batch.filter(pa.array([not hit.any() for hit in masks], pa.bool_()))

    return docs.mapInArrow(clean, docs.schema)


def _cut(batch: pa.RecordBatch, masks: list[np.ndarray]) -> pa.RecordBatch:
    """``batch`` with texts without the words that their masks hit."""
    texts = batch.column("text").to_pylist()
    cut = [without_hits(t, hit) if hit.any() else t for t, hit in zip(texts, masks, strict=True)]
    place = batch.schema.get_field_index("text")
    return batch.set_column(place, batch.schema.field(place), pa.array(cut, batch.schema.field(place).type))


def joined_decontaminated(docs: DataFrame, items: DataFrame, n: int = N, spans: bool = False) -> DataFrame:
    """:func:`decontaminated` for items of any number."""
    keyed = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("at"))
    keyed = shared_table(keyed, "benchmark-documents")
    hits = shared_table(joined_hits(keyed.select("at", "row.text"), items, n), "benchmark-hits")
    if not spans:
        return keyed.join(hits.select("at").distinct(), "at", "left_anti").select("row.*")
    places = _hit_places(hits).groupBy("at").agg(F.collect_list("place").alias("places"))  # no more than a text has words

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows, masks = pa.RecordBatch.from_struct_array(batch.column("row")), []
            for text, at in zip(rows.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                mask = np.zeros(len(words(text)) if at else 0, dtype=bool)
                mask[np.array(at or [], dtype=np.int64)] = True
                masks.append(mask)
            yield _cut(rows, masks)

    return keyed.join(places, "at", "left").select("row", "places").mapInArrow(clean, docs.schema)
