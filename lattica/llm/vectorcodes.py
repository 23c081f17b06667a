"""Vector codes by codebooks of whole numbers, whose nearest entries are found in a VA file.

A vector is cut into parts, each part has a codebook, and the code is the number of the nearest entry of each. The
entries of a codebook are approximated by the cells that their coordinates fall into (BITS bits a coordinate). For a
queried part, tables of its least and greatest squared distance to every cell give a lower and an upper bound to each
entry as sums of looked-up values; only entries whose lower bound doesn't exceed the smallest upper bound are
compared by their exact integer distance. Codebooks are fitted by rounds over all vectors: each task sums the parts
that it assigns to an entry, and the sums are added by entry, so what is shuffled has the size of the codebooks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm.shared import HOT_ROWS, hot_join, integer_vectors, largest, lengths, matrix, shared_table

SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
#: Bits of a coordinate's cell.
BITS = 4
#: Vectors whose bounds are held at a time.
QUERY_ROWS = 1024


class VAFile:
    """A codebook (entries by coordinates, whole numbers) with the cells of its coordinates."""

    def __init__(self, entries: np.ndarray, bits: int = BITS) -> None:
        self.entries = entries
        n, width = entries.shape
        cells = 1 << bits
        values = entries.astype(np.float64)
        step = np.maximum((values.max(axis=0) - values.min(axis=0)) / cells, 1e-300)
        cell = np.minimum((values - values.min(axis=0)) / step, cells - 1).astype(np.int64)
        # the ends of the cells are those of the entries in them
        self.low, self.high = np.full((width, cells), np.inf), np.full((width, cells), -np.inf)
        column = np.broadcast_to(np.arange(width), cell.shape)
        np.minimum.at(self.low, (column, cell), values)
        np.maximum.at(self.high, (column, cell), values)
        used = np.isfinite(self.low)
        self.low, self.high = np.where(used, self.low, 0), np.where(used, self.high, 0)
        #: which cell of each coordinate an entry is in, so that sums of looked-up values are one product
        self.chosen = np.zeros((width, cells, n))
        self.chosen[column, cell, np.arange(n)[:, None]] = 1
        self.chosen = self.chosen.reshape(width * cells, n)

    def bounds(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lower and upper bounds of the squared distance of each row to each entry, from tables per row."""
        at = rows.astype(np.float64)[:, :, None]
        under, over = self.low - at, at - self.high
        near = np.maximum(np.maximum(under, over), 0)
        far = np.maximum(np.abs(under), np.abs(over))
        n = len(rows)
        return (near * near).reshape(n, -1) @ self.chosen, (far * far).reshape(n, -1) @ self.chosen

    def nearest(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row (ties to the lower number) and its squared distance, a long or a Python int."""
        lower, upper = self.bounds(rows)
        # doubles of whole numbers below 2**53 are exact; beyond, a margin far above their error keeps every candidate
        row, entry = np.nonzero(lower * (1 - 1e-9) <= upper.min(axis=1)[:, None] * (1 + 1e-9))
        longs = (largest(rows) + largest(self.entries)) ** 2 * max(1, rows.shape[1]) < 2**63
        a, b = (rows, self.entries) if longs else (rows.astype(object), self.entries.astype(object))
        apart = a[row] - b[entry]
        distance = (apart * apart).sum(axis=1) if apart.shape[1] else np.zeros(len(row), dtype=np.int64)
        starts = np.searchsorted(row, np.arange(len(rows)))
        least = np.minimum.reduceat(distance, starts)
        first = np.minimum.reduceat(np.where(distance == least[row], entry, len(self.entries)), starts)
        return first, least


def cuts(width: int, parts: int = PARTS) -> list[slice]:
    """Consecutive parts of a vector, equal where ``parts`` divides its width."""
    ends = [width * k // parts for k in range(parts + 1)]
    return [slice(a, b) for a, b in zip(ends, ends[1:], strict=False)]


def _row_slices(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, QUERY_ROWS):
            part = batch.slice(start, QUERY_ROWS)
            yield part, matrix(part.column("x"), width)


def first_codebooks(rows: DataFrame, width: int, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """The parts of the vectors with the smallest ids, at most ``entries`` of them; equal ids by vector, nulls last."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").select("x").limit(entries).collect()
    start = np.array([row["x"] for row in first], dtype=np.int64).reshape(len(first), width)
    return [start[:, cut] for cut in cuts(width, parts)]


SUMS = "part int, entry int, n long, sums array<long>"
_ARROW_SUMS = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])


def refined(rows: DataFrame, width: int, codebooks: list[np.ndarray]) -> list[np.ndarray]:
    """One round: every entry becomes the floored mean of the parts nearest to it; unused entries stay."""
    places = cuts(width, len(codebooks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(c) for c in codebooks]
        counts = [np.zeros(len(c), dtype=np.int64) for c in codebooks]
        sums = [np.zeros(c.shape, dtype=np.int64) for c in codebooks]
        most = 0  # no sum exceeds it

        def summed() -> Iterator[pa.RecordBatch]:
            for part, (count, total) in enumerate(zip(counts, sums, strict=True)):
                used = np.flatnonzero(count)
                columns = [np.full(len(used), part, dtype=np.int32), used.astype(np.int32), count[used], list(total[used])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(columns, _ARROW_SUMS, strict=True)], schema=_ARROW_SUMS
                )
                count[:], total[:] = 0, 0

        for _, x in _row_slices(batches, width):
            added = largest(x) * len(x)
            if most + added >= 2**62:
                yield from summed()
                most = 0
                if added >= 2**62:  # so large that a slice must go row by row
                    for row in x:
                        for part, (file, cut) in enumerate(zip(files, places, strict=True)):
                            entry = file.nearest(row[None, cut])[0][0]
                            counts[part][entry] += 1
                            sums[part][entry] += row[cut]
                        yield from summed()
                    continue
            most += added
            for part, (file, cut) in enumerate(zip(files, places, strict=True)):
                entry = file.nearest(x[:, cut])[0]
                order = np.argsort(entry, kind="stable")
                held, starts = np.unique(entry[order], return_index=True)
                counts[part] += np.bincount(entry, minlength=len(counts[part]))
                sums[part][held] += np.add.reduceat(x[order][:, cut], starts, axis=0)
        yield from summed()

    parts = rows.select("x").mapInArrow(assign, SUMS)
    each = parts.select("part", "entry", "n", F.posexplode("sums").alias("place", "value"))
    exact = F.sum(F.col("value").cast("decimal(38,0)")).alias("total")  # exact beyond a long, too
    added = each.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), exact)
    out = [c.copy() for c in codebooks]
    for row in added.collect():  # a row for each number of the codebooks at most
        out[row["part"]][row["entry"], row["place"]] = int(row["total"]) // row["n"]
    return out


def fit(rows: DataFrame, width: int, rounds: int = ROUNDS, entries: int = ENTRIES, parts: int = PARTS) -> list[np.ndarray]:
    """The codebooks of the vectors ``x`` (vec_id, x), all of ``width`` whole numbers."""
    codebooks = first_codebooks(rows, width, entries, parts)
    for _ in range(rounds):
        codebooks = refined(rows, width, codebooks)
    return codebooks


def codebooks_sha256(codebooks: list[np.ndarray]) -> str:
    """SHA-256 of all numbers by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(v) for c in codebooks for v in c.ravel().tolist()).encode()).hexdigest()


def encoded(rows: DataFrame, width: int, codebooks: list[np.ndarray], id_type: str, label_type: str) -> DataFrame:
    """(vec_id, label, code, error) of the vectors (vec_id, label, x)."""
    places = cuts(width, len(codebooks))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [VAFile(c) for c in codebooks]
        for part, x in _row_slices(batches, width):
            found = [file.nearest(x[:, cut]) for file, cut in zip(files, places, strict=True)]
            digits = np.stack([entry for entry, _ in found], axis=1).astype(np.uint8).tobytes().hex()
            size = 2 * len(codebooks)
            codes = [digits[k : k + size] for k in range(0, len(digits), size)]
            errors = [sum(map(int, row)) for row in zip(*(distance.tolist() for _, distance in found), strict=True)]
            errors = [e if e < 2**63 else None for e in errors]
            columns = [part.column("vec_id"), part.column("label"), pa.array(codes), pa.array(errors, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(encode, f"vec_id {id_type}, label {label_type}, code string, error long")


def label_errors(coded: DataFrame) -> DataFrame:
    """``coded`` with ``label_error``, the sum of ``error`` over the rows of its label; null labels are one label.

    Sums are built on the map side; a label with over HOT_ROWS rows gets its sum where its rows lie.
    """
    key = F.when(F.col("label").isNull(), "").otherwise(F.concat(F.lit("="), F.col("label").cast("string")))
    keyed = coded.withColumn("key", key)
    sums = keyed.groupBy("key").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"))
    sums = shared_table(sums, "code-labels")
    hot = sums.filter(F.col("n") > HOT_ROWS)
    joined = hot_join(keyed, sums.select("key", F.expr("try_cast(total AS long)").alias("label_error")), "key", hot)
    return joined.drop("key")


def codes(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", rounds: int = ROUNDS
) -> DataFrame:
    """One row per vector: vec_id, code, error, label_error, codebooks_sha256.

    Vectors that are null or hold null or non-finite components are left out; components become floor(SCALE * x), a long
    at most. Vectors of another length have codebooks of their own; where PARTS doesn't divide a length, the parts
    differ by one. Ids may be null (the last in order) or repeat: each row gets its code. Errors and sums of errors
    beyond a long are null, and null errors aren't summed. Null labels are one label. An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    id_type, label_type = (table.schema[c].dataType.simpleString() for c in (id_col, label_col))
    rows = shared_table(integer_vectors(table, SCALE, vector_col, vec_id=id_col, label=label_col), "code-vectors")
    schema = f"vec_id {id_type}, label {label_type}, code string, error long, codebooks_sha256 string"
    coded = table.sparkSession.createDataFrame([], schema)
    for width in lengths(rows):
        part = rows.filter(F.size("x") == width)
        books = fit(part, width, rounds)
        found = encoded(part, width, books, id_type, label_type)
        coded = coded.unionByName(found.withColumn("codebooks_sha256", F.lit(codebooks_sha256(books))))
    return label_errors(shared_table(coded, "codes")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")
