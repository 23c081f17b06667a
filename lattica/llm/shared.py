"""Written intermediate tables, joins that split their hot keys, slices of Arrow batches, and vectors of whole numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.tables import scratch_dir, shared_dir  # noqa: F401  for the operators of this subpackage
from lattica.tables import written as shared_table


#: Rows of one key beyond which a join doesn't bring them together in one task.
HOT_ROWS = 200_000


def is_empty(df: DataFrame) -> bool:
    return not df.limit(1).count()


def hot_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame | None) -> DataFrame:
    """Inner join of ``left``, with any number of rows per key, and ``right``, with one row per key.

    ``hot`` has the keys with over HOT_ROWS rows in ``left``, so it has at most a row per HOT_ROWS of them; their
    rows stay where they are and the matching rows of ``right`` are sent to them. The rest is joined by key. None says
    that there are no such keys.
    """
    if hot is None or is_empty(hot):
        return left.join(right, key)
    hot = hot.select(key)
    few = F.broadcast(shared_table(right.join(F.broadcast(hot), key, "left_semi"), "hot-rows"))
    rest = left.join(F.broadcast(hot), key, "left_anti").join(right.join(F.broadcast(hot), key, "left_anti"), key)
    return left.join(few, key).unionByName(rest)


#: Rows of a batch that Python holds as objects at a time.
SLICE_ROWS = 512


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts of ``SLICE_ROWS`` rows, without copying, so few texts are Python objects at once."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(start, SLICE_ROWS)


# Vectors of whole numbers


def integer_vectors(table: DataFrame, scale: int, vector_col: str, **kept: str) -> DataFrame:
    """(the columns ``kept``, x): floor(``scale`` * entry) of each entry as double, beyond a long its nearest end.

    Rows whose vector is null or holds null or non-finite entries are left out. ``kept`` maps new names to columns.
    """
    vector = F.col(f"`{vector_col}`")
    good = vector.isNotNull() & F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    return table.filter(good).select(*[F.col(f"`{c}`").alias(name) for name, c in kept.items()], x.alias("x"))


def lengths(vectors: DataFrame) -> list[int]:
    """The lengths that the vectors ``x`` have; each is a space of its own with a fit of its own."""
    return sorted(row[0] for row in vectors.select(F.size("x")).distinct().collect())


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """The lists of an Arrow column, each of ``width`` numbers, as the rows of a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), width)


def largest(values: np.ndarray) -> int:
    """The largest absolute value, as a Python int."""
    return max(abs(int(values.min())), abs(int(values.max()))) if values.size else 0
