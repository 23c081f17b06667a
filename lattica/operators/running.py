"""Running sums and maxima without a task per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.tables import written


def running(
    rows: DataFrame,
    keys: list[str],
    order: str,
    sums: dict[str, str] | None = None,
    maxima: dict[str, str] | None = None,
    ties: tuple[str | Column, ...] = (),
    ranges: int | None = None,
) -> DataFrame:
    """``rows`` with columns (name: value) of sums and maxima up to each row of its key, by ``order``, then ``ties``.

    The rows are dealt into ranges of (keys, order, ties) with about equally many rows each, whose ends Spark samples, and
    written once. A range's totals are built on the map side, their running totals have a row per key and range, and
    each range of a key is finished by itself. So a key with a third of all rows is spread over many tasks, however
    its order is spread. Rows of one order that no tie tells apart are in one range. Sums skip nulls and start at 0,
    maxima skip nulls and start with null; they may be of any type that has an order, as structs.
    """
    sums, maxima = sums or {}, maxima or {}
    by = [*keys, order, *ties]
    dealt = rows.repartitionByRange(ranges, *by) if ranges else rows.repartitionByRange(*by)
    ranged = written(dealt.withColumn("__range", F.spark_partition_id()), "running-ranges")
    totals = ranged.groupBy(*keys, "__range").agg(
        *[F.sum(value).alias(name) for name, value in sums.items()], *[F.max(value).alias(name) for name, value in maxima.items()]
    )
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        *keys, "__range", *[F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"__{name}") for name in sums],
        *[F.max(name).over(before).alias(f"__{name}") for name in maxima],
    )
    inside = Window.partitionBy(*keys, "__range").orderBy(order, *ties).rowsBetween(Window.unboundedPreceding, 0)
    within = {f"__inside_{name}": F.coalesce(F.sum(value).over(inside), F.lit(0)) for name, value in sums.items()}
    within |= {f"__inside_{name}": F.max(value).over(inside) for name, value in maxima.items()}
    summed = ranged.withColumns(within)
    joined = summed.join(starts, [summed[k].eqNullSafe(starts[k]) for k in [*keys, "__range"]])
    return joined.select(
        *[summed[c] for c in rows.columns],
        *[(starts[f"__{name}"] + summed[f"__inside_{name}"]).alias(name) for name in sums],
        *[F.greatest(starts[f"__{name}"], summed[f"__inside_{name}"]).alias(name) for name in maxima],
    )


def running_sums(
    rows: DataFrame, keys: list[str], order: str, sums: dict[str, str], ties: tuple[str | Column, ...] = (), ranges: int | None = None
) -> DataFrame:
    """:func:`running` of sums (name: value)."""
    return running(rows, keys, order, sums, None, ties, ranges)


def running_sum(
    rows: DataFrame, keys: list[str], order: str, value: str, name: str, ties: tuple[str | Column, ...] = (), ranges: int | None = None
) -> DataFrame:
    """:func:`running` of one sum."""
    return running(rows, keys, order, {name: value}, None, ties, ranges)


def running_maximum(rows: DataFrame, keys: list[str], order: str, value: str, name: str, ranges: int | None = None) -> DataFrame:
    """:func:`running` of one maximum."""
    return running(rows, keys, order, None, {name: value}, (), ranges)


def ranked(rows: DataFrame, keys: list[str], by: list[str], name: str) -> DataFrame:
    """``rows`` with their places from 0 within their key, ordered ``by``; rows that this doesn't tell apart, in either order.

    The rows are dealt into ranges and sorted there, which is their one shuffle: a row's number in its range, less that of
    its key's first row there, plus the key's rows in earlier ranges, of which there is a row per key and range.
    """
    dealt = rows.repartitionByRange(*keys, *by).sortWithinPartitions(*keys, *by)
    numbered = written(dealt.withColumn("__at", F.monotonically_increasing_id()), "ranked-rows")
    numbered = numbered.withColumn("__range", F.shiftright("__at", 33))  # the id's upper bits are the range
    totals = numbered.groupBy(*keys, "__range").agg(F.min("__at").alias("__first"), F.count("*").alias("__rows"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    base = F.coalesce(F.sum("__rows").over(before), F.lit(0)) - F.col("__first")
    starts = totals.select(*[F.col(k).alias(f"__of_{k}") for k in [*keys, "__range"]], base.alias("__base"))
    joined = numbered.join(starts, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in [*keys, "__range"]])
    return joined.select(*rows.columns, (F.col("__at") + F.col("__base")).alias(name))
