"""Append-only logs in place of updates: the current state is the last row of each key, minus tombstones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def latest(log: DataFrame, keys: list[str], order: list[str], deleted: str | None = None) -> DataFrame:
    """The last row of each key by ``order``; a key whose last row has ``deleted`` set is gone.

    max_by combines on the map side, so a key with many rows doesn't meet in one task. Null keys are keys.
    """
    others = [c for c in log.columns if c not in keys]
    row = F.max_by(F.struct(*others), F.struct(*order))
    state = log.groupBy(*keys).agg(row.alias("row")).select(*keys, "row.*")
    return state.filter(~F.coalesce(F.col(deleted), F.lit(False))).drop(deleted) if deleted else state


def first_wins(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by ``order``: inserts that do nothing on a conflict."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.min_by(F.struct(*others), F.struct(*order)).alias("row")).select(*keys, "row.*")


def is_new(incoming: DataFrame, current: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """``incoming`` with ``is_new``: whether no current row has its key.

    With ``order`` the incoming rows are requests that are added one after the other: of those of a key that aren't
    ``refused`` only the first is new, and no refused one is.
    """
    held = current.select(*keys).distinct().withColumn("held", F.lit(True))
    rows = incoming.join(held, keys, "left").withColumn("is_new", F.col("held").isNull()).drop("held")
    if order is None:
        return rows
    first = incoming.filter("refused IS NULL").groupBy(*keys).agg(F.min(order).alias("__first"))
    rows = rows.join(first, keys, "left")
    only = F.col("refused").isNull() & (F.col(order) == F.col("__first"))
    return rows.withColumn("is_new", F.coalesce(F.col("is_new") & only, F.lit(False))).drop("__first")


def sync_counts(wanted: DataFrame, current: DataFrame, key: str, value: str) -> DataFrame:
    """What makes ``current`` into ``wanted``: one row per change, add, update or delete."""
    a = wanted.select(F.col(key).alias("k"), F.col(value).alias("wanted"), F.lit(True).alias("in_wanted"))
    b = current.select(F.col(key).alias("k"), F.col(value).alias("current"), F.lit(True).alias("in_current"))
    both = a.join(b, "k", "full_outer")
    change = (
        F.when(F.col("in_current").isNull(), "add")
        .when(F.col("in_wanted").isNull(), "delete")
        .when(~F.col("wanted").eqNullSafe(F.col("current")), "update")
    )
    return both.select(F.col("k").alias(key), change.alias("change"), "wanted", "current").filter("change IS NOT NULL")
