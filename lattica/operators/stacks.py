"""Stacks and workspaces as folds of their logs.

A stack's log is (stack, seq, op, content) with the ops push, pop, drop, replace and clear. No op is replayed: the depth
after each is a running sum held at zero, and an item stays if the depth never falls below its own later on. All
running values go over ranges of the log, so one stack with most of the log is spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.running import running_maximum, running_sum

PREVIEW = 60


def depths(log: DataFrame) -> DataFrame:
    """The log with ``segment`` (clears so far), ``was``, the depth before the op, and ``depth`` after it."""
    cleared = log.withColumn("__clears", (F.col("op") == "clear").cast("long"))
    rows = running_sum(cleared, ["stack"], "seq", "__clears", "segment")
    change = F.when(F.col("op") == "push", 1).when(F.col("op").isin("pop", "drop"), -1).otherwise(0).cast("long")
    inside = ["stack", "segment"]
    rows = running_sum(rows.withColumn("__change", change), inside, "seq", "__change", "__total")
    # A pop of an empty stack does nothing: what the sum had fallen below zero before the op is added back.
    before = F.col("__total") - F.col("__change")
    rows = running_maximum(rows.withColumns({"__before": before, "__sunk": -before}), inside, "seq", "__sunk", "__lowest")
    was = F.col("__before") + F.greatest(F.lit(0), F.col("__lowest"))
    rows = rows.withColumn("was", was).withColumn("depth", F.greatest(F.lit(0), F.col("was") + F.col("__change")))
    return rows.select(*log.columns, "segment", "was", "depth")


def items(log: DataFrame) -> DataFrame:
    """(stack, position, content): what the stacks hold in the end; the top has the largest position."""
    newest = log.groupBy("stack").agg(F.count_if(F.col("op") == "clear").alias("segment"))
    rows = depths(log).join(newest, ["stack", "segment"])
    later = rows.withColumns({"__back": -F.col("seq"), "__below": -F.col("depth")})
    rows = running_maximum(later, ["stack"], "__back", "__below", "__low")
    written = F.col("op").isin("push", "replace") & (F.col("depth") > 0) & (-F.col("__low") >= F.col("depth"))
    return rows.filter(written).groupBy("stack", F.col("depth").alias("position")).agg(F.max_by("content", "seq").alias("content"))


def popped(log: DataFrame) -> DataFrame:
    """(stack, seq, content): what each pop or drop took off; those of an empty stack are left out."""
    takes = F.col("op").isin("pop", "drop") & (F.col("was") > 0)
    rows = depths(log).withColumn("takes", takes).filter(F.col("takes") | (F.col("op").isin("push", "replace") & (F.col("depth") > 0)))
    level = F.when(F.col("takes"), F.col("was")).otherwise(F.col("depth"))
    put = F.when(~F.col("takes"), F.struct("seq", "content"))
    rows = running_maximum(rows.withColumns({"level": level, "put": put}), ["stack", "segment", "level"], "seq", "put", "last")
    return rows.filter("takes").select("stack", "seq", F.col("last.content").alias("content"))


def tops(items: DataFrame) -> DataFrame:
    """(stack, depth, content) of the top of each stack that isn't empty."""
    return items.groupBy("stack").agg(F.max("position").alias("depth"), F.max_by("content", "position").alias("content"))


def listed(items: DataFrame, stack) -> DataFrame:
    """(position, preview) of one stack, top first; a preview is the first characters on one line."""
    preview = F.left(F.replace("content", F.lit("\n"), F.lit(" ")), F.lit(PREVIEW))
    return items.filter(F.col("stack") == stack).select("position", preview.alias("preview")).orderBy(F.desc("position"))


def workspaces(spaces: DataFrame, items: DataFrame, user) -> DataFrame:
    """(id, name, is_active, item_count, updated_at) of a user's workspaces, the latest first."""
    counts = items.groupBy(F.col("stack").alias("id")).agg(F.count("*").alias("item_count"))
    own = spaces.filter(F.col("user_id") == user).join(counts, "id", "left")
    count = F.coalesce("item_count", F.lit(0)).cast("long").alias("item_count")
    return own.select("id", "name", "is_active", count, "updated_at").orderBy(F.desc("updated_at"), "id")


def activated(spaces: DataFrame, workspace) -> DataFrame:
    """``spaces`` with ``workspace`` as the only active one of its user; an unknown one changes nothing."""
    owner = spaces.filter(F.col("id") == workspace).select(F.col("user_id").alias("owner")).distinct()
    rows = spaces.join(owner, F.col("user_id") == F.col("owner"), "left")
    active = F.when(F.col("owner").isNotNull(), F.col("id") == workspace).otherwise(F.col("is_active"))
    return rows.withColumn("is_active", active).drop("owner")
