"""Tasks and swarms: leaderboard, progress and status over test results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# States of a task and the moves between them that a swarm makes.
STATES = ("pending", "running", "succeeded", "failed", "stopped")
MOVES = {"launch": ("pending", "running"), "stop": ("running", "stopped")}


def _counts() -> list[Column]:
    return [
        F.count_if(F.col("passed")).alias("passed"),
        F.count_if(~F.col("passed")).alias("failed"),
        F.count("*").alias("total"),
    ]


def _rate() -> Column:
    return F.round(100.0 * F.col("passed") / F.greatest(F.col("total"), F.lit(1)), 1).alias("pass_rate")


def leaderboard(results: DataFrame, task: str) -> DataFrame:
    """Agents of a task by pass rate, then mean duration."""
    by_agent = results.filter(F.col("task_id") == task).groupBy("agent_id")
    ranked = by_agent.agg(*_counts(), F.round(F.avg("duration_ms"), 0).alias("avg_duration_ms"))
    ranked = ranked.select("agent_id", "passed", "failed", "total", _rate(), "avg_duration_ms")
    return ranked.orderBy(F.desc("pass_rate"), F.asc_nulls_last("avg_duration_ms"), "agent_id")


def progress(results: DataFrame, task: str) -> DataFrame:
    """Results of a task per minute."""
    minute = F.date_trunc("minute", "created_at").cast("timestamp_ntz").alias("minute")
    per_minute = results.filter(F.col("task_id") == task).groupBy(minute).agg(*_counts())
    return per_minute.select("minute", "passed", "failed", "total", _rate()).orderBy("minute")


def status(tasks: DataFrame, results: DataFrame, agents: DataFrame, task: str | None = None) -> DataFrame:
    """Tasks with their swarm and their numbers of results; results are counted before they are joined."""
    chosen = tasks if task is None else tasks.filter(F.col("id") == task)
    counts = results.groupBy("task_id").agg(*_counts())
    named = agents.select(F.col("id").alias("swarm_id"), F.col("name").alias("swarm_name"))
    joined = chosen.join(named, "swarm_id", "left").join(counts, F.col("id") == F.col("task_id"), "left")
    numbers = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("total", "passed", "failed")]
    return joined.select("id", "description", "status", "swarm_name", *numbers).orderBy("id")


def moved(tasks: DataFrame, move: str) -> DataFrame:
    """Tasks with the state that ``move`` gives those it may move; ``refused`` marks the others."""
    before, after = MOVES[move]
    allowed = F.col("status") == before
    return tasks.withColumn("refused", ~allowed).withColumn("status", F.when(allowed, after).otherwise(F.col("status")))


def snapshots(results: DataFrame, vector: DataFrame) -> DataFrame:
    """Results with the version vector (author, max_seq) as a map. The vector is one row; its size is the authors."""
    pairs = vector.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("author", "max_seq")))).alias("version_vector"))
    return results.join(pairs)
