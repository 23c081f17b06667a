"""Perspectives and associations of agents: lookups, consensus and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.operators.latest import latest

PERSPECTIVE_KEY = ["agent_id", "node_id", "context_id"]
ASSOCIATION_KEY = ["agent_id", "source_id", "target_id", "relation"]


def current_perspectives(log: DataFrame) -> DataFrame:
    """The last weight of each (agent, node, context); a null context is a key like any other."""
    deleted = "deleted" if "deleted" in log.columns else None
    return latest(log, PERSPECTIVE_KEY, ["updated_at", "seq"], deleted).drop("seq")


def current_associations(log: DataFrame) -> DataFrame:
    deleted = "deleted" if "deleted" in log.columns else None
    return latest(log, ASSOCIATION_KEY, ["seq"], deleted).drop("seq")


def get_perspectives(
    perspectives: DataFrame, nodes: DataFrame, agent: str, context: str | None = None, min_weight: float | None = None
) -> DataFrame:
    mine = perspectives.filter(F.col("agent_id") == agent)
    if context is not None:
        mine = mine.filter(F.col("context_id") == context)
    if min_weight is not None:
        mine = mine.filter(F.col("weight") >= min_weight)
    named = mine.join(nodes.select(F.col("id").alias("node_id"), "kind", "content"), "node_id")
    named = named.select("node_id", "kind", "content", "context_id", "weight")
    return named.orderBy(F.desc_nulls_first("weight"), "node_id", "context_id")


def get_associations(
    associations: DataFrame, agent: str, source: str | None = None, relation: str | None = None
) -> DataFrame:
    mine = associations.filter(F.col("agent_id") == agent)
    if source is not None:
        mine = mine.filter(F.col("source_id") == source)
    if relation is not None:
        mine = mine.filter(F.col("relation") == relation)
    mine = mine.select("source_id", "target_id", "relation", "weight")
    return mine.orderBy(F.desc_nulls_first("weight"), "source_id", "target_id", "relation")


def consensus_view(perspectives: DataFrame) -> DataFrame:
    """Per node and context: distinct agents, mean, smallest, largest and sample deviation of their weights."""
    return perspectives.groupBy("node_id", "context_id").agg(
        F.count_distinct("agent_id").alias("agent_count"),
        F.avg("weight").alias("avg_weight"),
        F.min("weight").alias("min_weight"),
        F.max("weight").alias("max_weight"),
        F.stddev_samp("weight").alias("stddev_weight"),
    )


def consensus(
    perspectives: DataFrame, nodes: DataFrame, context: str | None = None, min_agents: int = 2, min_weight: float = -1.0
) -> DataFrame:
    chosen = perspectives if context is None else perspectives.filter(F.col("context_id") == context)
    agreed = consensus_view(chosen).filter((F.col("agent_count") >= min_agents) & (F.col("avg_weight") >= min_weight))
    named = agreed.join(nodes.select(F.col("id").alias("node_id"), "kind", "content"), "node_id")
    return named.orderBy(F.desc_nulls_first("avg_weight"), "node_id", "context_id")


def perspective_diff(perspectives: DataFrame, first: str, second: str, context: str | None = None) -> DataFrame:
    """Nodes that only one of two agents rates, and those that both rate differently, by the difference.

    One full outer join on (node, context), null-safe, in place of two anti joins and a self-join.
    """
    chosen = perspectives if context is None else perspectives.filter(F.col("context_id") == context)

    def of(agent: str, name: str) -> DataFrame:
        mine = chosen.filter(F.col("agent_id") == agent)
        return mine.select(
            F.col("node_id").alias(f"node_{name}"), F.col("context_id").alias(f"context_{name}"),
            F.col("weight").alias(f"weight_{name}"),
        )

    a, b = of(first, "a"), of(second, "b")
    on = (F.col("node_a") == F.col("node_b")) & F.col("context_a").eqNullSafe(F.col("context_b"))
    both = a.join(b, on, "full_outer")
    part = F.when(F.col("node_b").isNull(), "only_in_a").when(F.col("node_a").isNull(), "only_in_b")
    rows = both.select(
        F.coalesce(part, F.lit("disagreement")).alias("part"),
        F.coalesce("node_a", "node_b").alias("node_id"),
        F.coalesce("context_a", "context_b").alias("context_id"),
        "weight_a",
        "weight_b",
        F.abs(F.col("weight_a") - F.col("weight_b")).alias("difference"),
    )
    rows = rows.filter((F.col("part") != "disagreement") | (F.col("weight_a") != F.col("weight_b")))
    return rows.orderBy("part", F.desc_nulls_last("difference"), "node_id")


def unique_associations(associations: DataFrame) -> DataFrame:
    """Associations that no other agent holds; an agent's own repeats don't count against it."""
    keys = ["source_id", "target_id", "relation"]
    alone = associations.groupBy(*keys).agg(
        F.count_distinct("agent_id").alias("holders"), F.min("agent_id").alias("agent_id"), F.max("weight").alias("weight")
    )
    return alone.filter("holders = 1").drop("holders")


def unique_insights(associations: DataFrame, nodes: DataFrame, agent: str) -> DataFrame:
    """An agent's unique associations with the contents of both ends."""
    mine = unique_associations(associations).filter(F.col("agent_id") == agent)
    for end in ("source", "target"):
        named = nodes.select(F.col("id").alias(f"{end}_id"), F.col("content").alias(f"{end}_content"))
        mine = mine.join(named, f"{end}_id")
    return mine.select("source_id", "target_id", "relation", "weight", "source_content", "target_content")
