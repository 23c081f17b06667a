"""Next-node prediction from walks: counts of what followed a node, or a context of several, in place of a trained network.

Counting is one grouping that combines on the map side and grows with the corpus; a network trained on one machine
would not. Contexts of any order back off to their shorter ends (Witten and Bell): the more kinds of nodes have followed
a context, the more of its weight goes to what follows the context without its first node.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.navigate import clamped
from lattica.tables import tasks_for, written


def transitions(walks: DataFrame) -> DataFrame:
    """(agent, source, target, n): how often a walk (agent, walk, step, node) of an agent goes from source to target."""
    order = Window.partitionBy("agent", "walk").orderBy("step")
    pairs = walks.select("agent", F.col("node").alias("source"), F.lead("node").over(order).alias("target"))
    return pairs.filter("target IS NOT NULL").groupBy("agent", "source", "target").agg(F.count("*").alias("n"))


def probabilities(model: DataFrame, agent: str, node: str) -> DataFrame:
    """(target, probability) of all nodes that followed ``node``."""
    options = model.filter((F.col("agent") == agent) & (F.col("source") == node))
    total = F.sum("n").over(Window.partitionBy("source"))
    return options.select("target", (F.col("n") / total).alias("probability"))


def predict_next(model: DataFrame, agent: str, node: str, top_k: int | None = None) -> DataFrame:
    """(target, probability) of the likeliest nodes after ``node``; equal ones by id."""
    return probabilities(model, agent, node).orderBy(F.desc("probability"), "target").limit(clamped(top_k))


def ensemble_predict(model: DataFrame, agents: list[str], node: str, top_k: int | None = None) -> DataFrame:
    """(target, probability): softmax of the mean over ``agents`` of log(1 + n); an agent without the target adds 0."""
    options = model.filter(F.col("agent").isin(*agents) & (F.col("source") == node))
    logits = options.groupBy("target", "source").agg((F.sum(F.log1p("n")) / len(agents)).alias("logit"))
    total = F.sum(F.exp("logit")).over(Window.partitionBy("source"))
    rows = logits.select("target", (F.exp("logit") / total).alias("probability"))
    return rows.orderBy(F.desc("probability"), "target").limit(clamped(top_k))


def neural_search(found: DataFrame, predicted: DataFrame, limit: int | None = None) -> DataFrame:
    """Search results (id, rank) by rank x (1 + probability of the node in ``predicted``)."""
    near = predicted.select(F.col("target").alias("id"), "probability")
    score = F.coalesce("probability", F.lit(0.0))
    rows = found.join(near, "id", "left").select("id", "rank", score.alias("neural"), F.round(F.col("rank") * (1 + score), 9).alias("combined"))
    return rows.orderBy(F.desc("combined"), "id").limit(clamped(limit))


def model_info(model: DataFrame) -> DataFrame:
    """(agent, sources, parameters, observations) per agent."""
    return model.groupBy("agent").agg(
        F.count_distinct("source").alias("sources"), F.count("*").alias("parameters"), F.sum("n").alias("observations")
    )


# Contexts of several nodes

ORDER = 3


def _contexts(walks: DataFrame, order: int, *also: str) -> DataFrame:
    """(agent, walk, step, target, before): every node of a walk with up to ``order`` nodes before it, the last one last.

    ``also`` are columns that have one value in a walk and are kept.
    """
    along = Window.partitionBy(*also, "agent", "walk").orderBy("step")
    before = F.array_compact(F.array(*[F.lag("node", k).over(along) for k in range(order, 0, -1)]))
    return walks.filter("node IS NOT NULL").select(*also, "agent", "walk", "step", F.col("node").alias("target"), before.alias("before"))


def _ending(context: Column, length: int) -> Column:
    """The last ``length`` nodes of a context; null if it has fewer."""
    return F.when(F.size(context) >= length, F.slice(context, F.size(context) - (length - 1), length) if length else F.slice(context, 1, 0))


def context_counts(walks: DataFrame, order: int = ORDER) -> DataFrame:
    """(agent, context, target, n): how often a node of a walk (agent, walk, step, node) came after up to ``order`` nodes.

    Each node counts for the empty context and for every ending of what is before it. Walks are dealt into tasks of
    about TASK_ROWS counts each, which are combined there, and then the counts are, so a task's memory doesn't grow.
    """
    tasks = tasks_for(walks.sparkSession, walks.count() * (order + 1))
    part = F.pmod(F.xxhash64("agent", "walk"), F.lit(8 * tasks))  # several a task, so that tasks are nearly equal
    rows = _contexts(walks.withColumn("part", part).repartition(tasks, "part"), order, "part")
    endings = F.array_compact(F.array(*[_ending(F.col("before"), k) for k in range(order + 1)]))
    rows = rows.select("part", "agent", F.explode(endings).alias("context"), "target")
    within = rows.groupBy("part", "agent", "context", "target").agg(F.count("*").alias("n"))
    key = ["agent", "context", "target"]
    return within.repartition(tasks, *key).groupBy(*key).agg(F.sum("n").alias("n"))


def context_totals(counts: DataFrame) -> DataFrame:
    """(agent, context, total, kinds): how often a context had a node after it, and how many different ones."""
    return counts.groupBy("agent", "context").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))


def _backed_off(orders: list[tuple[Column, Column, Column]], uniform: Column) -> Column:
    """The probability from (n, total, kinds) of the shortest context to the longest; unknown ones change nothing."""
    p = uniform
    for n, total, kinds in orders:
        mixed = (F.coalesce(n, F.lit(0)) + kinds * p) / (total + kinds)
        p = F.when(total.isNotNull(), mixed).otherwise(p)
    return p


def predict_after(counts: DataFrame, agent: str, context: list, top_k: int | None = None) -> DataFrame:
    """(target, probability) of the likeliest nodes after a list of nodes; only the rows of its endings are read.

    Every node that any walk of the agent holds has a probability, and they add up to 1.
    """
    node = counts.schema["target"].dataType.simpleString()
    endings = [context[len(context) - k :] for k in range(len(context) + 1)]
    literal = lambda ending: F.array(*[F.lit(v) for v in ending]).cast(f"array<{node}>")
    length = F.size("context")
    own = counts.filter((F.col("agent") == agent) & F.array_contains(F.array(*map(literal, endings)), F.col("context")))
    totals = {row["k"]: row for row in own.groupBy(length.alias("k")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds")).collect()}
    columns = [F.sum(F.when(length == k, F.col("n"))).alias(f"n{k}") for k in sorted(totals)]
    wide = own.groupBy("target").agg(*columns) if columns else own.select("target")
    orders = [(F.col(f"n{k}"), F.lit(totals[k]["total"]), F.lit(totals[k]["kinds"])) for k in sorted(totals)]
    p = _backed_off(orders, F.lit(1.0 / totals[0]["kinds"] if totals else 0.0))
    return wide.select("target", p.alias("probability")).orderBy(F.desc("probability"), "target").limit(clamped(top_k))


def walk_likelihoods(counts: DataFrame, walks: DataFrame, order: int = ORDER) -> DataFrame:
    """(agent, walk, nodes, log_likelihood): the sum of the logarithms of each node's probability after those before it.

    A node that no walk of the agent held when counting has the probability of one more kind. Endings are looked up by
    one join per length with the counts, which are written once.
    """
    counts = written(counts, "context-counts")
    totals = written(context_totals(counts), "context-totals")
    rows = _contexts(walks, order)
    orders = []
    for k in range(order + 1):
        rows = rows.withColumn(f"c{k}", _ending(F.col("before"), k))
        at = totals.select("agent", F.col("context").alias(f"c{k}"), F.col("total").alias(f"t{k}"), F.col("kinds").alias(f"k{k}"))
        n = counts.select("agent", F.col("context").alias(f"c{k}"), "target", F.col("n").alias(f"n{k}"))
        rows = rows.join(at, ["agent", f"c{k}"], "left").join(n, ["agent", f"c{k}", "target"], "left")
        orders.append((F.col(f"n{k}"), F.col(f"t{k}"), F.col(f"k{k}")))
    p = _backed_off(orders, 1.0 / (F.coalesce("k0", F.lit(0)) + 1))
    return rows.groupBy("agent", "walk").agg(F.count("*").alias("nodes"), F.sum(F.log(p)).alias("log_likelihood"))
