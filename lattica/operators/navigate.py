"""Structural queries over the node tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.functions.paths import matches
from lattica.tables import scratch_path, written

# Kinds of nodes that define a symbol and that refer to one.
DEFINING = ("fn", "struct", "enum", "trait", "impl", "mod", "const", "static", "type_alias", "macro_def", "union")
REFERRING = ("path", "call", "method_call", "ident", "use", "type_path", "field", "macro_call", "param", "expr_path")


def clamped(limit: int | None, default: int = 50, most: int = 1000) -> int:
    return max(1, min(most, default if limit is None else limit))


def find(nodes: DataFrame, pattern: str, kind: str | None = None, limit: int | None = None) -> DataFrame:
    """Nodes whose content matches a case-insensitive LIKE pattern, by kind, content and id."""
    found = nodes.filter(F.col("content").ilike(pattern))
    if kind is not None:
        found = found.filter(F.col("kind") == kind)
    order = [F.asc_nulls_last("kind"), F.asc_nulls_last("content"), F.asc("id")]
    return found.select("id", "kind", "content", "path").orderBy(*order).limit(clamped(limit))


def refs(nodes: DataFrame, symbol: str, defining=DEFINING, referring=REFERRING) -> DataFrame:
    """Definitions, references (with the parent's kind and content) and implementations of a symbol."""
    named = nodes.filter(F.col("content") == symbol)
    parent = nodes.select(
        F.col("id").alias("parent"), F.col("kind").alias("parent_kind"), F.col("content").alias("parent_content")
    )
    nothing = F.lit(None).cast("string")
    definitions = named.filter(F.col("kind").isin(*defining)).select(
        F.lit("definition").alias("role"), "id", "kind", "path", nothing.alias("parent_kind"), nothing.alias("parent_content")
    )
    references = named.filter(F.col("kind").isin(*referring)).join(parent, F.col("parent_id") == F.col("parent"), "left")
    references = references.select(F.lit("reference").alias("role"), "id", "kind", "path", "parent_kind", "parent_content")
    impls = nodes.filter((F.col("kind") == "impl") & (F.get_json_object("metadata", "$.self_ty") == symbol))
    impls = impls.select(
        F.lit("impl").alias("role"), "id", "kind", "path", nothing.alias("parent_kind"), nothing.alias("parent_content")
    )
    return definitions.unionByName(references).unionByName(impls)


def with_child_count(chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """``chosen`` with their numbers of children; only children of chosen nodes are counted.

    The chosen nodes are written once: they are met twice, and by their size Spark sees whether to broadcast them.
    """
    chosen = written(chosen, "chosen")
    below = nodes.select(F.col("parent_id").alias("of"))
    below = below.join(chosen.select(F.col("id").alias("of")), "of", "left_semi")
    counts = below.groupBy("of").agg(F.count("*").alias("child_count"))
    joined = chosen.join(counts, F.col("id") == F.col("of"), "left")
    return joined.select(
        "id", "kind", "content", "position", "path", F.coalesce("child_count", F.lit(0)).cast("long").alias("child_count")
    )


def tree(nodes: DataFrame, pattern: str | None = None) -> DataFrame:
    """The roots, or the nodes that a path or label pattern matches, with the number of children of each."""
    chosen = nodes.filter("parent_id IS NULL") if pattern is None else nodes.filter(matches(F.col("path"), pattern))
    return with_child_count(chosen, nodes).orderBy("path")


def children(nodes: DataFrame, node_id: str) -> DataFrame:
    return with_child_count(nodes.filter(F.col("parent_id") == node_id), nodes).orderBy("position", "id")


def _reached(links: DataFrame, start: DataFrame) -> DataFrame:
    """(id, depth) of what ``links`` (source, target) reach from ``start`` (id), which has depth 0.

    One join per level with the level before, until a level is empty. Each level is a folder of one written table, so
    neither the number of rows nor the depth is limited, and a lost executor costs a level. What was reached before is
    not reached again, so links that lead back end too.
    """
    spark = links.sparkSession
    links = written(links, "links")
    folder = scratch_path(spark, "reached")
    start = start.select("id").distinct()
    start.write.parquet(f"{folder}/depth=0")
    schema = f"id {start.schema['id'].dataType.simpleString()}, depth int"
    depth = 0
    while True:
        found = spark.read.schema(schema).parquet(folder)
        last = found.filter(F.col("depth") == depth).select(F.col("id").alias("source"))
        further = links.join(last, "source").select(F.col("target").alias("id")).distinct().join(found, "id", "left_anti")
        depth += 1
        further.write.parquet(f"{folder}/depth={depth}")
        if not spark.read.schema(schema).parquet(f"{folder}/depth={depth}").limit(1).count():
            return spark.read.schema(schema).parquet(folder)


def ancestors(nodes: DataFrame, node_id: str) -> DataFrame:
    """The parents of a node up to its root; depth 0 is the immediate parent."""
    up = nodes.filter("parent_id IS NOT NULL").select(F.col("id").alias("source"), F.col("parent_id").alias("target"))
    found = _reached(up, nodes.filter(F.col("id") == node_id)).filter("depth > 0").select("id", (F.col("depth") - 1).alias("depth"))
    return nodes.join(found, "id").select("id", "kind", "content", "path", "depth")


def below(nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """(id, depth) of ``roots`` (id) and all nodes below them, by their parents: for trees whose paths aren't kept up."""
    down = nodes.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("source"), F.col("id").alias("target"))
    return _reached(down, roots)


def descendants(nodes: DataFrame, node_id: str) -> DataFrame:
    """A node and all below it with their depth, by their parents."""
    found = below(nodes, nodes.filter(F.col("id") == node_id))
    return nodes.join(found, "id").select("id", "kind", "content", "parent_id", "position", "depth")


def documents(nodes: DataFrame) -> DataFrame:
    """Document nodes with their number of direct children."""
    return with_child_count(nodes.filter("kind = 'document'"), nodes).orderBy("content", "id")
