"""Tables of source code: naming findings, canonical order of imports, and groups of comment lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Rule, kinds it judges, pattern of good names, severity.
NAMING = (
    ("non_snake_fn", ("fn",), "^[a-z0-9_]+$", "warning"),
    ("non_camel_type", ("struct", "enum", "trait", "union", "type_alias"), "^[A-Z][A-Za-z0-9]*$", "warning"),
    ("non_upper_const", ("const",), "^[A-Z0-9_]+$", "info"),
)
VISIBILITY = r"^pub(?:\([^)]*\))?\s+"


def naming_findings(nodes: DataFrame) -> DataFrame:
    """(id, rule, severity) of nodes (id, kind, content) with names against convention; a leading ``_`` excuses."""
    rule, severity = F.lit(None).cast("string"), F.lit(None).cast("string")
    for name, kinds, pattern, weight in NAMING:
        bad = F.col("kind").isin(*kinds) & ~F.rlike("content", F.lit(pattern))
        rule, severity = F.when(bad, name).otherwise(rule), F.when(bad, weight).otherwise(severity)
    rows = nodes.filter("content IS NOT NULL AND NOT startswith(content, '_')")
    return rows.select("id", rule.alias("rule"), severity.alias("severity")).filter("rule IS NOT NULL")


def import_key(source: Column) -> Column:
    """The path of a ``use`` line without visibility, spaces around ``::`` and the semicolon, in small letters."""
    path = F.regexp_replace(F.regexp_replace(F.trim(source), VISIBILITY, ""), r"^use\s+", "")
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(path, r"\s*::\s*", "::"), r"\s*;+$", "")))


def sorted_imports(imports: DataFrame) -> DataFrame:
    """(file, place, source) of imports (file, position, source): standard, external, internal; each by key, once.

    Of imports with one key the first stays.
    """
    key = F.col("key")
    group = (
        F.when(F.rlike(key, F.lit("^(?:std|core|alloc)(?:::|$)")), 0)
        .when(F.rlike(key, F.lit("^(?:crate|self|super)(?:::|$)")), 2)
        .otherwise(1)
    )
    rows = imports.withColumn("key", import_key(F.col("source")))
    first = rows.groupBy("file", "key").agg(F.min_by("source", "position").alias("source")).withColumn("group", group)
    order = Window.partitionBy("file").orderBy("group", "key")
    return first.select("file", (F.row_number().over(order) - 1).alias("place"), "source")


def comment_groups(comments: DataFrame) -> DataFrame:
    """(file, column, first_line, last_line, text): comments (file, line, column, text) on adjacent lines of one column."""
    order = Window.partitionBy("file", "column").orderBy("line")
    rows = comments.withColumn("island", F.col("line") - F.row_number().over(order))
    grouped = rows.groupBy("file", "column", "island").agg(
        F.min("line").alias("first_line"), F.max("line").alias("last_line"),
        F.sort_array(F.collect_list(F.struct("line", "text"))).alias("lines"),
    )
    return grouped.select(
        "file", "column", "first_line", "last_line", F.array_join(F.transform("lines", lambda x: x["text"]), "\n").alias("text")
    )


# The flags of directives.
FLAGS = ("skip", "skip-sort-imports", "skip-order-derives", "skip-suggestions")


def directives(lines: DataFrame, name: str) -> DataFrame:
    """(file, line, flag, message, rule) of comments ``// <name>:...`` in lines (file, line, text).

    A directive is one of FLAGS, or a message and the rule that it is about in brackets; others are no directives.
    """
    content = F.trim(F.regexp_extract(F.trim("text"), rf"^//\s?{name}:(.*)$", 1))
    rows = lines.withColumn("content", content).filter("content != ''")
    flag = F.when(F.col("content").isin(*FLAGS), F.col("content"))
    pattern = r"^(.+?)\s*\(([A-Za-z0-9_]+)\)$"
    part = lambda k: F.when(flag.isNull(), F.nullif(F.regexp_extract("content", pattern, k), F.lit("")))
    rows = rows.select("file", "line", flag.alias("flag"), part(1).alias("message"), part(2).alias("rule"))
    return rows.filter("flag IS NOT NULL OR rule IS NOT NULL")


def ordered_derives(source: Column) -> Column:
    """Text with the names in each ``#[derive(...)]`` of a line in alphabetical order, whatever their case."""
    pattern = r"#\[derive\(([^)]*)\)\]"
    names = F.transform(F.split(F.regexp_extract(source, pattern, 1), ","), lambda n: F.trim(n))
    keyed = F.array_sort(F.transform(F.filter(names, lambda n: n != ""), lambda n: F.struct(F.lower(n).alias("k"), n.alias("n"))))
    listed = F.array_join(F.transform(keyed, lambda x: x["n"]), ", ")
    start = F.regexp_instr(source, F.lit(pattern))
    found = F.regexp_extract(source, pattern, 0)
    before = F.substring(source, F.lit(1), start - 1)
    after = F.substring(source, start + F.length(found), F.length(source))
    return F.when(found == "", source).otherwise(F.concat(before, F.lit("#[derive("), listed, F.lit(")]"), after))


def placed_comments(comments: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, first_line, last_line, placement, node_id) of comments (file, first_line, last_line) among nodes (file, line, id).

    A comment of one line that a node begins on is trailing; one just before the next node, or before all of them, is
    above it; any other is between, or at the end of the file. Both lie in one order of lines, so the nearest nodes
    come from windows over the lines of a file.
    """
    here = nodes.groupBy("file", "line").agg(F.min("id").alias("id"))
    ends = comments.select("file", F.col("last_line").alias("line"), F.lit(None).cast("string").alias("id"), "first_line", "last_line")
    begins = here.select("file", "line", F.col("id").cast("string").alias("id"), F.lit(None).cast("int").alias("first_line"), F.lit(None).cast("int").alias("last_line"))
    both = begins.unionByName(ends.withColumn("first_line", F.col("first_line").cast("int")).withColumn("last_line", F.col("last_line").cast("int")))
    after = Window.partitionBy("file").orderBy("line").rangeBetween(1, Window.unboundedFollowing)
    found = F.when(F.col("id").isNotNull(), F.struct("line", "id"))
    both = both.withColumns({"next": F.min(found).over(after), "first_of_file": F.min(found).over(Window.partitionBy("file"))})
    rows = both.filter("last_line IS NOT NULL").join(
        here.select("file", F.col("line").alias("first_line"), F.col("id").cast("string").alias("same")), ["file", "first_line"], "left"
    )
    one = F.col("first_line") == F.col("last_line")
    earlier = F.coalesce(F.col("first_of_file.line") < F.col("first_line"), F.lit(False))
    placement = (
        F.when(one & F.col("same").isNotNull(), "trailing")
        .when(F.col("next").isNull(), "eof")
        .when((F.col("next.line") == F.col("last_line") + 1) | ~earlier, "above")
        .otherwise("between")
    )
    node = F.when(one & F.col("same").isNotNull(), F.col("same")).otherwise(F.col("next.id"))
    return rows.select("file", "first_line", "last_line", placement.alias("placement"), node.alias("node_id"))
