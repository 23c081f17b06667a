"""Markdown documents as nodes: lines are classified, gathered into blocks and nested under headings.

A document is one text of one row, and stays one until its blocks are rows: nothing is shuffled or sorted for it. Spark tells
what each line looks like, a helper goes over these numbers. The parent of a heading is the last heading before it of a lower
level, that of any other block the last heading. An item of a list hangs on the item within whose text it is indented.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructType

from lattica.sources.repository import normalized

FENCE = r"^ {0,3}(?:```|~~~)"
HEADING = r"^ {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?$"
RULE = r"^ {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$"
ITEM = r"^ {0,3}([-*+]|\d{1,9}[.)])[ \t]+(.*)$"
#: An item of a list that has begun, however far it is indented, and a line that ends all lists.
INNER_ITEM = r"^[ \t]*([-*+]|\d{1,9}[.)])[ \t]+(.*)$"
FLUSH = r"^[^ \t]"
QUOTE = r"^ {0,3}>[ ]?(.*)$"
TABLE = r"^ {0,3}\|"
LINK = r"\[[^\]]*\]\(([^)\s]+)[^)]*\)"

#: What a line looks like by itself, as bits of a number; above them its level as a heading, and an item's width and indent.
FENCE_LINE, BLANK_LINE, RULE_LINE, ITEM_LINE, INNER_LINE, QUOTE_LINE, TABLE_LINE, FLUSH_LINE = (1 << k for k in range(8))
LEVEL, WIDTH, MARGIN = 1 << 8, 1 << 11, 1 << 16
KINDS = ((BLANK_LINE, "blank"), (LEVEL * 7, "heading"), (RULE_LINE, "thematic_break"))
LATER_KINDS = ((QUOTE_LINE, "block_quote"), (TABLE_LINE, "table"))


def _shape(line: Column) -> Column:
    """The number of a line: its bits, level, width of marker and space, and indent with four for a tab."""
    like = lambda pattern: F.rlike(line, F.lit(pattern))
    bit = lambda condition, value: F.when(condition, value).otherwise(0)
    rule, inner = like(RULE), like(INNER_ITEM)
    margin = F.length(F.replace(F.regexp_extract(line, r"^([ \t]*)", 1), F.lit("\t"), F.lit("    ")))
    width = F.length(F.regexp_extract(line, INNER_ITEM, 1)) + 1
    level = F.length(F.regexp_extract(line, HEADING, 1))  # 0 if it is none
    shape = (
        bit(like(FENCE), FENCE_LINE) + bit(rule, RULE_LINE) + bit(like(QUOTE), QUOTE_LINE) + bit(like(TABLE), TABLE_LINE)
        + bit(like(FLUSH), FLUSH_LINE) + level * LEVEL
        + F.when(inner, bit(like(ITEM) & ~rule, ITEM_LINE) + INNER_LINE + width * WIDTH + margin.cast("long") * MARGIN).otherwise(0)
    )
    return F.when(line == "", F.lit(BLANK_LINE)).otherwise(shape).cast("long")


BLOCKS = ArrayType(
    StructType()
    .add("line", IntegerType()).add("n", IntegerType()).add("kind", StringType()).add("open", ArrayType(IntegerType())).add("indent", IntegerType())
)


@F.pandas_udf(BLOCKS)
def _laid(documents: pd.Series) -> pd.Series:
    """The blocks of documents, given as the shapes of their lines: first line, number of lines, kind, the lines of the
    headings and items that a block hangs on, outermost first, and the indent that an item needs at least.

    An item lies within those whose text starts at its marker or before it; any other block ends the lists.
    """

    def document(shapes) -> list[dict]:
        out: list[dict] = []
        fenced = in_list = False
        before = None
        headings: list[tuple[int, int]] = []  # level, line
        held: list[tuple[int, int, int]] = []  # line, and where the text starts, as written and as needed
        for line, shape in enumerate(shapes):
            fence, item = shape & FENCE_LINE, shape & ITEM_LINE
            fenced ^= bool(fence)
            in_list = (in_list or not fenced) if item else in_list and not shape & FLUSH_LINE
            if fence or fenced:
                kind = "code_block"
            else:
                kind = next((k for bit, k in KINDS if shape & bit), None)
                if kind is None and (item or (in_list and shape & INNER_LINE)):
                    kind = "list_item"
                kind = kind or next((k for bit, k in LATER_KINDS if shape & bit), "paragraph")
            goes_on = kind == before and kind not in ("heading", "list_item", "thematic_break") and not (fence and fenced)
            before = kind
            if kind == "blank":
                continue
            if goes_on:
                out[-1]["n"] += 1
                continue
            needed = 0
            if kind == "list_item":
                indent, width = shape // MARGIN, shape // WIDTH % (MARGIN // WIDTH)
                while held and held[-1][1] > indent:
                    held.pop()
                needed = held[-1][2] if held else 0
            else:
                held = []
            level = shape // LEVEL % 8
            while kind == "heading" and headings and headings[-1][0] >= level:
                headings.pop()
            around = [h[1] for h in headings] + [h[0] for h in held]
            out.append({"line": line, "n": 1, "kind": kind, "open": around, "indent": needed})
            if kind == "list_item":
                held.append((line, indent + width, needed + width))
            elif kind == "heading":
                headings.append((level, line))
        return out

    return pd.Series([document(shapes.tolist()) for shapes in documents], dtype=object)


def nodes(docs: DataFrame) -> DataFrame:
    """Nodes of Markdown documents (doc, text): doc, id, kind, content, parent_id, position, path, level, marker, indent.

    Ids are ``doc#line``. An item that is indented to another's text or beyond hangs on that item, to any depth. Blocks
    before the first heading hang on the document, whose own node is the caller's. Null and empty texts have no nodes.
    """
    split = F.split(F.rtrim(normalized(F.coalesce("text", F.lit("")))), "\n")
    rows = docs.select("doc", split.alias("texts"))
    rows = rows.select("doc", "texts", _laid(F.transform("texts", _shape)).alias("blocks"))
    block = lambda b: F.struct(*[b[c].alias(c) for c in ("line", "kind", "open", "indent")], F.slice("texts", b["line"] + 1, b["n"]).alias("texts"))
    # an outer explode: before a plain one Spark looks for empty arrays, and lays the blocks once more for that
    rows = rows.select("doc", F.posexplode_outer(F.transform("blocks", block)).alias("position", "b")).filter("b IS NOT NULL")
    rows = rows.select("doc", "position", "b.line", "b.kind", "b.open", "b.indent", "b.texts")
    kind, first = F.col("kind"), F.col("texts")[0]
    of = lambda pattern, group: F.regexp_extract(first, pattern, group)
    unquoted = F.transform("texts", lambda t: F.regexp_extract(t, QUOTE, 1))
    unfenced = F.filter("texts", lambda t: ~F.rlike(t, F.lit(FENCE)))
    content = (
        F.when(kind == "heading", of(HEADING, 2))
        .when(kind == "list_item", of(INNER_ITEM, 2))
        .when(kind == "block_quote", F.array_join(unquoted, "\n"))
        .when(kind == "code_block", F.array_join(unfenced, "\n"))
        .when(kind == "paragraph", F.array_join(F.transform("texts", lambda t: F.trim(t)), " "))
        .otherwise(F.array_join("texts", "\n"))
    )
    marker = (
        F.when(kind == "list_item", of(INNER_ITEM, 1))
        .when(kind == "code_block", F.trim(F.regexp_replace(first, FENCE + "[`~]*", "")))
    )
    level = F.when(kind == "heading", F.length(of(HEADING, 1)))
    doc, line = F.col("doc").cast("string"), F.col("line").cast("string")
    parent = F.when(F.size("open") > 0, F.concat_ws("#", doc, F.element_at("open", -1).cast("string"))).otherwise(doc)
    path = F.array_join(F.concat(F.array(doc), F.col("open").cast("array<string>"), F.array(line)), ".")
    return rows.select(
        "doc", F.concat_ws("#", doc, line).alias("id"), "kind", content.alias("content"), parent.alias("parent_id"),
        "position", path.alias("path"), level.alias("level"), marker.alias("marker"), "indent",
    )


def links(nodes: DataFrame) -> DataFrame:
    """(source_id, target, relation): ``links_to`` of each link without a scheme that leaves its page, code aside."""
    found = F.explode(F.regexp_extract_all("content", F.lit(LINK), F.lit(1))).alias("target")
    rows = nodes.filter("kind != 'code_block'").select(F.col("id").alias("source_id"), found, F.lit("links_to").alias("relation"))
    scheme = F.rlike("target", F.lit("^[A-Za-z][A-Za-z0-9+.-]*:"))
    return rows.filter(~scheme & ~F.startswith("target", F.lit("#"))).distinct()


def reconstruct(nodes: DataFrame) -> DataFrame:
    """(doc, text): the Markdown of nodes, which parses to the same nodes again (ids go by line and may differ)."""
    text = (
        F.when(F.col("kind") == "heading", F.rtrim(F.concat(F.repeat(F.lit("#"), F.col("level")), F.lit(" "), "content")))
        .when(F.col("kind") == "list_item", F.concat(F.repeat(F.lit(" "), F.col("indent")), "marker", F.lit(" "), "content"))
        .when(F.col("kind") == "block_quote", F.concat(F.lit("> "), F.replace("content", F.lit("\n"), F.lit("\n> "))))
        .when(F.col("kind") == "code_block", F.concat(F.lit("```"), "marker", F.lit("\n"), "content", F.lit("\n```")))
        .otherwise(F.col("content"))
    )
    joined = nodes.select("doc", F.struct("position", "kind", text.alias("text")).alias("p")).groupBy("doc").agg(F.sort_array(F.collect_list("p")).alias("parts"))

    def part(p: Column, k: Column) -> Column:
        both_items = (F.get("parts", k - 1)["kind"] == "list_item") & (p["kind"] == "list_item")
        return F.concat(F.when(k == 0, "").when(both_items, "\n").otherwise("\n\n"), p["text"])

    shown = F.filter(F.transform("parts", part), lambda p: p.isNotNull())
    return joined.select("doc", F.concat(F.array_join(shown, ""), F.lit("\n")).alias("text"))
