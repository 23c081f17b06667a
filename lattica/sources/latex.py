"""LaTeX and BibTeX sources as rows: commands with their places, reference edges, bibliography entries and fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Commands by the kind of node that they make.
SECTIONS = ("part", "chapter", "section", "subsection", "subsubsection", "paragraph", "subparagraph")
REFERENCES = ("ref", "eqref", "pageref", "autoref", "nameref", "cref", "Cref", "vref")
COMMAND = r"\\([A-Za-z]+)\*?(?:\[[^\]]*\])*\{([^{}]*)\}"
ENTRY = r"(?s)@(\w+)\s*\{\s*([^,\s{}]+)\s*,(.*?)\n\s*\}"
FIELD = r'(\w+)\s*=\s*(?:\{((?:[^{}]|\{[^{}]*\})*)\}|"([^"]*)"|(\w+))'
#: Entries of a bibliography that name no work.
NO_WORKS = ("comment", "preamble", "string")


def sources(files: DataFrame) -> DataFrame:
    """(doc, text) of files (path, content), for :func:`commands` and :func:`bib_fields`; null content is empty."""
    return files.select(F.col("path").alias("doc"), F.coalesce(F.col("content").cast("string"), F.lit("")).alias("text"))


def _found(docs: DataFrame) -> DataFrame:
    """(doc, found): the commands of each source as an array of (position, kind, argument), kinds that aren't read left out."""
    text = F.regexp_replace("text", r"(?m)%(?<!\\%).*$", "").alias("text")
    group = lambda k: F.regexp_extract_all("text", F.lit(COMMAND), F.lit(k))
    found = docs.select("doc", text).select("doc", F.arrays_zip(group(1).alias("command"), group(2).alias("argument")).alias("found"))
    kind = lambda command: (
        F.when(command.isin(*SECTIONS), F.concat(F.lit("latex_"), command))
        .when(command == "label", "latex_label")
        .when(command.isin(*REFERENCES), "latex_ref")
        .when(F.contains(F.lower(command), F.lit("cite")), "latex_cite")
        .when(command == "begin", "latex_environment")
    )
    made = F.transform("found", lambda c, i: F.struct(i.alias("position"), kind(c["command"]).alias("kind"), c["argument"].alias("argument")))
    return found.select("doc", F.filter(made, lambda c: c["kind"].isNotNull()).alias("found"))


def _names(found: Column) -> Column:
    """The names in a command's argument: several in citations and references."""
    several = found["kind"].isin("latex_cite", "latex_ref")
    names = F.when(several, F.split(found["argument"], r"\s*,\s*")).otherwise(F.array(found["argument"]))
    return F.transform(names, lambda name: F.trim(name))


def commands(docs: DataFrame) -> DataFrame:
    """(doc, position, kind, name) of sections, labels, references, citations and environments of sources (doc, text).

    A citation of several keys makes a row for each. Comments, from a % that no backslash precedes, are not read.
    """
    # a plain explode would have Spark look for empty arrays first, and find the commands once more for that
    rows = _found(docs).select("doc", F.explode_outer("found").alias("c")).filter("c IS NOT NULL")
    return rows.select("doc", "c.position", "c.kind", F.explode(_names(F.col("c"))).alias("name"))


def references(docs: DataFrame) -> DataFrame:
    """:func:`reference_edges` of sources (doc, text), a row per document: they are found within each row, without a shuffle."""
    of = lambda kind: F.filter("found", lambda c: c["kind"] == kind)
    named = _found(docs).select("doc", of("latex_label").alias("labels"), of("latex_ref").alias("refs"))
    names = F.transform("labels", lambda c: F.trim(c["argument"])).alias("names")
    rows = named.select("doc", names, F.col("labels.position").alias("places"), F.explode_outer("refs").alias("c")).filter("c IS NOT NULL")
    rows = rows.select("doc", "names", "places", "c.position", F.explode(_names(F.col("c"))).alias("name"))
    rows = rows.withColumn("label", F.array_position("names", F.col("name"))).filter("label > 0")
    target = F.element_at("places", F.col("label").cast("int"))
    return rows.select("doc", F.col("position").alias("source_position"), target.alias("target_position"))


def reference_edges(commands: DataFrame) -> DataFrame:
    """(doc, source_position, target_position): each reference and the first label of its name in the same document."""
    of_name = Window.partitionBy("doc", "name")
    label = F.col("kind") == "latex_label"
    rows = commands.filter(label | (F.col("kind") == "latex_ref"))
    rows = rows.withColumn("target_position", F.min(F.when(label, F.col("position"))).over(of_name))
    rows = rows.filter((F.col("kind") == "latex_ref") & F.col("target_position").isNotNull())
    return rows.select("doc", F.col("position").alias("source_position"), "target_position")


def bib_fields(docs: DataFrame) -> DataFrame:
    """(doc, key, type, field, value) of bibliographies (doc, text); an entry ends at a brace that begins a line."""
    found = docs.select("doc", F.explode(F.regexp_extract_all("text", F.lit(ENTRY), F.lit(0))).alias("found"))
    part = lambda k: F.regexp_extract("found", ENTRY, k)
    entries = found.select("doc", part(2).alias("key"), F.lower(part(1)).alias("type"), part(3).alias("body"))
    entries = entries.filter(~F.col("type").isin(*NO_WORKS))
    fields = entries.select("doc", "key", "type", F.explode(F.regexp_extract_all("body", F.lit(FIELD), F.lit(0))).alias("found"))
    value = F.concat(*[F.regexp_extract("found", FIELD, k) for k in (2, 3, 4)])
    name = F.lower(F.regexp_extract("found", FIELD, 1))
    return fields.select("doc", "key", "type", name.alias("field"), F.regexp_replace(value, r"\s+", " ").alias("value"))
