"""Citations: extraction from paragraphs, scoring of references, and links from citation keys to bibliographies.

Extraction is done with Spark's regular expressions; each extractor explodes its matches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.tables import written

# Patterns of the extractors.
BIBLIOGRAPHY = (
    r"([A-Z][a-z\x{00AD}\x{00C0}-\x{024F}]+(?:,\s*(?:[A-Z]\.\s*)+(?:and\s+)?)*(?:,?\s*(?:et\s+al\.))?)\s*\((\d{4}[a-z]?)\)\.\s*"
    r"[\"\x{201C}]([^\"\x{201D}]+)[\"\x{201D}]"
)
INLINE = (
    r"\(([A-Z][a-z\x{00AD}\x{00C0}-\x{024F}]+(?:(?:,?\s*(?:and|&)\s*)?[A-Z][a-z\x{00AD}\x{00C0}-\x{024F}]+)*(?:,?\s*et\s+al\.?)?),?\s*"
    r"(\d{4}[a-z]?)\)"
)
DOI = r"doi:?(10\.\d{4,}/[^\s,;]+)"
ARXIV = r"arXiv[:\s]+([\d.]+(?:v\d+)?(?:\s*\[[a-z.,\s]+\])?)"
URL = r"(https?://[^\s,;)\]]+)"
#: Characters from the start of a bibliography entry in which its DOI stands.
DOI_REACH = 500
#: Extractors in the order in which they win a key: name, pattern, number of groups.
PRIORITY = ("bibliography", "citation", "doi", "arxiv", "url")
# How well a kind of reference can be resolved; others have 0.2.
RESOLVABILITY = {"doi": 1.0, "arxiv": 0.9, "url": 0.8, "bibliography": 0.6, "citation": 0.4}
MIN_LENGTH = 50
#: Surnames and characters of surnames that one automaton holds; more are looked for in several passes over the strings.
MAX_NAMES, MAX_NAME_CHARS = 500_000, 16_000_000


def first_author(authors: Column) -> Column:
    """The first surname in small letters, without soft hyphens, hyphens and hard spaces."""
    surname = F.regexp_extract(F.substring_index(authors, ",", 1), r"(\S+)", 1)
    return F.translate(F.lower(surname), "\u00ad\u00a0-", "")


def author_year_key(authors: Column, year: Column) -> Column:
    return F.concat(first_author(authors), F.lit("-"), year)


def _stripped(value: Column) -> Column:
    return F.regexp_replace(value, r"\.+$", "")


def extract(paragraphs: DataFrame) -> DataFrame:
    """(id, extractor, key, title) for every citation in paragraphs (id, content) of over 50 characters.

    The paragraphs are read once: all matches of a paragraph are one array. A bibliography entry has the DOI that
    stands within DOI_REACH characters from its start as its key, else the first author and the year.
    """
    content, none = F.col("content"), F.lit(None).cast("string")

    def matches(kind: str, pattern: str, key, title=lambda found: none) -> Column:
        found = F.regexp_extract_all(content, F.lit(pattern), F.lit(0))
        return F.transform(found, lambda f: F.struct(F.lit(kind).alias("extractor"), key(f).alias("key"), title(f).alias("title")))

    group = lambda found, pattern, n: F.regexp_extract(found, pattern, n)

    def entry_key(found: Column) -> Column:
        start = F.position(found, content)
        doi = group(F.substring(content, start, F.lit(DOI_REACH)), DOI, 1)
        named = author_year_key(group(found, BIBLIOGRAPHY, 1), group(found, BIBLIOGRAPHY, 2))
        return F.when(doi != "", _stripped(doi)).otherwise(named)

    all_found = F.concat(
        matches("bibliography", BIBLIOGRAPHY, entry_key, lambda f: F.trim(group(f, BIBLIOGRAPHY, 3))),
        matches("citation", INLINE, lambda f: author_year_key(group(f, INLINE, 1), group(f, INLINE, 2))),
        matches("doi", DOI, lambda f: _stripped(group(f, DOI, 1))),
        matches("arxiv", ARXIV, lambda f: F.concat(F.lit("arxiv:"), _stripped(F.regexp_extract(group(f, ARXIV, 1), r"(\S+)", 1)))),
        matches("url", URL, lambda f: _stripped(group(f, URL, 1))),
    )
    rows = paragraphs.filter(F.length("content") > MIN_LENGTH).select("id", F.explode(all_found).alias("c"))
    return rows.select("id", "c.*")


def references(extracted: DataFrame) -> DataFrame:
    """One row per key: the extractor of highest priority, its title, and the number of citing paragraphs."""
    place = F.array_position(F.array(*[F.lit(p) for p in PRIORITY]), F.col("extractor"))
    return extracted.groupBy("key").agg(
        F.min_by("extractor", F.struct(place, "id")).alias("extractor"),
        F.min_by("title", F.struct(place, "id")).alias("title"),
        F.count_distinct("id").alias("paragraphs"),
    )


def efe_score(cites: Column, documents: Column, novelty: Column, extractor: Column) -> Column:
    table = F.create_map(*[x for k, v in RESOLVABILITY.items() for x in (F.lit(k), F.lit(v))])
    resolvable = F.coalesce(table[extractor], F.lit(0.2))
    return 0.4 * F.log1p(cites) + 0.3 * F.log1p(documents) + 0.2 * novelty + 0.1 * resolvable


def known_names(names: DataFrame, strings: DataFrame, max_names: int = MAX_NAMES, max_chars: int = MAX_NAME_CHARS) -> DataFrame:
    """The rows of ``names`` (author) that stand anywhere in a string of ``strings`` (held), each once.

    The names are cut by hash into blocks of ``max_names`` and ``max_chars`` on average, each of which is broadcast as one
    automaton that reads every string once, whatever the names share; a task gives each name that it found once. Nulls
    and empty names are found nowhere. Work grows with the characters of the strings times the blocks.
    """
    spark = names.sparkSession
    names = written(names.select("author").filter("author != ''").distinct(), "names")
    strings = strings.select("held").filter("held IS NOT NULL")
    size = names.agg(F.count("*").alias("n"), F.sum(F.length("author")).alias("chars")).first()
    blocks = max(1, math.ceil(size["n"] / max_names), math.ceil((size["chars"] or 0) / max_chars))
    if blocks > 1:
        strings = written(strings, "name-strings")
    found = names.limit(0)
    for block in range(blocks if size["n"] else 0):
        rows = names.filter(F.pmod(F.xxhash64("author"), F.lit(blocks)) == block).toPandas()
        if len(rows):
            sent = spark.sparkContext.broadcast(rows["author"].tolist())
            found = found.unionByName(strings.mapInPandas(_holding(sent), "author string"))
    return found.distinct()


def _holding(sent):
    """A pass over strings that gives each of the broadcast names which stands in one of them once per task."""

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ahocorasick.Automaton()
        for name in sent.value:
            names.add_word(name, name)
        names.make_automaton()
        seen: set[str] = set()
        for batch in batches:
            for text in batch["held"]:
                seen.update(name for _, name in names.iter(text))
        yield pd.DataFrame({"author": sorted(seen)}, dtype=object)

    return scan


def score_references(refs: DataFrame, cites: DataFrame, resolved_authors: DataFrame) -> DataFrame:
    """Unresolved references (key, extractor, author) by score.

    ``cites`` is (key, paragraph, document). Novelty is 0.5 without an author, 0.1 if a resolved author string holds
    the first author's surname, else 1.
    """
    counts = cites.groupBy("key").agg(F.count("*").alias("cites"), F.count_distinct("document").alias("documents"))
    refs = refs.withColumn("author", first_author(F.coalesce("author", F.lit(""))))
    strings = resolved_authors.select(F.lower("authors").alias("held")).distinct()
    known = known_names(refs.select("author"), strings).withColumn("known", F.lit(True))
    joined = refs.join(counts, "key", "left").join(known, "author", "left")
    novelty = F.when(F.col("author") == "", 0.5).when(F.col("known"), 0.1).otherwise(1.0)
    zero = F.lit(0)
    score = efe_score(F.coalesce("cites", zero), F.coalesce("documents", zero), novelty, F.col("extractor"))
    return joined.select("key", "extractor", F.round(score, 3).alias("score")).orderBy(F.desc("score"), "key")


def link_citations(citations: DataFrame, entries: DataFrame) -> DataFrame:
    """(citation_id, key, entry_id): each key of a citation (id, keys JSON array) with its entry, null if unresolved."""
    keys = citations.select(F.col("id").alias("citation_id"), F.explode(F.from_json("keys", "array<string>")).alias("key"))
    named = entries.select(F.col("content").alias("key"), F.col("id").alias("entry_id"))
    return keys.join(named, "key", "left").select("citation_id", "key", "entry_id")


def link_counts(links: DataFrame) -> DataFrame:
    return links.agg(F.count("entry_id").alias("linked"), F.count_if(F.col("entry_id").isNull()).alias("unresolved"))


def new_edges(cites: DataFrame, edges: DataFrame) -> DataFrame:
    """(source_id, target_id, relation) of citations (paragraph, key) that aren't edges yet."""
    wanted = cites.select(F.col("paragraph").alias("source_id"), F.col("key").alias("target_id"), F.lit("cites").alias("relation"))
    return wanted.distinct().join(edges.select("source_id", "target_id", "relation"), ["source_id", "target_id", "relation"], "left_anti")
