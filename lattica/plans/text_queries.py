"""Queries on texts, CSV tables, walks and expressions, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import arithmetic
from lattica.operators import citations, fulltext, perspectives, walks
from lattica.plans import model
from lattica.plans.graph_queries import register_sql
from lattica.plans.oracle import ranked_sql
from lattica.sources import csv_import
from lattica.tables import scratch_path


@register_sql("extract_urls", """SELECT 'g' || page_id AS id, 'url' AS extractor, regexp_replace(u, '\\.+$', '') AS key
  FROM (SELECT page_id, unnest(regexp_extract_all(repeat('x', 60) || ' ' || url || ', text', 'https?://[^\\s,;)\\]]+')) AS u
        FROM pages)""")  # fmt: skip
def extract_urls(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("x"), 60), F.lit(" "), "url", F.lit(", text"))
    paragraphs = model.table(spark, d, "pages").select(
        F.concat(F.lit("g"), F.col("page_id").cast("string")).alias("id"), text.alias("content")
    )
    return citations.extract(paragraphs).drop("title")


@register_sql("reference_dedup", """SELECT key, 'doi' AS extractor, count(DISTINCT id) AS paragraphs FROM (
    SELECT page_id AS id, '10.1000/' || page_id % 20 AS key FROM pages) GROUP BY key""")
def reference_dedup(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.repeat(F.lit("x"), 60), F.lit(" doi:10.1000/"), (F.col("page_id") % 20).cast("string"), F.lit(", ..."))
    paragraphs = model.table(spark, d, "pages").select(F.col("page_id").alias("id"), text.alias("content"))
    return citations.references(citations.extract(paragraphs)).drop("title")


@register_sql("score_references", """WITH c AS (SELECT 'k' || p_brand AS key, count(*) AS cites, count(DISTINCT p_size) AS docs FROM part GROUP BY 1)
  SELECT key, 'doi' AS extractor, round(0.4 * ln(1 + cites) + 0.3 * ln(1 + docs) + 0.2 * 0.5 + 0.1 * 1.0, 3) AS score FROM c""")
def score_references(spark: SparkSession, d: str) -> DataFrame:
    part = model.table(spark, d, "part")
    cites = part.select(F.concat(F.lit("k"), "p_brand").alias("key"), F.col("p_partkey").alias("paragraph"), F.col("p_size").alias("document"))
    refs = cites.select("key").distinct().select("key", F.lit("doi").alias("extractor"), F.lit("").alias("author"))
    return citations.score_references(refs, cites, spark.createDataFrame([("Nobody",)], "authors string"))


@register_sql("link_citations", """SELECT count(p_partkey) AS linked, count(*) FILTER (p_partkey IS NULL) AS unresolved
  FROM (SELECT unnest([l_partkey, l_partkey + 1000000 * (l_linenumber % 2)]) AS k FROM lineitem) LEFT JOIN part ON k = p_partkey""")
def link_citations(spark: SparkSession, d: str) -> DataFrame:
    key, other = F.col("l_partkey"), F.col("l_partkey") + 1000000 * (F.col("l_linenumber") % 2)
    keys = F.to_json(F.array(key.cast("string"), other.cast("string")))
    found = model.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), keys.alias("keys"))
    entries = model.table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_partkey").cast("string").alias("content"))
    return citations.link_counts(citations.link_citations(found, entries))


@register_sql("fts_match", f"""SELECT id FROM {ranked_sql("document_nodes", "the Apache licensed", "kind = 'paragraph'")}""")
def fts_match(spark: SparkSession, d: str) -> DataFrame:
    paragraphs = model.document_nodes(spark, d).filter("kind = 'paragraph'")
    return fulltext.matches(paragraphs, "the Apache licensed").select("id")


@register_sql("fts_search", f"""SELECT r.id, n.kind, n.path, r.rank FROM {ranked_sql("document_nodes", "licensed under the Apache License", "kind = 'paragraph'")} r
  JOIN document_nodes n ON r.id = n.id ORDER BY rank DESC, r.id LIMIT 20""")
def fts_search(spark: SparkSession, d: str) -> DataFrame:
    return fulltext.search(model.document_nodes(spark, d), "licensed under the Apache License", "paragraph", 20)


@register_sql("fts_index", f"""SELECT id, rank FROM {ranked_sql("nodes", "hot widgets", "kind = 'part'")}""")
def fts_index(spark: SparkSession, d: str) -> DataFrame:
    """A search of a written index."""
    parts = model.nodes(spark, d).filter("kind = 'part'")
    folder = scratch_path(spark, "index")
    fulltext.write_index(parts, folder)
    terms = fulltext.query_terms(spark, "hot widgets")
    return fulltext.matches(parts, "hot widgets", fulltext.read_index(spark, folder, terms))


@register_sql("context_search", f"""WITH boost AS (SELECT node_id AS id, avg(weight) AS boost, count(DISTINCT agent_id) AS agents FROM perspectives
    WHERE agent_id IN (SELECT 'u' || i FROM range(20) r(i)) GROUP BY node_id)
  SELECT r.id, rank, round(rank * (1 + coalesce(boost, 0)), 9) AS combined, coalesce(agents, 0) AS agents
  FROM {ranked_sql("nodes", "old gears", "kind = 'part'")} r LEFT JOIN boost b ON r.id = b.id ORDER BY combined DESC, r.id LIMIT 50""")
def context_search(spark: SparkSession, d: str) -> DataFrame:
    parts = model.nodes(spark, d).filter("kind = 'part'")
    rated = perspectives.current_perspectives(model.perspective_log(spark, d))
    return fulltext.context_search(parts, rated, "old gears", [f"u{k}" for k in range(20)], 50)


@register_sql("csv_profile", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS rows, count(*) - count({c}) AS nil_count, count(*) FILTER ({c}::VARCHAR = '') AS empty,
  count(DISTINCT {c}) AS "distinct", min({c}::VARCHAR) AS min, max({c}::VARCHAR) AS max, '{t}' AS type, {p} AS partial,
  0.0 AS nil_rate, 0.0 AS nil_share FROM part"""
    for c, t, p in (("p_partkey", "BIGINT", "false"), ("p_name", "TEXT", "false"), ("p_brand", "TEXT", "false"), ("p_size", "BIGINT", "false"))
))
def csv_profile(spark: SparkSession, d: str) -> DataFrame:
    part = model.table(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size")
    return csv_import.profile(part.select(*[F.col(c).cast("string").alias(c) for c in part.columns]))


@register_sql("csv_promote", """SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN p_size::BIGINT END AS mixed,
  CASE WHEN p_partkey % 2 = 0 THEN p_size::VARCHAR ELSE p_brand END AS mixed_raw, p_brand FROM part""")
def csv_promote(spark: SparkSession, d: str) -> DataFrame:
    mixed = F.when(F.col("p_partkey") % 2 == 0, F.col("p_size").cast("string")).otherwise(F.col("p_brand"))
    part = model.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("p_partkey"), mixed.alias("mixed"), "p_brand")
    return csv_import.import_table(part)


#: Tables that are written as CSV and imported; nation_copy shares its columns with nation.
CSV_COLUMNS = {
    "region": {"r_regionkey": "BIGINT", "r_name": "TEXT"},
    "nation": {"n_nationkey": "BIGINT", "n_name": "TEXT", "n_regionkey": "BIGINT"},
    "supplier": {"s_suppkey": "BIGINT", "s_name": "TEXT", "s_nationkey": "BIGINT"},
    "part": {"p_partkey": "BIGINT", "p_name": "TEXT", "p_brand": "TEXT", "p_size": "BIGINT"},
    "customer": {"c_custkey": "BIGINT", "c_name": "TEXT", "c_nationkey": "BIGINT", "c_mktsegment": "TEXT"},
    "orders": {"o_orderkey": "BIGINT", "o_custkey": "BIGINT", "o_orderstatus": "TEXT", "o_orderpriority": "TEXT", "o_orderdate": "DATE"},
}


def _csv_folder(spark: SparkSession, d: str) -> str:
    """The tables of CSV_COLUMNS, and nation once more, each as one CSV file with its header."""
    folder = scratch_path(spark, "csv")
    for name, columns in [*CSV_COLUMNS.items(), ("nation_copy", CSV_COLUMNS["nation"])]:
        table = model.table(spark, d, name.removesuffix("_copy"))
        text = [(F.date_format(c, "yyyy-MM-dd") if kind == "DATE" else F.col(c).cast("string")).alias(c.upper()) for c, kind in columns.items()]
        table.select(*text).coalesce(1).write.csv(f"{folder}-parts/{name}", header=True)
        move_part(spark, f"{folder}-parts/{name}", f"{folder}/{name.title().replace('_', '')}.csv")
    return folder


def move_part(spark: SparkSession, folder: str, path: str) -> None:
    """Give the one part file of a written folder a name of its own."""
    jvm = spark.sparkContext._jvm
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    files = source.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(target.getParent())
    part = next(f.getPath() for f in files.listStatus(source) if f.getPath().getName().startswith("part-"))
    files.rename(part, target)


def _csv_listed() -> list[tuple[str, str, dict[str, str]]]:
    """(table, its name in the import, columns) in the order of the files."""
    names = [*CSV_COLUMNS, "nation_copy"]
    files = sorted(f"{n.title().replace('_', '')}.csv" for n in names)
    order = {csv_import.table_name(f): k for k, f in enumerate(files)}
    return sorted(((n.removesuffix("_copy"), n, CSV_COLUMNS[n.removesuffix("_copy")]) for n in names), key=lambda x: order[x[1]])


@register_sql("csv_directory_columns", " UNION ALL ".join(
    f"""SELECT 'retail.{name}.{c}' AS id, 'retail.{name}' AS parent_id, {k} AS position, '{kind}' AS type, false AS partial, count(*) AS rows,
  count(*) - count({c}) AS nil_count, count(DISTINCT {c}) AS "distinct" FROM {table}"""
    for table, name, columns in _csv_listed() for k, (c, kind) in enumerate(columns.items())
))
def csv_directory_columns(spark: SparkSession, d: str) -> DataFrame:
    nodes = csv_import.import_directory(spark, _csv_folder(spark, d), "retail").nodes.filter("kind = 'csv_column'")
    get = lambda key, kind: F.get_json_object("metadata", "$." + key).cast(kind).alias(key)
    return nodes.select(
        "id", "parent_id", "position", get("type", "string"), get("partial", "boolean"), get("rows", "long"), get("nil_count", "long"),
        get("distinct", "long"),
    )


@register_sql("csv_directory_tables", f"""SELECT 'retail' AS id, 'csv_dataset' AS kind, NULL AS parent_id, 0 AS position,
    ({" + ".join(f"(SELECT count(*) FROM {table})" for table, _, _ in _csv_listed())}) AS rows FROM region WHERE r_regionkey = 0 UNION ALL """
  + " UNION ALL ".join(f"SELECT 'retail.{name}', 'csv_table', 'retail', {k}, count(*) FROM {table}"
                       for k, (table, name, _) in enumerate(_csv_listed())))
def csv_directory_tables(spark: SparkSession, d: str) -> DataFrame:
    nodes = csv_import.import_directory(spark, _csv_folder(spark, d), "retail").nodes.filter("kind != 'csv_column'")
    rows = F.coalesce(F.get_json_object("metadata", "$.row_count"), F.get_json_object("metadata", "$.total_rows")).cast("long")
    return nodes.select("id", "kind", "parent_id", "position", rows.alias("rows"))


@register_sql("csv_directory_orders", """SELECT o_orderkey::BIGINT AS o_orderkey, o_custkey::BIGINT AS o_custkey, o_orderstatus, o_orderpriority,
  strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate FROM orders""")
def csv_directory_orders(spark: SparkSession, d: str) -> DataFrame:
    orders = csv_import.import_directory(spark, _csv_folder(spark, d), "retail").tables["orders"]
    return orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@register_sql("csv_quoted_parts", """SELECT doc_id::VARCHAR AS doc_id, source, md5(coalesce(text, '')) AS digest FROM documents""")
def csv_quoted_parts(spark: SparkSession, d: str) -> DataFrame:
    """Whole texts, with their line ends and quotes, written as CSV files and read back in parts."""
    folder = scratch_path(spark, "csv-quoted")
    docs = model.table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "source", "text")
    docs.write.csv(folder, header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    rows = csv_import.read_parts(spark, folder, ["doc_id", "source", "text"])
    return rows.select("doc_id", "source", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@register_sql("csv_shared_columns", " UNION ALL ".join(
    f"SELECT 'retail.nation.{c}' AS source_id, 'retail.nation_copy.{c}' AS target_id, 'shared_column' AS relation FROM region WHERE r_regionkey = 0"
    for c in CSV_COLUMNS["nation"]
))
def csv_shared_columns(spark: SparkSession, d: str) -> DataFrame:
    return csv_import.import_directory(spark, _csv_folder(spark, d), "retail").edges


@register_sql("vocab_build", "SELECT id, row_number() OVER (ORDER BY path, position, id) - 1 AS token FROM nodes")
def vocab_build(spark: SparkSession, d: str) -> DataFrame:
    return walks.vocabulary(model.nodes(spark, d))


@register_sql("walk_tree", """SELECT row_number() OVER (ORDER BY path, position, id) - 1 AS step, id FROM nodes
  WHERE (path = 'r2' OR starts_with(path, 'r2.')) ORDER BY path, position, id LIMIT 32""")
def walk_tree(spark: SparkSession, d: str) -> DataFrame:
    return walks.tree_walk(model.nodes(spark, d), "r2", 32)


@register_sql("adjacency", """WITH e AS (SELECT parent_id AS a, id AS b FROM nodes WHERE parent_id IS NOT NULL
    UNION ALL SELECT source_id, target_id FROM edges)
  SELECT source, count(*) AS neighbours FROM (SELECT a AS source, b AS target FROM e UNION SELECT b, a FROM e) GROUP BY source""")
def adjacency(spark: SparkSession, d: str) -> DataFrame:
    both = walks.adjacency(model.nodes(spark, d), model.edges(spark, d))
    return both.groupBy("source").agg(F.count("*").alias("neighbours"))


DRAWN = """floor((('0x' || substr(md5('3|{step}|' || walk || '|' || node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 * d.degree)"""


def _step_sql(step: int) -> str:
    return f"""s{step} AS (SELECT walk, n.target AS node FROM s{step - 1} JOIN (SELECT DISTINCT source, degree FROM numbered) d ON d.source = node
    JOIN numbered n ON n.source = d.source AND n.number = {DRAWN.format(step=step)})"""


@register_sql("walk_edges", f"""WITH e AS (SELECT DISTINCT source_id AS source, target_id AS target FROM edges),
  numbered AS (SELECT source, target, count(*) OVER (PARTITION BY source) AS degree,
    row_number() OVER (PARTITION BY source ORDER BY ('0x' || substr(md5(target), 1, 4))::BIGINT % {walks.PARTS}, target) - 1 AS number FROM e),
  s0 AS (SELECT 'o' || o_orderkey AS walk, 'o' || o_orderkey AS node FROM orders), {_step_sql(1)}, {_step_sql(2)}
  SELECT walk, 0::INTEGER AS step, node FROM s0 UNION ALL SELECT walk, 1, node FROM s1 UNION ALL SELECT walk, 2, node FROM s2""")
def walk_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = model.edges(spark, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    starts = model.table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("node"))
    return walks.walk(starts.select(F.col("node").alias("walk"), "node"), edges, 2, seed=3)


@register_sql("lang_arithmetic", """SELECT l_orderkey, l_linenumber, (l_linenumber + 2 * 3)::BIGINT AS infix,
  (l_linenumber - 10) // 3 AS prefix, l_linenumber % 2 + 255 AS postfix,
  CASE WHEN l_linenumber % 2 <> 0 THEN 7 // (l_linenumber % 2) END AS divided FROM lineitem""")
def lang_arithmetic(spark: SparkSession, d: str) -> DataFrame:
    def compiled(text: str, notation: str):
        return arithmetic.column(arithmetic.parse(text, notation)).cast("long")

    return model.table(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", compiled("l_linenumber + 2 * 3", "infix").alias("infix"),
        compiled("/ - l_linenumber 10 3", "prefix").alias("prefix"),
        compiled("l_linenumber 2 % 0xff +", "postfix").alias("postfix"),
        compiled("7 / (l_linenumber % 2)", "infix").alias("divided"),
    )
