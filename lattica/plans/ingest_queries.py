"""Queries on sources, stacks, predictions and proofs, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import code, fulltext, predict, proofs, stacks
from lattica.plans import model
from lattica.plans.graph_queries import register_sql
from lattica.plans.oracle import ranked_sql
from lattica.sources import latex, markdown, repository
from lattica.tables import scratch_path


def _text(value: str):
    return F.col(value).cast("string")


# Sources

ENDINGS = ("rs", "py", "MD", "unknown", "gz", "tar.json")


def _files(spark: SparkSession, d: str) -> DataFrame:
    """Documents as files of one repository per source; some have no extension."""
    endings = F.array(*[F.lit(e) for e in ENDINGS])
    name = F.concat(F.lit("src/f"), _text("doc_id"), F.lit("."), F.element_at(endings, (F.col("doc_id") % 6 + 1).cast("int")))
    name = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("m"), _text("doc_id"), F.lit("/Makefile"))).otherwise(name)
    return model.table(spark, d, "documents").select(F.col("source").alias("repo"), name.alias("path"), F.col("text").alias("content"))


@register_sql("repo_census", """SELECT repo, language, count(*) AS files, sum(lines)::BIGINT AS lines FROM (
    SELECT source AS repo,
      CASE WHEN doc_id % 13 = 0 THEN 'make' WHEN doc_id % 6 <> 4 AND octet_length(encode(text)) > 1048576 AND doc_id % 6 NOT IN (0, 2) THEN 'binary'
           ELSE ['rust', 'python', 'markdown', 'text', 'binary', 'json'][doc_id % 6 + 1] END AS language,
      CASE WHEN doc_id % 13 <> 0 AND doc_id % 6 = 4 THEN 0
           ELSE length(text) - length(replace(text, chr(10), '')) + (text <> '' AND right(text, 1) <> chr(10))::INT END AS lines
    FROM documents) GROUP BY repo, language""")  # fmt: skip
def repo_census(spark: SparkSession, d: str) -> DataFrame:
    return repository.census(repository.files(_files(spark, d)))


@register_sql("repo_tree_changes", """SELECT doc_id AS path, CASE WHEN doc_id % 5 = 0 THEN 'add' WHEN doc_id % 7 = 0 THEN 'delete' ELSE 'update' END AS change
  FROM documents WHERE (doc_id % 5 = 0 AND doc_id % 7 <> 0) OR (doc_id % 5 <> 0 AND (doc_id % 7 = 0 OR doc_id % 11 = 0))""")
def repo_tree_changes(spark: SparkSession, d: str) -> DataFrame:
    docs = model.table(spark, d, "documents")
    old = docs.filter("doc_id % 5 != 0").select(F.col("doc_id").alias("path"), F.sha2("text", 256).alias("sha"))
    changed = F.when(F.col("doc_id") % 11 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = docs.filter("doc_id % 7 != 0").select(F.col("doc_id").alias("path"), F.sha2(changed, 256).alias("sha"))
    return repository.tree_changes(new, old)


@register_sql("normalize_source", r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
    text, '\r\n?', chr(10), 'g'), '[ \t\f\x0B]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\n+|\n+$', '', 'g') || chr(10)) AS digest
  FROM documents""")  # fmt: skip
def normalize_source(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "documents").select("doc_id", F.md5(repository.normalized(F.col("text"))).alias("digest"))


@register_sql("file_discovery", """SELECT 'source=' || coalesce(source, 'none') AS folder, sum(coalesce(octet_length(encode(text)), 0) + 1)::BIGINT AS bytes
  FROM documents GROUP BY ALL""")
def file_discovery(spark: SparkSession, d: str) -> DataFrame:
    """Texts written as files of folders per source; the same again in folders of builds and hidden ones isn't found."""
    root = scratch_path(spark, "tree")
    docs = model.table(spark, d, "documents").select("text", F.coalesce("source", F.lit("none")).alias("source"))
    for folder in ("src", "src/target", "target/deep", ".hidden"):
        docs.write.partitionBy("source").text(f"{root}/{folder}")
    found = repository.discovered(spark, root, "*.txt")
    folder = F.element_at(F.split("path", "/"), -2).alias("folder")
    return found.groupBy(folder).agg(F.sum(F.octet_length("content")).cast("long").alias("bytes"))


def _order_pages(spark: SparkSession, d: str) -> DataFrame:
    """A Markdown page per order: a heading, a paragraph of two lines, and a section with two items for each line."""
    line = model.numbered_lines(spark, d).join(model.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    section = F.concat(F.lit("## Line "), _text("ordinal"), F.lit("\n\n- part "), _text("l_partkey"),
                       F.lit("\n- [supplier](s"), _text("l_suppkey"), F.lit(".md)\n"))
    grouped = line.groupBy("o_orderkey", "o_orderpriority", "o_orderstatus").agg(
        F.sort_array(F.collect_list(F.struct("ordinal", section.alias("text")))).alias("sections")
    )
    sections = F.array_join(F.transform("sections", lambda s: s["text"]), "\n")
    head = F.concat(F.lit("# Order "), _text("o_orderkey"), F.lit("\n\npriority "), F.col("o_orderpriority"), F.lit("\nstatus "),
                    F.col("o_orderstatus"), F.lit("\n\n"))
    return grouped.select(F.col("o_orderkey").alias("doc"), F.concat(head, sections).alias("text"))


MARKDOWN_NODES = """SELECT DISTINCT o_orderkey || '#0' AS id, 'heading' AS kind, 'Order ' || o_orderkey AS content,
    o_orderkey::VARCHAR AS parent_id, 0 AS position, 1 AS level, o_orderkey || '.0' AS path FROM orders JOIN lines ON l_orderkey = o_orderkey
  UNION ALL SELECT DISTINCT o_orderkey || '#2', 'paragraph', 'priority ' || o_orderpriority || ' status ' || o_orderstatus, o_orderkey || '#0', 1,
    NULL, o_orderkey || '.0.2' FROM orders JOIN lines ON l_orderkey = o_orderkey
  UNION ALL SELECT l_orderkey || '#' || ordinal * 5, 'heading', 'Line ' || ordinal, l_orderkey || '#0', ordinal * 3 - 1, 2,
    l_orderkey || '.0.' || ordinal * 5 FROM lines JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_orderkey || '#' || ordinal * 5 + 2, 'list_item', 'part ' || l_partkey, l_orderkey || '#' || ordinal * 5, ordinal * 3, NULL,
    l_orderkey || '.0.' || ordinal * 5 || '.' || ordinal * 5 + 2 FROM lines JOIN orders ON l_orderkey = o_orderkey
  UNION ALL SELECT l_orderkey || '#' || ordinal * 5 + 3, 'list_item', '[supplier](s' || l_suppkey || '.md)', l_orderkey || '#' || ordinal * 5,
    ordinal * 3 + 1, NULL, l_orderkey || '.0.' || ordinal * 5 || '.' || ordinal * 5 + 3 FROM lines JOIN orders ON l_orderkey = o_orderkey"""
MARKDOWN_NODES = MARKDOWN_NODES.replace("ordinal * 5 + 2", "(ordinal * 5 + 2)").replace("ordinal * 5 + 3", "(ordinal * 5 + 3)")


@register_sql("markdown_nodes", MARKDOWN_NODES)
def markdown_nodes(spark: SparkSession, d: str) -> DataFrame:
    return markdown.nodes(_order_pages(spark, d)).select("id", "kind", "content", "parent_id", "position", "level", "path")


@register_sql("markdown_links", """SELECT l_orderkey || '#' || (ordinal * 5 + 3) AS source_id, 's' || l_suppkey || '.md' AS target,
  'links_to' AS relation FROM lines JOIN orders ON l_orderkey = o_orderkey""")
def markdown_links(spark: SparkSession, d: str) -> DataFrame:
    return markdown.links(markdown.nodes(_order_pages(spark, d)))


@register_sql("markdown_reconstruct", """SELECT o_orderkey AS doc, '# Order ' || o_orderkey || chr(10) || chr(10) || 'priority ' || o_orderpriority
    || ' status ' || o_orderstatus || chr(10) || chr(10) || string_agg('## Line ' || ordinal || chr(10) || chr(10) || '- part ' || l_partkey
    || chr(10) || '- [supplier](s' || l_suppkey || '.md)' || chr(10), chr(10) ORDER BY ordinal) AS text
  FROM lines JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus""")  # fmt: skip
def markdown_reconstruct(spark: SparkSession, d: str) -> DataFrame:
    return markdown.reconstruct(markdown.nodes(_order_pages(spark, d)))


def _bibliographies(spark: SparkSession, d: str) -> DataFrame:
    """A bibliography of a comment and an article per part."""
    text = F.concat(F.lit("@comment{x, y = 1\n}\n@Article{k"), _text("p_partkey"), F.lit(",\n  Title = {The {"), F.col("p_name"),
                    F.lit("}\n   part},\n  year = "), _text("p_size"), F.lit(',\n  note = "'), F.col("p_brand"), F.lit('"\n}\n'))
    return model.table(spark, d, "part").select(F.col("p_partkey").alias("doc"), text.alias("text"))


def _articles(spark: SparkSession, d: str) -> DataFrame:
    """A LaTeX source per order line: a label and references, every other one to it."""
    part, asked = _text("l_partkey"), F.col("ordinal") % 2 == 0
    name = F.when(asked, part).otherwise(F.lit("none"))
    text = F.concat(F.lit("\\section{One}\n% \\label{none}\n\\label{"), part, F.lit("}\nSee \\cite[p. 2]{a, b} and \\ref{"), name, F.lit("}.\n"))
    key = F.concat(_text("l_orderkey"), F.lit("_"), _text("ordinal"))
    return model.numbered_lines(spark, d).select(key.alias("doc"), text.alias("text"))


#: Texts of a written file: a file is read as one value, so its size must not grow with the tables.
TEXTS_PER_FILE = 10_000


def _written_files(spark: SparkSession, docs: DataFrame, label: str) -> DataFrame:
    """The texts of ``docs`` written to files of several texts each, and found there."""
    root = scratch_path(spark, label)
    docs.select("text").write.option("maxRecordsPerFile", TEXTS_PER_FILE).text(f"{root}/src")
    return repository.discovered(spark, root, "*.txt")


@register_sql("bibtex_files", """SELECT 'k' || p_partkey AS key, 'article' AS type, unnest(['title', 'year', 'note']) AS field,
  unnest(['The {' || p_name || '} part', p_size::VARCHAR, p_brand]) AS value FROM part""")
def bibtex_files(spark: SparkSession, d: str) -> DataFrame:
    return latex.bib_fields(latex.sources(_written_files(spark, _bibliographies(spark, d), "bib"))).drop("doc")


@register_sql("latex_files", """SELECT kind, name, count(*) AS n FROM (SELECT unnest(['latex_section', 'latex_label', 'latex_cite', 'latex_cite', 'latex_ref']) AS kind,
    unnest(['One', l_partkey::VARCHAR, 'a', 'b', CASE WHEN ordinal % 2 = 0 THEN l_partkey::VARCHAR ELSE 'none' END]) AS name FROM lines) GROUP BY kind, name""")
def latex_files(spark: SparkSession, d: str) -> DataFrame:
    found = latex.commands(latex.sources(_written_files(spark, _articles(spark, d), "tex")))
    return found.groupBy("kind", "name").agg(F.count("*").alias("n"))


@register_sql("bib_fields", """SELECT p_partkey AS doc, 'k' || p_partkey AS key, 'article' AS type, unnest(['title', 'year', 'note']) AS field,
  unnest(['The {' || p_name || '} part', p_size::VARCHAR, p_brand]) AS value FROM part""")
def bib_fields(spark: SparkSession, d: str) -> DataFrame:
    return latex.bib_fields(_bibliographies(spark, d))


@register_sql("latex_references", """SELECT l_orderkey || '_' || ordinal AS doc, 3 AS source_position, 1 AS target_position FROM lines WHERE ordinal % 2 = 0""")
def latex_references(spark: SparkSession, d: str) -> DataFrame:
    return latex.references(_articles(spark, d))


@register_sql("lint_naming", """SELECT p_partkey AS id, ['non_camel_type', 'non_upper_const', 'non_snake_fn'][p_partkey % 3 + 1] AS rule,
  ['warning', 'info', 'warning'][p_partkey % 3 + 1] AS severity FROM part WHERE p_partkey % 3 <> 2""")
def lint_naming(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("struct"), F.lit("const"), F.lit("fn"))
    kind = F.element_at(kinds, (F.col("p_partkey") % 3 + 1).cast("int"))
    name = F.replace("p_name", F.lit(" "), F.lit("_"))
    return code.naming_findings(model.table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), name.alias("content")))


@register_sql("sort_imports", """SELECT file, row_number() OVER (PARTITION BY file ORDER BY g, k) - 1 AS place, source FROM (
    SELECT l_orderkey AS file, CASE l_partkey % 3 WHEN 0 THEN 2 WHEN 1 THEN 0 ELSE 1 END AS g,
           CASE l_partkey % 3 WHEN 0 THEN 'crate::m' WHEN 1 THEN 'std::m' ELSE 'ext::m' END || l_partkey % 10 AS k,
           CASE l_partkey % 3 WHEN 0 THEN 'pub(crate) use crate::M' WHEN 1 THEN 'use std :: M' ELSE 'pub use ext::M' END || l_partkey % 10 || ';' AS source
    FROM lines GROUP BY ALL)""")  # fmt: skip
def sort_imports(spark: SparkSession, d: str) -> DataFrame:
    kind = F.col("l_partkey") % 3
    head = F.when(kind == 0, "pub(crate) use crate::M").when(kind == 1, "use std :: M").otherwise("pub use ext::M")
    source = F.concat(head, (F.col("l_partkey") % 10).cast("string"), F.lit(";"))
    rows = model.numbered_lines(spark, d).select(F.col("l_orderkey").alias("file"), F.col("ordinal").alias("position"), source.alias("source"))
    return code.sorted_imports(rows)


@register_sql("comment_groups", """SELECT file, 0 AS "column", min(line) AS first_line, max(line) AS last_line, md5(string_agg(content, chr(10) ORDER BY line)) AS text
  FROM (SELECT parent_id AS file, position AS line, content, position - row_number() OVER (PARTITION BY parent_id ORDER BY position) AS island
        FROM document_nodes WHERE kind = 'paragraph') GROUP BY file, island""")  # fmt: skip
def comment_groups(spark: SparkSession, d: str) -> DataFrame:
    rows = model.document_nodes(spark, d).filter("kind = 'paragraph'")
    rows = rows.select(F.col("parent_id").alias("file"), F.col("position").alias("line"), F.lit(0).alias("column"), F.col("content").alias("text"))
    return code.comment_groups(rows).withColumn("text", F.md5("text"))


# Stacks

OP = """CASE WHEN event_id % 100 = 9 THEN 'clear' WHEN event_id % 10 = 8 THEN 'replace' WHEN event_id % 10 IN (5, 6) THEN 'pop'
  WHEN event_id % 10 = 7 THEN 'drop' ELSE 'push' END"""
REPLAYED = f"""WITH RECURSIVE log AS (SELECT user_id AS u, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n, event_id AS seq,
      {OP} AS op, event_type || event_id AS content FROM events),
    replay AS (SELECT DISTINCT u, 0::BIGINT AS n, 0::BIGINT AS seq, []::VARCHAR[] AS items, NULL::VARCHAR AS taken FROM log
      UNION ALL SELECT log.u, log.n, log.seq, CASE log.op WHEN 'push' THEN list_append(items, content) WHEN 'clear' THEN []
        WHEN 'replace' THEN CASE WHEN len(items) = 0 THEN items ELSE list_append(items[:-2], content) END ELSE items[:-2] END,
        CASE WHEN log.op IN ('pop', 'drop') THEN items[-1] END
      FROM replay JOIN log ON log.u = replay.u AND log.n = replay.n + 1),
    held AS (SELECT u, items FROM replay QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC) = 1)"""


def _stack_log(spark: SparkSession, d: str) -> DataFrame:
    content = F.concat("event_type", _text("event_id"))
    return model.table(spark, d, "events").select(
        F.concat(F.lit("w"), _text("user_id")).alias("stack"), F.col("event_id").alias("seq"), F.expr(OP).alias("op"), content.alias("content")
    )


@register_sql("stack_items", f"{REPLAYED} SELECT 'w' || u AS stack, unnest(range(1, len(items) + 1)) AS position, unnest(items) AS content FROM held")
def stack_items(spark: SparkSession, d: str) -> DataFrame:
    return stacks.items(_stack_log(spark, d))


@register_sql("stack_popped", f"{REPLAYED} SELECT 'w' || u AS stack, seq, taken AS content FROM replay WHERE taken IS NOT NULL")
def stack_popped(spark: SparkSession, d: str) -> DataFrame:
    return stacks.popped(_stack_log(spark, d))


@register_sql("stack_tops", f"{REPLAYED} SELECT 'w' || u AS stack, len(items) AS depth, items[-1] AS content FROM held WHERE len(items) > 0")
def stack_tops(spark: SparkSession, d: str) -> DataFrame:
    return stacks.tops(stacks.items(_stack_log(spark, d)))


@register_sql("workspace_list", f"""{REPLAYED} SELECT 'w' || e.user_id AS id, 'space ' || e.user_id AS name, e.user_id = 12 AS is_active,
    (SELECT len(items) FROM held WHERE u = e.user_id) AS item_count, e.updated_at
  FROM (SELECT user_id, max(ts) AS updated_at FROM events GROUP BY user_id) e WHERE e.user_id % 5 = 2""")  # fmt: skip
def workspace_list(spark: SparkSession, d: str) -> DataFrame:
    seen = model.table(spark, d, "events").groupBy("user_id").agg(F.max("ts").alias("updated_at"))
    spaces = seen.select(
        F.concat(F.lit("w"), _text("user_id")).alias("id"), F.concat(F.lit("space "), _text("user_id")).alias("name"),
        (F.col("user_id") % 5).alias("user_id"), (F.col("user_id") < 5).alias("is_active"), "updated_at",
    )
    return stacks.workspaces(stacks.activated(spaces, "w12"), stacks.items(_stack_log(spark, d)), 2)


# Predictions and proofs

TRANSITIONS = """SELECT agent, source, target, count(*) AS n FROM (SELECT l_returnflag AS agent, l_partkey AS source,
  lead(l_partkey) OVER (PARTITION BY l_returnflag, l_orderkey ORDER BY ordinal) AS target FROM lines) WHERE target IS NOT NULL GROUP BY ALL"""


def _transitions(spark: SparkSession, d: str) -> DataFrame:
    return predict.transitions(model.numbered_lines(spark, d).select(
        F.col("l_returnflag").alias("agent"), F.col("l_orderkey").alias("walk"), F.col("ordinal").alias("step"), F.col("l_partkey").alias("node")
    ))


@register_sql("model_transitions", TRANSITIONS)
def model_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _transitions(spark, d)


CONTEXTS = """contexts AS (SELECT l_returnflag AS agent, l_orderkey AS walk, l_partkey AS target, list_filter([
    lag(l_partkey, 2) OVER w, lag(l_partkey) OVER w], lambda x: x IS NOT NULL) AS before FROM lines
    WINDOW w AS (PARTITION BY l_returnflag, l_orderkey ORDER BY ordinal)),
  counts AS (SELECT agent, before[len(before) - k + 1 :] AS context, target, count(*) AS n
    FROM (SELECT *, unnest(range(0, len(before) + 1)) AS k FROM contexts WHERE walk % 5 <> 0) GROUP BY ALL),
  totals AS (SELECT agent, context, sum(n) AS total, count(*) AS kinds FROM counts GROUP BY ALL)"""


def _context_walks(spark: SparkSession, d: str) -> DataFrame:
    return model.numbered_lines(spark, d).select(
        F.col("l_returnflag").alias("agent"), F.col("l_orderkey").alias("walk"), F.col("ordinal").alias("step"), F.col("l_partkey").alias("node")
    )


@register_sql("context_counts", f"WITH {CONTEXTS} SELECT agent, array_to_string(context, ',') AS context, target, n FROM counts")
def context_counts(spark: SparkSession, d: str) -> DataFrame:
    counts = predict.context_counts(_context_walks(spark, d).filter("walk % 5 != 0"), 2)
    return counts.withColumn("context", F.array_join(F.col("context").cast("array<string>"), ","))


@register_sql("walk_likelihoods", f"""WITH {CONTEXTS}, held AS (SELECT *, before[len(before) :] AS one FROM contexts WHERE walk % 5 = 0),
  p0 AS (SELECT h.*, (coalesce(n, 0) + kinds * (1 / (kinds + 1))) / (total + kinds) AS p FROM held h
    JOIN totals t ON t.agent = h.agent AND t.context = [] LEFT JOIN counts c ON c.agent = h.agent AND c.context = [] AND c.target = h.target),
  p1 AS (SELECT h.* EXCLUDE (p), CASE WHEN total IS NULL THEN p ELSE (coalesce(n, 0) + kinds * p) / (total + kinds) END AS p FROM p0 h
    LEFT JOIN totals t ON t.agent = h.agent AND t.context = one AND len(before) >= 1
    LEFT JOIN counts c ON c.agent = h.agent AND c.context = one AND c.target = h.target AND len(before) >= 1),
  p2 AS (SELECT h.* EXCLUDE (p), CASE WHEN total IS NULL THEN p ELSE (coalesce(n, 0) + kinds * p) / (total + kinds) END AS p FROM p1 h
    LEFT JOIN totals t ON t.agent = h.agent AND t.context = before AND len(before) = 2
    LEFT JOIN counts c ON c.agent = h.agent AND c.context = before AND c.target = h.target AND len(before) = 2)
  SELECT agent, walk, count(*) AS nodes, sum(ln(p)) AS log_likelihood FROM p2 GROUP BY agent, walk""")  # fmt: skip
def walk_likelihoods(spark: SparkSession, d: str) -> DataFrame:
    walks = _context_walks(spark, d)
    counts = predict.context_counts(walks.filter("walk % 5 != 0"), 2)
    return predict.walk_likelihoods(counts, walks.filter("walk % 5 = 0"), 2)


@register_sql("model_info", f"""SELECT agent, count(DISTINCT source) AS sources, count(*) AS parameters, sum(n)::BIGINT AS observations
  FROM ({TRANSITIONS}) GROUP BY agent""")
def model_info(spark: SparkSession, d: str) -> DataFrame:
    return predict.model_info(_transitions(spark, d))


@register_sql("predict_next", f"""SELECT target, n / sum(n) OVER () AS probability FROM ({TRANSITIONS}) WHERE agent = 'R' AND source = 7
  ORDER BY n DESC, target LIMIT 10""")
def predict_next(spark: SparkSession, d: str) -> DataFrame:
    return predict.predict_next(_transitions(spark, d), "R", 7, 10)


@register_sql("ensemble_predict", f"""SELECT target, exp(logit) / sum(exp(logit)) OVER () AS probability FROM (
    SELECT target, sum(ln(1 + n)) / 3 AS logit FROM ({TRANSITIONS}) WHERE source = 7 GROUP BY target) ORDER BY logit DESC, target LIMIT 10""")
def ensemble_predict(spark: SparkSession, d: str) -> DataFrame:
    return predict.ensemble_predict(_transitions(spark, d), ["A", "N", "R"], 7, 10)


@register_sql("neural_search", f"""WITH found AS (SELECT * FROM {ranked_sql("nodes", "widget", "kind = 'part'")} ORDER BY rank DESC, id LIMIT 200),
  predicted AS (SELECT 'p' || target AS id, n / sum(n) OVER () AS probability FROM ({TRANSITIONS}) WHERE agent = 'R' AND source = 7)
  SELECT f.id, rank, coalesce(probability, 0) AS neural, round(rank * (1 + coalesce(probability, 0)), 9) AS combined
  FROM found f LEFT JOIN predicted p ON f.id = p.id ORDER BY combined DESC, f.id LIMIT 100""")
def neural_search(spark: SparkSession, d: str) -> DataFrame:
    parts = model.nodes(spark, d).filter("kind = 'part'")
    found = fulltext.search(parts, "widget", None, 200)
    predicted = predict.probabilities(_transitions(spark, d), "R", 7)
    return predict.neural_search(found, predicted.withColumn("target", F.concat(F.lit("p"), _text("target"))), 100)


@register_sql("proofs")
def proofs_of_auctions(spark: SparkSession, d: str) -> DataFrame:
    bid = model.bids(spark, d).groupBy(F.col("auction_id").alias("id"))
    bid = bid.agg(F.count("*").alias("perspective_count"), F.avg("max_price").alias("avg_weight"))
    rows = model.auctions(spark, d).join(bid, "id", "left").withColumn("claim_type", F.lit("price"))
    made = proofs.proven(rows.select("id", "scope", "claim_type", "perspective_count", "avg_weight"))
    return proofs.verified(made)


@register_sql("status", """SELECT 'agents' AS name, count(*) AS value FROM agents UNION ALL SELECT 'auctions', count(*) FROM auctions
  UNION ALL SELECT 'edges', count(*) FROM edges UNION ALL SELECT 'ledger', count(*) FROM ledger UNION ALL SELECT 'nodes', count(*) FROM nodes
  UNION ALL SELECT 'operations', count(*) FROM operations UNION ALL SELECT 'perspectives', count(*) FROM perspectives
  UNION ALL SELECT 'tasks', count(*) FROM tasks""")  # fmt: skip
def status(spark: SparkSession, d: str) -> DataFrame:
    tables = {
        "agents": model.agents, "auctions": model.auctions, "edges": model.edges, "ledger": model.ledger, "nodes": model.nodes,
        "operations": model.operations, "tasks": model.tasks,
        "perspectives": lambda s, f: model.perspective_log(s, f).select("agent_id", "node_id", "context_id").distinct(),
    }
    counts = [build(spark, d).agg(F.lit(name).alias("name"), F.count("*").alias("value")) for name, build in tables.items()]
    out = counts[0]
    for more in counts[1:]:
        out = out.unionByName(more)
    return out
