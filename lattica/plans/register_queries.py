"""Queries on registers, citations, source comments and walks, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import citations, code, perspectives, registers, stacks, walks
from lattica.operators.latest import latest
from lattica.plans import model
from lattica.plans.oracle import sql
from lattica.queries import register


def register_sql(name: str, body: str | None = None):
    return register(name, sql(body) if body else None)


def _text(prefix: str, number) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


PREFERENCES = """prefs AS (SELECT (['alias', 'config', 'theme'])[n_nationkey % 3 + 1] AS category, lower(replace(n_name, ' ', '_')) AS key,
    'v' || n_regionkey AS value, n_nationkey AS updated_at FROM nation)"""


def _preferences(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    kinds = F.array(F.lit("alias"), F.lit("config"), F.lit("theme"))
    return model.table(spark, d, "nation").select(
        F.element_at(kinds, (key % 3 + 1).cast("int")).alias("category"), F.lower(F.replace("n_name", F.lit(" "), F.lit("_"))).alias("key"),
        _text("v", F.col("n_regionkey")).alias("value"), key.alias("updated_at"),
    )


@register_sql("get_preference", f"WITH {PREFERENCES} SELECT value FROM prefs WHERE category = 'theme' AND key = (SELECT min(key) FROM prefs WHERE category = 'theme')")
def get_preference(spark: SparkSession, d: str) -> DataFrame:
    rows = _preferences(spark, d)
    first = rows.filter("category = 'theme'").agg(F.min("key")).first()[0]
    return registers.get_preference(rows, "theme", first)


@register_sql("list_preferences", f"WITH {PREFERENCES} SELECT key, value, updated_at FROM prefs WHERE category = 'alias'")
def list_preferences(spark: SparkSession, d: str) -> DataFrame:
    return registers.list_preferences(_preferences(spark, d), "alias")


@register_sql("export_preferences", f"""WITH {PREFERENCES} SELECT '[' || string_agg('{{"key":"' || key || '","value":"' || value || '"}}', ',' ORDER BY key) || ']' AS json
  FROM prefs WHERE category = 'config'""")
def export_preferences(spark: SparkSession, d: str) -> DataFrame:
    return registers.export_preferences(_preferences(spark, d), "config")


@register_sql("init_document", f"""WITH {PREFERENCES} SELECT '# aliases' || chr(10) || (SELECT string_agg(key || ': ' || value || chr(10), '' ORDER BY key) FROM prefs
    WHERE category = 'alias') || chr(10) || '# config' || chr(10)
  || (SELECT string_agg(key || ' ' || value || chr(10), '' ORDER BY key) FROM prefs WHERE category = 'config') AS document""")
def init_document(spark: SparkSession, d: str) -> DataFrame:
    return registers.init_document(_preferences(spark, d))


@register_sql("init_rows", f"WITH {PREFERENCES} SELECT 1 AS id, category, key, value FROM prefs WHERE category IN ('alias', 'config')")
def init_rows(spark: SparkSession, d: str) -> DataFrame:
    document = registers.init_document(_preferences(spark, d)).withColumn("id", F.lit(1))
    return registers.init_rows(document)


@register_sql("push_init", """SELECT count(*) FILTER (n_nationkey < 5) AS added, count(*) FILTER (n_nationkey BETWEEN 5 AND 19 AND n_regionkey <> n_regionkey % 3) AS updated,
  count(*) FILTER (n_nationkey > 19) AS deleted FROM nation""")
def push_init(spark: SparkSession, d: str) -> DataFrame:
    nation = model.table(spark, d, "nation")
    wanted = nation.filter("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").alias("value"))
    now = nation.filter("n_nationkey > 4").select(F.col("n_name").alias("key"), (F.col("n_regionkey") % 3).alias("value"))
    return registers.push_counts(wanted, now)


# Workspaces: the events of a user are pushes and pops of typed items


def _typed_log(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_id")
    op = F.when(event % 5 < 3, "push").when(event % 5 == 3, "pop").otherwise("replace")
    content = registers.typed(F.col("event_type"), _text("n", event % 50), F.col("props"))
    return model.table(spark, d, "events").select(F.col("user_id").alias("stack"), event.alias("seq"), op.alias("op"), content.alias("content"))


@register_sql("workspace_typed_list", """WITH RECURSIVE log AS (SELECT event_id, event_type, props, event_id % 5 AS o,
    row_number() OVER (ORDER BY event_id) AS n FROM events WHERE user_id = 7),
  run AS (SELECT 0::BIGINT AS n, []::BIGINT[] AS stack UNION ALL
    SELECT l.n, CASE WHEN o < 3 THEN list_append(stack, event_id) WHEN len(stack) = 0 THEN stack WHEN o = 3 THEN stack[1 : len(stack) - 1]
      ELSE list_append(stack[1 : len(stack) - 1], event_id) END FROM run JOIN log l ON l.n = run.n + 1),
  last AS (SELECT stack FROM run ORDER BY n DESC LIMIT 1),
  items AS (SELECT unnest(stack) AS event_id, generate_subscripts(stack, 1) AS position FROM last)
  SELECT position::INTEGER AS position, event_type AS kind, 'n' || event_id % 50 AS ref_id, props AS meta FROM items JOIN log USING (event_id)""")  # fmt: skip
def workspace_typed_list(spark: SparkSession, d: str) -> DataFrame:
    items = stacks.items(_typed_log(spark, d))
    return registers.typed_list(items, 7).withColumn("position", F.col("position").cast("int"))


ITEMS = "items AS (SELECT p_partkey AS id, p_size AS stack, p_partkey::INTEGER AS position, p_name AS content FROM part)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), F.col("p_size").alias("stack"), F.col("p_partkey").cast("int").alias("position"), F.col("p_name").alias("content")
    )


@register_sql("workspace_drop_by_id", f"WITH {ITEMS} SELECT * FROM items WHERE id NOT IN (SELECT event_id * 3 FROM events)")
def workspace_drop_by_id(spark: SparkSession, d: str) -> DataFrame:
    return registers.dropped(_items(spark, d), model.table(spark, d, "events").select((F.col("event_id") * 3).alias("id")))


@register_sql("workspace_dup_by_id", f"""WITH {ITEMS} SELECT * FROM items UNION ALL
  SELECT e.event_id + (SELECT max(id) FROM items) + 1, (e.event_id % 60)::INTEGER,
    (coalesce((SELECT max(position) FROM items WHERE stack = e.event_id % 60), 0) + row_number() OVER (PARTITION BY e.event_id % 60 ORDER BY e.event_id))::INTEGER,
    content FROM events e JOIN items i ON i.id = e.event_id * 3""")
def workspace_dup_by_id(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_id")
    asked = model.table(spark, d, "events").select(event.alias("seq"), (event * 3).alias("id"), (event % 60).cast("int").alias("stack"))
    return registers.duplicated(_items(spark, d), asked)


@register_sql("workspace_create", """SELECT event_id AS seq, user_id % 200 AS user_id, event_type AS name, CASE WHEN user_id % 200 >= 100 THEN 'user' END AS refused,
  CASE WHEN user_id % 200 < 100 THEN sha256((user_id % 200) || '|' || event_type || '|' || event_id) END AS id FROM events""")
def workspace_create(spark: SparkSession, d: str) -> DataFrame:
    asked = model.table(spark, d, "events").select(F.col("event_id").alias("seq"), (F.col("user_id") % 200).alias("user_id"), F.col("event_type").alias("name"))
    return registers.create_workspaces(asked, spark.range(100).select(F.col("id").alias("user_id")))


@register_sql("workspace_anonymous", """SELECT DISTINCT sha256('user|' || props) AS user_id, sha256('workspace|' || props) AS workspace_id FROM events""")
def workspace_anonymous(spark: SparkSession, d: str) -> DataFrame:
    return registers.anonymous(model.table(spark, d, "events").select(F.col("props").alias("session")))


@register_sql("bootstrap_instance", "SELECT 'me' AS instance, 'instance' AS wallet_type FROM region WHERE r_regionkey = 0")
def bootstrap_instance(spark: SparkSession, d: str) -> DataFrame:
    instances = model.table(spark, d, "region").select(F.col("r_name").alias("name"), (F.col("r_regionkey") == 3).alias("is_self"))
    wallets = spark.createDataFrame([("other", "instance")], "instance string, wallet_type string")
    new, wallet = registers.bootstrapped(instances, wallets, "me")
    return wallet.join(new, F.lit(True), "left_anti")  # the instance itself is there already


# Models


@register_sql("create_models", """SELECT event_id AS seq, 'u' || event_id % 1500 AS agent, event_id % 64 AS dim, event_id % 5 AS n_heads,
  CASE WHEN a.name IS NULL THEN 'agent' WHEN event_id % 64 <= 0 OR event_id % 5 <= 0 OR (event_id % 64) % (event_id % 5) <> 0 THEN 'dim' END AS refused
  FROM events LEFT JOIN agents a ON a.name = 'u' || event_id % 1500""")  # fmt: skip
def create_models(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_id")
    asked = model.table(spark, d, "events").select(event.alias("seq"), _text("u", event % 1500).alias("agent"), (event % 64).alias("dim"), (event % 5).alias("n_heads"))
    return registers.create_models(asked, model.agents(spark, d))


@register_sql("record_selection", """SELECT event_id AS id, event_type AS name, event_id IN (SELECT event_id * 7 FROM events) AS selected FROM events""")
def record_selection(spark: SparkSession, d: str) -> DataFrame:
    events = model.table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("name"))
    return registers.with_selections(events, events.select((F.col("id") * 7).alias("inference_id")))


# Commits: every order is a commit whose parents are earlier orders


COMMITS = """commits AS (SELECT 'r' || o_orderkey % 3 AS repo, 'h' || o_orderkey AS sha, o_orderpriority AS message, o_orderkey AS time,
    CASE WHEN o_orderkey % 10 = 0 THEN ['h' || (o_orderkey - 3), 'h' || (o_orderkey // 2)] WHEN o_orderkey % 97 = 5 THEN [] ELSE ['h' || (o_orderkey - 3)] END AS parents
    FROM orders)"""


def _commits(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    one, two = _text("h", key - 3), _text("h", F.floor(key / 2))
    parents = F.when(key % 10 == 0, F.array(one, two)).when(key % 97 == 5, F.array().cast("array<string>")).otherwise(F.array(one))
    return model.table(spark, d, "orders").select(
        _text("r", key % 3).alias("repo"), _text("h", key).alias("sha"), F.col("o_orderpriority").alias("message"), key.alias("time"), parents.alias("parents")
    )


@register_sql("commit_nodes", f"""WITH {COMMITS} SELECT repo || '@' || sha AS id, 'repo_commit' AS kind, message AS content, repo AS parent_id,
  '{{"sha":"' || sha || '","time":' || time || '}}' AS metadata FROM commits""")
def commit_nodes(spark: SparkSession, d: str) -> DataFrame:
    return registers.commit_nodes(_commits(spark, d))


EDGES = """pairs AS (SELECT repo, sha, unnest(parents) AS parent FROM commits),
  edges2 AS (SELECT DISTINCT p.repo || '@' || p.sha AS source_id, p.repo || '@' || p.parent AS target_id, 'parent_commit' AS relation
    FROM pairs p JOIN commits c ON c.repo = p.repo AND c.sha = p.parent)"""


@register_sql("commit_edges", f"WITH {COMMITS}, {EDGES} SELECT * FROM edges2")
def commit_edges(spark: SparkSession, d: str) -> DataFrame:
    return registers.commit_edges(_commits(spark, d))


#: Times that often lie before those of the parents.
LATE = "late AS (SELECT * REPLACE (time - time % 4 * 5 AS time) FROM commits)"


@register_sql("commit_order", f"""WITH {COMMITS}, {LATE}, {EDGES}, moments AS (WITH RECURSIVE r AS (
      SELECT repo || '@' || sha AS id, time AS moment FROM late
      UNION SELECT repo || '@' || sha, moment + 1 FROM r JOIN edges2 ON target_id = r.id AND source_id <> target_id JOIN late ON repo || '@' || sha = source_id
      WHERE moment + 1 > time) SELECT id, max(moment) AS moment FROM r GROUP BY id)
  SELECT repo, sha, moment, row_number() OVER (PARTITION BY repo ORDER BY moment, time, sha) - 1 AS place
  FROM late JOIN moments ON id = repo || '@' || sha""")  # fmt: skip
def commit_order(spark: SparkSession, d: str) -> DataFrame:
    return registers.commit_order(_commits(spark, d).withColumn("time", F.col("time") - F.col("time") % 4 * 5))


@register_sql("mirror_at", f"""WITH {COMMITS}, {EDGES}, reached AS (WITH RECURSIVE r AS (SELECT repo || '@' || sha AS id FROM commits WHERE time IN (40, 71)
      UNION SELECT target_id FROM edges2 JOIN r ON source_id = r.id) SELECT id FROM r)
  SELECT repo, sha, message, time FROM commits WHERE repo || '@' || sha IN (SELECT id FROM reached)""")  # fmt: skip
def mirror_at(spark: SparkSession, d: str) -> DataFrame:
    commits = _commits(spark, d)
    return registers.reachable_commits(commits, commits.filter("time IN (40, 71)")).drop("parents")


@register_sql("list_repos", "SELECT n_name AS name, n_regionkey AS created_at FROM nation")
def list_repos(spark: SparkSession, d: str) -> DataFrame:
    return registers.list_repos(model.table(spark, d, "nation").select(F.col("n_name").alias("name"), F.col("n_regionkey").alias("created_at")))


# Citations in paragraphs of documents


BIBLIOGRAPHY = """SELECT 'd' || doc_id AS id, text || ' Smith, A. (' || (1900 + doc_id % 100) || ')). Knuth, D. (' || (1900 + doc_id % 100)
    || '). "On words ' || doc_id % 7 || '"' || CASE WHEN doc_id % 2 = 0 THEN ' doi:10.1000/w' || doc_id % 11 || '.' ELSE '' END
    || ' See (Adams & Brown, 2001b) arXiv: 2101.0' || doc_id % 9 || 'v2 [cs]' AS content FROM documents"""


def _cited(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("doc_id")
    year = (1900 + key % 100).cast("string")
    doi = F.when(key % 2 == 0, F.concat(F.lit(" doi:10.1000/w"), (key % 11).cast("string"), F.lit("."))).otherwise("")
    tail = F.concat(
        F.lit(" Smith, A. ("), year, F.lit(")). Knuth, D. ("), year, F.lit('). "On words '), (key % 7).cast("string"), F.lit('"'), doi,
        F.lit(" See (Adams & Brown, 2001b) arXiv: 2101.0"), (key % 9).cast("string"), F.lit("v2 [cs]"),
    )
    return model.table(spark, d, "documents").select(_text("d", key).alias("id"), F.concat("text", tail).alias("content"))


@register_sql("extract_references", f"""WITH p AS ({BIBLIOGRAPHY}), own AS (SELECT * FROM p WHERE content IS NOT NULL AND length(content) > 50)
  SELECT 'd' || doc_id AS id, 'bibliography' AS extractor, CASE WHEN doc_id % 2 = 0 THEN '10.1000/w' || doc_id % 11 ELSE 'knuth-' || (1900 + doc_id % 100) END AS key,
    'On words ' || doc_id % 7 AS title FROM documents WHERE text IS NOT NULL
  UNION ALL SELECT id, 'citation', 'adams-2001b', NULL FROM own
  UNION ALL SELECT id, 'doi', regexp_replace(unnest(regexp_extract_all(content, 'doi:?(10\\.\\d{{4,}}/[^\\s,;]+)', 1)), '\\.+$', ''), NULL FROM own
  UNION ALL SELECT id, 'arxiv', 'arxiv:2101.0' || id[2:]::BIGINT % 9 || 'v2', NULL FROM own
  UNION ALL SELECT id, 'url', regexp_replace(unnest(regexp_extract_all(content, 'https?://[^\\s,;)\\]]+')), '\\.+$', ''), NULL FROM own""")  # fmt: skip
def extract_references(spark: SparkSession, d: str) -> DataFrame:
    return citations.extract(_cited(spark, d))


@register_sql("score_novelty", """WITH refs AS (SELECT DISTINCT 'k' || p_brand AS key, split_part(p_name, ' ', 1) AS author FROM part)
  SELECT key, 'citation' AS extractor, round(0.2 * CASE WHEN author = '' THEN 0.5 WHEN EXISTS (SELECT 1 FROM part p WHERE p.p_partkey % 40 = 1
    AND contains(lower(p.p_name || ' and others'), lower(author))) THEN 0.1 ELSE 1.0 END + 0.1 * 0.4, 3) AS score FROM refs""")
def score_novelty(spark: SparkSession, d: str) -> DataFrame:
    part = model.table(spark, d, "part")
    author = F.split_part("p_name", F.lit(" "), F.lit(1)).alias("author")
    refs = part.select(F.concat(F.lit("k"), "p_brand").alias("key"), author).distinct().withColumn("extractor", F.lit("citation"))
    none = spark.createDataFrame([], "key string, paragraph string, document string")
    resolved = part.filter("p_partkey % 40 = 1").select(F.concat("p_name", F.lit(" and others")).alias("authors"))
    return citations.score_references(refs, none, resolved)


@register_sql("new_citation_edges", """SELECT DISTINCT 'p' || l_partkey AS source_id, 's' || l_suppkey AS target_id, 'cites' AS relation FROM lineitem
  WHERE NOT EXISTS (SELECT 1 FROM lineitem o WHERE o.l_partkey = lineitem.l_partkey AND o.l_suppkey = lineitem.l_suppkey AND o.l_linenumber = 2)""")
def new_citation_edges(spark: SparkSession, d: str) -> DataFrame:
    line = model.table(spark, d, "lineitem")
    cites = line.select(_text("p", F.col("l_partkey")).alias("paragraph"), _text("s", F.col("l_suppkey")).alias("key"), "l_linenumber")
    held = cites.filter("l_linenumber = 2").select(F.col("paragraph").alias("source_id"), F.col("key").alias("target_id"), F.lit("cites").alias("relation"))
    return citations.new_edges(cites, held)


# Source comments


@register_sql("comment_placement", """WITH nodes2 AS (SELECT l_orderkey AS file, (l_linenumber * 3)::INTEGER AS line, 'n' || min(l_partkey) AS id FROM lineitem GROUP BY 1, 2),
  comments AS (SELECT DISTINCT l_orderkey AS file, (l_linenumber * 2 + l_partkey % 9)::INTEGER AS first_line,
    (l_linenumber * 2 + l_partkey % 9 + l_suppkey % 2)::INTEGER AS last_line FROM lineitem),
  found AS (SELECT c.*, (SELECT id FROM nodes2 n WHERE n.file = c.file AND n.line = first_line) AS same,
    (SELECT arg_min(id, line) FROM nodes2 n WHERE n.file = c.file AND n.line > last_line) AS next_id,
    (SELECT min(line) FROM nodes2 n WHERE n.file = c.file AND n.line > last_line) AS next_line,
    EXISTS (SELECT 1 FROM nodes2 n WHERE n.file = c.file AND n.line < first_line) AS earlier FROM comments c)
  SELECT file, first_line, last_line, CASE WHEN first_line = last_line AND same IS NOT NULL THEN 'trailing' WHEN next_id IS NULL THEN 'eof'
    WHEN next_line = last_line + 1 OR NOT earlier THEN 'above' ELSE 'between' END AS placement,
    CASE WHEN first_line = last_line AND same IS NOT NULL THEN same ELSE next_id END AS node_id FROM found""")  # fmt: skip
def comment_placement(spark: SparkSession, d: str) -> DataFrame:
    line = model.table(spark, d, "lineitem")
    at = (F.col("l_linenumber") * 3).cast("int")
    nodes = line.groupBy(F.col("l_orderkey").alias("file"), at.alias("line")).agg(_text("n", F.min("l_partkey")).alias("id"))
    first = (F.col("l_linenumber") * 2 + F.col("l_partkey") % 9).cast("int")
    comments = line.select(F.col("l_orderkey").alias("file"), first.alias("first_line"), (first + F.col("l_suppkey") % 2).cast("int").alias("last_line")).distinct()
    return code.placed_comments(comments, nodes)


@register_sql("directives", """SELECT o_orderkey AS file, 1::INTEGER AS line, CASE o_orderkey % 4 WHEN 0 THEN 'skip' WHEN 1 THEN 'skip-sort-imports' END AS flag,
  CASE o_orderkey % 4 WHEN 2 THEN 'use a slice' END AS message, CASE o_orderkey % 4 WHEN 2 THEN 'rule_' || o_orderkey % 5 END AS rule
  FROM orders WHERE o_orderkey % 4 < 3""")
def directives(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("o_orderkey")
    text = (
        F.when(key % 4 == 0, "  // lattica: skip").when(key % 4 == 1, "//lattica:skip-sort-imports")
        .when(key % 4 == 2, F.concat(F.lit("// lattica: use a slice (rule_"), (key % 5).cast("string"), F.lit(")"))).otherwise("// lattica: nothing known")
    )
    return code.directives(model.table(spark, d, "orders").select(key.alias("file"), F.lit(1).alias("line"), text.alias("text")), "lattica")


@register_sql("derive_order", """SELECT p_partkey AS id, 'x #[derive(' || CASE WHEN p_partkey % 2 = 0 THEN 'Clone, Debug, Eq' ELSE 'clone, Debug' END || ')] y' AS source FROM part""")
def derive_order(spark: SparkSession, d: str) -> DataFrame:
    listed = F.when(F.col("p_partkey") % 2 == 0, "Eq,Debug , Clone").otherwise("Debug, clone")
    source = F.concat(F.lit("x #[derive("), listed, F.lit(")] y"))
    return model.table(spark, d, "part").select(F.col("p_partkey").alias("id"), source.alias("source")).withColumn("source", code.ordered_derives(F.col("source")))


# Walks


@register_sql("walk_tokens", """WITH tokens AS (SELECT id, row_number() OVER (ORDER BY path, position, id) - 1 AS token FROM nodes)
  SELECT o_orderkey AS walk, 0::INTEGER AS step, token FROM orders JOIN tokens ON id = 'c' || o_custkey""")
def walk_tokens(spark: SparkSession, d: str) -> DataFrame:
    walk = model.table(spark, d, "orders").select(F.col("o_orderkey").alias("walk"), F.lit(0).alias("step"), _text("c", F.col("o_custkey")).alias("node"))
    vocabulary = walks.vocabulary(model.nodes(spark, d))
    return walks.to_tokens(walks.to_nodes(walks.to_tokens(walk, vocabulary), vocabulary), vocabulary)


@register_sql("nodes_in_order", """SELECT p::INTEGER AS place, n.id, n.kind, n.content FROM (VALUES (0, 'n3'), (1, 'r1'), (3, 'c5'), (4, 'n3')) v(p, i) JOIN nodes n ON n.id = i""")
def nodes_in_order(spark: SparkSession, d: str) -> DataFrame:
    ids = spark.createDataFrame([(["n3", "r1", "none", "c5", "n3"],)], "ids array<string>")
    return walks.in_order(ids, model.nodes(spark, d))


@register_sql("neighbour_degrees", """SELECT source, count(*) AS numbers, max(degree) AS degree FROM (
    SELECT source_id AS source, count(*) OVER (PARTITION BY source_id) AS degree FROM (SELECT DISTINCT source_id, target_id FROM edges)) GROUP BY source""")
def neighbour_degrees(spark: SparkSession, d: str) -> DataFrame:
    edges = model.edges(spark, d).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"))
    numbered = walks.numbered_neighbours(edges)
    return numbered.groupBy("source").agg(F.count_distinct("number").alias("numbers"), F.max("degree").alias("degree"))


@register_sql("weighted_neighbours", """WITH rated AS (SELECT node_id, weight FROM perspectives WHERE agent_id = 'u3'),
  e AS (SELECT source_id AS source, target_id AS target, sum(greatest(round(greatest(1 + abs(coalesce(weight, 0)), 0.01) * 1000000), 1)::BIGINT) AS share
    FROM edges LEFT JOIN rated ON node_id = target_id GROUP BY ALL),
  laid AS (SELECT *, sum(share) OVER (PARTITION BY source ORDER BY target) AS high, sum(share) OVER (PARTITION BY source) AS total FROM e)
  SELECT source, target, (high - share)::BIGINT AS low, high::BIGINT AS high, total::BIGINT AS total FROM laid""")
def weighted_neighbours(spark: SparkSession, d: str) -> DataFrame:
    rated = perspectives.current_perspectives(model.perspective_log(spark, d))
    laid = walks.weighted_neighbours(walks.perspective_edges(model.edges(spark, d), rated, "u3"))
    return laid.select("source", "target", "low", "high", "total").distinct()


@register_sql("walk_perspective", """WITH rated AS (SELECT node_id, weight FROM perspectives WHERE agent_id = 'u3'),
  e AS (SELECT source_id AS source, target_id AS target, sum(greatest(round(greatest(1 + abs(coalesce(weight, 0)), 0.01) * 1000000), 1)::BIGINT) AS share
    FROM edges LEFT JOIN rated ON node_id = target_id GROUP BY ALL),
  laid AS (SELECT *, sum(share) OVER (PARTITION BY source ORDER BY target) AS high, sum(share) OVER (PARTITION BY source) AS total FROM e),
  s0 AS (SELECT 'o' || o_orderkey AS walk, 'o' || o_orderkey AS node FROM orders),
  d1 AS (SELECT walk, node, floor((('0x' || substr(md5('5|1|' || walk || '|' || node), 1, 13))::BIGINT + 0.5) / 4503599627370496.0 * total) AS p
    FROM s0 JOIN (SELECT DISTINCT source, total FROM laid) ON source = node),
  s1 AS (SELECT walk, target AS node FROM d1 JOIN laid ON source = node AND p >= high - share AND p < high)
  SELECT walk, 0::INTEGER AS step, node FROM s0 UNION ALL SELECT walk, 1, node FROM s1""")  # fmt: skip
def walk_perspective(spark: SparkSession, d: str) -> DataFrame:
    rated = perspectives.current_perspectives(model.perspective_log(spark, d))
    edges = walks.perspective_edges(model.edges(spark, d), rated, "u3")
    starts = model.table(spark, d, "orders").select(_text("o", F.col("o_orderkey")).alias("node"))
    return walks.walk(starts.select(F.col("node").alias("walk"), "node"), edges, 1, seed=5, weight=F.col("weight"))


@register_sql("weighted_targets", """SELECT node_id, max(weight) AS weight FROM perspectives WHERE agent_id = 'u3' AND weight > -0.95 GROUP BY node_id""")
def weighted_targets(spark: SparkSession, d: str) -> DataFrame:
    return walks.weighted_targets(perspectives.current_perspectives(model.perspective_log(spark, d)), "u3", least=-0.95)


@register_sql("perspectives_deleted", """SELECT 'u' || user_id AS agent_id, 'p' || json_extract_string(props, '$.k') AS node_id, event_type AS context_id,
    arg_max(value, event_id) AS weight, max(ts) AS updated_at FROM events GROUP BY ALL HAVING arg_max(event_id % 4, event_id) <> 0""")
def perspectives_deleted(spark: SparkSession, d: str) -> DataFrame:
    log = model.perspective_log(spark, d).join(model.table(spark, d, "events").select(F.col("event_id").alias("seq"), "value"), "seq")
    log = log.withColumns({"weight": F.col("value"), "deleted": F.col("seq") % 4 == 0}).drop("value")
    return perspectives.current_perspectives(log)


@register_sql("associations_deleted", """SELECT agent_id, source_id, target_id, relation, arg_max(w, seq) AS weight FROM (
    SELECT 's' || l_suppkey AS agent_id, 'o' || l_orderkey AS source_id, 'p' || l_partkey AS target_id, l_returnflag AS relation,
      1 - 20 * l_discount AS w, l_orderkey * 100 + ordinal AS seq FROM lines) GROUP BY ALL HAVING arg_max(seq % 3, seq) <> 0""")
def associations_deleted(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.current_associations(model.association_log(spark, d).withColumn("deleted", F.col("seq") % 3 == 0))


@register_sql("agents_latest", """SELECT 'u' || user_id AS name, arg_max(event_type, event_id) AS kind FROM events GROUP BY 1""")
def agents_latest(spark: SparkSession, d: str) -> DataFrame:
    log = model.table(spark, d, "events").select(_text("u", F.col("user_id")).alias("name"), F.col("event_type").alias("kind"), F.col("event_id").alias("seq"))
    return latest(log, ["name"], ["seq"]).drop("seq")
