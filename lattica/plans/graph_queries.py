"""Queries over the graph model, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import latest, ledger, market, navigate, oplog, perspectives, swarm
from lattica.plans import model
from lattica.plans.oracle import sql
from lattica.queries import register
from lattica.sources import peer
from lattica.tables import scratch_path, written

COUNTED = """SELECT n.id, n.kind, n.content, n.position, n.path, coalesce(c.n, 0) AS child_count
  FROM nodes n LEFT JOIN (SELECT parent_id AS of, count(*) AS n FROM nodes GROUP BY parent_id) c ON n.id = c.of"""


def register_sql(name: str, body: str | None = None):
    return register(name, sql(body) if body else None)


# Structure


@register_sql("tree_subtree", f"{COUNTED} WHERE n.path = 'r0.n5' OR starts_with(n.path, 'r0.n5.')")
def tree_subtree(spark: SparkSession, d: str) -> DataFrame:
    return navigate.tree(model.nodes(spark, d), "r0.n5")


@register_sql("tree_roots", f"{COUNTED} WHERE n.parent_id IS NULL")
def tree_roots(spark: SparkSession, d: str) -> DataFrame:
    return navigate.tree(model.nodes(spark, d))


@register_sql("tree_lquery", f"{COUNTED} WHERE regexp_matches(n.path, '^(r1|r2)\\.[^.]+\\.c1[^.]*$')")
def tree_lquery(spark: SparkSession, d: str) -> DataFrame:
    return navigate.tree(model.nodes(spark, d), "r1|r2.*{1}.c1*")


@register_sql("children", f"{COUNTED} WHERE n.parent_id = 'n3'")
def children(spark: SparkSession, d: str) -> DataFrame:
    return navigate.children(model.nodes(spark, d), "n3")


@register_sql("find_ilike", """SELECT id, kind, content, path FROM nodes WHERE content ILIKE '%00%1'
  ORDER BY kind NULLS LAST, content NULLS LAST, id LIMIT 50""")  # fmt: skip
def find_ilike(spark: SparkSession, d: str) -> DataFrame:
    return navigate.find(model.nodes(spark, d), "%00%1")


@register_sql("find_kind_limit", """SELECT id, kind, content, path FROM nodes WHERE content ILIKE '%a%' AND kind = 'nation'
  ORDER BY kind NULLS LAST, content NULLS LAST, id LIMIT 7""")  # fmt: skip
def find_kind_limit(spark: SparkSession, d: str) -> DataFrame:
    return navigate.find(model.nodes(spark, d), "%a%", "nation", 7)


@register_sql("refs", """
  SELECT 'definition' AS role, id, kind, path, NULL AS parent_kind, NULL AS parent_content FROM nodes
  WHERE content = 'R' AND kind IN ('region', 'order')
  UNION ALL SELECT 'reference', n.id, n.kind, n.path, p.kind, p.content FROM nodes n LEFT JOIN nodes p ON n.parent_id = p.id
  WHERE n.content = 'R' AND n.kind = 'line'
  UNION ALL SELECT 'impl', id, kind, path, NULL, NULL FROM nodes
  WHERE kind = 'impl' AND json_extract_string(metadata, '$.self_ty') = 'R'""")  # fmt: skip
def refs(spark: SparkSession, d: str) -> DataFrame:
    return navigate.refs(model.nodes(spark, d), "R", ("region", "order"), ("line",))


@register_sql("ancestors_recursive", """WITH RECURSIVE chain AS (
  SELECT p.id, p.kind, p.content, p.parent_id, p.path, 0 AS depth FROM nodes n JOIN nodes p ON n.parent_id = p.id
  WHERE n.id = 'l1_1'
  UNION ALL SELECT p.id, p.kind, p.content, p.parent_id, p.path, depth + 1 FROM chain JOIN nodes p ON chain.parent_id = p.id)
  SELECT id, kind, content, path, depth FROM chain""")  # fmt: skip
def ancestors_recursive(spark: SparkSession, d: str) -> DataFrame:
    return navigate.ancestors(model.nodes(spark, d), "l1_1")


@register_sql("descendants_recursive", """WITH RECURSIVE below AS (
  SELECT id, kind, content, parent_id, position, 0 AS depth FROM nodes WHERE id = 'n7'
  UNION ALL SELECT c.id, c.kind, c.content, c.parent_id, c.position, depth + 1 FROM below JOIN nodes c ON c.parent_id = below.id)
  SELECT id, kind, content, parent_id, position, depth FROM below""")  # fmt: skip
def descendants_recursive(spark: SparkSession, d: str) -> DataFrame:
    return navigate.descendants(model.nodes(spark, d), "n7")


@register_sql("list_documents", """SELECT n.id, n.kind, n.content, n.position, n.path, coalesce(c.n, 0) AS child_count
  FROM document_nodes n LEFT JOIN (SELECT parent_id AS of, count(*) AS n FROM document_nodes GROUP BY 1) c ON n.id = c.of
  WHERE n.kind = 'document'""")  # fmt: skip
def list_documents(spark: SparkSession, d: str) -> DataFrame:
    return navigate.documents(model.document_nodes(spark, d))


@register_sql("document_tree", """SELECT id, kind, content, parent_id, position, 0 AS depth FROM document_nodes WHERE id = 'd7'
  UNION ALL SELECT id, kind, content, parent_id, position, 1 FROM document_nodes WHERE parent_id = 'd7'""")
def document_tree(spark: SparkSession, d: str) -> DataFrame:
    return navigate.descendants(model.document_nodes(spark, d), "d7")


@register_sql("cascade_delete", """SELECT id, kind, path FROM nodes n WHERE NOT EXISTS (
  SELECT 1 FROM nodes x WHERE x.id IN ('n3', 'c11', 'o77') AND (n.path = x.path OR starts_with(n.path, x.path || '.')))""")
def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    nodes = model.nodes(spark, d)
    return oplog.cascade(nodes, nodes.filter(F.col("id").isin("n3", "c11", "o77"))).select("id", "kind", "path")


@register_sql("reparent_delete", """SELECT id, kind, CASE WHEN kind = 'customer' THEN split_part(path, '.', 1) ELSE parent_id END
  AS parent_id FROM nodes WHERE kind <> 'nation'""")
def reparent_delete(spark: SparkSession, d: str) -> DataFrame:
    nodes = model.nodes(spark, d)
    return oplog.reparent(nodes, nodes.filter("kind = 'nation'")).select("id", "kind", "parent_id")


@register_sql("edges_degree", """SELECT relation, source_id, count(*) AS degree FROM edges GROUP BY ALL HAVING count(*) > 3""")
def edges_degree(spark: SparkSession, d: str) -> DataFrame:
    edges = model.edges(spark, d)
    return edges.groupBy("relation", "source_id").agg(F.count("*").alias("degree")).filter("degree > 3")


# Perspectives


def _perspectives(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.current_perspectives(model.perspective_log(spark, d))


def _associations(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.current_associations(model.association_log(spark, d))


@register_sql("perspectives_latest", "SELECT * FROM perspectives")
def perspectives_latest(spark: SparkSession, d: str) -> DataFrame:
    return _perspectives(spark, d)


@register_sql("get_perspectives", """SELECT node_id, kind, content, context_id, weight FROM perspectives p
  JOIN nodes n ON p.node_id = n.id WHERE agent_id = 'u3' AND weight >= -0.9""")
def get_perspectives(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.get_perspectives(_perspectives(spark, d), model.nodes(spark, d), "u3", None, -0.9)


@register_sql("get_associations", """SELECT source_id, target_id, relation, weight FROM associations
  WHERE agent_id = 's5' AND relation = 'R'""")
def get_associations(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.get_associations(_associations(spark, d), "s5", None, "R")


@register_sql("consensus", """SELECT node_id, context_id, agent_count, round(avg_weight, 10) AS avg_weight, min_weight, max_weight,
  round(stddev_weight, 10) AS stddev_weight, kind, content FROM (
    SELECT node_id, context_id, count(DISTINCT agent_id) AS agent_count, avg(weight) AS avg_weight,
           min(weight) AS min_weight, max(weight) AS max_weight, stddev_samp(weight) AS stddev_weight
    FROM perspectives GROUP BY ALL HAVING count(DISTINCT agent_id) >= 2 AND avg(weight) >= -0.9) c
  JOIN nodes n ON c.node_id = n.id""")  # fmt: skip
def consensus(spark: SparkSession, d: str) -> DataFrame:
    agreed = perspectives.consensus(_perspectives(spark, d), model.nodes(spark, d), None, 2, -0.9)
    return agreed.withColumns({c: F.round(c, 10) for c in ("avg_weight", "stddev_weight")})


@register_sql("perspective_diff", """WITH a AS (SELECT * FROM perspectives WHERE agent_id = 'u1'),
  b AS (SELECT * FROM perspectives WHERE agent_id = 'u2')
  SELECT CASE WHEN b.node_id IS NULL THEN 'only_in_a' WHEN a.node_id IS NULL THEN 'only_in_b' ELSE 'disagreement' END AS part,
         coalesce(a.node_id, b.node_id) AS node_id, coalesce(a.context_id, b.context_id) AS context_id,
         a.weight AS weight_a, b.weight AS weight_b, abs(a.weight - b.weight) AS difference
  FROM a FULL JOIN b ON a.node_id = b.node_id AND a.context_id IS NOT DISTINCT FROM b.context_id
  WHERE a.node_id IS NULL OR b.node_id IS NULL OR a.weight <> b.weight""")  # fmt: skip
def perspective_diff(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.perspective_diff(_perspectives(spark, d), "u1", "u2")


@register_sql("unique_insights", """SELECT a.source_id, a.target_id, a.relation, a.weight, s.content AS source_content,
  t.content AS target_content FROM associations a JOIN nodes s ON a.source_id = s.id JOIN nodes t ON a.target_id = t.id
  WHERE a.agent_id = 's3' AND NOT EXISTS (SELECT 1 FROM associations o WHERE o.source_id = a.source_id
    AND o.target_id = a.target_id AND o.relation = a.relation AND o.agent_id <> a.agent_id)""")  # fmt: skip
def unique_insights(spark: SparkSession, d: str) -> DataFrame:
    return perspectives.unique_insights(_associations(spark, d), model.nodes(spark, d), "s3")


@register_sql("list_agents", "SELECT id, name, kind FROM agents WHERE kind = 'llm'")
def list_agents(spark: SparkSession, d: str) -> DataFrame:
    return model.agents(spark, d).filter("kind = 'llm'").orderBy("name")


@register_sql("removable_agents", """SELECT name FROM agents a WHERE kind = 'human'
  AND NOT EXISTS (SELECT 1 FROM perspectives p WHERE p.agent_id = a.id AND p.weight > 0.9)""")
def removable_agents(spark: SparkSession, d: str) -> DataFrame:
    strong = _perspectives(spark, d).filter("weight > 0.9").select(F.col("agent_id").alias("id"))
    return model.agents(spark, d).filter("kind = 'human'").join(strong, "id", "left_anti").select("name")


# Operation log


@register_sql("oplog_dedup", "SELECT author, author_seq, id, lamport_ts FROM operations")
def oplog_dedup(spark: SparkSession, d: str) -> DataFrame:
    ops = model.operations(spark, d).select("id", "author", "author_seq", "lamport_ts")
    return oplog.deduplicated(ops.unionByName(ops.withColumn("lamport_ts", F.col("lamport_ts") + 5)))


@register_sql("version_vector", "SELECT author, max(author_seq) AS max_seq FROM operations GROUP BY author")
def version_vector(spark: SparkSession, d: str) -> DataFrame:
    return oplog.version_vector(model.operations(spark, d))


@register_sql("lamport_clock", "SELECT coalesce(max(lamport_ts), 0) AS lamport_ts FROM operations")
def lamport_clock(spark: SparkSession, d: str) -> DataFrame:
    return oplog.lamport_clock(model.operations(spark, d))


@register_sql("ops_since", "SELECT * EXCLUDE (value) FROM operations WHERE author = 'u5' AND author_seq > 10")
def ops_since(spark: SparkSession, d: str) -> DataFrame:
    return oplog.ops_since(model.operations(spark, d), "u5", 10).drop("value")


@register_sql("ops_to_pull", """SELECT o.author, o.author_seq FROM operations o LEFT JOIN (
  SELECT author, max(author_seq) AS seen FROM operations WHERE value < 100 GROUP BY author) v ON o.author = v.author
  WHERE o.author_seq > coalesce(seen, 0)""")
def ops_to_pull(spark: SparkSession, d: str) -> DataFrame:
    ops = model.operations(spark, d)
    return oplog.to_pull(ops.filter("value < 100"), ops).select("author", "author_seq")


@register_sql("vector_difference", """WITH mine AS (SELECT author, max(author_seq) AS m FROM operations WHERE value < 100 GROUP BY 1),
  theirs AS (SELECT author, max(author_seq) AS t FROM operations GROUP BY 1),
  v AS (SELECT author, coalesce(m, 0) AS mine, coalesce(t, 0) AS theirs FROM mine FULL JOIN theirs USING (author))
  SELECT author, mine, theirs, greatest(theirs - mine, 0) AS behind, greatest(mine - theirs, 0) AS ahead FROM v
  WHERE mine <> theirs""")  # fmt: skip
def vector_difference(spark: SparkSession, d: str) -> DataFrame:
    ops = model.operations(spark, d)
    return oplog.vector_difference(ops.filter("value < 100"), ops)


PEER_SCHEMA = "author string, author_seq long, id long, op_type string, created_at timestamp"


def _published(spark: SparkSession, ops: DataFrame, label: str) -> str:
    """A peer's folder with two batches of ``ops``: each author's operations up to the tenth, then the rest."""
    folder = scratch_path(spark, label)
    for part in ("author_seq <= 10", "author_seq > 10"):
        peer.publish(ops.filter(part), folder)
    return folder


@register_sql("peer_pull", """SELECT o.author, o.author_seq, o.id, o.op_type, o.created_at FROM operations o LEFT JOIN (
  SELECT author, max(author_seq) AS seen FROM operations WHERE value < 100 GROUP BY author) v ON o.author = v.author
  WHERE o.author_seq > coalesce(seen, 0)""")
def peer_pull(spark: SparkSession, d: str) -> DataFrame:
    """What a peer's published log has beyond one's own, through the data source."""
    ops = written(model.operations(spark, d), "operations")
    return peer.pull(spark, _published(spark, ops, "peer"), oplog.version_vector(ops.filter("value < 100")), PEER_SCHEMA)


@register_sql("peer_sync", """WITH mine AS (SELECT author, author_seq FROM operations WHERE id % 3 = 0),
  theirs AS (SELECT author, author_seq FROM operations WHERE id % 3 = 1),
  m AS (SELECT author, max(author_seq) AS n FROM mine GROUP BY author), t AS (SELECT author, max(author_seq) AS n FROM theirs GROUP BY author),
  both_logs AS (SELECT 'mine' AS side, * FROM mine UNION ALL SELECT 'theirs', * FROM theirs
    UNION ALL SELECT 'mine', o.* FROM theirs o LEFT JOIN m USING (author) WHERE author_seq > coalesce(n, 0)
    UNION ALL SELECT 'theirs', o.* FROM mine o LEFT JOIN t USING (author) WHERE author_seq > coalesce(n, 0))
  SELECT side, author, count(*) AS operations, max(author_seq) AS max_seq FROM both_logs GROUP BY side, author""")  # fmt: skip
def peer_sync(spark: SparkSession, d: str) -> DataFrame:
    """Two published logs after an exchange: how many operations of each author either has."""
    ops = written(model.operations(spark, d), "operations")
    folders = {side: _published(spark, ops.filter(F.col("id") % 3 == k), side) for k, side in enumerate(("mine", "theirs"))}
    peer.sync(spark, folders["mine"], folders["theirs"], PEER_SCHEMA)
    held = [peer.operations(spark, f).withColumn("side", F.lit(side)) for side, f in folders.items()]
    counted = held[0].unionByName(held[1], allowMissingColumns=True).groupBy("side", "author")
    return counted.agg(F.count("*").alias("operations"), F.max("author_seq").alias("max_seq"))


@register_sql("oplog_newest", """SELECT id, author, lamport_ts FROM operations WHERE author = 'u9'
  ORDER BY lamport_ts DESC, author DESC, author_seq DESC LIMIT 20""")
def oplog_newest(spark: SparkSession, d: str) -> DataFrame:
    return oplog.newest(model.operations(spark, d), "u9").select("id", "author", "lamport_ts")


def _node_ops(spark: SparkSession, d: str) -> DataFrame:
    """Events as inserts, updates, moves and deletes of part nodes."""
    kinds = {"0": "insert_node", "1": "update_content", "2": "move_node", "3": "delete_node"}
    which = F.col("lamport_ts") % 13
    op = F.when(which < 6, kinds["0"]).when(which < 9, kinds["1"]).when(which < 12, kinds["2"]).otherwise(kinds["3"])
    author = F.col("author")
    payload = F.concat(
        F.lit('{"kind":"part","content":"'), author, F.lit('","new_content":"new '), author, F.lit('","parent_id":"r'),
        (F.col("lamport_ts") % 5).cast("string"), F.lit('","new_parent_id":"n'), (F.col("lamport_ts") % 25).cast("string"),
        F.lit('","position":'), (F.col("lamport_ts") % 100).cast("string"), F.lit("}"),
    )
    return model.operations(spark, d).withColumns({"op_type": op, "payload": payload})


@register_sql("oplog_fold_nodes", """WITH ops AS (
    SELECT *, CASE WHEN lamport_ts % 13 < 6 THEN 'insert' WHEN lamport_ts % 13 < 9 THEN 'update'
                   WHEN lamport_ts % 13 < 12 THEN 'move' ELSE 'delete' END AS op FROM operations)
  SELECT node_id AS id, 'part' AS kind,
         arg_max(CASE op WHEN 'insert' THEN author ELSE 'new ' || author END, lamport_ts)
           FILTER (WHERE op IN ('insert', 'update')) AS content,
         arg_max(CASE op WHEN 'insert' THEN 'r' || lamport_ts % 5 ELSE 'n' || lamport_ts % 25 END, lamport_ts)
           FILTER (WHERE op IN ('insert', 'move')) AS parent_id,
         (arg_max(lamport_ts % 100, lamport_ts) FILTER (WHERE op = 'insert'))::INTEGER AS position
  FROM ops GROUP BY node_id
  HAVING max(lamport_ts) FILTER (WHERE op = 'insert') > coalesce(max(lamport_ts) FILTER (WHERE op = 'delete'), 0)""")  # fmt: skip
def oplog_fold_nodes(spark: SparkSession, d: str) -> DataFrame:
    return oplog.fold_nodes(_node_ops(spark, d))


@register_sql("metadata_merge_fold", """SELECT node_id, 'k' || lamport_ts % 3 AS key, arg_max(author, lamport_ts) AS value
  FROM operations GROUP BY node_id, lamport_ts % 3""")
def metadata_merge_fold(spark: SparkSession, d: str) -> DataFrame:
    merge = F.concat(F.lit('{"merge":{"k'), (F.col("lamport_ts") % 3).cast("string"), F.lit('":"'), "author", F.lit('"}}'))
    ops = model.operations(spark, d).withColumns({"op_type": F.lit("update_metadata"), "payload": merge})
    return oplog.fold_metadata(ops)


@register_sql("oplog_fold_edges", """SELECT node_id AS source_id, 't' || lamport_ts % 7 AS target_id, 'links' AS relation, '{}' AS metadata
  FROM operations GROUP BY node_id, lamport_ts % 7 HAVING arg_max(lamport_ts % 4, lamport_ts) <> 0""")
def oplog_fold_edges(spark: SparkSession, d: str) -> DataFrame:
    target = F.concat(F.lit('{"relation":"links","target_id":"t'), (F.col("lamport_ts") % 7).cast("string"), F.lit('"}'))
    op = F.when(F.col("lamport_ts") % 4 == 0, "delete_edge").otherwise("insert_edge")
    return oplog.fold_edges(model.operations(spark, d).withColumns({"op_type": op, "payload": target}))


@register_sql("model_weight_fold", """SELECT author AS agent, 'w' || lamport_ts % 2 AS tensor, lamport_ts % 3 AS at,
  sum(lamport_ts % 100)::DOUBLE AS value FROM operations GROUP BY author, lamport_ts % 2, lamport_ts % 3""")
def model_weight_fold(spark: SparkSession, d: str) -> DataFrame:
    value = (F.col("lamport_ts") % 100).cast("double")
    values = F.transform(F.array(F.lit(0), F.lit(1), F.lit(2)), lambda i: F.when(F.col("lamport_ts") % 3 == i, value).otherwise(0.0))
    ops = model.operations(spark, d)
    tensor = F.concat(F.lit("w"), (F.col("lamport_ts") % 2).cast("string"))
    deltas = ops.select(F.col("author").alias("agent"), tensor.alias("tensor"), values.alias("values"))
    folded = oplog.fold_weights(deltas).select("agent", "tensor", F.posexplode("values").alias("at", "value"))
    seen = ops.select(F.col("author").alias("agent"), tensor.alias("tensor"), (F.col("lamport_ts") % 3).cast("int").alias("at")).distinct()
    return folded.join(seen, ["agent", "tensor", "at"]).select("agent", "tensor", F.col("at").cast("long").alias("at"), "value")


# Swarm


@register_sql("swarm_leaderboard", """SELECT agent_id, count(*) FILTER (passed) AS passed, count(*) FILTER (NOT passed) AS failed,
  count(*) AS total, round(100.0 * count(*) FILTER (passed) / greatest(count(*), 1), 1)::DOUBLE AS pass_rate,
  round(avg(duration_ms), 0) AS avg_duration_ms FROM test_results WHERE task_id = 'click' GROUP BY agent_id""")
def swarm_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return swarm.leaderboard(model.test_results(spark, d), "click").withColumn("pass_rate", F.col("pass_rate").cast("double"))


@register_sql("swarm_progress", """SELECT date_trunc('minute', created_at)::TIMESTAMP AS minute, count(*) FILTER (passed) AS passed,
  count(*) FILTER (NOT passed) AS failed, count(*) AS total,
  round(100.0 * count(*) FILTER (passed) / greatest(count(*), 1), 1)::DOUBLE AS pass_rate
  FROM test_results WHERE task_id = 'click' GROUP BY 1""")
def swarm_progress(spark: SparkSession, d: str) -> DataFrame:
    return swarm.progress(model.test_results(spark, d), "click").withColumn("pass_rate", F.col("pass_rate").cast("double"))


@register_sql("swarm_status", """SELECT t.id, t.description, t.status, a.name AS swarm_name, count(r.id) AS total,
  count(r.id) FILTER (r.passed) AS passed, count(r.id) FILTER (NOT r.passed) AS failed FROM tasks t
  LEFT JOIN agents a ON t.swarm_id = a.id LEFT JOIN test_results r ON r.task_id = t.id GROUP BY ALL""")
def swarm_status(spark: SparkSession, d: str) -> DataFrame:
    return swarm.status(model.tasks(spark, d), model.test_results(spark, d), model.agents(spark, d))


@register_sql("list_tasks", "SELECT id, status FROM tasks WHERE status = 'running'")
def list_tasks(spark: SparkSession, d: str) -> DataFrame:
    return model.tasks(spark, d).filter("status = 'running'").select("id", "status")


@register_sql("launch_swarm", """SELECT id, CASE WHEN status = 'pending' THEN 'running' ELSE status END AS status,
  status <> 'pending' AS refused FROM tasks""")
def launch_swarm(spark: SparkSession, d: str) -> DataFrame:
    return swarm.moved(model.tasks(spark, d), "launch").select("id", "status", "refused")


# Ledger


@register_sql("wallet_balances", "SELECT * FROM balances")
def wallet_balances(spark: SparkSession, d: str) -> DataFrame:
    return ledger.balances(model.ledger(spark, d))


@register_sql("wallet_balance", "SELECT * FROM balances WHERE wallet = 's7'")
def wallet_balance(spark: SparkSession, d: str) -> DataFrame:
    return ledger.wallet_balance(model.ledger(spark, d), "s7")


@register_sql("wallet_history", """SELECT from_wallet, to_wallet, amount, reason, timestamp,
  CASE WHEN to_wallet = 'c10' THEN 'received' ELSE 'sent' END AS direction FROM ledger
  WHERE to_wallet = 'c10' OR from_wallet = 'c10' ORDER BY timestamp DESC LIMIT 50""")  # fmt: skip
def wallet_history(spark: SparkSession, d: str) -> DataFrame:
    return ledger.history(model.ledger(spark, d), "c10")


@register_sql("total_supply", """SELECT coalesce(sum(amount) FILTER (from_wallet IS NULL), 0)::BIGINT AS supply,
  count(*) AS movements FROM ledger""")
def total_supply(spark: SparkSession, d: str) -> DataFrame:
    return ledger.total_supply(model.ledger(spark, d))


@register_sql("wallet_shares", """SELECT wallet, balance, round(balance::DOUBLE / supply::DOUBLE, 12) AS share FROM balances,
  (SELECT sum(amount) FILTER (from_wallet IS NULL) AS supply FROM ledger)""")
def wallet_shares(spark: SparkSession, d: str) -> DataFrame:
    return ledger.shares(model.ledger(spark, d)).withColumn("share", F.round(F.col("share").cast("double"), 12))


@register_sql("supply_top_holders", "SELECT wallet, balance FROM balances WHERE balance > 0 ORDER BY balance DESC, wallet LIMIT 10")
def supply_top_holders(spark: SparkSession, d: str) -> DataFrame:
    return ledger.top_holders(model.ledger(spark, d))


@register_sql("supply_last_mints", """SELECT to_wallet, amount, reason, timestamp FROM ledger WHERE from_wallet IS NULL
  ORDER BY timestamp DESC LIMIT 10""")
def supply_last_mints(spark: SparkSession, d: str) -> DataFrame:
    return ledger.last_mints(model.ledger(spark, d))


@register_sql("overdrafts", """WITH changes AS (
    SELECT to_wallet AS wallet, amount AS change, timestamp FROM ledger
    UNION ALL SELECT from_wallet, -amount, timestamp FROM ledger WHERE from_wallet IS NOT NULL),
  running AS (SELECT wallet, sum(change) OVER (PARTITION BY wallet ORDER BY timestamp, change
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance FROM changes)
  SELECT wallet, count(*) AS violations, min(balance)::BIGINT AS lowest FROM running WHERE balance < 0 GROUP BY wallet""")  # fmt: skip
def overdrafts(spark: SparkSession, d: str) -> DataFrame:
    return ledger.overdrafts(model.ledger(spark, d))


def _schedule(spark: SparkSession) -> DataFrame:
    rows = [("click", 5, True), ("view", 2, True), ("purchase", 50, False)]
    return spark.createDataFrame(rows, "work_type string, reward long, enabled boolean")


@register_sql("reward_mints", """SELECT agent_id AS wallet, task_id AS work_type, reward AS amount, 'reward:' || task_id AS reason
  FROM test_results JOIN (VALUES ('click', 5::BIGINT), ('view', 2::BIGINT)) s(work_type, reward) ON task_id = work_type
  WHERE passed""")
def reward_mints(spark: SparkSession, d: str) -> DataFrame:
    done = model.test_results(spark, d).filter("passed")
    work = done.select(F.col("agent_id").alias("wallet"), F.col("task_id").alias("work_type"))
    return ledger.reward_mints(work, _schedule(spark))


@register_sql("training_rewards", """SELECT 'u' || user_id AS agent, 'c' || user_id AS wallet, event_id % 57 AS steps,
  5 * greatest(event_id % 57 // 10, 1) AS amount, 'model_training' AS reason FROM events WHERE user_id % 3 <> 0""")
def training_rewards(spark: SparkSession, d: str) -> DataFrame:
    runs = model.table(spark, d, "events").select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent"),
                                                  (F.col("event_id") % 57).alias("steps"))
    wallet = F.when(F.col("user_id") % 3 != 0, F.concat(F.lit("c"), F.col("user_id").cast("string")))
    agents = runs.select(F.col("agent").alias("id"), wallet.alias("wallet")).distinct()
    schedule = spark.createDataFrame([("model_training", 5, True), ("view", 7, True)], "work_type string, reward long, enabled boolean")
    return ledger.training_rewards(runs.select("agent", "steps"), agents, schedule)


# Market


@register_sql("market_browse", """SELECT a.id, a.scope, current_price, floor_price, coalesce(n, 0) AS bid_count FROM auctions a
  LEFT JOIN (SELECT auction_id, count(*) AS n FROM bids GROUP BY 1) b ON a.id = b.auction_id
  WHERE status = 'active' AND current_price <= 130000 AND (scope = 'parts' OR starts_with(scope, 'parts.'))""")  # fmt: skip
def market_browse(spark: SparkSession, d: str) -> DataFrame:
    return market.browse(model.auctions(spark, d), model.bids(spark, d), "parts", 130000)


@register_sql("market_status", """SELECT a.id, a.scope, a.status, a.current_price,
  coalesce(string_agg(bidder_wallet || ':' || max_price, ',' ORDER BY max_price DESC, seq), '') AS bids
  FROM auctions a LEFT JOIN bids b ON a.id = b.auction_id WHERE a.id = 11 GROUP BY ALL""")
def market_status(spark: SparkSession, d: str) -> DataFrame:
    return market.market_status(model.auctions(spark, d), model.bids(spark, d), 11)


@register_sql("market_balance", """SELECT earnings, spending, earnings - spending AS net, active_auctions, active_bids FROM
  (SELECT coalesce(sum(amount) FILTER (to_wallet = 's3'), 0)::BIGINT AS earnings,
          coalesce(sum(amount) FILTER (from_wallet = 's3'), 0)::BIGINT AS spending FROM ledger),
  (SELECT count(*) FILTER (seller_wallet = 's3') AS active_auctions FROM auctions WHERE status = 'active'),
  (SELECT count(*) FILTER (bidder_wallet = 's3') AS active_bids FROM bids
   WHERE auction_id IN (SELECT id FROM auctions WHERE status = 'active'))""")  # fmt: skip
def market_balance(spark: SparkSession, d: str) -> DataFrame:
    return market.market_balance(model.ledger(spark, d), model.auctions(spark, d), model.bids(spark, d), "s3")


@register_sql("market_stats", """SELECT * FROM (SELECT count(*) AS auctions, count(*) FILTER (status = 'active') AS active,
  count(*) FILTER (status = 'settled') AS settled, count(*) FILTER (status = 'open_sourced') AS open_sourced,
  coalesce(round(avg(current_price) FILTER (status = 'settled')), 0)::DOUBLE AS avg_settled_price FROM auctions),
  (SELECT count(*) AS bids FROM bids)""")  # fmt: skip
def market_stats(spark: SparkSession, d: str) -> DataFrame:
    return market.stats(model.auctions(spark, d), model.bids(spark, d))


@register_sql("market_commons_since", """SELECT id, scope, current_price, event_id AS open_sourced_at FROM auctions
  JOIN (SELECT event_id FROM events) ON event_id = id * 3 WHERE status = 'open_sourced' AND event_id >= 200""")
def market_commons_since(spark: SparkSession, d: str) -> DataFrame:
    opened = model.table(spark, d, "events").select(F.col("event_id").alias("open_sourced_at"))
    auctions = model.auctions(spark, d).join(opened, F.col("open_sourced_at") == F.col("id") * 3)
    return market.commons(auctions, "parts", 200)


@register_sql("market_commons", "SELECT id, scope, current_price FROM auctions WHERE status = 'open_sourced'")
def market_commons(spark: SparkSession, d: str) -> DataFrame:
    return market.commons(model.auctions(spark, d), "parts")


@register_sql("auction_tick", """WITH t AS (SELECT *, greatest(current_price - price_decrement, floor_price) AS new_price FROM auctions
    WHERE status = 'active')
  SELECT id, current_price, new_price, count(max_price) AS qualifying,
         CASE WHEN new_price <= floor_price THEN 'open_sourced' WHEN count(max_price) >= min_bidders THEN 'settlement_ready'
              ELSE 'price_decremented' END AS action
  FROM t LEFT JOIN bids ON auction_id = id AND max_price >= new_price
  GROUP BY id, current_price, new_price, floor_price, min_bidders""")  # fmt: skip
def auction_tick(spark: SparkSession, d: str) -> DataFrame:
    return market.tick(model.auctions(spark, d), model.bids(spark, d))


@register_sql("auction_replay", """WITH RECURSIVE ticks AS (
    SELECT id, 0::BIGINT AS ticks, current_price AS price, 'price_decremented' AS action FROM auctions WHERE status = 'active'
    UNION ALL
    SELECT t.id, t.ticks + 1, greatest(price - price_decrement, floor_price),
           CASE WHEN greatest(price - price_decrement, floor_price) <= floor_price THEN 'open_sourced'
                WHEN (SELECT count(*) FROM bids b WHERE b.auction_id = t.id
                      AND b.max_price >= greatest(price - price_decrement, floor_price)) >= min_bidders THEN 'settlement_ready'
                ELSE 'price_decremented' END
    FROM ticks t JOIN auctions a ON t.id = a.id WHERE action = 'price_decremented')
  SELECT id, ticks, price AS final_price, action FROM ticks WHERE action <> 'price_decremented'""")  # fmt: skip
def auction_replay(spark: SparkSession, d: str) -> DataFrame:
    return market.replay(model.auctions(spark, d), model.bids(spark, d))


@register_sql("auction_settle", """WITH good AS (SELECT id, bidder_wallet, seller_wallet, current_price, min_bidders, seq,
    count(*) OVER (PARTITION BY id) AS n FROM auctions JOIN bids ON auction_id = id
    WHERE status = 'active' AND max_price >= current_price)
  SELECT id AS auction_id, bidder_wallet AS from_wallet, seller_wallet AS to_wallet, current_price AS amount,
    (sum(current_price) OVER (PARTITION BY id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS timestamp
  FROM good WHERE n >= min_bidders""")  # fmt: skip
def auction_settle(spark: SparkSession, d: str) -> DataFrame:
    return market.settle(model.auctions(spark, d), model.bids(spark, d))


@register_sql("list_bounties", """SELECT id, scope, current_price AS reward, status FROM auctions
  WHERE status = 'settled' AND starts_with(scope, 'parts.')""")
def list_bounties(spark: SparkSession, d: str) -> DataFrame:
    rows = model.auctions(spark, d).select("id", "scope", F.col("current_price").alias("reward"), "status")
    return market.bounties(rows, "settled", "parts")


# State kept as logs


@register_sql("preferences_latest", """SELECT 'u' || user_id AS agent, event_type AS key, arg_max(value, event_id) AS value
  FROM events GROUP BY ALL HAVING arg_max(value, event_id) < 400""")
def preferences_latest(spark: SparkSession, d: str) -> DataFrame:
    log = model.table(spark, d, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("agent"), F.col("event_type").alias("key"), "value",
        F.col("event_id").alias("seq"), (F.col("value") >= 400).alias("deleted"),
    )
    return latest.latest(log, ["agent", "key"], ["seq"], "deleted").drop("seq")


@register_sql("init_diff", """WITH a AS (SELECT n_name AS key, n_regionkey::VARCHAR AS wanted FROM nation WHERE n_nationkey < 20),
  b AS (SELECT n_name AS key, (n_regionkey % 3)::VARCHAR AS current FROM nation WHERE n_nationkey > 4)
  SELECT key, CASE WHEN current IS NULL THEN 'add' WHEN wanted IS NULL THEN 'delete' ELSE 'update' END AS change,
         wanted, current FROM a FULL JOIN b USING (key) WHERE wanted IS DISTINCT FROM current""")  # fmt: skip
def init_diff(spark: SparkSession, d: str) -> DataFrame:
    nation = model.table(spark, d, "nation")
    wanted = nation.filter("n_nationkey < 20").select(F.col("n_name").alias("key"), F.col("n_regionkey").cast("string").alias("value"))
    now = nation.filter("n_nationkey > 4").select(F.col("n_name").alias("key"), (F.col("n_regionkey") % 3).cast("string").alias("value"))
    return latest.sync_counts(wanted, now, "key", "value")
