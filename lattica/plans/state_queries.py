"""Queries that fold one log with all types of operations, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import oplog, state
from lattica.plans import model
from lattica.plans.oracle import sql
from lattica.queries import register
from lattica.streaming import fold
from lattica.tables import scratch_path

TASK_STATES = ("pending", "running", "succeeded", "failed", "stopped", "bogus")
BOUNTY_STATES = ("open", "claimed", "paid", "expired", "cancelled", "bogus")
TYPES = oplog.OP_TYPES
PERIOD = len(TYPES)
#: Base64 of the 32-bit floats 1.5, -2.0 and 0.25, 100.0.
DELTAS = ("AADAPwAAAMA=", "AACAPgAAyEI=")
DELTA_VALUES = ((1.5, -2.0), (0.25, 100.0))


def _choice(values, number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (number % len(values) + 1).cast("int"))


def full_log(spark: SparkSession, d: str) -> DataFrame:
    """Events as operations of all types in turn; every payload holds the values that any of them needs."""
    ops = model.operations(spark, d)
    at = F.col("lamport_ts")
    turn = F.floor(at / PERIOD)
    text = lambda prefix, number: F.concat(F.lit(prefix), number.cast("string"))
    # The operation of another type in an earlier turn, whose id is its time less 1
    earlier = lambda op_type: ((turn - turn % 3) * PERIOD + TYPES.index(op_type) - 1).cast("string")
    values = {
        "kind": F.lit("part"), "content": F.col("author"), "new_content": F.concat(F.lit("new "), "author"),
        "language": text("l", at % 3), "path": F.concat(F.lit("q."), "node_id"),
        "metadata": F.struct(F.col("author").alias("made")), "merge": F.struct(text("", at % 5).alias("seen")),
        "parent_id": text("p", at % 40), "new_parent_id": text("p", at % 30), "position": at % 100, "cascade": turn % 2 == 0,
        "agent_id": F.col("author"), "node_id": F.col("node_id"), "context_id": F.when(turn % 5 != 0, text("c", turn % 4)),
        "weight": (turn % 240) / 100.0 - 1.2, "source_id": F.col("node_id"), "target_id": text("t", turn % 7),
        "relation": F.lit("links"), "description": text("do ", at), "success_command": F.lit("make"), "budget_ops": at % 10,
        "task_id": earlier("create_task"), "bounty_id": earlier("create_bounty"),
        "new_status": F.when(at % PERIOD == TYPES.index("update_task_status"), _choice(TASK_STATES, turn)).otherwise(_choice(BOUNTY_STATES, turn)),
        "claimed_by": F.when(turn % 2 == 0, F.col("author")), "wallet_type": _choice(("human", "agent", "external", "other"), turn),
        "public_key_hex": text("0", at), "fingerprint": text("f", turn % 50), "label": F.col("author"),
        "from_wallet": F.when(turn % 4 != 0, F.col("author")), "to_wallet": text("w", at % 11), "amount": at % 1000 - 20,
        "reason": F.lit("pay"), "timestamp": at * 2, "nonce": turn, "work_type": _choice(("parse", "train"), turn),
        "poster_wallet": F.col("author"), "scope": F.col("node_id"), "reward": at % 300 - 10, "agent": F.col("author"),
        "dim": (at % 4 + 1) * 8, "n_heads": at % 4 + 1, "n_layers": F.lit(1), "tensor": text("w", turn % 2),
        "delta": _choice(DELTAS, turn), "walk_type": F.lit("tree"), "steps": at % 100, "final_loss": (at % 7) / 2.0,
    }
    payload = F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]))
    return ops.withColumns({"op_type": _choice(TYPES, at), "payload": payload})


LOG = f"""log AS (SELECT id, node_id, author, lamport_ts AS lt, lamport_ts // {PERIOD} AS turn, lamport_ts % {PERIOD} AS op FROM operations)"""


def register_fold(name: str, body: str):
    return register(name, sql(f"WITH {LOG} {body}"))


def _op(*names: str) -> str:
    return "op IN (" + ", ".join(str(TYPES.index(n)) for n in names) + ")"


def _is(name: str) -> str:
    return f"op = {TYPES.index(name)}"


NODE_SQL = f"""SELECT node_id AS id,
    arg_max(CASE WHEN {_is('insert_node')} THEN author ELSE 'new ' || author END, lt) FILTER ({_op('insert_node', 'update_content')}) AS content,
    arg_max(CASE WHEN {_is('insert_node')} THEN 'p' || lt % 40 ELSE 'p' || lt % 30 END, lt) FILTER ({_op('insert_node', 'move_node')}) AS parent_id,
    (arg_max(lt % 100, lt) FILTER ({_is('insert_node')}))::INTEGER AS position,
    arg_max('l' || lt % 3, lt) FILTER ({_is('insert_node')}) AS language,
    max(lt) FILTER ({_is('insert_node')}) AS inserted, max(lt) FILTER ({_is('delete_node')}) AS deleted,
    arg_max(turn % 2 = 0, lt) FILTER ({_is('delete_node')}) AS cascade,
    arg_max(author, lt) FILTER ({_is('insert_node')}) AS made,
    arg_max((lt % 5)::VARCHAR, lt) FILTER ({_is('update_metadata')}) AS seen
  FROM log WHERE node_id IS NOT NULL GROUP BY node_id"""


@register_fold("state_nodes", f""", folded AS ({NODE_SQL})
  SELECT id, 'part' AS kind, content, parent_id, position, language, 'q.' || id AS path, made, seen FROM folded
  WHERE inserted > coalesce(deleted, 0)""")  # fmt: skip
def state_nodes(spark: SparkSession, d: str) -> DataFrame:
    rows = state.full_nodes(full_log(spark, d))
    return rows.withColumns({"made": F.col("metadata")["made"], "seen": F.col("metadata")["seen"]}).drop("metadata")


LOST_SQL = f"""folded AS ({NODE_SQL}),
  gone AS (SELECT id, parent_id, cascade FROM folded WHERE deleted IS NOT NULL AND coalesce(inserted, 0) < deleted),
  alive AS (SELECT * FROM folded WHERE inserted > coalesce(deleted, 0)),
  everything AS (SELECT id, parent_id FROM alive UNION ALL SELECT id, parent_id FROM gone),
  lost AS (WITH RECURSIVE r AS (SELECT id FROM gone WHERE cascade
           UNION SELECT e.id FROM everything e JOIN r ON e.parent_id = r.id) SELECT id FROM r)"""


@register_fold("state_edges", f""", {LOST_SQL}, last AS (SELECT node_id, turn % 7 AS t, max(lt) AS lt, arg_max(author, lt) AS made FROM log
    WHERE {_op('insert_edge', 'delete_edge')} AND node_id IS NOT NULL GROUP BY ALL HAVING arg_max(op, lt) = {TYPES.index('insert_edge')})
  SELECT node_id AS source_id, 't' || t AS target_id, 'links' AS relation, '{{"made":"' || last.made || '"}}' AS metadata
  FROM last LEFT JOIN folded ON id = node_id WHERE lt > coalesce(deleted, 0) AND node_id NOT IN (SELECT id FROM lost)""")  # fmt: skip
def state_edges(spark: SparkSession, d: str) -> DataFrame:
    return state.edges_after(full_log(spark, d))


@register_fold("incremental_fold", f""", folded AS ({NODE_SQL})
  SELECT id, 'part' AS kind, content, parent_id, position FROM folded WHERE inserted > coalesce(deleted, 0)""")  # fmt: skip
def incremental_fold(spark: SparkSession, d: str) -> DataFrame:
    """The log in three batches, one of them twice."""
    log, folder = full_log(spark, d), scratch_path(spark, "incremental-fold")
    for batch, part in enumerate((1, 0, 0, 2)):
        fold.merge(log.filter(F.col("lamport_ts") % 3 == part), folder, batch, buckets=16)
    return fold.nodes(spark, folder)


@register("assigned_clocks", sql("""WITH asked AS (SELECT 'u' || user_id % 9 AS author, event_id AS arrived,
    CASE WHEN event_id % 5 = 0 THEN event_id * 3 % 20000 END AS seen FROM events),
  made AS (SELECT *, count(*) FILTER (seen IS NULL) OVER (PARTITION BY author ORDER BY arrived) AS n FROM asked),
  ahead AS (SELECT *, max(seen - n) OVER (PARTITION BY author ORDER BY arrived) AS a FROM made),
  vector AS (SELECT author, max(author_seq) AS s FROM operations WHERE lamport_ts <= 500 GROUP BY author)
  SELECT author, arrived, coalesce(s, 0) + n AS author_seq, n + greatest(coalesce(a, 0), (SELECT max(lamport_ts) FROM operations WHERE lamport_ts <= 500)) AS lamport_ts
  FROM ahead LEFT JOIN vector USING (author) WHERE seen IS NULL"""))  # fmt: skip
def assigned_clocks(spark: SparkSession, d: str) -> DataFrame:
    event = F.col("event_id")
    asked = model.table(spark, d, "events").select(
        F.concat(F.lit("u"), (F.col("user_id") % 9).cast("string")).alias("author"), event.alias("arrived"),
        F.when(event % 5 == 0, event * 3 % 20000).alias("lamport_ts"),
    )
    return oplog.assigned(asked, model.operations(spark, d).filter("lamport_ts <= 500"))


@register_fold("state_tree", f""", {LOST_SQL},
  up AS (WITH RECURSIVE r AS (SELECT id, parent_id AS heir, 1 AS n FROM gone WHERE NOT cascade
         UNION SELECT r.id, g.parent_id, n + 1 FROM r JOIN gone g ON r.heir = g.id AND NOT g.cascade WHERE n < 200) SELECT * FROM r),
  heirs AS (SELECT id, arg_max_null(heir, n) AS heir, max(n) AS steps FROM up GROUP BY id)
  SELECT a.id, 'part' AS kind, content, CASE WHEN h.id IS NULL THEN a.parent_id WHEN steps < 200 THEN heir END AS parent_id, position
  FROM alive a LEFT JOIN heirs h ON a.parent_id = h.id WHERE a.id NOT IN (SELECT id FROM lost)""")  # fmt: skip
def state_tree(spark: SparkSession, d: str) -> DataFrame:
    return state.tree_after(full_log(spark, d))


@register_fold("state_perspectives", f""", log2 AS (SELECT *, CASE WHEN turn % 5 <> 0 THEN 'c' || turn % 4 END AS context_id,
    (turn % 240) / 100.0 - 1.2 AS weight FROM log WHERE {_op('set_perspective', 'delete_perspective')} AND node_id IS NOT NULL)
  SELECT author AS agent_id, node_id, context_id, arg_max(weight::DOUBLE, lt) AS weight, NULL AS reasoning FROM log2
  WHERE {_is('delete_perspective')} OR weight BETWEEN -1 AND 1
  GROUP BY author, node_id, context_id HAVING arg_max(op, lt) = {TYPES.index('set_perspective')}""")  # fmt: skip
def state_perspectives(spark: SparkSession, d: str) -> DataFrame:
    return state.perspectives(full_log(spark, d))


@register_fold("state_associations", f"""SELECT author AS agent_id, node_id AS source_id, 't' || turn % 7 AS target_id, 'links' AS relation,
    arg_max((turn % 240) / 100.0 - 1.2, lt)::DOUBLE AS weight, NULL AS reasoning
  FROM log WHERE {_op('set_association', 'delete_association')} AND node_id IS NOT NULL GROUP BY author, node_id, turn % 7
  HAVING arg_max(op, lt) = {TYPES.index('set_association')}""")  # fmt: skip
def state_associations(spark: SparkSession, d: str) -> DataFrame:
    return state.associations(full_log(spark, d))


def _changes(op_type: str, created: str, states: tuple[str, ...]) -> str:
    listed = ", ".join(f"'{s}'" for s in states)
    return f"""changes AS (SELECT ((turn - turn % 3) * {PERIOD} + {TYPES.index(created)} - 1)::VARCHAR AS id, lt, turn, author,
      ([{listed}])[turn % {len(states)} + 1] AS new_status FROM log WHERE {_is(op_type)}),
    valid AS (SELECT * FROM changes WHERE new_status <> 'bogus')"""


@register_fold("state_tasks", f""", {_changes('update_task_status', 'create_task', TASK_STATES)},
  last AS (SELECT id, arg_max(new_status, lt) AS s FROM valid GROUP BY id)
  SELECT log.id::VARCHAR AS id, 'do ' || lt AS description, 'make' AS success_command, NULL AS scope_node_id,
    (lt % 10)::INTEGER AS budget_ops, NULL::INTEGER AS budget_seconds, coalesce(s, 'pending') AS status
  FROM log LEFT JOIN last ON log.id::VARCHAR = last.id WHERE {_is('create_task')}""")  # fmt: skip
def state_tasks(spark: SparkSession, d: str) -> DataFrame:
    return state.tasks(full_log(spark, d))


@register_fold("state_wallets", f"""SELECT arg_min(id::VARCHAR, lt) AS id, arg_min((['human', 'agent', 'external', 'other'])[turn % 4 + 1], lt) AS wallet_type,
    arg_min('0' || lt, lt) AS public_key_hex, 'f' || turn % 50 AS fingerprint, arg_min(author, lt) AS label
  FROM log WHERE {_op('create_wallet', 'register_wallet')} AND turn % 4 <> 3 GROUP BY turn % 50""")  # fmt: skip
def state_wallets(spark: SparkSession, d: str) -> DataFrame:
    return state.wallets(full_log(spark, d))


@register_fold("state_movements", f"""SELECT id, CASE WHEN turn % 4 <> 0 AND NOT {_is('mint_reward')} THEN author END AS from_wallet, 'w' || lt % 11 AS to_wallet,
    lt % 1000 - 20 AS amount, CASE WHEN {_is('mint_reward')} THEN 'reward:' || (['parse', 'train'])[turn % 2 + 1] ELSE 'pay' END AS reason,
    lt * 2 AS timestamp
  FROM log WHERE {_op('transfer_koi', 'signed_transfer', 'mint_reward')} AND lt % 1000 > 20
    AND NOT ({_is('signed_transfer')} AND turn % 4 = 0)""")  # fmt: skip
def state_movements(spark: SparkSession, d: str) -> DataFrame:
    return state.movements(full_log(spark, d))


@register_fold("state_rewards", f"""SELECT id, (['parse', 'train'])[turn % 2 + 1] AS work_type, 'w' || lt % 11 AS wallet, lt % 1000 - 20 AS amount
  FROM log WHERE {_is('mint_reward')} AND lt % 1000 > 20""")  # fmt: skip
def state_rewards(spark: SparkSession, d: str) -> DataFrame:
    return state.rewards(full_log(spark, d))


@register_fold("state_nonces", f"""SELECT author AS wallet, max(turn) AS nonce FROM log WHERE {_is('signed_transfer')} AND turn % 4 <> 0 GROUP BY author""")
def state_nonces(spark: SparkSession, d: str) -> DataFrame:
    return state.nonces(full_log(spark, d))


@register_fold("state_bounties", f""", {_changes('update_bounty_status', 'create_bounty', BOUNTY_STATES)},
  last AS (SELECT id, arg_max(new_status, lt) AS s, arg_max(author, lt) FILTER (turn % 2 = 0) AS claimed_by,
                  bool_or(new_status = 'paid') AS verified FROM valid GROUP BY id)
  SELECT log.id::VARCHAR AS id, author AS poster_wallet, node_id AS scope, 'do ' || lt AS description, lt % 300 - 10 AS reward,
    claimed_by, coalesce(verified, false) AS verified, coalesce(s, 'open') AS status
  FROM log LEFT JOIN last ON log.id::VARCHAR = last.id WHERE {_is('create_bounty')} AND lt % 300 > 10 AND node_id IS NOT NULL""")  # fmt: skip
def state_bounties(spark: SparkSession, d: str) -> DataFrame:
    return state.bounties(full_log(spark, d))


@register_fold("state_models", f"""SELECT author AS agent, ((arg_max(lt, lt) % 4 + 1) * 8)::INTEGER AS dim, (arg_max(lt, lt) % 4 + 1)::INTEGER AS n_heads,
    1::INTEGER AS n_layers FROM log WHERE {_op('create_model', 'delete_model')} GROUP BY author
  HAVING arg_max(op, lt) = {TYPES.index('create_model')}""")  # fmt: skip
def state_models(spark: SparkSession, d: str) -> DataFrame:
    return state.models(full_log(spark, d))


@register_fold("state_weights", f""", deleted AS (SELECT author, max(lt) AS deleted FROM log WHERE {_is('delete_model')} GROUP BY author),
  deltas AS (SELECT l.author AS agent, 'w' || turn % 2 AS tensor,
      unnest(CASE WHEN turn % 2 = 0 THEN {list(DELTA_VALUES[0])} ELSE {list(DELTA_VALUES[1])} END) AS value, unnest([0, 1]) AS position
    FROM log l LEFT JOIN deleted d ON l.author = d.author WHERE {_is('update_model_weights')} AND lt > coalesce(deleted, 0))
  SELECT agent, tensor, position, sum(value::DOUBLE) AS value FROM deltas GROUP BY ALL""")  # fmt: skip
def state_weights(spark: SparkSession, d: str) -> DataFrame:
    return state.model_weights(full_log(spark, d))


@register_fold("state_training", f"""SELECT id, author AS agent, 'tree' AS walk_type, (lt % 100)::INTEGER AS steps, (lt % 7) / 2.0::DOUBLE AS final_loss
  FROM log WHERE {_is('train_step')}""")  # fmt: skip
def state_training(spark: SparkSession, d: str) -> DataFrame:
    return state.training_runs(full_log(spark, d))
