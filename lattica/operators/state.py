"""The state that an operation log leaves, for the operations that :mod:`lattica.operators.oplog` doesn't fold.

An operation is (id, op_type, node_id, author, author_seq, lamport_ts, payload), its payload JSON. What is set again is
last-writer-wins by the clock, what is deleted has a tombstone, and what is appended stays. So every fold is a grouping
that combines on the map side, or a projection. Operations without a value that theirs needs are left out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.ledger import WALLET_TYPES
from lattica.operators.navigate import below
from lattica.operators.oplog import clock, edge_state, fold_metadata, fold_nodes
from lattica.operators.swarm import STATES
from lattica.tables import written

# The states of a bounty.
BOUNTY_STATES = ("open", "claimed", "paid", "expired", "cancelled")


def payloads(ops: DataFrame, op_types: tuple[str, ...], schema: str, needed: tuple[str, ...] = ()) -> DataFrame:
    """(id, op_type, node, clock, and the fields of ``schema``) of the operations of some types that have what they need."""
    rows = ops.filter(F.col("op_type").isin(*op_types)).select(
        F.col("id"), "op_type", F.col("node_id").alias("node"), clock().alias("clock"), F.from_json("payload", schema).alias("p")
    )
    rows = rows.select("id", "op_type", "node", "clock", "p.*")
    return rows.filter(reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in needed])) if needed else rows


def _latest(rows: DataFrame, keys: list[str], deleting: str) -> DataFrame:
    """The last row of each key; a key whose last operation is of the type ``deleting`` is gone."""
    others = [c for c in rows.columns if c not in (*keys, "id", "node", "clock")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "clock").alias("row"))
    return last.select(*keys, "row.*").filter(F.col("op_type") != deleting).drop("op_type")


def full_nodes(ops: DataFrame) -> DataFrame:
    """:func:`~lattica.operators.oplog.fold_nodes` with language and path of the last insert, and the merged metadata.

    The metadata of inserts and of update_metadata are merged key by key; ``metadata`` is a map, empty without any.
    """
    inserts = payloads(ops, ("insert_node",), "language string, path string")
    placed = inserts.groupBy(F.col("node").alias("id")).agg(F.max_by(F.struct("language", "path"), "clock").alias("p"))
    inserted = ops.filter("op_type = 'insert_node'").withColumn("merge", F.get_json_object("payload", "$.metadata"))
    as_merge = inserted.withColumns(
        {"op_type": F.lit("update_metadata"), "payload": F.concat(F.lit('{"merge":'), "merge", F.lit("}"))}
    )
    merges = ops.filter("op_type = 'update_metadata'").unionByName(as_merge.filter("merge IS NOT NULL").drop("merge"))
    keys = fold_metadata(merges).groupBy(F.col("node_id").alias("id"))
    merged = keys.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))).alias("metadata"))
    empty = F.create_map().cast("map<string,string>")
    rows = fold_nodes(ops).join(placed, "id", "left").join(merged, "id", "left")
    return rows.select(
        "id", "kind", "content", "parent_id", "position", "p.language", "p.path", F.coalesce("metadata", empty).alias("metadata")
    )


def deletions(ops: DataFrame) -> DataFrame:
    """(id, parent_id, cascade) of nodes that are deleted: the parent that the log gave them, and how they went."""
    rows = ops.filter(F.col("op_type").isin("insert_node", "move_node", "delete_node"))
    get = lambda key: F.get_json_object("payload", "$." + key)
    op = F.col("op_type")
    parent = F.when(op == "insert_node", get("parent_id")).when(op == "move_node", get("new_parent_id"))
    sets = (op == "insert_node") | ((op == "move_node") & get("new_parent_id").isNotNull())
    state = rows.groupBy(F.col("node_id").alias("id")).agg(
        F.max_by(F.when(sets, parent), F.when(sets, clock())).alias("parent_id"),
        F.max(F.when(op == "insert_node", clock())).alias("inserted"),
        F.max(F.when(op == "delete_node", clock())).alias("deleted"),
        F.max_by(F.when(op == "delete_node", get("cascade")), F.when(op == "delete_node", clock())).alias("cascade"),
    )
    gone = F.col("deleted").isNotNull() & (F.col("inserted").isNull() | (F.col("inserted") < F.col("deleted")))
    cascade = F.coalesce(F.col("cascade") == "true", F.lit(False)).alias("cascade")
    return state.filter(gone).select("id", "parent_id", cascade)


def tree_after(ops: DataFrame) -> DataFrame:
    """The nodes of a log after its deletions: with cascade all below goes too, else children move to the next parent.

    The next parent is the nearest ancestor that isn't deleted; it is found by doubling the steps through deleted
    nodes, so their number doesn't matter.
    """
    nodes = written(fold_nodes(ops), "fold-nodes")
    gone = written(deletions(ops), "fold-deletions")
    everything = nodes.select("id", "parent_id").unionByName(gone.select("id", "parent_id"))
    lost = below(everything, gone.filter("cascade"))
    left = nodes.join(lost, "id", "left_anti")
    heirs = gone.filter("NOT cascade").select(F.col("id").alias("gone"), F.col("parent_id").alias("heir"))
    for _ in range(heirs.count().bit_length() + 1):  # each round doubles the steps, so no chain is left after these
        heirs = written(heirs, "fold-heirs")
        over = heirs.select(F.col("gone").alias("via"), F.col("heir").alias("further"))
        joined = heirs.join(over, F.col("heir") == F.col("via"), "left")
        further = F.when(F.col("via").isNotNull(), F.col("further")).otherwise(F.col("heir")).alias("heir")
        heirs = joined.select("gone", further, F.col("via").isNotNull().alias("moved"))
        if not written(heirs.filter("moved"), "fold-moved").limit(1).count():
            heirs = heirs.drop("moved")
            break
        heirs = heirs.drop("moved")
    # Deleted nodes that hang from each other in a ring have no ancestor that is left
    ring = heirs.select(F.col("gone").alias("in_ring"))
    heirs = heirs.join(ring, F.col("heir") == F.col("in_ring"), "left")
    heirs = heirs.select("gone", F.when(F.col("in_ring").isNull(), F.col("heir")).alias("heir"))
    moved = left.join(heirs, F.col("parent_id") == F.col("gone"), "left")
    parent = F.when(F.col("gone").isNotNull(), F.col("heir")).otherwise(F.col("parent_id")).alias("parent_id")
    return moved.select("id", "kind", "content", parent, "position")


def edges_after(ops: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, metadata): the edges of a log after its deletions.

    Deleting a node takes the edges at it that were inserted before, and deleting one with cascade those at all below it.
    """
    deleted = ops.filter("op_type = 'delete_node'").groupBy(F.col("node_id").alias("id")).agg(F.max(clock()).alias("deleted"))
    deleted = written(deleted, "fold-deleted")
    everything = fold_nodes(ops).select("id", "parent_id")
    gone = written(deletions(ops), "fold-deletions")
    lost = written(below(everything.unionByName(gone.select("id", "parent_id")), gone.filter("cascade")), "fold-lost")
    edges = edge_state(ops)
    for side in ("source_id", "target_id"):
        at = deleted.select(F.col("id").alias(side), "deleted")
        edges = edges.join(at, side, "left").filter("deleted IS NULL OR clock > deleted").drop("deleted")
        edges = edges.join(lost.select(F.col("id").alias(side)), side, "left_anti")
    return edges.select("source_id", "target_id", "relation", "metadata")


def perspectives(ops: DataFrame) -> DataFrame:
    """(agent_id, node_id, context_id, weight, reasoning); a null context is a key like any other."""
    schema = "agent_id string, node_id string, context_id string, weight double, reasoning string"
    rows = payloads(ops, ("set_perspective", "delete_perspective"), schema, ("agent_id", "node_id"))
    rows = rows.filter("op_type = 'delete_perspective' OR weight BETWEEN -1 AND 1")
    return _latest(rows, ["agent_id", "node_id", "context_id"], "delete_perspective")


def associations(ops: DataFrame) -> DataFrame:
    """(agent_id, source_id, target_id, relation, weight, reasoning)."""
    keys = ["agent_id", "source_id", "target_id", "relation"]
    schema = ", ".join(f"{k} string" for k in keys) + ", weight double, reasoning string"
    rows = payloads(ops, ("set_association", "delete_association"), schema, tuple(keys))
    return _latest(rows.filter("op_type = 'delete_association' OR weight IS NOT NULL"), keys, "delete_association")


def _with_state(created: DataFrame, changes: DataFrame, key: str, first: str, states: tuple[str, ...]) -> DataFrame:
    """``created`` (id, ...) with the last valid new_status of ``changes`` (key, new_status, clock), ``first`` without."""
    last = changes.filter(F.col("new_status").isin(*states)).groupBy(F.col(key).alias("id"))
    last = last.agg(F.max_by("new_status", "clock").alias("new_status"))
    return created.join(last, "id", "left").withColumn("status", F.coalesce("new_status", F.lit(first))).drop("new_status")


def tasks(ops: DataFrame) -> DataFrame:
    """(id, description, success_command, scope_node_id, budget_ops, budget_seconds, status); ids are those of their ops."""
    schema = "description string, success_command string, scope_node_id string, budget_ops int, budget_seconds int"
    created = payloads(ops, ("create_task",), schema, ("description", "success_command"))
    created = created.withColumn("id", F.col("id").cast("string")).drop("op_type", "node", "clock")
    changes = payloads(ops, ("update_task_status",), "task_id string, new_status string", ("task_id", "new_status"))
    return _with_state(created, changes, "task_id", "pending", STATES)


def wallets(ops: DataFrame) -> DataFrame:
    """(id, wallet_type, public_key_hex, fingerprint, label): one per fingerprint, the first in the clock."""
    schema = "wallet_type string, public_key_hex string, fingerprint string, label string"
    needed = ("wallet_type", "public_key_hex", "fingerprint")
    rows = payloads(ops, ("create_wallet", "register_wallet"), schema, needed).filter(F.col("wallet_type").isin(*WALLET_TYPES))
    rows = rows.withColumn("id", F.col("id").cast("string"))
    first = rows.groupBy("fingerprint").agg(F.min_by(F.struct("id", "wallet_type", "public_key_hex", "label"), "clock").alias("row"))
    return first.select("row.id", "row.wallet_type", "row.public_key_hex", "fingerprint", "row.label")


_REWARD = "reward:"


def movements(ops: DataFrame) -> DataFrame:
    """(id, from_wallet, to_wallet, amount, reason, timestamp): the ledger of transfers, signed ones and rewards."""
    schema = "from_wallet string, to_wallet string, amount long, reason string, timestamp long, work_type string"
    kinds = ("transfer_koi", "signed_transfer", "mint_reward")
    rows = payloads(ops, kinds, schema, ("to_wallet", "amount")).filter("amount > 0")
    mint = F.col("op_type") == "mint_reward"
    rows = rows.filter(~(mint & F.col("work_type").isNull()) & ~((F.col("op_type") == "signed_transfer") & F.col("from_wallet").isNull()))
    return rows.select(
        "id", F.when(~mint, F.col("from_wallet")).alias("from_wallet"), "to_wallet", "amount",
        F.when(mint, F.concat(F.lit(_REWARD), "work_type")).otherwise(F.col("reason")).alias("reason"),
        F.coalesce("timestamp", F.col("clock.lamport_ts")).alias("timestamp"),
    )


def rewards(ops: DataFrame) -> DataFrame:
    """(id, work_type, wallet, amount): the log of rewarded work."""
    rows = payloads(ops, ("mint_reward",), "work_type string, to_wallet string, amount long", ("work_type", "to_wallet", "amount"))
    return rows.filter("amount > 0").select("id", "work_type", F.col("to_wallet").alias("wallet"), "amount")


def nonces(ops: DataFrame) -> DataFrame:
    """(wallet, nonce): the largest nonce that a wallet has signed."""
    rows = payloads(ops, ("signed_transfer",), "from_wallet string, nonce long", ("from_wallet", "nonce"))
    return rows.groupBy(F.col("from_wallet").alias("wallet")).agg(F.max("nonce").alias("nonce"))


def bounties(ops: DataFrame) -> DataFrame:
    """(id, poster_wallet, scope, description, reward, claimed_by, verified, status)."""
    schema = "poster_wallet string, scope string, description string, reward long"
    created = payloads(ops, ("create_bounty",), schema, tuple(f.split()[0] for f in schema.split(", "))).filter("reward > 0")
    created = created.withColumn("id", F.col("id").cast("string")).drop("op_type", "node", "clock")
    schema = "bounty_id string, new_status string, claimed_by string"
    changes = payloads(ops, ("update_bounty_status",), schema, ("bounty_id", "new_status"))
    changes = changes.filter(F.col("new_status").isin(*BOUNTY_STATES))
    marks = changes.groupBy(F.col("bounty_id").alias("id")).agg(
        F.max_by("claimed_by", F.when(F.col("claimed_by").isNotNull(), F.col("clock"))).alias("claimed_by"),
        F.max(F.col("new_status") == "paid").alias("verified"),
    )
    rows = _with_state(created, changes, "bounty_id", "open", BOUNTY_STATES).join(marks, "id", "left")
    return rows.withColumn("verified", F.coalesce("verified", F.lit(False)))


def models(ops: DataFrame) -> DataFrame:
    """(agent, dim, n_heads, n_layers): the models that weren't deleted after they were last created."""
    rows = payloads(ops, ("create_model", "delete_model"), "agent string, dim int, n_heads int, n_layers int", ("agent",))
    return _latest(rows, ["agent"], "delete_model")


def float_values(text: Column) -> Column:
    """The doubles of base64 text that holds 32-bit floats, lowest byte first; infinities and NaN are null."""
    digits = F.hex(F.unbase64(text))

    def value(k: Column) -> Column:
        bits = F.conv(F.concat(*[F.substring(digits, k * 8 + at, F.lit(2)) for at in (7, 5, 3, 1)]), 16, 10).cast("long")
        fraction, power = bits.bitwiseAND(F.lit((1 << 23) - 1)), F.shiftright(bits, 23).bitwiseAND(F.lit(255))
        size = F.when(power == 0, fraction * 2.0**-149).when(power < 255, (fraction + (1 << 23)) * F.pow(F.lit(2.0), power - 150))
        return F.when(bits >= (1 << 31), -size).otherwise(size)

    return F.transform(F.sequence(F.lit(0), F.greatest(F.length(digits) / 8, F.lit(1)).cast("int") - 1), value)


def model_weights(ops: DataFrame) -> DataFrame:
    """(agent, tensor, position, value): the sums of the deltas since a model was last deleted; their order doesn't matter."""
    deltas = payloads(ops, ("update_model_weights",), "agent string, tensor string, delta string", ("agent", "tensor", "delta"))
    deleted = payloads(ops, ("delete_model",), "agent string", ("agent",))
    deleted = deleted.groupBy("agent").agg(F.max("clock").alias("deleted"))
    rows = deltas.join(deleted, "agent", "left").filter("deleted IS NULL OR clock > deleted")
    parts = rows.select("agent", "tensor", F.posexplode(float_values(F.col("delta"))).alias("position", "value"))
    return parts.groupBy("agent", "tensor", "position").agg(F.sum("value").alias("value"))


def training_runs(ops: DataFrame) -> DataFrame:
    """(id, agent, walk_type, steps, final_loss): one per train_step."""
    rows = payloads(ops, ("train_step",), "agent string, walk_type string, steps int, final_loss double", ("agent",))
    return rows.select("id", "agent", "walk_type", "steps", "final_loss")
