"""The operation log: dedup, clocks, exchange with a peer, and the fold of the log to a state.

The fold is convergent: fields are last-writer-wins by (lamport_ts, author, author_seq) and deletes are tombstones, so
the order in which operations arrive doesn't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.operators.running import running_maximum, running_sum

CLOCK = ["lamport_ts", "author", "author_seq"]
# The types of operations a log may hold.
OP_TYPES = (
    "insert_node", "update_content", "update_metadata", "move_node", "delete_node", "insert_edge", "delete_edge",
    "set_perspective", "delete_perspective", "set_association", "delete_association", "create_task",
    "update_task_status", "create_wallet", "transfer_koi", "create_bounty", "update_bounty_status", "register_wallet",
    "signed_transfer", "mint_reward", "create_model", "update_model_weights", "delete_model", "train_step",
)


def clock() -> Column:
    return F.struct(*CLOCK)


def deduplicated(ops: DataFrame) -> DataFrame:
    """Each (author, author_seq) once: the one with the smallest Lamport time."""
    others = [c for c in ops.columns if c not in ("author", "author_seq")]
    first = ops.groupBy("author", "author_seq").agg(F.min_by(F.struct(*others), F.struct("lamport_ts", "id")).alias("row"))
    return first.select("author", "author_seq", "row.*")


def not_applied(incoming: DataFrame, log: DataFrame) -> DataFrame:
    """Incoming operations that the log doesn't hold yet."""
    return deduplicated(incoming).join(log.select("author", "author_seq"), ["author", "author_seq"], "left_anti")


def version_vector(ops: DataFrame) -> DataFrame:
    return ops.groupBy("author").agg(F.max("author_seq").alias("max_seq"))


def lamport_clock(ops: DataFrame) -> DataFrame:
    return ops.agg(F.coalesce(F.max("lamport_ts"), F.lit(0)).cast("long").alias("lamport_ts"))


def assigned(requests: DataFrame, log: DataFrame) -> DataFrame:
    """New operations (author, arrived, lamport_ts, ...) with their author_seq and Lamport time, without a task per author.

    ``arrived`` orders an author's rows. A row whose lamport_ts is null is an operation of the author; one that has it
    is an operation of another that the author has seen, and isn't returned. Sequences go on gapless from the version
    vector of ``log``, times from its clock: after n own operations the clock is n plus the largest of where it began
    and, over what was seen, its time less the own operations before it.
    """
    own = F.col("lamport_ts").isNull()
    rows = running_sum(requests.withColumn("__own", own.cast("long")), ["author"], "arrived", "__own", "__made")
    rows = running_maximum(rows.withColumn("__seen", F.col("lamport_ts") - F.col("__made")), ["author"], "arrived", "__seen", "__ahead")
    began = F.broadcast(lamport_clock(log).withColumnRenamed("lamport_ts", "__began"))  # one row
    rows = rows.filter(own).join(version_vector(log), "author", "left").join(began)
    return rows.select(
        *[c for c in requests.columns if c != "lamport_ts"],
        (F.coalesce("max_seq", F.lit(0)) + F.col("__made")).cast("long").alias("author_seq"),
        (F.greatest("__began", F.coalesce("__ahead", "__began")) + F.col("__made")).cast("long").alias("lamport_ts"),
    )


def ops_since(ops: DataFrame, author: str, since_seq: int) -> DataFrame:
    return ops.filter((F.col("author") == author) & (F.col("author_seq") > since_seq)).orderBy("author_seq")


def to_pull(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Operations of ``theirs`` beyond what the version vector of ``mine`` has seen of each author."""
    seen = version_vector(mine).withColumnRenamed("max_seq", "seen")
    behind = theirs.join(seen, "author", "left")
    return behind.filter(F.col("author_seq") > F.coalesce("seen", F.lit(0))).drop("seen")


def vector_difference(mine: DataFrame, theirs: DataFrame) -> DataFrame:
    """Per author how many operations each side is behind."""
    a = version_vector(mine).withColumnRenamed("max_seq", "mine")
    b = version_vector(theirs).withColumnRenamed("max_seq", "theirs")
    both = a.join(b, "author", "full_outer").na.fill(0, ["mine", "theirs"])
    return both.select(
        "author", "mine", "theirs", F.greatest(F.col("theirs") - F.col("mine"), F.lit(0)).alias("behind"),
        F.greatest(F.col("mine") - F.col("theirs"), F.lit(0)).alias("ahead"),
    ).filter("behind > 0 OR ahead > 0")


#: Deleted ids that are looked up as literals.
FEW_DELETED = 1000
#: The fields of a node's state: the clock of the last insert and delete, and of each value the last that set it.
NODE_FIELDS = ("inserted", "deleted", "kind", "content", "parent_id", "position")


def node_state(ops: DataFrame) -> DataFrame:
    """(node_id, NODE_FIELDS) of node operations: values with the clock that set them, so states can be merged.

    ``payload`` is JSON. insert_node sets kind, content, parent_id and position; update_content sets new_content;
    move_node sets new_parent_id and new_position, each only if given; delete_node is a tombstone that beats every
    insert before it in the clock. One grouping by node, without a sort or a window.
    """
    op, get = F.col("op_type"), lambda key: F.get_json_object("payload", "$." + key)
    insert, move = op == "insert_node", op == "move_node"
    content = F.when(insert, get("content")).when(op == "update_content", get("new_content"))
    parent = F.when(insert, get("parent_id")).when(move, get("new_parent_id"))
    position = F.when(insert, F.coalesce(get("position"), F.lit("0"))).when(move, get("new_position"))

    def last(value: Column, when: Column) -> Column:
        return F.max(F.when(when, F.struct(clock().alias("clock"), value.alias("value"))))

    return ops.filter("node_id IS NOT NULL").groupBy("node_id").agg(
        F.max(F.when(insert, clock())).alias("inserted"),
        F.max(F.when(op == "delete_node", clock())).alias("deleted"),
        last(get("kind"), insert).alias("kind"),
        last(content, insert | (op == "update_content")).alias("content"),
        last(parent, insert | (move & get("new_parent_id").isNotNull())).alias("parent_id"),
        last(position, insert | (move & get("new_position").isNotNull())).alias("position"),
    )


def merged_state(states: DataFrame) -> DataFrame:
    """States of :func:`node_state` as one per node. Merging the same operations again changes nothing."""
    return states.groupBy("node_id").agg(*[F.max(f).alias(f) for f in NODE_FIELDS])


def nodes_of(state: DataFrame) -> DataFrame:
    """The nodes that are alive in a state: id, kind, content, parent_id, position."""
    alive = F.col("inserted").isNotNull() & (F.col("deleted").isNull() | (F.col("inserted") > F.col("deleted")))
    return state.filter(alive).select(
        F.col("node_id").alias("id"), F.col("kind.value").alias("kind"), F.col("content.value").alias("content"),
        F.col("parent_id.value").alias("parent_id"), F.col("position.value").cast("int").alias("position"),
    )


def fold_nodes(ops: DataFrame) -> DataFrame:
    """The nodes that node operations leave. Children of a deleted node are treated by :func:`cascade`."""
    return nodes_of(node_state(ops))


def fold_metadata(ops: DataFrame) -> DataFrame:
    """(node_id, key, value): the shallow merge of all update_metadata operations, last writer wins per key."""
    merged = ops.filter("op_type = 'update_metadata'").select(
        "node_id", *CLOCK, F.explode(F.from_json(F.get_json_object("payload", "$.merge"), "map<string,string>"))
    )
    return merged.groupBy("node_id", "key").agg(F.max_by("value", clock()).alias("value"))


def edge_state(ops: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, metadata, clock) of edges whose last operation in the clock is an insert.

    ``metadata`` is the JSON text that the insert gave, ``{}`` without any.
    """
    get = lambda key: F.get_json_object("payload", "$." + key)
    edge = ops.filter(F.col("op_type").isin("insert_edge", "delete_edge"))
    keyed = edge.select(
        F.col("node_id").alias("source_id"), get("target_id").alias("target_id"), get("relation").alias("relation"),
        F.coalesce(get("metadata"), F.lit("{}")).alias("metadata"), "op_type", clock().alias("clock"),
    )
    state = keyed.groupBy("source_id", "target_id", "relation").agg(F.max_by(F.struct("op_type", "metadata", "clock"), "clock").alias("last"))
    return state.filter("last.op_type = 'insert_edge'").select("source_id", "target_id", "relation", "last.metadata", "last.clock")


def fold_edges(ops: DataFrame) -> DataFrame:
    """(source_id, target_id, relation, metadata): the edges that inserts and deletes leave, whatever becomes of their nodes."""
    return edge_state(ops).drop("clock")


def cascade(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """``nodes`` without the subtrees of ``deleted`` (id), by the labels of their paths: no recursion.

    A path holds the labels of all ancestors. Up to FEW_DELETED ids are looked up in the path as the nodes are read,
    without a shuffle; more are found by one join of the labels. Nodes without a path stay.
    """
    few = deleted.select(F.col("id").cast("string")).filter("id IS NOT NULL").distinct().limit(FEW_DELETED + 1).collect()
    if len(few) <= FEW_DELETED:
        under = F.exists(F.split("path", r"\."), lambda label: label.isin([r["id"] for r in few]))
        return nodes.filter(~F.coalesce(under, F.lit(False))) if few else nodes
    labels = nodes.select("id", F.explode(F.split("path", r"\.")).alias("label"))
    gone = labels.join(deleted.select(F.col("id").alias("label")).distinct(), "label", "left_semi")
    return nodes.join(gone.select("id").distinct(), "id", "left_anti")


def reparent(nodes: DataFrame, deleted: DataFrame) -> DataFrame:
    """``nodes`` without ``deleted`` (id); their children hang from their parents. Chains need one call per level."""
    gone = deleted.select("id").distinct()
    heirs = nodes.join(gone, "id", "left_semi").select(F.col("id").alias("gone"), F.col("parent_id").alias("heir"))
    left = nodes.join(gone, "id", "left_anti").join(heirs, F.col("parent_id") == F.col("gone"), "left")
    return left.withColumn("parent_id", F.when(F.col("gone").isNotNull(), F.col("heir")).otherwise(F.col("parent_id"))).drop(
        "gone", "heir"
    )


def without_dependants(rows: DataFrame, deleted: DataFrame, *columns: str) -> DataFrame:
    """Rows none of whose ``columns`` names a deleted node."""
    gone = deleted.select(F.col("id").alias("gone")).distinct()
    for column in columns:
        rows = rows.join(gone, F.col(column) == F.col("gone"), "left_anti")
    return rows


def fold_weights(deltas: DataFrame) -> DataFrame:
    """(agent, tensor, values): the sum of all deltas (agent, tensor, values array), position by position."""
    parts = deltas.select("agent", "tensor", F.posexplode("values").alias("at", "delta"))
    sums = parts.groupBy("agent", "tensor", "at").agg(F.sum("delta").alias("value"))
    ordered = F.array_sort(F.collect_list(F.struct("at", "value")))
    return sums.groupBy("agent", "tensor").agg(F.transform(ordered, lambda x: x["value"]).alias("values"))


def newest(ops: DataFrame, author: str | None = None, limit: int = 20) -> DataFrame:
    chosen = ops if author is None else ops.filter(F.col("author") == author)
    return chosen.orderBy(F.desc("lamport_ts"), F.desc("author"), F.desc("author_seq")).limit(limit)
