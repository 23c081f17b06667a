"""The graph model as DataFrames over the tables of a data folder. All ids are deterministic strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.tables import tasks_for

NODE_COLUMNS = ["id", "kind", "language", "content", "parent_id", "position", "path", "metadata"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _id(prefix: str, key: Column) -> Column:
    return F.concat(F.lit(prefix), key.cast("string"))


def _node(df: DataFrame, kind: str, node_id: Column, content: str, parent: Column, position: Column, path: Column, meta: Column):
    return df.select(
        node_id.alias("id"),
        F.lit(kind).alias("kind"),
        F.lit(None).cast("string").alias("language"),
        F.col(content).alias("content"),
        parent.cast("string").alias("parent_id"),
        position.cast("int").alias("position"),
        path.alias("path"),
        meta.alias("metadata"),
    )


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with ``ordinal``: (l_orderkey, l_linenumber) is no key, so lines are numbered within their order.

    If there are more lines than Spark's own number of tasks should sort, they are dealt into more.
    """
    line = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, line.count())  # from the files' footers
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        line = line.repartition(tasks, "l_orderkey")
    by_order = Window.partitionBy("l_orderkey").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"
    )
    return line.withColumn("ordinal", F.row_number().over(by_order))


def nodes(spark: SparkSession, sf_dir: str, lines: bool = True) -> DataFrame:
    """Region, nation, customer, order and (with ``lines``) order line as a tree five labels deep; parts as roots."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    customer, orders = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    part = table(spark, sf_dir, "part")
    region_path = _id("r", F.col("r_regionkey"))
    nation_path = F.concat_ws(".", _id("r", F.col("n_regionkey")), _id("n", F.col("n_nationkey")))
    customers = customer.join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    customer_path = F.concat_ws(".", nation_path, _id("c", F.col("c_custkey")))
    ordered = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    order_path = F.concat_ws(".", customer_path, _id("o", F.col("o_orderkey")))
    nothing = F.lit(None).cast("string")

    def meta(key: str, value: str) -> Column:
        return F.concat(F.lit('{"' + key + '":"'), F.col(value), F.lit('"}'))

    out = [
        _node(region, "region", region_path, "r_name", nothing, F.col("r_regionkey"), region_path, F.lit("{}")),
        _node(nation, "nation", _id("n", F.col("n_nationkey")), "n_name", _id("r", F.col("n_regionkey")),
              F.col("n_nationkey"), nation_path, F.lit("{}")),
        _node(customers, "customer", _id("c", F.col("c_custkey")), "c_name", _id("n", F.col("c_nationkey")),
              F.col("c_custkey"), customer_path, meta("segment", "c_mktsegment")),
        _node(ordered, "order", _id("o", F.col("o_orderkey")), "o_orderpriority", _id("c", F.col("o_custkey")),
              F.col("o_orderkey"), order_path, meta("status", "o_orderstatus")),
        _node(part, "part", _id("p", F.col("p_partkey")), "p_name", nothing, F.col("p_partkey"),
              F.concat(F.lit("parts."), _id("p", F.col("p_partkey"))), meta("brand", "p_brand")),
    ]
    if lines:
        line = numbered_lines(spark, sf_dir).join(ordered, F.col("l_orderkey") == F.col("o_orderkey"))
        line_id = F.concat(_id("l", F.col("l_orderkey")), F.lit("_"), F.col("ordinal").cast("string"))
        out.append(_node(line, "line", line_id, "l_returnflag", _id("o", F.col("l_orderkey")), F.col("ordinal"),
                         F.concat_ws(".", order_path, line_id), meta("status", "l_linestatus")))
    union = out[0]
    for more in out[1:]:
        union = union.unionByName(more)
    return union


def document_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and their paragraphs (lines of text that aren't empty)."""
    docs = table(spark, sf_dir, "documents")
    doc_id = _id("d", F.col("doc_id"))
    nothing = F.lit(None).cast("string")
    lines = docs.select("doc_id", "lang", F.posexplode(F.split("text", "\n")).alias("line", "content"))
    lines = lines.filter(F.col("content") != "")
    line_id = F.concat(doc_id, F.lit("_"), F.col("line").cast("string"))
    count = F.size(F.split("text", "\n")).cast("string")
    return docs.select(
        doc_id.alias("id"), F.lit("document").alias("kind"), F.col("lang").alias("language"),
        F.col("source").alias("content"), nothing.alias("parent_id"), F.lit(0).alias("position"), doc_id.alias("path"),
        F.concat(F.lit('{"line_count":'), count, F.lit("}")).alias("metadata"),
    ).unionByName(lines.select(
        line_id.alias("id"), F.lit("paragraph").alias("kind"), F.col("lang").alias("language"), "content",
        doc_id.alias("parent_id"), F.col("line").cast("int").alias("position"),
        F.concat_ws(".", doc_id, line_id).alias("path"), F.lit("{}").alias("metadata"),
    ))


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``contains`` from orders to parts and ``supplied_by`` from parts to suppliers, each once.

    Repeats are dropped by the numbers of both ends, which are shorter than the ids made of them, in as many tasks as
    the lines need.
    """
    line = table(spark, sf_dir, "lineitem")
    tasks = tasks_for(spark, line.count())  # from the files' footers
    more = tasks > int(spark.conf.get("spark.sql.shuffle.partitions"))

    def ends(source: str, source_key: str, target: str, target_key: str, relation: str) -> DataFrame:
        pairs = line.select(source_key, target_key)
        pairs = (pairs.repartition(tasks, source_key, target_key) if more else pairs).distinct()
        return pairs.select(_id(source, F.col(source_key)).alias("source_id"), _id(target, F.col(target_key)).alias("target_id"),
                            F.lit(relation).alias("relation"))

    return ends("o", "l_orderkey", "p", "l_partkey", "contains").unionByName(ends("p", "l_partkey", "s", "l_suppkey", "supplied_by"))


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events; their times carry no zone, and none is applied."""
    return table(spark, sf_dir, "events")


def agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One agent per user of events; the kind goes by the last digit of the user's number."""
    user = _events(spark, sf_dir).select("user_id").distinct()
    kinds = F.array(*[F.lit(k) for k in ("human", "llm", "tool", "swarm")])
    return user.select(
        _id("u", F.col("user_id")).alias("id"), _id("u", F.col("user_id")).alias("name"),
        F.element_at(kinds, (F.col("user_id") % 4 + 1).cast("int")).alias("kind"),
    )


def perspective_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating that an event stands for: agent, node, context, weight in [-1, 1], in the order of time."""
    weight = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("value") / 250 - 1))
    return _events(spark, sf_dir).select(
        _id("u", F.col("user_id")).alias("agent_id"),
        F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("node_id"),
        F.col("event_type").alias("context_id"),
        weight.alias("weight"),
        F.col("ts").alias("updated_at"),
        F.col("event_id").alias("seq"),
    )


def association_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return numbered_lines(spark, sf_dir).select(
        _id("s", F.col("l_suppkey")).alias("agent_id"), _id("o", F.col("l_orderkey")).alias("source_id"),
        _id("p", F.col("l_partkey")).alias("target_id"), F.col("l_returnflag").alias("relation"),
        (1 - 20 * F.col("l_discount")).alias("weight"),
        (F.col("l_orderkey") * 100 + F.col("ordinal")).alias("seq"),
    )


def operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a log of operations: per author a gapless author_seq, and a Lamport time over all."""
    by_author = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("op_type"),
        F.concat(F.lit("p"), F.get_json_object("props", "$.k")).alias("node_id"),
        _id("u", F.col("user_id")).alias("author"), (F.col("event_id") + 1).alias("lamport_ts"),
        F.row_number().over(by_author).cast("long").alias("author_seq"), F.col("props").alias("payload"),
        F.col("value"), F.col("ts").alias("created_at"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as movements from customer to supplier in nano-units of a hundredth; first lines are mints."""
    line = numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    payer = F.when(F.col("l_linenumber") != 1, _id("c", F.col("o_custkey")))
    return line.select(
        payer.alias("from_wallet"), _id("s", F.col("l_suppkey")).alias("to_wallet"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("amount"), F.col("l_returnflag").alias("reason"),
        (F.col("l_orderkey") * 100 + F.col("ordinal")).alias("timestamp"),
    )


def test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir).select(
        F.col("event_id").alias("id"), F.col("event_type").alias("task_id"), _id("u", F.col("user_id")).alias("agent_id"),
        (F.col("value") < 50).alias("passed"), F.round(F.col("value") * 10).cast("int").alias("duration_ms"),
        F.col("ts").alias("created_at"),
    )


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One task per type of event and one that never ran."""
    seen = _events(spark, sf_dir).groupBy("event_type").agg(F.min("ts").alias("created_at"))
    task = seen.select(
        F.col("event_type").alias("id"), F.concat(F.lit("do "), "event_type").alias("description"),
        F.lit("running").alias("status"), F.lit("u1").alias("swarm_id"), "created_at",
    )
    idle = seen.agg(F.min("created_at").alias("created_at")).select(
        F.lit("idle").alias("id"), F.lit("do nothing").alias("description"), F.lit("pending").alias("status"),
        F.lit(None).cast("string").alias("swarm_id"), "created_at",
    )
    return task.unionByName(idle)


def auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A falling-price auction per part, in whole hundredths."""
    start = F.round(F.col("p_retailprice") * 100).cast("long")
    state = F.when(F.col("p_partkey") % 5 == 0, "settled").when(F.col("p_partkey") % 7 == 0, "open_sourced")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.concat(F.lit("parts."), _id("p", F.col("p_partkey"))).alias("scope"),
        _id("s", F.col("p_partkey") % 10).alias("seller_wallet"), start.alias("current_price"),
        F.expr("floor(round(p_retailprice * 100) / 2)").cast("long").alias("floor_price"),
        F.greatest(F.expr("floor(round(p_retailprice * 100) / 20)").cast("long"), F.lit(1).cast("long")).alias("price_decrement"),
        (F.col("p_partkey") % 3 + 1).cast("int").alias("min_bidders"), F.coalesce(state, F.lit("active")).alias("status"),
        F.col("p_size").alias("open_delay_hours"),
    )


def bids(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = numbered_lines(spark, sf_dir).join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return line.select(
        F.col("l_partkey").alias("auction_id"), _id("c", F.col("o_custkey")).alias("bidder_wallet"),
        F.round(F.col("l_extendedprice") / F.col("l_quantity") * 100).cast("long").alias("max_price"),
        (F.col("l_orderkey") * 100 + F.col("ordinal")).alias("seq"),
    )
