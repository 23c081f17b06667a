"""Batches of requests against the registers, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators import ledger, oplog, perspectives, requests
from lattica.plans import model
from lattica.plans.oracle import sql
from lattica.queries import register


def register_sql(name: str, body: str):
    return register(name, sql(body))


def _events(spark: SparkSession, d: str) -> DataFrame:
    return model.table(spark, d, "events").withColumn("seq", F.col("event_id"))


def _text(prefix: str, number) -> Column:
    return F.concat(F.lit(prefix), number.cast("string"))


def _seq() -> Column:
    return F.col("seq")


@register_sql("register_agents", """SELECT event_id AS seq, 'u' || event_id % 1500 AS name, (['llm', 'robot', 'human'])[event_id % 3 + 1] AS kind,
  a.name IS NULL AND event_id % 3 <> 1 AND count(*) FILTER (event_id % 3 <> 1) OVER (PARTITION BY event_id % 1500 ORDER BY event_id) = 1 AS is_new,
  CASE WHEN event_id % 3 = 1 THEN 'kind' END AS refused FROM events LEFT JOIN agents a ON a.name = 'u' || event_id % 1500""")  # fmt: skip
def register_agents(spark: SparkSession, d: str) -> DataFrame:
    kind = F.element_at(F.array(F.lit("llm"), F.lit("robot"), F.lit("human")), (_seq() % 3 + 1).cast("int"))
    asked = _events(spark, d).select("seq", _text("u", _seq() % 1500).alias("name"), kind.alias("kind"))
    return requests.register_agents(asked, model.agents(spark, d))


@register_sql("get_agent", "SELECT * FROM agents WHERE name = 'u3'")
def get_agent(spark: SparkSession, d: str) -> DataFrame:
    return requests.get_agent(model.agents(spark, d), "u3")


@register_sql("remove_agents", """SELECT i AS seq, n.name, a.id AS agent_id, CASE WHEN a.id IS NULL THEN 'unknown'
    WHEN EXISTS (SELECT 1 FROM perspectives p WHERE p.agent_id = a.id AND weight > 0.9) THEN 'perspectives'
    WHEN EXISTS (SELECT 1 FROM associations s WHERE replace(s.agent_id, 's', 'u') = a.id AND weight > 0.9) THEN 'associations' END AS refused
  FROM (SELECT i, 'u' || i AS name FROM range(0, 2000) r(i)) n LEFT JOIN agents a USING (name)""")  # fmt: skip
def remove_agents(spark: SparkSession, d: str) -> DataFrame:
    asked = spark.range(2000).select(F.col("id").alias("seq"), _text("u", F.col("id")).alias("name"))
    rated = perspectives.current_perspectives(model.perspective_log(spark, d)).filter("weight > 0.9")
    related = perspectives.current_associations(model.association_log(spark, d)).filter("weight > 0.9")
    related = related.withColumn("agent_id", F.replace("agent_id", F.lit("s"), F.lit("u")))
    return requests.remove_agents(asked, model.agents(spark, d), rated, related)


def _peers(spark: SparkSession, d: str) -> DataFrame:
    supplier = model.table(spark, d, "supplier")
    asked = supplier.select(
        F.col("s_suppkey").alias("seq"), F.col("s_name").alias("name"), F.lit("local").alias("endpoint"),
        F.when(F.col("s_suppkey") % 7 == 0, "short").otherwise(F.sha2(F.col("s_name"), 256)).alias("public_key_hex"),
    )
    return asked


PEERS = """asked AS (SELECT s_suppkey AS seq, s_name AS name, 'local' AS endpoint,
    CASE WHEN s_suppkey % 7 = 0 THEN 'short' ELSE sha256(s_name) END AS public_key_hex FROM supplier),
  keyed AS (SELECT *, CASE WHEN length(public_key_hex) = 64 THEN to_base64(unhex(sha256(unhex(public_key_hex)))) END AS fingerprint FROM asked)"""


@register_sql("register_peers", f"""WITH {PEERS}
  SELECT k.*, fingerprint IS NOT NULL AND seq % 2 = 0 AS is_new, CASE WHEN fingerprint IS NULL THEN 'key' END AS refused FROM keyed k""")
def register_peers(spark: SparkSession, d: str) -> DataFrame:
    asked = _peers(spark, d)
    none = spark.createDataFrame([], "fingerprint string")
    known = requests.register_peers(asked, none).filter("seq % 2 = 1 AND fingerprint IS NOT NULL").select("fingerprint")
    return requests.register_peers(asked, known)


def _peer_table(spark: SparkSession, d: str) -> DataFrame:
    made = requests.register_peers(_peers(spark, d), spark.createDataFrame([], "fingerprint string")).filter("refused IS NULL")
    return made.withColumn("is_self", F.col("seq") == 1)


@register_sql("list_peers", f"""WITH {PEERS} SELECT name, fingerprint, public_key_hex, endpoint FROM keyed WHERE fingerprint IS NOT NULL AND seq <> 1""")
def list_peers(spark: SparkSession, d: str) -> DataFrame:
    return requests.listed_peers(_peer_table(spark, d))


@register_sql("get_peer", f"""WITH {PEERS} SELECT name, fingerprint, endpoint, public_key_hex, seq = 1 AS is_self FROM keyed
  WHERE fingerprint = (SELECT min(fingerprint) FROM keyed)""")
def get_peer(spark: SparkSession, d: str) -> DataFrame:
    peers = _peer_table(spark, d)
    return requests.get_peer(peers, peers.agg(F.min("fingerprint")).first()[0])


@register_sql("remove_peers", f"""WITH {PEERS} SELECT seq, name, CASE WHEN fingerprint IS NULL THEN 'unknown' WHEN seq = 1 THEN 'self' END AS refused FROM keyed""")
def remove_peers(spark: SparkSession, d: str) -> DataFrame:
    return requests.remove_peers(_peers(spark, d).select("seq", "name"), _peer_table(spark, d))


TASK_REQUESTS = """asked AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'none' ELSE event_type END AS task_id,
    (['running', 'succeeded', 'lost', 'failed'])[event_id % 4 + 1] AS new_status FROM events),
  judged AS (SELECT *, CASE WHEN task_id = 'none' THEN 'unknown' WHEN new_status = 'lost' THEN 'status' END AS refused FROM asked)"""


def _task_requests(spark: SparkSession, d: str) -> DataFrame:
    states = F.array(*[F.lit(s) for s in ("running", "succeeded", "lost", "failed")])
    task = F.when(_seq() % 11 == 0, "none").otherwise(F.col("event_type")).alias("task_id")
    return _events(spark, d).select("seq", task, F.element_at(states, (_seq() % 4 + 1).cast("int")).alias("new_status"))


@register_sql("update_tasks", f"WITH {TASK_REQUESTS} SELECT * FROM judged")
def update_tasks(spark: SparkSession, d: str) -> DataFrame:
    return requests.update_tasks(_task_requests(spark, d), model.tasks(spark, d))


@register_sql("tasks_after", f"""WITH {TASK_REQUESTS},
  last AS (SELECT task_id, arg_max(new_status, seq) AS s FROM judged WHERE refused IS NULL GROUP BY task_id)
  SELECT id, description, coalesce(s, status) AS status, swarm_id, created_at FROM tasks LEFT JOIN last ON id = task_id""")  # fmt: skip
def tasks_after(spark: SparkSession, d: str) -> DataFrame:
    tasks = model.tasks(spark, d)
    return requests.tasks_after(tasks, requests.update_tasks(_task_requests(spark, d), tasks))


@register_sql("stop_swarms", """WITH asked AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'none' WHEN event_id % 7 = 0 THEN 'idle'
    ELSE event_type END AS task_id FROM events),
  judged AS (SELECT a.*, CASE WHEN t.id IS NULL THEN 'unknown' WHEN t.status <> 'running' THEN 'state' END AS why FROM asked a LEFT JOIN tasks t ON t.id = task_id)
  SELECT seq, task_id, coalesce(why, CASE WHEN row_number() OVER (PARTITION BY task_id, why IS NULL ORDER BY seq) > 1 THEN 'state' END) AS refused FROM judged""")
def stop_swarms(spark: SparkSession, d: str) -> DataFrame:
    task = F.when(_seq() % 11 == 0, "none").when(_seq() % 7 == 0, "idle").otherwise(F.col("event_type")).alias("task_id")
    return requests.stop_swarms(_events(spark, d).select("seq", task), model.tasks(spark, d))


RESULTS = """asked AS (SELECT event_id AS seq, CASE WHEN event_id % 11 = 0 THEN 'none' ELSE event_type END AS task_id,
    'u' || event_id % 1500 AS agent, value < 50 AS passed, (event_id % 900)::INTEGER AS duration_ms FROM events),
  judged AS (SELECT a.*, g.id AS agent_id, CASE WHEN g.id IS NULL THEN 'agent' WHEN task_id = 'none' THEN 'task' END AS refused
    FROM asked a LEFT JOIN agents g ON g.name = agent)"""


def _record_results(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    task = F.when(_seq() % 11 == 0, "none").otherwise(F.col("event_type")).alias("task_id")
    asked = _events(spark, d).select(
        "seq", task, _text("u", _seq() % 1500).alias("agent"), (F.col("value") < 50).alias("passed"), (_seq() % 900).cast("int").alias("duration_ms")
    )
    vector = oplog.version_vector(model.operations(spark, d))
    return requests.record_results(asked, model.tasks(spark, d), model.agents(spark, d), vector)


@register_sql("record_results", f"WITH {RESULTS} SELECT *, CASE WHEN refused IS NULL THEN (SELECT min(event_id) FROM events) END AS snapshot FROM judged")
def record_results(spark: SparkSession, d: str) -> DataFrame:
    return _record_results(spark, d)[0]


@register_sql("result_snapshots", """SELECT (SELECT min(event_id) FROM events) AS snapshot, author, max(author_seq) AS max_seq FROM operations GROUP BY author""")
def result_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return _record_results(spark, d)[1]


@register_sql("evaluate_mining", """WITH done AS (SELECT CASE WHEN event_type = 'click' THEN 'create_version' ELSE event_type END AS kind FROM events),
  owed AS (SELECT 'retroactive_parsing' AS work_type, least((SELECT count(*) FROM part), 100) * 1000000000 AS amount
    UNION ALL SELECT 'retroactive_versions', ((SELECT count(*) FROM lineitem) - (SELECT count(*) FROM done WHERE kind = 'create_version')) * 7)
  SELECT work_type, amount::BIGINT AS amount, 'reward:' || work_type AS reason,
    (SELECT max(timestamp) FROM ledger) + row_number() OVER (ORDER BY work_type) AS timestamp FROM owed WHERE amount > 0""")  # fmt: skip
def evaluate_mining(spark: SparkSession, d: str) -> DataFrame:
    done = F.when(F.col("event_type") == "click", "create_version").otherwise(F.col("event_type")).alias("work_type")
    schedule = spark.createDataFrame([("create_version", 7, True), ("parse_file", 3, True)], "work_type string, reward long, enabled boolean")
    return ledger.evaluate_mining(
        model.table(spark, d, "part"), model.table(spark, d, "lineitem"), _events(spark, d).select(done), schedule, model.ledger(spark, d)
    )


@register_sql("get_task", """SELECT t.swarm_id, t.id, t.description, t.status, t.created_at, a.name AS swarm_name FROM tasks t
  LEFT JOIN agents a ON t.swarm_id = a.id WHERE t.id = 'click'""")
def get_task(spark: SparkSession, d: str) -> DataFrame:
    return requests.get_task(model.tasks(spark, d), model.agents(spark, d), "click")


WALLETS = """wallets AS (SELECT 's' || s_suppkey AS id FROM supplier UNION ALL SELECT 'c' || c_custkey FROM customer WHERE c_custkey % 9 <> 0)"""
TRANSFERS = """asked AS (SELECT event_id AS seq, 's' || event_id % 13 AS from_wallet, 'c' || event_id % 100 AS to_wallet,
    (CASE WHEN event_id % 17 = 0 THEN 0 ELSE round(value * 40000) END)::BIGINT AS amount FROM events)"""


def _wallets(spark: SparkSession, d: str) -> DataFrame:
    supplier, customer = model.table(spark, d, "supplier"), model.table(spark, d, "customer")
    own = supplier.select(_text("s", F.col("s_suppkey")).alias("id"))
    return own.unionByName(customer.filter("c_custkey % 9 != 0").select(_text("c", F.col("c_custkey")).alias("id")))


def _transfers(spark: SparkSession, d: str) -> DataFrame:
    amount = F.when(_seq() % 17 == 0, F.lit(0)).otherwise(F.round(F.col("value") * 40000)).cast("long")
    return _events(spark, d).select("seq", _text("s", _seq() % 13).alias("from_wallet"), _text("c", _seq() % 100).alias("to_wallet"), amount.alias("amount"))


#: Each payer's valid requests one after the other; here no payer is paid by the batch.
JUDGED = """checked AS (SELECT a.*, CASE WHEN amount <= 0 THEN 'amount' WHEN from_wallet NOT IN (SELECT id FROM wallets) THEN 'payer'
      WHEN to_wallet NOT IN (SELECT id FROM wallets) THEN 'payee' END AS why FROM asked a),
  valid AS (SELECT seq, from_wallet, amount, row_number() OVER (PARTITION BY from_wallet ORDER BY seq) AS n FROM checked WHERE why IS NULL),
  replay AS (WITH RECURSIVE r AS (
      SELECT 0::BIGINT AS n, f.from_wallet, coalesce(balance, 0)::BIGINT AS held, NULL::BIGINT AS seq, false AS good
      FROM (SELECT DISTINCT from_wallet FROM valid) f LEFT JOIN balances ON wallet = f.from_wallet
      UNION ALL SELECT v.n, v.from_wallet, held - CASE WHEN held >= amount THEN amount ELSE 0 END, v.seq, held >= amount
      FROM r JOIN valid v ON v.from_wallet = r.from_wallet AND v.n = r.n + 1) SELECT seq, good FROM r),
  judged AS (SELECT c.* EXCLUDE (why), coalesce(why, CASE WHEN NOT good THEN 'balance' END) AS refused FROM checked c LEFT JOIN replay USING (seq)),
  stamped AS (SELECT *, CASE WHEN refused IS NULL THEN ((SELECT max(timestamp) FROM ledger)
      + count(*) FILTER (refused IS NULL) OVER (ORDER BY seq))::BIGINT END AS timestamp FROM judged)"""


@register_sql("transfers", f"WITH {WALLETS}, {TRANSFERS}, {JUDGED} SELECT * FROM stamped")
def transfers(spark: SparkSession, d: str) -> DataFrame:
    return requests.transfers(_transfers(spark, d), _wallets(spark, d), model.ledger(spark, d))


@register_sql("inference_costs", """WITH asked AS (SELECT event_id AS seq, 's' || user_id % 10 AS w FROM events),
  placed AS (SELECT *, row_number() OVER (PARTITION BY w ORDER BY seq) AS n FROM asked),
  paid AS (SELECT seq, w FROM placed JOIN balances ON wallet = w WHERE n <= balance // 30000000)
  SELECT seq, w AS from_wallet, 'c1' AS to_wallet, 30000000::BIGINT AS amount, 'model_inference' AS reason,
    ((SELECT max(timestamp) FROM ledger) + row_number() OVER (ORDER BY seq))::BIGINT AS timestamp FROM paid""")  # fmt: skip
def inference_costs(spark: SparkSession, d: str) -> DataFrame:
    """Every event is an inference of its user's agent, whose wallet is a supplier's; one of ten has none in the ledger."""
    book = model.ledger(spark, d)
    asked = _events(spark, d).select("seq", _text("u", F.col("user_id")).alias("agent"), "user_id")
    agents = asked.select(F.col("agent").alias("id"), _text("s", F.col("user_id") % 10).alias("wallet")).distinct()
    wallets = ledger.balances(book).select(F.col("wallet").alias("id")).union(spark.createDataFrame([("c1",)], "id string")).distinct()
    pricing = spark.createDataFrame([("model_inference", 30_000_000), ("storage", 1)], "resource_type string, unit_cost long")
    return requests.inference_costs(asked.select("seq", "agent"), agents, wallets, pricing, book, "c1")


CHAINED = """asked AS (SELECT event_id AS seq, event_id % 9 AS f, event_id * 7 % 11 % 9 AS t, round(value * value * 900)::BIGINT AS amount FROM events),
  numbered AS (SELECT *, row_number() OVER (ORDER BY seq) AS n FROM asked),
  start AS (SELECT list(coalesce(balance, 0)::BIGINT // 300 ORDER BY w) AS held FROM range(9) r(w) LEFT JOIN balances ON wallet = 's' || w),
  replay AS (WITH RECURSIVE r AS (SELECT 0::BIGINT AS n, held, NULL::BIGINT AS seq, false AS good FROM start
      UNION ALL SELECT a.n, CASE WHEN held[f + 1] >= amount AND f <> t AND amount > 0 THEN list_transform(held,
          lambda h, k: h - CASE WHEN k = f + 1 THEN amount ELSE 0 END + CASE WHEN k = t + 1 THEN amount ELSE 0 END) ELSE held END,
        a.seq, held[f + 1] >= amount FROM r JOIN numbered a ON a.n = r.n + 1) SELECT seq, good FROM r)"""


@register_sql("transfers_chained", f"""WITH {CHAINED}, judged AS (SELECT a.seq, 's' || f AS from_wallet, 's' || t AS to_wallet, amount,
    CASE WHEN amount <= 0 THEN 'amount' WHEN NOT good THEN 'balance' END AS refused FROM asked a JOIN replay USING (seq))
  SELECT *, CASE WHEN refused IS NULL THEN (1 + count(*) FILTER (refused IS NULL) OVER (ORDER BY seq))::BIGINT END AS timestamp FROM judged""")  # fmt: skip
def transfers_chained(spark: SparkSession, d: str) -> DataFrame:
    """Wallets that pay each other with what the batch has paid them."""
    ids = spark.range(9).select(_text("s", F.col("id")).alias("id"))
    held = requests.with_balances(ids, model.ledger(spark, d)).select("id", F.floor(F.col("balance") / 300).alias("amount"))
    book = held.select(
        F.lit(None).cast("string").alias("from_wallet"), F.col("id").alias("to_wallet"), "amount", F.lit("mint").alias("reason"),
        F.lit(1).cast("long").alias("timestamp"),
    )
    amount = F.round(F.col("value") * F.col("value") * 900).cast("long").alias("amount")
    to = _text("s", _seq() * 7 % 11 % 9).alias("to_wallet")
    asked = _events(spark, d).select("seq", _text("s", _seq() % 9).alias("from_wallet"), to, amount)
    return requests.transfers(asked, ids, book)


SIGNED = """asked AS (SELECT event_id AS seq, 's' || event_id % 13 AS from_wallet, 'c' || event_id % 100 AS to_wallet,
    (CASE WHEN event_id % 17 = 0 THEN 0 ELSE round(value * 400) END)::BIGINT AS amount,
    event_id // 13 + CASE WHEN event_id % 13 = 3 AND event_id > 300 THEN 9 ELSE 3 END AS nonce FROM events),
  numbered AS (SELECT *, row_number() OVER (PARTITION BY from_wallet ORDER BY seq) AS n,
      from_wallet IN (SELECT id FROM wallets) AS payer, to_wallet IN (SELECT id FROM wallets) AS payee FROM asked),
  replay AS (WITH RECURSIVE r AS (
      SELECT 0::BIGINT AS n, f.from_wallet, coalesce(balance, 0)::BIGINT AS held, 2::BIGINT AS last, NULL::BIGINT AS seq, NULL::VARCHAR AS refused
      FROM (SELECT DISTINCT from_wallet FROM numbered) f LEFT JOIN balances ON wallet = f.from_wallet
      UNION ALL SELECT n, from_wallet, held - CASE WHEN why IS NULL THEN amount ELSE 0 END, last + CASE WHEN why IS NULL THEN 1 ELSE 0 END, seq, why
      FROM (SELECT v.*, held, last, CASE WHEN amount <= 0 THEN 'amount' WHEN NOT payer THEN 'payer' WHEN nonce <> last + 1 THEN 'nonce'
          WHEN NOT payee THEN 'payee' WHEN held < amount THEN 'balance' END AS why
        FROM r JOIN numbered v ON v.from_wallet = r.from_wallet AND v.n = r.n + 1)) SELECT seq, refused FROM r)"""


@register_sql("signed_transfers", f"""WITH {WALLETS}, {SIGNED}
  SELECT a.*, refused, CASE WHEN refused IS NULL THEN ((SELECT max(timestamp) FROM ledger)
      + count(*) FILTER (refused IS NULL) OVER (ORDER BY seq))::BIGINT END AS timestamp FROM asked a JOIN replay USING (seq)""")  # fmt: skip
def signed_transfers(spark: SparkSession, d: str) -> DataFrame:
    nonce = F.floor(_seq() / 13) + F.when((_seq() % 13 == 3) & (_seq() > 300), 9).otherwise(3)
    amount = F.when(_seq() % 17 == 0, F.lit(0)).otherwise(F.round(F.col("value") * 400)).cast("long").alias("amount")
    asked = _events(spark, d).select(
        "seq", _text("s", _seq() % 13).alias("from_wallet"), _text("c", _seq() % 100).alias("to_wallet"), amount, nonce.cast("long").alias("nonce")
    )
    known = spark.range(13).select(_text("s", F.col("id")).alias("wallet"), F.lit(2).cast("long").alias("nonce"))
    return requests.signed_transfers(asked, _wallets(spark, d), model.ledger(spark, d), known)


@register_sql("create_wallets", """SELECT event_id AS seq, (['human', 'agent', 'instance'])[event_id % 3 + 1] AS wallet_type, event_type AS label,
  CASE WHEN event_id % 3 = 2 THEN 'type' END AS refused FROM events""")
def create_wallets(spark: SparkSession, d: str) -> DataFrame:
    kinds = F.array(F.lit("human"), F.lit("agent"), F.lit("instance"))
    asked = _events(spark, d).select("seq", F.element_at(kinds, (_seq() % 3 + 1).cast("int")).alias("wallet_type"), F.col("event_type").alias("label"))
    return requests.create_wallets(asked)


@register_sql("list_wallets", f"WITH {WALLETS} SELECT id, coalesce(balance, 0) AS balance FROM wallets LEFT JOIN balances ON id = wallet")
def list_wallets(spark: SparkSession, d: str) -> DataFrame:
    return requests.with_balances(_wallets(spark, d), model.ledger(spark, d))


@register_sql("set_rewards", """WITH asked AS (SELECT event_id AS seq, event_type AS work_type, event_id % 50 - 5 AS reward,
    CASE WHEN event_id % 3 = 0 THEN event_id % 2 = 0 END AS enabled FROM events WHERE event_id % 50 > 5),
  last AS (SELECT work_type, arg_max(reward, seq) AS r, arg_max(enabled, seq) FILTER (enabled IS NOT NULL) AS e FROM asked GROUP BY 1),
  schedule AS (SELECT * FROM (VALUES ('parse', 7::BIGINT, false), ('click', 5::BIGINT, true)) s(work_type, reward, enabled))
  SELECT work_type, coalesce(r, reward) AS reward, coalesce(e, enabled, true) AS enabled FROM schedule FULL JOIN last USING (work_type)""")  # fmt: skip
def set_rewards(spark: SparkSession, d: str) -> DataFrame:
    enabled = F.when(_seq() % 3 == 0, _seq() % 2 == 0)
    asked = _events(spark, d).select("seq", F.col("event_type").alias("work_type"), (_seq() % 50 - 5).alias("reward"), enabled.alias("enabled"))
    schedule = spark.createDataFrame([("parse", 7, False), ("click", 5, True)], "work_type string, reward long, enabled boolean")
    return requests.set_rewards(asked, schedule)


@register_sql("create_auctions", """WITH asked AS (SELECT event_id AS seq, event_id % 300 AS attestation_id, event_id % 90 AS starting_price,
    event_id % 40 AS floor_price, event_id % 6 AS price_decrement, event_id % 9 AS interval_secs FROM events),
  checked AS (SELECT *, CASE WHEN starting_price <= 0 OR floor_price >= starting_price THEN 'prices' WHEN price_decrement <= 0 THEN 'decrement'
      WHEN interval_secs <= 0 THEN 'interval' WHEN attestation_id NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 2 = 0) THEN 'attestation'
      WHEN attestation_id IN (SELECT id FROM auctions WHERE status = 'active' AND id % 10 < 4) THEN 'active' END AS why FROM asked)
  SELECT * EXCLUDE (why), coalesce(why, CASE WHEN seq > min(seq) FILTER (why IS NULL) OVER (PARTITION BY attestation_id) THEN 'active' END) AS refused
  FROM checked""")  # fmt: skip
def create_auctions(spark: SparkSession, d: str) -> DataFrame:
    columns = {"attestation_id": 300, "starting_price": 90, "floor_price": 40, "price_decrement": 6, "interval_secs": 9}
    asked = _events(spark, d).select("seq", *[(_seq() % n).alias(c) for c, n in columns.items()])
    owned = model.table(spark, d, "part").filter("p_partkey % 2 = 0").select(F.col("p_partkey").alias("attestation_id"))
    auctions = model.auctions(spark, d).filter("id % 10 < 4").withColumnRenamed("id", "attestation_id")
    return requests.create_auctions(asked, owned, auctions)


@register_sql("place_bids", """SELECT event_id AS seq, event_id % 3000 AS auction_id, 'u' || user_id AS bidder_wallet, event_id % 70 AS max_price,
  CASE WHEN event_id % 70 <= 0 THEN 'price' WHEN a.id IS NULL THEN 'unknown' WHEN a.status <> 'active' THEN 'state' END AS refused
  FROM events LEFT JOIN auctions a ON a.id = event_id % 3000""")  # fmt: skip
def place_bids(spark: SparkSession, d: str) -> DataFrame:
    asked = _events(spark, d).select(
        "seq", (_seq() % 3000).alias("auction_id"), _text("u", F.col("user_id")).alias("bidder_wallet"), (_seq() % 70).alias("max_price")
    )
    return requests.place_bids(asked, model.auctions(spark, d))


@register_sql("open_source_auctions", """SELECT event_id AS seq, event_id % 3000 AS auction_id,
  CASE WHEN a.id IS NULL THEN 'unknown' WHEN a.status = 'active' THEN 'state' END AS refused
  FROM events LEFT JOIN auctions a ON a.id = event_id % 3000""")
def open_source_auctions(spark: SparkSession, d: str) -> DataFrame:
    return requests.open_sources(_events(spark, d).select("seq", (_seq() % 3000).alias("auction_id")), model.auctions(spark, d))


@register_sql("create_bounties", """SELECT event_id AS seq, 's' || event_id % 200 AS poster_wallet, 'parts' AS scope, event_id * 100000 - 500000 AS reward,
  CASE WHEN event_id * 100000 - 500000 <= 0 THEN 'reward' WHEN coalesce(balance, 0) < event_id * 100000 - 500000 THEN 'balance' END AS refused
  FROM events LEFT JOIN balances ON wallet = 's' || event_id % 200""")  # fmt: skip
def create_bounties(spark: SparkSession, d: str) -> DataFrame:
    asked = _events(spark, d).select(
        "seq", _text("s", _seq() % 200).alias("poster_wallet"), F.lit("parts").alias("scope"), (_seq() * 100000 - 500000).alias("reward")
    )
    return requests.create_bounties(asked, model.ledger(spark, d))


BOUNTIES = """bounties AS (SELECT p_partkey AS id, (['open', 'claimed', 'paid'])[p_partkey % 3 + 1] AS status, 's' || p_partkey % 8 AS poster_wallet,
    'c' || (p_partkey % 50 + 1) AS claimed_by, p_size * 500000 AS reward FROM part)"""


def _bounties(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("p_partkey")
    states = F.array(F.lit("open"), F.lit("claimed"), F.lit("paid"))
    return model.table(spark, d, "part").select(
        key.alias("id"), F.element_at(states, (key % 3 + 1).cast("int")).alias("status"), _text("s", key % 8).alias("poster_wallet"),
        _text("c", key % 50 + 1).alias("claimed_by"), (F.col("p_size") * 500000).cast("long").alias("reward"),
    )


@register_sql("get_bounty", f"WITH {BOUNTIES} SELECT * FROM bounties WHERE id = 11")
def get_bounty(spark: SparkSession, d: str) -> DataFrame:
    return _bounties(spark, d).filter("id = 11")


@register_sql("claim_bounties", f"""WITH {BOUNTIES}, asked AS (SELECT event_id AS seq, event_id % 3000 AS bounty_id, 'u' || user_id AS claimer_wallet FROM events),
  checked AS (SELECT a.*, CASE WHEN b.id IS NULL THEN 'unknown' WHEN status <> 'open' THEN 'state' END AS why FROM asked a LEFT JOIN bounties b ON bounty_id = b.id)
  SELECT * EXCLUDE (why), coalesce(why, CASE WHEN seq > min(seq) FILTER (why IS NULL) OVER (PARTITION BY bounty_id) THEN 'state' END) AS refused FROM checked""")
def claim_bounties(spark: SparkSession, d: str) -> DataFrame:
    asked = _events(spark, d).select("seq", (_seq() % 3000).alias("bounty_id"), _text("u", F.col("user_id")).alias("claimer_wallet"))
    return requests.claim_bounties(asked, _bounties(spark, d))


@register_sql("settle_bounties", f"""WITH {WALLETS}, {BOUNTIES}, wanted AS (SELECT event_id AS seq, event_id % 3000 AS bounty_id FROM events),
  first AS (SELECT w.*, poster_wallet AS from_wallet, claimed_by AS to_wallet, reward AS amount,
      CASE WHEN b.id IS NULL THEN 'unknown' WHEN status <> 'claimed' THEN 'state' END AS no FROM wanted w LEFT JOIN bounties b ON bounty_id = b.id),
  known AS (SELECT * REPLACE (coalesce(no, CASE WHEN seq > min(seq) FILTER (no IS NULL) OVER (PARTITION BY bounty_id) THEN 'state' END) AS no) FROM first),
  asked AS (SELECT * EXCLUDE (no) FROM known WHERE no IS NULL), {JUDGED}
  SELECT * FROM stamped UNION ALL BY NAME SELECT * EXCLUDE (no), no AS refused, NULL::BIGINT AS timestamp FROM known WHERE no IS NOT NULL""")  # fmt: skip
def settle_bounties(spark: SparkSession, d: str) -> DataFrame:
    asked = _events(spark, d).select("seq", (_seq() % 3000).alias("bounty_id"))
    return requests.settle_bounties(asked, _bounties(spark, d), _wallets(spark, d), model.ledger(spark, d))
