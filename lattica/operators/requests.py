"""Requests to the registers of agents, tasks, wallets, auctions and bounties, judged all at once.

A batch of requests is a table with ``seq``, their order. Each function returns the requests with ``refused``: null if
the request is accepted, else why not. What is accepted is appended by the caller, to logs that
:mod:`lattica.operators.latest` and the folds read. Checks against the state before the batch are joins; a request that
depends on earlier ones of the batch is judged by groupings, by running sums or by a fixpoint of these, never one after the other.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from lattica.operators import ledger
from lattica.operators.latest import first_wins, is_new
from lattica.operators.ledger import WALLET_TYPES
from lattica.operators.running import running_sum, running_sums
from lattica.operators.swarm import STATES
from lattica.tables import scratch_path, written

# The kinds of agents.
AGENT_KINDS = ("human", "llm", "tool", "swarm")


def refused(*checks: tuple[str, Column]) -> Column:
    """The first reason whose condition holds; an unknown condition holds too."""
    out = F.lit(None).cast("string")
    for reason, fails in reversed(checks):
        out = F.when(F.coalesce(fails, F.lit(True)), reason).otherwise(out)
    return out


def _known(rows: DataFrame, key: str, table: DataFrame, table_key: str, name: str) -> DataFrame:
    """``rows`` with ``name``: whether ``table`` has their key."""
    held = table.select(F.col(table_key).alias(key)).distinct().withColumn(name, F.lit(True))
    return rows.join(held, key, "left").withColumn(name, F.coalesce(name, F.lit(False)))


# Agents and peers


def register_agents(requests: DataFrame, agents: DataFrame) -> DataFrame:
    """Requests (seq, name, kind, ...) with refused and is_new: whether no agent had the name, nor an accepted request before."""
    rows = requests.withColumn("refused", refused(("kind", ~F.col("kind").isin(*AGENT_KINDS))))
    return is_new(rows, agents, ["name"], "seq")


def get_agent(agents: DataFrame, name: str) -> DataFrame:
    """The agent of a name; no row if there is none."""
    return agents.filter(F.col("name") == name)


def remove_agents(requests: DataFrame, agents: DataFrame, perspectives: DataFrame, associations: DataFrame) -> DataFrame:
    """Requests (seq, name): an agent that holds perspectives or associations stays."""
    named = requests.join(agents.select("name", F.col("id").alias("agent_id")), "name", "left")
    named = _known(named, "agent_id", perspectives, "agent_id", "rates")
    named = _known(named, "agent_id", associations, "agent_id", "relates")
    reason = refused(("unknown", F.col("agent_id").isNull()), ("perspectives", F.col("rates")), ("associations", F.col("relates")))
    return named.withColumn("refused", reason).drop("rates", "relates")


def register_peers(requests: DataFrame, peers: DataFrame) -> DataFrame:
    """Requests (seq, name, public_key_hex, endpoint) with fingerprint (base64 of the SHA-256 of the key) and is_new."""
    key = F.col("public_key_hex")
    good = F.rlike(key, F.lit("^[0-9A-Fa-f]{64}$"))
    made = F.when(good, F.base64(F.unhex(F.sha2(F.unhex(key), 256))))
    rows = requests.withColumn("fingerprint", made).withColumn("refused", refused(("key", ~good)))
    return is_new(rows, peers, ["fingerprint"], "seq")


def listed_peers(peers: DataFrame) -> DataFrame:
    return peers.filter("NOT is_self").select("name", "fingerprint", F.lower("public_key_hex").alias("public_key_hex"), "endpoint").orderBy("name", "fingerprint")


def get_peer(peers: DataFrame, fingerprint: str) -> DataFrame:
    """The peer, or the instance itself, of a fingerprint; no row if there is none."""
    found = peers.filter(F.col("fingerprint") == fingerprint)
    return found.select("name", "fingerprint", "endpoint", F.lower("public_key_hex").alias("public_key_hex"), "is_self")


def remove_peers(requests: DataFrame, peers: DataFrame) -> DataFrame:
    """Requests (seq, name): an instance doesn't remove itself."""
    named = requests.join(peers.select("name", "is_self").distinct(), "name", "left")
    return named.withColumn("refused", refused(("unknown", F.col("is_self").isNull()), ("self", F.col("is_self")))).drop("is_self")


# Tasks


def update_tasks(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests (seq, task_id, new_status): any known state may follow any other."""
    known = _known(requests, "task_id", tasks, "id", "known")
    reason = refused(("unknown", ~F.col("known")), ("status", ~F.col("new_status").isin(*STATES)))
    return known.withColumn("refused", reason).drop("known")


def tasks_after(tasks: DataFrame, judged: DataFrame) -> DataFrame:
    """``tasks`` with the states that the accepted of ``judged`` leave."""
    last = judged.filter("refused IS NULL").groupBy(F.col("task_id").alias("id")).agg(F.max_by("new_status", "seq").alias("new_status"))
    joined = tasks.join(last, "id", "left")
    return joined.withColumn("status", F.coalesce("new_status", "status")).drop("new_status")


def stop_swarms(requests: DataFrame, tasks: DataFrame) -> DataFrame:
    """Requests (seq, task_id): a running task is stopped once; the first request of a batch does it."""
    rows = requests.join(tasks.select(F.col("id").alias("task_id"), "status"), "task_id", "left")
    rows = rows.withColumn("refused", refused(("unknown", F.col("status").isNull()), ("state", F.col("status") != "running")))
    first = rows.filter("refused IS NULL").groupBy("task_id").agg(F.min("seq").alias("first"))
    later = F.when(F.col("refused").isNull() & (F.col("seq") > F.col("first")), "state")
    return rows.join(first, "task_id", "left").withColumn("refused", F.coalesce("refused", later)).drop("first", "status")


def record_results(requests: DataFrame, tasks: DataFrame, agents: DataFrame, vector: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results (seq, task_id, agent, passed, output, duration_ms, ops_count) of named agents, and the version vector they saw.

    The accepted have the agent's id and ``snapshot``, a number that the rows (snapshot, author, max_seq) of the second
    table share: one copy of the vector serves a whole batch, however many authors it has.
    """
    named = requests.join(agents.select(F.col("name").alias("agent"), F.col("id").alias("agent_id")), "agent", "left")
    known = _known(named, "task_id", tasks, "id", "known")
    rows = known.withColumn("refused", refused(("agent", F.col("agent_id").isNull()), ("task", ~F.col("known")))).drop("known")
    snapshot = requests.agg(F.min("seq").alias("snapshot"))
    seen = vector.select("author", "max_seq").join(F.broadcast(snapshot)).select("snapshot", "author", "max_seq")  # one row
    rows = rows.join(F.broadcast(snapshot))
    return rows.withColumn("snapshot", F.when(F.col("refused").isNull(), F.col("snapshot"))), seen


def get_task(tasks: DataFrame, agents: DataFrame, task_id: str) -> DataFrame:
    """A task with the name of its swarm."""
    names = agents.select(F.col("id").alias("swarm_id"), F.col("name").alias("swarm_name"))
    return tasks.filter(F.col("id") == task_id).join(names, "swarm_id", "left")


# Wallets


def create_wallets(requests: DataFrame) -> DataFrame:
    """Requests (seq, wallet_type, label)."""
    return requests.withColumn("refused", refused(("type", ~F.col("wallet_type").isin(*WALLET_TYPES))))


def with_balances(wallets: DataFrame, book: DataFrame) -> DataFrame:
    """``wallets`` (id, ...) with their balances in the ledger ``book``."""
    found = ledger.balances(book).select(F.col("wallet").alias("id"), "balance")
    return wallets.join(found, "id", "left").withColumn("balance", F.coalesce("balance", F.lit(0)).cast("long"))


def _changes(rows: DataFrame) -> DataFrame:
    """One row per side of each transfer (seq, from_wallet, to_wallet, amount, sure): what it does to its wallet's balance.

    ``low`` and ``high`` bound the change, ``net`` is that of accepted transfers, ``taken`` and ``open`` count the
    payer's accepted and undecided ones. A transfer to the payer itself changes nothing.
    """
    amount = F.when(F.col("from_wallet") == F.col("to_wallet"), F.lit(0)).otherwise(F.col("amount")).cast("decimal(38,0)")
    sure, nothing = F.col("sure"), F.lit(0).cast("decimal(38,0)")
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    out = F.struct(
        F.col("from_wallet").alias("wallet"), F.lit(True).alias("pays"), (-amount).alias("low"),
        F.when(sure, -amount).otherwise(nothing).alias("high"), F.when(sure, -amount).otherwise(nothing).alias("net"),
        F.when(sure, one).otherwise(none).alias("taken"), F.when(sure, none).otherwise(one).alias("open"),
    )
    into = F.struct(
        F.col("to_wallet").alias("wallet"), F.lit(False).alias("pays"), F.when(sure, amount).otherwise(nothing).alias("low"),
        amount.alias("high"), F.when(sure, amount).otherwise(nothing).alias("net"), none.alias("taken"), none.alias("open"),
    )
    return rows.select(*rows.columns, F.explode(F.array(out, into)).alias("side")).select(*rows.columns, "side.*")


#: Undecided transfers that the driver holds at a time when it judges them one by one, and wallets whose changes it keeps.
REPLAYED = 20_000
HELD_WALLETS = 200_000
#: Accepted transfers that the driver writes at a time.
ACCEPTED_PART = 500_000


def _replayed(rows: Iterable[Row], nonces: bool, change: Counter) -> Iterator[tuple[Any, bool]]:
    """(seq, accepted) of undecided transfers (seq, ..., held, last) in their order, none undecided before them.

    ``held`` and ``last`` are the payer's balance and nonce by all that was accepted before; ``change`` is kept up with
    what these transfers move.
    """
    taken: Counter = Counter()
    for row in rows:
        payer, amount = row["from_wallet"], row["amount"]
        good = row["held"] + change.get(payer, 0) >= amount
        if good and (not nonces or row["nonce"] == row["last"] + taken.get(payer, 0) + 1):
            change[payer] -= amount
            change[row["to_wallet"]] += amount
            taken[payer] += 1
            yield row["seq"], True
        else:
            yield row["seq"], False


def _replay(rows: DataFrame, size: int, nonces: bool) -> tuple[DataFrame, Any]:
    """The seq of the accepted of ``size`` undecided transfers, judged in their order, and the last seq judged.

    Spark sorts them into ranges of about REPLAYED; one range after the other comes to the driver and what it accepts is
    written in parts, so the driver holds a range, a part, and the changes of HELD_WALLETS wallets. If there are more
    wallets it stops there, else the last seq is null.
    """
    spark, kind = rows.sparkSession, rows.schema["seq"].dataType
    path = scratch_path(spark, "transfers-replayed")

    def write(part: list) -> None:
        # a whole number is a whole number in Arrow, too; other kinds are made by Spark
        table = spark.createDataFrame(pa.table({"seq": part})) if part and isinstance(kind, LongType) else spark.createDataFrame(
            [(v,) for v in part], StructType([StructField("seq", kind)])
        )
        table.coalesce(1).write.mode("append").parquet(path)

    ranged = rows.repartitionByRange(max(1, -(-size // REPLAYED)), "seq").sortWithinPartitions("seq")
    change: Counter = Counter()
    accepted, end = [], None
    for seq, good in _replayed(ranged.toLocalIterator(prefetchPartitions=True), nonces, change):
        if good:
            accepted.append(seq)
            if len(accepted) == ACCEPTED_PART:
                write(accepted)
                accepted = []
            if len(change) > HELD_WALLETS:
                end = seq
                break
    write(accepted)
    return spark.read.schema(StructType([StructField("seq", kind)])).parquet(path), end


def _accepted(rows: DataFrame, balances: DataFrame, nonces: DataFrame | None = None) -> DataFrame:
    """The seq of the transfers (seq, from_wallet, to_wallet, amount, nonce) that judging one after the other accepts.

    A fixpoint over sets of transfers: accepted is what the payer's least possible balance covers, were all its
    undecided earlier transfers accepted and none of those to it; refused is what its greatest possible balance doesn't
    cover. With ``nonces`` (from_wallet, last) a transfer's nonce must follow the payer's accepted ones, too: it is
    accepted with all undecided ones before it that follow on in the same way. Each round goes on with the wallets that
    have undecided ones. Rounds go on while they decide half of what they are asked, so there are as many as the logarithm
    of the requests; what is left then hangs on each other and is judged one by one, see :func:`_replay`.
    """
    spark = rows.sparkSession
    columns = ["seq", "from_wallet", "to_wallet", "amount", "nonce"]
    left = rows.select(*columns, F.lit(False).alias("sure"))
    done: list[DataFrame] = []
    while True:
        sums = {"least": "low", "most": "high", "before": "taken", "waiting": "open", "change": "net"}
        summed = running_sums(_changes(left), ["wallet"], "seq", sums)
        asked = summed.filter("pays AND NOT sure").join(balances.withColumnRenamed("wallet", "from_wallet"), "from_wallet", "left")
        # an undecided transfer's own amount isn't in its least balance before it
        own = F.when(F.col("from_wallet") == F.col("to_wallet"), F.lit(0)).otherwise(F.col("amount"))
        held = F.coalesce("balance", F.lit(0))
        covered = held + F.col("least") + own >= F.col("amount")
        never = held + F.col("most") < F.col("amount")
        last = F.lit(0).cast("long")
        if nonces is not None:
            asked = asked.join(nonces, "from_wallet", "left")
            last = F.coalesce("last", F.lit(0)) + F.col("before")
            follows = F.col("nonce") == last + F.col("waiting")  # after all undecided ones, itself among the waiting
            never = never | ~F.coalesce(F.col("nonce").between(last + 1, last + F.col("waiting")), F.lit(False))
            asked = asked.withColumn("breaks", F.when(covered & follows, 0).otherwise(1).cast("long"))
        judged = asked.withColumns({"covered": covered, "never": never, "held": held + F.col("change"), "last": last})
        if nonces is not None:
            judged = judged.select(*columns, "covered", "never", "held", "last", "breaks")
            judged = running_sum(judged, ["from_wallet"], "seq", "breaks", "broken").withColumn("covered", F.col("broken") == 0)
        judged = written(judged.select(*columns, "covered", "never", "held", "last"), "transfers-judged")
        sure = left.filter("sure").unionByName(judged.filter("covered").select(*columns, F.lit(True).alias("sure")))
        undecided = judged.filter("NOT covered AND NOT never")
        asked_for, accepted, waiting = judged.agg(
            F.count("*"), F.count_if("covered"), F.count_if(~F.col("covered") & ~F.col("never"))
        ).first()
        if waiting and REPLAYED and (accepted + waiting <= REPLAYED or 2 * waiting > asked_for):
            # what these hold counts what was sure before the round; what this round accepted is replayed with them
            good, end = _replay(judged.filter("covered OR NOT never"), accepted + waiting, nonces is not None)
            replayed = undecided.join(good, "seq", "left_semi").select(*columns, F.lit(True).alias("sure"))
            sure = sure.unionByName(replayed)
            undecided = undecided.limit(0) if end is None else undecided.filter(F.col("seq") > F.lit(end))
        undecided = undecided.select(*columns, F.lit(False).alias("sure"))
        if not undecided.limit(1).count():
            done.append(sure.select("seq"))
            break
        # accepted transfers still count where a wallet has undecided ones
        wallets = undecided.select(F.col("from_wallet").alias("wallet")).distinct().withColumn("waits", F.lit(True))
        for side in ("from", "to"):
            waits = wallets.select(F.col("wallet").alias(f"{side}_wallet"), F.col("waits").alias(f"{side}_waits"))
            sure = sure.join(waits, f"{side}_wallet", "left")
        sure = written(sure, "transfers-sure")
        waits = F.coalesce("from_waits", "to_waits", F.lit(False))
        done.append(sure.filter(~waits).select("seq"))
        left = sure.filter(waits).select(*columns, "sure").unionByName(undecided)
    return written(reduce(DataFrame.unionByName, done), "transfers-accepted")


def _book_state(book: DataFrame) -> tuple[DataFrame, int]:
    """The balances (wallet, balance) of a ledger and its last timestamp, 0 if it is empty; the ledger is read once."""
    amount = F.col("amount").cast("decimal(38,0)")
    sides = F.array(
        F.struct(F.col("to_wallet").alias("wallet"), amount.alias("change")), F.struct(F.col("from_wallet").alias("wallet"), (-amount).alias("change"))
    )
    per_wallet = book.select(F.explode(sides).alias("side"), "timestamp").select("side.*", "timestamp").groupBy("wallet").agg(
        F.sum("change").cast("long").alias("balance"), F.max("timestamp").alias("latest")
    )
    per_wallet = written(per_wallet, "ledger-state")
    now = per_wallet.agg(F.coalesce(F.max("latest"), F.lit(0)).cast("long")).first()[0]
    return per_wallet.filter("wallet IS NOT NULL").select("wallet", "balance"), now


def _judged_transfers(requests: DataFrame, wallets: DataFrame, book: DataFrame, nonces: DataFrame | None = None) -> DataFrame:
    rows = _known(requests, "from_wallet", wallets, "id", "payer")
    rows = _known(rows, "to_wallet", wallets, "id", "payee")
    reason = refused(("amount", F.col("amount") <= 0), ("payer", ~F.col("payer")))
    rows = written(rows.withColumn("refused", reason), "transfers-asked")
    known, now = _book_state(book)
    balances = known.select("wallet", "balance")
    good = rows.filter("refused IS NULL AND payee")
    last = None
    if nonces is None:
        good = good.withColumn("nonce", F.lit(None).cast("long"))
    else:
        last = nonces.select(F.col("wallet").alias("from_wallet"), F.col("nonce").alias("last"))
    accepted = _accepted(good, balances, last).withColumn("accepted", F.lit(1).cast("long"))
    rows = rows.join(accepted, "seq", "left").withColumn("accepted", F.coalesce("accepted", F.lit(0)))
    why = F.when(~F.col("payee"), "payee").otherwise("balance")
    if last is not None:
        rows = running_sum(rows, ["from_wallet"], "seq", "accepted", "taken").join(last, "from_wallet", "left")
        wrong = F.coalesce(F.col("nonce") != F.coalesce("last", F.lit(0)) + F.col("taken") + 1, F.lit(True))
        why = F.when(wrong, "nonce").otherwise(why)
    rows = rows.withColumn("refused", F.coalesce("refused", F.when(F.col("accepted") == 0, why)))
    rows = running_sum(rows, [], "seq", "accepted", "place")
    rows = rows.withColumn("timestamp", F.when(F.col("refused").isNull(), F.col("place") + now))
    return rows.select(*requests.columns, "refused", "timestamp")


def transfers(requests: DataFrame, wallets: DataFrame, book: DataFrame) -> DataFrame:
    """Requests (seq, from_wallet, to_wallet, amount) with refused, and the timestamp of the accepted.

    Judged as if one after the other in the order of ``seq``, which must tell them apart: a request is accepted if the
    payer's balance then covers it, with all that the batch has paid in and out before. Timestamps go on from the
    ledger's last.
    """
    return _judged_transfers(requests, wallets, book)


def signed_transfers(requests: DataFrame, wallets: DataFrame, book: DataFrame, nonces: DataFrame) -> DataFrame:
    """:func:`transfers` of requests with a nonce: each must be one above the payer's last accepted, from ``nonces`` (wallet, nonce) on.

    Signatures are checked by who holds the keys.
    """
    return _judged_transfers(requests, wallets, book, nonces)


def inference_costs(requests: DataFrame, agents: DataFrame, wallets: DataFrame, pricing: DataFrame, book: DataFrame, instance: str) -> DataFrame:
    """The ledger rows (seq, from_wallet, to_wallet, amount, reason, timestamp) of inferences (seq, agent) that are paid for.

    ``pricing`` (resource_type, unit_cost) names the price, the least if there are several; without one nothing is
    paid. An inference is paid to the wallet ``instance`` if the agent's wallet then covers it, see :func:`transfers`; what
    isn't covered, or has no wallet, is inferred all the same and leaves no row.
    """
    price = pricing.filter(F.col("resource_type") == ledger.INFERENCE).agg(F.min("unit_cost").cast("long").alias("amount"))
    owners = agents.filter("wallet IS NOT NULL").select(F.col("id").alias("agent"), F.col("wallet").alias("from_wallet"))
    asked = requests.join(owners, "agent").join(F.broadcast(price.filter("amount IS NOT NULL")))  # one row
    asked = asked.select("seq", "from_wallet", F.lit(instance).alias("to_wallet"), "amount")
    paid = transfers(asked, wallets, book).filter("refused IS NULL")
    return paid.select("seq", "from_wallet", "to_wallet", "amount", F.lit(ledger.INFERENCE).alias("reason"), "timestamp")


def set_rewards(requests: DataFrame, schedule: DataFrame) -> DataFrame:
    """The schedule (work_type, reward, enabled) after requests (seq, work_type, reward, enabled) with a positive reward.

    A null ``enabled`` leaves what was, true for new types.
    """
    last = requests.filter("reward > 0").groupBy("work_type").agg(
        F.max_by("reward", "seq").alias("new_reward"),
        F.max_by("enabled", F.when(F.col("enabled").isNotNull(), F.col("seq"))).alias("new_enabled"),
    )
    both = schedule.join(last, "work_type", "full_outer")
    enabled = F.coalesce("new_enabled", "enabled", F.lit(True)).alias("enabled")
    return both.select("work_type", F.coalesce("new_reward", "reward").alias("reward"), enabled).orderBy("work_type")


# Auctions


def create_auctions(requests: DataFrame, owned: DataFrame, auctions: DataFrame) -> DataFrame:
    """Requests (seq, attestation_id, starting_price, floor_price, price_decrement, interval_secs).

    ``owned`` (attestation_id) are the seller's. An attestation has one active auction: of a batch's valid requests
    for one the first is accepted.
    """
    rows = _known(requests, "attestation_id", owned, "attestation_id", "mine")
    rows = _known(rows, "attestation_id", auctions.filter("status = 'active'"), "attestation_id", "running")
    reason = refused(
        ("prices", (F.col("starting_price") <= 0) | (F.col("floor_price") < 0) | (F.col("floor_price") >= F.col("starting_price"))),
        ("decrement", F.col("price_decrement") <= 0), ("interval", F.col("interval_secs") <= 0),
        ("attestation", ~F.col("mine")), ("active", F.col("running")),
    )
    rows = rows.withColumn("refused", reason).drop("mine", "running")
    first = rows.filter("refused IS NULL").groupBy("attestation_id").agg(F.min("seq").alias("first"))
    rows = rows.join(first, "attestation_id", "left")
    later = F.when(F.col("refused").isNull() & (F.col("seq") > F.col("first")), "active")
    return rows.withColumn("refused", F.coalesce("refused", later)).drop("first")


def place_bids(requests: DataFrame, auctions: DataFrame) -> DataFrame:
    """Requests (seq, auction_id, bidder_wallet, max_price): only active auctions take bids."""
    states = auctions.select(F.col("id").alias("auction_id"), F.col("status").alias("state"))
    rows = requests.join(states, "auction_id", "left")
    reason = refused(("price", F.col("max_price") <= 0), ("unknown", F.col("state").isNull()), ("state", F.col("state") != "active"))
    return rows.withColumn("refused", reason).drop("state")


def open_sources(requests: DataFrame, auctions: DataFrame) -> DataFrame:
    """Requests (seq, auction_id): settled and open-sourced auctions become open-sourced."""
    states = auctions.select(F.col("id").alias("auction_id"), F.col("status").alias("state"))
    rows = requests.join(states, "auction_id", "left")
    reason = refused(("unknown", F.col("state").isNull()), ("state", ~F.col("state").isin("settled", "open_sourced")))
    return rows.withColumn("refused", reason).drop("state")


# Bounties


def create_bounties(requests: DataFrame, book: DataFrame) -> DataFrame:
    """Requests (seq, poster_wallet, scope, reward): the poster must hold the reward, which isn't set aside."""
    balances = ledger.balances(book).select(F.col("wallet").alias("poster_wallet"), "balance")
    rows = requests.join(balances, "poster_wallet", "left").withColumn("balance", F.coalesce("balance", F.lit(0)))
    reason = refused(("reward", F.col("reward") <= 0), ("balance", F.col("balance") < F.col("reward")))
    return rows.withColumn("refused", reason).drop("balance")


def claim_bounties(requests: DataFrame, bounties: DataFrame) -> DataFrame:
    """Requests (seq, bounty_id, claimer_wallet): the first claim of an open bounty is accepted."""
    rows = requests.join(bounties.select(F.col("id").alias("bounty_id"), F.col("status").alias("state")), "bounty_id", "left")
    rows = rows.withColumn("refused", refused(("unknown", F.col("state").isNull()), ("state", F.col("state") != "open")))
    first = rows.filter("refused IS NULL").groupBy("bounty_id").agg(F.min("seq").alias("first"))
    later = F.when(F.col("refused").isNull() & (F.col("seq") > F.col("first")), "state")
    return rows.join(first, "bounty_id", "left").withColumn("refused", F.coalesce("refused", later)).drop("first", "state")


def settle_bounties(requests: DataFrame, bounties: DataFrame, wallets: DataFrame, book: DataFrame) -> DataFrame:
    """Requests (seq, bounty_id) with refused and the ledger row: claimed bounties are paid while the poster can pay."""
    known = bounties.select(
        F.col("id").alias("bounty_id"), F.col("status").alias("state"), F.col("poster_wallet").alias("from_wallet"),
        F.col("claimed_by").alias("to_wallet"), F.col("reward").alias("amount"),
    )
    rows = requests.join(known, "bounty_id", "left")
    rows = rows.withColumn("why", refused(("unknown", F.col("state").isNull()), ("state", F.col("state") != "claimed")))
    first = first_wins(rows.filter("why IS NULL").select("bounty_id", "seq"), ["bounty_id"], ["seq"]).withColumnRenamed("seq", "first")
    rows = rows.join(first, "bounty_id", "left")
    rows = rows.withColumn("why", F.coalesce("why", F.when(F.col("seq") > F.col("first"), "state"))).drop("first", "state")
    paid = transfers(rows.filter("why IS NULL").drop("why"), wallets, book)
    rest = rows.filter("why IS NOT NULL").withColumnRenamed("why", "refused").withColumn("timestamp", F.lit(None).cast("long"))
    return paid.unionByName(rest)
