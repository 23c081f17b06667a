"""Wallets and the ledger: balances, history, supply and rewards. Amounts are whole nano-units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.running import running_sum

NANO = 1_000_000_000
# The types of wallets that can be created.
WALLET_TYPES = ("human", "agent", "external")
# Work that counts as parsing, that counts as a version, and the nodes that past parsing is paid for.
PARSE_WORK = ("parse_file", "parse_crate", "parse_markdown")
VERSION_WORK = "create_version"
NODES_REWARDED = 100
# Work that counts as training, steps that one reward is for, and what an inference is priced as.
TRAINING_WORK = "model_training"
STEPS_REWARDED = 10
INFERENCE = "model_inference"


def entries(ledger: DataFrame) -> DataFrame:
    """Both sides of each movement: wallet, received, sent; a mint has no payer. One scan, no union."""
    into = F.struct(F.col("to_wallet").alias("wallet"), F.col("amount").alias("received"), F.lit(0).cast("long").alias("sent"))
    out = F.struct(F.col("from_wallet").alias("wallet"), F.lit(0).cast("long").alias("received"), F.col("amount").alias("sent"))
    sides = ledger.select(F.explode(F.array(into, out)).alias("side"))
    return sides.select("side.*").filter("wallet IS NOT NULL")


def balances(ledger: DataFrame) -> DataFrame:
    """wallet, received, sent, balance. Sums run in decimals, so no amount overflows them."""
    total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    sums = entries(ledger).groupBy("wallet").agg(total("received").alias("received"), total("sent").alias("sent"))
    return sums.select(
        "wallet", F.col("received").cast("long").alias("received"), F.col("sent").cast("long").alias("sent"),
        (F.col("received") - F.col("sent")).cast("long").alias("balance"),
    )


def wallet_balance(ledger: DataFrame, wallet: str) -> DataFrame:
    mine = ledger.filter((F.col("to_wallet") == wallet) | (F.col("from_wallet") == wallet))
    return balances(mine).filter(F.col("wallet") == wallet)


def history(ledger: DataFrame, wallet: str, limit: int = 50) -> DataFrame:
    """The newest movements of a wallet; one to itself counts as received."""
    mine = ledger.filter((F.col("to_wallet") == wallet) | (F.col("from_wallet") == wallet))
    direction = F.when(F.col("to_wallet") == wallet, "received").otherwise("sent")
    rows = mine.select("from_wallet", "to_wallet", "amount", "reason", "timestamp", direction.alias("direction"))
    ties = ["from_wallet", "to_wallet", "amount", "reason"]
    return rows.orderBy(F.desc("timestamp"), *ties).limit(limit)


def total_supply(ledger: DataFrame) -> DataFrame:
    minted = F.sum(F.when(F.col("from_wallet").isNull(), F.col("amount")))
    return ledger.agg(F.coalesce(minted, F.lit(0)).cast("long").alias("supply"), F.count("*").alias("movements"))


def shares(ledger: DataFrame) -> DataFrame:
    """Each wallet's balance as a share of the supply, as text with 18 digits; ``0`` without supply."""
    supply = total_supply(ledger).select("supply")
    share = F.when(F.col("supply") == 0, F.lit("0")).otherwise(
        F.format_string("%.18f", F.col("balance").cast("double") / F.col("supply").cast("double"))
    )
    return balances(ledger).join(F.broadcast(supply)).select("wallet", "balance", share.alias("share"))  # one row


def top_holders(ledger: DataFrame, k: int = 10) -> DataFrame:
    return balances(ledger).filter("balance > 0").select("wallet", "balance").orderBy(F.desc("balance"), "wallet").limit(k)


def last_mints(ledger: DataFrame, k: int = 10) -> DataFrame:
    mints = ledger.filter("from_wallet IS NULL").select("to_wallet", "amount", "reason", "timestamp")
    return mints.orderBy(F.desc("timestamp"), "to_wallet", "amount", "reason").limit(k)


def running_balances(ledger: DataFrame) -> DataFrame:
    """Each wallet's balance after each of its movements, in the order of time."""
    into = F.struct(F.col("to_wallet").alias("wallet"), F.col("amount").alias("change"))
    out = F.struct(F.col("from_wallet").alias("wallet"), (-F.col("amount")).alias("change"))
    changes = ledger.select("timestamp", F.explode(F.array(into, out)).alias("side")).select("timestamp", "side.*")
    changes = changes.filter("wallet IS NOT NULL")
    return running_sum(changes, ["wallet"], "timestamp", "change", "balance", ties=("change",))


def overdrafts(ledger: DataFrame) -> DataFrame:
    """Per wallet how many movements leave it below zero, and the lowest balance."""
    below = running_balances(ledger).filter("balance < 0")
    return below.groupBy("wallet").agg(F.count("*").alias("violations"), F.min("balance").alias("lowest"))


def nonce_gaps(transfers: DataFrame) -> DataFrame:
    """Signed transfers (from_wallet, nonce, ...) whose nonce isn't one above the wallet's last."""
    by_wallet = Window.partitionBy("from_wallet").orderBy("nonce")
    expected = F.coalesce(F.lag("nonce").over(by_wallet), F.lit(0)) + 1
    return transfers.withColumn("expected", expected).filter("nonce != expected")


def reward_mints(work: DataFrame, schedule: DataFrame) -> DataFrame:
    """Work items (wallet, work_type) with the reward of the schedule; types that are missing or disabled mint none."""
    rates = schedule.filter("enabled").select("work_type", "reward")
    reason = F.concat(F.lit("reward:"), "work_type").alias("reason")
    return work.join(rates, "work_type").select("wallet", "work_type", F.col("reward").alias("amount"), reason)


def training_rewards(work: DataFrame, agents: DataFrame, schedule: DataFrame) -> DataFrame:
    """Mints (agent, wallet, steps, amount, reason) of training runs (agent, steps): the scheduled reward for each full
    ten steps, and at least once. Agents (id, wallet) without a wallet, and a reward that is missing or disabled, mint none.
    """
    rate = schedule.filter((F.col("work_type") == TRAINING_WORK) & F.col("enabled")).agg(F.max("reward").alias("rate"))
    owners = agents.filter("wallet IS NOT NULL").select(F.col("id").alias("agent"), "wallet")
    rows = work.join(owners, "agent").join(F.broadcast(rate.filter("rate IS NOT NULL")))  # one row
    times = F.greatest(F.floor(F.coalesce("steps", F.lit(0)) / STEPS_REWARDED), F.lit(1))
    return rows.select("agent", "wallet", "steps", (F.col("rate") * times).cast("long").alias("amount"), F.lit(TRAINING_WORK).alias("reason"))


def evaluate_mining(nodes: DataFrame, versions: DataFrame, rewards: DataFrame, schedule: DataFrame, book: DataFrame) -> DataFrame:
    """Mints (work_type, amount, reason, timestamp) of what past work is owed, from counts of one row each.

    ``rewards`` (work_type) is the log of rewarded work. Without any reward for parsing the nodes earn a unit each, up to
    NODES_REWARDED; versions beyond those rewarded earn what the schedule gives for one, if that is enabled.
    Timestamps go on from the ledger's last.
    """
    parsed = F.count_if(F.col("work_type").isin(*PARSE_WORK)).alias("parsed")
    versioned = F.count_if(F.col("work_type") == VERSION_WORK).alias("versioned")
    rate = schedule.filter((F.col("work_type") == VERSION_WORK) & F.col("enabled")).agg(F.max("reward").alias("rate"))
    one = nodes.agg(F.count("*").alias("nodes")).join(versions.agg(F.count("*").alias("versions")))
    one = one.join(rewards.agg(parsed, versioned)).join(rate).join(book.agg(F.coalesce(F.max("timestamp"), F.lit(0)).alias("last")))
    parsing = F.when(F.col("parsed") == 0, F.least(F.col("nodes"), F.lit(NODES_REWARDED)) * NANO)
    versions_owed = (F.col("versions") - F.col("versioned")) * F.col("rate")
    owed = F.array(*[
        F.struct(F.lit(kind).alias("work_type"), F.coalesce(amount, F.lit(0)).cast("long").alias("amount"))
        for kind, amount in (("retroactive_parsing", parsing), ("retroactive_versions", versions_owed))
    ])
    rows = one.select("last", F.posexplode(F.filter(owed, lambda o: o["amount"] > 0)).alias("place", "o"))
    reason = F.concat(F.lit("reward:"), "o.work_type").alias("reason")
    return rows.select("o.work_type", "o.amount", reason, (F.col("last") + F.col("place") + 1).cast("long").alias("timestamp"))


def retroactive_bonus(nodes: int, parse_rewards: int, versions: int, rewarded_versions: int, rate: int) -> dict[str, int]:
    """What past work is owed: up to 100 units for nodes never rewarded, and ``rate`` per version not yet rewarded."""
    return {
        "nodes": min(nodes, 100) * NANO if not parse_rewards else 0,
        "versions": max(0, versions - rewarded_versions) * rate,
    }
