"""Falling-price auctions and bounties as set operations; state machines are replayed for all auctions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions.paths import in_subtree
from lattica.operators.running import running_sum


def next_price() -> Column:
    return F.greatest(F.col("current_price") - F.col("price_decrement"), F.col("floor_price"))


def tick(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """One tick of every active auction: new_price, qualifying bids and the action.

    Reaching the floor opens the source even if enough bids qualify; else enough bids make it ready to settle.
    """
    active = auctions.filter("status = 'active'").withColumn("new_price", next_price())
    offers = bids.select(F.col("auction_id").alias("id"), "max_price")
    good = active.select("id", "new_price").join(offers, "id").filter(F.col("max_price") >= F.col("new_price"))
    counts = good.groupBy("id").agg(F.count("*").alias("qualifying"))
    state = active.join(counts, "id", "left").withColumn("qualifying", F.coalesce("qualifying", F.lit(0)).cast("long"))
    action = (
        F.when(F.col("new_price") <= F.col("floor_price"), "open_sourced")
        .when(F.col("qualifying") >= F.col("min_bidders"), "settlement_ready")
        .otherwise("price_decremented")
    )
    return state.select("id", "current_price", "new_price", "qualifying", action.alias("action"))


def replay(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """All ticks to the end: the first tick at which enough bids qualify, or the floor.

    The bid that makes an auction ready is its min_bidders-th highest, so its tick follows by arithmetic and no
    auction is expanded into its ticks. Only the highest bids of an auction are ranked.
    """
    active = auctions.filter("status = 'active'")
    to_floor = F.ceil((F.col("current_price") - F.col("floor_price")) / F.col("price_decrement")).cast("long")
    active = active.withColumn("floor_tick", F.greatest(to_floor, F.lit(1).cast("long")))
    needed = auctions.agg(F.max("min_bidders")).first()[0] or 0  # a bound on the ranks that matter
    by_price = Window.partitionBy("auction_id").orderBy(F.desc("max_price"), "seq")
    ranked = bids.withColumn("place", F.row_number().over(by_price)).filter(F.col("place") <= needed)
    ranked = ranked.select(F.col("auction_id").alias("id"), F.col("place").alias("min_bidders"), F.col("max_price").alias("bar"))
    joined = active.join(ranked, ["id", "min_bidders"], "left")
    ready = F.ceil((F.col("current_price") - F.col("bar")) / F.col("price_decrement")).cast("long")
    ready = F.when(F.col("bar").isNotNull(), F.greatest(ready, F.lit(1).cast("long")))
    settles = F.coalesce(ready < F.col("floor_tick"), F.lit(False))
    return joined.select(
        "id",
        F.when(settles, ready).otherwise(F.col("floor_tick")).alias("ticks"),
        F.when(settles, F.col("current_price") - ready * F.col("price_decrement"))
        .otherwise(F.col("floor_price")).alias("final_price"),
        F.when(settles, "settlement_ready").otherwise("open_sourced").alias("action"),
    )


def settle(auctions: DataFrame, bids: DataFrame, clock: int = 0) -> DataFrame:
    """Ledger rows of every active auction with enough bids at its price: each such bidder pays that price.

    ``timestamp`` is ``clock`` plus the revenue of the auction up to the row.
    """
    offers = bids.select(F.col("auction_id").alias("id"), "bidder_wallet", "max_price", "seq")
    good = auctions.filter("status = 'active'").join(offers, "id").filter("max_price >= current_price")
    counts = good.groupBy("id").agg(F.count("*").alias("n"))
    enough = good.join(counts, "id").filter("n >= min_bidders").drop("n")
    summed = running_sum(enough, ["id"], "seq", "current_price", "upto")
    return summed.select(
        F.col("id").alias("auction_id"), F.col("bidder_wallet").alias("from_wallet"),
        F.col("seller_wallet").alias("to_wallet"), F.col("current_price").alias("amount"),
        (F.col("upto") + clock).alias("timestamp"),
    )


def browse(
    auctions: DataFrame, bids: DataFrame, scope: str | None = None, max_price: int | None = None, status: str = "active"
) -> DataFrame:
    """Auctions of a status, below a scope and a price, cheapest first, with their numbers of bids."""
    chosen = auctions.filter(F.col("status") == status)
    if scope is not None:
        chosen = chosen.filter(in_subtree(F.col("scope"), scope))
    if max_price is not None:
        chosen = chosen.filter(F.col("current_price") <= max_price)
    offers = bids.select(F.col("auction_id").alias("id")).join(chosen.select("id"), "id", "left_semi")
    counts = offers.groupBy("id").agg(F.count("*").alias("bid_count"))
    joined = chosen.join(counts, "id", "left")
    rows = joined.select("id", "scope", "current_price", "floor_price", F.coalesce("bid_count", F.lit(0)).cast("long").alias("bid_count"))
    return rows.orderBy("current_price", "id")


def market_status(auctions: DataFrame, bids: DataFrame, auction: int) -> DataFrame:
    """An auction with its bids, highest first. The bids of one auction, not of all, are collected."""
    own = bids.filter(F.col("auction_id") == auction)
    key = F.struct((-F.col("max_price")).alias("k"), "seq", "bidder_wallet", "max_price")
    listed = own.groupBy(F.col("auction_id").alias("id")).agg(F.array_sort(F.collect_list(key)).alias("l"))
    as_text = F.transform("l", lambda b: F.concat_ws(":", b["bidder_wallet"], b["max_price"].cast("string")))
    joined = auctions.filter(F.col("id") == auction).join(listed, "id", "left")
    return joined.select("id", "scope", "status", "current_price", F.coalesce(F.array_join(as_text, ","), F.lit("")).alias("bids"))


def market_balance(ledger: DataFrame, auctions: DataFrame, bids: DataFrame, wallet: str) -> DataFrame:
    """Earnings, spending and net of a wallet, its active auctions and its bids on active auctions; one row."""
    money = ledger.agg(
        F.coalesce(F.sum(F.when(F.col("to_wallet") == wallet, F.col("amount"))), F.lit(0)).alias("earnings"),
        F.coalesce(F.sum(F.when(F.col("from_wallet") == wallet, F.col("amount"))), F.lit(0)).alias("spending"),
    )
    active = auctions.filter("status = 'active'")
    selling = active.agg(F.count_if(F.col("seller_wallet") == wallet).alias("active_auctions"))
    on_active = bids.join(active.select(F.col("id").alias("auction_id")), "auction_id", "left_semi")
    bidding = on_active.agg(F.count_if(F.col("bidder_wallet") == wallet).alias("active_bids"))
    row = money.join(selling).join(bidding)  # one row each
    return row.select("earnings", "spending", (F.col("earnings") - F.col("spending")).alias("net"), "active_auctions", "active_bids")


def commons(auctions: DataFrame, scope: str | None = None, since=None) -> DataFrame:
    """Open-sourced auctions, below a scope and, by ``open_sourced_at``, from a moment on, the latest first."""
    chosen = auctions.filter("status = 'open_sourced'")
    if since is not None:
        chosen = chosen.filter(F.col("open_sourced_at") >= since)
        scoped = chosen if scope is None else chosen.filter(in_subtree(F.col("scope"), scope))
        return scoped.select("id", "scope", "current_price", "open_sourced_at").orderBy(F.desc("open_sourced_at"), F.desc("id"))
    if scope is not None:
        chosen = chosen.filter(in_subtree(F.col("scope"), scope))
    return chosen.select("id", "scope", "current_price").orderBy(F.desc("id"))


def stats(auctions: DataFrame, bids: DataFrame) -> DataFrame:
    """Numbers of auctions by state, of bids, and the mean price of settled ones; one row."""
    settled = F.when(F.col("status") == "settled", F.col("current_price"))
    of_auctions = auctions.agg(
        F.count("*").alias("auctions"),
        F.count_if(F.col("status") == "active").alias("active"),
        F.count_if(F.col("status") == "settled").alias("settled"),
        F.count_if(F.col("status") == "open_sourced").alias("open_sourced"),
        F.coalesce(F.round(F.avg(settled)), F.lit(0.0)).alias("avg_settled_price"),
    )
    return of_auctions.join(bids.agg(F.count("*").alias("bids")))


def bounties(all_bounties: DataFrame, status: str | None = None, scope: str | None = None) -> DataFrame:
    """Bounties (id, scope, reward, status), highest reward first."""
    chosen = all_bounties if status is None else all_bounties.filter(F.col("status") == status)
    if scope is not None:
        chosen = chosen.filter(in_subtree(F.col("scope"), scope))
    return chosen.orderBy(F.desc("reward"), "id")
