"""Preference formatting: one prompt for the turns that two conversations share, and a masked completion for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What stands before and after the text of a turn; ``{role}`` is its role.
BEFORE, AFTER = "<|{role}|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """(pair_id, chosen, rejected): conversations 2k and 2k + 1, for all k of which both are there."""
    ids = turns.select("conv_id").filter("conv_id IS NOT NULL").distinct()
    pair = F.shiftright("conv_id", 1).cast("long")  # whole numbers: doubles end at 2^53
    halves = ids.groupBy(pair.alias("pair_id")).agg(
        F.min("conv_id").alias("chosen"), F.max("conv_id").alias("rejected")
    )
    return halves.filter("chosen != rejected")


def _rendered(turn: Column, before: str, after: str) -> Column:
    head, _, tail = before.partition("{role}")
    return F.concat(F.lit(head), turn["role"], F.lit(tail), turn["text"], F.lit(after))


def _joined(turns: Column, before: str, after: str) -> Column:
    return F.array_join(F.transform(turns, lambda t: _rendered(t, before, after)), "")


def _trained_spans(turns: Column, before: str, after: str, role: str) -> Column:
    """[(start, end)] of the characters of a completion that are trained on: text and end mark of the role's turns."""
    fixed = len(before.replace("{role}", ""))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def add(state: Column, turn: Column) -> Column:
        begin = state["at"] + fixed + F.length(turn["role"])
        end = begin + F.length(turn["text"]) + len(after)
        span = F.struct(begin.cast("int").alias("start"), end.cast("int").alias("end"))
        spans = F.when(turn["role"] == role, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct(end.cast("int").alias("at"), spans.alias("spans"))

    return F.aggregate(turns, start, add, lambda state: state["spans"])


def preferences(
    turns: DataFrame, pairs: DataFrame, before: str = BEFORE, after: str = AFTER, trained_role: str = TRAINED_ROLE
) -> DataFrame:
    """One row per pair: pair_id, chosen_id, rejected_id, prefix_turns, prompt, chosen, rejected and their spans.

    ``turns`` is (conv_id, turn, role, text), ``pairs`` is (pair_id, chosen, rejected). The prompt renders the longest
    common prefix of both conversations, compared turn by turn by role and text; chosen and rejected render what
    follows. The spans are the characters of a completion to train on; all others, and the prompt, are masked.

    Turns go by number, then role and text; a repeated row counts once. Rows with null conv_id or turn have no place
    and are left out; null role or text counts as empty. Equal conversations have empty completions. Pairs of which a
    conversation has no turns give no row, as do empty tables. Other columns are ignored, whatever their names.
    """
    placed = turns.filter("conv_id IS NOT NULL AND turn IS NOT NULL").select(
        "conv_id",
        F.struct(
            "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("t"),
    )
    sides = pairs.select("pair_id", F.explode(F.array(*[
        F.struct(F.col(name).alias("conv_id"), F.lit(name).alias("side")) for name in ("chosen", "rejected")
    ])).alias("s")).select("pair_id", "s.conv_id", "s.side")
    both = placed.join(sides, "conv_id").groupBy("pair_id")

    def turns_of(side: str) -> Column:
        return F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("t"))))

    def id_of(side: str) -> Column:
        return F.max(F.when(F.col("side") == side, F.col("conv_id"))).alias(f"{side}_id")

    rows = both.agg(id_of("chosen"), id_of("rejected"), turns_of("chosen").alias("c"), turns_of("rejected").alias("r"))
    rows = rows.filter("chosen_id IS NOT NULL AND rejected_id IS NOT NULL")
    same = F.zip_with("c", "r", lambda x, y: x["role"].eqNullSafe(y["role"]) & x["text"].eqNullSafe(y["text"]))
    differs = F.array_position(same, False)
    rows = rows.withColumn("prefix_turns", F.when(differs > 0, differs - 1).otherwise(F.size("c")).cast("int"))

    def rest(side: str) -> Column:
        return F.slice(F.col(side), F.col("prefix_turns") + 1, F.greatest(F.size(side), F.lit(1)))

    return rows.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "prefix_turns",
        _joined(F.slice("c", F.lit(1), F.col("prefix_turns")), before, after).alias("prompt"),
        _joined(rest("c"), before, after).alias("chosen"),
        _joined(rest("r"), before, after).alias("rejected"),
        _trained_spans(rest("c"), before, after, trained_role).alias("chosen_spans"),
        _trained_spans(rest("r"), before, after, trained_role).alias("rejected_spans"),
    )
