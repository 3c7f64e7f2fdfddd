"""Preference formatting: one shared prompt and a masked pair of completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Markers around a turn; the role stands between the first two.
OPEN, BREAK, CLOSE = "<|", "|>\n", "\n<|end|>\n"
ASSISTANT = "assistant"


def _turns(turns: DataFrame, side: str) -> DataFrame:
    """``(pair_id, place, role_, text_)``: places count the turns of a conversation from zero, whatever gaps their numbers have."""
    one = turns.groupBy("pair_id", "turn").agg(F.min(F.struct(
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).alias("said"))
    order = Window.partitionBy("pair_id").orderBy("turn")
    return one.select("pair_id", (F.row_number().over(order) - 1).alias("place"), F.col("said").alias(side))


def rendered(said: Column) -> Column:
    return F.concat(F.lit(OPEN), said["role"], F.lit(BREAK), said["text"], F.lit(CLOSE))


def _joined(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: rendered(t["said"])), "")


def _mask(turns: Column) -> Column:
    """``start:end`` of every assistant text in a completion (code points, end exclusive): only there a loss counts."""
    lengths = F.aggregate(
        turns, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("spans")),
        lambda acc, t: F.struct(
            (acc["at"] + F.length(rendered(t["said"]))).alias("at"),
            F.when(t["said"]["role"] == ASSISTANT, F.concat(acc["spans"], F.array(F.concat_ws(
                ":", acc["at"] + F.length(F.lit(OPEN)) + F.length(t["said"]["role"]) + F.length(F.lit(BREAK)),
                acc["at"] + F.length(rendered(t["said"])) - (len(CLOSE) - 1))))).otherwise(acc["spans"]).alias("spans")))
    return F.array_join(lengths["spans"], ",")


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Masked preference pairs from the turns of chosen and rejected conversations.

    Both tables hold ``pair_id, turn, role, text``; further columns are not read. The longest run of equal leading turns
    is rendered once as ``prompt``; what follows on either side is rendered as ``chosen`` and ``rejected``. The masks
    list the code points ``start:end`` of assistant texts, with the line break that ends them, within each
    completion; all else, user turns and markers included, carries no loss. Returns ``pair_id, prompt_turns, prompt,
    chosen, chosen_mask, rejected, rejected_mask``.

    NULL roles and texts count as empty, rows without pair_id or turn are no turns, of several rows for one turn the
    least ``(role, text)`` stands. A pair with only one side has an empty prompt and an empty other completion; equal
    sides have two empty completions. No rows give no rows. A conversation is one row here, and a pair's turns meet in
    one task; no other rows do.
    """
    keyed = [t.filter(F.col("pair_id").isNotNull() & F.col("turn").isNotNull()) for t in (chosen, rejected)]
    both = _turns(keyed[0], "c").join(_turns(keyed[1], "r"), ["pair_id", "place"], "full")
    sides = both.groupBy("pair_id").agg(
        F.min(F.when(~F.col("c").eqNullSafe(F.col("r")), F.col("place"))).alias("fork"),
        F.count(F.lit(1)).alias("n"),
        *[F.sort_array(F.collect_list(F.when(F.col(s).isNotNull(), F.struct("place", F.col(s).alias("said"))))).alias(s)
          for s in "cr"])
    fork = F.coalesce("fork", "n").cast("int")
    parts = sides.select("pair_id", fork.alias("prompt_turns"),
                         F.filter("c", lambda t: t["place"] < fork).alias("shared"),
                         F.filter("c", lambda t: t["place"] >= fork).alias("c"),
                         F.filter("r", lambda t: t["place"] >= fork).alias("r"))
    return parts.select(
        "pair_id", "prompt_turns", _joined(F.col("shared")).alias("prompt"),
        _joined(F.col("c")).alias("chosen"), _mask(F.col("c")).alias("chosen_mask"),
        _joined(F.col("r")).alias("rejected"), _mask(F.col("r")).alias("rejected_mask"))


def swapped_replies(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Chosen and rejected turns from plain conversations.

    Chosen is every conversation as it stands. Rejected is the same conversation up to its last assistant turn, whose
    text is taken from the last assistant turn of the conversation with which it is paired by id (2k with 2k + 1); where
    that one has none, the turn and all after it are missing. Equality joins on single ids only. Rows without
    conv_id or turn are no turns; of several rows for one turn the least ``(role, text)`` stands.
    """
    turns = conversations.filter(F.col("conv_id").isNotNull() & F.col("turn").isNotNull()).groupBy("conv_id", "turn").agg(
        F.min(F.struct(F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))).alias("said")).select(
        F.col("conv_id").alias("pair_id"), "turn", "said.role", "said.text")
    last = turns.filter(F.col("role") == ASSISTANT).groupBy("pair_id").agg(
        F.max(F.struct("turn", "text")).alias("last"))
    other = last.select(F.col("pair_id").bitwiseXOR(F.lit(1).cast("long")).alias("pair_id"), F.col("last.text").alias("reply"))
    ends = last.select("pair_id", F.col("last.turn").alias("final")).join(other, "pair_id", "left")
    kept = turns.join(ends, "pair_id").filter(
        (F.col("turn") < F.col("final")) | (F.col("turn") == F.col("final")) & F.col("reply").isNotNull())
    return turns, kept.select("pair_id", "turn", "role",
                              F.when(F.col("turn") == F.col("final"), F.col("reply")).otherwise(F.col("text")).alias("text"))
