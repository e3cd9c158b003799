"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns (turn, role, text), in order; of one turn number by role, then text.

    Repeated rows count once. A conversation is one value: a very long one is held as a whole. Other columns are not
    looked at. No rows in, no rows out.
    """
    row = F.struct(F.col("turn").cast("int").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    return turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.array_sort(F.collect_set(row)).alias("turns"))


def paired_by_opening(talks: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): each conversation and the next by conv_id that opens with the same turn.

    A stand-in for labelled preferences: linear in the number of conversations, however many share an opening. Windows
    see ids and digests only, of 1024 neighbouring ids; the last of these takes the first of the next ones with the same
    opening, found among one row each. Conversations with a null id, without turns or alone in their opening are in no
    pair.
    """
    opening = F.try_element_at("turns", F.lit(1))
    rows = talks.where("conv_id IS NOT NULL AND size(turns) > 0").select("conv_id", F.sha2(F.to_json(F.struct(opening["role"], opening["text"])), 256).alias("opening"))
    rows = rows.withColumn("near", F.expr("conv_id div 1024"))
    after = F.lead("conv_id").over(Window.partitionBy("opening", "near").orderBy("conv_id"))
    heads = rows.groupBy("opening", "near").agg(F.min("conv_id").alias("head"))
    heads = heads.withColumn("next", F.lead("head").over(Window.partitionBy("opening").orderBy("head"))).drop("head")
    both = rows.withColumn("after", after).join(heads, ["opening", "near"])
    out = both.select(F.col("conv_id").alias("chosen_id"), F.coalesce("after", "next").alias("rejected_id"))
    return out.where("rejected_id IS NOT NULL")


def paired_by_number(talks: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id): conversations 2k and 2k + 1, where both are there."""
    rows = talks.where("conv_id IS NOT NULL").select("conv_id")
    even = rows.where("conv_id % 2 = 0").select(F.col("conv_id").alias("chosen_id"))
    odd = rows.where("conv_id % 2 <> 0").select(F.col("conv_id").alias("rejected_id"))
    return even.join(odd, F.col("rejected_id") == F.col("chosen_id") + 1)


def _render(turn: Column) -> Column:
    """A turn in the template; markers inside the text are broken up, so that text can't open or close a turn."""
    safe = lambda c: F.replace(F.coalesce(c, F.lit("")), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(BEGIN), safe(turn["role"]), F.lit("\n"), safe(turn["text"]), F.lit(END))


def format_preferences(talks: DataFrame, pairs: DataFrame) -> DataFrame:
    """(chosen_id, rejected_id, shared_turns, prompt, chosen, rejected) for each pair of conversations.

    The longest common prefix of turns (same role and text, null equal to null) is rendered once, as prompt. What is
    left of either conversation is a completion: segments (text, train), where train marks assistant turns; all other
    tokens are masked. A conversation that is a prefix of the other has an empty completion. Pairs that name an unknown
    conversation are left out; repeated pairs give repeated rows; no pairs, no rows.
    """
    c = talks.select(F.col("conv_id").alias("chosen_id"), F.col("turns").alias("c"))
    r = talks.select(F.col("conv_id").alias("rejected_id"), F.col("turns").alias("r"))
    both = pairs.select("chosen_id", "rejected_id").join(c, "chosen_id").join(r, "rejected_id")
    least = F.least(F.size("c"), F.size("r"))
    same = F.expr("transform(arrays_zip(slice(c, 1, least(size(c), size(r))), slice(r, 1, least(size(c), size(r)))), p -> p['0'].role <=> p['1'].role AND p['0'].text <=> p['1'].text)")
    first = F.array_position(same, F.lit(False))
    both = both.withColumn("shared_turns", F.when(first == 0, least).otherwise(first - 1).cast("int"))
    rest = lambda t: F.transform(F.slice(t, F.col("shared_turns") + 1, F.greatest(F.size(t) - F.col("shared_turns"), F.lit(0))), lambda x: F.struct(_render(x).alias("text"), F.coalesce(x["role"] == "assistant", F.lit(False)).alias("train")))
    prompt = F.concat_ws("", F.transform(F.slice("c", 1, F.col("shared_turns")), _render))
    return both.select("chosen_id", "rejected_id", "shared_turns", prompt.alias("prompt"), rest("c").alias("chosen"), rest("r").alias("rejected"))
