"""Operators over the order of turns: asks and replies, as-of lookups, triggers and what follows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def replies_within(turns: DataFrame, ask: Column, reply: Column, within: int) -> DataFrame:
    """(dialogue, ask_turn, reply_turn): the first user reply at most ``within`` turns behind an assistant's ask."""
    asks = turns.where((F.col("speaker") == "assistant") & ask).select("dialogue_id", F.col("turn_index").alias("ask_turn"))
    answers = turns.where((F.col("speaker") == "user") & reply).select("dialogue_id", F.col("turn_index").alias("reply_turn"))
    # The distance is a part of the key, so that a long dialogue's turns are not all paired.
    near = asks.withColumn("reply_turn", F.explode(F.sequence(F.col("ask_turn") + 1, F.col("ask_turn") + within)))
    return near.join(answers, ["dialogue_id", "reply_turn"]).groupBy("dialogue_id", "ask_turn").agg(F.min("reply_turn").alias("reply_turn"))


def previous_user_turn(turns: DataFrame) -> DataFrame:
    """``turns`` with prev_user_turn and prev_user_text: the latest user turn before each."""
    before = Window.partitionBy("dialogue_id").orderBy("turn_index").rowsBetween(Window.unboundedPreceding, -1)
    said = F.when(F.col("speaker") == "user", F.struct("turn_index", "text"))
    found = turns.withColumn("p", F.last(said, ignorenulls=True).over(before))
    return found.withColumn("prev_user_turn", F.col("p.turn_index")).withColumn("prev_user_text", F.col("p.text")).drop("p")


def after_trigger(turns: DataFrame, trigger: Column) -> DataFrame:
    """``turns`` with trigger_turn: those behind the first user turn that holds the trigger."""
    all_ = Window.partitionBy("dialogue_id")
    first = F.min(F.when((F.col("speaker") == "user") & trigger, F.col("turn_index"))).over(all_)
    return turns.withColumn("trigger_turn", first).where("turn_index > trigger_turn")


def band_members(turns: DataFrame, reach: int) -> DataFrame:
    """``turns`` with band: the number of turns of the same speaker at most ``reach`` away."""
    by = Window.partitionBy("dialogue_id", "speaker").orderBy("turn_index").rangeBetween(-reach, reach)
    return turns.withColumn("band", F.count("*").over(by))


def across_turns(turns: DataFrame, words: tuple[str, ...], least: int) -> DataFrame:
    """(dialogue, speaker, n_words, reached_turn): where the turns of a speaker together hold ``least`` of the words, and the turn that completes them."""
    found = F.array(*[F.when(F.contains(F.col("text"), F.lit(w)), F.lit(w)) for w in words])
    each = turns.select("dialogue_id", "speaker", "turn_index", F.explode(F.array_compact(found)).alias("word"))
    first = each.groupBy("dialogue_id", "speaker", "word").agg(F.min("turn_index").alias("turn_index"))
    grouped = first.groupBy("dialogue_id", "speaker").agg(F.count("*").alias("n_words"), F.sort_array(F.collect_list("turn_index")).alias("t"))
    return grouped.where(F.col("n_words") >= least).select("dialogue_id", "speaker", "n_words", F.element_at("t", least).alias("reached_turn"))
