"""What brings a step into play: its first trigger, the user's words around it, and what the user gave unasked."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.cues import mixed_tokens, questionish
from turnweave.functions.text import any_of, compact, overlap_coefficient

# Least similarity of a context, the bonus of questions, and words of asking and of acting.
LEAST, BONUS = 0.08, 0.04
ASKS = ("询问", "确认", "检查", "是否", "哪", "还是", "提供", "手机号", "号码", "方式", "用什么", "发课")
ASK_WORDS = ("询问", "确认", "检查", "提供", "方式", "是否")
ACTIONS = ("处理", "操作", "配置", "选择", "保存", "入口", "页面", "引导", "说明", "按需", "需要", "可以", "建议")
BEFORE, AFTER = 2, 4


def first_triggers(by_pattern: DataFrame, by_element: DataFrame, by_object: DataFrame) -> DataFrame:
    """(dialogue, node_id, trigger_turn): of the first pattern in order that is met its first turn, otherwise the turn of the
    element match, otherwise that of the object scan.

    ``by_pattern``: dialogue_id, node_id, pattern_ord, turn_index; the others: dialogue_id, node_id, turn_index.
    """
    one = by_pattern.groupBy("dialogue_id", "node_id").agg(F.min(F.struct(F.lit(0).alias("kind"), F.col("pattern_ord").alias("place"), "turn_index")).alias("m"))
    rest = [x.groupBy("dialogue_id", "node_id").agg(F.min(F.struct(F.lit(k).alias("kind"), F.lit(0).alias("place"), "turn_index")).alias("m")) for k, x in ((1, by_element), (2, by_object))]
    found = one.unionByName(rest[0]).unionByName(rest[1]).groupBy("dialogue_id", "node_id").agg(F.min("m").alias("m"))
    return found.select("dialogue_id", "node_id", F.col("m.turn_index").alias("trigger_turn"))


def relevant_turns(users: DataFrame, hints: DataFrame, keep: int = 2) -> DataFrame:
    """(dialogue, node_id, turn_index, text): the user turns that are nearest to a node, for nodes without a trigger.

    ``users``: dialogue_id, turn_index, text of user turns. ``hints`` (metadata): node_id, texts (of its hint and its requirements).
    The best two where the best is near enough, with a bonus for questions; otherwise the last two questions, otherwise the last two turns.
    """
    rows = users.withColumn("toks", mixed_tokens("text")).withColumn("asks", questionish("text")).join(F.broadcast(hints), F.lit(True))
    near = F.array_max(F.transform("texts", lambda t: overlap_coefficient(mixed_tokens(t), F.col("toks"))))
    rows = rows.withColumn("score", F.coalesce(near, F.lit(0.0)) + F.when(F.col("asks"), BONUS).otherwise(0.0))
    of = Window.partitionBy("dialogue_id", "node_id")
    rank = lambda *by: F.row_number().over(of.orderBy(*by))
    rows = rows.withColumn("best", F.max("score").over(of)).withColumn("any_asks", F.max("asks").over(of))
    rows = rows.withColumn("by_score", rank(F.desc("score"), "turn_index")).withColumn("by_ask", rank(F.desc("asks"), F.desc("turn_index"))).withColumn("by_turn", rank(F.desc("turn_index")))
    kept = F.when(F.col("best") >= LEAST, F.col("by_score") <= keep).when(F.col("any_asks"), F.col("asks") & (F.col("by_ask") <= keep)).otherwise(F.col("by_turn") <= keep)
    return rows.where(kept).select("dialogue_id", "node_id", "turn_index", "text")


def context_texts(users: DataFrame, triggers: DataFrame, nearest: DataFrame) -> DataFrame:
    """(dialogue, node_id, context): the user's words around a trigger, questions before others; without a trigger the nearest turns."""
    around = triggers.select("dialogue_id", "node_id", F.explode(F.sequence(F.greatest(F.lit(0), F.col("trigger_turn") - BEFORE), F.col("trigger_turn") + AFTER)).alias("turn_index"))
    rows = around.join(users.select("dialogue_id", "turn_index", "text"), ["dialogue_id", "turn_index"]).withColumn("asks", questionish("text"))
    asked = F.max("asks").over(Window.partitionBy("dialogue_id", "node_id"))
    chosen = rows.withColumn("some", asked).where("asks OR NOT some").select("dialogue_id", "node_id", "turn_index", "text")
    rest = nearest.join(triggers, ["dialogue_id", "node_id"], "left_anti").select("dialogue_id", "node_id", "turn_index", "text")
    both = chosen.unionByName(rest).where("trim(text) <> ''")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "text"))), lambda x: x["text"])
    return both.groupBy("dialogue_id", "node_id").agg(F.array_join(lines, "\n").alias("context"))


def routed_similarities(contexts: DataFrame, requirements: DataFrame) -> DataFrame:
    """(dialogue, node, requirement, similarity) of the context of a node and each of its requirements (metadata: node_id, requirement_id, text, terms)."""
    rows = contexts.join(F.broadcast(requirements), "node_id").withColumn("toks", mixed_tokens("context"))
    own = F.concat(F.array("text"), "terms")
    return rows.select("dialogue_id", "node_id", "requirement_id", F.coalesce(F.array_max(F.transform(own, lambda t: overlap_coefficient(mixed_tokens(t), F.col("toks")))), F.lit(0.0)).alias("similarity"))


def given_unasked(users: DataFrame, requirements: DataFrame) -> DataFrame:
    """(dialogue, requirement_id) of requirements to ask for something that the user says anyway.

    ``requirements`` (metadata): requirement_id, text, terms (of its main elements).
    """
    telling = F.filter("terms", lambda t: (F.length(compact(t)) >= 2) & ~t.isin(*ASK_WORDS))
    asked = requirements.where(any_of(F.coalesce(F.col("text"), F.lit("")), ASKS)).select("requirement_id", F.explode(telling).alias("term"))
    return users.join(F.broadcast(asked), F.contains(F.regexp_replace("text", r"(?U)\s+", ""), F.regexp_replace("term", r"(?U)\s+", ""))).select("dialogue_id", "requirement_id").distinct()


def handled_branches(turns: DataFrame, triggers: DataFrame, words: DataFrame) -> DataFrame:
    """(dialogue, node_id): branches whose trigger words an assistant's later turn takes up with a word of acting.

    ``words`` (metadata): node_id, word (of the patterns of its trigger).
    """
    said = turns.where("speaker = 'assistant'").select("dialogue_id", "turn_index", F.regexp_replace("text", r"(?U)\s+", "").alias("said")).where(any_of(F.col("said"), ACTIONS))
    near = triggers.join(F.broadcast(words), "node_id").join(said, "dialogue_id").where("turn_index > trigger_turn")
    return near.where((F.col("word") != "") & F.contains(F.col("said"), F.regexp_replace("word", r"(?U)\s+", ""))).select("dialogue_id", "node_id").distinct()
