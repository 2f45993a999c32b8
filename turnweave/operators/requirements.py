"""Inside a step: relations of its requirements, routing of sibling answers, groups of patterns, flat rules, context penalties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.cues import EARLY_STOP, short_affirmation
from turnweave.functions.text import any_of
from turnweave.operators.context import replies_within

# Penalties of relations between requirements, of context, and bounds of routing.
PENALTY = {"any_of": 6.0, "all_of": 4.0, "condition_on": 6.0, "lacking": 5.0, "order": 7.0, "blocking": 8.0}
UNHANDLED, BROKEN, HANDLED = "触发但未处理", "已处理但后续违背转场", "已处理"
CONTEXT_PENALTY = {UNHANDLED: 12.0, BROKEN: 18.0}
ROUTED, LEAST, SHARE = 0.10, 0.06, 0.55


def relation_penalties(requirements: DataFrame, relations: DataFrame, active: DataFrame) -> DataFrame:
    """(dialogue, node, relation_id, penalty) of broken relations inside active nodes.

    ``requirements``: as ``requirement_results``. ``relations`` (metadata): node_id,
    relation_id, type, left, right, options (arrays of requirements), own (penalty or null).
    """
    entry = F.struct("requirement_id", F.struct("matched", "turn_index"))
    state = requirements.groupBy("dialogue_id", "node_id").agg(F.map_from_entries(F.collect_list(entry)).alias("of"))
    rows = state.join(active.where("active").select("dialogue_id", "node_id"), ["dialogue_id", "node_id"], "left_semi").join(F.broadcast(relations), "node_id")
    at = lambda x: F.try_element_at("of", x)
    matched = lambda x: F.coalesce(at(x)["matched"], F.lit(False))
    turn = lambda x: at(x)["turn_index"]
    kind, left, right, options = F.col("type"), F.col("left"), F.col("right"), F.col("options")
    lacking = lambda xs: F.filter(xs, lambda x: at(x).isNotNull() & ~matched(x))
    own = lambda name: F.coalesce(F.col("own"), F.lit(PENALTY[name]))
    listed = F.when(F.size(options) > 0, options)
    choice = F.coalesce(listed, F.when(F.size(left) > 0, left), right)
    a, b = F.get(left, F.lit(0)), F.get(right, F.lit(0))
    late = F.when(kind == "before_or_same_turn", turn(a) > turn(b)).otherwise(turn(a) >= turn(b))
    penalty = (
        F.when(kind.isin("any_of", "choice", "one_of"), F.when((F.size(choice) > 0) & ~F.exists(choice, matched), own("any_of")))
        .when(kind.isin("unordered_all", "all_of", "unordered"), own("all_of") * F.size(lacking(F.coalesce(listed, F.concat(left, right)))))
        .when(kind.isin("condition_on", "conditional", "if_then"), F.when(F.exists(left, matched) & (F.size(lacking(right)) > 0), own("condition_on")))
        .when(kind.isin("before", "strict_before", "before_or_same_turn"), F.when(a.isNotNull() & b.isNotNull(), F.when(matched(b) & ~matched(a), own("lacking")).when(late, own("order"))))
        .when(kind.isin("blocking", "terminal_after", "terminal"), F.when(F.exists(right, lambda x: F.coalesce(turn(x) > turn(a), F.lit(False))), own("blocking")))
    )
    return rows.withColumn("penalty", penalty).where("penalty > 0").select("dialogue_id", "node_id", "relation_id", "penalty")


def routed(rows: DataFrame) -> DataFrame:
    """Of (dialogue, node, requirement, similarity) those an asked question reaches: near the best; else the best if above 0; else all."""
    best = F.max("similarity").over(Window.partitionBy("dialogue_id", "node_id"))
    near = (F.col("similarity") >= ROUTED) & (F.col("similarity") >= F.greatest(F.lit(LEAST), SHARE * F.col("best")))
    of = Window.partitionBy("dialogue_id", "node_id")
    first = F.min(F.when(F.col("similarity") == F.col("best"), F.col("requirement_id"))).over(of)
    marked = rows.withColumn("best", best).withColumn("near", near).withColumn("some", F.max("near").over(of)).withColumn("first", first)
    kept = F.when(F.col("some"), F.col("near")).when(F.col("best") > 0, F.col("requirement_id") == F.col("first")).otherwise(F.lit(True))
    return marked.where(kept).drop("best", "near", "some", "first")


def pattern_groups(hits: DataFrame, groups: DataFrame) -> DataFrame:
    """(dialogue, group_id, n_hits, score, matched) of (dialogue, group_id, pattern_id) rows; ``groups``: group_id, min_hits."""
    counted = hits.groupBy("dialogue_id", "group_id").agg(F.count_distinct("pattern_id").alias("n_hits")).join(F.broadcast(groups), "group_id")
    least = F.greatest(F.lit(1), F.col("min_hits"))
    return counted.select("dialogue_id", "group_id", "n_hits", F.least(F.lit(1.0), F.col("n_hits") / least).alias("score"), (F.col("n_hits") >= least).alias("matched"))


def broad_terms(terms: DataFrame, least: int = 2) -> DataFrame:
    """(term, n_groups) of terms that ``least`` groups use: they tell little."""
    return terms.groupBy("term").agg(F.count_distinct("group_id").alias("n_groups")).where(F.col("n_groups") >= least)


#: Weights of flat rules as they are summed, and the places of their scores.
WEIGHT, SCORE_PLACES = "decimal(28,12)", 12


def flat_score(rows: DataFrame, hit_group: float, review_group: float) -> DataFrame:
    """(rule, span id, score, verdict) of flat rules: rows (rule_id, span_id, weight, is_role, is_hit, n_pool_hits).

    Weights are summed as decimals and scores have ``SCORE_PLACES`` places, so that no order of the rows decides a rounding or a threshold.
    """
    w = F.greatest(F.lit(0.1), F.col("weight")).cast(WEIGHT)
    plain = F.coalesce(F.bool_or(F.col("is_hit") & ~F.col("is_role")), F.lit(False))
    total = lambda c: F.sum(c).cast("double")
    ratio = total(F.when(F.col("is_hit"), w).otherwise(F.lit(0).cast(WEIGHT))) / total(w)
    out = rows.groupBy("rule_id", "span_id").agg(plain.alias("said"), ratio.alias("ratio"), F.max("n_pool_hits").alias("n"))
    score = F.when(~F.col("said"), F.lit(0.0)).otherwise(F.least(F.lit(1.0), F.round(F.col("ratio") + F.least(F.lit(0.25), 0.05 * F.col("n")), SCORE_PLACES)))
    out = out.withColumn("score", score)
    return out.select("rule_id", "span_id", "score", F.when(F.col("said") & (F.col("score") >= hit_group), "hit").when(F.col("said") & (F.col("score") >= review_group), "review").otherwise("miss").alias("verdict"))


def handled_later(events: DataFrame) -> DataFrame:
    """Context events (dialogue, policy, status, trigger_turn, safe_turn): a handling covers what was triggered up to its turn."""
    last = F.max(F.when(F.col("status") == HANDLED, F.col("safe_turn"))).over(Window.partitionBy("dialogue_id"))
    rows = events.withColumn("last", last)
    covered = (F.col("status") == UNHANDLED) & F.coalesce(F.col("trigger_turn") <= F.col("last"), F.lit(False))
    return rows.withColumn("safe_turn", F.when(covered, F.col("last")).otherwise(F.col("safe_turn"))).withColumn("status", F.when(covered, HANDLED).otherwise(F.col("status"))).drop("last")


def context_penalties(events: DataFrame) -> DataFrame:
    """(dialogue, penalty) of unhandled and of broken policies."""
    each = F.lit(0.0)
    for status, value in CONTEXT_PENALTY.items():
        each = F.when(F.col("status") == status, F.lit(value)).otherwise(each)
    return events.groupBy("dialogue_id").agg(F.sum(each).alias("penalty"))


def early_stops(turns: DataFrame, words: tuple[str, ...] = EARLY_STOP) -> DataFrame:
    """Dialogues whose user stops in the turns 1 or 2; turn 0 does not count."""
    return turns.where((F.col("speaker") == "user") & F.col("turn_index").isin(1, 2) & any_of(F.col("text"), words)).select("dialogue_id").distinct()


def window_union(turns: DataFrame, speaker: str, words: tuple[str, ...], least: int, ask: Column | None = None, within: int = 2, reply: Column | None = None) -> DataFrame:
    """(dialogue, turn_index): turns with one of the words, where the speaker's turns together hold ``least`` of them.

    With ``ask``, an assistant's ask that a short yes answers within ``within`` turns counts as one word more.
    """
    holds = [F.contains("text", F.lit(w)) for w in words]
    mine = F.col("speaker") == speaker
    n = sum((F.coalesce(F.bool_or(mine & h).cast("int"), F.lit(0)) for h in holds), F.lit(0))
    counted = turns.groupBy("dialogue_id").agg(n.alias("n"))
    if ask is not None:
        yes = replies_within(turns, ask, short_affirmation("text") if reply is None else reply, within).select("dialogue_id", F.lit(1).alias("bonus")).distinct()
        counted = counted.join(yes, "dialogue_id", "left").withColumn("n", F.col("n") + F.coalesce("bonus", F.lit(0)))
    enough = counted.where(F.col("n") >= least).select("dialogue_id")
    some = holds[0]
    for h in holds[1:]:
        some = some | h
    return turns.where(mine & some).join(enough, "dialogue_id", "left_semi").select("dialogue_id", "turn_index")
