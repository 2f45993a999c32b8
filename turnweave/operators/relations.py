"""Order and structure between steps: penalties of edges, scores of relation groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from turnweave.operators.nodes import DONE, MISSING, PARTIAL

SCORED = ("before", "strict_before", "condition_on", "branch_choice", "terminal_after", "suppress_after")
STRICT = ("strict_before", "condition_on", "branch_choice")
# Types of groups whose best member counts, whose members follow each other, and which ask for nothing.
ALTERNATIVE = ("any_of", "one_of", "choice", "branch_choice", "exclusive_branch")
ORDERED = ("ordered", "strict_order", "sequential", "before")
FREE = ("optional_parallel", "optional", "parallel_optional")


def edge_results(results: DataFrame, edges: DataFrame) -> DataFrame:
    """(dialogue, source, target, kind, pair_score, penalty): every scored edge; pair_score only where both ends are active."""
    side = lambda p: results.select("dialogue_id", *[F.col(c).alias(f"{p}_{c}") for c in ("node_id", "active", "score", "status", "first_hit_turn")])
    rows = side("a").join(F.broadcast(edges.where(F.col("kind").isin(*SCORED))), F.col("a_node_id") == F.col("source"))
    rows = rows.join(side("b"), ["dialogue_id"]).where("b_node_id = target")
    strict = F.col("kind").isin(*STRICT)
    conditional = F.col("kind").isin("condition_on", "branch_choice")
    rows = rows.where(~(conditional & ~F.col("b_active")))
    a_gone, b_gone = F.col("a_status") == MISSING, F.col("b_status") == MISSING
    both = F.col("a_active") & F.col("b_active")
    ordered = F.col("kind").isin("before", "strict_before")
    part = lambda holds, hard, soft: F.when(holds, F.when(strict, hard).otherwise(soft)).otherwise(0.0)
    penalty = (
        part(F.col("b_active") & (~F.col("a_active") | a_gone) & strict, 8.0, 8.0)
        + part(both & a_gone & ~b_gone, 8.0, 4.0)
        + part(both & ordered & b_gone & ~a_gone, 6.0, 3.0)
        + part(both & F.coalesce(F.col("a_first_hit_turn") > F.col("b_first_hit_turn"), F.lit(False)), 10.0, 4.0)
    )
    return rows.select("dialogue_id", "source", "target", "kind", F.when(both, (F.col("a_score") + F.col("b_score")) / 2).alias("pair_score"), (penalty * F.col("weight")).alias("penalty"))


def continued_after_end(results: DataFrame, edges: DataFrame, reach: DataFrame) -> DataFrame:
    """(dialogue, source, target, penalty): edges to an end, both ends active, behind whose reached target steps go on; each edge is charged."""
    ends = F.broadcast(edges.where(F.col("kind").isin("terminal_after", "suppress_after")).select("source", "target", "weight"))
    at = results.where("active").select("dialogue_id", "node_id", "first_hit_turn")
    hit = at.where("first_hit_turn IS NOT NULL").select("dialogue_id", F.col("node_id").alias("target"), F.col("first_hit_turn").alias("ended"))
    both = hit.join(ends, "target").join(at.select("dialogue_id", F.col("node_id").alias("source")), ["dialogue_id", "source"])
    behind = both.join(F.broadcast(reach.select(F.col("source").alias("target"), F.col("target").alias("node_id"))), "target")
    later = behind.join(results.select("dialogue_id", "node_id", "first_hit_turn"), ["dialogue_id", "node_id"]).where("first_hit_turn > ended")
    return later.select("dialogue_id", "source", "target", (8.0 * F.col("weight")).alias("penalty")).distinct()


def group_scores(members: DataFrame) -> DataFrame:
    """(dialogue, group_id, group_type, score, n_active, n_done, penalty) of rows (dialogue, group, type, position, active, score, status,
    first_hit_turn) of members.

    Only active members count; a group without one has 100. penalty: what an event of the group says that its score has lost.
    """
    by = Window.partitionBy("dialogue_id", "group_id").orderBy("position")
    rows = members if "active" in members.columns else members.withColumn("active", F.lit(True))
    on = F.col("active")
    # Members that are not active are no neighbours: the last active one before counts.
    before = F.last(F.when(on, F.struct("first_hit_turn")), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("before", before)
    rows = rows.withColumn("inverted", on & F.coalesce(F.col("before.first_hit_turn") > F.col("first_hit_turn"), F.lit(False)))
    chosen = on & (F.col("first_hit_turn").isNotNull() | F.col("status").isin(DONE, PARTIAL))
    out = rows.groupBy("dialogue_id", "group_id", "group_type").agg(
        (100.0 * F.avg(F.when(on, F.col("score")))).alias("mean"),
        (100.0 * F.max(F.when(on, F.col("score")))).alias("best"),
        F.sum(F.col("inverted").cast("int")).alias("inversions"),
        F.sum(chosen.cast("int")).alias("n_chosen"),
        F.sum(on.cast("int")).alias("n_active"),
        F.sum((on & (F.col("status") == DONE)).cast("int")).alias("n_done"),
    )
    kind = F.col("group_type")
    lost = F.when(kind == "exclusive_branch", 10.0 * F.greatest(F.lit(0), F.col("n_chosen") - 1)).when(kind.isin(*ORDERED), 8.0 * F.col("inversions")).otherwise(0.0)
    score = F.when(kind.isin(*ALTERNATIVE), F.col("best")).otherwise(F.col("mean"))
    out = out.withColumn("penalty", lost).withColumn("score", F.when(F.col("n_active") > 0, F.greatest(F.lit(0.0), score - lost)).otherwise(100.0))
    return out.select("dialogue_id", "group_id", "group_type", "score", "n_active", "n_done", "penalty")


def group_events(scores: DataFrame, groups: DataFrame) -> DataFrame:
    """(dialogue, group_id, relation, penalty): what is wrong with groups of ``group_scores``; the penalties are named, not charged again.

    ``groups`` (metadata): group_id, required, least (completed members, null: all).
    """
    rows = scores.where("n_active > 0").join(F.broadcast(groups.select("group_id", "required", "least")), "group_id")
    kind, done = F.col("group_type"), F.col("n_done")
    short = F.col("required") & (done < F.least(F.coalesce("least", "n_active"), F.col("n_active")))
    event = (
        F.when((kind == "exclusive_branch") & (F.col("penalty") > 0), F.struct(F.lit("group:exclusive_branch").alias("relation"), F.col("penalty").alias("lost")))
        .when(kind.isin(*ALTERNATIVE), F.when(F.col("required") & (done == 0), F.struct(F.lit("group:any_of").alias("relation"), F.lit(8.0).alias("lost"))))
        .when(kind.isin(*ORDERED), F.when(F.col("penalty") > 0, F.struct(F.lit("group:ordered").alias("relation"), F.col("penalty").alias("lost"))))
        .when(~kind.isin(*FREE) & short, F.struct(F.lit("group:all_of").alias("relation"), F.lit(6.0).alias("lost")))
    )
    return rows.withColumn("event", event).where("event IS NOT NULL").select("dialogue_id", "group_id", "event.relation", F.col("event.lost").alias("penalty"))


def relation_scores(dialogues: DataFrame, edge_rows: DataFrame, groups: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    """(dialogue, relation_score): mean of the pairs, mixed with the groups where there are any, without the penalties.

    ``weights`` (metadata: group_id, weight) of all groups; without it each has 1. Where the weights add up to nothing, their number counts.
    """
    pairs = edge_rows.groupBy("dialogue_id").agg((100.0 * F.avg("pair_score")).alias("pairs"), F.sum("penalty").alias("penalty"))
    rows = dialogues.select("dialogue_id").distinct().join(pairs, "dialogue_id", "left")
    base = F.coalesce("pairs", F.lit(100.0))
    if groups is not None:
        weighed = groups.withColumn("weight", F.lit(1.0)) if weights is None else groups.join(F.broadcast(weights.select("group_id", "weight")), "group_id")
        whole = F.sum(F.greatest(F.lit(0.0), F.col("weight")))
        mean = F.sum(F.col("score") * F.col("weight")) / F.when(whole > 0, whole).otherwise(F.count("*"))
        rows = rows.join(weighed.groupBy("dialogue_id").agg(F.greatest(F.lit(0.0), F.least(F.lit(100.0), mean)).alias("grouped")), "dialogue_id", "left")
        base = 0.55 * base + 0.45 * F.coalesce("grouped", F.lit(100.0))
    return rows.select("dialogue_id", F.greatest(F.lit(0.0), base - F.coalesce("penalty", F.lit(0.0))).alias("relation_score"))
