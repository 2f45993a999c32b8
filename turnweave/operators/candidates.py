"""Grey-zone candidates: what an evaluation leaves open, as rows for the second filter and arbitration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import clip
from turnweave.operators.judges import UNSURE
from turnweave.operators.requirements import HANDLED

# Needs by kind, strengths with and without evidence, bounds of requirements, and the mark of a transcript.
NEED = {"knowledge": 0.82, "constraint": 0.86, "context": 0.78}
WITH_EVIDENCE, WITHOUT = 0.60, 0.35
LEAST_NEED, LEAST_STRENGTH = 0.70, 0.35
TRANSCRIPT, TRANSCRIPT_CHARS = "客服实际表达摘要", 1800
KINDS = {"requirement": "requirement 覆盖灰区", "knowledge": "知识核验灰区", "constraint": "限制边界灰区", "context": "上下文转场灰区"}
FAMILY = {"requirement": "flow_missing", "knowledge": "knowledge_violation", "constraint": "constraint_violation", "context": "context_violation"}


def _row(kind: str, rows: DataFrame, target: str, need: Column, strength: Column, evidence: Column, forced: Column) -> DataFrame:
    key = F.concat_ws(":", "dialogue_id", F.lit(kind), target)
    return rows.select(
        key.alias("candidate_id"), "dialogue_id", F.lit(KINDS[kind]).alias("kind"), F.lit(FAMILY[kind]).alias("family"), F.col(target).alias("target"),
        need.cast("double").alias("need"), strength.cast("double").alias("strength"), evidence.alias("evidence"), forced.alias("forced_review"),
    )


def _known(kind: str, rows: DataFrame, target: str) -> DataFrame:
    """Candidates of checks: those that are unsure, or of which a side is in review. Columns: verdict, positive, negative, evidence."""
    positive, negative = F.coalesce("positive", F.lit("")), F.coalesce("negative", F.lit(""))
    unsure = F.col("verdict") == UNSURE
    open_ = rows.where(unsure | (positive == "review") | (negative == "review"))
    said = F.coalesce("evidence", F.lit(""))
    strength = F.when(said != "", WITH_EVIDENCE).otherwise(WITHOUT)
    forced = unsure | (negative == "review") | ((positive == "hit") & (negative == "hit"))
    return _row(kind, open_, target, F.lit(NEED[kind]), strength, F.filter(F.array(said), lambda x: x != ""), forced)


def of_facts(checks: DataFrame) -> DataFrame:
    return _known("knowledge", checks, "fact_id")


def of_constraints(limits: DataFrame) -> DataFrame:
    return _known("constraint", limits, "constraint_id")


def of_requirements(results: DataFrame, least_need: float = LEAST_NEED, least_strength: float = LEAST_STRENGTH) -> DataFrame:
    """Candidates of required requirements of active nodes that were not met, though something came near (``strength``)."""
    need = 1.0 - F.col("score")
    open_ = results.where(F.col("active") & F.col("required") & ~F.col("matched") & (need >= least_need) & (F.col("strength") >= least_strength))
    return _row("requirement", open_, "requirement_id", need, F.col("strength"), F.coalesce("evidence", F.array().cast("array<string>")), F.lit(False))


def of_context(events: DataFrame, turns: DataFrame) -> DataFrame:
    """Candidates of policies that were not handled, with the turn of the trigger, that of the handling or the next of the assistant."""
    open_ = events.where(F.col("status") != HANDLED)
    line = lambda mark: F.concat(F.lit(mark), F.col("turn_index").cast("string"), F.lit("轮："), F.col("text"))
    said = turns.select("dialogue_id", "turn_index", "speaker", "text")
    trigger = open_.join(said, "dialogue_id").where("turn_index = trigger_turn").select("dialogue_id", "policy_id", F.lit(0).alias("o"), "turn_index", line("第").alias("line"))
    after = open_.join(said.where("speaker = 'assistant'"), "dialogue_id").where("turn_index > trigger_turn AND (safe_turn IS NULL OR turn_index = safe_turn)")
    place = Window.partitionBy("dialogue_id", "policy_id").orderBy("turn_index")
    later = after.withColumn("n", F.row_number().over(place)).where("n <= 3").select("dialogue_id", "policy_id", F.lit(1).alias("o"), "turn_index", line("第").alias("line"))
    lines = trigger.unionByName(later).groupBy("dialogue_id", "policy_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("o", "turn_index", "line"))), lambda x: x["line"]).alias("evidence"))
    rows = open_.join(lines, ["dialogue_id", "policy_id"], "left").withColumn("evidence", F.coalesce("evidence", F.array().cast("array<string>")))
    return _row("context", rows, "policy_id", F.lit(NEED["context"]), F.when(F.size("evidence") > 0, WITH_EVIDENCE).otherwise(WITHOUT), F.col("evidence"), F.lit(False))


def all_candidates(facts: DataFrame, constraints: DataFrame, *more: DataFrame) -> DataFrame:
    """The candidates of facts and constraints and, where they are routed, of requirements and context."""
    out = facts.unionByName(constraints)
    for rows in more:
        out = out.unionByName(rows)
    return out


def transcripts(turns: DataFrame, limit: int = TRANSCRIPT_CHARS) -> DataFrame:
    """(dialogue, transcript): what the assistant says, a line a turn, clipped."""
    line = F.concat(F.lit("客服第"), F.col("turn_index").cast("string"), F.lit("轮："), F.trim("text"))
    own = turns.where("speaker = 'assistant' AND trim(text) <> ''").select("dialogue_id", "turn_index", line.alias("line")).distinct()
    lines = F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "line"))), lambda x: x["line"])
    return own.groupBy("dialogue_id").agg(F.array_join(lines, "\n").alias("all")).select("dialogue_id", clip("all", limit, "\n……[已截断]").alias("transcript"))


def kept_evidence(items: Column, limit: int = 6) -> Column:
    """The first ``limit`` entries without repeats, the transcript among them if there is one."""
    clean = F.filter(F.transform(items, lambda x: F.trim(F.coalesce(x, F.lit("")))), lambda x: x != "")
    scripts = F.filter(clean, lambda x: F.contains(x, F.lit(TRANSCRIPT)))
    first = F.slice(clean, 1, limit)
    held = (F.size(scripts) == 0) | F.exists(first, lambda x: F.contains(x, F.lit(TRANSCRIPT)))
    return F.array_distinct(F.when(held, first).otherwise(F.concat(F.slice(clean, 1, limit - 1), F.slice(scripts, 1, 1))))
