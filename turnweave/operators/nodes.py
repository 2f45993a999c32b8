"""Steps of the state graph: requirements, node results, activity, context, closure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.plans.local import local_table

# Names of states, thresholds of node scores, types of nodes on the main line.
DONE, PARTIAL, MISSING, INACTIVE = "已完成", "部分完成", "缺失", "未激活"
SATISFIED, PARTLY, ZERO_CAP, LOCAL_HIT = 0.75, 0.35, 0.58, 0.72
#: Pairs of a closure that are broadcast; graphs with more are refused.
MAX_PAIRS = 1_000_000
MAINLINE = ("", "start", "main", "mainline", "process", "normal", "core")


def by_dialogue(matches: DataFrame, dialogues: DataFrame) -> DataFrame:
    """(dialogue, found): every dialogue once, with a map of its best matches by rule; a catalogue's rules bound its size."""
    entry = F.struct("rule_id", F.struct("verdict", "score", "turn_index", "first_turn"))
    found = matches.groupBy("dialogue_id").agg(F.map_from_entries(F.collect_list(entry)).alias("found"))
    return dialogues.select("dialogue_id").distinct().join(found, "dialogue_id", "left")


def of_rule(rule: Column) -> Column:
    """A rule's best match in ``found``, or null."""
    return F.try_element_at("found", rule)


def requirement_results(found: DataFrame, requirements: DataFrame) -> DataFrame:
    """(dialogue, node, requirement, weight, required, score, matched, turn) for every dialogue.

    A match in review keeps its score, and like a hit has the first turn of its window. A node without requirements has one row, with
    a null one.
    """
    out = found.crossJoin(F.broadcast(requirements)).withColumn("m", of_rule(F.col("requirement_id")))
    return out.select(
        "dialogue_id", "node_id", "requirement_id", "weight", "required",
        F.when(F.col("m.verdict").isin("hit", "review"), F.least(F.lit(1.0), F.col("m.score"))).otherwise(F.lit(0.0)).alias("score"),
        F.coalesce(F.col("m.verdict") == "hit", F.lit(False)).alias("matched"),
        F.when(F.col("m.verdict").isin("hit", "review"), F.col("m.first_turn")).alias("turn_index"),
    )


def node_scores(requirements: DataFrame, keys: tuple[str, ...] = ("dialogue_id", "node_id"), branches: DataFrame | None = None) -> DataFrame:
    """Weighted mean of the required requirements; state and first turn.

    A node whose requirements are all optional has 1, one without any 0. Of several required ones, one of score zero caps the node.
    ``branches`` (dialogue_id, node_id, trigger_turn, handled): a branch of score zero that was handled is satisfied, and a satisfied
    node without a hit begins at its trigger.
    """
    required = F.col("required")
    real = F.col("requirement_id").isNotNull() if "requirement_id" in requirements.columns else F.lit(True)
    mean = F.sum(F.when(required, F.col("score") * F.col("weight"))) / F.sum(F.when(required, F.col("weight")))
    out = requirements.groupBy(*keys).agg(
        mean.alias("mean"),
        F.sum(real.cast("int")).alias("n"),
        F.sum((required & (F.col("score") <= 1e-4)).cast("int")).alias("n_zero"),
        F.min("turn_index").alias("first_hit_turn"),
        F.sum((required & ~F.col("matched")).cast("int")).alias("missing_required"),
        F.sum(required.cast("int")).alias("n_required"),
    )
    score = F.when(F.col("n_required") > 0, F.col("mean")).when(F.col("n") > 0, 1.0).otherwise(0.0)
    trigger = F.lit(None).cast("int")
    if branches is not None:
        out = out.join(branches, list(keys), "left")
        score, trigger = F.when((score == 0) & F.coalesce("handled", F.lit(False)), SATISFIED).otherwise(score), F.col("trigger_turn")
    out = out.withColumn("score", F.when((F.col("n_zero") > 0) & (F.col("n_required") > 1), F.least(score, F.lit(ZERO_CAP))).otherwise(score))
    state = F.when(F.col("score") >= SATISFIED, DONE).when(F.col("score") >= PARTLY, PARTIAL).otherwise(MISSING)
    first = F.coalesce("first_hit_turn", F.when(F.col("score") >= SATISFIED, trigger))
    return out.withColumn("status", state).withColumn("first_hit_turn", first).select(*keys, "first_hit_turn", "missing_required", "n_required", "score", "status")


def is_active(mode: Column, node_type: Column, required: Column, trigger: Column, local: Column, incoming: Column, unconditional: Column, conditional: Column) -> Column:
    """Whether a node takes part: by mode, type, trigger, local evidence and incoming edges; terminal nodes only by their trigger."""
    main = node_type.isin(*MAINLINE)
    t = F.when(node_type == "terminal", trigger).otherwise(trigger | (local & node_type.isin("faq", "out_of_scope")))
    promoted = main & required & ((unconditional & ~conditional) | ~incoming)
    return (
        F.when(mode == "optional", t)
        .when(mode.isin("user_triggered", "condition"), t | promoted)
        .when(mode == "always", main | t)
        .otherwise(main | t)
    )


CONDITIONAL = ("condition_on", "branch_choice", "optional_after")


def incoming_edges(edges: DataFrame) -> DataFrame:
    """(node_id, n_incoming, conditional, unconditional) of the targets of edges."""
    conditional = F.col("kind").isin(*CONDITIONAL)
    return edges.groupBy(F.col("target").alias("node_id")).agg(
        F.count("*").alias("n_incoming"), F.bool_or(conditional).alias("conditional"), F.bool_or(~conditional).alias("unconditional")
    )


def closure(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(source, target) of all that can be reached, without the source itself; on a cycle each pair is found once."""
    # Metadata: the pairs of one catalogue's nodes, worked out where the plan is made.
    behind: dict[str, set[str]] = {}
    for row in edges.select("source", "target").distinct().collect():
        behind.setdefault(row.source, set()).add(row.target)
    pairs = []
    for source in behind:
        seen, waiting = {source}, [source]
        while waiting:
            new = behind.get(waiting.pop(), set()) - seen
            seen |= new
            waiting += new
        pairs += [(source, target) for target in seen - {source}]
        if len(pairs) > MAX_PAIRS:
            raise ValueError(f"more than {MAX_PAIRS} pairs of nodes, which are broadcast")
    return local_table(spark, sorted(pairs), "source string, target string")


def node_results(scores: DataFrame, nodes: DataFrame, matches: DataFrame, edges: DataFrame, suppressed: DataFrame | None = None, local: DataFrame | None = None) -> DataFrame:
    """``scores`` with active and, for inactive or suppressed nodes, score 1 and no state.

    ``local`` (dialogue_id, node_id): nodes of which one requirement is clearly hit; without it, those of a high score.
    """
    fired = matches.where("verdict = 'hit'").select("dialogue_id", F.col("rule_id").alias("trigger_rule"), F.lit(True).alias("fired"))
    rows = scores.join(F.broadcast(nodes), "node_id").join(fired, ["dialogue_id", "trigger_rule"], "left")
    rows = rows.join(F.broadcast(incoming_edges(edges)), "node_id", "left")
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    near = F.col("score") >= LOCAL_HIT
    if local is not None:
        rows, near = rows.join(local.select("dialogue_id", "node_id", F.lit(True).alias("near")), ["dialogue_id", "node_id"], "left"), no("near")
    active = is_active(F.col("mode"), F.col("node_type"), F.col("required"), no("fired"), near, F.col("n_incoming").isNotNull(), no("unconditional"), no("conditional"))
    rows = rows.withColumn("active", active)
    if suppressed is not None:
        gone = suppressed.select("dialogue_id", "node_id", F.lit(True).alias("gone"))
        rows = rows.join(gone, ["dialogue_id", "node_id"], "left").withColumn("active", F.col("active") & ~no("gone")).drop("gone")
    on = F.col("active")
    return rows.select(
        "dialogue_id", "node_id", "active",
        F.when(on, F.col("score")).otherwise(F.lit(1.0)).alias("score"),
        F.when(on, F.col("status")).otherwise(F.lit(INACTIVE)).alias("status"),
        F.when(on, F.col("first_hit_turn")).alias("first_hit_turn"),
        F.when(on, F.col("missing_required")).otherwise(F.lit(0)).alias("missing_required"),
        F.when(on, F.col("n_required")).otherwise(F.lit(0)).alias("n_required"),
    )


def suppressed_by_terminals(results: DataFrame, edges: DataFrame, reach: DataFrame, triggers: DataFrame | None = None) -> DataFrame:
    """(dialogue, node) that a reached terminal or suppressing step ends: those an edge names (its column suppress), otherwise all behind
    its target, but not the edge's own ends.

    A step is reached if it is active and has a first turn or at least a part of its score. A terminal edge asks for its target, which the
    user's words have to have triggered (``triggers``: dialogue_id, node_id); a suppressing one for either end.
    """
    ends = edges.where(F.col("kind").isin("terminal_after", "suppress_after"))
    named = F.col("suppress") if "suppress" in edges.columns else F.array().cast("array<string>")
    ends = F.broadcast(ends.select("source", "target", "kind", named.alias("named"), F.explode(F.when(F.col("kind") == "terminal_after", F.array("target")).otherwise(F.array("source", "target"))).alias("by")))
    begun = F.col("first_hit_turn").isNotNull() | (F.col("score") >= PARTLY if "score" in results.columns else F.lit(False))
    hit = results.where(F.col("active") & begun).select("dialogue_id", F.col("node_id").alias("by"))
    if triggers is not None:
        hit = hit.join(triggers.select("dialogue_id", F.col("node_id").alias("by"), F.lit(True).alias("asked")), ["dialogue_id", "by"], "left")
        reached = hit.join(ends, "by").where("asked OR kind = 'suppress_after'")
    else:
        reached = hit.join(ends, "by")
    behind = F.broadcast(reach.groupBy(F.col("source").alias("target")).agg(F.collect_list("target").alias("behind")))
    rows = reached.join(behind, "target", "left")
    gone = F.when(F.size("named") > 0, F.col("named")).otherwise(F.coalesce("behind", F.array().cast("array<string>")))
    return rows.select("dialogue_id", "source", "target", F.explode(gone).alias("node_id")).where("node_id <> source AND node_id <> target").select("dialogue_id", "node_id").distinct()
