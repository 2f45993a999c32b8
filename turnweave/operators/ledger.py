"""What was found about each dialogue, as rows: losses, the same evidence twice, misses, warnings, purity of labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.cues import error_family
from turnweave.functions.text import compact
from turnweave.operators.judges import CONFLICT, SAFE, SUPPORT, UNSURE, VIOLATION
from turnweave.operators.nodes import MISSING, PARTIAL
from turnweave.operators.scoring import severity_penalty


def losses(steps: DataFrame, edges: DataFrame, checks: DataFrame, limits: DataFrame) -> DataFrame:
    """(dialogue, family, target, verdict, loss) of all that took points away; steps lose what their score lacks of 100."""
    lacking = steps.where(F.col("active") & F.col("status").isin(MISSING, PARTIAL))
    flow = lacking.select("dialogue_id", F.lit("flow").alias("family"), F.col("node_id").alias("target"), F.col("status").alias("verdict"), (100.0 * (1 - F.col("score"))).alias("loss"))
    order = edges.where("penalty > 0").select("dialogue_id", F.lit("relation"), F.concat_ws("->", "source", "target"), "kind", "penalty")
    bad = lambda rows, key, verdict, kind: rows.where(F.col("verdict") == verdict).select("dialogue_id", F.lit(kind), key, "verdict", severity_penalty(F.col("severity"), kind))
    return flow.union(order).union(bad(checks, "fact_id", CONFLICT, "knowledge")).union(bad(limits, "constraint_id", VIOLATION, "constraint"))


def evidence_ledger(checks: DataFrame, limits: DataFrame, events: DataFrame, steps: DataFrame) -> DataFrame:
    """(dialogue, family, target, verdict, turn_index, effect) of everything that was judged, good and bad: facts, constraints, policies and steps.

    effect: against, for or open.
    """
    against, for_ = (CONFLICT, VIOLATION, MISSING, PARTIAL, "触发但未处理", "已处理但后续违背转场"), (SUPPORT, SAFE, "已完成", "已处理")
    effect = F.when(F.col("verdict").isin(*against), "against").when(F.col("verdict").isin(*for_), "for").otherwise("open")
    part = lambda rows, family, target, turn, verdict="verdict": rows.select("dialogue_id", F.lit(family).alias("family"), F.col(target).alias("target"), F.col(verdict).alias("verdict"), F.col(turn).alias("turn_index"))
    out = part(checks, "knowledge", "fact_id", "turn_index").unionByName(part(limits, "constraint", "constraint_id", "turn_index"))
    out = out.unionByName(part(events, "context", "policy_id", "trigger_turn", "status")).unionByName(part(steps.where("active"), "flow", "node_id", "first_hit_turn", "status"))
    return out.withColumn("effect", effect)


def element_digest(audit: DataFrame, most: int = 6) -> DataFrame:
    """(dialogue, rule_id, verdict, n_hit, n_missing, hits, missing) of rows (dialogue, rule, verdict, value, is_hit): what was and was not met, joined and cut."""
    some = lambda hit: F.filter(F.sort_array(F.collect_set(F.when(F.col("is_hit") == hit, F.col("value")))), lambda x: x.isNotNull())
    out = audit.groupBy("dialogue_id", "rule_id", "verdict").agg(some(True).alias("h"), some(False).alias("m"))
    shown = lambda c: F.array_join(F.slice(c, 1, most), ",")
    return out.select("dialogue_id", "rule_id", "verdict", F.size("h").alias("n_hit"), F.size("m").alias("n_missing"), shown("h").alias("hits"), shown("m").alias("missing"))


def same_evidence(candidates: DataFrame, ledger: DataFrame) -> DataFrame:
    """``candidates`` (candidate_id, dialogue_id, family, evidence array) with relation to what the ledger
    (dialogue_id, family, verdict, evidence) says of the same evidence: issue, support, insufficient_only, neutral or unknown."""
    keyed = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", "")
    asked = candidates.select("candidate_id", "dialogue_id", "family", F.explode(F.array_distinct(F.transform("evidence", keyed))).alias("key")).where("key <> ''")
    said = ledger.select("dialogue_id", "family", F.trim(F.coalesce("verdict", F.lit(""))).alias("verdict"), keyed(F.col("evidence")).alias("key")).distinct()
    has = lambda *names: F.coalesce(F.bool_or(F.col("verdict").isin(*names)), F.lit(False))
    found = asked.join(said, ["dialogue_id", "family", "key"]).groupBy("candidate_id").agg(
        F.when(has(CONFLICT, VIOLATION), "issue")
        .when(has(SUPPORT, SAFE, "已处理"), "support")
        .when(F.bool_and(F.col("verdict").isin(UNSURE, "未提及", "")), "insufficient_only")
        .otherwise("neutral")
        .alias("relation")
    )
    return candidates.join(found, "candidate_id", "left").withColumn("relation", F.coalesce("relation", F.lit("unknown")))


def miss_audit(reconciled: DataFrame) -> DataFrame:
    """(family, n_expected, n_missed): expected errors and those no event explains."""
    return reconciled.groupBy("family").agg(F.count("*").alias("n_expected"), F.sum((~F.col("matched")).cast("int")).cast("bigint").alias("n_missed"))


def top_unexpected(surplus: DataFrame, k: int = 50) -> DataFrame:
    """The ``k`` most frequent (family, event_target) that no label explains."""
    return surplus.groupBy("family", "event_target").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "family", "event_target").limit(k)


def decision_counts(filtered: DataFrame) -> DataFrame:
    return filtered.groupBy("decision").agg(F.count("*").alias("n"))


def warnings(records: DataFrame, low: float = 10.0) -> DataFrame:
    """(warning, domain, n): several domains in one report; domains all of whose positives fail with low step scores."""
    domains = records.agg(F.count_distinct("domain").alias("n")).where("n > 1").select(F.lit("several_domains").alias("warning"), F.lit(None).cast("string").alias("domain"), "n")
    positive = records.where("sample_type = 'positive'").groupBy("domain").agg(F.count("*").alias("n"), F.bool_or("passed").alias("some"), F.avg("node_completion").alias("mean"))
    failing = positive.where(~F.col("some") & (F.col("mean") < low)).select(F.lit("all_positives_fail"), "domain", "n")
    return domains.union(failing)


def nothing_matched(negatives: DataFrame) -> DataFrame:
    """(warning, n) where negative samples expect errors and not one is found: their ids and the graph's do not belong together.

    ``negatives``: n_matched and n_open (missing or left to arbitration) of each negative dialogue.
    """
    found = negatives.agg(F.count("*").alias("n"), F.sum("n_matched").alias("matched"), F.sum("n_open").alias("open"))
    return found.where("matched = 0 AND open > 0").select(F.lit("nothing_matched").alias("warning"), "n")


def grey_share(dialogues: DataFrame, most: float = 0.12) -> DataFrame:
    """(n, n_grey, share, too_many) of negative dialogues (sample_type, grey) that may be left to arbitration."""
    out = dialogues.where(F.lower("sample_type").isin("negative", "负包")).agg(F.count("*").alias("n"), F.sum(F.coalesce(F.col("grey"), F.lit(False)).cast("int")).cast("bigint").alias("n_grey"))
    share = F.when(F.col("n") > 0, F.col("n_grey") / F.col("n")).otherwise(F.lit(0.0))
    return out.select("n", "n_grey", share.alias("share"), (share > most).alias("too_many"))


def domain_scores(dialogues: DataFrame, instruction: str, first: int = 28, least: float = 0.06, lead: float = 1.25) -> DataFrame:
    """(domain, score, selected) of the cosine of pairs of characters and words between an instruction and the
    ``first`` dialogues of each domain (domain, place, text); the best is selected if it is clear."""

    def grams(text: Column) -> Column:
        tight = F.regexp_replace(text, r"[^\p{L}\p{N}]+", "")
        pairs = F.when(F.length(tight) >= 2, F.transform(F.sequence(F.lit(1), F.length(tight) - 1), lambda i: F.substring(tight, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))
        return F.array_distinct(F.concat(pairs, F.regexp_extract_all(F.lower(text), F.lit("[A-Za-z0-9$]+"), F.lit(0))))

    named = dialogues.where("domain IS NOT NULL AND trim(domain) <> ''")
    head = named.withColumn("n", F.row_number().over(Window.partitionBy("domain").orderBy("place"))).where(F.col("n") <= first)
    own = head.select("domain", F.explode(grams(F.coalesce("text", F.lit("")))).alias("g")).distinct()
    wanted = own.sparkSession.range(1).select(grams(F.lit(instruction)).alias("wanted"))
    rows = own.crossJoin(F.broadcast(wanted)).groupBy("domain").agg(
        F.sum(F.array_contains("wanted", F.col("g")).cast("int")).alias("common"), F.count("*").alias("n"), F.max(F.size("wanted")).alias("m")
    )
    scored = rows.select("domain", (F.col("common") / (F.sqrt(F.col("n").cast("double")) * F.sqrt(F.col("m").cast("double")))).alias("score"))
    # One row per domain: the best two are found by aggregation, not in a window over all.
    best = scored.agg(F.max("score").alias("best"), F.sort_array(F.collect_list("score"), asc=False).alias("all"))
    clear = (F.col("score") == F.col("best")) & (F.col("best") >= least) & (F.coalesce(F.get("all", F.lit(1)), F.lit(0.0)) * lead <= F.col("best"))
    return scored.crossJoin(F.broadcast(best)).select("domain", "score", clear.alias("selected"))


def impure_labels(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, error_ord, issue) of negative dialogues whose labels lack a target or an evidence that the assistant says.

    ``dialogues``: dialogue_id, sample_type, turns array<struct<speaker, text>>, injected_errors
    array<struct<error_family, knowledge_id, constraint_id, node_id, requirement_id, evidence_span, wrong_statement>>.
    """
    own = F.array_join(F.transform(F.filter("turns", lambda t: t["speaker"].isin("assistant", "客服")), lambda t: F.coalesce(t["text"], F.lit(""))), "")
    rows = dialogues.where("sample_type = 'negative'").select("dialogue_id", compact(own).alias("said"), F.posexplode_outer("injected_errors").alias("error_ord", "e"))
    family, blank = error_family(F.col("e.error_family")), lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    span = compact(F.coalesce(F.when(~blank("e.evidence_span"), F.col("e.evidence_span")), F.col("e.wrong_statement")))
    spoken = family.isin("knowledge_violation", "constraint_violation")
    issues = F.array(
        F.when(F.col("e").isNull(), "no_labels"),
        F.when((family == "knowledge_violation") & blank("e.knowledge_id"), "no_knowledge_id"),
        F.when((family == "constraint_violation") & blank("e.constraint_id"), "no_constraint_id"),
        F.when((family == "flow_missing") & blank("e.node_id"), "no_node_id"),
        F.when((family == "flow_missing") & blank("e.requirement_id"), "no_requirement_id"),
        F.when(spoken & (span == ""), "no_span"),
        F.when(spoken & (span != "") & ~F.contains(F.col("said"), span), "span_not_said"),
    )
    return rows.select("dialogue_id", "error_ord", F.explode(F.array_compact(issues)).alias("issue"))
