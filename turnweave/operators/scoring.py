"""Component scores, their caps, the weighted total and its cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights, penalties by severity, and the caps of scores.
WEIGHTS = {"node_completion": 0.5, "relation_score": 0.1, "knowledge_score": 0.2, "constraint_score": 0.15, "soft_score": 0.05}
PENALTIES = {"low": 5.0, "medium": 12.0, "high": 28.0, "critical": 45.0}
KNOWLEDGE_SHARE = 0.8
CAPS = {
    "flow_single": 66.0, "flow_multiple": 58.0, "context": 62.0, "context_combined": 52.0, "combined": 42.0,
    "knowledge": (68.0, 60.0, 52.0, 48.0),
    "constraint": (62.0, 54.0, 46.0, 38.0),
}


def severity_rank(severity: Column) -> Column:
    """1 to 4; unknown ones count as medium."""
    return F.when(severity == "low", 1).when(severity == "high", 3).when(severity == "critical", 4).otherwise(2)


def severity_penalty(severity: Column, kind: str) -> Column:
    out = F.lit(PENALTIES["medium"])
    for name, value in PENALTIES.items():
        out = F.when(severity == name, F.lit(value)).otherwise(out)
    return out * (KNOWLEDGE_SHARE if kind == "knowledge" else 1.0)


def event_scores(events: DataFrame, kind: str) -> DataFrame:
    """(dialogue, score, worst, n) of the bad events of a kind: 100 less their penalties."""
    worst = F.max(severity_rank(F.col("severity")))
    score = F.greatest(F.lit(0.0), 100.0 - F.sum(severity_penalty(F.col("severity"), kind)))
    return events.groupBy("dialogue_id").agg(score.alias(f"{kind}_score"), worst.alias(f"{kind}_worst"), F.count("*").alias(f"n_{kind}"))


def _by_rank(rank: Column, caps: tuple[float, ...]) -> Column:
    out = F.lit(None).cast("double")
    for i, cap in enumerate(caps):
        out = F.when(rank == i + 1, F.lit(cap)).otherwise(out)
    return out


def totals(rows: DataFrame) -> DataFrame:
    """Capped components, the total and the cap that held it.

    ``rows``: node_completion, relation_score, knowledge_score, constraint_score, soft_score,
    knowledge_worst, constraint_worst (0: no event), missing_nodes, missing_required,
    n_required, context_problem.
    """
    missing = (F.col("missing_nodes") > 0) | (F.col("missing_required") > 0)
    many = (F.col("missing_nodes") >= 2) | (F.col("missing_required") >= 2) | (F.col("missing_required") / F.greatest(F.lit(1), F.col("n_required")) >= 0.25)
    flow = F.when(missing, F.when(many, F.lit(CAPS["flow_multiple"])).otherwise(F.lit(CAPS["flow_single"])))
    knowledge, constraint = _by_rank(F.col("knowledge_worst"), CAPS["knowledge"]), _by_rank(F.col("constraint_worst"), CAPS["constraint"])
    context = F.col("context_problem")
    families = missing.cast("int") + (F.col("knowledge_worst") > 0).cast("int") + (F.col("constraint_worst") > 0).cast("int") + context.cast("int")
    capped = {
        "node_completion": F.least("node_completion", flow),
        "relation_score": F.least("relation_score", F.when(context, F.lit(CAPS["context"]))),
        "knowledge_score": F.least("knowledge_score", knowledge),
        "constraint_score": F.least("constraint_score", constraint),
        "soft_score": F.col("soft_score"),
    }
    of_context = F.when(context, F.when(families >= 2, F.lit(CAPS["context_combined"])).otherwise(F.lit(CAPS["context"])))
    cap = F.least(F.lit(1e9), flow, knowledge, constraint, of_context, F.when(families >= 2, F.lit(CAPS["combined"])))
    # The cap is taken from the events, before components replace their columns.
    out = rows.withColumn("cap", F.when(cap < 1e9, cap))
    out = out.select(*[c for c in out.columns if c not in capped], *[x.alias(c) for c, x in capped.items()])
    weighted = sum((F.col(c) * w for c, w in WEIGHTS.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    return out.withColumn("uncapped", weighted).withColumn("total", F.least("uncapped", "cap"))


def soft_ratio(hits: Column, n: Column, direction: str, low: float, high: float) -> Column:
    """Score 0 to 1 of a share: higher or lower is better, or inside a range."""
    share = F.when(n > 0, hits / n).otherwise(F.lit(0.0))
    if direction == "higher":
        return F.least(F.lit(1.0), share / max(high, 1e-9))
    if direction == "lower":
        return F.when(share <= low, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - (share - low) / max(1e-9, 1 - low)))
    return F.when((share >= low) & (share <= high), F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), 1 - F.greatest(low - share, share - high)))
