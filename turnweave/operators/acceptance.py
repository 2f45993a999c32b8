"""Acceptance of scored dialogues against labels; labels never reach the scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import bigrams, overlap_coefficient

# Floors of a positive sample.
PASS, SCENARIO_PASS = 90.0, 82.0
FLOORS = {"node_completion": 78.0, "relation_score": 70.0, "knowledge_score": 98.0, "constraint_score": 98.0}
ALIGNED = 0.12


def positive_passes(scores: DataFrame) -> DataFrame:
    """``scores`` with passed and the reasons against it, joined.

    Columns: total, the components of ``FLOORS``, scenario (has coverage targets), n_bad
    (conflicts and violations), missing_nodes, missing_required, context_problem.
    """
    floor = F.when(F.col("scenario"), SCENARIO_PASS).otherwise(PASS)
    tests: list[tuple[str, Column]] = [("total", F.col("total") < floor)]
    tests += [(name, F.col(name) < least) for name, least in FLOORS.items()]
    tests += [
        ("bad_event", F.col("n_bad") > 0),
        ("missing_node", F.col("missing_nodes") > 0),
        ("missing_requirement", F.col("missing_required") > 0),
        ("context", F.col("context_problem")),
    ]
    reasons = F.array_join(F.array_compact(F.array(*[F.when(failed, name) for name, failed in tests])), ",")
    return scores.withColumn("reasons", reasons).withColumn("passed", F.col("reasons") == "")


def same_id(expected: Column, actual: Column, aliases: Column) -> Column:
    """Whether an expected id names an event; an empty one names all."""
    return F.coalesce(expected, F.lit("")).isin("") | (expected == actual) | F.array_contains(aliases, expected)


def _aligned(span: Column, text: Column, least: float) -> Column:
    a, b = F.coalesce(span, F.lit("")), F.coalesce(text, F.lit(""))
    inside = (a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b))
    return inside | (overlap_coefficient(bigrams(a), bigrams(b)) >= least)


def reconcile(errors: DataFrame, events: DataFrame, least: float = 0.40) -> DataFrame:
    """``errors`` (dialogue_id, error_id, family, target_id, span) with matched: an event of the family has the id, or an evidence alike."""
    e = events.select("dialogue_id", F.col("family").alias("e_family"), F.col("event_target"), F.col("aliases"), F.col("evidence"))
    fits = (F.col("family") == F.col("e_family")) & (
        ((F.col("target_id") != "") & same_id(F.col("target_id"), F.col("event_target"), F.col("aliases"))) | _aligned(F.col("span"), F.col("evidence"), least)
    )
    joined = errors.join(e, "dialogue_id", "left")
    return joined.groupBy(*errors.columns).agg(F.coalesce(F.bool_or(fits), F.lit(False)).alias("matched"))


def unexpected(errors: DataFrame, events: DataFrame, least: float = ALIGNED) -> DataFrame:
    """The events that no expected error explains."""
    x = errors.select("dialogue_id", F.col("family").alias("x_family"), "target_id", "span")
    return (
        events.alias("e")
        .join(
            x.alias("x"),
            (F.col("e.dialogue_id") == F.col("x.dialogue_id"))
            & (
                ((F.col("x.target_id") != "") & same_id(F.col("x.target_id"), F.col("e.event_target"), F.col("e.aliases")))
                | ((F.col("x.x_family") == F.col("e.family")) & _aligned(F.col("x.span"), F.col("e.evidence"), least))
            ),
            "left_anti",
        )
    )


def negative_passes(reconciled: DataFrame, surplus: DataFrame, allowed: int = 0) -> DataFrame:
    """(dialogue, n_expected, n_matched, n_unexpected, passed): all errors found, or left to arbitration, and no more than allowed besides."""
    by = reconciled.groupBy("dialogue_id").agg(
        F.count("*").alias("n_expected"), F.sum(F.col("matched").cast("int")).alias("n_matched"), F.sum((F.col("matched") | F.col("eligible")).cast("int")).alias("n_covered")
    )
    more = surplus.groupBy("dialogue_id").agg(F.count("*").alias("n_unexpected"))
    out = by.join(more, "dialogue_id", "left").withColumn("n_unexpected", F.coalesce("n_unexpected", F.lit(0)))
    return out.withColumn("passed", (F.col("n_covered") == F.col("n_expected")) & (F.col("n_unexpected") <= allowed)).drop("n_covered")
