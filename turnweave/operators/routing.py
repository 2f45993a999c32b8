"""Grey-zone candidates: representatives, the second filter, the budget, arbitration."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.sources.shared import join_counted, stored_with

# Gates of schema, evidence and margin scores.
NOISE, WEAK, GATE = (0.30, 0.25, 0.35), (0.55, 0.45), (0.80, 0.58, 0.70)


def top_per_dialogue(candidates: DataFrame, k: int = 3) -> DataFrame:
    """The best ``k`` of each dialogue by (source, need, strength), one per key."""
    order = [F.col("source"), F.col("need").desc(), F.col("strength").desc(), F.col("candidate_id")]
    once = candidates.withColumn("n", F.row_number().over(Window.partitionBy("dialogue_id", "route_key").orderBy(*order))).where("n = 1")
    return once.withColumn("place", F.row_number().over(Window.partitionBy("dialogue_id").orderBy(*order))).where(F.col("place") <= k).drop("n")


def representatives(candidates: DataFrame) -> DataFrame:
    """``candidates`` with merged_into (null for a representative) and merged_count, by route_key in order of priority.

    Representatives are found by aggregation, stored and joined back; a frequent key is dealt to many tasks.
    """
    order = F.struct(F.col("priority"), F.col("candidate_id"))
    keyed = candidates.withColumn("_key", F.xxhash64("route_key"))
    best, seen = stored_with(keyed.groupBy("route_key", "_key").agg(F.min(order).alias("best"), F.count("*").alias("n")), F.sum("n").alias("rows"), F.max("n").alias("most"))
    named = best.withColumnRenamed("route_key", "_same")
    out = join_counted(keyed, named, ["_key"], ["candidate_id"], seen["rows"] or 0, seen["most"] or 0).where(F.col("route_key").eqNullSafe(F.col("_same")))
    out = out.withColumn("merged_into", F.when(F.col("candidate_id") != F.col("best.candidate_id"), F.col("best.candidate_id")))
    return out.withColumnRenamed("n", "merged_count").drop("best", "_key", "_same")


def diverse_budget(candidates: DataFrame, budget: int, bucket: list[str]) -> DataFrame:
    """The ``budget`` rows that turns over the buckets choose, buckets by their best rank, in a bucket by rank.

    The k-th round takes the k-th of each bucket, and so a sort by (place in the bucket,
    best rank of the bucket) is the order of choice; only ``budget`` rows of a bucket can count.
    """
    by = Window.partitionBy(*bucket).orderBy("rank")
    placed = candidates.withColumn("round", F.row_number().over(by)).where(F.col("round") <= budget)
    placed = placed.withColumn("first", F.min("rank").over(Window.partitionBy(*bucket)))
    return placed.orderBy("round", "first").limit(budget).drop("first")


def margin(need: Column, strength: Column) -> Column:
    return 0.55 * need + 0.45 * strength


def second_filter(candidates: DataFrame) -> DataFrame:
    """``candidates`` with decision; the first rule that applies decides.

    Columns: promoted, forced_review, same_support, insufficient_only, open_set, has_evidence
    (booleans), schema_score, evidence_score, need, strength.
    """
    schema, evidence = F.col("schema_score"), F.col("evidence_score")
    m = margin(F.col("need"), F.col("strength"))
    gate = (schema >= GATE[0]) & (evidence >= GATE[1]) & (m >= GATE[2])
    gated = F.when(gate, "route_to_arbiter").otherwise("keep_local_low_value")
    decision = (
        F.when(F.col("promoted"), "local_strict")
        .when(F.col("forced_review"), gated)
        .when(F.col("same_support"), "merged_local_no_issue")
        .when(F.col("insufficient_only"), "merged_low_value")
        .when((schema < NOISE[0]) | (evidence < NOISE[1]) | ~F.col("has_evidence") | (evidence < NOISE[2]), "ignore_noise")
        .when(F.col("open_set"), "keep_local_open_set")
        .when((schema < WEAK[0]) | (evidence < WEAK[1]), "ignore_weak_anchor")
        .otherwise(gated)
    )
    return candidates.withColumn("margin", m).withColumn("decision", decision)


def replay(candidates: DataFrame, answers: DataFrame) -> DataFrame:
    """``candidates`` with verdict and confidence of recorded answers; without one: uncertain. Merged ones get their representative's."""
    a = answers.select("candidate_id", F.col("verdict").alias("a_verdict"), F.col("confidence").alias("a_confidence"))
    rows = candidates.withColumn("asked", F.coalesce("merged_into", "candidate_id"))
    rows = rows.join(a.withColumnRenamed("candidate_id", "asked"), "asked", "left").drop("asked")
    return rows.withColumn("verdict", F.coalesce("a_verdict", F.lit("uncertain"))).withColumn("confidence", F.coalesce("a_confidence", F.lit(0.0))).drop("a_verdict", "a_confidence")


def arbitrate(candidates: DataFrame, arbiter: Callable[[list[dict]], list[dict]], batch: int = 8, attempts: int = 2) -> DataFrame:
    """candidate_id, verdict, confidence and failure of a pluggable arbiter, ``batch`` candidates a call.

    A call that fails with an ``OSError`` or ``ValueError`` (the service, or its answer) is tried again, then each candidate alone;
    one that still fails is uncertain, and failure says why. Other errors are the arbiter's own, and end the job.
    """

    def asked(part: list[dict]) -> tuple[dict, str | None]:
        reason = None
        for _ in range(attempts):
            try:
                return {x["candidate_id"]: x for x in arbiter(part)}, None
            except (OSError, ValueError) as error:
                reason = f"{type(error).__name__}: {error}"
        return {}, reason

    def judged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = frame.to_dict("records")
            found = []
            for i in range(0, len(rows), batch):
                part = rows[i : i + batch]
                answers, reason = asked(part)
                for row in part:
                    own, failure = (answers, None) if reason is None else asked([row])
                    x = own.get(row["candidate_id"], {})
                    found.append((row["candidate_id"], x.get("verdict", "uncertain"), float(x.get("confidence", 0.0)), failure))
            yield pd.DataFrame(found, columns=["candidate_id", "verdict", "confidence", "failure"])

    return candidates.mapInPandas(judged, "candidate_id string, verdict string, confidence double, failure string")
