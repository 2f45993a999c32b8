"""Why an expected error was missed, where evidence stands in a dialogue, and to what a label belongs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.cues import error_family
from turnweave.functions.text import bigrams, overlap_coefficient
from turnweave.operators.judges import CONFLICT, SUPPORT, VIOLATION

# How many are shown of each kind, the similarity that counts as near, and thresholds of bindings.
CHECKS, FLOWS, SAYINGS, NEAR = 6, 8, 5, 0.08
SURE, HINTED, LEAD, TABLE_LEAD, SAME_NODE = 0.65, 0.18, 1.15, 1.10, 0.35


def label_tokens(text: Column | str) -> Column:
    """The tokens of a label: its parts, pairs of Chinese characters, single ones of short runs, Latin words."""
    a = F.lower(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")))
    parts = F.filter(F.split(a, r"[^A-Za-z0-9一-鿿]+"), lambda x: x != "")
    runs = F.regexp_extract_all(a, F.lit("[一-鿿]+"), F.lit(0))
    # Of a run its pairs, and if it is short its characters; runs are cut out once.
    cut = F.transform(runs, lambda x: F.concat(bigrams(x), F.when(F.length(x) <= 4, F.split(x, "")).otherwise(F.array().cast("array<string>"))))
    return F.array_distinct(F.filter(F.concat(parts, F.flatten(cut), F.regexp_extract_all(a, F.lit("[a-z0-9]+"), F.lit(0))), lambda x: x != ""))


def label_profile(text: Column | str) -> Column:
    """What labels are compared by: tokens and pairs of characters. It is to be a column of each side before they are joined, so that it is
    worked out once a label and not once a pair."""
    return F.struct(label_tokens(text).alias("tokens"), bigrams(text).alias("pairs"))


def label_similarity(a: Column | str, b: Column | str) -> Column:
    """Of two columns of ``label_profile``: common tokens by the smaller set; without a common one, common pairs of characters."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    x, y = a["tokens"], b["tokens"]
    own = overlap_coefficient(x, y)
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).when(own > 0, own).otherwise(overlap_coefficient(a["pairs"], b["pairs"]))


def nearest(errors: DataFrame, rows: DataFrame, k: int, key: str = "dialogue_id") -> DataFrame:
    """(error_id, place, target, verdict, similarity): of each error the ``k`` rows of its dialogue (target, verdict, label) most like its hint."""
    hints, labels = errors.select(key, "error_id", label_profile("hint").alias("h")), rows.select(key, "target", "verdict", label_profile("label").alias("l"))
    met = hints.join(labels, key).select("error_id", "target", "verdict", label_similarity("h", "l").alias("similarity"))
    by = Window.partitionBy("error_id").orderBy(F.desc("similarity"), "target", "verdict")
    return met.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("error_id", "place", "target", "verdict", "similarity")


def miss_causes(errors: DataFrame, checks: DataFrame, limits: DataFrame, flows: DataFrame) -> DataFrame:
    """(error_id, family, cause, nearest, similarity) of errors (dialogue_id, error_id, family, hint) that no event explains.

    checks, limits: (dialogue_id, target, verdict, label) of facts and constraints; flows: the same of requirements, with the
    verdict matched or not. cause: no_rows, not_aligned (something bad was found, under another name), nothing_near, right_side_only,
    unsure, met_anyway or really_missing.
    """
    family = error_family("family")
    parts = []
    for name, rows, k, bad in (("knowledge_violation", checks, CHECKS, CONFLICT), ("constraint_violation", limits, CHECKS, VIOLATION), ("flow_missing", flows, FLOWS, "missing")):
        own = errors.where(family == name) if name != "flow_missing" else errors.where(~family.isin("knowledge_violation", "constraint_violation"))
        found = nearest(own, rows, k).groupBy("error_id").agg(F.bool_or(F.col("verdict") == bad).alias("any_bad"), F.min_by(F.struct("target", "verdict", "similarity"), "place").alias("top"))
        out = own.join(found, "error_id", "left")
        far = F.col("top.similarity") < NEAR
        if name == "flow_missing":
            cause = F.when(F.col("top").isNull() | far, "nothing_near").when(F.col("top.verdict") == bad, "really_missing").otherwise("met_anyway")
        else:
            cause = F.when(F.col("top").isNull(), "no_rows").when(F.col("any_bad"), "not_aligned").when(far, "nothing_near").when(F.col("top.verdict") == SUPPORT, "right_side_only").otherwise("unsure")
        parts.append(out.select("error_id", F.lit(name).alias("family"), cause.alias("cause"), F.col("top.target").alias("nearest"), F.coalesce("top.similarity", F.lit(0.0)).alias("similarity")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def assistant_sayings(errors: DataFrame, turns: DataFrame, k: int = SAYINGS) -> DataFrame:
    """(error_id, place, turn_index, similarity): the assistant's turns most like an error's hint."""
    hints = errors.select("dialogue_id", "error_id", label_profile("hint").alias("h"))
    said = turns.where("speaker = 'assistant'").select("dialogue_id", "turn_index", label_profile("text").alias("t"))
    met = hints.join(said, "dialogue_id").select("error_id", "turn_index", label_similarity("h", "t").alias("similarity")).where("similarity > 0")
    by = Window.partitionBy("error_id").orderBy(F.desc("similarity"), "turn_index")
    return met.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k).select("error_id", "place", "turn_index", "similarity")


def span_turns(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """(dialogue, span_id, turn_index, exact): the first turn that holds a text, or without white space, of (dialogue_id, span_id, span)."""
    tight = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"(?U)\s+", "")
    met = spans.where("trim(span) <> ''").join(turns, "dialogue_id").withColumn("exact", F.contains("text", F.col("span"))).where(F.col("exact") | F.contains(tight("text"), tight("span")))
    best = met.groupBy("dialogue_id", "span_id").agg(F.min(F.struct((~F.col("exact")).alias("loose"), "turn_index")).alias("m"))
    return best.select("dialogue_id", "span_id", F.col("m.turn_index").alias("turn_index"), (~F.col("m.loose")).alias("exact"))


def nearby_lines(points: DataFrame, turns: DataFrame, reach: int = 2) -> DataFrame:
    """(dialogue, turn_index, lines): the assistant's turns around a place, in order, joined."""
    around = points.select("dialogue_id", "turn_index", F.explode(F.sequence(F.col("turn_index") - reach, F.col("turn_index") + reach)).alias("at")).distinct()
    own = turns.where("speaker = 'assistant'").select("dialogue_id", F.col("turn_index").alias("at"), "text")
    lines = F.transform(F.sort_array(F.collect_list(F.struct("at", "text"))), lambda x: F.concat(F.lit("第"), x["at"].cast("string"), F.lit("轮："), x["text"]))
    return around.join(own, ["dialogue_id", "at"]).groupBy("dialogue_id", "turn_index").agg(F.array_join(lines, " / ").alias("lines"))


def bound_labels(labels: DataFrame, targets: DataFrame) -> DataFrame:
    """(label_id, target_id, score) of labels (label_id, node, core, hint) and what they are most like of targets (metadata: target_id,
    node, anchor): a sure one, or with a hint a fair one that leads the second clearly. A label that names a target is bound to it."""
    known = F.broadcast(targets.select("target_id", label_profile("anchor").alias("t")))
    hinted = F.coalesce("hint", F.lit("")) != ""
    rows = labels.select("label_id", "node", hinted.alias("hinted"), *[label_profile(c).alias(c[0]) for c in ("node", "core", "hint")]).join(known, F.lit(True))
    score = F.greatest(label_similarity("n", "t"), 0.8 * label_similarity("c", "t"), label_similarity("h", "t"))
    rows = rows.select("label_id", "target_id", "hinted", F.when(F.col("node") == F.col("target_id"), F.lit(2.0)).otherwise(score).alias("score"))
    by = Window.partitionBy("label_id").orderBy(F.desc("score"), "target_id")
    rows = rows.withColumn("place", F.row_number().over(by)).withColumn("second", F.lead("score").over(by)).where("place = 1")
    clear = (F.coalesce("second", F.lit(0.0)) <= 1e-4) | (F.col("score") >= F.col("second") * LEAD)
    held = (F.col("score") >= SURE) | (F.col("hinted") & (F.col("score") >= HINTED) & clear)
    return rows.where(held).select("label_id", "target_id", F.least("score", F.lit(1.0)).alias("score"))
