"""Operators over whole tables whose other queries run over literals.

Each has the SQL of the literal query with the relation of literals replaced by one that
conversations or documents give: predicates and lengths of texts stand for verdicts and scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators import judges, matching, nodes, scoring
from turnweave.plans import queries as base
from turnweave.plans.queries import SQL, query


def _rows(spark: SparkSession, sf_dir: str, relation: str, table: str = "conversations") -> DataFrame:
    read = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return spark.sql("SELECT * FROM " + relation.replace(f"FROM {table}", "FROM {" + table + "}"), **{table: read})


def _sql(name: str, literal: str, relation: str, *more: tuple[str, str]) -> str:
    out = SQL[name]
    for old, new in ((literal, relation), *more):
        if old not in out:
            raise ValueError(f"not in the SQL of {name}: {old}")
        out = out.replace(old, new)
    return out


TEXT = "coalesce(text, '')"
SIZE = f"length({TEXT})"
SAYS = f"contains({TEXT}, 'er')"
TURN = "CAST(conv_id AS STRING) AS dialogue_id, CAST(turn AS INTEGER) AS turn_index"


def _verdict(x: str) -> str:
    return f"CASE ({x}) % 3 WHEN 0 THEN 'hit' WHEN 1 THEN 'review' ELSE 'miss' END"


# Four turns of a role are a group; every turn decides, and those with the syllable support as well.
TURN_GROUPS = f"""(SELECT coalesce(role, '') AS rule_id, CAST(conv_id AS STRING) AS dialogue_id, CAST(turn - turn % 4 AS INTEGER) AS a_turn, 0 AS a_seq, CAST({SIZE} % 2 AS INTEGER) AS window_ord, decisive,
 {_verdict(SIZE)} AS verdict, ({SIZE} % 128) / 128e0 AS score FROM conversations CROSS JOIN (VALUES (true), (false)) AS d(decisive) WHERE decisive OR {SAYS}) AS t"""
TURN_REQUIREMENTS = f"""(SELECT {TURN.split(",")[0]}, coalesce(role, '') AS node_id, 1e0 + {SIZE} % 3 AS weight, {SIZE} % 2 = 0 AS required,
 CASE WHEN {SAYS} THEN ({SIZE} % 128) / 128e0 ELSE 0e0 END AS score, {SAYS} AS matched, CASE WHEN {SAYS} THEN CAST(turn AS INTEGER) END AS turn_index FROM conversations) AS t"""
TURN_EVENTS = f"(SELECT {TURN.split(',')[0]}, CASE {SIZE} % 5 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' WHEN 2 THEN 'high' WHEN 3 THEN 'critical' ELSE 'odd' END AS severity FROM conversations WHERE {SAYS}) AS t"
CHARS = "coalesce(n_chars, 0)"
DOCUMENT_SCORES = f"""(SELECT CAST(doc_id AS STRING) AS dialogue_id, CAST({CHARS} % 101 AS DOUBLE) AS node_completion, CAST({CHARS} * 7 % 101 AS DOUBLE) AS relation_score, CAST({CHARS} * 11 % 101 AS DOUBLE) AS knowledge_score,
 CAST({CHARS} * 13 % 101 AS DOUBLE) AS constraint_score, CAST({CHARS} * 17 % 101 AS DOUBLE) AS soft_score, CAST({CHARS} % 5 AS INTEGER) AS knowledge_worst, CAST({CHARS} * 3 % 5 AS INTEGER) AS constraint_worst,
 CAST({CHARS} % 4 AS INTEGER) AS missing_nodes, CAST({CHARS} % 3 AS INTEGER) AS missing_required, 8 AS n_required, {CHARS} % 7 = 0 AS context_problem FROM documents) AS t"""
TURN_FACTS = f"""(SELECT {TURN}, {SIZE} % 2 = 0 AS has_selector, {_verdict(SIZE)} AS selector, {_verdict(SIZE + " + turn")} AS correct, CASE WHEN {SAYS} THEN 'hit' ELSE {_verdict("turn")} END AS wrong,
 {_verdict(SIZE + " * 5 + 2 * turn")} AS wrong_all, CASE {SIZE} % 7 WHEN 0 THEN 'conflict' WHEN 1 THEN 'support' END AS value FROM conversations) AS t"""
TURN_CONSTRAINTS = f"""(SELECT {TURN}, {SIZE} % 2 = 0 AS needs_trigger, {_verdict(SIZE)} AS trigger_v, CASE WHEN {SAYS} THEN 'hit' ELSE {_verdict("turn")} END AS negative, {_verdict(SIZE + " + turn")} AS safe,
 {SIZE} % 5 = 0 AS safe_fact FROM conversations) AS t"""


def _settled(spark, sf_dir):
    rows = _rows(spark, sf_dir, TURN_GROUPS).withColumn("rule_type", F.lit("default")).withColumn("window", F.lit("w"))
    return matching.settle(rows.withColumn("hit_group", F.lit(0.46)).withColumn("review_group", F.lit(0.22)), places=12)


@query(_sql("a2_settle", base.GROUPS, TURN_GROUPS))
def a2_settle_turns(spark, sf_dir):
    return _settled(spark, sf_dir).select(*matching.KEY, F.round("score", 12).alias("score"), "verdict")


@query(_sql("a3_best_match", base.GROUPS, TURN_GROUPS))
def a3_best_match_turns(spark, sf_dir):
    return matching.best_matches(_settled(spark, sf_dir)).select("dialogue_id", "rule_id", "verdict", F.round("score", 12).alias("score"), "turn_index", "seq")


@query(_sql("a8_node_scores", base.REQUIREMENTS, TURN_REQUIREMENTS))
def a8_node_scores_turns(spark, sf_dir):
    return nodes.node_scores(_rows(spark, sf_dir, TURN_REQUIREMENTS)).select("dialogue_id", "node_id", F.round("score", 6).alias("score"), "first_hit_turn", "status")


@query(_sql("a14_severity", base.BAD, TURN_EVENTS))
def a14_severity_turns(spark, sf_dir):
    return scoring.event_scores(_rows(spark, sf_dir, TURN_EVENTS), "knowledge").withColumn("knowledge_score", F.round("knowledge_score", 6))


@query(_sql("a17_totals", base.SCORES, DOCUMENT_SCORES))
def a17_totals_documents(spark, sf_dir):
    out = scoring.totals(_rows(spark, sf_dir, DOCUMENT_SCORES, "documents"))
    return out.select("dialogue_id", "cap", F.round("uncapped", 6).alias("uncapped"), F.round("total", 6).alias("total"))


_GRID = f"{base.BOOLS} AS h(has_selector), {base.q_grid(['selector', 'correct', 'wrong', 'wrong_all'])}, (VALUES ('conflict'), ('support'), (NULL)) AS v(value)"


@query(_sql("d7_knowledge_ladder", _GRID, TURN_FACTS, ("SELECT has_selector,", "SELECT dialogue_id, turn_index, has_selector,")))
def d7_knowledge_ladder_turns(spark, sf_dir):
    c = {x: F.col(x) for x in ("has_selector", "selector", "correct", "wrong", "wrong_all", "value")}
    verdict = judges.knowledge_verdict(*c.values(), F.lit(None).cast("string"))
    return _rows(spark, sf_dir, TURN_FACTS).withColumn("verdict", verdict)


_TRIGGERS = f"{base.BOOLS} AS h(needs_trigger), {base.q_grid(['trigger_v', 'negative', 'safe'])}, {base.BOOLS} AS s(safe_fact)"


@query(_sql("d12_constraint_ladder", _TRIGGERS, TURN_CONSTRAINTS, ("SELECT needs_trigger,", "SELECT dialogue_id, turn_index, needs_trigger,")))
def d12_constraint_ladder_turns(spark, sf_dir):
    verdict = judges.constraint_verdict(*[F.col(x) for x in ("needs_trigger", "trigger_v", "negative", "safe", "safe_fact")])
    return _rows(spark, sf_dir, TURN_CONSTRAINTS).withColumn("verdict", verdict)
