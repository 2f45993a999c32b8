"""Queries of patterns, triggers, values, candidates, diagnoses and graphs, and their SQL; registered beside the others."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from turnweave.functions import facts as ff
from turnweave.operators import activation, candidates, diagnosis, ledger, matching, patterns, reports, values
from turnweave.operators.atoms import NEGATION
from turnweave.operators.values import VALUE_FACT
from turnweave.plans import graph as gr
from turnweave.plans import checks as ck
from turnweave.plans import queries as base
from turnweave.plans import whole_sql
from turnweave.plans.local import local_table
from turnweave.plans.queries import FACTS, PAIRS, SETTLED, TURNS, _documents, _text, _turns, _values, q_any, q_bigrams, q_chars, q_compact, q_compare, q_days, q_numbers, q_text_hit, q_unit, query
from turnweave.plans.spoken import DIALOGUE, flag, pick, step
from turnweave.sources import packs

# ------------------------------------------------------------------ patterns and scans

BROAD = {"speaker": "assistant", "any": ["the", "that", "ing", "wor"], "all": [], "none": ["ß"], "regex_any": [], "reply_to_user_any": [], "assistant_any": [], "least": 1, "within": 2}
HITS = "(contains(lower(text), 'the')::INT + contains(lower(text), 'that')::INT + contains(lower(text), 'ing')::INT + contains(lower(text), 'wor')::INT)"


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index FROM turns WHERE speaker = 'assistant' AND {HITS} >= 2 AND (contains(lower(text), 'ing') OR contains(lower(text), 'wor')) AND NOT contains(lower(text), 'ß')")
def p19_broad_pattern(spark, sf_dir):
    made = patterns.strengthened(BROAD, frozenset({"the", "that"}))
    return patterns.pattern_turns(_turns(spark, sf_dir), made)


REPLY = {**BROAD, "any": [], "none": [], "all": ["e"], "reply_to_user_any": ["er", "on"], "assistant_any": ["in"]}


@query(f"WITH {TURNS}, p AS (SELECT *, last_value(CASE WHEN speaker = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM turns) SELECT dialogue_id, turn_index FROM p WHERE speaker = 'assistant' AND contains(lower(text), 'e') AND contains(lower(text), 'in') AND (contains(lower(prev), 'er') OR contains(lower(prev), 'on'))")
def p18_reply_pattern(spark, sf_dir):
    return patterns.pattern_turns(_turns(spark, sf_dir), REPLY)


KNOWN = {**BROAD, "speaker": "", "any": ["规则", "生效", "负责"], "all": ["知道吗"], "none": [], "least": 1}
SAYINGS = f"(SELECT event_id AS id, {pick(['您知道', '了解', '请问', '我', '没有'])} || {pick(['平台规则', '生效时间', '负责人', '页面'], 5)} || {pick(['吗', '是否', '', '了'], 20)} AS s FROM events) AS t"


@query(f"WITH c AS (SELECT id, lower(s) AS s, {q_compact('s')} AS c FROM {SAYINGS}) SELECT id FROM c WHERE {q_any('s', KNOWN['any'])} AND (contains(s, '知道吗') OR ({q_any('c', ('吗', '是否', '是不是', '有没有'))} AND {q_any('c', ('知道', '了解', '知情', '确认'))}))")
def p20_relaxed_all(spark, sf_dir):
    rows = _values(spark, sf_dir, SAYINGS)
    return rows.where(patterns.turn_matches(patterns.strengthened(KNOWN), F.col("s"), F.lit("assistant"))).select("id")


def q_slot(a: str, b: str) -> str:
    x, y = q_compact(a), q_compact(b)
    common = f"len(list_intersect({q_chars(x)}, {q_chars(y)}))"
    return f"({x} <> '' AND {y} <> '' AND (contains({y}, {x}) OR (length({x}) >= 4 AND {common} >= 3 AND {common} / len({q_chars(x)}) >= 0.86)))"


@query(f"""WITH {TURNS}, o(object_id, slot, term) AS (VALUES ('one', 0, 'ungen'), ('one', 1, 'keit'), ('one', 1, 'lich'), ('two', 0, 'tion'), ('two', 1, 'eaux'), ('two', 2, 'ing')),
m AS (SELECT dialogue_id, turn_index, object_id, count(DISTINCT slot) AS met, CASE object_id WHEN 'one' THEN 2 ELSE 3 END AS n FROM turns, o WHERE speaker = 'user' AND {q_slot('term', 'text')} AND NOT {q_slot("'schön'", 'text')} GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, object_id ORDER BY met < 2, CASE WHEN met < 2 THEN -met END, turn_index) AS k FROM m)
SELECT dialogue_id, object_id, met >= 2 AS matched, turn_index, round(CASE WHEN met >= 2 THEN 1 ELSE met / n END, 6)::DOUBLE AS share FROM r WHERE k = 1""")
def p31_scan_objects(spark, sf_dir):
    rows = [("one", "user", [], [["ungen"], ["keit", "lich"]], ["schön"], 2), ("two", "user", [], [["tion"], ["eaux"], ["ing"]], ["schön"], 2)]
    objects = local_table(spark, rows, "object_id string, speaker string, direct array<string>, slots array<array<string>>, none array<string>, least int")
    return patterns.scan_objects(_turns(spark, sf_dir), objects).withColumn("share", F.round("share", 6))


@query(f"SELECT id, {q_any(q_compact('b'), patterns.NEUTRAL_SEEN)} OR NOT {q_any(q_compact('b'), patterns.NEUTRAL_PROBLEMS)} AS neutral FROM {PAIRS}")
def p29_only_neutral(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", patterns.only_neutral("enable_page 修复", ["入口不可见", "入口"], F.col("b")).alias("neutral"))


# ------------------------------------------------------------------ triggers and contexts

TRIGGERED = f"triggers AS (SELECT dialogue_id, 'n' AS node_id, min(turn_index) AS trigger_turn FROM turns WHERE speaker = 'user' AND contains(text, 'er') GROUP BY 1)"
HINTS = "(VALUES ('n', 'the nation'), ('n', 'que los'), ('m', 'ungen und')) AS h(node_id, hint)"


def q_words(x: str) -> str:
    return f"list_distinct(list_concat(list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9一-鿿]+'), lambda w: w <> ''), regexp_extract_all(lower({x}), '[a-z0-9]+')))"


NEAREST = f"""users AS (SELECT dialogue_id, turn_index, text, {q_words('text')} AS toks, {q_any('text', ('?', '？'))} AS asks FROM turns WHERE speaker = 'user'),
sims AS (SELECT dialogue_id, node_id, turn_index, text, asks, max(CASE WHEN least(len(toks), len({q_words('hint')})) > 0 THEN len(list_intersect(toks, {q_words('hint')})) / least(len(toks), len({q_words('hint')})) ELSE 0 END + CASE WHEN asks THEN 0.04 ELSE 0 END) AS score FROM users, {HINTS} GROUP BY ALL),
ranked AS (SELECT *, max(score) OVER w AS best, bool_or(asks) OVER w AS asked, row_number() OVER (PARTITION BY dialogue_id, node_id ORDER BY score DESC, turn_index) AS r1, row_number() OVER (PARTITION BY dialogue_id, node_id ORDER BY asks DESC, turn_index DESC) AS r2,
  row_number() OVER (PARTITION BY dialogue_id, node_id ORDER BY turn_index DESC) AS r3 FROM sims WINDOW w AS (PARTITION BY dialogue_id, node_id)),
nearest AS (SELECT dialogue_id, node_id, turn_index, text FROM ranked WHERE CASE WHEN best >= 0.08 THEN r1 <= 2 WHEN asked THEN asks AND r2 <= 2 ELSE r3 <= 2 END)"""


def _users(spark, sf_dir):
    return _turns(spark, sf_dir).where("speaker = 'user'").select("dialogue_id", "turn_index", "text")


def _nearest(spark, sf_dir):
    hints = local_table(spark, [("n", ["the nation", "que los"]), ("m", ["ungen und"])], "node_id string, texts array<string>")
    return activation.relevant_turns(_users(spark, sf_dir), hints)


def _triggers(spark, sf_dir):
    return _users(spark, sf_dir).where(F.contains("text", F.lit("er"))).groupBy("dialogue_id").agg(F.min("turn_index").alias("trigger_turn")).select("dialogue_id", F.lit("n").alias("node_id"), "trigger_turn")


@query(f"WITH {TURNS}, {NEAREST} SELECT dialogue_id, node_id, turn_index FROM nearest")
def w3_relevant_turns(spark, sf_dir):
    return _nearest(spark, sf_dir).select("dialogue_id", "node_id", "turn_index")


@query(f"""WITH {TURNS}, {NEAREST}, {TRIGGERED}, near AS (SELECT t.dialogue_id, node_id, u.turn_index, u.text, u.asks FROM triggers t JOIN users u ON t.dialogue_id = u.dialogue_id AND u.turn_index BETWEEN greatest(0, trigger_turn - 2) AND trigger_turn + 4),
chosen AS (SELECT dialogue_id, node_id, turn_index, text FROM (SELECT *, bool_or(asks) OVER (PARTITION BY dialogue_id, node_id) AS asked FROM near) WHERE asks OR NOT asked UNION ALL SELECT * FROM nearest x WHERE NOT EXISTS (SELECT 1 FROM triggers t WHERE t.dialogue_id = x.dialogue_id AND t.node_id = x.node_id))
SELECT dialogue_id, node_id, string_agg(text, chr(10) ORDER BY turn_index, text) AS context FROM chosen WHERE trim(text) <> '' GROUP BY 1, 2""")
def w4_contexts(spark, sf_dir):
    return activation.context_texts(_users(spark, sf_dir), _triggers(spark, sf_dir), _nearest(spark, sf_dir))


@query(f"""WITH {TURNS}, p(pattern_ord, word) AS (VALUES (0, 'ungen'), (1, 'que')), a AS (SELECT dialogue_id, 0 AS kind, pattern_ord AS place, turn_index FROM turns, p WHERE speaker = 'user' AND contains(text, word)
 UNION ALL SELECT dialogue_id, 1, 0, turn_index FROM turns WHERE speaker = 'user' AND contains(text, 'tion') UNION ALL SELECT dialogue_id, 2, 0, turn_index FROM turns WHERE speaker = 'user' AND contains(text, 'er')),
r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY kind, place, turn_index) AS n FROM a) SELECT dialogue_id, 'n' AS node_id, turn_index AS trigger_turn FROM r WHERE n = 1""")
def w6_first_triggers(spark, sf_dir):
    users = _users(spark, sf_dir)
    by = lambda word: users.where(F.contains("text", F.lit(word))).select("dialogue_id", F.lit("n").alias("node_id"), "turn_index")
    ordered = by("ungen").withColumn("pattern_ord", F.lit(0)).unionByName(by("que").withColumn("pattern_ord", F.lit(1)))
    return activation.first_triggers(ordered, by("tion"), by("er"))


@query(f"WITH {TURNS}, r(requirement_id, term) AS (VALUES ('r1', 'ungen'), ('r1', 'que'), ('r2', 'eau')) SELECT DISTINCT dialogue_id, requirement_id FROM turns, r WHERE speaker = 'user' AND contains({q_compact('text')}, term)")
def d3_given_unasked(spark, sf_dir):
    rows = [("r1", "询问方式", ["ungen", "que", "是否", "x"]), ("r2", "确认号码", ["eau"]), ("r3", "说明规则", ["er"])]
    asked = local_table(spark, rows, "requirement_id string, text string, terms array<string>")
    lowered = _users(spark, sf_dir).withColumn("text", F.lower("text"))
    return activation.given_unasked(lowered, asked)


# Branch words over sayings of events: a dialogue is a user of the table, a turn an event.
SAID_TURNS = f"(SELECT {DIALOGUE}, CAST(event_id AS INT) AS turn_index, {pick(['user', 'assistant'])} AS speaker, {pick(['入口', '页面', '额度', '您好'], 2)} || {pick(['在哪', '可以打开', '说明一下', '没有', '保存'], 3)} AS text FROM events) AS t"


@query(f"""WITH s AS (SELECT * FROM {SAID_TURNS}), t AS (SELECT dialogue_id, w AS node_id, w AS word, min(turn_index) AS trigger_turn FROM s, (VALUES ('入口'), ('额度')) AS x(w) WHERE speaker = 'user' AND contains(text, w) GROUP BY ALL)
SELECT DISTINCT t.dialogue_id, node_id FROM t JOIN s ON s.dialogue_id = t.dialogue_id AND s.turn_index > trigger_turn WHERE speaker = 'assistant' AND contains(text, word) AND {q_any('text', activation.ACTIONS)}""")
def d4_handled_branches(spark, sf_dir):
    turns = _values(spark, sf_dir, SAID_TURNS)
    words = local_table(spark, [("入口", "入口"), ("额度", "额度")], "node_id string, word string")
    met = turns.where("speaker = 'user'").join(F.broadcast(words), F.contains("text", F.col("word"))).groupBy("dialogue_id", "node_id").agg(F.min("turn_index").alias("trigger_turn"))
    return activation.handled_branches(turns, met, words)


# ------------------------------------------------------------------ values and sides of facts

VALUE_SPANS = FACTS.replace("event_id AS id,", f"event_id AS id, {DIALOGUE}, CAST(event_id AS INT) AS turn_index,")
VALUE_FACTS = [("v1", "10元", ""), ("v2", "次日生效", ""), ("v3", "18点", "点")]


def _value_sql() -> str:
    unit = f"CASE WHEN u <> '' THEN u ELSE {q_unit('expected')} END"
    return f"""WITH f(fact_id, expected, u) AS (VALUES {', '.join(str(x) for x in VALUE_FACTS)}), s AS (SELECT dialogue_id, turn_index, actual FROM {VALUE_SPANS}),
g AS (SELECT fact_id, expected, {unit} AS u FROM f), e AS (SELECT *, list_transform({q_numbers('expected', 'u')}, lambda v: split_part(v, ' ', 1)) AS e, {q_days('expected')} AS ed,
  CASE WHEN fact_id = 'v2' THEN ['生效'] ELSE [] END AS anchors FROM g),
p AS (SELECT dialogue_id, fact_id, turn_index, actual, e, ed, anchors, list_transform({q_numbers('actual', "CASE WHEN u <> '' THEN u ELSE " + q_unit('actual') + " END")}, lambda v: split_part(v, ' ', 1)) AS a, {q_days('actual')} AS ad FROM s, e WHERE NOT {q_any('actual', ff.REWARDS)}),
r AS (SELECT *, {q_compare('e', 'ed', 'a', 'ad')} AS result FROM p WHERE (len(a) > 0 OR len(ad) > 0) AND (len(e) = 0 OR len(a) > 0) AND NOT {q_any('actual', ff.DENIED)}
  AND NOT (len(e) = 0 AND len(ed) > 0 AND len(ad) > 0 AND len(anchors) > 0 AND len(list_filter(anchors, lambda x: contains(actual, x))) = 0))
SELECT dialogue_id, fact_id, turn_index, result FROM r WHERE result <> 'unknown'"""


def _value_results(spark, sf_dir):
    spans = _values(spark, sf_dir, VALUE_SPANS).select("dialogue_id", "turn_index", F.lit(0).alias("seq"), F.col("actual").alias("text"))
    rows = [(name, name, [], [], [{"expected": expected, "unit": unit, "anchors": [], "condition": ""}], False, []) for name, expected, unit in VALUE_FACTS]
    return values.value_results(spans, local_table(spark, rows, VALUE_FACT))


@query(_value_sql())
def d8_value_results(spark, sf_dir):
    return _value_results(spark, sf_dir).select("dialogue_id", "fact_id", "turn_index", "result")


@query(f"WITH v AS ({_value_sql()}), r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, fact_id ORDER BY result = 'support', turn_index) AS n FROM v) SELECT dialogue_id, fact_id, result AS value, turn_index AS value_turn FROM r WHERE n = 1")
def w13_first_value(spark, sf_dir):
    return values.first_value(_value_results(spark, sf_dir)).select("dialogue_id", "fact_id", "value", "value_turn")


TRUNKED = f"(SELECT event_id AS id, {pick(['方案一', '方案', '标准协议', '协议', '成本', ''])} || {pick(['需要10天', '会更低', '说明', '今天'], 6)} || {pick(['履约', '状态', ''], 24)} AS s FROM events) AS t"


@query(f"""WITH x AS (SELECT id, s, {q_compact('s')} AS c FROM {TRUNKED}), v AS (SELECT *, len({q_numbers('s', q_unit('s'))}) > 0 OR len({q_days('s')}) > 0 OR {q_any('s', values.DIRECTION_WORDS)} AS says FROM x)
SELECT id, (contains(c, '标准协议') AND contains(c, '履约状态')) OR ((contains(c, '标准')) AND says) AS trunk FROM v""")
def f12_trunk(spark, sf_dir):
    kind = "array<array<struct<terms:array<string>,general:boolean>>>"
    groups = F.from_json(F.lit(json.dumps([[{"terms": ["标准协议"], "general": False}, {"terms": ["履约状态"], "general": True}]], ensure_ascii=False)), kind)
    return _values(spark, sf_dir, TRUNKED).select("id", ff.names_trunk(groups, F.col("s"), values.DIRECTION_WORDS).alias("trunk"))


@query(f"SELECT id, NOT contains({q_compact('s')}, '说明') AND (len({q_numbers('s', chr(39) + '天' + chr(39))}) > 0 OR len({q_days('s')}) > 0) AND (contains(s, '协议') OR contains(s, '方案')) AS continues FROM {TRUNKED}")
def f11_continuations(spark, sf_dir):
    checks = F.array(F.struct(ff.fact_profile(F.lit("10天"), F.lit("天")).alias("profile")))
    allowed = ff.continues_value(F.lit(True), F.array(F.lit("说明")), checks, F.array(F.lit("协议"), F.lit("方案")), F.col("s"))
    return _values(spark, sf_dir, TRUNKED).select("id", allowed.alias("continues"))


PROBED = f"(SELECT event_id AS id, {pick(['hit', 'review', 'miss'])} AS positive, {pick(['不适合您', '不行', '可以', '未生效'], 3)} AS s, {flag(2, 12)} AS any_denies FROM events) AS t"


@query(f"SELECT id, CASE WHEN positive <> 'miss' AND {q_any('s', NEGATION)} THEN CASE WHEN {q_any('s', values.TURNED)} THEN 'hit' ELSE 'review' END WHEN positive <> 'miss' AND any_denies THEN 'review' ELSE 'miss' END AS wrong FROM {PROBED}")
def d10_negation_probe(spark, sf_dir):
    from turnweave.functions.text import any_of

    return _values(spark, sf_dir, PROBED).select("id", values.negation_probe(F.col("positive"), F.col("s"), any_of(F.col("s"), NEGATION), F.col("any_denies")).alias("wrong"))


CARRYING = f"(SELECT {DIALOGUE}, CAST(event_id AS INT) AS turn_index, {pick(['小班课程', '大班', '讲座课'])} || {pick(['不太适合', '不能补齐', '以后再说', '更适合您'], 3)} AS text FROM events WHERE event_id % 7 = 0) AS t"


@query(f"""WITH s AS (SELECT * FROM {CARRYING}), c AS (SELECT dialogue_id, string_agg(text, ' ' ORDER BY turn_index) AS scope FROM s GROUP BY 1),
h AS (SELECT s.dialogue_id, turn_index, {q_text_hit("'不太适合'", 'text')}::INT + {q_text_hit("'以后'", 'text')}::INT AS hits FROM s JOIN c USING (dialogue_id) WHERE {q_text_hit("'小班课程'", 'scope')} AND NOT {q_any('text', ff.DENIED)}),
r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY hits DESC, turn_index) AS n FROM h WHERE hits > 0) SELECT dialogue_id, 'r' AS rule_id, turn_index, round(least(1, 0.72 + 0.2 * hits / 2), 6)::DOUBLE AS score FROM r WHERE n = 1""")
def d11_carried_sides(spark, sf_dir):
    spans = _values(spark, sf_dir, CARRYING).select("dialogue_id", F.lit("r").alias("rule_id"), "turn_index", F.lit(0).alias("seq"), "text")
    groups = local_table(spark, [("r", [["小班课程"]], [["不太适合"], ["以后", "不"]])], "rule_id string, mains array<array<string>>, facts array<array<string>>")
    return values.carried_sides(spans, groups).select("dialogue_id", "rule_id", "turn_index", F.round("score", 6).alias("score"))


# ------------------------------------------------------------------ candidates and audits

CHECKS = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS fact_id, {pick(['支持', '冲突', '证据不足'])} AS verdict, {pick(['hit', 'review', 'miss'], 2)} AS positive, {pick(['miss', 'hit', 'review', 'miss'], 5)} AS negative, {pick(['一句', '', '两句'], 7)} AS evidence FROM events) AS t"


def _candidate_sql(name: str, kind: str, need: float) -> str:
    return (
        f"SELECT dialogue_id || ':{name}:' || fact_id AS candidate_id, dialogue_id, '{kind}' AS family, {need}::DOUBLE AS need, CASE WHEN evidence <> '' THEN 0.6 ELSE 0.35 END::DOUBLE AS strength,"
        f" verdict = '证据不足' OR negative = 'review' OR (positive = 'hit' AND negative = 'hit') AS forced_review FROM {CHECKS} WHERE verdict = '证据不足' OR positive = 'review' OR negative = 'review'"
    )


_CANDIDATE = ["candidate_id", "dialogue_id", "family", "need", "strength", "forced_review"]


@query(_candidate_sql("knowledge", "knowledge_violation", 0.82))
def d19_fact_candidates(spark, sf_dir):
    return candidates.of_facts(_values(spark, sf_dir, CHECKS)).select(*_CANDIDATE)


@query(_candidate_sql("knowledge", "knowledge_violation", 0.82) + " UNION ALL " + _candidate_sql("constraint", "constraint_violation", 0.86))
def u2_candidates(spark, sf_dir):
    rows = _values(spark, sf_dir, CHECKS)
    return candidates.all_candidates(candidates.of_facts(rows), candidates.of_constraints(rows.withColumnRenamed("fact_id", "constraint_id"))).select(*_CANDIDATE)


OPEN = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS requirement_id, NOT ({flag(3)}) AS active, NOT ({flag(4, 2)}) AS required, {flag(5, 3)} AS matched, (event_id % 64) / 64e0 AS score, (event_id % 32) / 32e0 AS strength FROM events) AS t"


@query(f"SELECT dialogue_id || ':requirement:' || requirement_id AS candidate_id, dialogue_id, 'flow_missing' AS family, 1 - score AS need, strength, false AS forced_review FROM {OPEN} WHERE active AND required AND NOT matched AND 1 - score >= 0.7 AND strength >= 0.35")
def d19_requirement_candidates(spark, sf_dir):
    rows = _values(spark, sf_dir, OPEN).withColumn("evidence", F.array().cast("array<string>"))
    return candidates.of_requirements(rows).select(*_CANDIDATE)


POLICIES = "(SELECT CAST(conv_id AS STRING) AS dialogue_id, 'p' AS policy_id, CASE WHEN conv_id % 3 = 0 THEN '已处理' ELSE '触发但未处理' END AS status, CAST(conv_id % 4 AS INT) AS trigger_turn, CASE WHEN conv_id % 3 = 0 THEN CAST(conv_id % 4 + 1 AS INT) END AS safe_turn FROM conversations GROUP BY conv_id) AS t"


@query(f"""WITH {TURNS}, o AS (SELECT * FROM {POLICIES} WHERE status <> '已处理'), l AS (SELECT o.dialogue_id, 0 AS k, turn_index, '第' || turn_index || '轮：' || text AS line FROM o JOIN turns USING (dialogue_id) WHERE turn_index = trigger_turn
 UNION ALL SELECT * FROM (SELECT o.dialogue_id, 1, turn_index, '第' || turn_index || '轮：' || text FROM o JOIN turns USING (dialogue_id) WHERE speaker = 'assistant' AND turn_index > trigger_turn QUALIFY row_number() OVER (PARTITION BY o.dialogue_id ORDER BY turn_index) <= 3))
SELECT dialogue_id || ':context:p' AS candidate_id, dialogue_id, 'context_violation' AS family, 0.78::DOUBLE AS need, CASE WHEN count(line) > 0 THEN 0.6 ELSE 0.35 END::DOUBLE AS strength, coalesce(string_agg(line, '|' ORDER BY k, turn_index), '') AS evidence FROM o LEFT JOIN l USING (dialogue_id) GROUP BY dialogue_id""")
def d19_context_candidates(spark, sf_dir):
    rows = candidates.of_context(_values(spark, sf_dir, POLICIES), _turns(spark, sf_dir))
    return rows.select(*_CANDIDATE[:5], F.array_join("evidence", "|").alias("evidence"))


@query(f"""WITH {TURNS}, a AS (SELECT dialogue_id, string_agg('客服第' || turn_index || '轮：' || trim(text), chr(10) ORDER BY turn_index) AS s FROM turns WHERE speaker = 'assistant' AND trim(text) <> '' GROUP BY 1)
SELECT dialogue_id, CASE WHEN length(s) > 200 THEN substr(s, 1, 200) || chr(10) || '……[已截断]' ELSE s END AS transcript FROM a""")
def d20_transcripts(spark, sf_dir):
    return candidates.transcripts(_turns(spark, sf_dir), 200)


ITEMS = f"(SELECT event_id AS id, array({pick(['甲', '', '乙'])}, {pick(['甲', '丙', ' '], 3)}, {pick(['丁', '戊'], 9)}, {pick(['己', '丁'], 2)}, {pick(['客服实际表达摘要：好', '庚', ''], 5)}) AS items FROM events) AS t"
_CLEAN = "list_filter(items, lambda x: trim(x) <> '')"


@query(f"""WITH c AS (SELECT id, list_transform({_CLEAN}, lambda x: trim(x)) AS c FROM {ITEMS.replace('array(', 'list_value(')}), k AS (SELECT id, c[1:3] AS f, list_filter(c, lambda x: contains(x, '客服实际表达摘要')) AS s, c FROM c),
r AS (SELECT id, CASE WHEN len(s) = 0 OR len(list_filter(f, lambda x: contains(x, '客服实际表达摘要'))) > 0 THEN f ELSE list_concat(c[1:2], s[1:1]) END AS r FROM k) SELECT id, array_to_string({base.q_once('r')}, ',') AS kept FROM r""")
def t5_kept_evidence(spark, sf_dir):
    return _values(spark, sf_dir, ITEMS).select("id", F.array_join(candidates.kept_evidence(F.col("items"), 3), ",").alias("kept"))


@query(f"WITH {SETTLED}, r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, rule_id ORDER BY CASE verdict WHEN 'hit' THEN 3 WHEN 'review' THEN 2 ELSE 1 END DESC, score DESC, a_turn, a_seq, window_ord)::INTEGER AS place FROM settled) SELECT dialogue_id, rule_id, place, verdict, score FROM r WHERE place <= 3")
def t2_candidate_audit(spark, sf_dir):
    return matching.candidate_audit(base._settled(spark, sf_dir), 3).select("dialogue_id", "rule_id", "place", "verdict", F.round("score", 12).alias("score"))


# ------------------------------------------------------------------ diagnoses and bindings


def q_label(x: str) -> str:
    runs = f"regexp_extract_all(lower({x}), '[一-鿿]+')"
    pairs = f"flatten(list_transform({runs}, lambda r: list_transform(generate_series(1, length(r) - 1), lambda i: substr(r, i::INT, 2))))"
    single = f"flatten(list_transform(list_filter({runs}, lambda r: length(r) <= 4), lambda r: string_split(r, '')))"
    return f"list_distinct(list_filter(list_concat(list_filter(regexp_split_to_array(lower({x}), '[^A-Za-z0-9一-鿿]+'), lambda w: w <> ''), {pairs}, {single}, regexp_extract_all(lower({x}), '[a-z0-9]+')), lambda w: w <> ''))"


def q_overlap(x: str, y: str) -> str:
    return f"(CASE WHEN least(len({x}), len({y})) > 0 THEN len(list_intersect({x}, {y})) / least(len({x}), len({y})) ELSE 0 END)"


def q_similar(x: str, y: str, bx: str, by: str) -> str:
    """Similarity of labels from their tokens and pairs of characters."""
    return f"(CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0 WHEN {q_overlap(x, y)} > 0 THEN {q_overlap(x, y)} ELSE {q_overlap(bx, by)} END)"


MISSED = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS error_id, {pick(['knowledge', 'constraint', 'flow', '知识错误'])} AS family, {pick(['次日生效 规则', 'k3 奖励十元', '取消入口', '不承诺结果', 'abc_de'], 3)} AS hint FROM events WHERE event_id % 11 = 0) AS t"
SHOWN = f"(SELECT {DIALOGUE}, CAST(event_id AS STRING) AS target, {pick(['支持', '冲突', '证据不足', '违规', '安全', 'missing', 'matched'])} AS verdict, {pick(['生效时间是次日', '奖励规则', 'abcde', '入口取消', 'k3', '完全无关的话'], 2)} AS label FROM events WHERE event_id % 5 = 0) AS t"


def _miss_sql() -> str:
    parts = []
    for name, test, k, bad in (("knowledge_violation", "family IN ('knowledge', '知识错误')", 6, "冲突"), ("constraint_violation", "family = 'constraint'", 6, "违规"), ("flow_missing", "family = 'flow'", 8, "missing")):
        flow = name == "flow_missing"
        cause = (
            "CASE WHEN target IS NULL OR similarity < 0.08 THEN 'nothing_near' WHEN verdict = 'missing' THEN 'really_missing' ELSE 'met_anyway' END"
            if flow
            else "CASE WHEN target IS NULL THEN 'no_rows' WHEN any_bad THEN 'not_aligned' WHEN similarity < 0.08 THEN 'nothing_near' WHEN verdict = '支持' THEN 'right_side_only' ELSE 'unsure' END"
        )
        parts.append(
            f"SELECT e.error_id, '{name}' AS family, {cause} AS cause, target AS nearest, round(coalesce(similarity, 0), 6)::DOUBLE AS similarity FROM e LEFT JOIN (SELECT error_id, target, verdict, similarity, bool_or(verdict = '{bad}') OVER (PARTITION BY error_id) AS any_bad, place FROM ranked WHERE place <= {k}) n ON n.error_id = e.error_id AND n.place = 1 WHERE {test}"
        )
    return f"""WITH e AS (SELECT *, {q_label('hint')} AS ht, {q_bigrams(q_compact('hint'))} AS hb FROM {MISSED}), s AS (SELECT *, {q_label('label')} AS lt, {q_bigrams(q_compact('label'))} AS lb FROM {SHOWN}),
m AS (SELECT error_id, target, verdict, {q_similar('ht', 'lt', 'hb', 'lb')} AS similarity FROM e JOIN s USING (dialogue_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY similarity DESC, target, verdict) AS place FROM m) {' UNION ALL '.join(parts)}"""


@query(_miss_sql())
def w12_miss_causes(spark, sf_dir):
    shown = _values(spark, sf_dir, SHOWN)
    return diagnosis.miss_causes(_values(spark, sf_dir, MISSED), shown, shown, shown).withColumn("similarity", F.round("similarity", 6))


LABEL_ROWS = f"(SELECT event_id AS label_id, {pick(['n1', '入口', 'step_two', ''])} AS node, {pick(['取消报名', '生效', ''], 4)} AS core, {pick(['', '次日生效规则', '报名入口'], 12)} AS hint FROM events) AS t"
TARGETS = "(VALUES ('n1', '生效 时间 次日'), ('n2', '取消 报名入口'), ('n3', 'step two 说明')) AS g(target_id, anchor)"


@query(f"""WITH l AS (SELECT *, {q_label('node')} AS nt, {q_bigrams(q_compact('node'))} AS nb, {q_label('core')} AS ct, {q_bigrams(q_compact('core'))} AS cb, {q_label('hint')} AS ht, {q_bigrams(q_compact('hint'))} AS hb FROM {LABEL_ROWS}),
g AS (SELECT *, {q_label('anchor')} AS anch, {q_bigrams(q_compact('anchor'))} AS ab FROM {TARGETS}),
s AS (SELECT label_id, hint, target_id, CASE WHEN node = target_id THEN 2 ELSE greatest({q_similar('nt', 'anch', 'nb', 'ab')}, 0.8 * {q_similar('ct', 'anch', 'cb', 'ab')}, {q_similar('ht', 'anch', 'hb', 'ab')}) END AS score FROM l, g),
r AS (SELECT *, row_number() OVER w AS n, lead(score) OVER w AS second FROM s WINDOW w AS (PARTITION BY label_id ORDER BY score DESC, target_id))
SELECT label_id, target_id, round(least(score, 1), 6)::DOUBLE AS score FROM r WHERE n = 1 AND (score >= 0.65 OR (hint <> '' AND score >= 0.18 AND (second <= 0.0001 OR score >= second * 1.15)))""")
def j22_bound_labels(spark, sf_dir):
    targets = local_table(spark, [("n1", "n1", "生效 时间 次日"), ("n2", "n2", "取消 报名入口"), ("n3", "n3", "step two 说明")], "target_id string, node string, anchor string")
    return diagnosis.bound_labels(_values(spark, sf_dir, LABEL_ROWS), targets).withColumn("score", F.round("score", 6))


SPANS = "(SELECT CAST(conv_id AS STRING) AS dialogue_id, CAST(turn AS STRING) AS span_id, substr(coalesce(text, ''), 3, 9) AS span FROM conversations WHERE conv_id % 3 = 0) AS t"


@query(f"""WITH {TURNS}, m AS (SELECT s.dialogue_id, span_id, turn_index, contains(text, span) AS exact FROM {SPANS.replace(' AS t', ' AS s')} JOIN turns ON turns.dialogue_id = s.dialogue_id WHERE trim(span) <> '' AND (contains(text, span) OR contains(regexp_replace(text, '\\s+', '', 'g'), regexp_replace(span, '\\s+', '', 'g')))),
r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, span_id ORDER BY NOT exact, turn_index) AS n FROM m) SELECT dialogue_id, span_id, turn_index, exact FROM r WHERE n = 1""")
def d26_span_turns(spark, sf_dir):
    return diagnosis.span_turns(_values(spark, sf_dir, SPANS), _turns(spark, sf_dir))


@query(f"""WITH {TURNS}, p AS (SELECT DISTINCT dialogue_id, turn_index FROM turns WHERE speaker = 'user') SELECT p.dialogue_id, p.turn_index, string_agg('第' || t.turn_index || '轮：' || text, ' / ' ORDER BY t.turn_index) AS lines
FROM p JOIN turns t ON t.dialogue_id = p.dialogue_id AND abs(t.turn_index - p.turn_index) <= 2 AND t.speaker = 'assistant' GROUP BY 1, 2""")
def d26_nearby_lines(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return diagnosis.nearby_lines(turns.where("speaker = 'user'").select("dialogue_id", "turn_index"), turns)


HINT_ROWS = f"(SELECT {pick(['n1', 'n2', '', None])} AS target_node, {pick(['k1', '', 'r2'], 4)} AS target_id, {pick(['knowledge', ''], 12)} AS target_kind, {pick(['positive', 'negative', ''], 5)} AS sample_type, {pick(['flow', 'knowledge', ''], 7)} AS error_family FROM events) AS t"


@query(f"""WITH g AS (SELECT coalesce(target_node, '') AS target_node, target_id, target_kind, coalesce(array_to_string(list_sort(list(DISTINCT sample_type) FILTER (sample_type <> ''))[1:4], ','), '') AS sample_types,
 coalesce(array_to_string(list_sort(list(DISTINCT error_family) FILTER (error_family <> ''))[1:6], ','), '') AS error_families, count(*) AS n FROM {HINT_ROWS} WHERE coalesce(target_node, '') <> '' OR target_id <> '' GROUP BY 1, 2, 3)
SELECT * FROM g ORDER BY NOT contains(sample_types, 'positive'), target_node, target_id, n DESC, target_kind LIMIT 9""")
def a30_binding_hints(spark, sf_dir):
    return packs.binding_hints(_values(spark, sf_dir, HINT_ROWS), 9)


# ------------------------------------------------------------------ reports

RESULT = "CASE n_chars % 4 WHEN 0 THEN 'passed' WHEN 1 THEN 'arbitrated' WHEN 2 THEN 'pending' ELSE 'failed' END"
RESULT_ROWS = f"(SELECT lang AS domain, CASE WHEN doc_id % 3 > 0 THEN source END AS sample_type, {RESULT} AS result, (n_chars % 100) / 1e0 AS total, (n_chars % 90) / 1e0 AS node_completion, (n_chars % 80) / 1e0 AS relation_score, (n_chars % 70) / 1e0 AS knowledge_score, (n_chars % 60) / 1e0 AS constraint_score FROM documents) AS t"


@query(
    f"SELECT coalesce(domain, '未标注') AS domain, coalesce(sample_type, '未标注') AS sample_type, count(*) AS n, "
    + ", ".join(f"count(*) FILTER (result = '{x}') AS n_{x}" for x in ("passed", "arbitrated", "pending", "failed"))
    + ", "
    + ", ".join(f"round(avg({c}), 6) AS avg_{c}" for c in reports.COMPONENTS)
    + f" FROM {RESULT_ROWS} GROUP BY 1, 2"
)
def a22_result_breakdown(spark, sf_dir):
    out = reports.result_breakdown(_values(spark, sf_dir, RESULT_ROWS))
    return out.select(*[F.round(c, 6).alias(c) if c.startswith("avg_") else c for c in out.columns])


@query(f"WITH {base.RECONCILED}, n AS (SELECT dialogue_id, count(*) FILTER (false) AS m, count(*) AS o FROM reconciled GROUP BY 1) SELECT 'nothing_matched' AS warning, count(*) AS n FROM n HAVING sum(m) = 0 AND sum(o) > 0")
def a26_nothing_matched(spark, sf_dir):
    open_ = base._errors(spark, sf_dir).groupBy("dialogue_id").agg(F.lit(0).alias("n_matched"), F.count("*").alias("n_open"))
    return ledger.nothing_matched(open_)


@query("WITH d AS (SELECT lower(CASE WHEN doc_id % 2 = 0 THEN 'Negative' ELSE 'positive' END) AS s, n_chars % 7 = 0 AS grey FROM documents) SELECT count(*) AS n, count(*) FILTER (grey) AS n_grey, round(count(*) FILTER (grey) / count(*), 6) AS share, count(*) FILTER (grey) / count(*) > 0.12 AS too_many FROM d WHERE s = 'negative'")
def q1_grey_share(spark, sf_dir):
    rows = _documents(spark, sf_dir).select(F.when(F.col("doc_id") % 2 == 0, "Negative").otherwise("positive").alias("sample_type"), (F.col("n_chars") % 7 == 0).alias("grey"))
    return ledger.grey_share(rows).withColumn("share", F.round("share", 6))


# ------------------------------------------------------------------ graphs; metadata, read from one JSON text on both sides

RAW = {
    "nodes": [
        {"id": "a", "type": "main", "atoms": [{"id": "a1", "text": "询问方式", "element_groups": [{"elements": [{"value": "方式", "fact": True}, "确认"]}]}, {"id": "a2", "element_groups": []}]},
        {"id": "b", "type": "faq", "activation": {"mode": "user_triggered"}, "requirements": [{"id": "b1", "element_groups": ["费用"]}]},
        {"id": "t", "type": "terminal"},
    ],
    "edges": [{"source": "a", "target": "b", "relation": "strict_order"}, {"from": "b", "to": "t", "type": "terminal", "weight": 2}],
    "relation_groups": [{"id": "g", "type": "all_of", "nodes": ["a", "b", "zz"], "min_completed": 3}],
    "knowledge_table": [{"id": "k", "severity": "high", "node_id": "a", "atoms": [{"id": "k1", "selector_groups": [{"elements": [{"value": "协议", "main": True}]}]}, {"id": "k2", "severity": "low", "node_id": "nowhere"}]}, {"id": "k3", "node_id": "b"}],
    "hard_constraint_table": [{"id": "h1", "negative_groups": [{"elements": [{"value": "保证", "main": True}]}]}, {"id": "h2", "negative_groups": [{"elements": [{"value": "保证", "main": True}]}], "node_id": "gone"}],
    "soft_constraint_table": [{"id": "s1", "metric": {"type": "max_chars_per_assistant_turn"}}],
}
JSON_TEXT = _text(json.dumps(RAW, ensure_ascii=False))


def q_table(key: str, alias: str) -> str:
    return f"(SELECT unnest(json_extract({JSON_TEXT}::JSON, '$.{key}[*]')) AS {alias})"


FLAT = f"(SELECT coalesce(a->>'id', k->>'id') AS id, CASE WHEN a IS NULL THEN '' ELSE k->>'id' END AS parent_id, coalesce(a->>'severity', k->>'severity', '') AS severity, coalesce(a->>'node_id', k->>'node_id', '') AS node_id FROM {q_table('knowledge_table', 'k')} LEFT JOIN LATERAL (SELECT unnest(json_extract(k, '$.atoms[*]')) AS a) ON true)"


@query(f"SELECT * FROM {FLAT}")
def c13_flattened(spark, sf_dir):
    rows = [(r["id"], r.get("parent_id", ""), r.get("severity", ""), r.get("node_id", "")) for r in gr.flattened(RAW["knowledge_table"])]
    return local_table(spark, rows, "id string, parent_id string, severity string, node_id string")


@query(f"""WITH n AS (SELECT n->>'id' AS id FROM {q_table('nodes', 'n')}) SELECT 'fact' AS kind, id, node_id AS name FROM {FLAT} WHERE node_id <> '' AND node_id NOT IN (FROM n)
UNION ALL SELECT 'hard', h->>'id', h->>'node_id' FROM {q_table('hard_constraint_table', 'h')} WHERE h->>'node_id' NOT IN (FROM n) UNION ALL SELECT 'group', g->>'id', m FROM (SELECT g, unnest(json_extract_string(g, '$.nodes[*]')) AS m FROM {q_table('relation_groups', 'g')}) WHERE m NOT IN (FROM n)""")
def j23_dangling(spark, sf_dir):
    return local_table(spark, gr.dangling(RAW), "kind string, id string, name string")


@query(f"""SELECT coalesce(e->>'source', e->>'from') AS source, coalesce(e->>'target', e->>'to') AS target, CASE coalesce(e->>'relation', e->>'type') WHEN 'strict_order' THEN 'strict_before' WHEN 'terminal' THEN 'terminal_after' ELSE coalesce(e->>'relation', e->>'type') END AS kind, coalesce((e->>'weight')::DOUBLE, 1) AS weight FROM {q_table('edges', 'e')}""")
def c4_edges(spark, sf_dir):
    return gr.compile_graph(spark, RAW).catalogue.edges.select("source", "target", "kind", "weight")


@query(f"""SELECT n->>'id' AS node_id, r->>'id' AS requirement_id, 1::DOUBLE AS weight, true AS required FROM (SELECT n, unnest(coalesce(nullif(json_extract(n, '$.atoms[*]'), []), json_extract(n, '$.requirements[*]'))) AS r FROM {q_table('nodes', 'n')})""")
def c2_requirements(spark, sf_dir):
    return gr.compile_graph(spark, RAW).requirements.select("node_id", "requirement_id", "weight", "required")


@query(f"""WITH r AS (SELECT unnest(coalesce(nullif(json_extract(n, '$.atoms[*]'), []), json_extract(n, '$.requirements[*]'))) AS r FROM {q_table('nodes', 'n')}), g AS (SELECT r->>'id' AS rule_id, unnest(json_extract(r, '$.element_groups[*]')) AS g FROM r),
e AS (SELECT rule_id, CASE WHEN json_type(g) = 'VARCHAR' THEN g ELSE unnest(json_extract(g, '$.elements[*]')) END AS e, generate_subscripts(CASE WHEN json_type(g) = 'VARCHAR' THEN [g] ELSE json_extract(g, '$.elements[*]') END, 1) AS n FROM g)
SELECT rule_id, CASE WHEN json_type(e) = 'VARCHAR' THEN e->>'$' ELSE e->>'value' END AS value, n = 1 AS main, false AS fact FROM e""")
def c9_node_elements(spark, sf_dir):
    rows = gr.compile_graph(spark, RAW).catalogue.elements.where("rule_type = 'node_positive'")
    return rows.select("rule_id", "value", "main", "fact")


@query(f"""WITH n AS (SELECT n FROM {q_table('nodes', 'n')}), a AS (SELECT 'requirement' AS kind, n->>'id' AS owner, r->>'id' AS atom, row_number() OVER () AS k FROM (SELECT n, unnest(coalesce(nullif(json_extract(n, '$.atoms[*]'), []), json_extract(n, '$.requirements[*]'))) AS r FROM n)
UNION ALL SELECT 'activation', n->>'id', 'activation::' || (n->>'id'), row_number() OVER () FROM n WHERE coalesce(n->'activation'->>'mode', 'always') <> 'always'
UNION ALL SELECT 'fact', CASE WHEN node_id IN ('a', 'b', 't') THEN node_id ELSE '' END, id, row_number() OVER () FROM {FLAT} UNION ALL SELECT 'hard', coalesce(h->>'node_id', ''), h->>'id', row_number() OVER () FROM {q_table('hard_constraint_table', 'h')} UNION ALL SELECT 'soft', '', s->>'id', 1 FROM {q_table('soft_constraint_table', 's')})
SELECT kind, owner, atom, ((k - 1) // 2)::INTEGER AS batch FROM a""")
def c14_atom_batches(spark, sf_dir):
    return local_table(spark, gr.atoms_of(gr.normalized(RAW), 2), "kind string, owner string, atom string, batch int")


@query(f"""WITH n AS (SELECT n, coalesce(n->'activation'->>'mode', 'always') AS mode FROM {q_table('nodes', 'n')}), i AS (SELECT 'conditional_without_trigger' AS type FROM n WHERE mode IN ('user_triggered', 'condition') AND (n->'activation'->'trigger_groups') IS NULL AND (n->'activation'->'patterns') IS NULL
 UNION ALL SELECT 'empty_terminal_made_optional' FROM n WHERE (n->>'type') = 'terminal' AND (n->'requirements') IS NULL AND (n->'atoms') IS NULL
 UNION ALL SELECT 'requirement_without_element_rule' FROM (SELECT n, unnest(json_extract(n, '$.requirements[*]')) AS r FROM n) WHERE (n->'atoms') IS NULL AND (r->'element_groups') IS NULL AND (r->'evidence_groups') IS NULL
 UNION ALL SELECT 'relation_group_optional_nodes_repaired' FROM {q_table('relation_groups', 'g')} WHERE (g->>'min_completed')::INT > (SELECT count(*) FROM n WHERE mode <> 'optional' AND list_contains(json_extract_string(g, '$.nodes[*]'), n->>'id')))
SELECT type, count(*)::INTEGER AS n FROM i GROUP BY 1""")
def a31_lint_counts(spark, sf_dir):
    return local_table(spark, sorted(gr.lint_counts(gr.lint(RAW)).items()), "type string, n int")


@query(f"""WITH e AS (SELECT h->>'id' AS id, json_extract_string(h, '$.negative_groups[*].elements[*].value') AS v FROM {q_table('hard_constraint_table', 'h')}) SELECT min(id) AS id FROM e GROUP BY v""")
def t7_same_meaning(spark, sf_dir):
    rows = gr.same_meaning([c for c in gr.merged_constraints(RAW) if c["enforcement"] == "hard"], gr.HARD_MOST)
    return local_table(spark, [(r["id"],) for r in rows], "id string")


OTHER = {**RAW, "nodes": [*RAW["nodes"][:2], {"id": "x", "name": "结束"}], "knowledge_table": [{"id": "k3"}]}
OTHER_TEXT = _text(json.dumps(OTHER, ensure_ascii=False))


@query(f"""WITH a AS (SELECT 'node' AS kind, n->>'id' AS id FROM {q_table('nodes', 'n')} UNION ALL SELECT 'fact', id FROM {FLAT}), b AS (SELECT 'node' AS kind, unnest(json_extract_string({OTHER_TEXT}::JSON, '$.nodes[*].id')) AS id UNION ALL SELECT 'fact', unnest(json_extract_string({OTHER_TEXT}::JSON, '$.knowledge_table[*].id')))
SELECT kind, 'missing' AS state, id FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT kind, 'extra', id FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def u6_graph_difference(spark, sf_dir):
    return local_table(spark, [x[:3] for x in gr.difference(RAW, OTHER)], "kind string, state string, id string")


@query(f"""SELECT 'hard.' || (h->>'id') AS path, 'no_negative_main' AS issue FROM {q_table('hard_constraint_table', 'h')} WHERE len(json_extract(h, '$.negative_groups[*].elements[*]')) = 0
UNION ALL SELECT 'nodes.' || (n->>'id') || '.' || (r->>'id'), unnest(CASE WHEN len(json_extract(r, '$.element_groups[*].elements[*]')) = 0 THEN ['no_main'] ELSE list_concat(list_transform(list_filter(json_extract_string(r, '$.element_groups[*].elements[*].fact'), lambda x: x = 'true'), lambda x: 'fact_in_node'),
  CASE WHEN len(list_filter(json_extract_string(r, '$.element_groups[*].elements[*].main'), lambda x: x = 'true')) = 0 THEN ['no_main'] ELSE [] END) END) FROM (SELECT n, unnest(json_extract(n, '$.atoms[*]')) AS r FROM {q_table('nodes', 'n')})
UNION ALL SELECT 'knowledge.' || coalesce(a->>'id', k->>'id'), 'selector_without_main' FROM {q_table('knowledge_table', 'k')} LEFT JOIN LATERAL (SELECT unnest(json_extract(k, '$.atoms[*]')) AS a) ON true WHERE len(list_filter(json_extract_string(coalesce(a, k), '$.selector_groups[*].elements[*].main'), lambda x: x = 'true')) = 0""")
def q4_contract_issues(spark, sf_dir):
    return local_table(spark, ck.contract_issues(RAW), "path string, issue string")


# ------------------------------------------------------------------ flat rules, scopes, ledgers

FLAT_TERMS = "(VALUES ('f1', 'the', 0), ('f1', 'ungen', 1), ('f2', 'eau', 0)) AS r(rule_id, term, n)"


@query(f"""WITH {base.ATOMS}, e AS (SELECT *, seq > 0 OR n_spans = 1 AS ev FROM atoms), t AS (SELECT *, count(*) OVER (PARTITION BY rule_id) AS m FROM {FLAT_TERMS}),
h AS (SELECT rule_id, dialogue_id, turn_index, seq, count(*) AS k, any_value(m) AS m FROM e, t WHERE ev AND {q_text_hit('term', 'text')} GROUP BY ALL),
p AS (SELECT rule_id, dialogue_id, turn_index, seq, count(*) AS n FROM e, (VALUES ('f1', 'that'), ('f2', 'que')) AS x(rule_id, term) WHERE ev AND {q_text_hit('term', 'text')} GROUP BY ALL),
s AS (SELECT h.*, coalesce(n, 0) AS n FROM h LEFT JOIN p USING (rule_id, dialogue_id, turn_index, seq)), v AS (SELECT *, least(1, k / m + least(0.25, 0.05 * n)) AS score FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY rule_id, dialogue_id ORDER BY score >= 0.46 DESC, score >= 0.22 DESC, score DESC, turn_index, seq) AS o FROM v)
SELECT dialogue_id, rule_id, CASE WHEN score >= 0.46 THEN 'hit' WHEN score >= 0.22 THEN 'review' ELSE 'miss' END AS verdict, round(score, 6)::DOUBLE AS score, turn_index, seq FROM r WHERE o = 1""")
def a5_flat_matches(spark, sf_dir):
    from turnweave.operators.atoms import atoms
    from turnweave.plans.catalogue import compile_rules

    rules = [
        {"id": "f1", "type": "default", "elements": [{"value": "the", "main": True, "pool": []}, {"value": "ungen", "main": True}]},
        {"id": "f2", "type": "default", "elements": [{"value": "eau", "main": True}]},
    ]
    elements = compile_rules(spark, rules).elements.withColumn("weight", F.lit(1.0))
    pooled = {"f1": "that", "f2": "que"}
    extra = compile_rules(spark, [{"id": k, "type": "default", "elements": [{"value": "zzzz", "pool": [v], "type": "surface"}]} for k, v in pooled.items()]).elements
    spans = atoms(_turns(spark, sf_dir))
    return matching.flat_matches_with_pools(spans, elements, matching.pool_hits(spans, extra)).select("dialogue_id", "rule_id", "verdict", F.round("score", 6).alias("score"), "turn_index", "seq")


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index FROM turns t WHERE speaker = 'unknown' OR NOT EXISTS (SELECT 1 FROM turns u WHERE u.dialogue_id = t.dialogue_id AND u.speaker = 'unknown')")
def p15_scope_with_fallback(spark, sf_dir):
    return matching.scoped(_turns(spark, sf_dir), "unknown").select("dialogue_id", "turn_index")


@query(f"""SELECT dialogue_id, 'knowledge' AS family, fact_id AS target, verdict, 1 AS turn_index, CASE verdict WHEN '冲突' THEN 'against' WHEN '支持' THEN 'for' ELSE 'open' END AS effect FROM {base.spoken.CHECKED}
UNION ALL SELECT dialogue_id, 'constraint', constraint_id, verdict, 2, CASE verdict WHEN '违规' THEN 'against' ELSE 'for' END FROM {base.spoken.LIMITED}
UNION ALL SELECT dialogue_id, 'context', policy_id, status, trigger_turn, CASE status WHEN '已处理' THEN 'for' ELSE 'against' END FROM {base.spoken.CONTEXT} UNION ALL SELECT dialogue_id, 'flow', node_id, status, 3, CASE status WHEN '已完成' THEN 'for' ELSE 'against' END FROM {base.spoken.STEPS} WHERE active""")
def d25_ledger(spark, sf_dir):
    rows = lambda x: _values(spark, sf_dir, x)
    checks, limits = rows(base.spoken.CHECKED).withColumn("turn_index", F.lit(1)), rows(base.spoken.LIMITED).withColumn("turn_index", F.lit(2))
    return ledger.evidence_ledger(checks, limits, rows(base.spoken.CONTEXT), rows(base.spoken.STEPS).withColumn("first_hit_turn", F.lit(3)))


AUDITED = f"(SELECT {DIALOGUE}, {pick(['r1', 'r2'])} AS rule_id, 'review' AS verdict, {pick(['甲', '乙', '丙'], 2)} AS value, {flag(3, 5)} AS is_hit FROM events) AS t"


@query(f"""WITH g AS (SELECT dialogue_id, rule_id, verdict, list_sort(list(DISTINCT value) FILTER (is_hit)) AS h, list_sort(list(DISTINCT value) FILTER (NOT is_hit)) AS m FROM {AUDITED} GROUP BY ALL)
SELECT dialogue_id, rule_id, verdict, coalesce(len(h), 0)::INTEGER AS n_hit, coalesce(len(m), 0)::INTEGER AS n_missing, coalesce(array_to_string(h[1:2], ','), '') AS hits, coalesce(array_to_string(m[1:2], ','), '') AS missing FROM g""")
def d18_element_digest(spark, sf_dir):
    return ledger.element_digest(_values(spark, sf_dir, AUDITED), 2)


# ------------------------------------------------------------------ the whole evaluation


@query(whole_sql.E2)
def e2_matches(spark, sf_dir):
    from turnweave.operators.atoms import atoms
    from turnweave.plans import sample

    rows = matching.match_rules(atoms(_turns(spark, sf_dir)), sample.catalogue(spark).elements)
    return rows.withColumn("score", F.round("score", 6))


@query(whole_sql.E1)
def e1_evaluate(spark, sf_dir):
    from turnweave.plans import sample

    columns = ("node_completion", "relation_score", "knowledge_score", "constraint_score", "soft_score", "total")
    return sample.evaluated(spark, _turns(spark, sf_dir))["scores"].select("dialogue_id", *[F.round(c, 6).alias(c) for c in columns], "missing_nodes", "context_problem")


def _run(spark, sf_dir):
    from turnweave.plans import graph, run, sample
    from turnweave.sources.shared import new_folder

    return run.run(_turns(spark, sf_dir), sample.graph(spark), graph.version(sample.GRAPH), new_folder(spark))


@query(whole_sql.R1)
def r1_run(spark, sf_dir):
    """A whole run into an empty store."""
    return _run(spark, sf_dir)["decisions"].withColumn("total", F.round("total", 6))


@query(whole_sql.E1[: whole_sql.E1.index("ended AS (")].rstrip().rstrip(",") + " SELECT * FROM events")
def j11_terminal_policies(spark, sf_dir):
    from turnweave.plans import evaluate, sample

    return evaluate.policy_events(_turns(spark, sf_dir), sample.graph(spark).parts.policies).select("dialogue_id", "safe_turn", "status")


# Answers as models write them: in text and fences, with commas too many, cut off, in arrays and wrappers; every tenth is none.
# Braces are written as < and >, as the text of a query names its tables in braces.
WRITTEN = (
    f"(SELECT CAST(event_id AS STRING) AS file, CAST(event_id % 64 AS DOUBLE) / 64 AS c, {pick(['hit', 'miss', 'review'], 3)} AS v, event_id % 10 = 0 AS broken, "
    f"{pick(['', 'Here it is: ', '<"results": [', '[', '// note '], 2)} AS head, {pick(['>', ',>', '', '> is all', ' /* so */ >'], 7)} AS tail FROM events) AS t"
)
_WRITTEN_TEXT = """CASE WHEN broken THEN 'I cannot say.' ELSE translate(head || '<"candidate_id": "c' || file || '", verdict: "' || v || '", "confidence": ' || CAST(c AS STRING) || tail, '<>', '{}') END"""


@query(f"SELECT file, CASE WHEN NOT broken THEN 'c' || file END AS candidate_id, CASE WHEN NOT broken THEN v END AS verdict, CASE WHEN NOT broken THEN c END AS confidence, CASE WHEN broken THEN 'no JSON in the text' END AS problem FROM {WRITTEN}")
def s12_raw_answers(spark, sf_dir):
    from turnweave.sources import packs

    rows = _values(spark, sf_dir, WRITTEN).select("file", F.expr(_WRITTEN_TEXT).alias("raw"))
    return packs.parsed_answers(rows).select("file", "candidate_id", "verdict", "confidence", "problem")
