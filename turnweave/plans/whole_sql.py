"""SQL of the whole evaluation over the sample graph: a second, relational statement of it, for comparison.

It holds for graphs like the sample: one term an element, terms of requirements under five characters (met literally), no
patterns, objects, values, directions or carried facts, one policy.
"""

from __future__ import annotations

from turnweave.functions.cues import EARLY_STOP
from turnweave.plans.catalogue import rule_rows
from turnweave.plans.graph import graph_rows
from turnweave.plans.queries import ATOMS, q_chars, q_compact, q_strict, q_text_hit
from turnweave.plans.sample import GRAPH
from turnweave.plans.spoken import literal

PARTS, RULES, TABLES = graph_rows(GRAPH)


def _table(name: str, columns: str, rows: list[tuple]) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(literal, row)) + ")" for row in rows) + ")"


def _elements() -> str:
    rows, made = [], rule_rows(RULES)
    # Places of groups and of elements in them: where a match stands is told by the first hit one.
    with_main = {r[3] for r in made if r[14]}
    for r in made:
        group_ord, element_ord = r[4], r[9]
        rule, kind, group, decisive, whole, element, term, main, fact, scope, fallback, weight, precise = r[0], r[1], r[3], r[6], r[7], r[8], r[11], r[14], r[15], r[17], r[18], r[20], r[21]
        main = main or group not in with_main  # a group without a main element counts by all of its elements
        rows.append((rule, kind, group, element, term, main, fact, bool(decisive), bool(whole), scope, fallback, float(weight), bool(precise), *map(float, r[22:26]), group_ord, element_ord))
    return _table("el", "rule_id, rule_type, group_id, element_id, term, main, fact, decisive, whole, scope, fallback, weight, precise, hm, hg, rm, rg, group_ord, element_ord", rows)


FACTORS = "(VALUES (0, 1.0, 'same_atom'), (1, 0.92, 'same_turn_adjacent_2'), (2, 0.82, 'same_turn_adjacent_3'), (3, 0.96, 'same_speaker_adjacent_turn_2'), (4, 0.9, 'same_speaker_adjacent_turn_3')) AS x(w, factor, window_name)"

#: From spans to the best window of each rule: el, hits, anchors, members, windows, verdicts of groups, settled windows, matches.
MATCHES = f"""{ATOMS}, {_elements()},
ev AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, turn_index ORDER BY seq) AS place FROM atoms WHERE seq > 0 OR n_spans = 1),
hits AS (SELECT rule_id, element_id, main, dialogue_id, turn_index, seq FROM atoms, el WHERE {q_text_hit('term', 'text')}),
rules AS (SELECT rule_id, any_value(rule_type) AS rule_type, any_value(scope) AS scope, bool_or(fallback) AS fallback FROM el GROUP BY 1),
anchors AS (SELECT DISTINCT h.rule_id, rule_type, e.dialogue_id, e.turn_index AS a_turn, e.seq AS a_seq, e.place, e.speaker FROM hits h JOIN ev e USING (dialogue_id, turn_index, seq) JOIN rules USING (rule_id)
  WHERE h.main AND (e.speaker = scope OR (fallback AND NOT EXISTS (SELECT 1 FROM atoms o WHERE o.dialogue_id = e.dialogue_id AND o.speaker = scope)))),
members AS (SELECT a.rule_id, rule_type, a.dialogue_id, a_turn, a_seq, w, factor, window_name, e.turn_index, e.seq, e.text FROM anchors a JOIN ev e ON a.dialogue_id = e.dialogue_id, {FACTORS}
  WHERE (w = 0 OR NOT starts_with(rule_type, 'constraint_')) AND (w <= 2 OR rule_type = 'node_positive')
    AND CASE WHEN w <= 2 THEN e.turn_index = a_turn AND abs(e.place - a.place) <= w ELSE e.speaker = a.speaker AND e.seq > 0 AND abs(e.turn_index - a_turn) <= w - 2 END),
windows AS (SELECT rule_id, rule_type, dialogue_id, a_turn, a_seq, w, factor, window_name, string_agg(text, ' ' ORDER BY turn_index, seq) AS joined, count(*) AS size, min({{'t': turn_index, 's': seq}}) AS first FROM members GROUP BY ALL HAVING count(*) > 1 OR w = 0),
inside AS (SELECT m.rule_id, m.dialogue_id, a_turn, a_seq, w, element_id, min({{'t': m.turn_index, 's': m.seq}}) AS spot FROM members m JOIN hits h ON h.rule_id = m.rule_id AND h.dialogue_id = m.dialogue_id AND h.turn_index = m.turn_index AND h.seq = m.seq GROUP BY ALL),
over_ AS (SELECT DISTINCT n.rule_id, dialogue_id, a_turn, a_seq, w, element_id, first AS spot FROM windows n JOIN el USING (rule_id) WHERE n.rule_type = 'node_positive' AND size > 1 AND {q_strict('term', 'joined')}),
found AS (SELECT rule_id, dialogue_id, a_turn, a_seq, w, element_id, coalesce(i.spot, o.spot) AS spot FROM inside i FULL JOIN over_ o USING (rule_id, dialogue_id, a_turn, a_seq, w, element_id)),
measured AS (SELECT n.rule_id, n.rule_type, n.dialogue_id, n.a_turn, n.a_seq, n.w, factor, window_name, group_id, decisive, whole, hm, hg, rm, rg, f.element_id IS NOT NULL AS hit, main, fact, weight, precise, f.spot, first, group_ord, element_ord
  FROM windows n JOIN el USING (rule_id) LEFT JOIN found f ON f.rule_id = n.rule_id AND f.dialogue_id = n.dialogue_id AND f.a_turn = n.a_turn AND f.a_seq = n.a_seq AND f.w = n.w AND f.element_id = el.element_id),
sums AS (SELECT rule_id, rule_type, dialogue_id, a_turn, a_seq, w, factor, window_name, group_id, group_ord, first, decisive, whole, hm, hg, rm, rg, arg_min(spot, element_ord) FILTER (hit) AS spot, coalesce(sum(weight) FILTER (hit), 0) / sum(weight) AS raw_group, coalesce(sum(weight) FILTER (hit AND main), 0) / sum(weight) FILTER (main) AS raw_core,
  count(*) FILTER (main) AS n_core, count(*) FILTER (main AND hit) AS core_hit, count(*) FILTER (hit) AS n_hit, count(*) FILTER (fact) AS n_fact, count(*) FILTER (fact AND NOT hit) AS fact_missing, count(*) FILTER (main AND NOT fact AND NOT hit) AS trunk_missing,
  count(*) FILTER ((main OR fact) AND precise AND NOT hit) AS precise_missing, coalesce(bool_or(fact AND hit), false) AS fact_hit FROM measured GROUP BY ALL),
covered AS (SELECT *, CASE WHEN core_hit > 0 THEN greatest(raw_core, 0.5 + 0.5 * core_hit / n_core) ELSE raw_core END AS raw_main, n_fact > 0 AND (starts_with(rule_type, 'knowledge_') OR starts_with(rule_type, 'constraint_')) AS facts FROM sums),
shares AS (SELECT *, CASE WHEN w IN (1, 2) AND raw_group >= 0.999 AND raw_main >= 0.999 THEN 1 ELSE least(1, raw_main * factor) END AS mc, CASE WHEN w IN (1, 2) AND raw_group >= 0.999 AND raw_main >= 0.999 THEN 1 ELSE least(1, raw_group * factor) END AS gc FROM covered),
vetoed AS (SELECT *, CASE WHEN rule_type = 'node_positive' AND precise_missing > 0 THEN 0.65 WHEN facts AND trunk_missing > 0 THEN 0.7 WHEN facts AND fact_missing > 0 THEN 0.8 WHEN rule_type = 'node_trigger' AND core_hit < n_core THEN 0.65 WHEN whole AND core_hit < n_core THEN 0.75 END AS veto FROM shares),
judged AS (SELECT *, CASE WHEN veto IS NOT NULL THEN 'miss' WHEN mc >= hm AND n_hit > 0 AND (facts OR gc >= hg) THEN 'hit' WHEN mc >= rm AND gc >= rg AND n_hit > 0 THEN 'review' ELSE 'miss' END AS verdict,
  (CASE WHEN veto IS NULL THEN 0.7 * mc + 0.3 * gc ELSE least(0.7 * mc + 0.3 * gc, rg * veto) END)::DOUBLE AS score FROM vetoed),
settling AS (SELECT rule_id, rule_type, dialogue_id, a_turn, a_seq, w, window_name, hg, rg, first.t AS first_turn, arg_min(spot, group_ord) FILTER (spot IS NOT NULL) AS spot, max(score) FILTER (decisive AND verdict = 'hit') AS h, max(score) FILTER (decisive AND verdict = 'review') AS v, max(score) FILTER (decisive) AS a,
  avg(score) FILTER (NOT decisive) AS s, coalesce(bool_or(fact_hit AND verdict = 'hit'), false) AS fact_hit FROM judged GROUP BY ALL),
mixed AS (SELECT *, CASE WHEN s IS NULL THEN coalesce(h, v, a, 0) ELSE 0.8 * coalesce(h, v, a, 0) + 0.2 * s END AS score FROM settling),
settled AS (SELECT *, CASE WHEN h IS NOT NULL AND score >= hg THEN 'hit' WHEN h IS NOT NULL OR v IS NOT NULL OR score >= rg THEN 'review' ELSE 'miss' END AS verdict FROM mixed),
placed AS (SELECT *, CASE verdict WHEN 'hit' THEN 3 WHEN 'review' THEN 2 ELSE 1 END AS rank FROM settled),
matches AS (SELECT dialogue_id, rule_id, rule_type, verdict, score, coalesce(spot.t, a_turn) AS turn_index, coalesce(spot.s, a_seq) AS seq, window_name, first_turn FROM placed QUALIFY row_number() OVER (PARTITION BY dialogue_id, rule_id ORDER BY rank DESC, score DESC, a_turn, a_seq, w) = 1)"""

E2 = f"WITH {MATCHES} SELECT dialogue_id, rule_id, rule_type, verdict, round(score, 6) AS score, turn_index, seq, window_name AS \"window\", first_turn FROM matches"


def _fuzzy(word: str, text: str, least: float, either: bool) -> str:
    """A word in a text literally, or by its characters."""
    c, t = f"'{word}'", q_compact(text)
    common = f"len(list_intersect({q_chars(c)}, {q_chars(t)}))"
    inside = f"contains({t}, {c})" + (f" OR ({t} <> '' AND contains({c}, {t}))" if either else "")
    return f"({inside} OR (least({len(word)}, length({t})) >= 3 AND {common} >= 2 AND {common} / least(len({q_chars(c)}), len({q_chars(t)})) >= {least}))"


def _words_of(x: str) -> str:
    return f"list_distinct(regexp_extract_all(lower({x}), '[a-z0-9]+'))"


_POLICY = PARTS.policies[0]
_SAFE = [w for p in _POLICY["safe"] for w in p["any"]]
_FORBIDDEN = [w for p in _POLICY["forbidden"] for w in p["any"]]
_NODES = _table("nodes", "node_id, node_type, mode, required", [(n["id"], n["type"], n["mode"], n["required"]) for n in TABLES["nodes"]])
_REQUIREMENTS = _table("reqs", "node_id, requirement_id, weight, required, conditional", [(*r[:4], r[5]) for r in TABLES["requirements"]])
_EDGES = _table("edges", "source, target, kind, weight", [(e["source"], e["target"], e["type"], e["weight"]) for e in TABLES["edges"]])
_MEMBERS = _table("listed", "group_id, group_type, position, node_id", TABLES["members"])
_WEIGHTS = _table("group_weights", "group_id, weight", [(g[0], g[2]) for g in TABLES["groups"]])
_STOPS = " OR ".join(f"contains(text, '{w}')" for w in EARLY_STOP)
_ASKED = _table("asked", "requirement_id, word", [(r["id"], e["value"]) for n in PARTS.nodes if n["type"] == "faq" for r in n["requirements"] for g in r["groups"] for e in g["elements"]])


def _steps(name: str, gone: str) -> str:
    """Steps without those that are gone."""
    on = f"(active AND (dialogue_id, node_id) NOT IN (SELECT dialogue_id, node_id FROM {gone}))"
    return f"""{name} AS (SELECT dialogue_id, node_id, node_type, {on} AS active, CASE WHEN {on} THEN score ELSE 1 END AS score, CASE WHEN {on} THEN status ELSE '未激活' END AS status, CASE WHEN {on} THEN first_hit END AS first_hit,
  CASE WHEN {on} THEN missing_required ELSE 0 END AS missing_required, CASE WHEN {on} THEN n_required ELSE 0 END AS n_required FROM activity)"""


#: Scores of every dialogue.
E1 = f"""WITH {MATCHES}, {_NODES}, {_REQUIREMENTS}, {_EDGES}, {_MEMBERS}, {_WEIGHTS}, {_ASKED},
dialogues AS (SELECT DISTINCT dialogue_id FROM turns),
fired AS (SELECT dialogue_id, substr(rule_id, 13) AS node_id, turn_index FROM matches WHERE starts_with(rule_id, 'activation::') AND verdict = 'hit'),
users AS (SELECT dialogue_id, turn_index, text FROM turns WHERE speaker = 'user'),
near AS (SELECT u.* FROM users u JOIN fired f ON f.dialogue_id = u.dialogue_id AND f.node_id = 'answers' AND u.turn_index BETWEEN greatest(0, f.turn_index - 2) AND f.turn_index + 4
  UNION ALL SELECT * FROM (SELECT u.* FROM users u WHERE NOT EXISTS (SELECT 1 FROM fired f WHERE f.dialogue_id = u.dialogue_id AND f.node_id = 'answers') QUALIFY row_number() OVER (PARTITION BY dialogue_id ORDER BY list_contains({_words_of('text')}, 'answers') DESC, CASE WHEN list_contains({_words_of('text')}, 'answers') THEN turn_index ELSE -turn_index END) <= 2)),
contexts AS (SELECT dialogue_id, {_words_of("string_agg(text, ' ')")} AS toks FROM near WHERE trim(text) <> '' GROUP BY 1),
kept AS (SELECT dialogue_id, requirement_id, bool_or(list_contains(toks, word) OR list_contains(toks, 'answers')) AS named FROM contexts, asked GROUP BY 1, 2),
routed AS (SELECT *, NOT named AND bool_or(named) OVER (PARTITION BY dialogue_id) AS skipped FROM kept),
early AS (SELECT DISTINCT dialogue_id FROM turns WHERE speaker = 'user' AND turn_index IN (1, 2) AND ({_STOPS})),
results AS (SELECT d.dialogue_id, r.node_id, r.requirement_id, weight, (required OR (conditional AND d.dialogue_id NOT IN (SELECT dialogue_id FROM early))) AND NOT coalesce(skipped, false) AS required, coalesce(verdict = 'hit' AND score >= 0.72, false) AS clear, CASE WHEN skipped THEN 1 WHEN verdict IN ('hit', 'review') THEN least(1, score) ELSE 0 END AS score,
  coalesce(skipped, false) OR coalesce(verdict = 'hit', false) AS matched, CASE WHEN skipped THEN 0 WHEN verdict IN ('hit', 'review') THEN first_turn END AS turn_index
  FROM dialogues d, reqs r LEFT JOIN matches m ON m.dialogue_id = d.dialogue_id AND m.rule_id = r.requirement_id LEFT JOIN routed s ON s.dialogue_id = d.dialogue_id AND s.requirement_id = r.requirement_id),
means AS (SELECT dialogue_id, node_id, CASE WHEN count(*) FILTER (required) = 0 THEN 1 ELSE sum(score * weight) FILTER (required) / sum(weight) FILTER (required) END AS mean, count(*) FILTER (required AND score <= 0.0001) AS zero, min(turn_index) AS first_found,
  count(*) FILTER (required AND NOT matched) AS missing_required, count(*) FILTER (required) AS n_required, bool_or(clear) AS clear FROM results GROUP BY 1, 2),
levelled AS (SELECT *, CASE WHEN zero > 0 AND n_required > 1 THEN least(mean, 0.58) ELSE mean END AS score FROM means),
scored AS (SELECT l.* EXCLUDE (first_found), coalesce(first_found, CASE WHEN score >= 0.75 AND n.mode = 'optional' THEN f.turn_index END) AS first_hit FROM levelled l JOIN nodes n USING (node_id) LEFT JOIN fired f USING (dialogue_id, node_id)),
activity AS (SELECT s.*, node_type, CASE WHEN score >= 0.75 THEN '已完成' WHEN score >= 0.35 THEN '部分完成' ELSE '缺失' END AS status,
  CASE WHEN mode = 'always' THEN true WHEN node_type = 'terminal' THEN f.node_id IS NOT NULL ELSE f.node_id IS NOT NULL OR clear END AS active FROM scored s JOIN nodes USING (node_id) LEFT JOIN fired f USING (dialogue_id, node_id)),
started AS (SELECT dialogue_id, min(turn_index) AS trigger_turn FROM turns WHERE speaker = 'user' AND contains(lower(text), 'eau') GROUP BY 1),
handled AS (SELECT s.dialogue_id, trigger_turn, coalesce(min(turn_index) FILTER ({' OR '.join(_fuzzy(w, 'text', 0.75, True) for w in _SAFE)}), min(turn_index) FILTER ({' OR '.join(_fuzzy(w, 'text', 0.5, False) for w in _SAFE)})) AS safe_turn
  FROM started s LEFT JOIN turns t ON t.dialogue_id = s.dialogue_id AND t.speaker = 'assistant' AND t.turn_index > trigger_turn GROUP BY 1, 2),
events AS (SELECT h.dialogue_id, safe_turn, CASE WHEN safe_turn IS NULL THEN '触发但未处理' WHEN count(t.turn_index) > 0 THEN '已处理但后续违背转场' ELSE '已处理' END AS status
  FROM handled h LEFT JOIN turns t ON t.dialogue_id = h.dialogue_id AND t.speaker = 'assistant' AND t.turn_index > safe_turn AND ({' OR '.join(_fuzzy(w, 'text', 0.75, True) for w in _FORBIDDEN)}) GROUP BY 1, 2),
ended AS (SELECT e.dialogue_id, n.node_id FROM events e, nodes n WHERE status = '已处理' AND (node_type = 'terminal' OR NOT EXISTS (SELECT 1 FROM matches m JOIN reqs r ON r.requirement_id = m.rule_id WHERE r.node_id = n.node_id AND m.dialogue_id = e.dialogue_id AND m.verdict = 'hit' AND m.turn_index <= safe_turn))),
{_steps('first_pass', 'ended')},
stopped AS (SELECT * FROM ended UNION SELECT dialogue_id, 'answers' FROM first_pass JOIN fired USING (dialogue_id, node_id) WHERE node_id = 'close' AND active AND (first_hit IS NOT NULL OR score >= 0.35)),
{_steps('steps', 'stopped')},
links AS (SELECT a.dialogue_id, weight, a.active AS aa, b.active AS ba, a.status = '缺失' AS am, b.status = '缺失' AS bm, a.score AS s1, b.score AS s2, coalesce(a.first_hit > b.first_hit, false) AS turned, kind = 'strict_before' AS hard, kind IN ('before', 'strict_before') AS ordered
  FROM steps a JOIN edges ON a.node_id = source JOIN steps b ON b.dialogue_id = a.dialogue_id AND b.node_id = target WHERE kind <> 'optional_after'),
pairs AS (SELECT dialogue_id, 100 * avg((s1 + s2) / 2) FILTER (aa AND ba) AS pair_mean, sum(weight * (CASE WHEN ba AND hard AND (NOT aa OR am) THEN 8 ELSE 0 END + CASE WHEN aa AND ba THEN CASE WHEN am AND NOT bm THEN CASE WHEN hard THEN 8 ELSE 4 END ELSE 0 END
  + CASE WHEN ordered AND bm AND NOT am THEN CASE WHEN hard THEN 6 ELSE 3 END ELSE 0 END + CASE WHEN turned THEN CASE WHEN hard THEN 10 ELSE 4 END ELSE 0 END ELSE 0 END)) AS penalty FROM links GROUP BY 1),
in_groups AS (SELECT s.*, group_id, group_type, coalesce(lag(first_hit) OVER (PARTITION BY dialogue_id, group_id ORDER BY position) > first_hit, false) AS turned FROM steps s JOIN listed USING (node_id) WHERE active),
valued AS (SELECT dialogue_id, group_id, CASE group_type WHEN 'any_of' THEN 100 * max(score) ELSE greatest(0, 100 * avg(score) - 8 * count(*) FILTER (turned)) END AS g FROM in_groups GROUP BY dialogue_id, group_id, group_type),
grouped AS (SELECT d.dialogue_id, sum(coalesce(g, 100) * w.weight) / sum(w.weight) AS grouped FROM dialogues d CROSS JOIN group_weights w LEFT JOIN valued v ON v.dialogue_id = d.dialogue_id AND v.group_id = w.group_id GROUP BY 1),
inner_ AS (SELECT a.dialogue_id, CASE WHEN b.matched AND NOT a.matched THEN 5 WHEN a.turn_index >= b.turn_index THEN 7 ELSE 0 END AS penalty
  FROM results a JOIN results b ON a.dialogue_id = b.dialogue_id AND a.requirement_id = 'greet.0' AND b.requirement_id = 'greet.1' JOIN steps s ON s.dialogue_id = a.dialogue_id AND s.node_id = 'greet' AND s.active),
less AS (SELECT dialogue_id, sum(penalty) AS more FROM (SELECT * FROM inner_ UNION ALL SELECT dialogue_id, CASE status WHEN '触发但未处理' THEN 12 WHEN '已处理但后续违背转场' THEN 18 ELSE 0 END FROM events) GROUP BY 1),
related AS (SELECT d.dialogue_id, greatest(0, greatest(0, 0.55 * coalesce(pair_mean, 100) + 0.45 * coalesce(grouped, 100) - coalesce(penalty, 0)) - coalesce(more, 0)) AS relation_score FROM dialogues d LEFT JOIN pairs USING (dialogue_id) LEFT JOIN grouped USING (dialogue_id) LEFT JOIN less USING (dialogue_id)),
conflicts AS (SELECT DISTINCT dialogue_id, CASE rule_id WHEN 'fact.wrong' THEN 2 ELSE 3 END AS worst, CASE rule_id WHEN 'fact.wrong' THEN 9.6 ELSE 22.4 END AS loss FROM settled WHERE rule_id IN ('fact.wrong', 'other.wrong') AND verdict = 'hit'),
known AS (SELECT dialogue_id, greatest(0, 100 - sum(loss)) AS knowledge_score, max(worst) AS knowledge_worst FROM conflicts GROUP BY 1),
negatives AS (SELECT p.* FROM placed p LEFT JOIN matches t ON t.dialogue_id = p.dialogue_id AND t.rule_id = 'later.trigger' AND p.rule_id = 'later.negative' WHERE p.rule_id = 'ban.negative' OR (p.rule_id = 'later.negative' AND t.verdict = 'hit' AND p.a_turn > t.turn_index)
  QUALIFY row_number() OVER (PARTITION BY p.dialogue_id, p.rule_id ORDER BY rank DESC, p.score DESC, a_turn, a_seq) = 1),
broken AS (SELECT n.dialogue_id, CASE n.rule_id WHEN 'ban.negative' THEN 3 ELSE 1 END AS worst, CASE n.rule_id WHEN 'ban.negative' THEN 28 ELSE 5 END AS loss FROM negatives n LEFT JOIN settled s ON n.rule_id = 'ban.negative' AND s.rule_id = 'ban.safe' AND s.dialogue_id = n.dialogue_id AND s.a_turn = n.a_turn AND s.a_seq = n.a_seq
  WHERE n.verdict = 'hit' AND coalesce(s.verdict, 'miss') <> 'hit'),
limits AS (SELECT dialogue_id, greatest(0, 100 - sum(loss)) AS constraint_score, max(worst) AS constraint_worst FROM broken GROUP BY 1),
spoken AS (SELECT a.dialogue_id, count(*) AS n, count(*) FILTER (EXISTS (SELECT 1 FROM settled s WHERE s.rule_id = 'kind.soft' AND s.verdict IN ('hit', 'review') AND s.dialogue_id = a.dialogue_id AND s.a_turn = a.turn_index AND s.a_seq = a.seq)) AS h FROM atoms a WHERE speaker = 'assistant' GROUP BY 1),
longest AS (SELECT dialogue_id, max(length({q_compact('text')})) AS n FROM turns WHERE speaker = 'assistant' GROUP BY 1),
soft AS (SELECT d.dialogue_id, 50 * coalesce(least(1, h / s.n / 0.9), 1) + 50 * CASE WHEN l.n > 150 THEN greatest(0, 1 - (l.n - 150) / 150) ELSE 1 END AS soft_score FROM dialogues d LEFT JOIN spoken s USING (dialogue_id) LEFT JOIN longest l USING (dialogue_id)),
summed AS (SELECT dialogue_id, coalesce(100 * avg(score) FILTER (active), 0) AS node_completion, count(*) FILTER (active AND status = '缺失') AS missing_nodes, sum(missing_required) AS missing_required, sum(n_required) AS n_required FROM steps GROUP BY 1),
joined AS (SELECT s.*, relation_score, soft_score, coalesce(knowledge_score, 100) AS knowledge_score, coalesce(knowledge_worst, 0) AS kw, coalesce(constraint_score, 100) AS constraint_score, coalesce(constraint_worst, 0) AS cw, coalesce(status <> '已处理', false) AS context_problem
  FROM summed s JOIN related USING (dialogue_id) JOIN soft USING (dialogue_id) LEFT JOIN known USING (dialogue_id) LEFT JOIN limits USING (dialogue_id) LEFT JOIN events USING (dialogue_id)),
f AS (SELECT *, missing_nodes > 0 OR missing_required > 0 AS flow, missing_nodes >= 2 OR missing_required >= 2 OR missing_required / greatest(1, n_required) >= 0.25 AS many, CASE kw WHEN 1 THEN 68 WHEN 2 THEN 60 WHEN 3 THEN 52 WHEN 4 THEN 48 END AS k, CASE cw WHEN 1 THEN 62 WHEN 2 THEN 54 WHEN 3 THEN 46 WHEN 4 THEN 38 END AS c FROM joined),
g AS (SELECT *, CASE WHEN flow THEN CASE WHEN many THEN 58 ELSE 66 END END AS fl, flow::INT + (k IS NOT NULL)::INT + (c IS NOT NULL)::INT + context_problem::INT AS n FROM f),
z AS (SELECT dialogue_id, missing_nodes, context_problem, soft_score, least(node_completion, fl) AS node_completion, least(relation_score, CASE WHEN context_problem THEN 62 END) AS relation_score, least(knowledge_score, k) AS knowledge_score, least(constraint_score, c) AS constraint_score,
  least(fl, k, c, CASE WHEN context_problem THEN CASE WHEN n >= 2 THEN 52 ELSE 62 END END, CASE WHEN n >= 2 THEN 42 END) AS cap FROM g)
SELECT dialogue_id, round(node_completion, 6)::DOUBLE AS node_completion, round(relation_score, 6)::DOUBLE AS relation_score, round(knowledge_score, 6)::DOUBLE AS knowledge_score, round(constraint_score, 6)::DOUBLE AS constraint_score, round(soft_score, 6)::DOUBLE AS soft_score,
 missing_nodes, context_problem, round(least(0.5 * node_completion + 0.1 * relation_score + 0.2 * knowledge_score + 0.15 * constraint_score + 0.05 * soft_score, cap), 6)::DOUBLE AS total FROM z"""


#: Acceptance of every dialogue as a positive sample: the floors of its capped components, and what else speaks against it.
R1 = E1[: E1.rindex("SELECT dialogue_id, round(node_completion")] + """,
bad AS (SELECT dialogue_id, count(*) AS n_bad FROM (SELECT dialogue_id FROM conflicts UNION ALL SELECT dialogue_id FROM broken) GROUP BY 1),
held AS (SELECT z.*, s.missing_required, coalesce(n_bad, 0) AS n_bad, least(0.5 * node_completion + 0.1 * relation_score + 0.2 * knowledge_score + 0.15 * constraint_score + 0.05 * soft_score, cap) AS total
  FROM z JOIN (SELECT dialogue_id, missing_required FROM summed) s USING (dialogue_id) LEFT JOIN bad USING (dialogue_id)),
said AS (SELECT *, array_to_string(list_filter([CASE WHEN total < 90 THEN 'total' END, CASE WHEN node_completion < 78 THEN 'node_completion' END, CASE WHEN relation_score < 70 THEN 'relation_score' END, CASE WHEN knowledge_score < 98 THEN 'knowledge_score' END,
  CASE WHEN constraint_score < 98 THEN 'constraint_score' END, CASE WHEN n_bad > 0 THEN 'bad_event' END, CASE WHEN missing_nodes > 0 THEN 'missing_node' END, CASE WHEN missing_required > 0 THEN 'missing_requirement' END, CASE WHEN context_problem THEN 'context' END], lambda x: x IS NOT NULL), ',') AS reasons FROM held)
SELECT dialogue_id, round(total, 6)::DOUBLE AS total, reasons = '' AS passed, reasons, CASE WHEN reasons = '' THEN 'accepted' WHEN n_bad > 0 OR context_problem THEN 'blocked' ELSE 'incomplete' END AS decision FROM said"""
