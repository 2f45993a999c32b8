"""Queries of cues, requirements, ledgers and routing, and their SQL; registered beside the others."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from turnweave.functions import cues
from turnweave.functions.text import overlap_coefficient
from turnweave.operators import judges, ledger, requirements
from turnweave.plans import queries as base
from turnweave.plans.spoken import ACTIVE_NODES, ANSWERS, ASKED, CHECKED, CONTEXT, FLAT, FOUND, LABELS, LEDGER, LIMITED, NAMES, PENALTIES, SAID, STEPS, TURNED
from turnweave.plans.queries import PAIRS, TURNS, _documents, _text, _turns, _values, q_any, q_chars, q_compact, q_strict, query

# ------------------------------------------------------------------ cues


@query(f"SELECT id, {q_any(q_compact('s'), cues.INQUIRY)} AND {q_any(q_compact('s'), cues.AWARENESS)} AS hit FROM {SAID}")
def p24_generic_inquiry(spark, sf_dir):
    return _values(spark, sf_dir, SAID).select("id", cues.generic_inquiry("s").alias("hit"))


@query(f"SELECT id, {q_compact('s')} <> '' AND length({q_compact('s')}) <= 16 AND NOT {q_any(q_compact('s'), cues.ACK_NO)} AND {q_any(q_compact('s'), cues.ACK_YES)} AS hit FROM {SAID}")
def p23_short_affirmation(spark, sf_dir):
    return _values(spark, sf_dir, SAID).select("id", cues.short_affirmation("s").alias("hit"))


@query(f"SELECT id, regexp_full_match({q_compact('s')}, '[一-鿿]{{1,2}}') AS hit FROM {SAID}")
def p25_short_predicate(spark, sf_dir):
    return _values(spark, sf_dir, SAID).select("id", cues.short_predicate("s").alias("hit"))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, {q_any('text', cues.QUESTION)} AS asks FROM turns")
def p26_questionish(spark, sf_dir):
    return _turns(spark, sf_dir).select("dialogue_id", "turn_index", cues.questionish("text").alias("asks"))


@query(f"SELECT id, NOT {q_any(q_compact('s'), cues.STOP)} AND {q_any(q_compact('s'), cues.CONTINUE)} AS hit FROM {SAID}")
def p27_allows_continue(spark, sf_dir):
    return _values(spark, sf_dir, SAID).select("id", cues.allows_continue("s").alias("hit"))


@query(f"WITH {TURNS} SELECT DISTINCT dialogue_id FROM turns WHERE speaker = 'user' AND turn_index IN (1, 2) AND (contains(text, 'er') OR contains(text, 'the'))")
def p28_early_stops(spark, sf_dir):
    return requirements.early_stops(_turns(spark, sf_dir), ("er", "the"))


def q_loose(a: str, b: str, least: float) -> str:
    x, y = q_chars(q_compact(a)), q_chars(q_compact(b))
    common = f"len(list_intersect({x}, {y}))"
    return f"(least(length({q_compact(a)}), length({q_compact(b)})) >= 3 AND {common} >= 2 AND {common} / least(len({x}), len({y})) >= {least})"


def q_fuzzy(a: str, b: str) -> str:
    x, y = q_compact(a), q_compact(b)
    return f"({a} <> '' AND (contains(lower({b}), lower({a})) OR ({x} <> '' AND {y} <> '' AND (contains({y}, {x}) OR contains({x}, {y}) OR {q_loose(a, b, 0.75)}))))"


@query(f"SELECT id, {q_fuzzy('a', 'b')} AS hit FROM {PAIRS}")
def p21_fuzzy_hit(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", cues.fuzzy_hit("a", "b").alias("hit"))


@query(f"WITH {TURNS}, p AS (SELECT *, lead(text) OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS after FROM turns) SELECT dialogue_id, turn_index FROM p WHERE after IS NOT NULL AND {q_compact('text')} <> '' AND {q_compact('after')} <> '' AND (contains({q_compact('after')}, {q_compact('text')}) OR {q_loose('text', 'after', 0.95)})")
def p30_loose_hit(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("after", F.lead("text").over(Window.partitionBy("dialogue_id").orderBy("turn_index"))).where("after IS NOT NULL")
    return rows.where(cues.loose_hit("text", "after", 0.95)).select("dialogue_id", "turn_index")


@query(
    f"WITH x AS (SELECT id, a, b, {q_compact('a')} AS x, {q_compact('b')} AS y, list_filter(regexp_split_to_array({q_compact('a')}, {_text(cues.PARTS)}), lambda p: p <> '') AS parts FROM {PAIRS})"
    f" SELECT id, x <> '' AND y <> '' AND ({q_strict('a', 'b')} OR (length(x) >= 4 AND ((len(parts) >= 2 AND len(list_filter(parts, lambda p: NOT contains(y, p))) = 0) OR (contains(y, left(x, 2)) AND contains(y, right(x, 2)))))) AS hit FROM x"
)
def p8_anchor_hit(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", cues.anchor_hit("a", "b").alias("hit"))


@query(f"WITH {TURNS}, k AS (SELECT *, list_distinct(list_concat(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9一-鿿]+'), lambda x: x <> ''), regexp_extract_all(lower(text), '[a-z0-9]+'))) AS toks FROM turns), p AS (SELECT *, lead(toks) OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS after FROM k) SELECT dialogue_id, turn_index, round(CASE WHEN least(len(toks), len(after)) > 0 THEN len(list_intersect(toks, after)) / least(len(toks), len(after)) ELSE 0 END, 6)::DOUBLE AS similarity FROM p WHERE after IS NOT NULL")
def f16_mixed_tokens(spark, sf_dir):
    rows = _turns(spark, sf_dir).withColumn("toks", cues.mixed_tokens("text"))
    rows = rows.withColumn("after", F.lead("toks").over(Window.partitionBy("dialogue_id").orderBy("turn_index"))).where("after IS NOT NULL")
    return rows.select("dialogue_id", "turn_index", F.round(overlap_coefficient(F.col("toks"), F.col("after")), 6).alias("similarity"))



@query(
    f"WITH a AS (SELECT id, lower(trim(coalesce(answer, ''))) AS a FROM {ANSWERS}) SELECT id, CASE WHEN a IN {cues.CONFIRMED} THEN 'confirmed_issue' WHEN a IN {cues.REFUSED} THEN 'no_issue' WHEN a IN {cues.OPEN} THEN 'uncertain'"
    f" WHEN {q_any('a', cues.HOLDS_CONFIRMED)} THEN 'confirmed_issue' WHEN {q_any('a', cues.HOLDS_REFUSED)} THEN 'no_issue' WHEN {q_any('a', cues.HOLDS_OPEN)} THEN 'uncertain'"
    " WHEN contains(a, 'confirm') OR (contains(a, 'issue') AND NOT contains(a, 'no')) THEN 'confirmed_issue' WHEN contains(a, 'no') OR contains(a, 'safe') THEN 'no_issue' ELSE 'uncertain' END AS verdict FROM a"
)
def f24_arbiter_verdict(spark, sf_dir):
    return _values(spark, sf_dir, ANSWERS).select("id", cues.arbiter_verdict("answer").alias("verdict"))



@query(
    f"WITH n AS (SELECT id, lower(trim(coalesce(name, ''))) AS n, coalesce(kind, '') AS k FROM {NAMES}) SELECT id, CASE "
    + " ".join(f"WHEN list_contains({list(names)}, n) THEN '{family}'" for family, names in cues.FAMILIES.items())
    + " " + " ".join(f"WHEN contains(k, '{word}') THEN '{family}'" for word, family in cues.KINDS)
    + " WHEN n <> '' THEN n ELSE 'unknown' END AS family FROM n"
)
def f25_error_family(spark, sf_dir):
    return _values(spark, sf_dir, NAMES).select("id", cues.error_family("name", F.col("kind")).alias("family"))


# ------------------------------------------------------------------ requirements


@query(f"WITH {TURNS}, n AS (SELECT dialogue_id FROM turns WHERE speaker = 'assistant' GROUP BY 1 HAVING bool_or(contains(text, 'the'))::INT + bool_or(contains(text, 'tion'))::INT + bool_or(contains(text, 'eau'))::INT >= 2) SELECT dialogue_id, turn_index FROM turns JOIN n USING (dialogue_id) WHERE speaker = 'assistant' AND (contains(text, 'the') OR contains(text, 'tion') OR contains(text, 'eau'))")
def j8_window_union(spark, sf_dir):
    return requirements.window_union(_turns(spark, sf_dir), "assistant", ("the", "tion", "eau"), 2)


@query(f"WITH {TURNS}, b AS (SELECT DISTINCT a.dialogue_id FROM turns a JOIN turns u ON a.dialogue_id = u.dialogue_id AND u.turn_index > a.turn_index AND u.turn_index <= a.turn_index + 2 WHERE a.speaker = 'assistant' AND contains(a.text, 'in') AND u.speaker = 'user' AND contains(u.text, 'an')), n AS (SELECT dialogue_id FROM turns GROUP BY 1 HAVING coalesce(bool_or(contains(text, 'the') AND speaker = 'assistant'), false)::INT + coalesce(bool_or(contains(text, 'eau') AND speaker = 'assistant'), false)::INT + (dialogue_id IN (FROM b))::INT >= 2) SELECT dialogue_id, turn_index FROM turns JOIN n USING (dialogue_id) WHERE speaker = 'assistant' AND (contains(text, 'the') OR contains(text, 'eau'))")
def j8_window_union_with_reply(spark, sf_dir):
    return requirements.window_union(_turns(spark, sf_dir), "assistant", ("the", "eau"), 2, F.contains("text", F.lit("in")), 2, F.contains("text", F.lit("an")))


@query(f"WITH {TURNS}, s AS (SELECT dialogue_id, turn_index, lead(turn_index) OVER w AS after, lag(turn_index) OVER w AS before, contains(text, 'the') AS hit FROM turns WHERE speaker = 'assistant' WINDOW w AS (PARTITION BY dialogue_id ORDER BY turn_index)), e AS (SELECT dialogue_id, turn_index AS t, 0 AS o FROM s WHERE hit UNION ALL SELECT dialogue_id, after, 1 FROM s WHERE hit AND after - turn_index <= 2 UNION ALL SELECT dialogue_id, before, 2 FROM s WHERE hit AND turn_index - before <= 2) SELECT dialogue_id, t AS turn_index, min(o)::INTEGER AS scope_ord FROM e GROUP BY 1, 2")
def j9_value_scope(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    return judges.value_scope(turns.where((F.col("speaker") == "assistant") & F.contains("text", F.lit("the"))), turns)


WORDS = "(VALUES ('g1', 'p1', 'the'), ('g1', 'p2', 'tion'), ('g1', 'p3', 'ung'), ('g2', 'p1', 'eau'), ('g2', 'p2', 'the')) AS w(group_id, pattern_id, word)"


@query(f"WITH {TURNS}, h AS (SELECT DISTINCT dialogue_id, group_id, pattern_id FROM turns, {WORDS} WHERE contains(text, word)) SELECT dialogue_id, group_id, count(*) AS n_hits, least(1.0, count(*) / 2)::DOUBLE AS score, count(*) >= 2 AS matched FROM h GROUP BY ALL")
def a20_pattern_groups(spark, sf_dir):
    hits = _turns(spark, sf_dir).join(F.broadcast(_values(spark, sf_dir, WORDS)), F.contains("text", F.col("word")))
    return requirements.pattern_groups(hits, _values(spark, sf_dir, "(VALUES ('g1', 2), ('g2', 2)) AS g(group_id, min_hits)"))


@query(f"SELECT word AS term, count(DISTINCT group_id) AS n_groups FROM {WORDS} GROUP BY 1 HAVING count(DISTINCT group_id) >= 2")
def a21_broad_terms(spark, sf_dir):
    return requirements.broad_terms(_values(spark, sf_dir, WORDS).withColumnRenamed("word", "term"))


@query("""WITH r AS (SELECT user_id, event_type, event_id, (event_id % 97) / 600.0::DOUBLE AS s FROM events), b AS (SELECT *, max(s) OVER w AS best FROM r WINDOW w AS (PARTITION BY user_id, event_type)),
n AS (SELECT *, s >= 0.10 AND s >= greatest(0.06, 0.55 * best) AS near FROM b), x AS (SELECT *, bool_or(near) OVER w AS any_near, min(CASE WHEN s = best THEN event_id END) OVER w AS first FROM n WINDOW w AS (PARTITION BY user_id, event_type))
SELECT user_id AS dialogue_id, event_type AS node_id, event_id AS requirement_id FROM x WHERE CASE WHEN any_near THEN near WHEN best > 0 THEN event_id = first ELSE true END""")
def w5_routed_answers(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("user_id").alias("dialogue_id"), F.col("event_type").alias("node_id"), F.col("event_id").alias("requirement_id"), ((F.col("event_id") % 97) / F.lit(600.0)).alias("similarity"))
    return requirements.routed(rows).select("dialogue_id", "node_id", "requirement_id")


RELATIONS = """(VALUES ('n', 'r1', 'any_of', array(), array(), array('c'), NULL), ('n', 'r2', 'all_of', array(), array(), array('a', 'c', 'zz'), NULL), ('n', 'r3', 'condition_on', array('a'), array('c'), array(), 9.0D),
 ('n', 'r4', 'before', array('a'), array('b'), array(), NULL), ('n', 'r5', 'before_or_same_turn', array('a'), array('e'), array(), NULL), ('n', 'r6', 'strict_before', array('a'), array('e'), array(), NULL), ('n', 'r7', 'before', array('c'), array('a'), array(), NULL),
 ('n', 'r8', 'blocking', array('b'), array('a', 'c'), array(), NULL), ('n', 'r9', 'any_of', array('a'), array(), array(), NULL), ('m', 'r10', 'any_of', array(), array(), array('a'), NULL)) AS t(node_id, relation_id, type, left, right, options, own)"""


@query(f"""WITH l(node_id, relation_id, type, a, b, opts, own) AS (VALUES ('n', 'r1', 'any', [], [], ['c'], NULL), ('n', 'r2', 'all', [], [], ['a', 'c', 'zz'], NULL), ('n', 'r3', 'cond', ['a'], ['c'], [], 9), ('n', 'r4', 'before', ['a'], ['b'], [], NULL),
 ('n', 'r5', 'same', ['a'], ['e'], [], NULL), ('n', 'r6', 'before', ['a'], ['e'], [], NULL), ('n', 'r7', 'before', ['c'], ['a'], [], NULL), ('n', 'r8', 'block', ['b'], ['a', 'c'], [], NULL), ('n', 'r9', 'any', ['a'], [], [], NULL), ('m', 'r10', 'any', [], [], ['a'], NULL)),
f AS (SELECT * FROM {FOUND}),
s AS (SELECT f.dialogue_id, node_id, list(requirement_id) AS known, list(requirement_id) FILTER (matched) AS ok, max(turn_index) FILTER (requirement_id = 'a') AS ta, max(turn_index) FILTER (requirement_id = 'b') AS tb,
  max(turn_index) FILTER (requirement_id = 'c') AS tc, max(turn_index) FILTER (requirement_id = 'e') AS te FROM f JOIN (SELECT * FROM {ACTIVE_NODES}) x USING (dialogue_id, node_id) WHERE x.active GROUP BY ALL),
t AS (SELECT *, CASE a[1] WHEN 'a' THEN ta WHEN 'b' THEN tb WHEN 'c' THEN tc WHEN 'e' THEN te END AS t1, CASE b[1] WHEN 'a' THEN ta WHEN 'b' THEN tb WHEN 'c' THEN tc WHEN 'e' THEN te END AS t2, coalesce(ok, []) AS m FROM s JOIN l USING (node_id)),
p AS (SELECT dialogue_id, node_id, relation_id, CASE type
 WHEN 'any' THEN CASE WHEN len(list_intersect(CASE WHEN len(opts) > 0 THEN opts ELSE a END, m)) = 0 THEN coalesce(own, 6) END
 WHEN 'all' THEN coalesce(own, 4) * len(list_filter(opts, lambda x: list_contains(known, x) AND NOT list_contains(m, x)))
 WHEN 'cond' THEN CASE WHEN len(list_intersect(a, m)) > 0 AND len(list_filter(b, lambda x: list_contains(known, x) AND NOT list_contains(m, x))) > 0 THEN coalesce(own, 6) END
 WHEN 'block' THEN CASE WHEN coalesce(ta > t1, false) OR coalesce(tc > t1, false) THEN coalesce(own, 8) END
 ELSE CASE WHEN list_contains(m, b[1]) AND NOT list_contains(m, a[1]) THEN coalesce(own, 5) WHEN CASE type WHEN 'same' THEN t1 > t2 ELSE t1 >= t2 END THEN coalesce(own, 7) END END::DOUBLE AS penalty FROM t)
SELECT * FROM p WHERE penalty > 0""")
def a12_requirement_relations(spark, sf_dir):
    listed = _values(spark, sf_dir, RELATIONS)
    for c in ("left", "right", "options"):
        listed = listed.withColumn(c, F.col(c).cast("array<string>"))
    return requirements.relation_penalties(_values(spark, sf_dir, FOUND), listed.withColumn("own", F.col("own").cast("double")), _values(spark, sf_dir, ACTIVE_NODES))


@query(f"WITH x AS (SELECT rule_id, span_id, bool_or(is_hit AND NOT is_role) AS said, sum(CASE WHEN is_hit THEN greatest(0.1, weight) ELSE 0 END) / sum(greatest(0.1, weight)) AS r, max(n_pool_hits) AS n FROM {FLAT} GROUP BY ALL), y AS (SELECT *, CASE WHEN said THEN least(1.0, r + least(0.25, 0.05 * n)) ELSE 0 END AS s FROM x) SELECT rule_id, span_id, round(s, 6)::DOUBLE AS score, CASE WHEN said AND s >= 0.46 THEN 'hit' WHEN said AND s >= 0.22 THEN 'review' ELSE 'miss' END AS verdict FROM y")
def a4_flat_score(spark, sf_dir):
    return requirements.flat_score(_values(spark, sf_dir, FLAT), 0.46, 0.22).withColumn("score", F.round("score", 6))



@query(f"WITH c AS (SELECT *, max(safe_turn) FILTER (status = '已处理') OVER (PARTITION BY dialogue_id) AS last FROM {CONTEXT}), x AS (SELECT *, status = '触发但未处理' AND coalesce(trigger_turn <= last, false) AS covered FROM c) SELECT dialogue_id, policy_id, CASE WHEN covered THEN '已处理' ELSE status END AS status, CASE WHEN covered THEN last ELSE safe_turn END AS safe_turn FROM x")
def w8_handled_later(spark, sf_dir):
    return requirements.handled_later(_values(spark, sf_dir, CONTEXT)).select("dialogue_id", "policy_id", "status", "safe_turn")


@query(f"SELECT dialogue_id, sum(CASE status WHEN '触发但未处理' THEN 12 WHEN '已处理但后续违背转场' THEN 18 ELSE 0 END)::DOUBLE AS penalty FROM {CONTEXT} GROUP BY 1")
def a13_context_penalties(spark, sf_dir):
    return requirements.context_penalties(_values(spark, sf_dir, CONTEXT))



def _direction_sql() -> str:
    """The first pair of directions, by a CASE over all of them."""
    cases = []
    for wanted, opposite, label in judges.DIRECTIONS:
        said = []
        for word in opposite:
            here = f"contains(s, '{word}')"
            if label == judges.HIGH_LOW:
                clause = f"list_filter(regexp_split_to_array(s, '{judges.CLAUSE}'), lambda c: contains(c, '{word}'))[1]"
                here += f" AND (length(subject) < 3 OR coalesce(contains({clause}, subject), false))"
            elif label == judges.STATUS:
                here += f" AND (NOT {q_any('expected', judges.STATES)} OR contains(s, '{word}' || right(expected, 2)) OR contains(s, '{word}' || expected))"
            said.append(f"({here})")
        cases.append(f"WHEN {q_any('expected', wanted)} AND ({' OR '.join(said)}) THEN '{label}'")
    return f"SELECT id, CASE {' '.join(cases)} END AS label FROM {TURNED}"


@query(_direction_sql())
def d9_direction_conflict(spark, sf_dir):
    subjects = F.filter(F.array("subject"), lambda x: x != "")
    return _values(spark, sf_dir, TURNED).select("id", judges.direction_conflict(F.col("s"), subjects, F.array("expected")).alias("label"))


# ------------------------------------------------------------------ ledgers and routing


@query(f"""WITH a AS (SELECT *, regexp_replace(evidence, '\\s+', '', 'g') AS k FROM {ASKED}), l AS (SELECT DISTINCT dialogue_id, family, verdict, regexp_replace(evidence, '\\s+', '', 'g') AS k FROM {LEDGER}),
r AS (SELECT a.candidate_id, CASE WHEN bool_or(verdict IN ('冲突', '违规')) THEN 'issue' WHEN bool_or(verdict IN ('支持', '安全', '已处理')) THEN 'support' WHEN bool_and(verdict IN ('证据不足', '未提及', '')) THEN 'insufficient_only' ELSE 'neutral' END AS relation FROM a JOIN l USING (dialogue_id, family, k) WHERE k <> '' GROUP BY 1)
SELECT candidate_id, coalesce(relation, 'unknown') AS relation FROM a LEFT JOIN r USING (candidate_id)""")
def j18_same_evidence(spark, sf_dir):
    asked = _values(spark, sf_dir, ASKED).withColumn("evidence", F.array("evidence"))
    return ledger.same_evidence(asked, _values(spark, sf_dir, LEDGER)).select("candidate_id", "relation")


@query(f"WITH {base.RECONCILED} SELECT family, count(*) AS n_expected, count(*) FILTER (NOT matched) AS n_missed FROM reconciled GROUP BY 1")
def a29_miss_audit(spark, sf_dir):
    return ledger.miss_audit(base.j16_reconcile(spark, sf_dir).join(base._errors(spark, sf_dir).select("error_id", "family"), "error_id"))


@query(f"WITH e AS (SELECT event_type AS family, user_id AS event_target, count(*) AS n FROM events GROUP BY ALL) SELECT * FROM e ORDER BY n DESC, family, event_target LIMIT 50")
def a29_top_unexpected(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return ledger.top_unexpected(events.select(F.col("event_type").alias("family"), F.col("user_id").alias("event_target")))


@query("SELECT event_type AS decision, count(*) AS n FROM events GROUP BY 1")
def a27_decision_counts(spark, sf_dir):
    return ledger.decision_counts(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_type").alias("decision")))


@query(f"WITH {base.RECORDS}, r AS (SELECT *, total * 0.1 AS node_completion FROM records) SELECT 'several_domains' AS warning, NULL AS domain, count(DISTINCT domain) AS n FROM r HAVING count(DISTINCT domain) > 1 UNION ALL SELECT 'all_positives_fail', domain, count(*) FROM r WHERE sample_type = 'positive' GROUP BY domain HAVING NOT bool_or(passed) AND avg(node_completion) < 10")
def a26_warnings(spark, sf_dir):
    return ledger.warnings(base._records(spark, sf_dir).withColumn("node_completion", F.col("total") * 0.1))


INSTRUCTION = "the station and the nation of the people, with a thing that was said"


@query(rf"""WITH h AS (SELECT lang AS domain, coalesce(text, '') AS text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS n FROM documents WHERE lang IS NOT NULL AND trim(lang) <> ''),
x AS (SELECT domain, text, n FROM h WHERE n <= 28 UNION ALL SELECT '?', '{INSTRUCTION}', 0), t AS (SELECT domain, regexp_replace(text, '[^\p{{L}}\p{{N}}]+', '', 'g') AS s, lower(text) AS l FROM x),
g AS (SELECT DISTINCT domain, unnest(list_concat(list_transform(generate_series(1, length(s) - 1), lambda i: substr(s, i::INT, 2)), regexp_extract_all(l, '[A-Za-z0-9$]+'))) AS g FROM t),
i AS (SELECT g FROM g WHERE domain = '?'), c AS (SELECT domain, count(*) FILTER (g IN (SELECT g FROM i)) / (sqrt(count(*)) * sqrt((SELECT count(*) FROM i))) AS s FROM g WHERE domain <> '?' GROUP BY 1),
r AS (SELECT *, max(s) OVER () AS best, coalesce((SELECT s FROM c ORDER BY s DESC LIMIT 1 OFFSET 1), 0) AS second FROM c) SELECT domain, round(s, 6) AS score, s = best AND best >= 0.06 AND second * 1.25 <= best AS selected FROM r""")
def d23_domain_routing(spark, sf_dir):
    docs = _documents(spark, sf_dir).select(F.col("lang").alias("domain"), F.col("doc_id").alias("place"), "text")
    return ledger.domain_scores(docs, INSTRUCTION).withColumn("score", F.round("score", 6))



@query(f"""WITH f AS (SELECT *, CASE WHEN error_family IN ('knowledge', 'knowledge_error') THEN 'k' WHEN error_family = 'flow' THEN 'f' ELSE 'c' END AS fam, {q_compact("coalesce(CASE WHEN coalesce(evidence_span, '') <> '' THEN evidence_span END, wrong_statement)")} AS span FROM {LABELS} WHERE sample_type = 'negative'),
i AS (SELECT dialogue_id, unnest([CASE WHEN fam = 'k' AND knowledge_id = '' THEN 'no_knowledge_id' END, CASE WHEN fam = 'c' AND constraint_id = '' THEN 'no_constraint_id' END, CASE WHEN fam = 'f' AND node_id = '' THEN 'no_node_id' END, CASE WHEN fam = 'f' AND requirement_id = '' THEN 'no_requirement_id' END,
  CASE WHEN fam <> 'f' AND span = '' THEN 'no_span' END, CASE WHEN fam <> 'f' AND span <> '' AND NOT contains({q_compact('said')}, span) THEN 'span_not_said' END]) AS issue FROM f)
SELECT dialogue_id, issue FROM i WHERE issue IS NOT NULL""")
def q1_impure_labels(spark, sf_dir):
    fields = ("error_family", "knowledge_id", "constraint_id", "node_id", "requirement_id", "evidence_span", "wrong_statement")
    turn = F.struct(F.lit("assistant").alias("speaker"), F.col("said").alias("text"))
    rows = _values(spark, sf_dir, LABELS).select("dialogue_id", "sample_type", F.array(turn).alias("turns"), F.array(F.struct(*fields)).alias("injected_errors"))
    return ledger.impure_labels(rows).select("dialogue_id", "issue")



@query(f"""SELECT dialogue_id, 'flow' AS family, node_id AS target, status AS verdict, round(100 * (1 - score), 6) AS loss FROM {STEPS} WHERE active AND status IN ('缺失', '部分完成') UNION ALL
SELECT dialogue_id, 'relation', source || '->' || target, kind, penalty FROM {PENALTIES} WHERE penalty > 0 UNION ALL
SELECT dialogue_id, 'knowledge', fact_id, verdict, round(0.8 * CASE severity WHEN 'low' THEN 5 WHEN 'medium' THEN 12 WHEN 'high' THEN 28 ELSE 45 END, 6)::DOUBLE FROM {CHECKED} WHERE verdict = '冲突' UNION ALL
SELECT dialogue_id, 'constraint', constraint_id, verdict, CASE severity WHEN 'low' THEN 5 WHEN 'medium' THEN 12 WHEN 'high' THEN 28 ELSE 45 END::DOUBLE FROM {LIMITED} WHERE verdict = '违规'""")
def d25_losses(spark, sf_dir):
    rows = ledger.losses(_values(spark, sf_dir, STEPS), _values(spark, sf_dir, PENALTIES), _values(spark, sf_dir, CHECKED), _values(spark, sf_dir, LIMITED))
    return rows.withColumn("loss", F.round("loss", 6))
