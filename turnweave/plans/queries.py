"""One query per operator, and the SQL that gives the same rows.

All run over whole tables. Where an operator needs Chinese texts, verdicts or scores that no
table has, a relation of ``plans.spoken`` makes them from the rows of a table. Small VALUES are
catalogues: rules, terms and edges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from turnweave.functions import facts as ff
from turnweave.functions import numbers as fn
from turnweave.functions import text as ft
from turnweave.operators import acceptance, context, judges, matching, nodes, patterns, relations, reports, routing, scoring
from turnweave.operators.atoms import CLAUSE_ENDS, EDGES, GUARANTEE, NO_GUARANTEE, QUESTION, SENTENCE_ENDS, TAGS, atoms, spread, tags
from turnweave.plans import catalogue as cat
from turnweave.plans import graph, sample, spoken
from turnweave.plans.local import local_table
from turnweave.plans.spoken import BAD, CALLS, CANDIDATES, ERRORS, EVENTS, FACTS, FAMILIES, GROUPS, LISTED, MEASURES, MEMBERS, NUMBERED, ORDERED, PAIRS, POSITIVE, RECORDED, REQUIREMENTS, RESULTS, SCORES, TAGGED, TEXTS
from turnweave.sources.dialogues import turns_of_table
from turnweave.sources.shared import stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns_of_table(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


_values = spoken.values


def _text(words) -> str:
    return "'" + str(words).replace("'", "''") + "'"


# ------------------------------------------------------------------ SQL text of shared parts

SPEAKER = "CASE WHEN lower(trim(role)) IN ('客服','assistant','agent','bot') THEN 'assistant' WHEN lower(trim(role)) IN ('用户','user','customer') THEN 'user' ELSE 'unknown' END"
TURNS = f"turns AS (SELECT conv_id::VARCHAR AS dialogue_id, turn::INTEGER AS turn_index, {SPEAKER} AS speaker, coalesce(text, '') AS text FROM conversations)"


def q_compact(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '\s+', '', 'g'))"


def q_fillers(x: str) -> str:
    out = q_compact(x)
    for word in ft.FILLERS:
        out = f"replace({out}, '{word}', '')"
    return out


def q_chars(x: str) -> str:
    return f"list_distinct(list_filter(string_split({x}, ''), lambda c: c <> ''))"


def q_any(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {_text(w)})" for w in words) + ")"


def q_strict(a: str, b: str) -> str:
    return f"({q_compact(a)} <> '' AND {q_compact(b)} <> '' AND (contains({q_compact(b)}, {q_compact(a)}) OR ({q_fillers(a)} <> '' AND contains({q_fillers(b)}, {q_fillers(a)}))))"


def q_text_hit(a: str, b: str) -> str:
    x, y = q_compact(a), q_compact(b)
    common = f"len(list_intersect({q_chars(x)}, {q_chars(y)}))"
    loose = rf"(NOT regexp_matches({x}, '\d') AND NOT {q_any(x, ft.EXACT_MARKS)} AND length({x}) >= 5 AND {common} >= 4 AND {common} / len({q_chars(x)}) >= 0.9)"
    return f"({x} <> '' AND {y} <> '' AND ({q_strict(a, b)} OR {loose}))"


def q_jaccard(a: str, b: str) -> str:
    x, y = q_chars(q_compact(a)), q_chars(q_compact(b))
    common = f"len(list_intersect({x}, {y}))"
    return f"CASE WHEN len({x}) = 0 OR len({y}) = 0 THEN 0.0 ELSE {common} / (len({x}) + len({y}) - {common}) END"


def _atoms_sql() -> str:
    strip = f"lambda x: trim(x, '{EDGES}')"
    subs = f"list_filter(list_transform(regexp_split_to_array(p, '{CLAUSE_ENDS}'), {strip}), lambda s: length(regexp_replace(s, '\\s+', '', 'g')) >= 2)"
    return rf"""{TURNS},
parts AS (SELECT dialogue_id, turn_index, speaker, trim(text) AS raw,
  list_filter(list_transform(regexp_split_to_array(trim(text), '{SENTENCE_ENDS}'), {strip}), lambda x: x <> '') AS parts FROM turns WHERE trim(text) <> ''),
spans AS (SELECT dialogue_id, turn_index, speaker,
  list_concat([raw], flatten(list_transform(parts, lambda p: CASE WHEN len({subs}) <= 1 THEN [p] ELSE {subs} END))) AS spans FROM parts),
each AS (SELECT dialogue_id, turn_index, speaker, unnest(spans) AS text, generate_subscripts(spans, 1) AS pos FROM spans),
firsts AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, turn_index, {q_compact("text")} ORDER BY pos) AS n FROM each WHERE {q_compact("text")} <> ''),
atoms AS (SELECT dialogue_id, turn_index, speaker, text, (row_number() OVER (PARTITION BY dialogue_id, turn_index ORDER BY pos) - 1)::INTEGER AS seq,
  count(*) OVER (PARTITION BY dialogue_id, turn_index) AS n_spans FROM firsts WHERE n = 1)"""


ATOMS = _atoms_sql()

# ------------------------------------------------------------------ sources


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, speaker, length(text) AS n_chars FROM turns")
def s3_turns_canonical(spark, sf_dir):
    return _turns(spark, sf_dir).select("dialogue_id", "turn_index", "speaker", F.length("text").cast("bigint").alias("n_chars"))


@query("SELECT d.doc_id, d.lang, l.quality, l.toxic FROM documents d JOIN labels l ON d.doc_id = l.doc_id")
def s_labels_join(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _documents(spark, sf_dir).select("doc_id", "lang").join(labels, "doc_id").select("doc_id", "lang", "quality", "toxic")


# ------------------------------------------------------------------ projections and predicates


@query(f"SELECT dialogue_id, turn_index, {q_compact('text')} AS tight FROM ({'WITH ' + TURNS + ' SELECT * FROM turns'})")
def p2_compact(spark, sf_dir):
    return _turns(spark, sf_dir).select("dialogue_id", "turn_index", ft.compact("text").alias("tight"))


@query(f"SELECT id, {q_fillers('s')} AS rest FROM {TEXTS}")
def p3_without_fillers(spark, sf_dir):
    return _values(spark, sf_dir, TEXTS).select("id", ft.without_fillers("s").alias("rest"))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, lower(trim(regexp_replace(translate(text, {_text(ft.MARKS)}, '{' ' * len(ft.MARKS)}'), '\\s+', ' ', 'g'))) AS plain FROM turns")
def p1_normalize(spark, sf_dir):
    return _turns(spark, sf_dir).select("dialogue_id", "turn_index", ft.normalize("text").alias("plain"))


@query(f"SELECT id, {q_text_hit('a', 'b')} AS hit FROM {PAIRS}")
def p4_text_hit(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", ft.text_hit("a", "b").alias("hit"))


@query(f"SELECT id, {q_strict('a', 'b')} AS hit FROM {PAIRS}")
def p6_strict_hit(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", ft.strict_hit("a", "b").alias("hit"))


@query(f"SELECT id, length({q_compact('a')}) >= 4 AND contains({q_compact('b')}, substr({q_compact('a')}, 1, 2)) AS hit FROM {PAIRS}")
def p7_object_hit(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", ft.object_hit("a", "b").alias("hit"))



@query(rf"""WITH RECURSIVE p AS (SELECT id, {q_compact('a')} AS a, {q_compact('b')} AS b FROM {ORDERED}),
w(id, a, b, k, place, ok) AS (SELECT id, a, b, 0, 0, true FROM p UNION ALL
  SELECT id, a, b, k + 1, place + f, ok AND f > 0 AND (place = 0 OR f - 1 <= {ft.MAX_GAP}) FROM (SELECT *, strpos(substr(b, place + 1), substr(a, k + 1, 1)) AS f FROM w WHERE k < length(a)))
SELECT id, ok AND a <> '' AND b <> '' AND length(a) >= 6 AND NOT regexp_matches(a, '\\d') AND NOT {q_any('a', ft.MODAL_MARKS)} AS hit FROM w WHERE k = length(a)""")
def p5_ordered_hit(spark, sf_dir):
    return _values(spark, sf_dir, ORDERED).select("id", ft.ordered_hit("a", "b").alias("hit"))


@query(rf"SELECT id, regexp_matches({q_compact('a')}, '\d') OR regexp_matches({q_compact('a')}, '{ft.COUNTED}') OR {q_any(q_compact('a'), ft.PRECISE_WORDS)} AS precise FROM {PAIRS}")
def p9_precise(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", ft.is_precise(F.array("a")).alias("precise"))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index FROM turns WHERE contains(lower(text), 'the') AND (contains(lower(text), 'ing')::INT + contains(lower(text), 'on')::INT + contains(lower(text), 'er')::INT) >= 2 AND NOT contains(lower(text), 'ß') AND regexp_matches(text, '(?:^A)|(?:ea)', 'i')")
def p18_pattern(spark, sf_dir):
    pattern = graph.pattern({"all": ["the"], "any": ["ing", "on", "er"], "none": ["ß"], "min_any_hits": 2, "regex_any": ["^A", "ea"]})
    return patterns.pattern_turns(_turns(spark, sf_dir), pattern)


# Patterns of every pair of syllables: one that has to be there, two of which one has to, one that must not.
SYLLABLES = ("the", "ing", "on", "er", "que", "eau", "ung", "lich", "ción", "re", "tion", "keit")
MANY = [(f"{a}.{b}", a, b, SYLLABLES[(i + 2 * k + 1) % 12], SYLLABLES[(3 * i + k + 5) % 12]) for i, a in enumerate(SYLLABLES) for k, b in enumerate(SYLLABLES)]


@query(f"WITH {TURNS}, p(pattern_id, w1, w2, w3, w4) AS (VALUES {', '.join(map(str, MANY))}), t AS (SELECT dialogue_id, turn_index, lower(text) AS x FROM turns WHERE speaker = 'assistant') SELECT dialogue_id, turn_index, pattern_id FROM t JOIN p ON contains(x, w1) AND (contains(x, w2) OR contains(x, w3)) AND NOT contains(x, w4)")
def p18_many_patterns(spark, sf_dir):
    listed = [(name, graph.pattern({"speaker": "assistant", "all": [a], "any": [b, c], "none": [d]})) for name, a, b, c, d in MANY]
    return patterns.indexed_turns(_turns(spark, sf_dir), listed)



def q_between(x: str) -> str:
    return f"{x} BETWEEN 5.5 AND 40.0"


#: Of a text s: its ranges, what is left without them, and the numbers of the rest, as pieces of text.
NUMBER_PARTS = f"(SELECT *, regexp_extract_all(s, '{fn._RANGE}') AS ranges, regexp_extract_all(regexp_replace(s, '{fn._RANGE}', ' ', 'g'), '{fn._SINGLE}') AS singles FROM {NUMBERED})"


def q_part(x: str, pattern: str, i: int) -> str:
    return f"regexp_extract({x}, '{pattern}', {i})"


def q_shown(x: str) -> str:
    return rf"regexp_replace(({x})::DOUBLE::VARCHAR, '\.0$', '')"


def q_days(x: str) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {q_any(x, words)} THEN '{name}' END" for name, words in fn.DAYS.items()) + "], lambda d: d IS NOT NULL)"


@query(
    f"SELECT id, len(list_filter(ranges, lambda x: {q_between(q_part('x', fn._RANGE, 1) + '::DOUBLE')} AND {q_between(q_part('x', fn._RANGE, 2) + '::DOUBLE')})) > 0"
    f" OR len(list_filter(singles, lambda x: {q_between(q_part('x', fn._SINGLE, 1) + '::DOUBLE')})) > 0 AS inside FROM {NUMBER_PARTS}"
)
def p22_number_in_range(spark, sf_dir):
    return _values(spark, sf_dir, NUMBERED).select("id", fn.number_in_range(fn.numbers("s"), 5.5, 40.0).alias("inside"))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index FROM turns WHERE speaker = 'assistant'")
def p15_speaker_scope(spark, sf_dir):
    return _turns(spark, sf_dir).where("speaker = 'assistant'").select("dialogue_id", "turn_index")


# ------------------------------------------------------------------ scalar functions


@query(f"WITH {ATOMS} SELECT dialogue_id, turn_index, seq, text, CASE WHEN seq = 0 THEN 'turn' ELSE 'atom' END AS span_type, seq > 0 OR n_spans = 1 AS is_evidence FROM atoms")
def f1_spans(spark, sf_dir):
    return atoms(_turns(spark, sf_dir)).select("dialogue_id", "turn_index", "seq", "text", "span_type", "is_evidence")



def _tag_rules() -> list[tuple[str, str]]:
    """(test, tag) of all general tags of a span s with the compact form c."""
    asked = q_any("s", QUESTION)
    rules = [(asked, "form:question"), (asked, "intent:ask"), (q_any("s", ("您好", "你好", "早上好", "下午好")), "intent:greet")]
    rules += [(q_any("c", words), name) for words, named in TAGS for name in named]
    promised = f"({q_any('c', GUARANTEE)} AND NOT {q_any('c', NO_GUARANTEE)})"
    return [*rules, (promised, "intent:promise"), (promised, "modality:certain")]


@query(
    "SELECT id, array_to_string(list_sort(list_distinct(list_filter(['speaker_role:' || who, " + ", ".join(f"CASE WHEN {test} THEN '{tag}' END" for test, tag in _tag_rules())
    + f"], lambda x: x IS NOT NULL))), ',') AS tags FROM (SELECT *, {q_compact('s')} AS c FROM {TAGGED})"
)
def f2_tags(spark, sf_dir):
    return _values(spark, sf_dir, TAGGED).select("id", F.array_join(F.array_sort(tags(F.col("s"), ft.compact("s"), F.col("who"))), ",").alias("tags"))


@query(
    f"SELECT id, array_to_string(list_concat(list_transform(ranges, lambda x: 'range:' || {q_shown(q_part('x', fn._RANGE, 1))} || '~' || {q_shown(q_part('x', fn._RANGE, 2))} || ':' || {q_part('x', fn._RANGE, 3)}),"
    f" list_transform(singles, lambda x: 'number:' || {q_shown(q_part('x', fn._SINGLE, 1))} || ':' || {q_part('x', fn._SINGLE, 2)})), ',') AS found FROM {NUMBER_PARTS}"
)
def f3_numbers(spark, sf_dir):
    show = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    one = lambda n: F.concat(n["type"], F.lit(":"), F.when(n["type"] == "range", F.concat(show(n["start"]), F.lit("~"), show(n["end"]))).otherwise(show(n["value"])), F.lit(":"), n["unit"])
    return _values(spark, sf_dir, NUMBERED).select("id", F.array_join(F.transform(fn.numbers("s"), one), ",").alias("found"))


@query(f"SELECT id, array_to_string({q_days('s')}, ',') AS days FROM {NUMBERED}")
def f6_day_words(spark, sf_dir):
    return _values(spark, sf_dir, NUMBERED).select("id", F.array_join(fn.day_words("s"), ",").alias("days"))



def q_held_unit(x: str) -> str:
    return "CASE " + " ".join(f"WHEN contains({x}, '{u}') THEN '{u}'" for u in ff.UNITS) + " END"


def q_unit(x: str) -> str:
    near, word = f"regexp_extract({x}, '{ff._NEAR}', 1)", f"regexp_extract({x}, '{ff._WORD_NEAR}', 2)"
    return f"CASE WHEN contains({x}, '点') OR contains({x}, ':') THEN '点' ELSE coalesce({q_held_unit(near)}, {q_held_unit(word)}, {q_held_unit(x)}, '') END"


def q_plain(x: str) -> str:
    return rf"(CASE WHEN {x} = floor({x}) THEN {x}::BIGINT::VARCHAR ELSE regexp_replace(regexp_replace(printf('%.6f', {x}), '0+$', ''), '\.$', '') END)"


def q_numbers(t: str, u: str) -> str:
    """The values of a text with a unit, as a list of 'number unit'."""
    numeral = lambda x: f"(CASE {x} " + " ".join(f"WHEN '{k}' THEN {v}e0" for k, v in ff.NUMERALS.items()) + " END)"
    fits, short = lambda x: f"({u} = '' OR contains({x}, {u}))", lambda x: f"(CASE WHEN {u} <> '' THEN {u} ELSE substr({x}, 1, 1) END)"
    late = lambda n: f"(CASE WHEN {u} = '点' AND {n} = 6 AND (contains({t}, '下午') OR contains({t}, '晚上')) THEN 18e0 ELSE {n} END)"

    def ranges(pattern: str, value) -> str:
        part = lambda i: q_part("x", pattern, i)
        both = ", ".join(f"{q_plain(value(part(i)))} || ' ' || {short(part(3))}" for i in (1, 2))
        return f"flatten(list_transform(list_filter(regexp_extract_all({t}, '{pattern}'), lambda x: {fits(part(3))}), lambda x: [{both}]))"

    number, raw = q_part("x", ff._SINGLE, 1), q_part("x", ff._SINGLE, 2)
    own = f"(CASE WHEN contains({raw}, ':') THEN '点' ELSE {raw} END)"
    known = f"(CASE WHEN {u} = '' OR {own} = {u} THEN {own} WHEN {own} = '' AND {q_compact(t)} = {number} THEN {u} WHEN {u} = '点' AND ({number} IN ('18', '6') OR contains({t}, ':')) THEN {own} END)"
    single = f"{q_plain(late(number + '::DOUBLE'))} || ' ' || (CASE WHEN {known} = '' THEN {u} ELSE {known} END)"
    singles = f"list_filter(list_transform(regexp_extract_all({t}, '{ff._SINGLE}'), lambda x: CASE WHEN {known} IS NOT NULL THEN {single} END), lambda x: x IS NOT NULL)"
    word, unit = q_part("x", ff._WORD_SINGLE, 1), q_part("x", ff._WORD_SINGLE, 2)
    words = f"list_transform(list_filter(regexp_extract_all({t}, '{ff._WORD_SINGLE}'), lambda x: {fits(unit)}), lambda x: {q_plain(late(numeral(word)))} || ' ' || {short(unit)})"
    six = f"(CASE WHEN {u} = '点' AND {q_any(t, ff.SIX)} THEN ['18 点'] ELSE [] END)"
    parts = [ranges(ff._RANGE, lambda x: f"{x}::DOUBLE"), singles, ranges(ff._WORD_RANGE, numeral), words, six]
    return f"list_concat({', '.join(parts)})"


def q_once(x: str) -> str:
    """A list without repeats, in order."""
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


@query(f"SELECT id, {q_unit('actual')} AS unit, {q_unit('expected')} AS asked FROM {FACTS}")
def f5_units(spark, sf_dir):
    return _values(spark, sf_dir, FACTS).select("id", ff.unit_of("actual").alias("unit"), ff.unit_of("expected").alias("asked"))


@query(f"WITH u AS (SELECT id, actual, {q_unit('expected')} AS u FROM {FACTS}), p AS (SELECT id, {q_numbers('actual', 'u')} AS p FROM u) SELECT id, array_to_string({q_once('p')}, ',') AS pairs FROM p")
def f4_number_units(spark, sf_dir):
    pairs = ff.number_units("actual", ff.unit_of("expected"))
    return _values(spark, sf_dir, FACTS).select("id", F.array_join(F.transform(pairs, lambda x: F.concat(x["number"], F.lit(" "), x["unit"])), ",").alias("pairs"))


def q_compare(exp: str, exp_days: str, act: str, act_days: str) -> str:
    common = lambda a, b: f"len(list_intersect({a}, {b}))"
    some = f"len({exp_days}) > 0 AND len({act_days}) > 0"
    within = f"({common(exp, act)} = len(list_distinct({act})) OR {common(exp, act)} = len(list_distinct({exp})))"
    return f"CASE WHEN {some} AND {common(exp_days, act_days)} = 0 THEN 'conflict' WHEN len({exp}) > 0 AND len({act}) > 0 THEN CASE WHEN {within} THEN 'support' ELSE 'conflict' END WHEN {some} THEN 'support' ELSE 'unknown' END"


PROFILES = f"""u AS (SELECT id, expected, actual, {q_unit('expected')} AS u FROM {FACTS}),
p AS (SELECT id, expected, actual, u, list_transform({q_numbers('expected', 'u')}, lambda v: split_part(v, ' ', 1)) AS e, {q_days('expected')} AS ed,
  list_transform({q_numbers('actual', "CASE WHEN u <> '' THEN u ELSE " + q_unit('actual') + " END")}, lambda v: split_part(v, ' ', 1)) AS a, {q_days('actual')} AS ad FROM u)"""


@query(f"WITH {PROFILES} SELECT id, {q_compare('e', 'ed', 'a', 'ad')} AS verdict FROM p")
def f7_compare_facts(spark, sf_dir):
    expected = ff.fact_profile("expected")
    rows = _values(spark, sf_dir, FACTS).withColumn("e", expected)
    return rows.select("id", ff.compare_profiles(F.col("e"), ff.fact_profile("actual", F.col("e.unit"))).alias("verdict"))


def q_anchors(x: str) -> str:
    out = rf"regexp_replace(regexp_replace({q_compact(x)}, '\d+(?:\.\d+)?', ' ', 'g'), '[一二三四五六七八九十百千万两]+', ' ', 'g')"
    for words in (ff.DAY_PARTS, ff.PARTICLES):
        for word in sorted(words, key=lambda w: -len(w)):
            out = f"replace({out}, '{word}', ' ')"
    return out


@query(rf"WITH c AS (SELECT id, list_filter(regexp_split_to_array({q_anchors('b')}, '[\s，,。；;：:/、()（）\[\]{{}}]+'), lambda x: length(x) BETWEEN 2 AND 8) AS p FROM {PAIRS}) SELECT id, array_to_string(list_slice({q_once('p')}, 1, 4), ',') AS anchors FROM c")
def f8_slot_anchors(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", F.array_join(ff.slot_anchors("b"), ",").alias("anchors"))


@query(f"""WITH {PROFILES}, c AS (SELECT *, list_filter(regexp_split_to_array({q_anchors('expected')}, '\\s+'), lambda x: length(x) BETWEEN 2 AND 8) AS anchors FROM p)
SELECT id, (len(a) > 0 OR len(ad) > 0) AND (len(e) = 0 OR len(a) > 0) AND NOT {q_any('actual', ff.DENIED)}
  AND NOT (len(e) = 0 AND len(ed) > 0 AND len(ad) > 0 AND len(anchors) > 0 AND len(list_filter(anchors, lambda x: contains(actual, x))) = 0) AS asserted FROM c""")
def f9_asserted_facts(spark, sf_dir):
    rows = _values(spark, sf_dir, FACTS).withColumn("e", ff.fact_profile("expected"))
    rows = rows.withColumn("a", ff.fact_profile("actual", F.col("e.unit")))
    return rows.select("id", ff.asserts_fact(ff.slot_anchors("expected"), F.col("e"), F.col("actual"), F.col("a")).alias("asserted"))


@query(rf"SELECT id, length({q_compact('a')}) <= 2 OR {q_compact('a')} IN ({', '.join(_text(x) for x in ff.GENERAL_SLOTS)}) OR regexp_matches({q_compact('a')}, '(?:{'|'.join(ff.GENERAL_ENDS)})$') AS general, {q_any('b', ff.REWARDS)} AND NOT {q_any('a', ff.REWARDS)} AS other FROM {PAIRS}")
def f10_slots(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", ff.general_slot(F.col("a")).alias("general"), ff.other_slot(F.col("a"), F.col("b")).alias("other"))


def q_bigrams(x: str) -> str:
    return f"list_distinct(list_transform(generate_series(1, length({x}) - 1), lambda i: substr({x}, i::INT, 2)))"


@query(f"SELECT id, round(CASE WHEN least(len(x), len(y)) > 0 THEN len(list_intersect(x, y)) / least(len(x), len(y)) ELSE 0.0 END, 6) AS overlap FROM (SELECT id, {q_bigrams(q_compact('a'))} AS x, {q_bigrams(q_compact('b'))} AS y FROM {PAIRS})")
def f16_overlap(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", F.round(ft.overlap_coefficient(ft.bigrams("a"), ft.bigrams("b")), 6).alias("overlap"))


@query(f"WITH {TURNS}, p AS (SELECT *, lead(text) OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS after FROM turns) SELECT dialogue_id, turn_index, round({q_jaccard('text', 'after')}, 6) AS similarity FROM p WHERE after IS NOT NULL")
def f17_jaccard_adjacent(spark, sf_dir):
    by = Window.partitionBy("dialogue_id").orderBy("turn_index")
    rows = _turns(spark, sf_dir).withColumn("after", F.lead("text").over(by)).where("after IS NOT NULL")
    return rows.select("dialogue_id", "turn_index", F.round(ft.char_jaccard("text", "after"), 6).alias("similarity"))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, (floor(length(text) / 1.6) + 1)::BIGINT AS tokens FROM turns")
def f22_rough_tokens(spark, sf_dir):
    return _turns(spark, sf_dir).select("dialogue_id", "turn_index", ft.rough_tokens("text").alias("tokens"))


@query(f"SELECT id, 'k_' || substr(sha1(a || '|' || b), 1, 10) AS stable FROM {PAIRS}")
def f23_stable_ids(spark, sf_dir):
    return _values(spark, sf_dir, PAIRS).select("id", ft.stable_id("k", "a", "b").alias("stable"))


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, CASE WHEN length(text) > 20 THEN substr(text, 1, 20) || '…' ELSE text END AS clipped FROM turns")
def t6_clip(spark, sf_dir):
    return _turns(spark, sf_dir).select("dialogue_id", "turn_index", ft.clip("text", 20).alias("clipped"))


@query(f"WITH x AS (SELECT id, unnest(items) AS v, generate_subscripts(items, 1) AS n FROM {LISTED.replace('array(', 'list_value(')}), k AS (SELECT id, trim(v) AS v, n, min(n) OVER (PARTITION BY id, {q_compact('v')}) AS first FROM x WHERE {q_compact('v')} <> '') SELECT id, string_agg(v, '|' ORDER BY n) AS kept FROM k WHERE n = first GROUP BY 1")
def t1_dedupe_ordered(spark, sf_dir):
    return _values(spark, sf_dir, LISTED).select("id", F.array_join(ft.dedupe_ordered("items"), "|").alias("kept"))


# ------------------------------------------------------------------ joins

TERMS = "(VALUES ('r1', 'the'), ('r1', 'thing'), ('r2', 'ungen'), ('r2', 'schlich'), ('r3', 'eaux'), ('r3', 'leau'), ('r4', 'ción')) AS r(rule_id, term)"


@query(f"WITH {ATOMS} SELECT DISTINCT rule_id, dialogue_id, turn_index, seq FROM atoms, {TERMS} WHERE (seq > 0 OR n_spans = 1) AND {q_text_hit('term', 'text')}")
def j1_theta_recall(spark, sf_dir):
    return matching.recall(stored(atoms(spread(_turns(spark, sf_dir)))), sample.latin_rules(spark, TERMS).elements).select("rule_id", "dialogue_id", "turn_index", "seq")


@query(f"WITH {ATOMS}, h AS (SELECT DISTINCT rule_id, dialogue_id FROM atoms, {TERMS} WHERE (seq > 0 OR n_spans = 1) AND {q_text_hit('term', 'text')}) SELECT dialogue_id, count(*) AS n_rules FROM h GROUP BY 1")
def j1_rules_per_dialogue(spark, sf_dir):
    return j1_theta_recall(spark, sf_dir).groupBy("dialogue_id").agg(F.count_distinct("rule_id").alias("n_rules"))


@query(f"WITH {ATOMS}, h AS (SELECT DISTINCT dialogue_id FROM atoms, {TERMS} WHERE rule_id = 'r1' AND (seq > 0 OR n_spans = 1) AND {q_text_hit('term', 'text')}) SELECT DISTINCT dialogue_id FROM turns WHERE dialogue_id NOT IN (SELECT dialogue_id FROM h)")
def j13_rule_miss_anti(spark, sf_dir):
    hit = j1_theta_recall(spark, sf_dir).where("rule_id = 'r1'").select("dialogue_id").distinct()
    return _turns(spark, sf_dir).select("dialogue_id").distinct().join(hit, "dialogue_id", "left_anti")


@query(f"WITH {TURNS} SELECT a.dialogue_id, a.turn_index, count(*) AS band FROM turns a JOIN turns b ON a.dialogue_id = b.dialogue_id AND a.speaker = b.speaker AND abs(a.turn_index - b.turn_index) <= 2 GROUP BY ALL")
def j4_band_same_speaker(spark, sf_dir):
    return context.band_members(_turns(spark, sf_dir), 2).select("dialogue_id", "turn_index", "band")


@query(f"WITH {TURNS} SELECT a.dialogue_id, a.turn_index AS ask_turn, min(u.turn_index)::INTEGER AS reply_turn FROM turns a JOIN turns u ON a.dialogue_id = u.dialogue_id AND u.turn_index > a.turn_index AND u.turn_index <= a.turn_index + 3 WHERE a.speaker = 'assistant' AND contains(a.text, 'e') AND u.speaker = 'user' AND contains(u.text, 'a') GROUP BY ALL")
def j5_ask_reply(spark, sf_dir):
    return context.replies_within(_turns(spark, sf_dir), F.contains("text", F.lit("e")), F.contains("text", F.lit("a")), 3)


@query(f"WITH {TURNS} SELECT dialogue_id, turn_index, last_value(CASE WHEN speaker = 'user' THEN turn_index END IGNORE NULLS) OVER (PARTITION BY dialogue_id ORDER BY turn_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_user_turn FROM turns")
def j6_asof_previous_user(spark, sf_dir):
    return context.previous_user_turn(_turns(spark, sf_dir)).select("dialogue_id", "turn_index", "prev_user_turn")


@query(f"WITH {TURNS}, u AS (SELECT dialogue_id, speaker, w, min(turn_index) AS t FROM turns, (VALUES ('the'), ('on'), ('er')) AS x(w) WHERE contains(text, w) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, speaker ORDER BY t) AS n, count(*) OVER (PARTITION BY dialogue_id, speaker) AS n_words FROM u) SELECT dialogue_id, speaker, n_words, t AS reached_turn FROM r WHERE n = 2")
def j7_across_turns(spark, sf_dir):
    return context.across_turns(_turns(spark, sf_dir), ("the", "on", "er"), 2)


@query(f"WITH {TURNS}, f AS (SELECT dialogue_id, min(turn_index) AS trigger_turn FROM turns WHERE speaker = 'user' AND contains(text, 'er') GROUP BY 1) SELECT t.dialogue_id, t.turn_index, f.trigger_turn FROM turns t JOIN f ON t.dialogue_id = f.dialogue_id AND t.turn_index > f.trigger_turn")
def j10_after_trigger(spark, sf_dir):
    return context.after_trigger(_turns(spark, sf_dir), F.contains("text", F.lit("er"))).select("dialogue_id", "turn_index", "trigger_turn")


EDGES_V = "(VALUES ('a', 'b'), ('b', 'c'), ('c', 'd'), ('d', 'b'), ('x', 'y')) AS e(source, target)"


@query(f"WITH RECURSIVE r AS (SELECT source, target FROM {EDGES_V} UNION SELECT r.source, e.target FROM r JOIN {EDGES_V} ON r.target = e.source) SELECT source, target FROM r WHERE source <> target")
def j14_closure(spark, sf_dir):
    return nodes.closure(spark, _values(spark, sf_dir, EDGES_V))


@query(f"WITH {TURNS}, a AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY turn_index) AS n FROM turns WHERE speaker = 'assistant') SELECT a.dialogue_id, a.turn_index AS first, b.turn_index AS second, round({q_jaccard('a.text', 'b.text')}, 6) AS similarity FROM a JOIN a b ON a.dialogue_id = b.dialogue_id AND b.n BETWEEN a.n + 1 AND a.n + 3 WHERE {q_jaccard('a.text', 'b.text')} >= 0.8")
def j15_repeated_replies(spark, sf_dir):
    return judges.repeated_replies(_turns(spark, sf_dir), 0.8, 3).withColumn("similarity", F.round("similarity", 6))


def q_aligned(span: str, text: str, least: float) -> str:
    x, y = q_bigrams(q_compact(span)), q_bigrams(q_compact(text))
    return f"(({span} <> '' AND {text} <> '' AND (contains({text}, {span}) OR contains({span}, {text}))) OR (least(len({x}), len({y})) > 0 AND len(list_intersect({x}, {y})) / least(len({x}), len({y})) >= {least}))"


NAMED = "x.target_id <> '' AND (x.target_id = e.event_target OR (e.alias <> '' AND x.target_id = e.alias))"
RECONCILED = f"""ev AS (SELECT * FROM {EVENTS}), er AS (SELECT * FROM {ERRORS}),
reconciled AS (SELECT x.dialogue_id, x.error_id, x.family, x.eligible, coalesce(bool_or(x.family = e.family AND (({NAMED}) OR {q_aligned('x.span', 'e.evidence', 0.4)})), false) AS matched
  FROM er x LEFT JOIN ev e ON x.dialogue_id = e.dialogue_id GROUP BY ALL),
surplus AS (SELECT e.* FROM ev e WHERE NOT EXISTS (SELECT 1 FROM er x WHERE x.dialogue_id = e.dialogue_id AND (({NAMED}) OR (x.family = e.family AND {q_aligned('x.span', 'e.evidence', 0.12)}))))"""


def _events(spark, sf_dir):
    return _values(spark, sf_dir, EVENTS).withColumn("aliases", F.filter(F.array("alias"), lambda x: x != "")).drop("alias")


def _errors(spark, sf_dir):
    return _values(spark, sf_dir, ERRORS)


@query(f"WITH {RECONCILED} SELECT dialogue_id, error_id, matched FROM reconciled")
def j16_reconcile(spark, sf_dir):
    return acceptance.reconcile(_errors(spark, sf_dir), _events(spark, sf_dir)).select("dialogue_id", "error_id", "matched")


@query(f"WITH {RECONCILED} SELECT dialogue_id, event_id, event_target FROM surplus")
def j17_unexpected(spark, sf_dir):
    return acceptance.unexpected(_errors(spark, sf_dir), _events(spark, sf_dir)).select("dialogue_id", "event_id", "event_target")


# ------------------------------------------------------------------ catalogue statistics

CATALOGUE_TERMS = "(VALUES ('c1', '生效'), ('c1', '次日'), ('c2', '次日'), ('c2', '10单'), ('c3', '取消'), ('c3', '次日')) AS r(rule_id, term)"


@query(f"WITH d AS (SELECT {q_compact('term')} AS term, count(DISTINCT rule_id) AS df FROM {CATALOGUE_TERMS} GROUP BY 1) SELECT term, df, round(ln((3 + 1) / (df + 1)) + 1, 6) AS idf FROM d")
def a6_idf(spark, sf_dir):
    return cat.idf(sample.latin_rules(spark, CATALOGUE_TERMS).elements).withColumn("idf", F.round("idf", 6))


@query(f"WITH d AS (SELECT {q_compact('term')} AS term, count(DISTINCT rule_id) AS df FROM {CATALOGUE_TERMS} GROUP BY 1) SELECT rule_id, r.term, round(greatest(0.2, least(4.0, 1.5 * (ln(4 / (df + 1)) + 1) * CASE WHEN r.term = '10单' THEN 1.2 ELSE 1.0 END)), 6) AS weight FROM {CATALOGUE_TERMS} JOIN d ON d.term = r.term")
def a7_weights(spark, sf_dir):
    return sample.latin_rules(spark, CATALOGUE_TERMS).elements.select("rule_id", F.col("value").alias("term"), F.round("weight", 6).alias("weight"))


# ------------------------------------------------------------------ windows, groups, matches


@query(f"""WITH {ATOMS}, e AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, turn_index ORDER BY seq) AS place FROM atoms WHERE seq > 0 OR n_spans = 1),
c AS (SELECT DISTINCT rule_id, dialogue_id, turn_index, seq, place, speaker FROM e, {TERMS} WHERE {q_text_hit('term', 'text')}),
m AS (SELECT c.rule_id, c.dialogue_id, c.turn_index AS a_turn, c.seq AS a_seq, x.w AS window_ord FROM c JOIN e ON c.dialogue_id = e.dialogue_id,
  (VALUES (0), (1), (2), (3), (4)) AS x(w)
  WHERE CASE WHEN x.w <= 2 THEN e.turn_index = c.turn_index AND abs(e.place - c.place) <= x.w ELSE e.speaker = c.speaker AND e.seq > 0 AND abs(e.turn_index - c.turn_index) <= x.w - 2 END)
SELECT rule_id, dialogue_id, a_turn, a_seq, window_ord::INTEGER AS window_ord, count(*) AS size FROM m GROUP BY ALL HAVING count(*) > 1 OR window_ord = 0""")
def w2_windows(spark, sf_dir):
    spans = stored(atoms(spread(_turns(spark, sf_dir))))
    elements = sample.latin_rules(spark, TERMS).elements
    return matching.windows(matching.recall(spans, elements), spans, elements.select("rule_id", "rule_type").distinct()).select(*matching.KEY, "size")



@query(f"""WITH p(rule_type, hm, hg, rm, rg) AS (VALUES {', '.join(str((k, *v)) for k, v in cat.PROFILES.items())}),
m AS (SELECT *, CASE WHEN n_core_hit > 0 THEN greatest(raw_core, 0.5 + 0.5 * n_core_hit / n_core) ELSE raw_core END AS raw_main, (starts_with(rule_type, 'knowledge_') OR starts_with(rule_type, 'constraint_')) AND n_fact > 0 AS facts FROM {MEASURES} JOIN p USING (rule_type)),
c AS (SELECT *, starts_with(window_name, 'same_turn_adjacent') AND raw_group >= 0.999 AND raw_main >= 0.999 AS whole FROM m),
v AS (SELECT *, CASE WHEN whole THEN 1 ELSE least(1, raw_main * factor) END AS mc, CASE WHEN whole THEN 1 ELSE least(1, raw_group * factor) END AS gc FROM c),
z AS (SELECT *, CASE WHEN rule_type = 'node_positive' AND n_precise_missing > 0 THEN 0.65 WHEN facts AND n_trunk_missing > 0 THEN 0.7 WHEN facts AND n_fact_missing > 0 THEN 0.8 WHEN rule_type = 'node_trigger' AND n_cluster_missing > 0 THEN 0.65 WHEN require_all AND n_core_hit < n_core THEN 0.75 END AS veto FROM v)
SELECT group_id, CASE WHEN veto IS NOT NULL THEN 'miss' WHEN mc >= hm AND n_plain_hit > 0 AND (facts OR gc >= hg) THEN 'hit' WHEN mc >= rm AND gc >= rg AND n_plain_hit > 0 THEN 'review' ELSE 'miss' END AS verdict,
 round((CASE WHEN veto IS NULL THEN 0.7 * mc + 0.3 * gc ELSE least(0.7 * mc + 0.3 * gc, rg * veto) END)::DOUBLE, 6) AS score FROM z""")
def a1_group_verdicts(spark, sf_dir):
    rows = _values(spark, sf_dir, MEASURES).withColumnRenamed("window_name", "window").drop("verdict", "score")
    for i, name in enumerate(("hit_main", "hit_group", "review_main", "review_group")):
        value = F.lit(None).cast("double")
        for kind, profile in cat.PROFILES.items():
            value = F.when(F.col("rule_type") == kind, profile[i]).otherwise(value)
        rows = rows.withColumn(name, value)
    return matching.group_verdicts(rows).select("group_id", "verdict", F.round("score", 6).alias("score"))



def _settled(spark, sf_dir):
    rows = _values(spark, sf_dir, GROUPS).withColumn("rule_type", F.lit("default")).withColumn("window", F.lit("w"))
    return matching.settle(rows.withColumn("hit_group", F.lit(0.46)).withColumn("review_group", F.lit(0.22)), places=12)


SETTLED = f"""g AS (SELECT rule_id, dialogue_id, a_turn, a_seq, window_ord, max(score) FILTER (decisive AND verdict = 'hit') AS h, max(score) FILTER (decisive AND verdict = 'review') AS v,
 max(score) FILTER (decisive) AS a, avg(score) FILTER (NOT decisive) AS s FROM {GROUPS} GROUP BY ALL),
x AS (SELECT *, CASE WHEN s IS NULL THEN coalesce(h, v, a, 0) ELSE 0.8 * coalesce(h, v, a, 0) + 0.2 * s END AS score FROM g),
settled AS (SELECT rule_id, dialogue_id, a_turn, a_seq, window_ord, round(score, 12) AS score, CASE WHEN h IS NOT NULL AND score >= 0.46 THEN 'hit' WHEN h IS NOT NULL OR v IS NOT NULL OR score >= 0.22 THEN 'review' ELSE 'miss' END AS verdict FROM x)"""


@query(f"WITH {SETTLED} SELECT * FROM settled")
def a2_settle(spark, sf_dir):
    # Scores are multiples of a part of 1/128: rounded to fewer places, some are ties that the noise of floats decides.
    return _settled(spark, sf_dir).select(*matching.KEY, F.round("score", 12).alias("score"), "verdict")


@query(f"WITH {SETTLED}, r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id, rule_id ORDER BY CASE verdict WHEN 'hit' THEN 3 WHEN 'review' THEN 2 ELSE 1 END DESC, score DESC, a_turn, a_seq, window_ord) AS n FROM settled) SELECT dialogue_id, rule_id, verdict, score, a_turn AS turn_index, a_seq AS seq FROM r WHERE n = 1")
def a3_best_match(spark, sf_dir):
    return matching.best_matches(_settled(spark, sf_dir)).select("dialogue_id", "rule_id", "verdict", F.round("score", 12).alias("score"), "turn_index", "seq")


# ------------------------------------------------------------------ steps, relations, scores


@query(f"WITH m AS (SELECT dialogue_id, node_id, CASE WHEN count(*) FILTER (required) = 0 THEN 1 ELSE sum(score * weight) FILTER (required) / sum(weight) FILTER (required) END AS mean, count(*) FILTER (required AND score <= 0.0001) AS z, count(*) FILTER (required) AS k, min(turn_index) AS first_hit_turn FROM {REQUIREMENTS} GROUP BY ALL), s AS (SELECT *, CASE WHEN z > 0 AND k > 1 THEN least(mean, 0.58) ELSE mean END AS score FROM m) SELECT dialogue_id, node_id, round(score, 6) AS score, first_hit_turn, CASE WHEN score >= 0.75 THEN '已完成' WHEN score >= 0.35 THEN '部分完成' ELSE '缺失' END AS status FROM s")
def a8_node_scores(spark, sf_dir):
    return nodes.node_scores(_values(spark, sf_dir, REQUIREMENTS)).select("dialogue_id", "node_id", F.round("score", 6).alias("score"), "first_hit_turn", "status")


EDGE_ROWS = "(VALUES ('a', 'b', 'before', 1e0), ('a', 'b', 'strict_before', 2e0), ('c', 'b', 'condition_on', 1e0), ('b', 'c', 'before', 1e0), ('e', 'a', 'branch_choice', 1e0), ('a', 'e', 'condition_on', 1e0), ('a', 'f', 'optional_after', 1e0)) AS e(source, target, kind, weight)"


@query(f"""WITH r AS (SELECT * FROM {RESULTS}), x AS (SELECT a.dialogue_id, source, target, kind, weight, a.active AS aa, b.active AS ba, a.status = '缺失' AS am, b.status = '缺失' AS bm, a.score AS s1, b.score AS s2, coalesce(a.first_hit_turn > b.first_hit_turn, false) AS turned,
  kind IN ('strict_before', 'condition_on', 'branch_choice') AS hard, kind IN ('before', 'strict_before') AS ordered
 FROM r a JOIN {EDGE_ROWS} ON a.node_id = source JOIN r b ON b.dialogue_id = a.dialogue_id AND b.node_id = target WHERE kind <> 'optional_after' AND (b.active OR kind NOT IN ('condition_on', 'branch_choice')))
SELECT dialogue_id, source, target, kind, round(CASE WHEN aa AND ba THEN (s1 + s2) / 2 END, 6)::DOUBLE AS pair_score, round(weight * (CASE WHEN ba AND hard AND (NOT aa OR am) THEN 8 ELSE 0 END + CASE WHEN aa AND ba THEN
  CASE WHEN am AND NOT bm THEN CASE WHEN hard THEN 8 ELSE 4 END ELSE 0 END + CASE WHEN ordered AND bm AND NOT am THEN CASE WHEN hard THEN 6 ELSE 3 END ELSE 0 END + CASE WHEN turned THEN CASE WHEN hard THEN 10 ELSE 4 END ELSE 0 END ELSE 0 END), 6)::DOUBLE AS penalty FROM x""")
def a10_edge_penalties(spark, sf_dir):
    rows = relations.edge_results(_values(spark, sf_dir, RESULTS), _values(spark, sf_dir, EDGE_ROWS))
    return rows.select("dialogue_id", "source", "target", "kind", F.round("pair_score", 6).alias("pair_score"), F.round("penalty", 6).alias("penalty"))



@query(f"""WITH m AS (SELECT *, coalesce(lag(first_hit_turn) OVER (PARTITION BY dialogue_id, group_id ORDER BY position) > first_hit_turn, false) AS turned FROM {MEMBERS} WHERE active),
g AS (SELECT dialogue_id, group_id, group_type, 100 * avg(score) AS mean, 100 * max(score) AS best, count(*) FILTER (turned) AS n, count(*) FILTER (first_hit_turn IS NOT NULL OR status IN ('已完成', '部分完成')) AS c FROM m GROUP BY ALL)
SELECT dialogue_id, group_id, round(CASE group_type WHEN 'exclusive_branch' THEN greatest(0, best - 10 * greatest(0, c - 1)) WHEN 'sequential' THEN greatest(0, mean - 8 * n) ELSE mean END, 6)::DOUBLE AS score FROM g
UNION ALL SELECT dialogue_id, group_id, 100e0 FROM {MEMBERS} GROUP BY ALL HAVING NOT bool_or(active)""")
def a11_group_scores(spark, sf_dir):
    return relations.group_scores(_values(spark, sf_dir, MEMBERS)).select("dialogue_id", "group_id", F.round("score", 6).alias("score"))


@query(f"""WITH g AS (SELECT dialogue_id, group_id, group_type, count(*) AS n, count(*) FILTER (status = '已完成') AS done, count(*) FILTER (turned) AS t, count(*) FILTER (first_hit_turn IS NOT NULL OR status IN ('已完成', '部分完成')) AS c
 FROM (SELECT *, coalesce(lag(first_hit_turn) OVER (PARTITION BY dialogue_id, group_id ORDER BY position) > first_hit_turn, false) AS turned FROM {MEMBERS} WHERE active) AS m GROUP BY ALL)
SELECT dialogue_id, group_id, CASE group_type WHEN 'sequential' THEN 'group:ordered' WHEN 'all_of' THEN 'group:all_of' ELSE CASE WHEN c > 1 THEN 'group:exclusive_branch' ELSE 'group:any_of' END END AS relation,
 (CASE group_type WHEN 'sequential' THEN 8 * t WHEN 'all_of' THEN 6 ELSE CASE WHEN c > 1 THEN 10 * (c - 1) ELSE 8 END END)::DOUBLE AS penalty
FROM g WHERE CASE group_type WHEN 'sequential' THEN t > 0 WHEN 'all_of' THEN done < n ELSE c > 1 OR done = 0 END""")
def a11_group_events(spark, sf_dir):
    groups = local_table(spark, [("g1", True, None), ("g2", True, 3), ("g3", True, None)], "group_id string, required boolean, least int")
    return relations.group_events(relations.group_scores(_values(spark, sf_dir, MEMBERS)), groups)



@query(f"""WITH f AS (SELECT *, (missing_nodes > 0 OR missing_required > 0) AS flow, (missing_nodes >= 2 OR missing_required >= 2 OR missing_required / n_required >= 0.25) AS many,
 CASE knowledge_worst WHEN 1 THEN 68 WHEN 2 THEN 60 WHEN 3 THEN 52 WHEN 4 THEN 48 END AS k, CASE constraint_worst WHEN 1 THEN 62 WHEN 2 THEN 54 WHEN 3 THEN 46 WHEN 4 THEN 38 END AS c FROM {SCORES}),
g AS (SELECT *, CASE WHEN flow THEN CASE WHEN many THEN 58 ELSE 66 END END AS fl, flow::INT + (k IS NOT NULL)::INT + (c IS NOT NULL)::INT + context_problem::INT AS n FROM f),
h AS (SELECT *, least(fl, k, c, CASE WHEN context_problem THEN CASE WHEN n >= 2 THEN 52 ELSE 62 END END, CASE WHEN n >= 2 THEN 42 END)::DOUBLE AS cap,
 0.5 * least(node_completion, fl) + 0.1 * least(relation_score, CASE WHEN context_problem THEN 62 END) + 0.2 * least(knowledge_score, k) + 0.15 * least(constraint_score, c) + 0.05 * soft_score AS u FROM g)
SELECT dialogue_id, cap, round(u, 6) AS uncapped, round(least(u, cap), 6) AS total FROM h""")
def a17_totals(spark, sf_dir):
    out = scoring.totals(_values(spark, sf_dir, SCORES))
    return out.select("dialogue_id", "cap", F.round("uncapped", 6).alias("uncapped"), F.round("total", 6).alias("total"))



@query(f"SELECT dialogue_id, round(greatest(0, 100 - sum(0.8 * CASE severity WHEN 'low' THEN 5 WHEN 'medium' THEN 12 WHEN 'high' THEN 28 WHEN 'critical' THEN 45 ELSE 12 END)), 6)::DOUBLE AS knowledge_score, max(CASE severity WHEN 'low' THEN 1 WHEN 'high' THEN 3 WHEN 'critical' THEN 4 ELSE 2 END)::INTEGER AS knowledge_worst, count(*) AS n_knowledge FROM {BAD} GROUP BY 1")
def a14_severity(spark, sf_dir):
    return scoring.event_scores(_values(spark, sf_dir, BAD), "knowledge").withColumn("knowledge_score", F.round("knowledge_score", 6))


@query(f"WITH {TURNS} SELECT dialogue_id, round(least(1.0, avg(contains(text, 'er')::INT) / 0.6), 6) AS score FROM turns WHERE speaker = 'assistant' GROUP BY 1")
def a18_soft_ratio(spark, sf_dir):
    own = _turns(spark, sf_dir).where("speaker = 'assistant'").groupBy("dialogue_id").agg(F.sum(F.contains("text", F.lit("er")).cast("int")).alias("h"), F.count("*").alias("n"))
    return own.select("dialogue_id", F.round(scoring.soft_ratio(F.col("h"), F.col("n"), "higher", 0.0, 0.6), 6).alias("score"))


@query(f"WITH {TURNS}, s AS (SELECT dialogue_id, turn_index, length({q_compact('text')})::INTEGER AS n_chars FROM turns WHERE speaker = 'assistant'), r AS (SELECT *, row_number() OVER (PARTITION BY dialogue_id ORDER BY n_chars DESC, turn_index) AS n FROM s) SELECT dialogue_id, turn_index, n_chars FROM r WHERE n = 1 AND n_chars > 100")
def a19_longest_turns(spark, sf_dir):
    return judges.longest_turns(_turns(spark, sf_dir), 100)


# ------------------------------------------------------------------ ladders

VERDICTS = "(VALUES ('hit'), ('review'), ('miss'))"


def q_grid(names: list[str]) -> str:
    return ", ".join(f"{VERDICTS} AS v_{n}({n})" for n in names)


@query(f"""WITH g AS (SELECT * FROM (VALUES (true), (false)) AS h(has_selector), {q_grid(['selector', 'correct', 'wrong', 'wrong_all'])}, (VALUES ('conflict'), ('support'), (NULL)) AS v(value)),
x AS (SELECT *, CASE value WHEN 'conflict' THEN '冲突' WHEN 'support' THEN '支持' END AS as_value, CASE WHEN wrong = 'miss' AND wrong_all = 'hit' THEN 'hit' ELSE wrong END AS w FROM g)
SELECT has_selector, selector, correct, wrong, wrong_all, value, CASE
 WHEN has_selector AND selector = 'miss' THEN coalesce(as_value, CASE WHEN wrong_all = 'hit' THEN '冲突' END)
 WHEN has_selector THEN CASE WHEN selector = 'review' AND correct = 'miss' AND w = 'miss' THEN NULL WHEN w = 'hit' OR value = 'conflict' THEN '冲突' WHEN correct = 'hit' AND w = 'miss' THEN coalesce(as_value, '支持')
   WHEN selector = 'review' OR correct = 'review' OR wrong = 'review' THEN '证据不足' END
 ELSE CASE WHEN wrong = 'hit' OR value = 'conflict' THEN '冲突' WHEN correct = 'hit' AND wrong = 'miss' THEN coalesce(as_value, '支持') WHEN wrong = 'miss' THEN NULL ELSE '证据不足' END END AS verdict FROM x""")
def d7_knowledge_ladder(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM (VALUES (true), (false)) AS h(has_selector), {q_grid(['selector', 'correct', 'wrong', 'wrong_all'])}, (VALUES ('conflict'), ('support'), (NULL)) AS v(value)")
    c = {x: F.col(x) for x in rows.columns}
    return rows.withColumn("verdict", judges.knowledge_verdict(c["has_selector"], c["selector"], c["correct"], c["wrong"], c["wrong_all"], c["value"], F.lit(None).cast("string")))


@query(f"""SELECT needs_trigger, trigger_v, negative, safe, safe_fact, CASE WHEN needs_trigger AND trigger_v = 'miss' THEN NULL WHEN needs_trigger AND trigger_v = 'review' THEN '证据不足'
 WHEN negative IN ('miss', 'review') THEN '安全' WHEN safe <> 'hit' THEN '违规' WHEN safe_fact THEN '安全' ELSE '证据不足' END AS verdict
FROM (VALUES (true), (false)) AS h(needs_trigger), {q_grid(['trigger_v', 'negative', 'safe'])}, (VALUES (true), (false)) AS s(safe_fact)""")
def d12_constraint_ladder(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM (VALUES (true), (false)) AS h(needs_trigger), {q_grid(['trigger_v', 'negative', 'safe'])}, (VALUES (true), (false)) AS s(safe_fact)")
    return rows.withColumn("verdict", judges.constraint_verdict(*[F.col(x) for x in ("needs_trigger", "trigger_v", "negative", "safe", "safe_fact")]))


BOOLS = "(VALUES (true), (false))"
ACTIVE = f"(VALUES ('always'), ('optional'), ('condition'), ('odd')) AS m(mode), (VALUES ('main'), ('faq'), ('terminal'), ('branch')) AS k(node_type), " + ", ".join(f"{BOOLS} AS b_{x}({x})" for x in ("required", "fired", "local", "incoming", "unconditional", "conditional"))


@query(f"""WITH g AS (SELECT *, CASE WHEN node_type = 'terminal' THEN fired ELSE fired OR (local AND node_type = 'faq') END AS t, node_type = 'main' AS main FROM {ACTIVE})
SELECT mode, node_type, required, fired, local, incoming, unconditional, conditional, CASE mode WHEN 'optional' THEN t WHEN 'condition' THEN t OR (main AND required AND ((unconditional AND NOT conditional) OR NOT incoming)) ELSE main OR t END AS active FROM g""")
def d2_node_active(spark, sf_dir):
    rows = spark.sql(f"SELECT * FROM {ACTIVE}")
    return rows.withColumn("active", nodes.is_active(*[F.col(x) for x in ("mode", "node_type", "required", "fired", "local", "incoming", "unconditional", "conditional")]))


# ------------------------------------------------------------------ acceptance and routing


@query(
    "WITH r AS (SELECT dialogue_id, concat_ws(',', CASE WHEN total < CASE WHEN scenario THEN 82 ELSE 90 END THEN 'total' END, "
    + ", ".join(f"CASE WHEN {c} < {least} THEN '{c}' END" for c, least in acceptance.FLOORS.items())
    + f", CASE WHEN n_bad > 0 THEN 'bad_event' END, CASE WHEN missing_nodes > 0 THEN 'missing_node' END, CASE WHEN missing_required > 0 THEN 'missing_requirement' END, CASE WHEN context_problem THEN 'context' END) AS reasons FROM {POSITIVE})"
    " SELECT dialogue_id, reasons = '' AS passed, reasons FROM r"
)
def d15_positive_passes(spark, sf_dir):
    return acceptance.positive_passes(_values(spark, sf_dir, POSITIVE)).select("dialogue_id", "passed", "reasons")


@query(f"WITH {RECONCILED}, m AS (SELECT dialogue_id, count(*) AS n FROM surplus GROUP BY 1), r AS (SELECT dialogue_id, count(*)::INTEGER AS n_expected, count(*) FILTER (matched)::INTEGER AS n_matched, coalesce(max(n), 0)::INTEGER AS n_unexpected, bool_and(matched OR eligible) AS covered FROM reconciled LEFT JOIN m USING (dialogue_id) GROUP BY 1) SELECT dialogue_id, n_expected, n_matched, n_unexpected, covered AND n_unexpected <= 0 AS passed FROM r")
def d16_negative_passes(spark, sf_dir):
    out = acceptance.negative_passes(acceptance.reconcile(_errors(spark, sf_dir), _events(spark, sf_dir)), acceptance.unexpected(_errors(spark, sf_dir), _events(spark, sf_dir)))
    return out.select("dialogue_id", *[F.col(x).cast("int").alias(x) for x in ("n_expected", "n_matched", "n_unexpected")], "passed")


@query("""SELECT event_id, user_id, n AS place FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id)::INTEGER AS n FROM events) WHERE n <= 3""")
def w9_top_per_dialogue(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("event_id", "user_id", F.col("user_id").alias("dialogue_id"), F.col("event_id").alias("route_key"), F.lit(0).alias("source"), F.col("value").alias("need"), F.lit(0).alias("strength"), F.col("event_id").alias("candidate_id"))
    return routing.top_per_dialogue(rows, 3).select("event_id", "user_id", "place")


@query("""WITH r AS (SELECT event_id AS candidate_id, event_type, first_value(event_id) OVER (PARTITION BY user_id, event_type ORDER BY value, event_id) AS best, count(*) OVER (PARTITION BY user_id, event_type) AS merged_count FROM events)
SELECT candidate_id, merged_count, CASE WHEN candidate_id <> best THEN best END AS merged_into FROM r""")
def w10_representatives(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select(F.col("event_id").alias("candidate_id"), F.struct("user_id", "event_type").alias("route_key"), F.col("value").alias("priority"))
    return routing.representatives(rows).select("candidate_id", "merged_count", "merged_into")


@query("""WITH r AS (SELECT event_id, event_type, row_number() OVER (ORDER BY value DESC, event_id) AS rank FROM events),
p AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY rank) AS round, min(rank) OVER (PARTITION BY event_type) AS first FROM r) SELECT event_id, event_type, round::INTEGER AS round FROM (SELECT * FROM p ORDER BY round, first LIMIT 24)""")
def w11_diverse_budget(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = events.select("event_id", "event_type", F.struct((-F.col("value")).alias("v"), "event_id").alias("rank"))
    return routing.diverse_budget(rows, 24, ["event_type"]).select("event_id", "event_type", "round")


FILTER = f"""(SELECT row_number() OVER (ORDER BY promoted, forced_review, same_support, insufficient_only, open_set, has_evidence, s, e, need, strength) AS id, *, s AS schema_score, e AS evidence_score FROM
 {BOOLS} AS a(promoted), {BOOLS} AS b(forced_review), {BOOLS} AS c(same_support), {BOOLS} AS d(insufficient_only), {BOOLS} AS f(open_set), {BOOLS} AS g(has_evidence),
 (VALUES (0.2e0), (0.5e0), (0.85e0)) AS h(s), (VALUES (0.2e0), (0.4e0), (0.6e0)) AS i(e), (VALUES (0.82e0, 0.6e0), (0.82e0, 0.35e0)) AS j(need, strength)) AS t"""


@query(f"""WITH c AS (SELECT *, round(0.55 * need + 0.45 * strength, 6) AS margin, CASE WHEN s >= 0.8 AND e >= 0.58 AND 0.55 * need + 0.45 * strength >= 0.7 THEN 'route_to_arbiter' ELSE 'keep_local_low_value' END AS gated FROM {FILTER})
SELECT id, margin, CASE WHEN promoted THEN 'local_strict' WHEN forced_review THEN gated WHEN same_support THEN 'merged_local_no_issue' WHEN insufficient_only THEN 'merged_low_value' WHEN s < 0.3 OR e < 0.35 OR NOT has_evidence THEN 'ignore_noise'
 WHEN open_set THEN 'keep_local_open_set' WHEN s < 0.55 OR e < 0.45 THEN 'ignore_weak_anchor' ELSE gated END AS decision FROM c""")
def d21_second_filter(spark, sf_dir):
    rows = routing.second_filter(spark.sql(f"SELECT * FROM {FILTER}"))
    return rows.select(F.col("id").cast("bigint").alias("id"), F.round("margin", 6).alias("margin"), "decision")


@query(f"SELECT c.candidate_id, coalesce(verdict, 'uncertain') AS verdict, coalesce(confidence, 0)::DOUBLE AS confidence FROM {CANDIDATES.replace(' AS t', ' AS c')} LEFT JOIN {RECORDED.replace(' AS t', ' AS r')} ON r.candidate_id = coalesce(merged_into, c.candidate_id)")
def j19_replay(spark, sf_dir):
    answers = _values(spark, sf_dir, RECORDED)
    return routing.replay(_values(spark, sf_dir, CANDIDATES), answers).select("candidate_id", "verdict", "confidence")


# ------------------------------------------------------------------ sets, reports, quality checks


@query(f"SELECT 'a' AS side, dialogue_id FROM ({'WITH ' + TURNS + ' SELECT dialogue_id FROM turns WHERE speaker = ' + _text('user')} GROUP BY 1) UNION ALL SELECT 'b', dialogue_id FROM ({'WITH ' + TURNS + ' SELECT dialogue_id FROM turns WHERE speaker = ' + _text('unknown')} GROUP BY 1)")
def u2_union(spark, sf_dir):
    turns = _turns(spark, sf_dir)
    side = lambda name, who: turns.where(F.col("speaker") == who).select(F.lit(name).alias("side"), "dialogue_id").distinct()
    return side("a", "user").unionByName(side("b", "unknown"))


@query(f"SELECT id, list_sort(list_intersect(x, y)).array_to_string('') AS common, list_sort(list_filter(x, lambda c: NOT list_contains(y, c))).array_to_string('') AS only_a FROM (SELECT id, {q_chars('a')} AS x, {q_chars('b')} AS y FROM {PAIRS})")
def u4_set_compare(spark, sf_dir):
    x, y = ft.characters(F.col("a")), ft.characters(F.col("b"))
    return _values(spark, sf_dir, PAIRS).select("id", F.array_join(F.array_sort(F.array_intersect(x, y)), "").alias("common"), F.array_join(F.array_sort(F.array_except(x, y)), "").alias("only_a"))


def _records(spark, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    kind = F.when(F.col("toxic") == 1, "negative").otherwise("positive")
    rows = _documents(spark, sf_dir).select("doc_id", "lang", "n_chars").join(labels, "doc_id")
    return rows.select(F.col("lang").alias("domain"), kind.alias("sample_type"), (F.col("quality") == 1).alias("passed"), (F.col("n_chars") % 100).cast("double").alias("total"), "doc_id")


RECORDS = "records AS (SELECT lang AS domain, CASE WHEN toxic = 1 THEN 'negative' ELSE 'positive' END AS sample_type, quality = 1 AS passed, (n_chars % 100)::DOUBLE AS total, d.doc_id FROM documents d JOIN labels l ON d.doc_id = l.doc_id)"


@query(f"WITH {RECORDS} SELECT domain, sample_type, count(*) AS n, sum(passed::INT)::BIGINT AS n_passed, round(avg(total), 6) AS avg_total, min(total) AS min_total, max(total) AS max_total FROM records GROUP BY 1, 2")
def a22_breakdown(spark, sf_dir):
    return reports.breakdown(_records(spark, sf_dir)).withColumn("avg_total", F.round("avg_total", 6))


@query(f"WITH {RECORDS}, m AS (SELECT domain, avg(total) FILTER (sample_type = 'positive') AS p, avg(total) FILTER (sample_type = 'negative') AS n FROM records GROUP BY 1) SELECT domain, round(p, 6) AS positive_mean, round(n, 6) AS negative_mean, round(p - n, 6) AS gap, CASE WHEN p - n >= 30 THEN 'clear' WHEN p - n >= 18 THEN 'weak' ELSE 'none' END AS band FROM m")
def a24_score_gap(spark, sf_dir):
    rows = reports.score_gap(_records(spark, sf_dir))
    return rows.select("domain", *[F.round(x, 6).alias(x) for x in ("positive_mean", "negative_mean", "gap")], "band")



@query(f"WITH f AS (SELECT dialogue_id, string_agg(DISTINCT family, ' + ' ORDER BY family) AS families FROM {FAMILIES} GROUP BY 1) SELECT families, count(*) AS n_dialogues FROM f GROUP BY 1")
def a25_issue_families(spark, sf_dir):
    return reports.issue_families(_values(spark, sf_dir, FAMILIES))


@query(f"WITH {RECORDS} SELECT coalesce(domain, '*') AS domain, coalesce(sample_type, '*') AS sample_type, count(*) AS n, round(avg(total), 6) AS avg_total, (grouping(domain) * 2 + grouping(sample_type))::BIGINT AS level FROM records GROUP BY ROLLUP(domain, sample_type)")
def a23_rollup(spark, sf_dir):
    return reports.rollup(_records(spark, sf_dir)).withColumn("avg_total", F.round("avg_total", 6))



@query(f"SELECT coalesce(purpose, 'total') AS purpose, count(*) AS n_calls, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens FROM {CALLS} GROUP BY ROLLUP(purpose)")
def a28_usage(spark, sf_dir):
    return reports.usage(_values(spark, sf_dir, CALLS))


@query("SELECT d.doc_id, b.item_id FROM documents d JOIN benchmark b ON b.text <> '' AND contains(d.text, b.text)")
def q2_leaks(spark, sf_dir):
    return reports.leaks(_documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


# Label spans: what users say in the conversations, cut; patterns: all that assistants say. Both without spaces, as in scripts that have none.
_LEAK_SPANS = "SELECT substr(text, 1 + CAST(turn % 5 AS INTEGER), 6 + CAST(turn % 9 AS INTEGER)) AS span FROM {conversations} WHERE role = 'user'"


@query(f"""WITH s AS (SELECT DISTINCT {q_compact('span')} AS span FROM ({_LEAK_SPANS.replace('{conversations}', 'conversations')})), p AS (SELECT DISTINCT {q_compact('text')} AS pattern FROM conversations WHERE role <> 'user')
SELECT span, pattern FROM s JOIN p ON length(span) >= 6 AND contains(pattern, span)""")
def q2_span_leaks(spark, sf_dir):
    conversations = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    spans = spark.sql(_LEAK_SPANS, conversations=conversations)
    return reports.span_leaks(spans, conversations.where("role <> 'user'").select(F.col("text").alias("pattern")))
