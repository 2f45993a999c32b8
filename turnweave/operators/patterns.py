"""Patterns of words over turns, and scans for the object that a trigger or requirement names.

A pattern is a record of the catalogue (``plans.graph.pattern``); what it says becomes one
Column expression, or for patterns over several turns a join of few columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.cues import AWARENESS, INQUIRY, generic_inquiry, short_affirmation
from turnweave.functions.cues import fuzzy_hit as _fuzzy
from turnweave.functions.numbers import number_in_range, numbers
from turnweave.functions.text import any_of, char_overlap, characters, compact
from turnweave.operators.context import previous_user_turn, replies_within
from turnweave.operators.requirements import window_union
from turnweave.operators.term_index import word_marks
from turnweave.plans.local import local_table

# Bounds of broad patterns, similarities, and words that show a structure.
BROAD, SIMILAR, SLOT_SHARE, SLOT_COMMON = 4, 0.82, 0.86, 3
STRUCTURE = ("选项", "显示", "展示", "页面", "类型", "方式", "规则", "流程", "入口", "设置", "配置", "时间")
ASKED = ("assistant_ask_user_affirm", "ask_user_affirm")
NEUTRAL_PROBLEMS = ("不可见", "不能用", "无法使用")
NEUTRAL_SEEN = ("已显示", "已经显示", "能看到", "看得到", "看到了", "可以看到")
REPAIRS = ("enable", "repair", "configure", "open", "guide", "配置", "引导", "修复", "处理")


def asks_if_known(value: str) -> bool:
    tight = "".join(value.split()).lower()
    return any(w in tight for w in INQUIRY) and any(w in tight for w in AWARENESS)


def is_short_word(value: str) -> bool:
    tight = "".join(value.split())
    return 1 <= len(tight) <= 2 and all("一" <= c <= "鿿" for c in tight)


def strengthened(pattern: dict, broad: frozenset[str] = frozenset()) -> dict:
    """A pattern of a requirement as it is executed: many alternatives need two hits, one of them telling; weak words that
    all have to be there may be met loosely."""
    out = dict(pattern)
    if pattern["speaker"] not in ("", "assistant") or not pattern["any"] or pattern["regex_any"] or pattern.get("number"):
        return out
    if any(asks_if_known(v) or is_short_word(v) for v in pattern["all"]):
        out["loose_all"] = True
    if len(pattern["any"]) >= BROAD and not pattern["all"]:
        out["least"] = max(2, pattern["least"])
        out["loose_any"] = True
        weak = [v for v in pattern["any"] if v in broad]
        if weak and len(weak) < len(pattern["any"]):
            out["weak"] = weak
    return out


def _said(value: str, text: Column, fuzzy: bool) -> Column:
    return _fuzzy(F.lit(value), text) if fuzzy else F.contains(F.lower(text), F.lit(value.lower()))


def _loosely(value: str, text: Column) -> Column:
    """A paraphrase: a question of knowledge by any such question, a long phrase by its characters."""
    if asks_if_known(value):
        return generic_inquiry(text)
    if len("".join(value.split())) < 6:
        return F.lit(False)
    a, b = compact(F.lit(value)), compact(text)
    return F.contains(b, a) | (F.contains(a, b) & (b != "")) | (char_overlap(F.lit(value), text, "min", 2) >= SIMILAR)


def turn_matches(pattern: dict, text: Column, speaker: Column, fuzzy: bool = False) -> Column:
    """Whether one turn holds a pattern: speaker, all, any with the least number of hits, none, regex_any, number.

    Kinds and polarities are named by no turn, so that patterns that ask for them match nothing.
    """
    out = F.lit(True) if not pattern["speaker"] else speaker == pattern["speaker"]
    if pattern.get("kinds_any") or pattern.get("polarity"):
        return F.lit(False)
    all_ok = F.lit(True)
    for value in pattern["all"]:
        all_ok = all_ok & F.contains(F.lower(text), F.lit(value.lower()))
    if pattern["any"]:
        own = [_said(v, text, fuzzy) | (_loosely(v, text) if pattern.get("loose_any") else F.lit(False)) for v in pattern["any"]]
        loose = [_said(v, text, fuzzy) | _fuzzy(F.lit(v), text) for v in pattern["any"]]
        hits = F.array_compact(F.array(*[F.when(F.when(all_ok, a).otherwise(b), F.lit(v)) for v, a, b in zip(pattern["any"], own, loose, strict=True)]))
        out = out & (F.size(hits) >= pattern["least"])
        if pattern.get("weak"):
            out = out & (F.size(F.array_except(hits, F.array(*map(F.lit, pattern["weak"])))) > 0)
        if pattern.get("loose_all"):
            structured = F.exists(hits, lambda v: any_of(v, STRUCTURE))
            relaxed = F.size(hits) > 0
            for value in pattern["all"]:
                relaxed = relaxed & (generic_inquiry(text) if asks_if_known(value) else (F.size(hits) >= 3) | structured if is_short_word(value) else F.lit(False))
            all_ok = all_ok | relaxed
    out = out & all_ok
    for value in pattern["none"]:
        out = out & ~F.contains(F.lower(text), F.lit(value.lower()))
    if pattern["regex_any"]:
        out = out & text.rlike("(?i)" + "|".join(f"(?:{x})" for x in pattern["regex_any"]))
    rule = pattern.get("number")
    if rule:
        out = out & number_in_range(numbers(text), float(rule.get("min", "-inf")), float(rule.get("max", "inf")), str(rule.get("unit_contains") or ""))
    return out


def pattern_turns(turns: DataFrame, pattern: dict, fuzzy: bool = False, node_text: str | None = None) -> DataFrame:
    """(dialogue, turn_index) of the turns in which a pattern is met; asks that a short yes answers stand at the answer.

    ``node_text``: of the step that the pattern triggers; turns that name only its neutral object are left out.
    """
    text, speaker = F.col("text"), F.col("speaker")
    if node_text is not None:
        met = pattern_turns(turns, pattern, fuzzy)
        words = [*pattern["any"], *pattern["all"]]
        if not asks_for_repair(node_text, words):
            return met
        neutral = turns.where(only_neutral(node_text, words, text)).select("dialogue_id", "turn_index")
        return met.join(neutral, ["dialogue_id", "turn_index"], "left_anti")
    if pattern.get("cross_turn") in ASKED:
        ask = turn_matches({**pattern, "speaker": "", "cross_turn": None}, text, speaker, fuzzy)
        return replies_within(turns, ask, short_affirmation("text"), pattern["within"]).select("dialogue_id", F.col("reply_turn").alias("turn_index"))
    if pattern.get("window_union"):
        return window_union(turns, pattern["speaker"] or "assistant", tuple(pattern["any"]), pattern["least"])
    rows = turns
    holds = turn_matches(pattern, text, speaker, fuzzy)
    if pattern["reply_to_user_any"]:
        rows = previous_user_turn(turns)
        holds = holds & (speaker == "assistant") & any_of(F.lower(F.coalesce("prev_user_text", F.lit(""))), [x.lower() for x in pattern["reply_to_user_any"]])
        if pattern["assistant_any"]:
            holds = holds & any_of(F.lower(text), [x.lower() for x in pattern["assistant_any"]])
    return rows.where(holds).select("dialogue_id", "turn_index")


def indexable(pattern: dict) -> bool:
    """Whether a pattern is words of one turn, so that ``indexed_turns`` can find it."""
    special = ("cross_turn", "window_union", "reply_to_user_any", "number", "kinds_any", "polarity", "loose_any", "loose_all", "weak")
    return bool(pattern["any"] or pattern["all"]) and not any(pattern.get(x) for x in special)


def indexed_turns(turns: DataFrame, listed: list[tuple[str, dict]]) -> DataFrame:
    """(dialogue, turn_index, pattern_id) of all turns in which one of many ``indexable`` patterns is met: ``pattern_turns`` of each.

    One pass over a turn finds the words of all patterns. A turn meets the patterns of which it has a word that they need (one of
    all, or any of any), and only these are counted; the number of patterns makes no plan longer.
    """
    spark = turns.sparkSession
    number = {w: i for i, w in enumerate(dict.fromkeys(w.lower() for _, p in listed for w in (*p["any"], *p["all"], *p["none"])))}
    numbers_of = lambda words: [number[w.lower()] for w in words]
    rows, keys = [], []
    for k, (_, p) in enumerate(listed):
        regex = "(?i)" + "|".join(f"(?:{x})" for x in p["regex_any"]) if p["regex_any"] else None
        rows.append((k, p["speaker"] or "", numbers_of(p["any"]), numbers_of(p["all"]), numbers_of(p["none"]), int(p["least"]), regex))
        need = {max(p["all"], key=len)} if p["all"] else set(p["any"])
        keys += [(k, number[w.lower()]) for w in need]
    known = F.broadcast(local_table(spark, rows, "pattern int, asked string, some array<int>, all array<int>, none array<int>, least int, regex string"))
    keyed = F.broadcast(local_table(spark, sorted(set(keys)), "pattern int, mark int"))
    marked = word_marks(turns, list(number), ["dialogue_id", "turn_index", "speaker"])
    pairs = marked.withColumn("mark", F.explode("marks")).join(keyed, "mark").drop("mark").distinct().join(known, "pattern")
    held = lambda c: F.size(F.filter(c, lambda x: F.array_contains("marks", x)))
    enough = (F.size("some") == 0) | (held("some") >= F.col("least"))
    met = pairs.where(F.col("asked").isin("") | (F.col("asked") == F.col("speaker"))).where(enough & (held("all") == F.size("all")) & (held("none") == 0))
    if any(p["regex_any"] for _, p in listed):
        plain, with_regex = met.where("regex IS NULL"), met.where("regex IS NOT NULL").join(turns.select("dialogue_id", "turn_index", "text"), ["dialogue_id", "turn_index"])
        met = plain.select("dialogue_id", "turn_index", "pattern").unionByName(with_regex.where(F.rlike("text", F.col("regex"))).select("dialogue_id", "turn_index", "pattern"))
    names = F.broadcast(local_table(spark, [(k, name) for k, (name, _) in enumerate(listed)], "pattern int, pattern_id string"))
    return met.select("dialogue_id", "turn_index", "pattern").join(names, "pattern").drop("pattern")


def all_turns(turns: DataFrame, listed: list[tuple[str, dict]]) -> DataFrame:
    """(dialogue, turn_index, pattern_id) of many patterns: those of words together, the others one by one."""
    plain = [x for x in listed if indexable(x[1])]
    out = indexed_turns(turns, plain) if plain else local_table(turns.sparkSession, [], "dialogue_id string, turn_index int, pattern_id string")
    for name, p in listed:
        if not indexable(p):
            out = out.unionByName(pattern_turns(turns, p).withColumn("pattern_id", F.lit(name)))
    return out


def slot_hit(term: Column, text: Column) -> Column:
    """A term of a slot: contained, or from four characters on nearly all of its characters."""
    a, b = compact(term), compact(text)
    x, y = characters(a), characters(b)
    common = F.size(F.array_intersect(x, y))
    return (a != "") & (b != "") & (F.contains(b, a) | ((F.length(a) >= 4) & (common >= SLOT_COMMON) & (common / F.size(x) >= SLOT_SHARE)))


def scan_objects(turns: DataFrame, objects: DataFrame) -> DataFrame:
    """(dialogue, object_id, matched, turn_index, share): where an object is named.

    ``objects`` (metadata): object_id, speaker ("": any), direct and none (arrays of terms), slots (array of arrays of terms),
    least (slots that have to be met). The first turn with a direct term counts, otherwise the first with enough slots,
    otherwise the one with the most; turns with a term of ``none`` do not count.
    """
    text = F.col("text")
    some = lambda terms: F.exists(terms, lambda t: slot_hit(t, text))
    rows = turns.join(F.broadcast(objects.withColumnRenamed("speaker", "asked")), (F.col("asked") == "") | (F.col("speaker") == F.col("asked")))
    rows = rows.where(~some(F.col("none"))).withColumn("named", some(F.col("direct")))
    rows = rows.withColumn("met", F.size(F.filter("slots", some))).where("named OR met > 0")
    n = F.size("slots")
    enough = (n > 0) & (F.col("met") >= F.greatest(F.lit(1), F.least(F.col("least"), n)))
    share = F.when(F.col("named") | enough, F.lit(1.0)).otherwise(F.col("met") / F.greatest(F.lit(1), n))
    rank = F.when(F.col("named"), 0).when(enough, 1).otherwise(2)
    order = F.struct(rank.alias("rank"), F.when(rank == 2, -share).otherwise(F.lit(0.0)).alias("less"), "turn_index")
    best = rows.groupBy("dialogue_id", "object_id").agg(F.min_by(F.struct((rank < 2).alias("matched"), "turn_index", share.alias("share")), order).alias("b"))
    return best.select("dialogue_id", "object_id", "b.*")


def asks_for_repair(node_text: str, words: list[str]) -> bool:
    """Whether a step repairs something, and its pattern has words of a problem."""
    tight = ["".join(w.split()) for w in words]
    return any(w in node_text.lower() for w in REPAIRS) and any(p in w for p in NEUTRAL_PROBLEMS for w in tight)


def only_neutral(node_text: str, words: list[str], text: Column) -> Column:
    """Whether a turn names only the neutral object of a repair step, and not the problem that the step is for."""
    if not asks_for_repair(node_text, words):
        return F.lit(False)
    said = F.regexp_replace(text, r"(?U)\s+", "")
    return any_of(said, NEUTRAL_SEEN) | ~any_of(said, NEUTRAL_PROBLEMS)
