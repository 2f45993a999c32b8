"""Facts and constraints: ladders over the verdicts of their sides, and metrics of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import any_of, char_jaccard, compact

# Names of verdicts.
SUPPORT, CONFLICT, UNSURE = "支持", "冲突", "证据不足"
SAFE, VIOLATION = "安全", "违规"


def knowledge_verdict(has_selector: Column, selector: Column, correct: Column, wrong: Column, wrong_all: Column, value: Column, direction: Column) -> Column:
    """The verdict of a fact, or null if it is not mentioned.

    selector, correct, wrong, wrong_all: hit, review or miss; value and direction:
    conflict, support or null of the comparison of values and of directions.
    """
    grey = (correct == "review") | (wrong == "review")
    as_value = F.when(value == "conflict", CONFLICT).when(value == "support", SUPPORT)
    turned = direction == "conflict"
    aside = F.when(value.isNotNull(), as_value).when(turned, CONFLICT).when(wrong_all == "hit", CONFLICT)
    worse = F.when((wrong == "miss") & (wrong_all == "hit"), "hit").otherwise(wrong)
    nothing = (selector == "review") & (correct == "miss") & (worse == "miss")
    inside = (
        F.when(nothing, None)
        .when(worse == "hit", CONFLICT)
        .when(value == "conflict", CONFLICT)
        .when(turned, CONFLICT)
        .when((correct == "hit") & (worse == "miss"), F.coalesce(as_value, F.lit(SUPPORT)))
        .when((selector == "review") | grey, UNSURE)
    )
    plain = (
        F.when(wrong == "hit", CONFLICT)
        .when(value == "conflict", CONFLICT)
        .when(turned, CONFLICT)
        .when((correct == "hit") & (wrong == "miss"), F.coalesce(as_value, F.lit(SUPPORT)))
        .when((wrong == "miss") & correct.isin("miss", "review"), None)
        .otherwise(UNSURE)
    )
    return F.when(has_selector, F.when(selector == "miss", aside).otherwise(inside)).otherwise(plain)


def constraint_verdict(needs_trigger: Column, trigger: Column, negative: Column, safe: Column, safe_fact: Column) -> Column:
    """The verdict of a hard constraint, or null where its trigger did not occur."""
    judged = (
        F.when(negative == "miss", SAFE)
        .when((safe == "hit") & (negative == "review"), SAFE)
        .when((negative == "hit") & (safe == "hit") & safe_fact, SAFE)
        .when((negative == "hit") & safe.isin("miss", "review"), VIOLATION)
        .when((negative == "hit") & (safe == "hit"), UNSURE)
        .otherwise(SAFE)
    )
    return F.when(needs_trigger & (trigger == "miss"), None).when(needs_trigger & (trigger == "review"), UNSURE).otherwise(judged)


def longest_turns(turns: DataFrame, limit: int) -> DataFrame:
    """(dialogue, turn_index, n_chars): the longest assistant turn, the first of equal ones, where it is over the limit."""
    sized = turns.where("speaker = 'assistant'").withColumn("n_chars", F.length(compact("text")))
    best = sized.groupBy("dialogue_id").agg(F.max_by(F.struct("turn_index", "n_chars"), F.struct("n_chars", -F.col("turn_index"))).alias("w"))
    return best.select("dialogue_id", "w.turn_index", "w.n_chars").where(F.col("n_chars") > limit)


def repeated_replies(turns: DataFrame, threshold: float = 0.8, reach: int = 3) -> DataFrame:
    """(dialogue, first, second, similarity): assistant turns that nearly repeat one of the ``reach`` before them."""
    by = Window.partitionBy("dialogue_id").orderBy("turn_index")
    own = turns.where("speaker = 'assistant'").withColumn("n", F.row_number().over(by)).select("dialogue_id", "turn_index", "text", "n")
    a = own.select("dialogue_id", F.col("turn_index").alias("first"), F.col("text").alias("a_text"), F.explode(F.sequence(F.col("n") + 1, F.col("n") + reach)).alias("n"))
    b = own.select("dialogue_id", F.col("turn_index").alias("second"), F.col("text").alias("b_text"), "n")
    pairs = a.join(b, ["dialogue_id", "n"]).withColumn("similarity", char_jaccard("a_text", "b_text"))
    return pairs.where(F.col("similarity") >= threshold).select("dialogue_id", "first", "second", "similarity")


def value_scope(selected: DataFrame, turns: DataFrame, reach: int = 2, keys: tuple[str, ...] = ()) -> DataFrame:
    """(dialogue, keys, turn_index, scope_ord): the selected assistant turn, then the next and the previous one in reach."""
    by = Window.partitionBy("dialogue_id").orderBy("turn_index")
    own = turns.where("speaker = 'assistant'").select("dialogue_id", "turn_index").distinct()
    near = own.withColumn("after", F.lead("turn_index").over(by)).withColumn("before", F.lag("turn_index").over(by))
    at = near.join(selected.select("dialogue_id", *keys, "turn_index").distinct(), ["dialogue_id", "turn_index"])
    keep = lambda c: F.when(F.abs(F.col(c) - F.col("turn_index")) <= reach, F.col(c))
    each = at.select("dialogue_id", *keys, F.posexplode(F.array("turn_index", keep("after"), keep("before"))).alias("scope_ord", "scope_turn"))
    return each.where("scope_turn IS NOT NULL").groupBy("dialogue_id", *keys, F.col("scope_turn").alias("turn_index")).agg(F.min("scope_ord").alias("scope_ord"))


# Pairs of directions (what is expected, what contradicts it, name), separators of clauses, words of states.
HIGH_LOW, STATUS = "高低方向反转", "状态反转"
DIRECTIONS = (
    (("较高", "略高", "更高", "偏高", "更贵"), ("较低", "更低", "偏低", "更便宜", "便宜"), HIGH_LOW),
    (("较低", "更低", "偏低", "更便宜", "便宜"), ("较高", "略高", "更高", "偏高", "更贵"), HIGH_LOW),
    (("适合", "适用", "适用于", "推荐", "鼓励选择"), ("不适合", "不太适合", "不推荐", "不建议"), "适用性反转"),
    (("更流畅", "更顺", "更顺畅", "互动更好", "实时互动"), ("差不多", "没区别", "区别不大", "关系不大", "不明显"), "互动/效果优势反转"),
    (("有助于", "有帮助", "帮助", "保住", "保留"), ("没帮助", "没有帮助", "无关", "不影响", "没用"), "作用/影响方向反转"),
    (("已", "已经", "已开放", "已开启", "已显示"), ("未", "未开放", "未开启", "未显示", "还没", "没有"), STATUS),
)
CLAUSE = "[；;。.!！?？\n，,]"
STATES = ("生效", "显示", "开通", "设置", "添加", "签署")


def direction_conflict(text: Column, subjects: Column, expected: Column) -> Column:
    """The name of the first pair whose expected side a fact states and whose other side the text says, or null.

    High and low count only in a clause that names one of the subjects (of three characters
    or more, if there are any); a state only right before the end of what has the state.
    """
    clauses = F.split(text, CLAUSE)
    named = F.filter(subjects, lambda t: F.length(t) >= 3)
    slots = F.filter(expected, lambda t: any_of(t, STATES))

    def near_subject(word: str) -> Column:
        first = F.get(F.filter(clauses, lambda c: F.contains(c, F.lit(word))), F.lit(0))
        return (F.size(named) == 0) | F.coalesce(F.exists(named, lambda t: F.contains(first, t)), F.lit(False))

    def at_state(word: str) -> Column:
        bound = F.exists(slots, lambda t: F.contains(text, F.concat(F.lit(word), F.right(t, F.lit(2)))) | F.contains(text, F.concat(F.lit(word), t)))
        return (F.size(slots) == 0) | bound

    def states(words: tuple[str, ...]) -> Column:
        return F.exists(expected, lambda t: any_of(t, words))

    guards = {HIGH_LOW: near_subject, STATUS: at_state}
    out = F.lit(None).cast("string")
    for wanted, opposite, label in reversed(DIRECTIONS):
        said = F.lit(False)
        for word in opposite:
            here = F.contains(text, F.lit(word))
            said = said | ((here & guards[label](word)) if label in guards else here)
        out = F.when(states(wanted) & said, F.lit(label)).otherwise(out)
    return out


def direction_conflicts(atoms: DataFrame, facts: DataFrame, selected: DataFrame) -> DataFrame:
    """(dialogue, fact_id, turn_index, seq, label): the first span of those that a fact's selector hit (``selected``: fact_id and span) that turns it round."""
    rows = selected.join(atoms.select("dialogue_id", "turn_index", "seq", "text"), ["dialogue_id", "turn_index", "seq"]).join(F.broadcast(facts), "fact_id")
    found = rows.withColumn("label", direction_conflict(F.col("text"), F.col("subjects"), F.col("expected"))).where("label IS NOT NULL")
    return found.groupBy("dialogue_id", "fact_id").agg(F.min(F.struct("turn_index", "seq", "label")).alias("m")).select("dialogue_id", "fact_id", "m.*")
