"""Predicates over what a turn does in a call: asks, confirms, stops, goes on; and names of verdicts and families."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.text import _c, any_of, characters, compact, strict_hit

# Words of inquiries, acknowledgements, of going on and of stopping.
INQUIRY = ("吗", "是否", "是不是", "有没有")
AWARENESS = ("知道", "了解", "知情", "确认")
ACK_NO = ("不是", "不对", "没有", "没", "否", "别", "不要")
ACK_YES = ("是", "对", "嗯", "恩", "本人", "我", "没错", "可以", "行", "好", "你说", "您说")
CONTINUE = ("你说", "您说", "说吧", "继续", "接着", "讲重点", "挑重点", "快点说", "我在听", "可以说", "能说", "简短说", "说重点", "长话短说", "说一下", "说完", "别漏")
STOP = ("别说", "不要说", "先挂", "挂了", "回头", "稍后", "没空", "不方便接")
EARLY_STOP = (*STOP, "不方便", "没空", "忙", "开车", "骑车", "路上", "真跑不了", "跑不了", "先不跑", "晚点再说")
QUESTION = ("?", "？", "吗", "什么", "怎么", "多少", "哪里", "哪", "是否", "能不能", "可不可以", "为什么", "啥")
ACK_LENGTH = 16
# What separates the parts of an anchor.
PARTS = r"[，,。；;：:/、()（）\[\]{}]|和|与|及|或"


def fuzzy_hit(value: Column | str, text: Column | str, least: float = 0.75) -> Column:
    """A phrase by its characters: contained either way, or enough of the smaller set; under three characters only literally."""
    v, t = F.lower(F.coalesce(_c(value), F.lit(""))), F.lower(F.coalesce(_c(text), F.lit("")))
    a, b = compact(value), compact(text)
    x, y = characters(a), characters(b)
    common = F.size(F.array_intersect(x, y))
    loose = (F.least(F.length(a), F.length(b)) >= 3) & (common >= 2) & (common / F.least(F.size(x), F.size(y)) >= least)
    inside = F.contains(t, v) | ((a != "") & (b != "") & (F.contains(b, a) | F.contains(a, b)))
    return (v != "") & (inside | ((a != "") & (b != "") & loose))


def loose_hit(value: Column | str, text: Column | str, least: float = 0.5) -> Column:
    """A phrase of the context: contained, or half of the smaller set of characters."""
    a, b = compact(value), compact(text)
    x, y = characters(a), characters(b)
    common = F.size(F.array_intersect(x, y))
    loose = (F.least(F.length(a), F.length(b)) >= 3) & (common >= 2) & (common / F.least(F.size(x), F.size(y)) >= least)
    return (a != "") & (b != "") & (F.contains(b, a) | loose)


def anchor_hit(anchor: Column | str, text: Column | str) -> Column:
    """An anchor literally, by all its parts, or by its first and last two characters."""
    a, b = compact(anchor), compact(text)
    parts = F.filter(F.split(a, PARTS), lambda x: x != "")
    apart = (F.size(parts) >= 2) & F.forall(parts, lambda p: F.contains(b, p))
    ends = F.contains(b, F.substring(a, 1, 2)) & F.contains(b, F.right(a, F.lit(2)))
    return (a != "") & (b != "") & (strict_hit(anchor, text) | ((F.length(a) >= 4) & (apart | ends)))


def generic_inquiry(text: Column | str) -> Column:
    """Whether a text asks if something is known."""
    a = compact(text)
    return any_of(a, INQUIRY) & any_of(a, AWARENESS)


def short_predicate(text: Column | str) -> Column:
    return compact(text).rlike(r"^[一-鿿]{1,2}$")


def short_affirmation(text: Column | str) -> Column:
    """A short yes without a no."""
    a = compact(text)
    return (a != "") & (F.length(a) <= ACK_LENGTH) & ~any_of(a, ACK_NO) & any_of(a, ACK_YES)


def questionish(text: Column | str) -> Column:
    return any_of(F.coalesce(_c(text), F.lit("")), QUESTION)


def allows_continue(text: Column | str) -> Column:
    """Leave to go on; a word of stopping overrides it."""
    a = compact(text)
    return ~any_of(a, STOP) & any_of(a, CONTINUE)


def mixed_tokens(text: Column | str) -> Column:
    """Words, and of Chinese runs the short ones, pairs and triples of characters."""
    a = F.lower(F.coalesce(_c(text), F.lit("")))
    words = F.filter(F.split(a, r"[^a-z0-9一-鿿]+"), lambda x: x != "")
    latin = F.regexp_extract_all(a, F.lit("[a-z0-9]+"), F.lit(0))
    runs = F.regexp_extract_all(a, F.lit(r"[一-鿿]+"), F.lit(0))
    grams = lambda x, n: F.when(F.length(x) >= n, F.transform(F.sequence(F.lit(1), F.length(x) - (n - 1)), lambda i: F.substring(x, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))
    pieces = F.flatten(F.transform(runs, lambda x: F.concat(grams(x, 2), grams(x, 3))))
    return F.array_distinct(F.concat(words, latin, F.filter(runs, lambda x: F.length(x) <= 6), pieces))


# Verdicts of arbiters by word, then by what an answer holds.
CONFIRMED = ("yes", "true", "confirmed", "confirm", "confirmed_issue", "issue", "problem", "成立", "确认", "确认成立", "问题成立", "冲突", "事实冲突", "违规", "限制违规", "未完成", "缺失")
REFUSED = ("no", "false", "no_issue", "not_issue", "safe", "not_confirmed", "不成立", "未成立", "安全", "问题不成立", "支持", "正确", "事实正确", "已完成", "无问题")
OPEN = ("uncertain", "unknown", "insufficient", "证据不足", "不确定", "无法判断")
HOLDS_CONFIRMED = ("问题成立", "事实冲突", "限制违规", "确实违规", "确实缺失")
HOLDS_REFUSED = ("问题不成立", "事实正确", "安全表达", "已经完成", "无违规")
HOLDS_OPEN = ("证据不足", "无法判断", "不确定")


def arbiter_verdict(answer: Column | str) -> Column:
    """confirmed_issue, no_issue or uncertain of an arbiter's free answer."""
    a = F.lower(F.trim(F.coalesce(_c(answer), F.lit(""))))
    has = lambda *w: any_of(a, w)
    return (
        F.when(a.isin(*CONFIRMED), "confirmed_issue")
        .when(a.isin(*REFUSED), "no_issue")
        .when(a.isin(*OPEN), "uncertain")
        .when(has(*HOLDS_CONFIRMED), "confirmed_issue")
        .when(has(*HOLDS_REFUSED), "no_issue")
        .when(has(*HOLDS_OPEN), "uncertain")
        .when(has("confirm") | (has("issue") & ~has("no")), "confirmed_issue")
        .when(has("no", "safe"), "no_issue")
        .otherwise("uncertain")
    )


# Families of errors by their names, then by what the kind of a candidate holds.
FAMILIES = {
    "flow_missing": ("flow", "missing", "process_missing", "flow_missing", "流程缺失"),
    "knowledge_violation": ("knowledge", "knowledge_error", "knowledge_violation", "faq_wrong", "fact_wrong", "知识错误"),
    "semantic_or_context": ("semantic_or_context",),
    "context_violation": ("context", "context_violation"),
    "constraint_violation": ("constraint", "boundary", "boundary_violation", "constraint_violation", "限制违规"),
}
KINDS = (("知识", "knowledge_violation"), ("限制", "constraint_violation"), ("边界", "constraint_violation"), ("requirement", "flow_missing"), ("样本验收", "flow_missing"), ("上下文", "context_violation"))


def error_family(name: Column | str, kind: Column | None = None) -> Column:
    v = F.lower(F.trim(F.coalesce(_c(name), F.lit(""))))
    out = F.when(F.lit(False), F.lit(""))
    for family, names in FAMILIES.items():
        out = out.when(v.isin(*names), family)
    if kind is not None:
        for word, family in KINDS:
            out = out.when(F.contains(F.coalesce(kind, F.lit("")), F.lit(word)), family)
    return out.when(v != "", v).otherwise("unknown")
