"""Comparable facts: units, numbers with units, days, and whether a value stands for the fact that is asked about.

The text is a column of turns; what is expected comes from the catalogue. All of it are
Column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.cues import anchor_hit
from turnweave.functions.numbers import compare_facts, day_words
from turnweave.functions.text import _c, any_of, compact, strict_hit

# Numerals, units, and how a range is written.
NUMERALS = {
    "零": 0, "一": 1, "二": 2, "两": 2, "三": 3, "四": 4, "五": 5, "六": 6, "七": 7, "八": 8, "九": 9, "十": 10,
    "十一": 11, "十二": 12, "十三": 13, "十四": 14, "十五": 15, "十六": 16, "十七": 17, "十八": 18, "十九": 19, "二十": 20,
}
UNITS = ("单", "天", "元", "秒", "分钟", "小时", "点")
NUMERAL = "|".join(sorted(NUMERALS, key=lambda x: (-len(x), x)))
UNIT_MARKS = "个单天点元秒分钟小时"
TO = "(?:到|-|~|—|至)"
EVENING = ("下午", "晚上")
SIX = ("下午6", "下午六", "晚上6", "晚上六")
# Words that deny a value, and words of days and particles that are no part of a fact's slot.
DENIED = ("不能", "不可以", "不可", "不算", "不是", "无需", "不用")
DAY_PARTS = (
    "今天", "当天", "当日", "明天", "次日", "翌日", "第二天", "下一天", "昨日", "昨天", "前天", "后天", "上周", "下周", "本周", "本月",
    "次月", "下月", "前一天", "后一天", "下一工作日", "工作日", "上午", "下午", "晚上", "中午", "凌晨", "早上", "点前", "点后",
    "之前", "以后", "以内", "之内", "之后", "前", "后", "点", "时", "分", "分钟", "小时", "天", "日", "周", "月", "年", "周期",
)
PARTICLES = ("为", "是", "在", "从", "到", "至", "于", "的", "了", "会", "可", "可以", "必须", "需要", "进行")
# Ends and words of general slots, and words of rewards.
GENERAL_ENDS = ("状态", "情况", "方式", "时间", "类型", "条件", "机制", "目的", "作用", "路径", "入口", "选项", "场景", "范围", "数量", "数值", "结果", "对象", "原因", "关系", "方向")
GENERAL_SLOTS = ("成本", "状态", "情况", "时间", "方式", "条件", "要求", "标准", "结果", "影响", "生效")
REWARDS = ("奖励", "额外", "奖金", "补贴", "补偿", "每单多", "多1", "多一")

_RANGE = rf"(\d+(?:\.\d+)?)\s*{TO}\s*(\d+(?:\.\d+)?)\s*([{UNIT_MARKS}]+)"
_SINGLE = rf"(\d+(?:\.\d+)?)\s*([{UNIT_MARKS}:]*)"
_WORD_RANGE = rf"({NUMERAL})\s*{TO}\s*({NUMERAL})\s*([{UNIT_MARKS}]+)"
_WORD_SINGLE = rf"({NUMERAL})\s*([{UNIT_MARKS}]+)"
_NEAR = r"\d+(?:\.\d+)?\s*([个单天元秒分钟小时]+)"
_WORD_NEAR = rf"({NUMERAL})\s*([个单天元秒分钟小时]+)"


def _held_unit(text: Column) -> Column:
    """The first unit, in the order of ``UNITS``, that a text holds, or null."""
    return F.coalesce(*[F.when(F.contains(text, F.lit(u)), F.lit(u)) for u in UNITS])


def unit_of(text: Column | str) -> Column:
    """The unit of a text's value: of hours before all, then of what stands behind a number or numeral; "" if there is none."""
    text = F.coalesce(_c(text), F.lit(""))
    near, word = F.regexp_extract(text, _NEAR, 1), F.regexp_extract(text, _WORD_NEAR, 2)
    return F.when(any_of(text, ("点", ":")), F.lit("点")).otherwise(F.coalesce(_held_unit(near), _held_unit(word), _held_unit(text), F.lit("")))


def plain_number(number: Column) -> Column:
    """A number as text, without an end of zeros."""
    whole = F.abs(number - F.floor(number)) < 1e-9
    return F.when(whole, F.floor(number).cast("string")).otherwise(F.regexp_replace(F.regexp_replace(F.format_string("%.6f", number), "0+$", ""), r"\.$", ""))


def number_units(text: Column | str, unit: Column | str) -> Column:
    """array<struct<number, unit>> of a text's values that have the asked unit ("": any), each once, in the order of the
    four ways to write them: range of digits, digits, range of numerals, numerals. Six in the afternoon is 18."""
    text = F.coalesce(_c(text), F.lit(""))
    unit = F.coalesce(_c(unit), F.lit(""))
    numerals = F.create_map(*[F.lit(x) for pair in NUMERALS.items() for x in (pair[0], float(pair[1]))])
    of_word = lambda x: F.element_at(numerals, x)
    of_digits = lambda x: x.cast("double")
    asked, hours = unit != "", unit == "点"
    fits = lambda u: ~asked | F.contains(u, unit)
    short = lambda u: F.when(asked, unit).otherwise(F.substring(u, 1, 1))
    pair = lambda n, u: F.struct(plain_number(n).alias("number"), u.alias("unit"))
    late = lambda n: F.when(hours & (n == 6) & any_of(text, EVENING), F.lit(18.0)).otherwise(n)
    all_of = lambda pattern: F.regexp_extract_all(text, F.lit(pattern), 0)

    def parts(pattern: str, *names: str) -> Column:
        """The groups of each match, cut out once: what reads them several times reads fields."""
        return F.transform(all_of(pattern), lambda x: F.struct(*[F.regexp_extract(x, pattern, i).alias(name) for i, name in enumerate(names, 1)]))

    def ranges(pattern: str, value) -> Column:
        held = F.filter(parts(pattern, "low", "high", "unit"), lambda x: fits(x["unit"]))
        return F.flatten(F.transform(held, lambda x: F.array(pair(value(x["low"]), short(x["unit"])), pair(value(x["high"]), short(x["unit"])))))

    def single(x: Column) -> Column:
        number, raw = x["number"], x["unit"]
        own = F.when(F.contains(raw, F.lit(":")), F.lit("点")).otherwise(raw)
        bare = (own == "") & (compact(text) == number)
        near_hour = hours & (number.isin("18", "6") | F.contains(text, F.lit(":")))
        known = F.when(~asked | (own == unit), own).when(bare, unit).when(near_hour, own)
        shown = F.when(known == "", unit).otherwise(known)
        return F.when(known.isNotNull(), pair(late(of_digits(number)), shown))

    words = F.filter(parts(_WORD_SINGLE, "number", "unit"), lambda x: fits(x["unit"]))
    words = F.transform(words, lambda x: pair(late(of_word(x["number"])), short(x["unit"])))
    six = F.when(hours & any_of(text, SIX), F.struct(F.lit("18").alias("number"), F.lit("点").alias("unit")))
    singles = F.array_compact(F.transform(parts(_SINGLE, "number", "unit"), single))
    return F.array_distinct(F.concat(ranges(_RANGE, of_digits), singles, ranges(_WORD_RANGE, of_word), words, F.array_compact(F.array(six))))


def fact_profile(text: Column | str, unit: Column | str = "") -> Column:
    """struct<unit, numbers, days>: what of a text can be compared, by the asked unit or the text's own."""
    text, unit = _c(text), F.lit("") if isinstance(unit, str) and not unit else _c(unit)
    own = F.when(unit != "", unit).otherwise(unit_of(text))
    made = lambda u: F.struct(u.alias("unit"), F.transform(number_units(text, u), lambda x: x["number"]).alias("numbers"), day_words(text).alias("days"))
    # The unit is worked out once, not at each of its uses.
    return F.get(F.transform(F.array(own), made), F.lit(0))


def may_assert(anchors: Column, expected: Column, text: Column) -> Column:
    """What ``asserts_fact`` and a comparison ask of a text that can be told without its numbers; the costly part is these."""
    named = (F.size(anchors) == 0) | F.exists(anchors, lambda a: F.contains(text, a))
    numeral = "[" + "".join(sorted({c for word in NUMERALS for c in word})) + "]"
    days = F.size(day_words(text)) > 0
    return ~any_of(text, DENIED) & F.when(F.size(expected["numbers"]) == 0, days & named).otherwise(text.rlike(r"(?U)\d|" + numeral) | any_of(text, SIX))


def asked_profile(expected: Column, text: Column) -> Column:
    """The ``fact_profile`` of a text for a comparison: without numbers where none are expected, as they decide nothing there."""
    bare = F.struct(expected["unit"].alias("unit"), F.array().cast("array<string>").alias("numbers"), day_words(text).alias("days"))
    return F.when(F.size(expected["numbers"]) == 0, bare).otherwise(fact_profile(text, expected["unit"]))


def comparable(profile: Column) -> Column:
    return (F.size(profile["numbers"]) > 0) | (F.size(profile["days"]) > 0)


def compare_profiles(expected: Column, actual: Column) -> Column:
    """conflict, support or unknown."""
    distinct = lambda p: F.array_distinct(p["numbers"])
    return compare_facts(expected["days"], distinct(expected), actual["days"], distinct(actual))


def slot_anchors(text: Column | str) -> Column:
    """Up to four parts of two to eight characters that are left of a fact without numbers, days and particles."""
    out = F.regexp_replace(F.regexp_replace(compact(text), r"\d+(?:\.\d+)?", " "), "[一二三四五六七八九十百千万两]+", " ")
    for words in (DAY_PARTS, PARTICLES):
        for word in sorted(words, key=lambda x: -len(x)):
            out = F.replace(out, F.lit(word), F.lit(" "))
    parts = F.filter(F.split(out, r"[\s，,。；;：:/、()（）\[\]{}]+"), lambda x: F.length(x).between(2, 8))
    return F.slice(F.array_distinct(parts), 1, 4)


def asserts_fact(anchors: Column, expected: Column, actual_text: Column, actual: Column) -> Column:
    """Whether a text with these values states the expected fact's slot (``slot_anchors`` of its text), and not only names or denies a value."""
    named = (F.size(anchors) == 0) | F.exists(anchors, lambda a: F.contains(actual_text, a))
    only_days = (F.size(expected["numbers"]) == 0) & (F.size(expected["days"]) > 0) & (F.size(actual["days"]) > 0)
    counted = (F.size(expected["numbers"]) == 0) | (F.size(actual["numbers"]) > 0)
    return comparable(actual) & counted & ~any_of(actual_text, DENIED) & (~only_days | named)


def general_slot(term: Column) -> Column:
    """Whether an anchor names only a general slot, such as a time or a state."""
    a = compact(term)
    return (F.length(a) <= 2) | a.isin(*GENERAL_SLOTS) | a.rlike("(?:" + "|".join(GENERAL_ENDS) + ")$")


def slot_applies(anchors: Column, condition: Column, trunk: Column, text: Column) -> Column:
    """Whether a value belongs to the slot of these anchors; ``trunk``: whether the text names the fact's object."""
    own = F.filter(F.transform(F.coalesce(anchors, F.array().cast("array<string>")), lambda a: F.trim(a)), lambda a: a != "")
    special = F.filter(own, lambda a: ~general_slot(a))
    hits = F.size(F.filter(special, lambda a: anchor_hit(a, text)))
    some = F.exists(own, lambda a: anchor_hit(a, text))
    return (
        F.when(F.size(own) == 0, F.lit(True))
        .when(F.size(special) >= 2, (hits >= 2) | ((hits >= 1) & trunk))
        .when(F.size(special) == 1, (hits > 0) | trunk)
        .otherwise(some)
    )


def other_slot(item_text: Column, text: Column) -> Column:
    """Whether a text is about rewards, and the fact is not."""
    return any_of(text, REWARDS) & ~any_of(item_text, REWARDS)


def says_value_or_direction(text: Column, directions: tuple[str, ...]) -> Column:
    return comparable(fact_profile(text)) | any_of(text, directions)


def names_trunk(groups: Column, text: Column, directions: tuple[str, ...]) -> Column:
    """Whether a text names the object of a fact: of one of the groups (array of main elements, each
    struct<terms, general>) all elements, a special one among them, or beside a value or a direction
    a special one by its first two characters."""
    b = compact(text)
    strict = lambda e: F.exists(e["terms"], lambda t: strict_hit(t, text))
    short = lambda e: F.exists(e["terms"], lambda t: strict_hit(t, text) | ((F.length(compact(t)) >= 4) & F.contains(b, F.substring(compact(t), 1, 2))))
    whole = F.exists(groups, lambda g: (F.size(g) > 0) & F.forall(g, strict) & F.exists(g, lambda e: strict(e) & ~e["general"]))
    near = F.exists(groups, lambda g: F.exists(g, lambda e: ~e["general"] & short(e)))
    return whole | (near & says_value_or_direction(text, directions))


def continues_value(allowed: Column, blockers: Column, checks: Column, anchors: Column, text: Column) -> Column:
    """Whether a text only states the value of a fact that the scope selected: where the catalogue allows it, without a
    blocker, with a value to compare and a short term of the selector."""
    blocked = F.exists(F.coalesce(blockers, F.array().cast("array<string>")), lambda x: strict_hit(x, text))
    valued = F.exists(checks, lambda c: comparable(c["profile"]) & comparable(fact_profile(text, c["profile"]["unit"])))
    return F.coalesce(allowed, F.lit(False)) & ~blocked & valued & F.exists(anchors, lambda a: (a != "") & F.contains(text, a))
