"""Text predicates and similarities as Column expressions; no Python runs per row."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Particles that may stand between the parts of an expression, in the order of their removal.
FILLERS = ("就会", "将会", "就能", "就可以", "可以", "能够", "会", "能", "将", "就", "了", "的")
# A term that holds one of these, or a digit, has to be met literally.
EXACT_MARKS = ("一", "二", "三", "四", "五", "六", "七", "八", "九", "十", "元", "点", "天", "单", "秒", "分钟", "小时", "%", "％")
# A term that holds one of these is never matched in parts.
MODAL_MARKS = ("不能", "不可以", "不会", "不得", "禁止", "保证", "承诺", "一定", "肯定")
# Words that make a term precise; so do digits and counted units.
PRECISE_WORDS = (
    "今天", "今日", "当天", "当日", "明天", "次日", "第二天", "前一天", "昨日", "昨天",
    "上午", "下午", "晚上", "中午", "午餐", "晚餐", "高峰", "18点", "18:00",
    "分钟", "小时", "%", "％",
    "较低", "更低", "便宜", "略高", "稍高", "更高",
    "生效", "未生效", "已生效", "显示", "未显示", "已显示", "适用", "不适用",
)
COUNTED = "[一二三四五六七八九十百千万两]+(?:点|时|秒|分钟|小时|天|日|单|元|块)"
MAX_GAP = 18
# Characters that a loosely met term and its text have in common, at least, and their share of the term's.
COMMON_LEAST, COMMON_SHARE = 4, 0.90


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether the text holds one of the words."""
    found = F.lit(False)
    for word in words:
        found = found | F.contains(text, F.lit(word))
    return found


def compact(text: Column | str) -> Column:
    """Lower case, without white space; null is empty."""
    return F.lower(F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"(?U)\s+", ""))


def without_fillers(text: Column | str) -> Column:
    out = compact(text)
    for word in FILLERS:
        out = F.replace(out, F.lit(word), F.lit(""))
    return out


def characters(text: Column) -> Column:
    """The set of a text's characters."""
    return F.array_distinct(F.filter(F.split(text, ""), lambda x: x != ""))


def form(text: Column | str) -> Column:
    """What ``form_hit`` needs of a text, made once: its compact form, and that without fillers."""
    return F.struct(compact(text).alias("tight"), without_fillers(text).alias("rest"))


def term_form(term: Column | str) -> Column:
    """What ``form_hit`` needs of a term: its form, its characters, and whether it has to be met literally."""
    a = compact(term)
    exact = a.rlike(r"(?U)\d") | any_of(a, EXACT_MARKS) | (F.length(a) < 5)
    return F.struct(a.alias("tight"), without_fillers(term).alias("rest"), characters(a).alias("chars"), exact.alias("exact"))


def form_hit(a: Column, b: Column) -> Column:
    """``text_hit`` of the forms of a term and a text."""
    literal = F.contains(b["tight"], a["tight"]) | ((a["rest"] != "") & F.contains(b["rest"], a["rest"]))
    own = F.size(a["chars"])
    common = F.size(F.filter(a["chars"], lambda x: F.contains(b["tight"], x)))
    loose = ~a["exact"] & (common >= COMMON_LEAST) & (common / own >= COMMON_SHARE)
    return (a["tight"] != "") & (b["tight"] != "") & (literal | loose)


def text_hit(term: Column | str, text: Column | str) -> Column:
    """Whether the text expresses the term: literally, but for fillers, or by nearly all of its characters."""
    return form_hit(term_form(term), form(text))


def strict_hit(term: Column | str, text: Column | str) -> Column:
    """Literally, or but for fillers."""
    a, b = compact(term), compact(text)
    a2, b2 = without_fillers(term), without_fillers(text)
    return (a != "") & (b != "") & (F.contains(b, a) | ((a2 != "") & F.contains(b2, a2)))


def ordered_hit(term: Column | str, text: Column | str) -> Column:
    """Whether the characters of a long term follow each other in the text, each the next one of its kind, in small gaps."""
    return tight_ordered_hit(compact(term), compact(text))


def tight_ordered_hit(a: Column, b: Column) -> Column:
    """``ordered_hit`` of compact forms."""

    def follow(s: Column, x: Column) -> Column:
        rest = F.substring(b, s["at"] + 1, F.length(b))
        found = F.position(x, rest)
        gap = found - 1
        ok = s["ok"] & (found > 0) & ((s["at"] == 0) | (gap <= MAX_GAP))
        return F.struct((s["at"] + found).cast("int").alias("at"), ok.alias("ok"))

    start = F.struct(F.lit(0).cast("int").alias("at"), F.lit(True).alias("ok"))
    walked = F.aggregate(F.filter(F.split(a, ""), lambda x: x != ""), start, follow)["ok"]
    fits = (a != "") & (b != "") & (F.length(a) >= 6) & ~a.rlike(r"(?U)\d") & ~any_of(a, MODAL_MARKS)
    return fits & walked


def object_hit(term: Column | str, text: Column | str) -> Column:
    """A term of four characters or more by its first two."""
    a, b = compact(term), compact(text)
    return (F.length(a) >= 4) & F.contains(b, F.substring(a, 1, 2))


def is_precise(terms: Column) -> Column:
    """Whether an array of terms names a number, a counted unit, a day or a state."""
    joined = compact(F.array_join(terms, " "))
    return joined.rlike(r"(?U)\d") | joined.rlike(COUNTED) | any_of(joined, PRECISE_WORDS)


def char_jaccard(a: Column | str, b: Column | str) -> Column:
    """Jaccard similarity of the two texts' characters; 0 if one is empty."""
    x, y = characters(compact(a)), characters(compact(b))
    both = F.size(F.array_union(x, y))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(x, y)) / both)


def char_overlap(a: Column | str, b: Column | str, of: str = "min", min_common: int = 1) -> Column:
    """Common characters by the smaller set ("min") or the first one ("first"); 0 below ``min_common``."""
    x, y = characters(compact(a)), characters(compact(b))
    common = F.size(F.array_intersect(x, y))
    size = F.least(F.size(x), F.size(y)) if of == "min" else F.size(x)
    return F.when((size > 0) & (common >= min_common), common / size).otherwise(F.lit(0.0))


def bigrams(text: Column | str) -> Column:
    """The set of neighbouring pairs of characters of the compact text."""

    def pairs(a: Column) -> Column:
        found = F.transform(F.sequence(F.lit(1), F.length(a) - 1), lambda i: F.substring(a, i, F.lit(2)))
        return F.when(F.length(a) >= 2, F.array_distinct(found)).otherwise(F.array().cast("array<string>"))

    # The compact text is worked out once, not once a pair.
    return F.get(F.transform(F.array(compact(text)), pairs), F.lit(0))


def overlap_coefficient(a: Column, b: Column) -> Column:
    """Common entries of two sets by the smaller one."""
    least = F.least(F.size(a), F.size(b))
    return F.when(least > 0, F.size(F.array_intersect(a, b)) / least).otherwise(F.lit(0.0))


def cosine_overlap(a: Column, b: Column) -> Column:
    """Common entries by the geometric mean of the sizes."""
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(a, b)) / F.sqrt(F.size(a).cast("double") * F.size(b))).otherwise(F.lit(0.0))


# Full-width forms and their plain ones, then marks that count as a space.
WIDE = "".join(chr(i) for i in range(0xFF01, 0xFF5F)) + "　"
PLAIN = "".join(chr(i) for i in range(0x21, 0x7F)) + " "
MARKS = "，。！？；：、,.!?;:()[]{}<>\"'“”‘’（）【】《》…—-_/\\|~·"


def normalize(text: Column | str) -> Column:
    """Plain forms of full-width characters, marks as spaces, single spaces, lower case."""
    plain = F.translate(F.coalesce(_c(text), F.lit("")), WIDE, PLAIN)
    spaced = F.translate(plain, MARKS, " " * len(MARKS))
    return F.lower(F.trim(F.regexp_replace(spaced, r"(?U)\s+", " ")))


def clip(text: Column | str, n: int, mark: str = "…") -> Column:
    text = _c(text)
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit(mark))).otherwise(text)


def rough_tokens(text: Column | str) -> Column:
    """An estimate of language-model tokens."""
    return (F.floor(F.length(F.coalesce(_c(text), F.lit(""))) / 1.6) + 1).cast("bigint")


def stable_id(kind: str, *parts: Column | str, digits: int = 10) -> Column:
    return F.concat(F.lit(f"{kind}_"), F.substring(F.sha1(F.concat_ws("|", *[_c(x) for x in parts])), 1, digits))


def dedupe_ordered(items: Column | str) -> Column:
    """The first of all entries with one compact form, in order, without empty ones."""
    kept = F.filter(F.transform(_c(items), lambda x: F.trim(x)), lambda x: x.isNotNull() & (compact(x) != ""))
    keys = F.transform(kept, compact)
    return F.filter(kept, lambda x, i: F.array_position(keys, F.get(keys, i)) == i + 1)
