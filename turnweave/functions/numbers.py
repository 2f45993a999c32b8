"""Numbers, ranges, units and day words in texts, and the comparison of two facts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from turnweave.functions.text import _c, any_of

# The units of numbers, and how a range is written.
UNITS = "元|块|点|天|日|单|秒|分钟|小时|%|％"
_RANGE = rf"(\d+(?:\.\d+)?)\s*(?:-|~|到|至)\s*(\d+(?:\.\d+)?)\s*({UNITS})?"
_SINGLE = rf"(\d+(?:\.\d+)?)\s*({UNITS})?"
# Words of days, by category.
DAYS = {
    "today": ("今天", "当天", "当日", "今日"),
    "next_day": ("次日", "第二天", "隔天", "明天"),
    "previous_day": ("前一天", "前日", "上一天", "前一日"),
    "immediate": ("立即", "马上", "立刻", "当场"),
}


def numbers(text: Column | str) -> Column:
    """array<struct<type, value, start, end, unit>>: first the ranges, then the numbers outside them."""
    text = F.coalesce(_c(text), F.lit(""))
    null = F.lit(None).cast("double")
    unit = lambda x, pattern, i: F.regexp_extract(x, pattern, i)
    ranges = F.transform(
        F.regexp_extract_all(text, F.lit(_RANGE), 0),
        lambda x: F.struct(
            F.lit("range").alias("type"),
            null.alias("value"),
            F.regexp_extract(x, _RANGE, 1).cast("double").alias("start"),
            F.regexp_extract(x, _RANGE, 2).cast("double").alias("end"),
            unit(x, _RANGE, 3).alias("unit"),
        ),
    )
    rest = F.regexp_replace(text, _RANGE, " ")
    singles = F.transform(
        F.regexp_extract_all(rest, F.lit(_SINGLE), 0),
        lambda x: F.struct(
            F.lit("number").alias("type"),
            F.regexp_extract(x, _SINGLE, 1).cast("double").alias("value"),
            null.alias("start"),
            null.alias("end"),
            unit(x, _SINGLE, 2).alias("unit"),
        ),
    )
    return F.concat(ranges, singles)


def number_in_range(found: Column, low: float, high: float, unit: str = "") -> Column:
    """Whether one of ``numbers`` lies in the range, a range with both of its ends."""
    fits = lambda v: (v >= low) & (v <= high)
    inside = lambda n: F.when(n["type"] == "range", fits(n["start"]) & fits(n["end"])).otherwise(fits(n["value"]))
    return F.exists(found, lambda n: inside(n) & (F.contains(n["unit"], F.lit(unit)) if unit else F.lit(True)))


def day_words(text: Column | str) -> Column:
    """The categories of days that a text names."""
    text = F.coalesce(_c(text), F.lit(""))
    return F.array_compact(F.array(*[F.when(any_of(text, words), F.lit(name)) for name, words in DAYS.items()]))


def fact_values(text: Column | str) -> Column:
    """The values of a text as strings, a range by both ends, without repeats."""
    flat = F.flatten(F.transform(numbers(text), lambda n: F.array_compact(F.array(n["value"], n["start"], n["end"]))))
    return F.array_distinct(F.transform(flat, lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")))


def compare_facts(expected_days: Column, expected: Column, actual_days: Column, actual: Column) -> Column:
    """conflict, support or unknown of two sets of day words and values."""
    both_days = (F.size(expected_days) > 0) & (F.size(actual_days) > 0)
    both = (F.size(expected) > 0) & (F.size(actual) > 0)
    within = (F.size(F.array_except(actual, expected)) == 0) | (F.size(F.array_except(expected, actual)) == 0)
    return (
        F.when(both_days & ~F.arrays_overlap(expected_days, actual_days), F.lit("conflict"))
        .when(both, F.when(within, F.lit("support")).otherwise(F.lit("conflict")))
        .when(both_days, F.lit("support"))
        .otherwise(F.lit("unknown"))
    )
