"""Turns cut into spans ("atoms"), general tags of spans, and which spans are evidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions.text import any_of, compact

# Where sentences and clauses end, and what is stripped from their ends.
SENTENCE_ENDS = r"[。！？!?；;\n]+"
CLAUSE_ENDS = r"[，,、]|然后|另外|还有|同时|接下来|那我|所以"
EDGES = " ，,、：:"

# Words of questions, negations and guarantees.
QUESTION = ("吗", "呢", "么", "是否", "是不是", "有没有", "能不能", "可不可以", "方便", "对吧", "是吧", "？", "?")
NEGATION = ("不", "不用", "不需要", "无需", "不必", "没有", "没", "不会", "不能", "无法", "没法", "不是", "并非", "不支持", "不包含", "不收取", "不产生", "不影响", "不生效", "不开放")
GUARANTEE = ("保证", "承诺", "确保", "一定", "肯定", "包", "绝对")
NO_GUARANTEE = ("不能保证", "不保证", "无法保证", "不能承诺", "不承诺", "无法承诺")
# Fixed values: (words, tags they give), looked for in the compact text.
TAGS = (
    (("确认", "核实", "请问", "是不是", "对吧", "是吧"), ("intent:confirm",)),
    (("本人", "接听", "负责人", "负责", "当前接听"), ("target:identity",)),
    (("方便", "有空", "没时间", "忙", "打扰", "时间"), ("target:availability",)),
    (("不方便", "没时间", "忙", "等会", "稍后"), ("context_state:unavailable",)),
    (("开车", "骑车", "开着车", "路上", "安全"), ("context_state:driving", "target:safety")),
    (("不是负责人", "不负责", "找负责人", "负责人不在"), ("context_state:not_responsible",)),
    (("不想", "算了", "不做", "拒绝", "不要"), ("context_state:refusing",)),
    (("不懂", "没懂", "什么意思", "为什么", "凭什么", "质疑"), ("context_state:confused", "intent:challenge")),
    (NEGATION, ("polarity:negation", "modality:negation", "intent:deny")),
    (GUARANTEE, ("modality:guarantee",)),
    ((*NO_GUARANTEE, "不可以", "不能"), ("intent:refuse",)),
    (("为准", "以系统", "以页面", "按规则", "平台规则", "规则"), ("target:rule",)),
    (("结果", "状态", "显示", "成功", "失败", "通过", "未通过", "可用", "不可用"), ("target:system_result",)),
    (("人工", "帮你改", "协调", "我帮您改", "后台改", "后台", "手动", "我给你", "我帮你", "帮你", "我来", "留住", "保留", "搞定", "安排", "优先", "抹掉", "清除"), ("target:manual_intervention",)),
    (("我给你", "我帮你", "帮你", "我来", "可以帮", "能帮", "给你安排", "给你留", "给你保", "我处理"), ("intent:claim",)),
    (("说明", "告知", "同步", "通知", "提醒", "介绍", "讲一下", "说一下"), ("intent:inform",)),
    (("您先别急", "理解", "抱歉", "不好意思", "辛苦"), ("intent:reassure",)),
    (("再确认", "再说一下", "方便说下", "具体"), ("intent:clarify",)),
    (("不打扰", "再联系", "稍后联系", "祝", "再见", "结束", "先这样"), ("intent:close",)),
    (("继续", "接着", "简单说", "说完", "先跟您说"), ("intent:continue_push", "target:business_process")),
)


def with_spans(turns: DataFrame) -> DataFrame:
    """``turns`` with spans: the whole text, then its sentences, cut into clauses where two clauses have two
    characters each, without repeats of a compact form.

    Each step is a column of its own, so that no lambda works out another's array again.
    """
    strip = lambda x: F.btrim(x, F.lit(EDGES))
    tight = lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", "")) >= 2
    raw = turns.withColumn("raw", F.trim(F.coalesce("text", F.lit(""))))
    parts = raw.withColumn("parts", F.filter(F.transform(F.split("raw", SENTENCE_ENDS), strip), lambda x: x != ""))
    cut = parts.withColumn("cut", F.transform("parts", lambda p: F.struct(p.alias("p"), F.filter(F.transform(F.split(p, CLAUSE_ENDS), strip), tight).alias("subs"))))
    pieces = F.flatten(F.transform("cut", lambda x: F.when(F.size(x["subs"]) <= 1, F.array(x["p"])).otherwise(x["subs"])))
    whole = cut.withColumn("whole", F.when(F.col("raw") == "", F.array().cast("array<string>")).otherwise(F.concat(F.array("raw"), pieces)))
    keyed = whole.withColumn("keys", F.transform("whole", compact))
    first = lambda x, i: (F.get("keys", i) != "") & (F.array_position("keys", F.get("keys", i)) == i + 1)
    return keyed.withColumn("spans", F.filter("whole", first)).drop("raw", "parts", "cut", "whole", "keys")


#: All tags of spans but those of speakers, which begin with ``SPEAKER``.
SPEAKER = "speaker_role:"
NAMED = ("form:question", "intent:ask", "intent:greet", *sorted({x for _, named in TAGS for x in named}), "intent:promise", "modality:certain")


def tags(text: Column, tight: Column, speaker: Column) -> Column:
    """General tags "type:value" of a span; ``tight``: its compact form."""
    raw = F.coalesce(text, F.lit(""))
    asked = any_of(raw, QUESTION)
    found = [F.concat(F.lit(SPEAKER), speaker), F.when(asked, "form:question"), F.when(asked, "intent:ask")]
    found.append(F.when(any_of(raw, ("您好", "你好", "早上好", "下午好")), "intent:greet"))
    for words, named in TAGS:
        held = any_of(tight, words)
        found += [F.when(held, name) for name in named]
    promised = any_of(tight, GUARANTEE) & ~any_of(tight, NO_GUARANTEE)
    found += [F.when(promised, "intent:promise"), F.when(promised, "modality:certain")]
    return F.array_distinct(F.array_compact(F.array(*found)))


def spread(turns: DataFrame) -> DataFrame:
    """``turns`` dealt evenly, those of a long dialogue too: cutting and matching are work per turn, and files may be few."""
    return turns.repartition("dialogue_id", "turn_index")


def atoms(turns: DataFrame) -> DataFrame:
    """(dialogue_id, turn_index, seq, speaker, text, compact, span_type, is_evidence) of every span.

    seq 0 is the whole turn. It is evidence only if its turn has no other span.
    """
    cut = with_spans(turns).select("dialogue_id", "turn_index", "speaker", "spans")
    alone = F.size("spans") == 1
    # The outer form: for the other, the optimizer would filter on the size of all that makes the spans.
    each = cut.select("dialogue_id", "turn_index", "speaker", alone.alias("alone"), F.posexplode_outer("spans").alias("seq", "text"))
    each = each.where("seq IS NOT NULL")
    return each.select(
        "dialogue_id",
        "turn_index",
        "seq",
        "speaker",
        "text",
        compact("text").alias("compact"),
        F.when(F.col("seq") == 0, "turn").otherwise("atom").alias("span_type"),
        ((F.col("seq") > 0) | F.col("alone")).alias("is_evidence"),
    )
