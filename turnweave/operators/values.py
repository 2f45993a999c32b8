"""Facts whose values can be compared, denied facts, and facts whose object an earlier turn names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.functions import facts as ff
from turnweave.functions.numbers import DAYS
from turnweave.functions.text import any_of, compact, form, text_hit
from turnweave.operators.judges import DIRECTIONS, HIGH_LOW
from turnweave.operators.term_index import Term, mark_terms
from turnweave.plans.catalogue import term_forms
from turnweave.plans.local import local_table

#: All words of directions.
DIRECTION_WORDS = tuple(dict.fromkeys(word for wanted, opposite, _ in DIRECTIONS for word in (*wanted, *opposite)))
# Words of a denied fact, and terms that alone say nothing of a fact.
TURNED = ("不适合", "不推荐", "不建议", "无关", "不影响", "没有帮助", "没帮助", "未生效", "未显示", "没有显示")
EMPTY_FACTS = ("不", "没", "少", "会", "能")

#: A fact with values: its selector's groups of main elements and short terms, and what is expected.
VALUE_FACT = (
    "fact_id string, item_text string, groups array<array<struct<terms:array<string>,general:boolean>>>, short_terms array<string>, "
    "checks array<struct<expected:string,unit:string,anchors:array<string>,condition:string>>, allowed boolean, blockers array<string>"
)


def fact_words(facts: DataFrame) -> tuple[list[tuple[str, Term]], list[str]]:
    """(fact_id, word) of what a span has to hold to speak of a fact of ``VALUE_FACT``, and the facts that any value may speak of.

    Beside a value, the first two characters of a special term name a fact's object; where it is allowed, a short term does.
    """
    words, any_value = [], []
    for f in facts.collect():
        special = [t for g in f.groups for e in g if not e.general for t in e.terms]
        forms = [term_forms(t) for t in special]
        words += [(f.fact_id, Term(a[:2] if len(a) >= 4 else a, rest, (), True)) for a, rest in forms if a]
        if f.allowed:
            words += [(f.fact_id, Term(a, "", (), True)) for a, _ in map(term_forms, f.short_terms) if a]
        if not f.groups:
            any_value.append(f.fact_id)
    return words, any_value


def direction_words(facts: DataFrame) -> list[tuple[str, Term]]:
    """(fact_id, word) of what a span has to hold to turn a fact (fact_id, subjects, expected) round: for high and low one of its
    subjects, otherwise a word of the other direction."""
    words = []
    for f in facts.collect():
        named = [t for t in f.subjects or [] if len(t) >= 3]
        for wanted, opposite, label in DIRECTIONS:
            if any(w in t for t in f.expected or [] for w in wanted):
                words += [(f.fact_id, Term(term_forms(t)[0], "", (), True)) for t in (named if label == HIGH_LOW and named else opposite)]
    return words


def spans_of_facts(spans: DataFrame, words: list[tuple[str, Term]], any_value: list[str] = ()) -> DataFrame:
    """``spans`` (with text) and the fact_id of each fact of which a span has a word; one pass over a span finds the words of all facts.

    Facts without an object of their own (``any_value``) meet the spans that have a value: each of these is a comparison asked for.
    """
    names = F.broadcast(local_table(spans.sparkSession, [(i, fact) for i, (fact, _) in enumerate(words)], "mark int, fact_id string"))
    marked = mark_terms(spans.withColumn("form", form("text")), [t for _, t in words])
    found = marked.withColumn("mark", F.explode("marks")).drop("marks").join(names, "mark").drop("mark").distinct()
    if any_value:
        # A digit, a numeral or a day: all that a value can be made of.
        valued = spans.where(F.col("text").rlike(r"(?U)\d|[" + "".join(sorted({c for w in (*ff.NUMERALS, *(w for words in DAYS.values() for w in words)) for c in w})) + "]"))
        found = found.unionByName(valued.withColumn("fact_id", F.explode(F.array(*map(F.lit, any_value))))).distinct()
    return found


def with_profiles(facts: DataFrame) -> DataFrame:
    """``facts`` whose checks have the profile of what they expect, parsed here, once a fact."""
    profiled = F.transform("checks", lambda c: F.struct(c["expected"].alias("expected"), c["anchors"].alias("anchors"), c["condition"].alias("condition"), ff.fact_profile(c["expected"], c["unit"]).alias("profile"), ff.slot_anchors(c["expected"]).alias("slots")))
    made = facts.withColumn("checks", profiled)
    return local_table(facts.sparkSession, made.collect(), made.schema)


def value_results(spans: DataFrame, facts: DataFrame) -> DataFrame:
    """(dialogue, fact, turn_index, seq, check_ord, result) of spans that state a value of a fact: conflict or support.

    ``spans``: dialogue_id, turn_index, seq, text and, where a selector chose them, fact_id; without it a span meets the facts of
    which it has a word. ``facts``: ``VALUE_FACT``, metadata that is broadcast; expected values are parsed once a fact.
    """
    met = spans if "fact_id" in spans.columns else spans_of_facts(spans, *fact_words(facts))
    rows = met.join(F.broadcast(with_profiles(facts)), "fact_id")
    text = F.col("text")
    trunk = (F.size("groups") == 0) | ff.names_trunk(F.col("groups"), text, DIRECTION_WORDS)
    rows = rows.withColumn("trunk", trunk)
    bound = F.col("trunk") | ff.continues_value(F.col("allowed"), F.col("blockers"), F.col("checks"), F.col("short_terms"), text)
    rows = rows.where(bound & ~ff.other_slot(F.col("item_text"), text))
    each = rows.select("dialogue_id", "fact_id", "turn_index", "seq", "text", "trunk", F.posexplode("checks").alias("check_ord", "check"))
    check = F.col("check")
    each = each.where(ff.comparable(check["profile"]) & ff.slot_applies(check["anchors"], check["condition"], F.col("trunk"), text))
    # A text's profile is the costly part. It is made once a row: a filter on it would be given a copy of all that makes it, and so would the
    # inner form of the explode.
    each = each.where(ff.may_assert(check["slots"], check["profile"], text))
    actual = F.array(ff.asked_profile(check["profile"], text))
    told = F.transform(actual, lambda a: F.when(ff.asserts_fact(check["slots"], check["profile"], text, a), ff.compare_profiles(check["profile"], a)))
    return each.select("dialogue_id", "fact_id", "turn_index", "seq", "check_ord", F.explode_outer(told).alias("result")).where("result <> 'unknown'")


def first_value(results: DataFrame, order: tuple[str, ...] = ("turn_index", "seq", "check_ord")) -> DataFrame:
    """(dialogue, fact, value, value_turn, value_seq): the first conflict by ``order``, otherwise the first support."""
    rank = F.struct(F.when(F.col("result") == "conflict", 0).otherwise(1).alias("rank"), *order)
    best = results.groupBy("dialogue_id", "fact_id").agg(F.min_by(F.struct("result", "turn_index", "seq"), rank).alias("b"))
    return best.select("dialogue_id", "fact_id", F.col("b.result").alias("value"), F.col("b.turn_index").alias("value_turn"), F.col("b.seq").alias("value_seq"))


def negation_probe(positive: Column, positive_text: Column, positive_denies: Column, any_denies: Column) -> Column:
    """The verdict of the wrong side of a fact without one: its correct side's span denies it, or a span near it denies something."""
    found = positive.isin("hit", "review")
    return F.when(found & positive_denies, F.when(any_of(F.coalesce(positive_text, F.lit("")), TURNED), F.lit("hit")).otherwise(F.lit("review"))).when(found & any_denies, F.lit("review")).otherwise(F.lit("miss"))


def carried_sides(spans: DataFrame, groups: DataFrame) -> DataFrame:
    """(dialogue, rule_id, turn_index, seq, score): spans that state a fact whose object the scope's other spans name.

    ``spans``: dialogue_id, rule_id, turn_index, seq, text: the scope that the rule's selector chose. ``groups`` (metadata): rule_id,
    mains and facts (arrays of arrays of terms) of the groups that allow it.
    """
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn_index", "seq", "text"))), lambda x: x["text"]), " ")
    scope = spans.groupBy("dialogue_id", "rule_id").agg(joined.alias("scope"))
    known = F.broadcast(groups.where((F.size("mains") > 0) & (F.size("facts") > 0)))
    named = scope.join(known, "rule_id").where(F.forall("mains", lambda terms: F.exists(terms, lambda t: (t != "") & text_hit(t, F.col("scope")))))
    rows = spans.where(~any_of(F.col("text"), ff.DENIED)).join(named.drop("scope"), ["dialogue_id", "rule_id"])
    telling = lambda t: (F.length(compact(t)) >= 2) & ~compact(t).isin(*EMPTY_FACTS)
    hits = F.size(F.filter("facts", lambda terms: F.exists(terms, lambda t: telling(t) & text_hit(t, F.col("text")))))
    rows = rows.withColumn("hits", hits).where("hits > 0")
    score = F.least(F.lit(1.0), 0.72 + 0.2 * F.col("hits") / F.size("facts"))
    best = rows.withColumn("score", score).groupBy("dialogue_id", "rule_id").agg(F.max_by(F.struct("turn_index", "seq", "score"), F.struct("score", -F.col("turn_index"), -F.col("seq"))).alias("b"))
    return best.select("dialogue_id", "rule_id", "b.*")
