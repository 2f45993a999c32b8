"""Personal data in whole texts by weak supervision; DataFrame operations only.

**Base spans** follow fixed rules: email, ip, card and phone patterns, each leftmost and
non-overlapping in its kind, of which those that fail their check (parts of an address,
Luhn, numbers of digits) are dropped.

**The method** looks at more candidates: base spans, and looser ones of the same kinds (mail
addresses written with "(at)" or "(dot)", IPv6 addresses, card numbers of 13 to 15 digits,
phone numbers without a plus). Five labelers vote for, against or not at all: the shape
(regular expressions), the check (Luhn, parts, digits), a gazetteer (top-level domains, first
digits of cards, country codes), the words in front (context) and the neighbouring characters.
Expectation-maximisation over the counts of equal votes estimates, for each kind, the share of
true spans and what each labeler says of true and of false ones. Its posteriors are the soft
labels from which a final classifier of spans is fitted (naive Bayes over digits, separators,
length, first character, context and check). Loose candidates that it finds to be likelier
true than ``LEAST`` are added, as kinds ``weak_email`` to ``weak_phone``; base spans stay
whatever it says. Added spans share no character with base spans.

Everything that is counted is counted over all candidates of all texts, in one aggregation by
votes and features: both have few values, so that its rows are bounded whatever the input.
Each round of the estimation is one aggregation of these rows; only the parameters (a few
dozen numbers a kind) pass through the driver. Texts are read once, spans are stored.

Places are code points. They come from the lengths of what a split leaves between matches, in
blocks, so that a text's cost does not grow with the square of its matches. The patterns are
written without nested backtracking: a text of one endless run costs linear time.

Edge cases: a null or empty text has no spans; a null doc_id and repeated rows are rows like
others; a text without a candidate takes part in nothing; without any candidate the fixed
priors hold; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from turnweave.llm.common import stored

KINDS = ("email", "ip", "card", "phone")
WEAK = tuple(f"weak_{kind}" for kind in KINDS)

# The base patterns, with possessive repeats and a look behind: in each, a match that fails from
# the beginning of a run fails from its middle too, so that a search need not begin there.
_LOCAL, _LABEL = "A-Za-z0-9._%+-", "A-Za-z0-9-"
BASE = {
    "email": rf"(?:(?<![{_LOCAL}])|\G)[{_LOCAL}]++@[{_LABEL}]++(?:\.[{_LABEL}]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": rf"(?i)(?<![\p{{L}}{_LOCAL}])[{_LOCAL}]++(?: ?[(\[]at[)\]] ?| ?@ ?)[{_LABEL}]++(?:(?: ?[(\[]dot[)\]] ?|\.)[{_LABEL}]++)++(?![\p{{L}}\p{{N}}])",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "number": r"(?<![\p{L}\p{N}_@.#/+-])\(?[0-9](?:[ ().-]{0,2}[0-9])++(?![\p{L}\p{N}_@/])",
}
#: What a text has to have, if it has a match: cheaper to look for.
_HINT = {"email": r"@|(?i)[(\[]at[)\]]", "ip": r"[0-9]\.[0-9]", "card": r"[0-9][\x20-]?[0-9]", "phone": r"\+[0-9]"}

# What the gazetteer and the context labelers know.
DOMAINS = ("com", "org", "net", "edu", "gov", "info", "io", "de", "fr", "es", "it", "nl", "eu", "uk", "ch", "at", "us")
ISSUERS = r"^(4|5[1-5]|2[2-7]|3[47]|30[0-5]|3[689]|6011|65|64[4-9]|62|35)"
COUNTRIES = r"^\+(1|7|20|27|3[0-9]|4[0-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])"
FOR_WORDS = {
    "email": r"mail|contact|write|reach|correo|courriel|kontakt",
    "ip": r"\bip\b|address|host|server|from|client|adresse|dirección",
    "card": r"card|visa|master|credit|debit|amex|karte|carte|tarjeta|kreditkarte",
    "phone": r"tel|phone|call|mobile|cell|fax|whatsapp|sms|rufnummer|llame|appele",
}
AGAINST_WORDS = {
    "email": r"example of|syntax|pattern",
    "ip": r"version|release|section|chapter|\bv$|§",
    "card": r"isbn|order|serial|invoice|\bid\b|token|hash|sha|ticket|\bno\b|nr",
    "phone": r"isbn|order|serial|invoice|\bid\b|token|hash|sha|ticket|date|page|total|sum|price|year|[$€£]",
}

#: Votes: not at all, for, against.
NONE, YES, NO = 0, 1, 2
LABELERS = ("shape", "check", "gazetteer", "context", "edges")
FEATURES = ("digits", "gaps", "length", "first", "context", "check")
#: Pseudo-counts: spans of each kind, true and false; votes of a labeler that is right, and that is wrong, of the said.
PRIOR, RIGHT, WRONG, SILENT = 2.0, 6.0, 2.0, 4.0
ROUNDS, LEAST = 12, 0.9
#: Code points in front of a span that the context labeler reads; matches that are added up at a time.
CONTEXT, BLOCK = 32, 128


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.get(F.transform(F.array(value), then), 0)


def _running(values: Column, zero: Column, combine: Callable[[Column, Column], Column]) -> Column:
    """For each place of an array what the values before it combine to; of blocks first, so that long arrays stay cheap."""

    def total(part: Column) -> Column:
        return F.aggregate(part, zero, combine)

    def of(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda b: total(F.slice(v, b * BLOCK + 1, BLOCK)))
        before = lambda sums: F.transform(sums, lambda _, b: total(F.slice(sums, F.lit(1), b)))
        here = lambda done: F.transform(v, lambda _, i: combine(F.get(done, F.floor(i / BLOCK).cast("int")), total(F.slice(v, F.floor(i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK))))
        return _let(_let(blocks, before), here)

    return _let(values, lambda v: F.when(F.size(v) > 0, of(v)).otherwise(F.slice(v, 1, 0)))


def matches(text: Column, pattern: str, hint: str | None = None) -> Column:
    """Array of (start, end, value, before, after) of a pattern's matches; before and after: what stands beside it.

    ``text`` is not null; ``hint``: a pattern that every text with a match has.
    """
    kind = "array<struct<start: int, end: int, value: string, before: string, after: string>>"

    def spans(s: Column) -> Column:
        gaps, hits = s["gaps"], s["hits"]
        both = F.zip_with(hits, F.slice(gaps, F.lit(1), F.size(hits)), lambda h, g: F.length(h) + F.length(g))
        return _let(_running(both, F.lit(0), lambda a, b: a + b), lambda at: F.transform(hits, lambda h, i: span(h, F.get(gaps, i), F.get(gaps, i + 1), F.get(at, i))))

    def span(hit: Column, gap: Column, following: Column, at: Column) -> Column:
        start = at + F.length(gap)
        beside = F.substring(gap, -CONTEXT, CONTEXT).alias("before"), F.substring(following, 1, 1).alias("after")
        return F.struct(start.alias("start"), (start + F.length(hit)).alias("end"), hit.alias("value"), *beside)

    found = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"))
    here = _let(found, lambda s: F.when(F.size(s["hits"]) > 0, spans(s)))
    return F.coalesce(F.when(text.rlike(hint or pattern), here), F.array()).cast(kind)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def _parts_fit(value: Column) -> Column:
    """No part of an address is above 255."""
    return F.forall(F.split(value, r"\."), lambda x: _let(F.regexp_replace(x, "^0+", ""), lambda y: (F.length(y) < 3) | ((F.length(y) == 3) & (y <= "255"))))


def _holds(kind: str, value: Column) -> Column:
    """Whether a match of a base pattern passes its check."""
    if kind == "ip":
        return _parts_fit(value)
    if kind == "card":
        return _let(_digits(value), lambda d: F.length(d).between(16, 19) & _luhn(d))
    if kind == "phone":
        return F.length(_digits(value)).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    return F.filter(matches(text, BASE[kind], _HINT[kind]), lambda c: _holds(kind, c["value"]))


def _either(yes: Column, no: Column) -> Column:
    """The vote of two conditions; where both or none hold, none."""
    return F.when(yes & ~no, YES).when(no & ~yes, NO).otherwise(NONE)


def _votes(kind: str, c: Column) -> dict[str, Column]:
    """What each labeler says of a candidate."""
    value, before, after = c["value"], F.lower(c["before"]), c["after"]
    digits = _digits(value)
    n = F.length(digits)
    if kind == "email":
        last = F.lower(F.regexp_extract(value, r"([A-Za-z0-9-]+)$", 1))
        shape = _either(value.rlike(r"(?i)^[A-Z0-9][A-Z0-9._%+-]*@[^@\s]+$|[(\[](at|dot)[)\]]"), value.rlike(r"^[.%+-]|\.\.|[.]@| @ "))
        check = _either(last.rlike("^[a-z]{2,24}$"), ~last.rlike("^[a-z]{2,24}$"))
        gazetteer = _either(last.isin(*DOMAINS), F.lit(False))
    elif kind == "ip":
        four = value.contains(".")
        shape = _either(value.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") | ~four, value.rlike(r"(^|\.)0[0-9]"))
        check = _either(_parts_fit(value) | ~four, F.lit(False))
        gazetteer = _either(value.rlike(r"^(10|127|192\.168|172\.(1[6-9]|2[0-9]|3[01]))\.|^(fe80|fd|20)"), value.rlike(r"^(0|255)\.|^[1-9]\.[0-9]\.[0-9]\.[0-9]$"))
    elif kind == "card":
        shape = _either(value.rlike(r"^[0-9]+$|^([0-9]{4}[ -]){3}[0-9]{4}$|^[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}$"), value.rlike(r"[.()]| .*-|-.* |^0"))
        check = _either(_luhn(digits), ~_luhn(digits))
        gazetteer = _either(digits.rlike(ISSUERS), ~digits.rlike(ISSUERS))
    else:
        shape = _either(value.rlike(r"^\+[0-9]|^\([0-9]{2,4}\) ?[0-9]|^00[1-9]|^[0-9]{3}[-. ][0-9]{3}[-. ][0-9]{4}$"), value.rlike(r"^(19|20)[0-9]{2}[-.][01]?[0-9][-.]|^[0-3]?[0-9][-.][01]?[0-9][-.]([0-9]{2}|[0-9]{4})$|^[0-9]+(\.[0-9]+)?$| [0-9] "))
        check = _either(n.between(10, 15), (n < 7) | (n > 15))
        gazetteer = _either(value.rlike(COUNTRIES), value.startswith("+") & ~value.rlike(COUNTRIES))
    context = _either(before.rlike(f"({FOR_WORDS[kind]})[^\n]*$"), before.rlike(f"({AGAINST_WORDS[kind]})[^\n]*$"))
    glued = before.rlike(r"[\p{L}\p{N}_/#=]$") | after.rlike(r"^[\p{L}\p{N}_/@]")
    return {"shape": shape, "check": check, "gazetteer": gazetteer, "context": context, "edges": _either(~glued, glued)}


def _features(c: Column) -> dict[str, Column]:
    """What the final classifier sees beside context and check; few values each."""
    value = c["value"]
    first = F.when(value.rlike(r"^\+"), 1).when(value.rlike(r"^\("), 2).when(value.rlike("^0"), 3).when(value.rlike("^[0-9]"), 4).otherwise(0)
    return {
        "digits": F.least(F.length(_digits(value)), F.lit(20)),
        "gaps": F.least(F.length(F.regexp_replace(value, r"[^ ().@:\[\]-]", "")), F.lit(9)),
        "length": F.least(F.floor(F.length(value) / 4), F.lit(10)).cast("int"),
        "first": first,
    }


def _voted(kind: str, spans: Column) -> Column:
    """Spans with votes and features."""
    return F.transform(spans, lambda c: F.struct(F.lit(kind).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), *[v.cast("int").alias(k) for k, v in (_votes(kind, c) | _features(c)).items()]))


def _apart(base: Column, loose: Column) -> Column:
    """The loose spans that share no character with a base span."""
    event = "array<struct<start: int, end: int, base: boolean, span: struct<{}>>>"
    fields = "kind: string, start: int, end: int, " + ", ".join(f"{x}: int" for x in (*LABELERS, "digits", "gaps", "length", "first"))

    def events(spans: Column, is_base: bool) -> Column:
        return F.transform(spans, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), F.lit(is_base).alias("base"), c.alias("span"))).cast(event.format(fields))

    def free(line: Column) -> Column:
        ends = _running(F.transform(line, lambda e: F.when(e["base"], e["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
        far = F.lit(2**31 - 1)
        nexts = F.reverse(_running(F.reverse(F.transform(line, lambda e: F.when(e["base"], e["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
        marked = F.zip_with(F.zip_with(line, ends, lambda e, end: F.struct(e.alias("e"), end.alias("end"))), nexts, lambda x, start: F.struct(x["e"].alias("e"), (~x["e"]["base"] & (x["end"] <= x["e"]["start"]) & (start >= x["e"]["end"])).alias("ok")))
        return F.transform(F.filter(marked, lambda x: x["ok"]), lambda x: x["e"]["span"])

    return F.when(F.size(base) == 0, loose).when(F.size(loose) == 0, loose).otherwise(_let(F.array_sort(F.concat(events(base, True), events(loose, False))), free))


def candidates(documents: DataFrame) -> DataFrame:
    """doc_id, base and loose: arrays of spans (kind, start, end, votes, features) of every whole text."""
    text = F.col("_text")
    rows = documents.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    base = F.concat(*[_voted(kind, base_spans(text, kind)) for kind in KINDS])
    n = lambda c: F.length(_digits(c["value"]))
    numbers = lambda low, high: F.filter(F.col("_numbers"), lambda c: n(c).between(low, high))
    rows = rows.withColumn("_numbers", matches(text, LOOSE["number"], r"[0-9][ ().-]{0,2}[0-9]")).withColumn("base", base)
    loose = F.concat(
        _voted("email", matches(text, LOOSE["email"], _HINT["email"])),
        _voted("ip", matches(text, LOOSE["ip"], "[0-9A-Fa-f]:[0-9A-Fa-f]")),
        _voted("card", numbers(13, 19)),
        _voted("phone", numbers(7, 12)),
    )
    return rows.withColumn("_loose", loose).select("doc_id", "base", _apart(F.col("base"), F.col("_loose")).alias("loose"))


def _start() -> dict:
    """The parameters before anything was seen: by kind the share of true spans, and of each labeler the votes on true and false ones."""
    right = {YES: RIGHT, NO: WRONG, NONE: SILENT}
    wrong = {YES: WRONG, NO: RIGHT, NONE: SILENT}
    share = lambda of: {v: x / sum(of.values()) for v, x in of.items()}
    return {kind: (0.5, {x: (share(right), share(wrong)) for x in LABELERS}) for kind in KINDS}


def _log_odds(prior: float, tables: dict, value: Callable[[str], Column]) -> Column:
    """The log odds of a span being true: of the prior, and of each value by its two tables of shares."""
    out = F.lit(math.log(prior / (1 - prior)))
    for name, (true, false) in tables.items():
        ratios = [math.log(true[v] / false[v]) for v in sorted(true)]
        out = out + F.element_at(F.array(*[F.lit(x) for x in ratios]), value(name) + 1)
    return out


def _probability(params: dict, kind: Column, value: Callable[[str], Column]) -> Column:
    odds = F.lit(0.0)
    for name, (prior, tables) in params.items():
        odds = F.when(kind == name, _log_odds(prior, tables, value)).otherwise(odds)
    return 1 / (1 + F.exp(-odds))


def _counted(patterns: DataFrame, params: dict, names: tuple[str, ...], sizes: dict[str, int]) -> dict:
    """By kind: the weight of true and of false spans, and of each value of each name, by the posteriors of ``params``."""
    p = _probability(params, F.col("kind"), F.col)
    weighed = patterns.select("kind", *sorted({*names}), (F.col("n") * p).alias("_true"), (F.col("n") * (1 - p)).alias("_false"))
    sums = [F.sum("_true").alias("true"), F.sum("_false").alias("false")]
    for x in names:
        for v in range(sizes[x]):
            sums += [F.sum(F.when(F.col(x) == v, F.col(w)).otherwise(0.0)).alias(f"{x}_{v}{w}") for w in ("_true", "_false")]
    return {r.kind: r.asDict() for r in weighed.groupBy("kind").agg(*sums).collect()}


def estimate(patterns: DataFrame, rounds: int = ROUNDS) -> dict:
    """Reliabilities by expectation-maximisation over ``patterns`` (kind, a column a labeler, n: spans that got these votes)."""
    first = _start()
    params, sizes = first, dict.fromkeys(LABELERS, 3)
    for _ in range(rounds):
        seen = _counted(patterns, params, LABELERS, sizes)
        params = {}
        for kind in KINDS:
            got = seen.get(kind, {})
            true, false = got.get("true", 0.0), got.get("false", 0.0)
            tables = {}
            for x in LABELERS:
                both = []
                for side, weight in (("_true", true), ("_false", false)):
                    fixed = first[kind][1][x][0 if side == "_true" else 1]
                    pseudo = RIGHT + WRONG + SILENT
                    both.append({v: (got.get(f"{x}_{v}{side}", 0.0) + pseudo * fixed[v]) / (weight + pseudo) for v in range(3)})
                tables[x] = tuple(both)
            params[kind] = ((true + PRIOR) / (true + false + 2 * PRIOR), tables)
    return params


def fit_classifier(patterns: DataFrame, reliabilities: dict) -> dict:
    """Naive Bayes over the features of spans, from the posteriors of their votes as soft labels."""
    sizes = {"digits": 21, "gaps": 10, "length": 11, "first": 5, "context": 3, "check": 3}
    seen = _counted(patterns, reliabilities, FEATURES, sizes)
    params = {}
    for kind in KINDS:
        got = seen.get(kind, {})
        true, false = got.get("true", 0.0), got.get("false", 0.0)
        tables = {}
        for x in FEATURES:
            shares = lambda side, weight, x=x, got=got: {v: (got.get(f"{x}_{v}{side}", 0.0) + 1) / (weight + sizes[x]) for v in range(sizes[x])}
            tables[x] = (shares("_true", true), shares("_false", false))
        params[kind] = ((true + PRIOR) / (true + false + 2 * PRIOR), tables)
    return params


def vote_patterns(found: DataFrame) -> DataFrame:
    """How many candidates have the same kind, votes and features; few rows, stored."""
    names = list(dict.fromkeys((*LABELERS, *FEATURES)))
    each = found.select(F.explode(F.concat("base", "loose")).alias("c")).select("c.kind", *[f"c.{x}" for x in names])
    return stored(each.groupBy("kind", *names).agg(F.count("*").alias("n")))


def find_spans(documents: DataFrame, least: float = LEAST) -> DataFrame:
    """doc_id and spans: array of (kind, start, end, probability, base) of every whole text, by kind, then start.

    ``probability`` is the classifier's; base spans are there whatever it is.
    """
    found = stored(candidates(documents))
    patterns = vote_patterns(found)
    classifier = fit_classifier(patterns, estimate(patterns))

    def judged(spans: Column, base: bool) -> Column:
        name = (lambda c: c["kind"]) if base else (lambda c: F.concat(F.lit("weak_"), c["kind"]))
        fields = lambda c: F.struct(name(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), _probability(classifier, c["kind"], lambda x: c[x]).alias("probability"), F.lit(base).alias("base"))
        return F.transform(spans, fields)

    # Spans are in order of kind already, and of start in a kind of one pattern; sorting by the two fields keeps what equals.
    place = lambda c: F.array_position(F.array(*[F.lit(x) for x in (*KINDS, *WEAK)]), c["kind"])
    keyed = lambda spans: F.transform(spans, lambda c: F.struct(place(c).alias("place"), c["start"].alias("start"), c.alias("c")))
    kept = F.filter(judged(F.col("loose"), False), lambda c: c["probability"] >= least)
    whole = F.transform(F.array_sort(keyed(F.concat(judged(F.col("base"), True), kept))), lambda x: x["c"])
    return found.select("doc_id", whole.alias("spans"))


def listed(spans: Column) -> Column:
    """Spans as text: kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(":", c["kind"], c["start"], c["end"])), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span (in order of start, without overlaps) replaced by its kind in brackets."""
    starts = F.transform(spans, lambda c: c["start"])
    before = F.transform(spans, lambda c, i: F.concat(F.substring(text, F.when(i == 0, 1).otherwise(F.get(spans, i - 1)["end"] + 1), F.get(starts, i) - F.when(i == 0, 0).otherwise(F.get(spans, i - 1)["end"])), F.lit("["), F.upper(c["kind"]), F.lit("]")))
    last = F.when(F.size(spans) > 0, F.get(spans, F.size(spans) - 1)["end"]).otherwise(0)
    return F.concat(F.array_join(before, ""), F.substring(text, last + 1, F.length(text)))


def span_digests(documents: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    found = find_spans(documents)
    base = F.filter("spans", lambda c: c["base"])

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda c: c["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *[count(kind) for kind in KINDS], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
