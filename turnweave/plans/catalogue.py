"""The rule catalogue: JSON metadata compiled to small tables.

A catalogue has rules (a side of a node, of a fact or of a constraint), their groups
(alternatives) and the groups' elements with the terms that express them. It is metadata
of tens to thousands of rows; it is compiled on the driver and checked before it is
broadcast.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.text import COUNTED, EXACT_MARKS, FILLERS, PRECISE_WORDS, compact
from turnweave.operators.atoms import NEGATION
from turnweave.plans.local import local_table

#: Elements that are broadcast; larger catalogues are refused.
MAX_ELEMENTS = 200_000

# Thresholds by type of rule (hit_main, hit_group, review_main, review_group).
PROFILES = {
    "node_positive": (0.50, 0.34, 0.25, 0.18),
    "node_trigger": (0.50, 0.42, 0.26, 0.20),
    "knowledge_selector": (0.50, 0.42, 0.26, 0.20),
    "knowledge_positive": (0.52, 0.58, 0.30, 0.34),
    "knowledge_negative": (0.52, 0.58, 0.30, 0.34),
    "knowledge_subject": (0.50, 0.42, 0.26, 0.20),
    "constraint_trigger": (0.50, 0.42, 0.26, 0.20),
    "constraint_negative": (0.52, 0.58, 0.30, 0.34),
    "constraint_positive": (0.52, 0.54, 0.30, 0.32),
    "soft_global": (0.48, 0.30, 0.24, 0.18),
    "default": (0.52, 0.46, 0.28, 0.22),
}
# Roles of the groups that decide, by type of rule.
DECISIVE = {
    "node_positive": ("main", "required"),
    "node_trigger": ("trigger", "main", "required"),
    "knowledge_selector": ("selector", "main", "required"),
    "knowledge_positive": ("correct", "positive", "main", "required"),
    "knowledge_negative": ("wrong", "negative", "main", "required"),
    "constraint_trigger": ("trigger", "main", "required"),
    "constraint_negative": ("negative", "negative_main", "main", "required"),
    "constraint_positive": ("safe", "safe_exception", "positive", "main", "required"),
    "soft_global": ("global", "main", "required"),
}
# Types whose value itself is looked for in texts, and types that name a speaker.
SURFACE = frozenset("surface business_target attribute value time date duration quantity condition target action object subject unit".split())
ROLES = frozenset(("speaker_role", "discourse_role"))
# Marks of numbers, words of negation, words that say little, participants.
NUMBER_MARKS = ("元", "点", "天", "单", "小时", "分钟", "%", "％")
WEAK = ("可以", "需要", "进行", "这个", "那个", "一下", "今天")
PARTICIPANTS = ("我", "你", "您", "他", "她", "对方", "用户", "客户", "老板", "负责人", "客服")
PRONOUNS = ("我", "你", "您", "对方")

#: States that the main elements of one group may stand for, and how many are one number's bits.
MAX_STATES, STATE_BITS = 126, 63

ELEMENT = (
    "rule_id string, rule_type string, rule_ord int, group_id string, group_ord int, role string, decisive boolean, require_all boolean, "
    "element_id string, element_ord int, type string, value string, terms array<string>, surface array<string>, main boolean, fact boolean, cluster int, scope string, fallback boolean, flat boolean"
)

WEIGHTED = ELEMENT + (
    ", weight double, precise boolean, hit_main double, hit_group double, review_main double, review_group double, "
    "forms array<struct<tight:string,rest:string,chars:array<string>,exact:boolean>>"
)


def _tight(x: Any) -> str:
    return re.sub(r"\s+", "", str(x or "")).lower()


def _terms(items: list[Any]) -> list[str]:
    """Without empty ones and repeats of a compact form, in order."""
    found = {}
    for x in items:
        found.setdefault(_tight(x), str(x or "").strip())
    found.pop("", None)
    return list(found.values())


def _names_participant(e: dict) -> bool:
    value = _tight(e["value"])
    return value in PARTICIPANTS or (len(value) <= 4 and any(_tight(x) in PRONOUNS for x in e["terms"][1:]))


def _clusters(elements: list[dict]) -> dict[int, int]:
    """The states that a trigger's main elements stand for, by element.

    A state is named by its first element and has all later ones whose value holds the first one's or is held by it. Elements that
    name a participant stand for no state, unless all do.
    """
    mains = {i: _tight(e["value"]) for i, e in enumerate(elements) if e["main"] and e["type"] not in ROLES}
    waiting = [i for i in mains if not _names_participant(elements[i])] or list(mains)
    states: dict[int, int] = {}
    number = 0
    while waiting:
        head, *rest = waiting
        alike = {i for i in rest if mains[head] and mains[i] and (mains[head] in mains[i] or mains[i] in mains[head])}
        states |= {i: number for i in (head, *alike)}
        waiting = [i for i in rest if i not in alike]
        number += 1
    return states


@dataclass
class Catalogue:
    """Small tables of a compiled catalogue."""

    elements: DataFrame
    nodes: DataFrame
    edges: DataFrame
    size: int
    #: Whether an edge ends what is behind its target.
    ends: bool = False


def rule_rows(rules: list[dict[str, Any]]) -> list[tuple]:
    """The elements of rules as rows of ``WEIGHTED``; see ``compile_rules``."""
    rows, seen = [], set()
    for r, rule in enumerate(rules):
        if not rule.get("id"):
            raise ValueError("a rule needs an id")
        if rule["id"] in seen:
            raise ValueError(f"two rules are named {rule['id']}")
        seen.add(rule["id"])
        kind = rule.get("type", "node_positive")
        # A rule with elements of its own is a flat one: its elements stand for one group, and spans are scored by themselves.
        flat = bool(rule.get("elements")) and not rule.get("groups")
        groups = rule.get("groups") or ([{"elements": rule["elements"]}] if flat else [])
        default = next((name for name in ("negative", "positive", "trigger", "selector") if name in kind), "main")
        roles = [g.get("role") or ("main" if kind == "node_positive" else default) for g in groups]
        allowed = DECISIVE.get(kind, ("main", "required"))
        decisive = [x in allowed for x in roles]
        if not any(decisive):
            decisive = [True] * len(groups)
        for g, group in enumerate(groups):
            elements = []
            for e in group.get("elements") or []:
                value = e if isinstance(e, str) else e.get("value") or e.get("text") or ""
                e = {} if isinstance(e, str) else e
                of = e.get("type", "surface")
                terms = _terms([value, *(e.get("aliases") or []), *(e.get("pool") or [])])
                shown = terms if of in SURFACE else [t for t in terms if _tight(t) != _tight(value)]
                elements.append({"type": of, "value": value, "terms": terms, "surface": shown, "main": bool(e.get("main", False)), "fact": bool(e.get("fact", False))})
            clusters = _clusters(elements)
            if len(set(clusters.values())) > MAX_STATES:
                raise ValueError(f"a group of {rule['id']} names more than {MAX_STATES} states")
            for k, e in enumerate(elements):
                rows.append(
                    (rule["id"], kind, r, f"{rule['id']}.g{g}", g, roles[g], decisive[g], bool(group.get("require_all", False)))
                    + (f"{rule['id']}.g{g}.e{k}", k, e["type"], e["value"], e["terms"], e["surface"], e["main"], e["fact"], clusters.get(k), rule.get("scope"), bool(rule.get("fallback", False)), flat)
                )
    return _weighted(rows)


def compile_rules(spark: SparkSession, rules: list[dict[str, Any]], nodes: list[dict[str, Any]] = (), edges: list[dict[str, Any]] = ()) -> Catalogue:
    """Tables of rules like {"id", "type", "groups": [{"role", "require_all", "elements": [{"type", "value", "pool", "main", "fact"}]}]}."""
    rows = rule_rows(rules)
    for name, n in (("elements", len(rows)), ("nodes", len(nodes)), ("edges", len(edges))):
        if n > MAX_ELEMENTS:
            raise ValueError(f"{n} {name}; at most {MAX_ELEMENTS} are broadcast")
    elements = local_table(spark, rows, WEIGHTED)
    node_rows = [(n["id"], n.get("type", "main"), n.get("mode", "always"), bool(n.get("required", True)), n.get("rules", [n["id"]]), n.get("trigger")) for n in nodes]
    known = {n["id"] for n in nodes}
    for e in edges:
        if e["source"] not in known or e["target"] not in known:
            raise ValueError(f"an edge names an unknown node: {e['source']} -> {e['target']}")
    edge_rows = [(e["source"], e["target"], edge_kind(e.get("type", "before")), float(e.get("weight", 1.0)), list(e.get("suppress", ()))) for e in edges]
    return Catalogue(
        elements,
        local_table(spark, node_rows, "node_id string, node_type string, mode string, required boolean, rules array<string>, trigger_rule string"),
        local_table(spark, edge_rows, "source string, target string, kind string, weight double, suppress array<string>"),
        len(rows),
        any(e[2] in ENDS for e in edge_rows),
    )


# Kinds of edges that end what is behind their target, and other names of kinds.
ENDS = ("terminal_after", "suppress_after")
EDGE_KINDS = {
    "required_after": "before", "soft_order": "before", "strict_order": "strict_before", "ordered": "strict_before", "conditional": "condition_on", "if_then": "condition_on",
    "branch": "branch_choice", "choice": "branch_choice", "terminal": "terminal_after", "stop_after": "suppress_after",
}


def edge_kind(name: str) -> str:
    return EDGE_KINDS.get(name, name)


def idf(elements: DataFrame) -> DataFrame:
    """(term, df, idf) of the compact terms; every rule is a document."""
    terms = elements.select("rule_id", F.explode("terms").alias("t")).select("rule_id", compact("t").alias("term")).where("term <> ''").distinct()
    n = elements.agg(F.greatest(F.lit(1), F.count_distinct("rule_id")).alias("n"))
    counted = terms.groupBy("term").agg(F.count("*").alias("df"))
    return counted.crossJoin(F.broadcast(n)).select("term", "df", (F.log((F.col("n") + 1) / (F.col("df") + 1)) + 1).alias("idf"))


def term_forms(text: str) -> tuple[str, str]:
    """A term's compact form, and that without fillers."""
    tight = rest = _tight(text)
    for word in FILLERS:
        rest = rest.replace(word, "")
    return tight, rest


def _form(text: str) -> dict[str, Any]:
    """What ``form_hit`` compares of a term."""
    tight, rest = term_forms(text)
    exact = bool(re.search(r"\d", tight)) or any(x in tight for x in EXACT_MARKS) or len(tight) < 5
    return {"tight": tight, "rest": rest, "chars": list(dict.fromkeys(tight)), "exact": exact}


def _special(value: str, terms: list[str]) -> float:
    """How much more or less a term's form says."""
    joined, own = " ".join(terms), _tight(value)
    tight = _tight(joined)
    out = 1.20 if re.search(r"\d", joined) or any(x in tight for x in NUMBER_MARKS) else 1.0
    out *= 1.15 if any(x in tight for x in NEGATION) or value in ("否定", "negation") else 1.0
    return out * (0.80 if len(own) <= 1 else 1.0) * (0.85 if own in WEAK else 1.0)


def _weighted(rows: list[tuple]) -> list[tuple]:
    """Rows of ``ELEMENT`` with their weight, whether they are precise, the thresholds of their type and the forms of their terms."""
    documents: dict[str, set[str]] = {}
    for row in rows:
        documents.setdefault(row[0], set()).update(_tight(t) for t in row[12])
    df: dict[str, int] = {}
    for terms in documents.values():
        for term in terms:
            df[term] = df.get(term, 0) + 1
    n = max(1, len(documents))
    out = []
    for row in rows:
        kind, value, terms, surface, main, fact = row[1], row[11], row[12], row[13], row[14], row[15]
        rarest = max((math.log((n + 1) / (df[t] + 1)) + 1 for t in map(_tight, terms) if t in df), default=1.0)
        weight = (1.5 if main else 1.0) * (1.25 if fact else 1.0) * rarest * _special(value, terms)
        tight = _tight(" ".join(terms))
        precise = bool(re.search(r"\d", tight) or re.search(COUNTED, tight)) or any(x in tight for x in PRECISE_WORDS)
        profile = PROFILES.get(kind, PROFILES["default"])
        out.append((*row, max(0.2, min(4.0, weight)), precise, *profile, [_form(t) for t in surface]))
    return out
