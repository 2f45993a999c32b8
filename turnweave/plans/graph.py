"""A rule graph from JSON: loose shapes read into the catalogue's tables.

A graph has nodes (steps with requirements), edges, relation groups, facts (``knowledge_table``),
hard and soft constraints, and terminal policies. Writers of graphs use several names and
shapes for one thing; all are brought to one form here, on the driver, as a graph is metadata.
``lint`` says what a graph lacks, before it is compiled.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from turnweave.functions.facts import GENERAL_ENDS
from turnweave.operators.values import VALUE_FACT
from turnweave.plans.catalogue import ROLES, Catalogue, compile_rules, edge_kind
from turnweave.plans.local import local_table

#: Rows of metadata of one kind; larger graphs are refused, as all of it is broadcast.
MAX_ROWS = 20_000
HARD_MOST, SOFT_MOST = 10, 8

# Names of speakers, of groups in loose shapes, of units and days that make a value comparable.
ASSISTANTS, USERS, BOTH = ("assistant", "agent", "客服"), ("user", "customer", "用户"), ("any", "all", "both", "任意", "双方")
GROUP_KEYS = ("element_groups", "groups", "selector_groups", "correct_groups", "wrong_groups", "negative_groups", "safe_groups", "trigger_groups")
VALUED = r"\d+(?:\.\d+)?\s*(单|天|元|秒|分钟|小时|点)"
VALUED_DAYS = ("今天", "当天", "当日", "今日", "次日", "第二天", "隔天", "明天", "前一天", "前日", "上一天", "18点", "18:00")
VALUED_COUNTS = ("一单", "两单", "三单", "四单", "五单", "六单", "七单", "八单", "九单", "十单", "十二单", "十天", "七天")
MODES = ("always", "user_triggered", "condition", "optional")


def _text(x: Any) -> str:
    return str(x if x is not None else "").strip()


def _first(row: dict, *names: str) -> Any:
    """The first of the named entries that is not empty."""
    return next((row[x] for x in names if row.get(x) not in (None, "", [], {})), None)


def _rows(x: Any) -> list[dict]:
    return [dict(x)] if isinstance(x, dict) else [dict(r) for r in x if isinstance(r, dict)] if isinstance(x, list) else []


def _words(x: Any) -> list[str]:
    """Texts of a loose list, without repeats."""
    found = [x] if isinstance(x, (str, int, float)) else list(x) if isinstance(x, (list, tuple, set)) else []
    return list(dict.fromkeys(t for t in map(_text, found) if t))


# ------------------------------------------------------------------ elements and groups


def element(x: Any, main: bool | None = None, fact: bool | None = None) -> dict | None:
    """One element of a text or a loose record, or None if it has no value."""
    row = {"value": x} if isinstance(x, str) else x if isinstance(x, dict) else {}
    value = _text(_first(row, "value", "v", "text", "name", "element"))
    if not value:
        return None
    pool = _words(row.get("pool")) + _words(row.get("aliases")) + _words(row.get("variants")) + _words(row.get("secondary_pool"))
    own = {"type": _text(_first(row, "type", "element_type")) or "surface", "value": value, "pool": list(dict.fromkeys(pool))}
    own["main"] = bool(row.get("main", row.get("required", main)) if main is None else main)
    own["fact"] = bool(row.get("fact") if fact is None else fact)
    return own


def groups(x: Any) -> list[dict]:
    """Groups of elements: of a list of groups, of one group, of a flat list of elements, or of records that name an object and its value."""
    if isinstance(x, dict):
        x = next((x[k] for k in GROUP_KEYS if isinstance(x.get(k), list)), [x])
    found, flat = [], []
    for row in x if isinstance(x, list) else []:
        if isinstance(row, dict) and isinstance(row.get("elements"), list):
            members = [e for e in map(element, row["elements"]) if e]
        elif isinstance(row, dict) and "element" in row and "value" in row:
            value = {"value": row["value"], "pool": row.get("pool")}
            members = [e for e in (element(row["element"], True, False), element(value, bool(row.get("main", False)), bool(row.get("fact", True)))) if e]
        else:
            flat += [e for e in [element(row)] if e]
            continue
        if members:
            kept = {k: row[k] for k in ("role", "require_all_main", "allow_context_carry", "source_text") if k in row}
            found.append({**kept, "elements": members})
    return found or ([{"elements": flat}] if flat else [])


def with_main(found: list[dict], facts: bool = True) -> list[dict]:
    """Groups each of which has a main element, the first if none is named; without facts, if these are not allowed."""
    for group in found:
        if not facts:
            for e in group["elements"]:
                e["fact"] = False
        if not any(e["main"] for e in group["elements"]):
            group["elements"][0]["main"] = True
    return found


def bound_facts(found: list[dict], selectors: list[dict]) -> list[dict]:
    """Groups of a fact's side: facts are no main elements, and a group of facts has the selector's main element beside them."""
    trunk = next((e for g in selectors for e in g["elements"] if e["main"] and not e["fact"]), None)
    for group in found:
        members = group["elements"]
        for e in members:
            e["main"] = e["main"] and not e["fact"]
        if trunk and any(e["fact"] for e in members) and not any(e["main"] for e in members):
            same = next((e for e in members if e["value"] == trunk["value"]), None)
            if same:
                same |= {"main": True, "fact": False}
            else:
                members.insert(0, {**trunk, "pool": list(trunk["pool"])})
        if not any(e["main"] for e in members):
            free = next((e for e in members if not e["fact"]), None)
            if free:
                free["main"] = True
    return found


def value_checks(x: Any) -> list[dict]:
    """What a value check expects: expected, unit, anchors, condition of each of its checks."""
    own = x if isinstance(x, dict) else {}
    listed = _rows(_first(own, "checks", "value_checks") or []) or ([own] if own else [])
    out = []
    for check in listed:
        expected = _text(_first(check, "normalized_expected", "expected_value", "expected"))
        if expected:
            out.append({"expected": expected, "unit": _text(check.get("unit")), "anchors": _words(_first(check, "slot_anchors", "anchors")), "condition": _text(check.get("condition"))})
    return out


def comparable_check(x: Any) -> bool:
    """Whether a value check names a number with a unit or a day."""
    return any(re.search(VALUED, c["expected"]) or any(w in c["expected"] for w in VALUED_DAYS + VALUED_COUNTS) for c in value_checks(x))


def signature(found: list[dict]) -> set[str]:
    """The values of groups without marks."""
    return {v for g in found for e in g["elements"] if (v := re.sub(r"[\s，。,.、：:；;（）()【】\[\]\-~—_]+", "", e["value"].lower()))}


def usable_wrong(wrong: list[dict], correct: list[dict], check: Any) -> list[dict]:
    """The wrong side, unless a value check decides, or it says nothing that the correct side does not say."""
    own = signature(wrong)
    return [] if comparable_check(check) or (own and own <= signature(correct)) else wrong


def requested_speaker(found: list[dict], default: str | None) -> str | None:
    """The speaker whom role elements ask for; None: both."""
    for e in (e for g in found for e in g["elements"] if e["type"] in ROLES):
        value = e["value"].lower()
        if value in ASSISTANTS:
            return "assistant"
        if value in USERS:
            return "user"
        if value in BOTH:
            return None
    return default


def pool_key(e: dict) -> str:
    return f"{e['type']}:{e['value']}"


def union_pools(*tables: dict[str, list[str]]) -> dict[str, list[str]]:
    """Pools of terms by element, put together in order without repeats."""
    out: dict[str, list[str]] = {}
    for table in tables:
        for key, terms in table.items():
            out[key] = list(dict.fromkeys([*out.get(key, []), *_words(terms)]))
    return out


def with_pools(found: list[dict], pools: dict[str, Any]) -> list[dict]:
    """Groups whose elements have the terms of a pool table, by "type:value", "type.value", "type_value", value or type."""
    for e in (e for g in found for e in g["elements"]):
        names = (pool_key(e), f"{e['type']}.{e['value']}", f"{e['type']}_{e['value']}", e["value"], e["type"])
        more = next((pools[n] for n in names if pools.get(n)), [])
        e["pool"] = list(dict.fromkeys([*e["pool"], *_words(more.get("terms") if isinstance(more, dict) else more)]))
    return found


# ------------------------------------------------------------------ parts of a graph


def pattern(x: Any, speaker: str = "") -> dict | None:
    """A pattern of words: speaker, all, any, none, regex_any and how they count; None if it says nothing."""
    if isinstance(x, str):
        x = {"any": [x]}
    if not isinstance(x, dict):
        return None
    out = {k: _words(x.get(k)) for k in ("all", "any", "none", "regex_any", "reply_to_user_any", "assistant_any")}
    out |= {k: x[k] for k in ("number", "window_union", "cross_turn", "kinds_any", "polarity") if x.get(k)}
    out["speaker"] = _text(x.get("speaker")) or speaker
    out["least"] = int(x.get("min_any_hits") or 1)
    out["within"] = int(x.get("reply_window") or 2)
    return out if any(out[k] for k in ("all", "any", "regex_any", "reply_to_user_any")) or out.get("number") or out.get("cross_turn") else None


def patterns(x: Any, speaker: str = "") -> list[dict]:
    listed = x if isinstance(x, list) else [x] if x else []
    return [p for p in (pattern(r, speaker) for r in listed) if p]


def executable(p: dict, description: str, trigger_words: frozenset[str] = frozenset()) -> list[dict]:
    """A requirement's pattern as it is executed, and what may stand for it.

    Words of the trigger that the description does not name are no evidence; of the words that it names all are needed; what needs
    several words may come over several turns, and who somebody is may be asked and answered.
    """
    out = dict(p)
    own = [w for w in p["any"] if w not in trigger_words or w in description]
    out["any"] = own or p["any"]
    named = [w for w in out["any"] if w in description]
    if not p["all"] and p["least"] < 2 and len(named) >= 2:
        out["least"] = len(named)
    made = [out]
    if out["speaker"] in ("", "assistant") and out["least"] >= 2 and len(out["any"]) >= 2 and not out.get("window_union"):
        made.append({**out, "speaker": "assistant", "all": [], "none": [], "regex_any": [], "window_union": True})
    if any(w in description for w in ("身份", "本人")):
        made.append({**out, "any": [], "all": [], "none": [], "least": 1, "regex_any": ["确认.{0,12}本人", "是.{0,12}本人", "本人.{0,6}吗", "接听.{0,8}吗"], "cross_turn": "assistant_ask_user_affirm"})
    return made


def object_groups(x: Any) -> list[dict]:
    """Groups of an object that a constraint names by its elements or by the texts that express it."""
    own = x if isinstance(x, dict) else {}
    found = groups(_first(own, "primary_elements", "required_elements", "elements") or [])
    texts = [t for k in ("forbidden_surface_forms", "surface_forms", "semantic_equivalents", "trigger_context", "forbidden_action") for t in _words(own.get(k))]
    return found or groups(texts)


def activation(node: dict) -> dict:
    """When a node takes part: its mode, and the groups, patterns, object and hint of its trigger."""
    own = node.get("activation")
    own = {"mode": own} if isinstance(own, str) else own if isinstance(own, dict) else {}
    mode = _text(_first(own, "mode", "type")) or "always"
    trigger = groups(_first(own, "trigger_groups", "trigger_element_groups", "element_groups", "primary_elements") or [])
    return {"mode": mode, "groups": with_main(trigger), "patterns": patterns(own.get("patterns"), "user"), "object": own.get("trigger_object") or {}, "hint": _text(_first(own, "trigger_hint", "description", "hint"))}


def requirement(row: dict, node_id: str, k: int) -> dict:
    found = _first(row, "element_groups", "groups", "primary_elements", "elements") or []
    own = with_main(with_pools(groups(found), row.get("secondary_pools") or {}), facts=False)
    weight = row.get("weight")
    return {
        "id": _text(_first(row, "id", "atom_id", "requirement_id")) or f"{node_id}.r{k}",
        "text": _text(_first(row, "text", "name", "description")),
        "required": row.get("required", True) is not False,
        "weight": float(weight) if isinstance(weight, (int, float)) and weight > 0 else 1.0,
        "groups": own,
        "aliases": _words(row.get("aliases")),
        # An optional requirement that is a required one if the user does not stop the call at its start.
        "conditional": isinstance(row.get("match_policy"), dict) and bool(row["match_policy"].get("conditional_required_when_no_early_user_stop")),
    }


def node(row: dict) -> dict:
    """A node; its atoms, if it has any, stand for its requirements."""
    name = _text(_first(row, "id", "node_id"))
    if not name:
        raise ValueError("a node needs an id")
    listed = _rows(row.get("atoms")) or _rows(row.get("requirements"))
    return {
        "id": name,
        "name": _text(row.get("name")),
        "type": _text(_first(row, "type", "node_type")) or "main",
        "required": row.get("required", True) is not False,
        "activation": activation(row),
        "requirements": [requirement(r, name, k) for k, r in enumerate(listed)],
        "relations": [relation(r, name, k) for k, r in enumerate(_rows(_first(row, "atom_relations", "requirement_relations") or []))],
        "aliases": _words(row.get("aliases")),
    }


def relation(row: dict, node_id: str, k: int) -> dict:
    left, right = _words(_first(row, "left", "source", "from", "if", "before")), _words(_first(row, "right", "target", "to", "then", "after"))
    return {"node_id": node_id, "id": _text(row.get("id")) or f"{node_id}.rel{k}", "type": _text(_first(row, "type", "relation")).lower(), "left": left, "right": right, "options": _words(_first(row, "atoms", "options", "members", "nodes")), "own": row.get("penalty")}


def edge(row: dict, known: set[str]) -> dict:
    source, target = _text(_first(row, "source", "from")), _text(_first(row, "target", "to"))
    if not source or not target:
        raise ValueError("an edge needs both ends")
    if source not in known or target not in known:
        raise ValueError(f"an edge names an unknown node: {source} -> {target}")
    effect = row.get("terminal_effect") if isinstance(row.get("terminal_effect"), dict) else {}
    return {"source": source, "target": target, "type": edge_kind(_text(_first(row, "relation", "type")).lower() or "before"), "weight": float(row.get("weight") or 1.0), "suppress": _words(effect.get("suppress_nodes"))}


def relation_group(row: dict, known: set[str], k: int) -> dict:
    """A group of nodes; names that no node has are left out."""
    weight, least = row.get("weight"), row.get("min_completed")
    return {
        "id": _text(row.get("id")) or f"group{k}",
        "type": (_text(_first(row, "type", "group_type")) or "all_of").lower(),
        "nodes": [n for n in _words(_first(row, "nodes", "members")) if n in known],
        "weight": float(weight) if isinstance(weight, (int, float)) else 1.0,
        "required": row.get("required", True) is not False,
        "least": int(least) if isinstance(least, (int, float)) else None,
    }


def flattened(table: Any) -> list[dict]:
    """Rows of a table whose rows may be parents with atoms: each atom with what it does not say itself from its parent."""
    out = []
    for row in _rows(table):
        atoms = _rows(row.get("atoms"))
        shared = {k: v for k, v in row.items() if k not in ("atoms", "id", "name", "text")}
        out += [{**shared, "parent_id": _text(row.get("id")), **atom} for atom in atoms] or [row]
    return out


def fact(row: dict) -> dict:
    name = _text(_first(row, "id", "knowledge_id"))
    if not name:
        raise ValueError("a fact needs an id")
    selectors = with_main(groups(_first(row, "selector_groups", "selector_element_groups") or []))
    correct = bound_facts(groups(_first(row, "correct_groups", "correct_element_groups", "positive_element_groups", "element_groups") or []), selectors)
    wrong = bound_facts(groups(_first(row, "wrong_groups", "wrong_element_groups", "negative_element_groups") or []), selectors)
    check = row.get("value_check") if isinstance(row.get("value_check"), dict) else {}
    return {
        "id": name, "text": " ".join([name, _text(row.get("name")), _text(row.get("text")), *_words(row.get("aliases"))]), "severity": _text(row.get("severity")) or "medium", "node_id": _text(row.get("node_id")),
        "selector": selectors, "correct": correct, "wrong": usable_wrong(wrong, correct, check), "checks": value_checks(check), "aliases": _words(row.get("aliases")),
        "allowed": bool(check.get("allow_continuation", False)), "blockers": _words(_first(check, "continuation_blockers", "blockers")),
    }


def constraint(row: dict, enforcement: str) -> dict:
    name = _text(_first(row, "id", "constraint_id"))
    if not name:
        raise ValueError("a constraint needs an id")
    trigger = with_main(groups(_first(row, "trigger_groups", "trigger_element_groups") or []) or object_groups(_first(row, "trigger_object", "trigger_target")))
    negative = with_main(groups(_first(row, "negative_groups", "negative_element_groups", "element_groups", "negative_elements") or []) or object_groups(row.get("negative_object")))
    safe = with_main(groups(_first(row, "safe_groups", "positive_element_groups", "safe_element_groups", "positive_elements") or []))
    scope = row.get("detection_scope") if isinstance(row.get("detection_scope"), dict) else {}
    return {
        "id": name, "text": _text(_first(row, "name", "text")), "severity": _text(row.get("severity")) or "medium", "enforcement": _text(row.get("enforcement")) or enforcement,
        "kind": _text(row.get("constraint_kind")) or ("semantic_object" if enforcement == "hard" else "fuzzy_quality"), "needs_trigger": row.get("trigger_policy") in ("requires_user_trigger", "context_dependent"),
        "trigger": trigger, "negative": negative, "safe": safe, "speaker": requested_speaker(negative or safe, _text(scope.get("speaker")) or "assistant"), "metric": row.get("metric") if isinstance(row.get("metric"), dict) else {},
        "global": groups(_first(row, "global_elements", "primary_elements") or []), "prohibited": patterns(row.get("prohibited")), "safe_context": patterns(row.get("safe_context")), "node_id": _text(row.get("node_id")), "aliases": _words(row.get("aliases")),
    }


def merged_constraints(source: dict) -> list[dict]:
    """Hard, soft and compiled constraints, one of each (id, enforcement, kind): of repeated ones each entry is the fuller one."""
    found: dict[tuple, dict] = {}
    for key, enforcement in (("hard_constraint_table", "hard"), ("soft_constraint_table", "soft"), ("constraint_table", "")):
        for row in flattened(source.get(key)):
            own = constraint(row, enforcement or _text(row.get("enforcement")) or "hard")
            at = (own["id"], own["enforcement"], own["kind"])
            known = found.setdefault(at, own)
            for name, value in own.items():
                if len(json.dumps(value, ensure_ascii=False, default=str)) > len(json.dumps(known[name], ensure_ascii=False, default=str)):
                    known[name] = value
    return list(found.values())


def same_meaning(rows: list[dict], most: int, keys: tuple[str, ...] = ("negative", "global")) -> list[dict]:
    """Constraints one of each meaning (the values of their groups), the first ``most``."""
    seen, out = set(), []
    for row in rows:
        meaning = frozenset().union(*(signature(row[k]) for k in keys)) or frozenset({row["id"]})
        if meaning not in seen:
            seen.add(meaning)
            out.append(row)
    return out[:most]


def policy(row: dict, k: int) -> dict:
    return {
        "id": _text(row.get("id")) or f"policy{k}", "trigger": patterns(row.get("trigger"), "user"), "safe": patterns(_first(row, "safe_response", "handling", "resolution"), "assistant"),
        "forbidden": patterns(row.get("forbidden_after_safe_response"), "assistant"), "suppress": _words(_first(row, "suppress_nodes_after_safe_response", "suppress_nodes")),
    }


@dataclass
class Parts:
    """A graph in one form, as plain records."""

    nodes: list[dict] = field(default_factory=list)
    edges: list[dict] = field(default_factory=list)
    groups: list[dict] = field(default_factory=list)
    facts: list[dict] = field(default_factory=list)
    constraints: list[dict] = field(default_factory=list)
    policies: list[dict] = field(default_factory=list)


def normalized(source: dict) -> Parts:
    """All parts of a graph; facts that name a node that there is not lose the name."""
    nodes = [node(r) for r in _rows(source.get("nodes"))]
    known = {n["id"] for n in nodes}
    facts = [fact(r) for r in flattened(source.get("knowledge_table"))]
    for row in facts:
        row["node_id"] = row["node_id"] if row["node_id"] in known else ""
    return Parts(
        nodes,
        [edge(r, known) for r in _rows(source.get("edges"))],
        [relation_group(r, known, k) for k, r in enumerate(_rows(source.get("relation_groups")))],
        facts,
        merged_constraints(source),
        [policy(r, k) for k, r in enumerate(_rows(source.get("terminal_policies")))],
    )


def dangling(source: dict) -> list[tuple[str, str, str]]:
    """(kind, id, name) of names of nodes or requirements in facts, constraints and groups that the graph has not."""
    nodes = [node(r) for r in _rows(source.get("nodes"))]
    ids, atoms = {n["id"] for n in nodes}, {r["id"] for n in nodes for r in n["requirements"]}
    out = []
    for kind, key in (("fact", "knowledge_table"), ("hard", "hard_constraint_table"), ("soft", "soft_constraint_table")):
        for row in flattened(source.get(key)):
            out += [(kind, _text(row.get("id")), x) for x in _words(row.get("node_id")) if x not in ids]
            out += [(kind, _text(row.get("id")), x) for x in _words(_first(row, "atom_ids", "requirement_id")) if x not in atoms]
    for row in _rows(source.get("relation_groups")):
        out += [("group", _text(row.get("id")), x) for x in _words(row.get("nodes")) if x not in ids]
    return out


# ------------------------------------------------------------------ lint


def _answer_key(words: dict) -> bool:
    """Whether a pattern looks copied from a sample: one long text."""
    return any(len(x) >= 24 for k in ("any", "all") for x in words[k])


def _same_pattern(p: dict) -> tuple:
    return (p["speaker"], *(tuple(sorted(x.lower().replace(" ", "") for x in p[k])) for k in ("all", "any", "regex_any", "none")))


def lint(source: dict) -> list[dict]:
    """(type, path) of what a graph lacks or says twice."""
    found: list[dict] = []

    def say(kind: str, path: str) -> None:
        found.append({"type": kind, "path": path})

    modes = {}
    for i, row in enumerate(_rows(source.get("nodes"))):
        own, path = activation(row), f"nodes[{i}]"
        modes[_text(_first(row, "id", "node_id"))] = own["mode"]
        if own["mode"] not in MODES:
            say("unknown_activation_mode", f"{path}.activation")
        if own["mode"] in ("user_triggered", "condition") and not (own["groups"] or own["patterns"] or own["object"] or own["hint"]):
            say("conditional_without_trigger", path)
        if _text(row.get("type")) == "terminal" and not (row.get("requirements") or row.get("atoms") or row.get("evidence_groups")):
            say("empty_terminal_made_optional", path)
        for j, req in enumerate(_rows(row.get("requirements"))):
            if not groups(_first(req, "element_groups", "primary_elements") or []) and not req.get("evidence_groups") and not row.get("atoms"):
                say("requirement_without_element_rule", f"{path}.requirements[{j}]")
            for g, group in enumerate(_rows(req.get("evidence_groups"))):
                own_patterns = patterns(group.get("patterns"))
                if len({_same_pattern(p) for p in own_patterns}) < len(own_patterns):
                    say("duplicate_group_pattern_removed", f"{path}.requirements[{j}].evidence_groups[{g}]")
                for k, p in enumerate(own_patterns):
                    if p["speaker"] in ("", "assistant") and len(p["any"]) >= 4 and p["least"] < 2:
                        say("broad_any_strengthened", f"{path}.requirements[{j}].evidence_groups[{g}].patterns[{k}]")
    for i, row in enumerate(_rows(source.get("edges"))):
        if _text(_first(row, "relation", "type")) in ("branch", "condition_on") and modes.get(_text(_first(row, "target", "to"))) == "always":
            say("branch_target_always_active", f"edges[{i}]")
    for i, row in enumerate(_rows(source.get("relation_groups"))):
        least = row.get("min_completed")
        if isinstance(least, int) and least > sum(modes.get(n) not in (None, "optional") for n in _words(row.get("nodes"))):
            say("relation_group_optional_nodes_repaired", f"relation_groups[{i}].min_completed")
    for i, row in enumerate(flattened(source.get("knowledge_table"))):
        support, refute = patterns(row.get("support_patterns")), patterns(_first(row, "refute_patterns", "conflict_patterns"))
        words = {w for p in support for k in ("all", "any") for w in p[k]}
        for p in refute:
            own_words = {w for k in ("all", "any") for w in p[k]}
            if _answer_key(p):
                say("answer_key_pattern_removed", f"knowledge_table[{i}]")
            elif _same_pattern(p) in {_same_pattern(q) for q in support} or (own_words and own_words <= words):
                say("support_refute_overlap_repaired", f"knowledge_table[{i}]")
        for j, claim in enumerate(_rows(row.get("claims"))):
            if claim.get("refute_patterns") and not claim.get("claim_patterns"):
                say("refute_without_claim_anchor", f"knowledge_table[{i}].claims[{j}]")
    for i, row in enumerate(_rows(source.get("constraint_table")) or _rows(source.get("hard_constraint_table")) + _rows(source.get("soft_constraint_table"))):
        for key in ("prohibited", "safe_context", "trigger", "unresolved"):
            listed = row.get(key) if isinstance(row.get(key), list) else []
            own_patterns = patterns(listed)
            if key in ("prohibited", "unresolved") and len(own_patterns) < len(listed):
                say("empty_constraint_pattern_removed", f"constraint_table[{i}].{key}")
            if len({_same_pattern(p) for p in own_patterns}) < len(own_patterns):
                say("duplicate_constraint_pattern_removed", f"constraint_table[{i}].{key}")
    return found


def lint_counts(issues: list[dict]) -> dict[str, int]:
    return dict(Counter(x["type"] for x in issues))


def english_only(source: Any, most: int = 6, share: float = 0.08) -> tuple[list[str], bool]:
    """Texts of a graph that have Latin words and no Chinese, and whether there are few enough of them."""
    texts: list[str] = []

    def walk(x: Any, key: str = "") -> None:
        if isinstance(x, dict):
            for k, v in x.items():
                walk(v, k)
        elif isinstance(x, list):
            for v in x:
                walk(v, key)
        elif isinstance(x, str) and key in ("name", "text", "description", "value", "v", "pool", "aliases", "trigger_hint"):
            texts.append(x)

    walk(source)
    foreign = [t for t in texts if len(re.findall(r"[A-Za-z]{2,}", t)) >= 2 and not re.search(r"[一-鿿]", t)]
    return foreign, len(foreign) <= most and len(foreign) <= share * max(1, len(texts))


def rule_coverage(parts: Parts, most: float = 0.40) -> tuple[list[str], bool]:
    """Requirements, facts and constraints without any element, and whether few enough are."""
    rows = [(r["id"], r["groups"]) for n in parts.nodes for r in n["requirements"]]
    rows += [(f["id"], f["selector"] + f["correct"]) for f in parts.facts]
    rows += [(c["id"], c["negative"] + c["global"] + ([c["metric"]] if c["metric"] else [])) for c in parts.constraints]
    missing = [name for name, found in rows if not found]
    return missing, len(missing) <= most * max(1, len(rows))


# ------------------------------------------------------------------ versions, atoms, differences


def version(source: Any) -> str:
    """A name of a graph by what it says: 24 digits of a digest of its sorted JSON."""
    return hashlib.sha256(json.dumps(source, ensure_ascii=False, sort_keys=True).encode()).hexdigest()[:24]


def atoms_of(parts: Parts, batch: int = 8) -> list[tuple[str, str, str, int]]:
    """(kind, owner, atom, batch) of all that elements can be written for, in batches of each kind."""
    listed = [("requirement", n["id"], r["id"]) for n in parts.nodes for r in n["requirements"]]
    listed += [("activation", n["id"], f"activation::{n['id']}") for n in parts.nodes if n["activation"]["mode"] != "always"]
    listed += [("fact", f["node_id"], f["id"]) for f in parts.facts]
    listed += [(c["enforcement"], c["node_id"], c["id"]) for c in parts.constraints]
    seen: Counter = Counter()
    out = []
    for kind, owner, name in listed:
        out.append((kind, owner, name, seen[kind] // batch))
        seen[kind] += 1
    return out


def merged_elements(source: dict, delta: list[dict]) -> dict:
    """A graph whose requirements have the groups that a delta gives by atom id; elements that are there get more terms."""
    of = {_text(_first(d, "atom_id", "id")): groups(_first(d, "element_groups", "groups", "elements") or []) for d in delta}
    out = json.loads(json.dumps(source))
    for n in out.get("nodes") or []:
        for r in n.get("atoms") or n.get("requirements") or []:
            more = of.get(_text(_first(r, "id", "atom_id")))
            if not more:
                continue
            own = groups(r.get("element_groups") or [])
            known = {pool_key(e): e for g in own for e in g["elements"]}
            for group in more:
                new = []
                for e in group["elements"]:
                    if pool_key(e) in known:
                        known[pool_key(e)]["pool"] = list(dict.fromkeys(known[pool_key(e)]["pool"] + e["pool"]))
                    else:
                        new.append(e)
                if new:
                    own.append({**group, "elements": new})
            r["element_groups"] = own
    return out


def from_legacy(source: dict) -> dict:
    """A graph of the older shape, with stages and requirements as texts, in the present one."""
    if source.get("nodes"):
        return source
    stages = _rows(_first(source, "stages", "steps", "flow") or [])
    listed = [
        {"id": _text(_first(s, "id", "stage_id")) or f"s{i}", "name": _text(s.get("name")), "type": "main", "requirements": [{"id": f"s{i}.r{k}", "text": t, "element_groups": [{"elements": [{"value": t, "main": True}]}]} for k, t in enumerate(_words(_first(s, "requirements", "goals", "must_say")))]}
        for i, s in enumerate(stages)
    ]
    links = [{"source": a["id"], "target": b["id"], "relation": "strict_order"} for a, b in zip(listed, listed[1:], strict=False)]
    facts = [{"id": _text(k.get("id")) or f"k{i}", "correct_groups": [{"elements": _words(_first(k, "facts", "value", "text")) }]} for i, k in enumerate(_rows(_first(source, "knowledge", "facts") or []))]
    bans = [{"id": _text(c.get("id")) or f"c{i}", "negative_groups": [{"elements": _words(_first(c, "forbidden", "banned", "text"))}]} for i, c in enumerate(_rows(_first(source, "constraints", "bans") or []))]
    return {"nodes": listed, "edges": links, "knowledge_table": facts, "hard_constraint_table": bans}


def _bigrams(x: str) -> set[str]:
    tight = re.sub(r"\s+", "", x).lower()
    return {tight[i : i + 2] for i in range(len(tight) - 1)}


def difference(a: dict, b: dict, least: float = 0.36) -> list[tuple[str, str, str, str]]:
    """(kind, state, id, nearest) of what two graphs do not share: missing or extra, and what comes near it."""
    out = []
    for kind, key in (("node", "nodes"), ("fact", "knowledge_table"), ("hard", "hard_constraint_table"), ("soft", "soft_constraint_table")):
        label = lambda r: " ".join([_text(_first(r, "name", "text")), *_words(r.get("aliases"))])
        one, two = ({_text(_first(r, "id", "node_id")): label(r) for r in flattened(g.get(key))} for g in (a, b))
        for state, mine, other in (("missing", one, two), ("extra", two, one)):
            for name in sorted(mine.keys() - other.keys()):
                own = _bigrams(mine[name])
                score = {k: len(own & _bigrams(v)) / max(1, len(own | _bigrams(v))) for k, v in other.items() if k not in mine}
                best = max(sorted(score), key=score.get, default="")
                out.append((kind, state, name, best if best and score[best] >= least else ""))
    return out


# ------------------------------------------------------------------ tables


@dataclass
class Graph:
    """The tables of a graph, and its policies and metrics as records."""

    parts: Parts
    catalogue: Catalogue
    requirements: DataFrame
    relations: DataFrame
    members: DataFrame
    groups: DataFrame
    facts: DataFrame
    values: DataFrame
    constraints: DataFrame


def _general(e: dict) -> bool:
    value = re.sub(r"\s+", "", e["value"]).lower()
    return len(value) <= 2 or value.endswith(GENERAL_ENDS)


def graph_rows(source: dict) -> tuple[Parts, list[dict], dict[str, list]]:
    """A graph's parts, its rules, and the rows of its other tables by name; more than ``MAX_ROWS`` of a kind are refused."""
    parts = normalized(from_legacy(source))
    if max(len(parts.nodes), len(parts.edges), len(parts.facts), len(parts.constraints), sum(len(n["requirements"]) for n in parts.nodes)) > MAX_ROWS:
        raise ValueError(f"more than {MAX_ROWS} rows of one kind")
    rules: list[dict[str, Any]] = []

    def rule(name: str, kind: str, found: list[dict], scope: str | None, fallback: bool = False) -> str | None:
        if found:
            made = [{**g, "require_all": bool(g.get("require_all_main", False))} for g in found]
            rules.append({"id": name, "type": kind, "groups": made, "scope": scope, "fallback": fallback})
        return name if found else None

    node_rows, requirement_rows, relation_rows = [], [], []
    for n in parts.nodes:
        own = n["activation"]
        trigger = rule(f"activation::{n['id']}", "node_trigger", own["groups"], requested_speaker(own["groups"], "user"), True)
        node_rows.append({"id": n["id"], "type": n["type"], "mode": own["mode"], "required": n["required"], "rules": [r["id"] for r in n["requirements"]], "trigger": trigger})
        for r in n["requirements"]:
            rule(r["id"], "node_positive", r["groups"], requested_speaker(r["groups"], "assistant"), True)
            requirement_rows.append((n["id"], r["id"], r["weight"], r["required"], r["text"], r["conditional"]))
        relation_rows += [(x["node_id"], x["id"], x["type"], x["left"], x["right"], x["options"], float(x["own"]) if isinstance(x["own"], (int, float)) else None) for x in n["relations"]]
    fact_rows, value_rows = [], []
    for f in parts.facts:
        sides = [rule(f"{f['id']}.{side}", kind, f[side], "assistant") for side, kind in (("selector", "knowledge_selector"), ("correct", "knowledge_positive"), ("wrong", "knowledge_negative"))]
        expected = [t for g in f["correct"] for e in g["elements"] if e["fact"] for t in (e["value"], *e["pool"])]
        mains = [[e for e in g["elements"] if e["main"] and not e["fact"]] for g in f["selector"]]
        subjects = [t for g in mains for e in g for t in (e["value"], *e["pool"])]
        fact_rows.append((f["id"], *sides, f["severity"], subjects, expected, any(g.get("allow_context_carry") for g in f["wrong"])))
        if f["checks"]:
            trunk = [[{"terms": [e["value"], *e["pool"]], "general": _general(e)} for e in g] for g in mains]
            short = [t for g in f["selector"] for e in g["elements"] for t in (e["value"], *e["pool"]) if len(re.sub(r"\s+", "", t)) <= 8]
            value_rows.append((f["id"], f["text"], trunk, short, f["checks"], f["allowed"], f["blockers"]))
    constraint_rows = []
    for c in parts.constraints:
        if c["enforcement"] == "hard" and c["kind"] != "structural_metric":
            sides = [rule(f"{c['id']}.trigger", "constraint_trigger", c["trigger"], requested_speaker(c["trigger"], "user")), rule(f"{c['id']}.negative", "constraint_negative", c["negative"], c["speaker"]), rule(f"{c['id']}.safe", "constraint_positive", c["safe"], c["speaker"])]
            constraint_rows.append((c["id"], *sides, c["needs_trigger"], c["severity"]))
        elif c["enforcement"] == "soft" and c["global"] and not c["metric"].get("type"):
            rule(f"{c['id']}.soft", "soft_global", [{"elements": [e], "role": "global"} for g in c["global"] for e in g["elements"]], "assistant")
    edges = [{"source": e["source"], "target": e["target"], "type": e["type"], "weight": e["weight"], "suppress": e["suppress"]} for e in parts.edges]
    member_rows = [(g["id"], g["type"], i, n) for g in parts.groups for i, n in enumerate(g["nodes"])]
    group_rows = [(g["id"], g["type"], g["weight"], g["required"], g["least"]) for g in parts.groups]
    rows = {"nodes": node_rows, "edges": edges, "requirements": requirement_rows, "relations": relation_rows, "members": member_rows, "groups": group_rows, "facts": fact_rows, "values": value_rows, "constraints": constraint_rows}
    return parts, rules, rows


def compile_graph(spark: SparkSession, source: dict) -> Graph:
    """The tables of a graph; larger ones than ``MAX_ROWS`` of a kind are refused."""
    parts, rules, rows = graph_rows(source)
    table = lambda name, schema: local_table(spark, rows[name], schema)
    return Graph(
        parts,
        compile_rules(spark, rules, rows["nodes"], rows["edges"]),
        table("requirements", "node_id string, requirement_id string, weight double, required boolean, text string, conditional boolean"),
        table("relations", "node_id string, relation_id string, type string, left array<string>, right array<string>, options array<string>, own double"),
        table("members", "group_id string, group_type string, position int, node_id string"),
        table("groups", "group_id string, group_type string, weight double, required boolean, least int"),
        table("facts", "fact_id string, selector string, correct string, wrong string, severity string, subjects array<string>, expected array<string>, carries boolean"),
        table("values", VALUE_FACT),
        table("constraints", "constraint_id string, trigger string, negative string, safe string, needs_trigger boolean, severity string"),
    )


def read_graph(path: str) -> dict:
    """A graph or configuration file of JSON; of other shapes than an object a ``ValueError``."""
    with open(path, encoding="utf-8") as file:
        found = json.load(file)
    if not isinstance(found, dict):
        raise ValueError(f"{path} holds no object")
    return found


def compile_graph_file(spark: SparkSession, path: str, out: str | None = None) -> Graph:
    """The tables of a graph file; ``out``: a folder for them as Parquet, one a table, under the graph's version."""
    source = read_graph(path)
    graph = compile_graph(spark, source)
    if out:
        for name in ("requirements", "relations", "members", "groups", "facts", "values", "constraints"):
            getattr(graph, name).write.mode("overwrite").parquet(f"{out}/{version(source)}/{name}")
        for name in ("elements", "nodes", "edges"):
            getattr(graph.catalogue, name).write.mode("overwrite").parquet(f"{out}/{version(source)}/{name}")
    return graph
