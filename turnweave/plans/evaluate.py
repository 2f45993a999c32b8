"""The whole evaluation: turns and a rule graph to matches, steps, facts, constraints, relations and scores.

Everything is keyed by dialogue from the hits on. What several steps read is stored once. Facts and
constraints start from what matched: a dialogue and an item that never met make no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.cues import allows_continue, loose_hit
from turnweave.functions.text import any_of
from turnweave.operators import activation, judges, matching, nodes, patterns, relations, requirements, scoring, values
from turnweave.operators.atoms import NEGATION, atoms, spread
from turnweave.plans.graph import Graph
from turnweave.plans.local import local_table
from turnweave.sources.shared import stored

SIDES = ("selector", "correct", "wrong")
#: Of a selector's windows those near its best one open the scope of a fact.
SCOPE_LEAST, SCOPE_SHARE = 0.42, 0.75


def policy_events(turns: DataFrame, policies: list[dict]) -> DataFrame:
    """(dialogue, policy_id, trigger_turn, safe_turn, forbidden_turn, status) of the terminal policies that were triggered.

    One pass over the turns marks what each policy finds in them; a turn that allows to go on triggers none. Without a turn that
    handles the trigger as the policy says, one that comes near it counts.
    """
    text, speaker = F.col("text"), F.col("speaker")

    def some(listed: list[dict], fuzzy: bool) -> Column:
        out = F.lit(False)
        for p in listed:
            out = out | patterns.turn_matches(p, text, speaker, fuzzy)
        return out

    def near(listed: list[dict]) -> Column:
        out = F.lit(False)
        for p in listed:
            for word in (*p["any"], *p["all"]):
                out = out | loose_hit(F.lit(word), text)
        return out

    marks = [
        F.struct(
            F.lit(p["id"]).alias("policy_id"),
            ((speaker == "user") & some(p["trigger"], False) & ~allows_continue(text)).alias("trigger"),
            ((speaker == "assistant") & some(p["safe"], True)).alias("safe"),
            ((speaker == "assistant") & near(p["safe"])).alias("nearly"),
            ((speaker == "assistant") & some(p["forbidden"], True)).alias("forbidden"),
        )
        for p in policies
    ]
    rows = turns.select("dialogue_id", "turn_index", F.inline(F.array(*marks))).where("trigger OR safe OR nearly OR forbidden")
    at = lambda c: F.collect_list(F.when(F.col(c), F.col("turn_index")))
    out = rows.groupBy("dialogue_id", "policy_id").agg(F.min(F.when(F.col("trigger"), F.col("turn_index"))).alias("trigger_turn"), at("safe").alias("safe"), at("nearly").alias("nearly"), at("forbidden").alias("forbidden"))
    after = lambda c, bound: F.array_min(F.filter(c, lambda x: x > F.col(bound)))
    out = out.where("trigger_turn IS NOT NULL").withColumn("safe_turn", F.coalesce(after("safe", "trigger_turn"), after("nearly", "trigger_turn")))
    out = out.withColumn("forbidden_turn", after("forbidden", "safe_turn"))
    status = F.when(F.col("safe_turn").isNull(), requirements.UNHANDLED).when(F.col("forbidden_turn").isNotNull(), requirements.BROKEN).otherwise(requirements.HANDLED)
    return requirements.handled_later(out.select("dialogue_id", "policy_id", "trigger_turn", "safe_turn", "forbidden_turn", status.alias("status")))


def _suppressed_by_policies(events: DataFrame, found: DataFrame, graph: Graph) -> DataFrame:
    """(dialogue, node_id) that a handled policy ends: those it names, conditional and terminal ones, and those without a hit up to its handling."""
    spark = events.sparkSession
    # A step that has no hit up to one policy's handling is ended by it: the first handling ends the most.
    handled = events.where(F.col("status") == requirements.HANDLED).groupBy("dialogue_id").agg(F.min("safe_turn").alias("until"), F.collect_set("policy_id").alias("policies"))
    named = local_table(spark, [(p["id"], n) for p in graph.parts.policies for n in p["suppress"]], "policy_id string, node_id string")
    own = handled.select("dialogue_id", F.explode("policies").alias("policy_id")).join(F.broadcast(named), "policy_id").select("dialogue_id", "node_id")
    always = [n["id"] for n in graph.parts.nodes if n["type"] == "terminal" or n["activation"]["mode"] in ("user_triggered", "condition")]
    listed = local_table(spark, [(n["id"], [r["id"] for r in n["requirements"]], n["id"] in always) for n in graph.parts.nodes], "node_id string, rules array<string>, always boolean")
    rows = handled.join(found, "dialogue_id").join(F.broadcast(listed), F.lit(True))
    hit = lambda r: F.coalesce((nodes.of_rule(r)["verdict"] == "hit") & (nodes.of_rule(r)["turn_index"] <= F.col("until")), F.lit(False))
    return own.union(rows.where(F.col("always") | ~F.exists("rules", hit)).select("dialogue_id", "node_id")).distinct()


def _fact_checks(spans: DataFrame, settled: DataFrame, graph: Graph) -> DataFrame:
    """(dialogue, fact_id, severity, verdict, the verdicts behind it) of every fact that something speaks of."""
    facts = F.broadcast(graph.facts)
    of_side = lambda side: settled.join(F.broadcast(graph.facts.select("fact_id", F.col(side).alias("rule_id"))), "rule_id")
    own = spans.where("speaker = 'assistant' AND is_evidence")
    selected = of_side("selector").where("verdict <> 'miss'")
    best = F.max("score").over(matching.Window.partitionBy("dialogue_id", "fact_id"))
    near = selected.withColumn("best", best).where(F.col("score") >= F.greatest(F.lit(SCOPE_LEAST), SCOPE_SHARE * F.col("best")))
    scope = stored(judges.value_scope(near.select("dialogue_id", "fact_id", F.col("a_turn").alias("turn_index")), own, keys=("fact_id",)))
    place = F.struct(matching.verdict_rank(F.col("verdict")), "score", -F.col("a_turn"), -F.col("a_seq"), -F.col("window_ord"))
    kept = F.struct("verdict", F.col("m_turn").alias("turn"), F.col("m_seq").alias("seq"))
    top = lambda rows, name: rows.groupBy("dialogue_id", "fact_id").agg(F.max_by(kept, place).alias(name))
    in_scope = scope.select("dialogue_id", "fact_id", F.col("turn_index").alias("a_turn"))
    sides = [top(of_side("selector"), "selector_m")]
    for side in ("correct", "wrong"):
        rows = of_side(side)
        free = rows.join(graph.facts.where("selector IS NULL").select("fact_id"), "fact_id", "left_semi")
        sides.append(top(rows.join(in_scope, ["dialogue_id", "fact_id", "a_turn"], "left_semi").unionByName(free), f"{side}_m"))
    sides.append(top(of_side("wrong"), "all_m"))
    rows = sides[0]
    for side in sides[1:]:
        rows = rows.join(side, ["dialogue_id", "fact_id"], "full")
    rows = stored(rows)
    # Values and directions: in the scope of a selector that was met, otherwise over all the assistant says.
    opened = rows.where("selector_m.verdict IN ('hit', 'review')").select("dialogue_id", "fact_id")
    # Only facts with values or directions to compare.
    judged = graph.facts.join(graph.values.select("fact_id", F.lit(True).alias("valued")), "fact_id", "left").where("valued OR size(expected) > 0").select("fact_id")
    words, any_value = values.fact_words(graph.values)
    words += values.direction_words(graph.facts.join(judged, "fact_id", "left_semi").select("fact_id", "subjects", "expected"))
    wide = values.spans_of_facts(own.select("dialogue_id", "turn_index", "seq", "text"), words, any_value).join(opened, ["dialogue_id", "fact_id"], "left_anti").withColumn("scope_ord", F.lit(0))
    narrow = own.select("dialogue_id", "turn_index", "seq", "text").join(scope, ["dialogue_id", "turn_index"])
    checked = narrow.select("dialogue_id", "fact_id", "turn_index", "seq", "text", "scope_ord").unionByName(wide.select("dialogue_id", "fact_id", "turn_index", "seq", "text", "scope_ord"))
    if any(f["checks"] for f in graph.parts.facts):
        value = values.first_value(values.value_results(checked, graph.values))
        rows = rows.join(value, ["dialogue_id", "fact_id"], "full")
    else:
        rows = rows.withColumn("value", F.lit(None).cast("string")).withColumn("value_turn", F.lit(None).cast("int"))
    turned = judges.direction_conflicts(own, graph.facts.select("fact_id", "subjects", "expected"), checked.select("dialogue_id", "fact_id", "turn_index", "seq"))
    rows = rows.join(turned.select("dialogue_id", "fact_id", F.lit("conflict").alias("direction"), F.col("turn_index").alias("turned_turn")), ["dialogue_id", "fact_id"], "full")
    if any(g.get("allow_context_carry") for f in graph.parts.facts for g in f["wrong"]):
        listed = [(f["id"], [[e["value"], *e["pool"]] for e in g["elements"] if e["main"] and not e["fact"]], [[e["value"], *e["pool"]] for e in g["elements"] if e["fact"]]) for f in graph.parts.facts for g in f["wrong"] if g.get("allow_context_carry")]
        carrying = local_table(spans.sparkSession, listed, "rule_id string, mains array<array<string>>, facts array<array<string>>")
        carried = values.carried_sides(narrow.withColumnRenamed("fact_id", "rule_id").select("dialogue_id", "rule_id", "turn_index", "seq", "text"), carrying)
        rows = rows.join(carried.select("dialogue_id", F.col("rule_id").alias("fact_id"), F.lit(True).alias("carried")), ["dialogue_id", "fact_id"], "left")
    else:
        rows = rows.withColumn("carried", F.lit(None).cast("boolean"))
    rows = rows.join(facts.select("fact_id", "severity", F.col("selector").isNotNull().alias("has_selector"), F.col("wrong").isNotNull().alias("has_wrong")), "fact_id")
    # The spans of correct sides, for facts without a wrong side.
    at = own.select("dialogue_id", F.col("turn_index").alias("p_turn"), F.col("seq").alias("p_seq"), F.col("text").alias("p_text"))
    rows = rows.withColumn("p_turn", F.col("correct_m.turn")).withColumn("p_seq", F.col("correct_m.seq")).join(at, ["dialogue_id", "p_turn", "p_seq"], "left")
    verdict_of = lambda m: F.coalesce(F.col(f"{m}.verdict"), F.lit("miss"))
    denies = any_of(F.coalesce("p_text", F.lit("")), NEGATION)
    # Whether a span of a fact's scope denies something; without a selector all that the assistant says is its scope.
    denying = own.where(any_of(F.col("text"), NEGATION)).select("dialogue_id", "turn_index").distinct()
    scoped = denying.join(scope.select("dialogue_id", "fact_id", "turn_index").distinct(), ["dialogue_id", "turn_index"]).select("dialogue_id", "fact_id", F.lit(True).alias("near_denies")).distinct()
    rows = rows.join(scoped, ["dialogue_id", "fact_id"], "left").join(denying.select("dialogue_id", F.lit(True).alias("any_denies")).distinct(), "dialogue_id", "left")
    nearby = F.when(F.col("has_selector"), F.col("near_denies")).otherwise(F.col("any_denies"))
    probe = values.negation_probe(verdict_of("correct_m"), F.col("p_text"), denies, F.coalesce(nearby, F.lit(False)))
    wrong = F.when(~F.col("has_wrong"), probe).when(F.col("carried") & (verdict_of("wrong_m") == "miss"), "hit").otherwise(verdict_of("wrong_m"))
    verdict = judges.knowledge_verdict(F.col("has_selector"), verdict_of("selector_m"), verdict_of("correct_m"), wrong, verdict_of("all_m"), F.col("value"), F.col("direction"))
    turn = F.coalesce(F.when(wrong == "hit", F.col("wrong_m.turn")), F.when(F.col("value") == "conflict", F.col("value_turn")), "turned_turn", "correct_m.turn", "value_turn", "selector_m.turn")
    out = rows.select("dialogue_id", "fact_id", "severity", verdict.alias("verdict"), turn.alias("turn_index"), verdict_of("correct_m").alias("correct"), wrong.alias("wrong"), verdict_of("selector_m").alias("selector"))
    return out.where("verdict IS NOT NULL")


def _limit_checks(turns: DataFrame, spans: DataFrame, settled: DataFrame, graph: Graph) -> DataFrame:
    """(dialogue, constraint_id, enforcement, severity, verdict, score, turn_index): hard constraints whose negative side something
    met, metrics that a turn breaks, and every soft constraint of every dialogue."""
    spark = turns.sparkSession
    of_side = lambda side: settled.join(F.broadcast(graph.constraints.select("constraint_id", "needs_trigger", "severity", F.col(side).alias("rule_id"))), "rule_id")
    place = F.struct(matching.verdict_rank(F.col("verdict")), "score", -F.col("a_turn"), -F.col("a_seq"))
    kept = F.struct("verdict", F.col("a_turn").alias("turn"), F.col("a_seq").alias("seq"))
    trigger = of_side("trigger").groupBy("dialogue_id", "constraint_id").agg(F.max_by(kept, place).alias("t"))
    rows = of_side("negative").join(trigger, ["dialogue_id", "constraint_id"], "left")
    late = ~F.col("needs_trigger") | F.coalesce((F.col("t.verdict") == "hit") & (F.col("a_turn") > F.col("t.turn")), F.lit(False))
    negative = rows.where(late).groupBy("dialogue_id", "constraint_id", "needs_trigger", "severity").agg(F.max_by(kept, place).alias("n"))
    safe = of_side("safe").select("dialogue_id", "constraint_id", "a_turn", "a_seq", F.col("verdict").alias("safe"), "fact_hit")
    same = (negative["dialogue_id"] == safe["dialogue_id"]) & (negative["constraint_id"] == safe["constraint_id"]) & (F.col("n.turn") == safe["a_turn"]) & (F.col("n.seq") == safe["a_seq"])
    both = negative.join(safe, same, "left").select(negative["dialogue_id"], negative["constraint_id"], "severity", "n", F.coalesce("safe", F.lit("miss")).alias("safe"), F.coalesce("fact_hit", F.lit(False)).alias("fact_hit"))
    verdict = judges.constraint_verdict(F.lit(False), F.lit("hit"), F.col("n.verdict"), F.col("safe"), F.col("fact_hit"))
    out = both.select("dialogue_id", "constraint_id", F.lit("hard").alias("enforcement"), "severity", verdict.alias("verdict"), F.lit(None).cast("double").alias("score"), F.col("n.turn").alias("turn_index"))
    unsure = trigger.join(F.broadcast(graph.constraints.where("needs_trigger").select("constraint_id", "severity")), "constraint_id").where("t.verdict = 'review'")
    out = out.unionByName(unsure.select("dialogue_id", "constraint_id", F.lit("hard").alias("enforcement"), "severity", F.lit(judges.UNSURE).alias("verdict"), F.lit(None).cast("double").alias("score"), F.col("t.turn").alias("turn_index")))
    found = [out]
    for c in graph.parts.constraints:  # each is a plan of its own; their number is the catalogue's, at most a few of each kind
        metric, soft = c["metric"], c["enforcement"] == "soft"
        own = lambda rows, score=None, c=c: rows.select("dialogue_id", F.lit(c["id"]).alias("constraint_id"), F.lit(c["enforcement"]).alias("enforcement"), F.lit(c["severity"]).alias("severity"), F.lit("软问题" if c["enforcement"] == "soft" else judges.VIOLATION).alias("verdict"), (F.lit(0.0) if score is None else score).alias("score"), "turn_index")
        if metric.get("type") == "max_chars_per_assistant_turn":
            limit = int(metric.get("max_chars") or 120)
            found.append(own(judges.longest_turns(turns, limit), F.greatest(F.lit(0.0), 1 - (F.col("n_chars") - limit) / F.lit(float(limit)))))
        elif metric.get("type") == "semantic_repetition_between_assistant_turns":
            repeated = judges.repeated_replies(turns, float(metric.get("similarity_threshold") or 0.8))
            found.append(own(repeated.groupBy("dialogue_id").agg(F.min("second").alias("turn_index"), F.max("similarity").alias("similarity")), 1 - F.col("similarity")))
        elif soft and c["global"]:
            met = settled.where((F.col("rule_id") == f"{c['id']}.soft") & F.col("verdict").isin("hit", "review")).select("dialogue_id", F.col("a_turn").alias("turn_index"), F.col("a_seq").alias("seq")).distinct()
            share = spans.where("speaker = 'assistant'").join(met.withColumn("met", F.lit(1)), ["dialogue_id", "turn_index", "seq"], "left").groupBy("dialogue_id").agg(F.sum("met").alias("h"), F.count("*").alias("n"), F.min(F.when(F.col("met") == 1, F.col("turn_index"))).alias("turn_index"))
            good, review = float(metric.get("good_threshold", metric.get("target_ratio", 0.25))), float(metric.get("review_threshold", 0.12))
            kind = str(metric.get("direction") or metric.get("scoring_direction") or "higher_better")
            direction = "lower" if kind in ("lower_better", "lower_is_better", "max", "upper_bound") else "range" if kind.startswith("range") else "higher"
            low, high = (good, good) if direction == "lower" else sorted((float(metric.get("min_threshold", review)), float(metric.get("max_threshold", good))))
            score = scoring.soft_ratio(F.coalesce("h", F.lit(0)), F.col("n"), direction, low if direction != "higher" else 0.0, good if direction == "higher" else high)
            rows = share.withColumn("s", score)
            found.append(rows.select("dialogue_id", F.lit(c["id"]).alias("constraint_id"), F.lit("soft").alias("enforcement"), F.lit(c["severity"]).alias("severity"), F.when(F.col("s") >= 1, judges.SAFE).otherwise("软问题").alias("verdict"), F.col("s").alias("score"), "turn_index"))
    forbidden = [c for c in graph.parts.constraints if c["prohibited"]]
    if forbidden:
        found.append(_prohibited(turns, forbidden))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    rank = F.when(F.col("verdict") == judges.VIOLATION, 0).otherwise(1)
    best = out.groupBy("dialogue_id", "constraint_id", "enforcement", "severity").agg(F.min_by(F.struct("verdict", "score", "turn_index"), F.struct(rank, F.coalesce("turn_index", F.lit(2**31 - 1)))).alias("b"))
    return best.select("dialogue_id", "constraint_id", "enforcement", "severity", "b.*")


def _prohibited(turns: DataFrame, constraints: list[dict]) -> DataFrame:
    """Rows of ``_limit_checks`` for constraints of which the assistant says a prohibited pattern, outside of their safe contexts."""
    spark = turns.sparkSession
    named = [(c["id"], c["enforcement"], c["severity"], "软问题" if c["enforcement"] == "soft" else judges.VIOLATION) for c in constraints]
    known = F.broadcast(local_table(spark, named, "constraint_id string, enforcement string, severity string, verdict string"))

    def met(rows: DataFrame, listed: list[tuple[str, dict]]) -> DataFrame:
        owners = F.broadcast(local_table(spark, [(str(i), name) for i, (name, _) in enumerate(listed)], "pattern_id string, constraint_id string"))
        return patterns.all_turns(rows, [(str(i), p) for i, (_, p) in enumerate(listed)]).join(owners, "pattern_id").select("dialogue_id", "constraint_id", "turn_index").distinct()

    hit = met(turns.where("speaker = 'assistant'"), [(c["id"], p) for c in constraints for p in c["prohibited"]])
    safe = [(c["id"], q) for c in constraints for q in c["safe_context"]]
    if safe:
        hit = hit.join(met(turns, safe), ["dialogue_id", "constraint_id", "turn_index"], "left_anti")
    first = hit.groupBy("dialogue_id", "constraint_id").agg(F.min("turn_index").alias("turn_index")).join(known, "constraint_id")
    return first.select("dialogue_id", "constraint_id", "enforcement", "severity", "verdict", F.lit(None).cast("double").alias("score"), "turn_index")


def _routed(turns: DataFrame, found: DataFrame, graph: Graph, results: DataFrame, triggers: DataFrame) -> DataFrame:
    """``results`` in which sibling answers that nothing asked for count as given, at turn 0, and are not required."""
    asked = [n for n in graph.parts.nodes if n["type"] == "faq" and len(n["requirements"]) > 1]
    if not asked:
        return results
    spark = turns.sparkSession
    users = turns.where("speaker = 'user'").select("dialogue_id", "turn_index", "text")
    names = [n["id"] for n in asked]
    hints = local_table(spark, [(n["id"], [f"{n['activation']['hint']} {n['name']}".strip(), *[r["text"] for r in n["requirements"]]]) for n in asked], "node_id string, texts array<string>")
    terms = local_table(spark, [(n["id"], r["id"], r["text"], [t for g in r["groups"] for e in g["elements"] for t in (e["value"], *e["pool"])]) for n in asked for r in n["requirements"]], "node_id string, requirement_id string, text string, terms array<string>")
    contexts = activation.context_texts(users, triggers.where(F.col("node_id").isin(*names)), activation.relevant_turns(users, hints))
    kept = requirements.routed(activation.routed_similarities(contexts, terms)).select("dialogue_id", "node_id", "requirement_id", F.lit(True).alias("kept"))
    heard = contexts.select("dialogue_id", "node_id", F.lit(True).alias("heard"))
    rows = results.join(kept, ["dialogue_id", "node_id", "requirement_id"], "left").join(heard, ["dialogue_id", "node_id"], "left")
    skipped = F.coalesce(F.col("heard"), F.lit(False)) & F.col("kept").isNull()
    over = {"required": F.lit(False), "score": F.lit(1.0), "matched": F.lit(True), "turn_index": F.lit(0)}
    return rows.select(*[F.when(skipped, over[c]).otherwise(F.col(c)).alias(c) if c in over else c for c in results.columns])


#: Modes of nodes that the user's words can trigger.
TRIGGERED = ("user_triggered", "condition", "optional")


def _node_text(n: dict) -> str:
    return " ".join(["".join([n["id"], n["name"], *n["aliases"]]), *[f"{r['id']} {r['text']}" for r in n["requirements"]]])


def _asked(triggers: DataFrame, graph: Graph) -> DataFrame:
    """``triggers`` of nodes whose mode knows triggers."""
    return triggers.where(F.col("node_id").isin(*[n["id"] for n in graph.parts.nodes if n["activation"]["mode"] in TRIGGERED]))


def _branches(turns: DataFrame, triggers: DataFrame, graph: Graph) -> DataFrame:
    """(dialogue, node_id, trigger_turn, handled) of triggered branches; handled: a later turn of the assistant takes the trigger's words up."""
    asked = _asked(triggers, graph)
    words = [(n["id"], w) for n in graph.parts.nodes for p in n["activation"]["patterns"] for w in (*p["any"], *p["all"])]
    if not words:
        return asked.withColumn("handled", F.lit(False))
    taken = activation.handled_branches(turns, asked, local_table(turns.sparkSession, words, "node_id string, word string")).withColumn("handled", F.lit(True))
    return asked.join(taken, ["dialogue_id", "node_id"], "left")


def _with_bare_nodes(spark: SparkSession, graph: Graph) -> DataFrame:
    """The requirements, and for each node that has none a row without one, so that it has a score."""
    bare = [(n["id"], None, 0.0, False, "", False) for n in graph.parts.nodes if not n["requirements"]]
    return graph.requirements.unionByName(local_table(spark, bare, graph.requirements.schema)) if bare else graph.requirements


def _with_conditional(turns: DataFrame, results: DataFrame, graph: Graph) -> DataFrame:
    """``results`` in which requirements that hold for calls that go on are required where no user stops early."""
    stopped = requirements.early_stops(turns).withColumn("stopped", F.lit(True))
    named = F.col("requirement_id").isin(*[r["id"] for n in graph.parts.nodes for r in n["requirements"] if r["conditional"]])
    rows = results.join(stopped, "dialogue_id", "left")
    return rows.select(*[(F.col(c) | (F.coalesce(named, F.lit(False)) & F.col("stopped").isNull())).alias(c) if c == "required" else c for c in results.columns])


def _with_empty_groups(rows: DataFrame, dialogues: DataFrame, graph: Graph) -> DataFrame:
    """``rows`` of members and one inactive member for each group that has none."""
    empty = [(g["id"], g["type"]) for g in graph.parts.groups if not g["nodes"]]
    if not empty:
        return rows
    listed = F.broadcast(local_table(dialogues.sparkSession, empty, "group_id string, group_type string"))
    return rows.unionByName(dialogues.crossJoin(listed).withColumn("active", F.lit(False)), allowMissingColumns=True)


def evaluate(turns: DataFrame, graph: Graph, given_satisfies: bool = False) -> dict[str, DataFrame]:
    """Result tables by name: matches, steps, edges, groups, inner, events, checks, limits, scores.

    given_satisfies: requirements to ask for something hold if the user says it unasked.
    """
    spark = turns.sparkSession
    catalogue = graph.catalogue
    turns = stored(spread(turns.select("dialogue_id", "turn_index", "speaker", "text")))
    spans = stored(atoms(turns))
    settled = stored(matching.settled_windows(spans, catalogue.elements))
    matches = stored(matching.best_matches(settled))
    dialogues = stored(turns.select("dialogue_id").distinct())
    found = stored(nodes.by_dialogue(matches, dialogues))

    # Triggers of nodes: patterns, elements, objects.
    fired = matches.where("verdict = 'hit'").join(F.broadcast(catalogue.nodes.select("node_id", F.col("trigger_rule").alias("rule_id"))), "rule_id").select("dialogue_id", "node_id", "turn_index")
    none = local_table(spark, [], "dialogue_id string, node_id string, pattern_ord int, turn_index int")
    by_pattern, scanned = none, none.drop("pattern_ord")
    listed = []
    for n in graph.parts.nodes:
        for k, p in enumerate(n["activation"]["patterns"]):
            asked = {**p, "speaker": p["speaker"] or "user"}
            if patterns.asks_for_repair(_node_text(n), [*p["any"], *p["all"]]):
                met = patterns.pattern_turns(turns, asked, node_text=_node_text(n)).select("dialogue_id", F.lit(n["id"]).alias("node_id"), F.lit(k).alias("pattern_ord"), "turn_index")
                by_pattern = by_pattern.unionByName(met)
            else:
                listed.append((n["id"], k, asked))
    if listed:
        names = F.broadcast(local_table(spark, [(str(i), node_id, k) for i, (node_id, k, _) in enumerate(listed)], "pattern_id string, node_id string, pattern_ord int"))
        by_pattern = by_pattern.unionByName(patterns.all_turns(turns, [(str(i), p) for i, (_, _, p) in enumerate(listed)]).join(names, "pattern_id").select(*by_pattern.columns))
    objects = [(n["id"], "user", *_object_terms(n["activation"]["object"])) for n in graph.parts.nodes if n["activation"]["object"]]
    if objects:
        listed = local_table(spark, objects, "object_id string, speaker string, direct array<string>, slots array<array<string>>, none array<string>, least int")
        scanned = patterns.scan_objects(turns, listed).where("matched").select("dialogue_id", F.col("object_id").alias("node_id"), "turn_index")
    triggers = stored(activation.first_triggers(by_pattern, fired, scanned))

    raw = nodes.requirement_results(found, _with_bare_nodes(spark, graph))
    clear = raw.where(F.col("matched") & (F.col("score") >= nodes.LOCAL_HIT)).select("dialogue_id", "node_id").distinct()
    if any(r["conditional"] for n in graph.parts.nodes for r in n["requirements"]):
        raw = _with_conditional(turns, raw, graph)
    results = _routed(turns, found, graph, raw, triggers)
    if given_satisfies:
        asked = local_table(spark, [(r["id"], r["text"], [t for g in r["groups"] for e in g["elements"] if e["main"] for t in (e["value"], *e["pool"])]) for n in graph.parts.nodes for r in n["requirements"]], "requirement_id string, text string, terms array<string>")
        given = activation.given_unasked(turns.where("speaker = 'user'").select("dialogue_id", "text"), asked).withColumn("given", F.lit(True))
        rows = results.join(given, ["dialogue_id", "requirement_id"], "left")
        results = rows.select(*[F.when(F.coalesce("given", F.lit(False)), F.lit(1.0 if c == "score" else True)).otherwise(F.col(c)).alias(c) if c in ("score", "matched") else c for c in results.columns])
    results = stored(results)
    scores = stored(nodes.node_scores(results, branches=_branches(turns, triggers, graph)))
    trigger_rows = triggers.select("dialogue_id", "node_id", F.lit("hit").alias("verdict")).join(F.broadcast(catalogue.nodes.select("node_id", F.concat(F.lit("trigger::"), "node_id").alias("rule_id"))), "node_id")
    triggered_nodes = catalogue.nodes.withColumn("trigger_rule", F.concat(F.lit("trigger::"), "node_id"))

    events = policy_events(turns, graph.parts.policies) if graph.parts.policies else local_table(spark, [], "dialogue_id string, policy_id string, trigger_turn int, safe_turn int, forbidden_turn int, status string")
    events = stored(events)
    gone = _suppressed_by_policies(events, found, graph) if graph.parts.policies else None
    steps = nodes.node_results(scores, triggered_nodes, trigger_rows, catalogue.edges, gone, clear)
    reach = nodes.closure(spark, catalogue.edges) if catalogue.ends else None
    if reach is not None:
        ended = nodes.suppressed_by_terminals(steps, catalogue.edges, reach, _asked(triggers, graph))
        gone = ended if gone is None else gone.union(ended).distinct()
        steps = nodes.node_results(scores, triggered_nodes, trigger_rows, catalogue.edges, gone, clear)
    steps = stored(steps)

    edges = relations.edge_results(steps, catalogue.edges)
    members = F.broadcast(graph.members)
    in_groups = ["dialogue_id", "group_id", "group_type", "position", "active", "score", "status", "first_hit_turn"]
    grouped = relations.group_scores(_with_empty_groups(steps.join(members, "node_id").select(*in_groups), dialogues, graph)) if graph.parts.groups else None
    told = relations.group_events(grouped, graph.groups) if grouped is not None else local_table(spark, [], "dialogue_id string, group_id string, relation string, penalty double")
    inner = requirements.relation_penalties(results, graph.relations, steps.select("dialogue_id", "node_id", "active"))
    less = inner.select("dialogue_id", "penalty").unionByName(requirements.context_penalties(events))
    if reach is not None:
        less = less.unionByName(relations.continued_after_end(steps, catalogue.edges, reach).select("dialogue_id", "penalty"))
    less = less.groupBy("dialogue_id").agg(F.sum("penalty").alias("more"))
    related = relations.relation_scores(dialogues, edges, grouped, graph.groups).join(less, "dialogue_id", "left")
    related = related.select("dialogue_id", F.greatest(F.lit(0.0), F.col("relation_score") - F.coalesce("more", F.lit(0.0))).alias("relation_score"))

    checks = stored(_fact_checks(spans, settled, graph)) if graph.parts.facts else local_table(spark, [], "dialogue_id string, fact_id string, severity string, verdict string, turn_index int, correct string, wrong string, selector string")
    limits = stored(_limit_checks(turns, spans, settled, graph))

    active = F.col("active")
    parts = steps.groupBy("dialogue_id").agg(
        (100.0 * F.coalesce(F.avg(F.when(active, F.col("score"))), F.lit(0.0))).alias("node_completion"),
        F.sum((active & (F.col("status") == nodes.MISSING)).cast("int")).alias("missing_nodes"),
        F.sum("missing_required").alias("missing_required"),
        F.sum("n_required").alias("n_required"),
    )
    soft = limits.where("enforcement = 'soft'").groupBy("dialogue_id").agg((100.0 * F.sum(F.coalesce("score", F.lit(0.0)))).alias("soft"), F.count("*").alias("n_soft"))
    n_soft = sum(c["enforcement"] == "soft" and bool(c["global"] or c["metric"].get("type")) for c in graph.parts.constraints)
    problem = events.groupBy("dialogue_id").agg(F.bool_or(F.col("status") != requirements.HANDLED).alias("context_problem"))
    rows = parts.join(related, "dialogue_id").join(soft, "dialogue_id", "left").join(problem, "dialogue_id", "left")
    rows = rows.join(scoring.event_scores(checks.where(F.col("verdict") == judges.CONFLICT), "knowledge"), "dialogue_id", "left")
    rows = rows.join(scoring.event_scores(limits.where((F.col("verdict") == judges.VIOLATION) & (F.col("enforcement") == "hard")), "constraint"), "dialogue_id", "left")
    rows = rows.fillna(100.0, ["knowledge_score", "constraint_score"]).fillna(0, ["knowledge_worst", "constraint_worst", "n_knowledge", "n_constraint"]).fillna(False, ["context_problem"])
    # Soft constraints that a dialogue has no row of are met: metrics make rows only where they are broken.
    full = F.coalesce("soft", F.lit(0.0)) + 100.0 * (n_soft - F.coalesce("n_soft", F.lit(0)))
    rows = rows.withColumn("soft_score", full / n_soft if n_soft else F.lit(100.0)).drop("soft", "n_soft")
    return {"matches": matches, "steps": steps, "requirements": results, "edges": edges, "groups": told, "inner": inner, "events": events, "checks": checks, "limits": limits, "scores": scoring.totals(rows)}


def _object_terms(x: dict) -> tuple[list[str], list[list[str]], list[str], int]:
    """direct terms, slots, veto terms and least slots of a trigger object."""
    words = lambda v: [v] if isinstance(v, str) else [str(t) for t in v] if isinstance(v, list) else [t for k in ("any", "terms", "aliases", "values", "surface_forms") for t in words(v.get(k) or [])] if isinstance(v, dict) else []
    direct = [t for k in ("surface_forms", "semantic_equivalents", "aliases", "canonical", "text") for t in words(x.get(k) or [])]
    listed = x.get("slot_groups") or x.get("required_slots") or x.get("slots") or []
    slots = [s for s in map(words, listed.values() if isinstance(listed, dict) else listed) if s]
    slots += [words(v) for k, v in x.items() if k.endswith(("_terms", "_markers", "_objects", "_actions", "_attributes", "_values")) and words(v)]
    least = int(x.get("min_slot_hits") or x.get("min_required_groups") or len(slots) or 1)
    return direct, slots, words(x.get("none") or x.get("safe_exceptions") or []), least
