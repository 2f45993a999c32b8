"""Rules matched to spans: recall, windows, groups, and the best match of each rule.

The catalogue is broadcast (its size is bounded where it is compiled), spans are not
shuffled for the theta join. From the hits on, everything is keyed by dialogue, and only
spans that were hit take part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from turnweave.functions.text import MODAL_MARKS, any_of, compact, form
from turnweave.operators.atoms import NAMED, SPEAKER, tags
from turnweave.operators.requirements import flat_score
from turnweave.operators.term_index import Term, mark_terms
from turnweave.plans.catalogue import MAX_STATES, ROLES, STATE_BITS
from turnweave.plans.local import local_table
from turnweave.sources.shared import stored

# Factors of windows, in the order in which they are tried.
WINDOWS = (
    ("same_atom", 1.00),
    ("same_turn_adjacent_2", 0.92),
    ("same_turn_adjacent_3", 0.82),
    ("same_speaker_adjacent_turn_2", 0.96),
    ("same_speaker_adjacent_turn_3", 0.90),
)
SPAN = ["dialogue_id", "turn_index", "seq"]


def spot(turn: str = "turn_index", seq: str = "seq") -> Column:
    """A place in a dialogue as one number, in order: aggregates of numbers are hashed, those of structs have to be sorted."""
    return F.shiftleft(F.col(turn).cast("bigint"), 32) + F.col(seq)


def turn_of(place: str) -> Column:
    return F.shiftright(F.col(place), 32).cast("int")


def seq_of(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(2**32 - 1)).cast("int")


def _is_role() -> Column:
    return F.col("type").isin(*ROLES)


def element_terms(elements: DataFrame) -> DataFrame:
    """A row per element and term, with the forms of the term that are compared."""
    each = elements.select("rule_id", "rule_type", "group_id", "element_id", F.explode_outer("forms").alias("t")).where("t IS NOT NULL")
    tight = F.col("t.tight")
    in_order = (F.length(tight) >= 6) & ~tight.rlike(r"(?U)\d") & ~any_of(tight, MODAL_MARKS)
    return each.withColumn("in_order", in_order & (F.col("rule_type") == "node_positive"))


def term_list(rows: list) -> list[Term]:
    """The terms of collected rows of ``element_terms``, in their order; metadata."""
    return [Term(r.t.tight, r.t.rest, tuple(r.t.chars), r.t.exact, r.in_order) for r in rows]


def _said(texts: DataFrame, elements: DataFrame, ordered: bool = False) -> DataFrame:
    """``texts`` (with form) joined with the elements of whose terms one is expressed: rule_id, group_id, element_id, term; a row a term.

    ``ordered``: the characters of a long term may follow each other in gaps.
    """
    rows = element_terms(elements).collect()
    names = [(i, r.rule_id, r.group_id, r.element_id, r.t.tight) for i, r in enumerate(rows)]
    named = F.broadcast(local_table(texts.sparkSession, names, "mark int, rule_id string, group_id string, element_id string, term string"))
    found = mark_terms(texts, term_list(rows), ordered)
    return found.withColumn("mark", F.explode("marks")).drop("marks").join(named, "mark").drop("mark")


def element_hits(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """(span, element) of every hit: an equal general tag, or a term that the text expresses.

    Tags meet elements in a hash join with the broadcast catalogue, if any element is one; the terms of all elements are found in one
    pass over a span.
    """
    names = [*SPAN, "speaker", "rule_id", "group_id", "element_id"]
    tag = F.concat(F.col("type"), F.lit(":"), compact("value")).alias("tag")
    asked = elements.select(tag, "rule_id", "group_id", "element_id").where(F.col("tag").isin(*NAMED) | F.col("tag").startswith(SPEAKER))
    said = _said(atoms.select(*SPAN, "speaker", form("text").alias("form")), elements).select(*names)
    if asked.isEmpty():
        return said.distinct()
    tagged = atoms.select(*SPAN, "speaker", F.explode(tags(F.col("text"), F.col("compact"), F.col("speaker"))).alias("tag"))
    same = tagged.join(F.broadcast(asked), "tag").select(*names)
    return said.union(same).distinct()


def recall(atoms: DataFrame, elements: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """(rule, span): evidence that hits a main element of a rule, or any where a rule has no main one."""
    hits = element_hits(atoms, elements) if hits is None else hits
    plain = elements.where(~_is_role())
    mains = plain.where("main").select("rule_id", "element_id")
    without = plain.groupBy("rule_id").agg(F.max("main").alias("any_main")).where("NOT any_main")
    telling = mains.union(plain.join(F.broadcast(without), "rule_id").select("rule_id", "element_id"))
    found = hits.join(F.broadcast(telling), ["rule_id", "element_id"], "left_semi")
    evidence = atoms.where("is_evidence").select(*SPAN)
    found = found.join(evidence, SPAN, "left_semi").select("rule_id", *SPAN, "speaker").distinct()
    # A rule with a scope takes spans of its speaker; with a fallback, all of a dialogue in which this speaker says nothing.
    scopes = elements.where("scope IS NOT NULL").select("rule_id", "scope", "fallback").distinct()
    rows = found.join(F.broadcast(scopes), "rule_id", "left")
    heard = atoms.select("dialogue_id", F.col("speaker").alias("scope"), F.lit(True).alias("heard")).distinct()
    if scopes.isEmpty():
        return rows.select("rule_id", *SPAN, "speaker")
    rows = rows.join(heard, ["dialogue_id", "scope"], "left")
    own = F.col("scope").isNull() | (F.col("speaker") == F.col("scope")) | (F.col("fallback") & F.col("heard").isNull())
    return rows.where(own).select("rule_id", *SPAN, "speaker")


KEY = ["rule_id", "dialogue_id", "a_turn", "a_seq", "window_ord"]


def with_places(atoms: DataFrame) -> DataFrame:
    """``atoms`` with the place of evidence spans in their turn, how many spans stand near them, and the first of these.

    n_turn: in the turn; near_1, near_2: spans that are no whole turn, of the same speaker,
    at most one and two turns away; first_1 to first_4: the first span (turn, seq) of the windows of several spans.
    All frames lie in one dialogue: one shuffle serves them.
    """
    in_turn = Window.partitionBy("dialogue_id", "turn_index")
    by_speaker = Window.partitionBy("dialogue_id", "speaker").orderBy("turn_index")
    counts, part = F.col("is_evidence").cast("int"), (F.col("span_type") == "atom").cast("int")
    at = spot()
    inside = lambda r: F.min(F.when(F.col("is_evidence"), at)).over(in_turn.orderBy("seq").rowsBetween(-r, 0))
    around = lambda r: F.min(F.when(F.col("span_type") == "atom", at)).over(by_speaker.rangeBetween(-r, r))
    return atoms.repartition("dialogue_id").select(
        "*",
        F.sum(counts).over(in_turn.orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).alias("place"),
        F.sum(counts).over(in_turn).alias("n_turn"),
        F.sum(part).over(by_speaker.rangeBetween(-1, 1)).alias("near_1"),
        F.sum(part).over(by_speaker.rangeBetween(-2, 2)).alias("near_2"),
        *[x.alias(f"first_{i}") for i, x in enumerate((inside(1), inside(2), around(1), around(2)), 1)],
    )


def _evidence(atoms: DataFrame) -> DataFrame:
    return (atoms if "place" in atoms.columns else with_places(atoms)).where("is_evidence")


def windows(candidates: DataFrame, atoms: DataFrame, rules: DataFrame) -> DataFrame:
    """(rule, anchor span, window, factor, size, first): the windows of every candidate; first: their first span.

    Constraints have only the span itself; nodes also spans of the same speaker in
    neighbouring turns. A window of one span is left out. Members are not listed: their
    number follows from the span's place. With a column lead, only anchors with it have windows over several turns.
    """
    lead = F.col("lead") if "lead" in candidates.columns else F.lit(True)
    anchors = candidates.drop("speaker").join(_evidence(atoms), SPAN).join(F.broadcast(rules), "rule_id")
    place, n = F.col("place"), F.col("n_turn")
    around = lambda r: F.least(n, place + r) - F.greatest(F.lit(1), place - r) + 1
    free, node = ~F.col("rule_type").startswith("constraint_"), F.col("rule_type") == "node_positive"
    sizes = [F.lit(1), F.when(free, around(1)), F.when(free, around(2)), F.when(node & lead, F.col("near_1")), F.when(node & lead, F.col("near_2"))]
    firsts = [spot(), *[F.col(f"first_{i}") for i in range(1, 5)]]
    listed = [
        F.when(F.lit(i == 0) | (size > 1), F.struct(F.lit(i).alias("window_ord"), F.lit(name).alias("window"), F.lit(factor).alias("factor"), size.cast("bigint").alias("size"), firsts[i].alias("first")))
        for i, (size, (name, factor)) in enumerate(zip(sizes, WINDOWS, strict=True))
    ]
    out = anchors.select("rule_id", "rule_type", "dialogue_id", F.col("turn_index").alias("a_turn"), F.col("seq").alias("a_seq"), F.col("place").alias("a_place"), F.col("speaker").alias("a_speaker"), F.inline_outer(F.array_compact(F.array(*listed))))
    return out.where("window_ord IS NOT NULL")


def _inside(wins: DataFrame, hits: DataFrame, atoms: DataFrame) -> DataFrame:
    """(rule, anchor, low, high, element, at): elements that a span hits, and the windows of the anchor, low to high, that have the span.

    Rows of windows that do not exist (of one span) may be there: what has the windows leaves these out.
    """
    spans = _evidence(atoms).select(*SPAN, "speaker", "place", "span_type")
    held = hits.select("rule_id", *SPAN, "element_id").join(spans, SPAN)
    # In the anchor's turn, by places. Every anchor has a window of itself.
    anchors = wins.where("window_ord = 0").select("rule_id", "rule_type", "dialogue_id", "a_turn", "a_seq", "a_place")
    near = F.abs(F.col("place") - F.col("a_place"))
    reach = F.when(F.col("rule_type").startswith("constraint_"), 0).otherwise(2)
    pairs = anchors.withColumn("turn_index", F.col("a_turn")).join(held, ["rule_id", "dialogue_id", "turn_index"]).where(near <= reach)
    narrow = pairs.select("rule_id", "dialogue_id", "a_turn", "a_seq", near.cast("int").alias("low"), reach.alias("high"), "element_id", spot().alias("at"))
    # In neighbouring turns of the speaker, by turns: what a turn's spans hit is taken together first. Where the window over three turns
    # is, that over five is too.
    by_turn = held.where("span_type = 'atom'").groupBy("rule_id", "dialogue_id", "speaker", "turn_index", "element_id").agg(F.min("seq").alias("seq"))
    asked = wins.where("window_ord = 4").select(*KEY[:4], F.col("a_speaker").alias("speaker"), F.explode(F.sequence(F.col("a_turn") - 2, F.col("a_turn") + 2)).alias("turn_index"))
    far = F.abs(F.col("turn_index") - F.col("a_turn")) > 1
    wide = asked.join(by_turn, ["rule_id", "dialogue_id", "speaker", "turn_index"]).select(*KEY[:4], F.when(far, 4).otherwise(3).alias("low"), F.lit(4).alias("high"), "element_id", spot().alias("at"))
    return narrow.unionByName(wide)


def _texts(atoms: DataFrame) -> DataFrame:
    """(dialogue_id, a_turn, a_seq or a_speaker, window_ord, joined): the text of each window of several spans, once for all rules."""
    evidence = atoms.where("is_evidence")
    by_turn = Window.partitionBy("dialogue_id", "turn_index").orderBy("seq")
    near = [F.struct(F.lit(r).alias("window_ord"), F.array_join(F.collect_list("text").over(by_turn.rowsBetween(-r, r)), " ").alias("joined")) for r in (1, 2)]
    own = evidence.withColumn("w", F.array(*near)).select("dialogue_id", F.col("turn_index").alias("a_turn"), F.col("seq").alias("a_seq"), F.lit(None).cast("string").alias("a_speaker"), F.inline_outer("w"))
    parts = F.collect_list(F.when(F.col("span_type") == "atom", F.struct("seq", "text")))
    turns = evidence.groupBy("dialogue_id", "speaker", "turn_index").agg(F.transform(F.sort_array(parts), lambda x: x["text"]).alias("parts"))
    by_speaker = Window.partitionBy("dialogue_id", "speaker").orderBy("turn_index")
    far = [F.struct(F.lit(r + 2).alias("window_ord"), F.array_join(F.flatten(F.collect_list("parts").over(by_speaker.rangeBetween(-r, r))), " ").alias("joined")) for r in (1, 2)]
    wide = turns.withColumn("w", F.array(*far)).select("dialogue_id", F.col("turn_index").alias("a_turn"), F.lit(None).cast("int").alias("a_seq"), F.col("speaker").alias("a_speaker"), F.inline_outer("w"))
    return own.unionByName(wide)


def window_hits(wins: DataFrame, hits: DataFrame, atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """(rule, anchor, low, high, element, at, later) of what is hit in the windows low to high of an anchor: by a member, or (later) over
    a window's text (nodes only), then at its first span."""
    inside = _inside(wins, hits, atoms)
    several = wins.where("rule_type = 'node_positive' AND size > 1")
    narrow = F.col("window_ord") <= 2
    place = ["dialogue_id", "a_turn", "window_ord", "t_seq", "t_speaker"]
    of = several.select("rule_id", *place[:3], F.when(narrow, F.col("a_seq")).alias("t_seq"), F.when(~narrow, F.col("a_speaker")).alias("t_speaker"))
    # A text is prepared once for all the rules that ask for it; their number is the catalogue's.
    asked = of.groupBy(*place).agg(F.collect_set("rule_id").alias("rules"))
    texts = _texts(atoms)
    same = (
        (asked["dialogue_id"] == texts["dialogue_id"]) & (asked["a_turn"] == texts["a_turn"]) & (asked["window_ord"] == texts["window_ord"])
        & asked["t_seq"].eqNullSafe(texts["a_seq"]) & asked["t_speaker"].eqNullSafe(texts["a_speaker"])
    )
    prepared = asked.join(texts, same).select(*[asked[c] for c in place], "rules", form("joined").alias("form"))
    over = _said(prepared, elements.where("rule_type = 'node_positive'"), ordered=True).where(F.array_contains("rules", F.col("rule_id")))
    over = over.select("rule_id", "dialogue_id", "a_turn", "window_ord", "t_seq", "t_speaker", "element_id").distinct()
    at = several.select(*KEY, F.when(narrow, F.col("a_seq")).alias("w_seq"), F.when(~narrow, F.col("a_speaker")).alias("w_speaker"), "first")
    back = at.join(over, ["rule_id", "dialogue_id", "a_turn", "window_ord"]).where(F.col("w_seq").eqNullSafe(F.col("t_seq")) & F.col("w_speaker").eqNullSafe(F.col("t_speaker")))
    over_text = back.select(*KEY[:4], F.col("window_ord").alias("low"), F.col("window_ord").alias("high"), "element_id", F.col("first").alias("at"), F.lit(True).alias("later"))
    return inside.withColumn("later", F.lit(False)).unionByName(over_text)


def with_core(elements: DataFrame) -> DataFrame:
    """``elements`` with core (the main ones of a group, else all but roles, else all) and the group's n_clusters."""
    of = Window.partitionBy("group_id")
    plain = ~_is_role()
    some = lambda c: F.max(c.cast("int")).over(of) == 1
    core = F.when(some(F.col("main") & plain), F.col("main") & plain).when(some(plain), plain).otherwise(F.lit(True))
    return elements.withColumn("core", core).withColumn("n_clusters", F.size(F.collect_set("cluster").over(of)))


def _cluster_bits(hit: Column) -> list[Column]:
    """The state that a hit element stands for as a bit, in words of ``STATE_BITS``; few enough are allowed where rules are compiled."""
    number = F.col("cluster")
    words = range(0, MAX_STATES, STATE_BITS)
    return [F.when(hit & (number >= low) & (number < low + STATE_BITS), F.expr(f"shiftleft(1L, cluster - {low})")) for low in words]


def _group_bounds(elements: DataFrame) -> DataFrame:
    """Of each group of ``with_core`` what all its elements come to; metadata."""
    plain, core, w = ~_is_role(), F.col("core"), F.col("weight")
    count = lambda c: F.sum(c.cast("int"))
    return elements.groupBy("rule_id", "rule_type", "group_id", "group_ord", "decisive", "require_all", "hit_main", "hit_group", "review_main", "review_group").agg(
        F.sum(w).alias("all_w"),
        F.sum(F.when(core, w).otherwise(0.0)).alias("all_core_w"),
        count(core).alias("n_core"),
        count(F.col("fact") & plain).alias("n_fact"),
        count(F.col("main") & ~F.col("fact") & plain).alias("n_trunk"),
        count(plain & (F.col("main") | F.col("fact")) & F.col("precise")).alias("n_precise"),
        F.max("n_clusters").alias("n_clusters"),
    )


def group_measures(wins: DataFrame, found: DataFrame, elements: DataFrame) -> DataFrame:
    """Of each (window, group): coverages and missing parts; ``found``: of ``window_hits``, ``elements``: of ``with_core``.

    Windows and hits are dealt once, by dialogue and rule, with few columns; what follows, up to a rule's best window, groups in that
    order. Only hit elements make rows: what a group's elements come to in all is metadata.
    """
    rows = wins.select(*KEY[:4], F.col("window_ord").alias("low"), F.col("window_ord").alias("high"), F.lit("").alias("element_id"), F.col("first").alias("at"), F.lit(False).alias("later"))
    dealt = rows.unionByName(found).repartition("dialogue_id", "rule_id").select(*KEY[:4], F.explode(F.sequence("low", "high")).alias("window_ord"), "element_id", "at", "later")
    first_of = lambda c: F.min(F.when(c, F.col("at")))
    each = dealt.groupBy(*KEY, "element_id").agg(F.coalesce(first_of(~F.col("later")), first_of(F.col("later"))).alias("at"))
    plain, hit, w = ~_is_role(), F.col("element_id") != "", F.col("weight")
    own = elements.select("rule_id", "group_id", "element_id", "element_ord", "weight", "core", "main", "fact", "precise", "cluster", plain.alias("plain"))
    # A window itself is a row of each group of its rule.
    slots = own.unionByName(elements.select("rule_id", "group_id", F.lit("").alias("element_id")).distinct(), allowMissingColumns=True)
    plain = F.col("plain")
    count = lambda c: F.sum(F.when(hit & c, 1).otherwise(0))
    sums = each.join(F.broadcast(slots), ["rule_id", "element_id"]).groupBy(*KEY, "group_id").agg(
        F.max(~hit).alias("there"),
        F.min(F.when(~hit, F.col("at"))).alias("first"),
        F.min_by("at", F.when(hit, F.col("element_ord"))).alias("at"),
        F.sum(F.when(hit, w).otherwise(0.0)).alias("hit_w"),
        F.sum(F.when(hit & F.col("core"), w).otherwise(0.0)).alias("hit_core_w"),
        count(F.col("core")).alias("n_core_hit"),
        count(plain).alias("n_plain_hit"),
        count(F.col("fact") & plain).alias("n_fact_hit"),
        F.coalesce(F.bool_or(F.col("fact") & hit), F.lit(False)).alias("fact_hit"),
        count(F.col("main") & ~F.col("fact") & plain).alias("n_trunk_hit"),
        count(plain & (F.col("main") | F.col("fact")) & F.col("precise")).alias("n_precise_hit"),
        sum((F.bit_count(F.coalesce(F.bit_or(x), F.lit(0).cast("bigint"))) for x in _cluster_bits(hit)), F.lit(0)).alias("n_cluster_hit"),
    )
    of_window = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in WINDOWS]), F.col("window_ord") + 1)
    rows = sums.where("there").join(F.broadcast(_group_bounds(elements)), ["rule_id", "group_id"])
    missing = [(F.col(f"n_{x}") - F.col(f"n_{x}_hit")).alias(f"n_{x}_missing") for x in ("fact", "trunk", "precise")]
    return rows.select(
        *KEY, "rule_type", of_window(0).alias("window"), of_window(1).alias("factor"), "group_id", "group_ord", "decisive", "require_all", "hit_main", "hit_group", "review_main", "review_group",
        "first", "at", (F.col("hit_w") / F.col("all_w")).alias("raw_group"), (F.col("hit_core_w") / F.col("all_core_w")).alias("raw_core"), "n_core", "n_core_hit", "n_plain_hit", "n_fact", "fact_hit",
        *missing, (F.col("n_clusters") - F.col("n_cluster_hit")).alias("n_cluster_missing"),
    )


def group_verdicts(measures: DataFrame) -> DataFrame:
    """``measures`` with main_cov, group_cov, score and verdict; the first rule that applies decides."""
    counted = F.when(F.col("n_core_hit") > 0, F.greatest(F.col("raw_core"), 0.5 + 0.5 * F.col("n_core_hit") / F.col("n_core"))).otherwise(F.col("raw_core"))
    rows = measures.withColumn("raw_main", counted)
    full = F.col("window").startswith("same_turn_adjacent") & (F.col("raw_group") >= 0.999) & (F.col("raw_main") >= 0.999)
    cover = lambda c: F.when(full, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.col(c) * F.col("factor")))
    rows = rows.withColumn("main_cov", cover("raw_main")).withColumn("group_cov", cover("raw_group"))
    rows = rows.withColumn("raw_score", 0.70 * F.col("main_cov") + 0.30 * F.col("group_cov"))
    facts = (F.col("n_fact") > 0) & (F.col("rule_type").startswith("knowledge_") | F.col("rule_type").startswith("constraint_"))
    vetoes = [
        ((F.col("rule_type") == "node_positive") & (F.col("n_precise_missing") > 0), 0.65),
        (facts & (F.col("n_trunk_missing") > 0), 0.7),
        (facts & (F.col("n_fact_missing") > 0), 0.8),
        ((F.col("rule_type") == "node_trigger") & (F.col("n_cluster_missing") > 0), 0.65),
        (F.col("require_all") & (F.col("n_core_hit") < F.col("n_core")), 0.75),
    ]
    said = F.col("n_plain_hit") > 0
    main_ok, group_ok = F.col("main_cov") >= F.col("hit_main"), F.col("group_cov") >= F.col("hit_group")
    grey = (F.col("main_cov") >= F.col("review_main")) & (F.col("group_cov") >= F.col("review_group")) & said
    verdict, score = F.lit(None).cast("string"), F.lit(None).cast("double")
    for holds, share in reversed(vetoes):
        verdict = F.when(holds, F.lit("miss")).otherwise(verdict)
        score = F.when(holds, F.least(F.col("raw_score"), F.col("review_group") * share)).otherwise(score)
    free = F.when(main_ok & said & (facts | group_ok), "hit").when(grey, "review").otherwise("miss")
    return rows.withColumn("verdict", F.coalesce(verdict, free)).withColumn("score", F.coalesce(score, F.col("raw_score")))


def settle(groups: DataFrame, places: int | None = None) -> DataFrame:
    """One row per window: the decisive groups are alternatives, the others support.

    m_turn, m_seq: where the match stands, at the first span that the first hit element of the first group with one meets, otherwise
    at the anchor; first_turn: where the window begins. Groups without places stand at their anchor. With ``places``, scores are rounded
    to so many once the verdict is known: equal ones are ties then, whatever the noise of their sums.
    """
    best = lambda of: F.max(F.when(F.col("decisive") & of, F.col("score")))
    hit, review = F.col("verdict") == "hit", F.col("verdict") == "review"
    placed = "at" in groups.columns
    out = groups.groupBy(*KEY, "rule_type", "window", "hit_group", "review_group", *(["first"] if placed else [])).agg(
        *([F.min_by("at", F.when(F.col("at").isNotNull(), F.col("group_ord"))).alias("at")] if placed else []),
        best(hit).alias("best_hit"),
        best(review).alias("best_review"),
        best(F.lit(True)).alias("best_any"),
        F.avg(F.when(~F.col("decisive"), F.col("score"))).alias("support"),
        *([F.coalesce(F.bool_or(F.col("fact_hit") & hit), F.lit(False)).alias("fact_hit")] if "fact_hit" in groups.columns else []),
    )
    decided = F.coalesce("best_hit", "best_review", "best_any", F.lit(0.0))
    out = out.withColumn("score", F.when(F.col("support").isNotNull(), 0.80 * decided + 0.20 * F.col("support")).otherwise(decided))
    some = F.col("best_hit").isNotNull() | F.col("best_review").isNotNull()
    verdict = F.when(F.col("best_hit").isNotNull() & (F.col("score") >= F.col("hit_group")), "hit").when(some | (F.col("score") >= F.col("review_group")), "review").otherwise("miss")
    out = out.withColumn("verdict", verdict)
    if places is not None:
        out = out.withColumn("score", F.round("score", places))
    if not placed:
        return out.withColumns({"m_turn": F.col("a_turn"), "m_seq": F.col("a_seq"), "first_turn": F.col("a_turn")})
    return out.withColumns({"m_turn": F.coalesce(turn_of("at"), "a_turn"), "m_seq": F.coalesce(seq_of("at"), "a_seq"), "first_turn": turn_of("first")}).drop("at", "first")


def verdict_rank(verdict: Column) -> Column:
    return F.when(verdict == "hit", 3).when(verdict == "review", 2).otherwise(1)


def best_matches(settled: DataFrame) -> DataFrame:
    """(dialogue, rule, verdict, score, turn, seq, window, first_turn): the best window; of equal ones the first by anchors."""
    order = F.struct(verdict_rank(F.col("verdict")), "score", -F.col("a_turn"), -F.col("a_seq"), -F.col("window_ord"))
    kept = F.struct("verdict", "score", F.col("m_turn").alias("turn_index"), F.col("m_seq").alias("seq"), "window", "first_turn")
    return settled.groupBy("dialogue_id", "rule_id", "rule_type").agg(F.max_by(kept, order).alias("m")).select("dialogue_id", "rule_id", "rule_type", "m.*")


def evaluate_windows(wins: DataFrame, hits: DataFrame, atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """One row per (window, group): verdicts of every group of a rule in every window."""
    return group_verdicts(group_measures(wins, window_hits(wins, hits, atoms, elements), with_core(elements)))


def settled_windows(atoms: DataFrame, elements: DataFrame, every: bool = False) -> DataFrame:
    """The verdict of each rule in each window where anything was recalled, with fact_hit: whether a group that was hit has a fact hit.

    Spans, hits and windows are each read several times, with few of their columns: they
    are stored. Windows over several turns are the same for all anchors of a turn: the first one has them, with ``every`` all.
    """
    atoms = stored(with_places(atoms))
    hits = stored(element_hits(atoms, elements))
    rules = elements.select("rule_id", "rule_type").distinct()
    recalled = recall(atoms, elements, hits)
    leads = F.col("seq") == F.min("seq").over(Window.partitionBy("rule_id", "dialogue_id", "turn_index"))
    wins = stored(windows(recalled if every else recalled.withColumn("lead", leads), atoms, rules))
    return settle(evaluate_windows(wins, hits, atoms, elements))


def pool_hits(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """(span, rule_id, term) of the pool terms (all but an element's value) that evidence spans express."""
    pooled = elements.withColumn("forms", F.slice("forms", 2, F.greatest(F.lit(0), F.size("forms") - 1)))
    return _said(atoms.where("is_evidence").select(*SPAN, form("text").alias("form")), pooled).select(*SPAN, "rule_id", "term").distinct()


def flat_matches(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """The best span of each flat rule (elements without groups) in each dialogue: weighted share of its elements, more for pool terms."""
    return flat_matches_with_pools(atoms, elements, pool_hits(atoms, elements))


def flat_matches_with_pools(atoms: DataFrame, elements: DataFrame, pooled_hits: DataFrame) -> DataFrame:
    hits = element_hits(atoms.where("is_evidence"), elements).select(*SPAN, "rule_id", "element_id").withColumn("is_hit", F.lit(True))
    spans = hits.select(*SPAN, "rule_id").distinct()
    own = elements.select("rule_id", "element_id", "weight", _is_role().alias("is_role"), "hit_group", "review_group")
    rows = spans.join(F.broadcast(own), "rule_id").join(hits, [*SPAN, "rule_id", "element_id"], "left").withColumn("is_hit", F.coalesce("is_hit", F.lit(False)))
    pooled = pooled_hits.groupBy(*SPAN, "rule_id").agg(F.count("*").alias("n_pool_hits"))
    rows = rows.join(pooled, [*SPAN, "rule_id"], "left").withColumn("n_pool_hits", F.coalesce("n_pool_hits", F.lit(0).cast("bigint")))
    keyed = rows.withColumn("span_id", F.struct(*SPAN))
    bounds = elements.select("rule_id", "rule_type", "hit_group", "review_group").distinct()
    scored = flat_score(keyed, 0.0, 0.0).drop("verdict").join(F.broadcast(bounds), "rule_id")
    verdict = F.when(F.col("score") <= 0, "miss").when(F.col("score") >= F.col("hit_group"), "hit").when(F.col("score") >= F.col("review_group"), "review").otherwise("miss")
    scored = scored.withColumn("verdict", verdict).select("rule_id", "rule_type", "score", "verdict", "span_id.*")
    order = F.struct(verdict_rank(F.col("verdict")), "score", -F.col("turn_index"), -F.col("seq"))
    kept = F.struct("verdict", "score", "turn_index", "seq", F.lit("same_atom").alias("window"), F.col("turn_index").alias("first_turn"))
    return scored.groupBy("dialogue_id", "rule_id", "rule_type").agg(F.max_by(kept, order).alias("m")).select("dialogue_id", "rule_id", "rule_type", "m.*")


def match_rules(atoms: DataFrame, elements: DataFrame) -> DataFrame:
    """The best match of each rule in each dialogue where anything was recalled: of grouped rules by windows, of flat ones by spans."""
    grouped = best_matches(settled_windows(atoms, elements.where("NOT flat")))
    return grouped.unionByName(flat_matches(atoms, elements.where("flat")))


def scoped(atoms: DataFrame, speaker: str | None, fallback: bool = True) -> DataFrame:
    """The spans of a speaker, None: all; with ``fallback``, all spans of dialogues in which this speaker says nothing."""
    if speaker is None:
        return atoms
    own = atoms.where(F.col("speaker") == speaker)
    if not fallback:
        return own
    return own.unionByName(atoms.join(own.select("dialogue_id").distinct(), "dialogue_id", "left_anti"))


def candidate_audit(settled: DataFrame, k: int = 5) -> DataFrame:
    """(dialogue, rule, place, ...): the ``k`` best windows of each rule in each dialogue, by verdict and score, the first of equal ones.

    ``settled``: of ``settled_windows`` with ``every``, where windows over several turns are to be listed for each of their anchors.
    """
    by = Window.partitionBy("dialogue_id", "rule_id").orderBy(verdict_rank(F.col("verdict")).desc(), F.desc("score"), "a_turn", "a_seq", "window_ord")
    return settled.withColumn("place", F.row_number().over(by)).where(F.col("place") <= k)
