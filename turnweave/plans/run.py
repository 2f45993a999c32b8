"""A whole run from dialogues to decisions, which can be resumed.

Results are addressed by what they are results of: the version of the graph and the digest of a dialogue. A run reads which digests
have results, evaluates the others, once for all dialogues of equal content, and writes them as a batch; a batch counts from the
moment its last table, ``done``, is there, so that a run that died leaves nothing that is read. Everything behind the evaluation
(acceptance, candidates, second filter, budget, arbitration, decisions) is worked out from the stored results.

    {folder}/graph={version}/{table}/batch={batch}        results of the evaluation, by digest
    {folder}/graph={version}/done/batch={batch}           (digest) of a complete batch
    {folder}/answers/batch={batch}                        answers to candidates, by the digest of what was asked
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators import acceptance, candidates, judges, ledger, routing
from turnweave.plans.evaluate import evaluate
from turnweave.plans.graph import Graph
from turnweave.sources.shared import join_counted, stored, stored_with

#: Tables of an evaluation that are kept.
KEPT = ("scores", "steps", "requirements", "edges", "groups", "events", "checks", "limits")
#: Candidates that are asked for at a time; what was answered before a failure is kept.
CHUNK = 64
# Candidates of a dialogue and of a run, the anchor score of bound candidates, and how evidence is measured.
PER_DIALOGUE, BUDGET, ANCHOR = 3, 24, 0.82
EVIDENCE_MOST, EVIDENCE_LEAST, EVIDENCE_CHARS = 0.86, 0.25, 1800.0
PRIORITY = {"both": 0.22, "near": 0.12, "alone": 0.06, "weak": -0.10}


def dialogue_digests(turns: DataFrame) -> DataFrame:
    """(dialogue_id, digest, n_turns) of dialogues by what is said in them.

    Sums of hashes of turns, each with its place, so that a long dialogue is added up in parts and never held as a whole.
    """
    each = lambda seed: F.xxhash64(F.lit(seed), "turn_index", "speaker", "text")
    sums = [F.sum(each(seed).cast("decimal(20,0)")) for seed in (1, 2)]
    rows = turns.groupBy("dialogue_id").agg(F.count("*").alias("n_turns"), *[x.alias(f"_s{k}") for k, x in enumerate(sums)])
    return rows.select("dialogue_id", F.sha2(F.concat_ws(":", "n_turns", "_s0", "_s1"), 256).alias("digest"), "n_turns")


def _new_batch() -> str:
    return f"{time.time_ns():020d}-{uuid.uuid4().hex[:8]}"


class Store:
    """The folder of results of one graph version; any path that Spark reads and writes."""

    def __init__(self, spark: SparkSession, folder: str, version: str):
        self.spark, self.root = spark, f"{folder}/graph={version}"

    def _batches(self, table: str) -> list[str]:
        """The names of batches that have the table complete: few, one a run."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return []
        complete = [x.getPath() for x in files.listStatus(path) if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(x.getPath(), "_SUCCESS"))]
        return sorted(x.getName().removeprefix("batch=") for x in complete)

    def _read(self, table: str) -> DataFrame | None:
        batches = self._batches("done")
        if not batches:
            return None
        return self.spark.read.option("basePath", f"{self.root}/{table}").parquet(*[f"{self.root}/{table}/batch={b}" for b in batches])

    def done(self) -> DataFrame | None:
        """(digest, batch): of digests that two runs evaluated at the same time, the first batch."""
        rows = self._read("done")
        return None if rows is None else rows.groupBy("digest").agg(F.min("batch").alias("batch"))

    def write(self, tables: dict[str, DataFrame], digests: DataFrame) -> None:
        """Write ``tables`` as a batch, by the digest that ``digests`` (dialogue_id, digest) has for their dialogues."""
        batch = _new_batch()
        for name, table in tables.items():
            table.join(digests.select("dialogue_id", "digest"), "dialogue_id").drop("dialogue_id").write.parquet(f"{self.root}/{name}/batch={batch}")
        digests.select("digest").write.parquet(f"{self.root}/done/batch={batch}")

    def table(self, name: str) -> DataFrame:
        """A table of all complete batches, by digest in the column dialogue_id."""
        rows = self._read(name)
        return rows.join(self.done(), ["digest", "batch"], "left_semi").drop("batch").withColumnRenamed("digest", "dialogue_id")


def evaluate_missing(turns: DataFrame, digests: DataFrame, graph: Graph, store: Store) -> int:
    """Evaluate what has no results yet and return how many digests that were; without any no evaluation is started.

    One dialogue of each digest is evaluated, by its own id: that of a digest is long, and would be in every row that is shuffled.
    """
    done = store.done()
    wanted = digests.groupBy("digest").agg(F.min("dialogue_id").alias("dialogue_id"))
    wanted, seen = stored_with(wanted if done is None else wanted.join(done, "digest", "left_anti"), F.count("*").alias("n"))
    if not seen["n"]:
        return 0
    fresh = turns.join(wanted, "dialogue_id", "left_semi").select("dialogue_id", "turn_index", "speaker", "text")
    found = evaluate(fresh, graph)
    store.write({name: found[name] for name in KEPT}, wanted)
    return seen["n"]


# ------------------------------------------------------------------ behind the evaluation


def _evidence(rows: DataFrame, turns: DataFrame) -> DataFrame:
    """``rows`` with evidence: the text of their turn."""
    said = turns.select("dialogue_id", "turn_index", F.col("text").alias("evidence"))
    return rows.join(said, ["dialogue_id", "turn_index"], "left")


def open_candidates(checks: DataFrame, limits: DataFrame, turns: DataFrame) -> DataFrame:
    """The grey-zone candidates of each dialogue, at most ``PER_DIALOGUE``, with what the second filter asks for.

    ``turns``: of the dialogues that ``checks`` and ``limits`` name.
    """
    facts = _evidence(checks, turns).withColumnsRenamed({"correct": "positive", "wrong": "negative"})
    bounds = _evidence(limits, turns).withColumns({"positive": F.lit(None).cast("string"), "negative": F.lit(None).cast("string")})
    sides = facts.select("dialogue_id", F.col("fact_id").alias("target"), "positive", "negative")
    rows = candidates.all_candidates(candidates.of_facts(facts), candidates.of_constraints(bounds)).join(sides, ["dialogue_id", "target"], "left")
    rows = rows.withColumn("source", F.lit("local")).withColumn("route_key", F.concat_ws("\x1f", "kind", "target", F.array_join("evidence", "\x1e")))
    rows = routing.top_per_dialogue(rows, PER_DIALOGUE).drop("place")
    said = facts.select("dialogue_id", F.lit("knowledge_violation").alias("family"), "verdict", "evidence").unionByName(bounds.select("dialogue_id", F.lit("constraint_violation").alias("family"), "verdict", "evidence"))
    rows = ledger.same_evidence(rows, said)
    text = F.length(F.array_join("evidence", "\n"))
    measured = F.when(F.size("evidence") > 0, F.least(F.lit(1.0), F.greatest(F.least(F.lit(EVIDENCE_MOST), EVIDENCE_LEAST + text / EVIDENCE_CHARS), F.col("strength")))).otherwise(0.0)
    return rows.withColumns(
        {
            "schema_score": F.lit(ANCHOR), "evidence_score": measured, "has_evidence": F.size("evidence") > 0, "open_set": F.lit(False), "promoted": F.lit(False),
            "same_support": F.col("relation") == "support", "insufficient_only": F.lit(False),
        }
    )


def _priority(rows: DataFrame) -> Column:
    """How much an answer can tell: a collision of both sides before a weak one."""
    positive, negative = F.coalesce("positive", F.lit("")), F.coalesce("negative", F.lit(""))
    both, near = (positive == "hit") & (negative == "hit"), (negative == "review") & positive.isin("hit", "review")
    extra = F.when(both, PRIORITY["both"]).when(near, PRIORITY["near"]).when(negative == "review", PRIORITY["alone"]).otherwise(0.0)
    return F.col("margin") + extra + F.when((positive == "review") & negative.isin("miss", ""), PRIORITY["weak"]).otherwise(0.0)


def routed_candidates(found: DataFrame, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """All candidates with decision and merged_into, and those of them that the budget sends to an arbiter."""
    filtered = stored(routing.second_filter(found))
    sent = filtered.where("decision = 'route_to_arbiter'").withColumn("priority", -_priority(filtered))
    merged = stored(routing.representatives(sent))
    # A rank is any value in order: no numbering of all rows, which would be one task's work.
    ranked = merged.where("merged_into IS NULL").withColumn("rank", F.struct("priority", "candidate_id"))
    chosen = routing.diverse_budget(ranked, budget, ["family", "target"])
    out = filtered.join(merged.select("candidate_id", "merged_into"), "candidate_id", "left")
    return out, chosen


def content_key(rows: DataFrame) -> DataFrame:
    """``rows`` with asked: the digest of what an arbiter is asked, which two dialogues may share."""
    return rows.withColumn("asked", F.sha2(F.concat_ws("\x1f", "kind", "target", F.array_join("evidence", "\x1e")), 256))


def answers_of(spark: SparkSession, folder: str) -> DataFrame | None:
    """(asked, verdict, confidence, failure) of all recorded answers; of two, the surer one."""
    held = Store(spark, folder, "")
    held.root = folder
    batches = held._batches("answers")
    if not batches:
        return None
    rows = spark.read.parquet(*[f"{folder}/answers/batch={b}" for b in batches])
    best = rows.groupBy("asked").agg(F.max_by(F.struct("verdict", "confidence", "failure"), F.struct("confidence", "verdict")).alias("a"))
    return best.select("asked", "a.*")


def ask_once(chosen: DataFrame, arbiter: Callable[[list[dict]], list[dict]], folder: str, chunk: int = CHUNK) -> int:
    """Ask the arbiter for candidates without a recorded answer, and record the answers; returns how many were asked for.

    Candidates of equal content are asked for once. They are asked for in chunks, each written before the next is begun, so that what
    was answered stays where a later call, task or run fails. A call that failed is recorded with its reason and asked again by the next run.
    """
    spark = chosen.sparkSession
    known = answers_of(spark, folder)
    rows = content_key(chosen).groupBy("asked").agg(F.min_by(F.struct("kind", "target", "evidence"), "candidate_id").alias("c")).select("asked", F.col("asked").alias("candidate_id"), "c.*")
    rows = rows if known is None else rows.join(known.where("failure IS NULL"), "asked", "left_anti")
    open_, seen = stored_with(rows.withColumn("place", F.monotonically_increasing_id()), F.count("*").alias("n"))
    n = seen["n"] or 0
    chunks = -(-n // chunk)
    # The number of chunks is the budget's, not the corpus's.
    for k in range(chunks):
        part = open_.where(F.pmod(F.xxhash64("asked"), F.lit(chunks)) == k)
        answers = routing.arbitrate(part, arbiter).withColumnRenamed("candidate_id", "asked")
        answers.write.parquet(f"{folder}/answers/batch={_new_batch()}")
    return n


def acceptances(scores: DataFrame, steps: DataFrame, checks: DataFrame, limits: DataFrame) -> DataFrame:
    """dialogue_id, total, passed, reasons and decision of dialogues as positive samples.

    decision: accepted; blocked by a conflict, a violation or an unhandled policy; otherwise incomplete.
    """
    bad = checks.where(F.col("verdict") == judges.CONFLICT).select("dialogue_id").unionAll(limits.where((F.col("verdict") == judges.VIOLATION) & (F.col("enforcement") == "hard")).select("dialogue_id"))
    rows = scores.join(bad.groupBy("dialogue_id").agg(F.count("*").alias("n_bad")), "dialogue_id", "left").withColumn("n_bad", F.coalesce("n_bad", F.lit(0)))
    if "missing_required" not in rows.columns:
        rows = rows.join(steps.groupBy("dialogue_id").agg(F.sum("missing_required").alias("missing_required")), "dialogue_id")
    out = acceptance.positive_passes(rows.withColumn("scenario", F.lit(False)))
    decision = F.when(F.col("passed"), "accepted").when((F.col("n_bad") > 0) | F.col("context_problem"), "blocked").otherwise("incomplete")
    return out.select("dialogue_id", "total", "passed", "reasons", decision.alias("decision"))


def labelled(errors: DataFrame, checks: DataFrame, limits: DataFrame, turns: DataFrame) -> DataFrame:
    """(dialogue_id, n_expected, n_matched, n_unexpected, passed) of dialogues with planted errors (dialogue_id, error_id, family, target_id, span, eligible)."""
    part = lambda rows, family, target, verdict: _evidence(rows.where(F.col("verdict") == verdict), turns).select(
        "dialogue_id", F.lit(family).alias("family"), F.col(target).alias("event_target"), F.array().cast("array<string>").alias("aliases"), "evidence"
    )
    events = part(checks, "knowledge", "fact_id", judges.CONFLICT).unionByName(part(limits.where("enforcement = 'hard'"), "constraint", "constraint_id", judges.VIOLATION))
    concerned = events.join(errors.select("dialogue_id").distinct(), "dialogue_id", "left_semi")
    return acceptance.negative_passes(acceptance.reconcile(errors, events), acceptance.unexpected(errors, concerned))


def by_dialogue(digests: DataFrame, results: DataFrame) -> DataFrame:
    """``results`` (one row a digest, in dialogue_id) for every dialogue; a digest that many dialogues share is dealt to many tasks."""
    counted, seen = stored_with(digests.groupBy("digest").agg(F.count("*").alias("n")), F.sum("n").alias("rows"), F.max("n").alias("most"))
    classes = stored(results.withColumnRenamed("dialogue_id", "digest").join(counted, "digest"))
    return join_counted(digests, classes, ["digest"], ["dialogue_id"], seen["rows"] or 0, seen["most"] or 0).drop("digest", "n")


def run(turns: DataFrame, graph: Graph, version: str, folder: str, arbiter: Callable[[list[dict]], list[dict]] | None = None, errors: DataFrame | None = None, budget: int = BUDGET) -> dict[str, DataFrame | int]:
    """A run over ``turns``: results by name, and how many dialogues were evaluated and candidates asked for.

    decisions: a row a dialogue; candidates: with their decisions, merged_into and recorded answers, by digest in dialogue_id; ledger: all that
    was judged; labelled: of dialogues with planted ``errors`` (dialogue_id as in ``turns``), if any are given.
    """
    spark = turns.sparkSession
    turns = stored(turns.select("dialogue_id", "turn_index", "speaker", "text"))
    digests = stored(dialogue_digests(turns).drop("n_turns"))
    store = Store(spark, folder, version)
    n = evaluate_missing(turns, digests, graph, store)
    one = digests.groupBy("digest").agg(F.min("dialogue_id").alias("dialogue_id"))
    # The store may hold more than this run's dialogues.
    tables = {name: store.table(name).join(one.select(F.col("digest").alias("dialogue_id")), "dialogue_id", "left_semi") for name in KEPT} if n or store.done() is not None else None
    if tables is None:
        return {"evaluated": 0, "asked": 0}
    said = turns.join(one, "dialogue_id").select(F.col("digest").alias("dialogue_id"), "turn_index", "speaker", "text")
    accepted = acceptances(tables["scores"], tables["steps"], tables["checks"], tables["limits"])
    found, chosen = routed_candidates(open_candidates(tables["checks"], tables["limits"], said), budget)
    asked = ask_once(stored(chosen), arbiter, folder) if arbiter is not None else 0
    answers = answers_of(spark, folder)
    keyed = content_key(found)
    if answers is not None:
        keyed = keyed.join(answers.select("asked", F.col("verdict").alias("answer"), "confidence"), "asked", "left")
    out = {
        "decisions": by_dialogue(digests, accepted),
        "candidates": keyed,
        "ledger": ledger.evidence_ledger(tables["checks"], tables["limits"], tables["events"], tables["steps"]),
        "losses": ledger.losses(tables["steps"], tables["edges"], tables["checks"], tables["limits"]),
        "evaluated": n,
        "asked": asked,
    }
    if errors is not None:
        own = lambda rows: digests.join(rows.withColumnRenamed("dialogue_id", "digest"), "digest").drop("digest")
        out["labelled"] = labelled(errors, own(tables["checks"]), own(tables["limits"]), turns)
    return out
