"""Packs of dialogues: which are evaluated, in what order, what binds them to a graph, and what a run leaves behind."""

from __future__ import annotations

import json
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.functions.loose_json import read_any, records_with
from turnweave.functions.text import clip
from turnweave.operators.ledger import domain_scores
from turnweave.sources.dialogues import write_tables

# The least lead of a domain's score over the second.
LEAD = 1.45
HINTS = 64
ANSWER = ["file", "candidate_id", "verdict", "confidence", "reason", "problem"]


def pack_folder(base: str, sample_type: str | None) -> str:
    """The folder of a pack below a base folder, or the base itself."""
    own = Path(base) / f"{sample_type}_pack"
    return str(own) if sample_type in ("positive", "negative") and own.exists() else base


def selected(dialogues: DataFrame, sample_type: str | None = None, domain: str | None = None, graph_text: str = "", limit: int | None = None) -> DataFrame:
    """The dialogues of a pack and of one domain: the named one if there is any of it, otherwise the one that is clearly most like the
    graph's text, otherwise all; the first ``limit`` by file."""
    rows = dialogues
    if sample_type:
        rows = rows.where(F.lower("sample_type") == sample_type)
    if domain and not rows.where(F.col("domain") == domain).isEmpty():
        rows = rows.where(F.col("domain") == domain)
    elif graph_text:
        texts = rows.select("domain", F.col("file").alias("place"), F.array_join(F.transform("turns", lambda t: F.coalesce(t["text"], t["content"], F.lit(""))), " ").alias("text"))
        best = domain_scores(texts, graph_text, first=24, lead=LEAD).where("selected").select("domain")
        if not best.isEmpty():
            rows = rows.join(F.broadcast(best), "domain", "left_semi")
    return rows.orderBy("file", "dialogue_id").limit(limit) if limit is not None else rows


def binding_hints(rows: DataFrame, most: int = HINTS) -> DataFrame:
    """(target_node, target_id, target_kind, sample_types, error_families, n): the targets that labels name, those of positive
    samples first, at most ``most``. ``rows``: these columns for each label, with sample_type and error_family."""
    named = rows.where("coalesce(target_node, '') <> '' OR coalesce(target_id, '') <> ''")
    blank = lambda c: F.coalesce(F.col(c), F.lit(""))
    some = lambda c, k: F.array_join(F.slice(F.array_sort(F.collect_set(F.when(blank(c) != "", clip(c, 160)))), 1, k), ",")
    out = named.groupBy(*[blank(c).alias(c) for c in ("target_node", "target_id", "target_kind")]).agg(some("sample_type", 4).alias("sample_types"), some("error_family", 6).alias("error_families"), F.count("*").alias("n"))
    return out.orderBy(F.when(F.contains("sample_types", F.lit("positive")), 0).otherwise(1), "target_node", "target_id", F.desc("n"), "target_kind").limit(most)


def read_text(path: str) -> str:
    return Path(path).read_text(encoding="utf-8")


def write_text(path: str, text: str) -> None:
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    Path(path).write_text(text, encoding="utf-8")


def write_run(spark: SparkSession, folder: str, tables: dict[str, DataFrame], info: dict) -> None:
    """The tables of a run, a folder each, records of dialogues by domain and sample type, and ``info`` as a manifest."""
    parts = {name: [c for c in ("domain", "sample_type") if c in table.columns] for name, table in tables.items()}
    write_tables(tables, folder, {k: v for k, v in parts.items() if v})
    manifest = json.dumps({**info, "tables": sorted(tables)}, ensure_ascii=False, indent=2)
    spark.createDataFrame([(manifest,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/manifest")


def replayed_answers(spark: SparkSession, folder: str) -> DataFrame:
    """(candidate_id, verdict, confidence, reason) of recorded answers: JSON files of a folder, one answer or an array of them each."""
    schema = "candidate_id string, verdict string, confidence double, reason string"
    return spark.read.schema(schema).option("multiLine", True).json(folder).where("candidate_id IS NOT NULL")


def _share(x) -> float | None:
    """A confidence as a number, or null."""
    try:
        return float(x)
    except (TypeError, ValueError):
        return None


def parsed_answers(rows: DataFrame) -> DataFrame:
    """(file, candidate_id, verdict, confidence, reason, problem) of raw answers (file, raw) as models wrote them.

    Each text is read in the tasks by the tolerant reader; it may hold one answer or many, in any wrapper. A text without an answer
    gives one row with its problem, so that none is lost; empty and null texts are such texts.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text = lambda x: x if x is None or isinstance(x, str) else json.dumps(x, ensure_ascii=False)
        for batch in batches:
            out = []
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                try:
                    found = records_with(read_any(raw.as_py() or ""), "candidate_id")
                    problem = None if found else "no answer in the JSON"
                except ValueError as error:
                    found, problem = [], str(error)
                out += [(file, text(x["candidate_id"]), text(x.get("verdict")), _share(x.get("confidence")), text(x.get("reason")), None) for x in found]
                if not found:
                    out.append((file, None, None, None, None, problem))
            columns = list(zip(*out)) if out else [()] * 6
            kinds = (pa.string(),) * 3 + (pa.float64(),) + (pa.string(),) * 2
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=ANSWER)

    schema = ", ".join(f"{name} {'double' if name == 'confidence' else 'string'}" for name in ANSWER)
    return rows.select(F.col("file").cast("string"), F.col("raw").cast("string")).mapInArrow(read, schema)


def raw_answers(spark: SparkSession, folder: str) -> DataFrame:
    """``parsed_answers`` of the text files of a folder, one answer or several each; a file is one row and read as a whole.

    A file of no bytes is none to Spark's readers, and gives no row.
    """
    files = spark.read.text(folder, wholetext=True, recursiveFileLookup=True)
    return parsed_answers(files.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw")))


def case_pages(spark: SparkSession, records: DataFrame, folder: str) -> None:
    """An HTML page a dialogue, as text files written where the rows are: dialogue_id, title and lines (array of strings)."""
    escape = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    body = F.array_join(F.transform("lines", lambda x: F.concat(F.lit("<p>"), escape(x), F.lit("</p>"))), "\n")
    page = F.concat(F.lit("<!doctype html><meta charset='utf-8'><h1>"), escape(F.col("title")), F.lit("</h1>\n"), body)
    records.select("dialogue_id", page.alias("page")).write.mode("overwrite").partitionBy("dialogue_id").text(folder)
