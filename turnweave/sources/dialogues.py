"""Dialogues from labelled JSON files or from a flat table of turns, and sinks of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of the two speakers, and of the two kinds of samples.
ASSISTANT = ("客服", "assistant", "agent", "bot")
USER = ("用户", "user", "customer")
POSITIVE, NEGATIVE = ("positive", "e0", "perfect", "正包"), ("negative", "负包")

_TURN = "struct<speaker:string,role:string,text:string,content:string>"
#: Everything that is read of a dialogue file; other keys are ignored, missing ones are null.
DIALOGUE = (
    "id string, dialogue_id string, domain string, sample_type string, pack_type string, expected_quality string, quality string, "
    f"turns array<{_TURN}>, dialogue array<{_TURN}>, source_positive_id string, coverage_targets array<string>, "
    "injected_errors array<struct<error_family:string,target_id:string,node_id:string,requirement_id:string,knowledge_id:string,constraint_id:string,"
    "description:string,evidence_span:string,wrong_statement:string,evaluability:string,expected_detector:string>>, "
    "_corrupt_record string"
)


def speaker(role: Column) -> Column:
    role = F.lower(F.trim(role))
    return F.when(role.isin(*ASSISTANT), "assistant").when(role.isin(*USER), "user").otherwise("unknown")


def read_dialogues(spark: SparkSession, path: str) -> DataFrame:
    """One row per dialogue of a file or, recursively, a folder of JSON objects or arrays.

    Files whose name starts with ``graph`` are left out, and so are malformed ones and
    rows without turns.
    """
    raw = spark.read.schema(DIALOGUE).option("multiLine", True).option("recursiveFileLookup", True).option("mode", "PERMISSIVE").json(path)
    raw = raw.withColumn("file", F.col("_metadata.file_path"))
    name = F.regexp_extract("file", r"([^/]+)$", 1)
    turns = F.coalesce("turns", "dialogue")
    # The first name that is not empty counts.
    kind = F.lower(F.coalesce(*[F.when(F.col(x) != "", F.col(x)) for x in ("sample_type", "pack_type", "expected_quality", "quality")]))
    return raw.where(F.col("_corrupt_record").isNull() & ~name.startswith("graph") & turns.isNotNull()).select(
        F.coalesce("id", "dialogue_id", F.regexp_replace(name, r"\.json$", "")).alias("dialogue_id"),
        "domain",
        F.when(kind.isin(*POSITIVE), "positive").when(kind.isin(*NEGATIVE), "negative").otherwise(kind).alias("sample_type"),
        turns.alias("turns"),
        "source_positive_id",
        "coverage_targets",
        "injected_errors",
        "file",
    )


def turns_of(dialogues: DataFrame) -> DataFrame:
    """(dialogue_id, turn_index, speaker, text) of every turn, numbered from 0."""
    each = dialogues.select("dialogue_id", F.posexplode("turns").alias("turn_index", "t"))
    return each.select("dialogue_id", "turn_index", speaker(F.coalesce("t.speaker", "t.role")).alias("speaker"), F.coalesce("t.text", "t.content", F.lit("")).alias("text"))


def turns_of_table(conversations: DataFrame) -> DataFrame:
    """The same of a table (conv_id, turn, role, text)."""
    return conversations.select(
        F.col("conv_id").cast("string").alias("dialogue_id"),
        F.col("turn").cast("int").alias("turn_index"),
        speaker(F.col("role")).alias("speaker"),
        F.coalesce("text", F.lit("")).alias("text"),
    )


def write_tables(tables: dict[str, DataFrame], path: str, partition_by: dict[str, list[str]] | None = None, form: str = "parquet") -> None:
    """Each result table in a folder of its own; nested records become JSON with form="json"."""
    for name, table in tables.items():
        table.write.mode("overwrite").partitionBy(*(partition_by or {}).get(name, [])).format(form).save(f"{path}/{name}")
