"""Turns as a stream: spans of each turn as it arrives, and dialogues closed by a gap in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnweave.operators.atoms import atoms

TURNS = "dialogue_id string, turn_index int, speaker string, text string, at timestamp"


def read_turns(spark: SparkSession, path: str) -> DataFrame:
    """A stream of JSON lines with turns."""
    return spark.readStream.schema(TURNS).json(path)


def stream_atoms(turns: DataFrame) -> DataFrame:
    """Spans of a stream of turns; no state is kept."""
    return atoms(turns)


def closed_dialogues(turns: DataFrame, gap: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """One row per dialogue that had no turn for ``gap``: its turns in order, ready for evaluation.

    Scores need the whole dialogue (an end found late takes steps back), and so a dialogue
    is evaluated once, when its session has closed.
    """
    session = turns.withWatermark("at", late).groupBy(F.session_window("at", gap).alias("w"), "dialogue_id")
    out = session.agg(F.sort_array(F.collect_list(F.struct("turn_index", "speaker", "text"))).alias("turns"), F.count("*").alias("n_turns"))
    return out.select("dialogue_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n_turns", "turns")
