"""What the operators of this subpackage share: reading, checkpoints; stored tables and batch bounds come from the sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from turnweave.sources.shared import BATCH_BYTES, BATCH_ROWS, HOT_KEYS, HOT_ROWS, bound_batches, join_counted, shared_folder, stored, stored_with  # noqa: F401

def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` with its lineage cut by files in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)
