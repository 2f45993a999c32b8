"""Small tables of metadata as local relations."""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType


def local_table(spark: SparkSession, rows: Iterable[tuple], schema: str | StructType) -> DataFrame:
    """A table of a few rows that is part of the plan, without a job of its own."""
    kind = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    rows = list(rows)
    named = [dict(zip(kind.names, (x.asDict(True).values() if hasattr(x, "asDict") else x), strict=True)) for x in rows]
    return spark.createDataFrame(pa.Table.from_pylist(named, schema=to_arrow_schema(kind)))
