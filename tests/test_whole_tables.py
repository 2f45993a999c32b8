"""Queries that feed operators from whole tables give DuckDB's rows, and more from a larger table."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from turnweave.plans import queries_whole

NAMES = sorted(x for x in vars(queries_whole) if x.endswith(("_turns", "_documents")))


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(spark, name):
    sizes = []
    for size in ("sf0.001", "sf0.01"):
        at = f"/root/testdata/{size}"
        duck = duckdb.connect()
        for table in ("conversations", "documents"):
            duck.sql(f"CREATE VIEW {table} AS SELECT * FROM '{at}/{table}.parquet'")
        ours, theirs = entry.queries()[name](spark, at).toPandas(), duck.sql(entry.oracle_sql()[name]).df()
        columns = sorted(ours.columns)
        shown = lambda d: sorted(tuple("null" if pd.isna(x) else f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x) for x in r) for r in d[columns].astype(object).itertuples(index=False))  # noqa: E731, B023
        assert columns == sorted(theirs.columns) and shown(ours) == shown(theirs)
        sizes.append(len(ours))
    assert 0 < sizes[0] < sizes[1]
