"""Every query with SQL gives the rows that DuckDB gives."""

import duckdb
import pandas as pd
import pytest

from turnweave.plans import queries_graph, queries_more  # noqa: F401  they register their queries beside the others
from turnweave.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    def shown(x):
        if pd.isna(x):
            return "null"
        return f"{float(x):.6f}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)

    return sorted(tuple(shown(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for table in TABLES:
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return connection


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_and_sql_agree(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns)
    assert rows(ours, columns) == rows(theirs, columns)


def test_evaluation_keeps_every_dialogue_and_the_bounds(spark):
    found = QUERIES["e1_evaluate"](spark, SF).toPandas()
    turns = pd.read_parquet(f"{SF}/conversations.parquet")
    assert sorted(found["dialogue_id"]) == sorted(turns["conv_id"].astype(str).unique())
    assert found["total"].between(0, 100).all()
    spark.catalog.clearCache()
