"""The registered queries over whole small tables."""

import duckdb
import pandas as pd
import pytest

import corpus_pipeline
from turnweave.llm.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    for table in ("pages", "embeddings", "documents"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    ours, theirs = QUERIES[name](spark, SF).toPandas(), con.sql(SQL[name]).df()
    columns = sorted(ours.columns)
    shown = lambda d: sorted(tuple("null" if pd.isna(x) else str(int(x)) if isinstance(x, float) else str(x) for x in r) for r in d[columns].astype(object).itertuples(index=False))
    assert columns == sorted(theirs.columns) and shown(ours) == shown(theirs)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_every_document_or_page_has_rows(spark, name):
    found = QUERIES[name](spark, SF)
    key = found.columns[0]
    table = "pages" if key == "page_id" else "documents"
    assert found.select(key).distinct().count() == spark.read.parquet(f"{SF}/{table}.parquet").count()


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, now, SF)
        assert after.columns == docs.columns, name
        now = after.checkpoint()
        assert 0 < now.count() <= docs.count()
    kept = {r.doc_id for r in now.select("doc_id").collect()}
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == kept


def test_pipeline_of_nothing(spark):
    now = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, SF)
    assert now.count() == 0
