"""The llm queries with SQL against it, and the pipeline's stages."""

import duckdb
import pytest

import corpus_pipeline
from skeinflow import scratch
from skeinflow.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, want = queries.QUERIES[name](spark, SF), db.sql(queries.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    order = [want.columns.index(c) for c in columns]
    assert sorted(tuple(str(r[c]) for c in columns) for r in df.collect()) == sorted(tuple(str(r[i]) for i in order) for r in want.fetchall())


def test_stages(spark, edge, nothing):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = scratch.keep(stage(spark, docs, SF), name)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        now = [r["doc_id"] for r in out.select("doc_id").collect()]
        assert len(now) == len(set(now)) and set(now) <= before and len(now) > 0.3 * len(before)
        docs, before = out, set(now)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == before
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, edge, SF).collect()
        assert stage(spark, nothing, SF).count() == 0
