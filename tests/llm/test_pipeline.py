"""The pipeline's stages on their own inputs, and every query's registration."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from tools.oracle_check import TABLES, digest
from weftmix.llm import queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="driver test data not present")


def test_every_operator_is_registered():
    names = entry.queries()
    assert {n.split("_")[0] for n in queries.QUERIES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.QUERIES) | {"pipeline"} <= set(names) and set(queries.ORACLE_SQL) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = queries.QUERIES[name](spark, SF)
    have = digest(df.columns, [tuple(r) for r in df.collect()])
    rel = con.execute(queries.ORACLE_SQL[name])
    cols = [c[0] for c in rel.description]
    want = digest(cols, rel.fetchall())
    assert sorted(df.columns) == sorted(cols) and have[1] == want[1]


def test_stages_keep_columns_and_take_effect(spark, tmp_dir):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(f"{tmp_dir}/{name}")
        docs = spark.read.parquet(f"{tmp_dir}/{name}")
        if name != "pack":
            assert docs.columns == before.columns and docs.dtypes == before.dtypes
            assert docs.select("doc_id").subtract(before.select("doc_id")).isEmpty()
        if name == "near_dedup":
            assert docs.count() < before.count()
            assert docs.count() == queries.simhash.near_duplicates(before).select("component_id").distinct().count()
        if name == "substring_dedup":
            assert docs.count() == before.count()
            kept = {r["doc_id"]: bytes(r["kept"]).decode("utf-8", "ignore") for r in queries.suffix_dedup.dedup(before).collect()}
            assert {r["doc_id"]: r["text"] for r in docs.collect()} == kept
        if name == "decontaminate":
            bad = {r["doc_id"] for r in queries.decontaminate.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect()} - bad
        if name == "pack":
            tokens = docs.groupBy("doc_id").sum("length").collect()
            assert {r["doc_id"] for r in tokens} == {r["doc_id"] for r in before.collect()}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_on_empty_and_null_rows(spark, tmp_dir, name, stage):
    schema = spark.read.parquet(f"{SF}/documents.parquet").schema
    odd = spark.createDataFrame([(None,) * len(schema), (1, "", None, None, 0), (1, "", None, None, 0), (2, None, "en", "s", None)], schema)
    for rows in (odd, odd.limit(0)):
        got = stage(spark, rows, SF)
        n = got.count()
        assert n == 0 if rows is not odd else n >= 0
