"""D6 on stored reviews: what a merge rewrites, and what it leaves."""

import os

import pytest
from pyspark.sql import functions as F

from weftmix.operators.review import merge_reviews, review_records
from weftmix.sources.review_store import merge_into_store, read_review_store, write_review_store

REVIEW = "review_id string, question_id bigint, answer1_id string, answer2_id string, reviewer_id int, text string, score array<double>"


def reviews(spark, rows):
    df = spark.createDataFrame([(f"r{q}", q, "a", "b", 1, t, s) for q, t, s in rows], REVIEW)
    return df.withColumn("metadata", F.create_map().cast("map<string,string>"))


def files(path):
    out = {}
    for folder, _, names in os.walk(path):
        for n in names:
            if n.endswith(".json"):
                out.setdefault(os.path.relpath(folder, path), set()).add(n)
    return out


def rows(df):
    return sorted(((r["review_id"], r["question_id"], r["text"], tuple(r["score"] or ()), tuple(r["metadata"].items())) for r in df.collect()), key=str)


@pytest.fixture()
def store(spark, tmp_dir):
    first = reviews(spark, [(q, f"text {q} é\n", [float(q % 9), -1.0 if q % 10 == 0 else 2.0]) for q in range(40)] + [(None, None, None), (7, "again", [1.0, 1.0])])
    path = f"{tmp_dir}/store"
    write_review_store(first, path, 8)
    return path, first


def test_only_touched_buckets_are_rewritten(spark, store):
    path, first = store
    before, old = files(path), rows(read_review_store(spark, path))
    assert old == rows(review_records(first)) and all(len(n) == 1 for n in before.values()) and len(before) == 8
    fresh = reviews(spark, [(10, "new 10", [3.0, 4.0]), (20, "new 20", [5.0, 6.0]), (999, "unknown", [1.0, 1.0])])
    merge_into_store(spark, path, fresh)
    assert rows(read_review_store(spark, path)) == rows(merge_reviews(review_records(first), fresh))
    after = files(path)
    changed = {b for b in before if before[b] != after[b]}
    n = lambda q: f"n_buckets=8/bucket={spark.range(1).select(F.pmod(F.xxhash64(F.lit(q).cast('bigint')), F.lit(8))).first()[0]}"
    assert after.keys() == before.keys() and {n(10), n(20)} <= changed <= {n(10), n(20), n(999)}


def test_stopped_and_empty_merges_leave_the_store(spark, store, tmp_dir):
    path, first = store
    before = files(path)
    bad = reviews(spark, [(q, "new", [3.0, 4.0]) for q in range(40)]).withColumn(
        "text", F.when(F.col("question_id") == 33, F.raise_error(F.lit("stopped"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="stopped"):
        merge_into_store(spark, path, bad)
    merge_into_store(spark, path, reviews(spark, []))
    assert files(path) == before and rows(read_review_store(spark, path)) == rows(review_records(first))
    write_review_store(reviews(spark, []), f"{tmp_dir}/none", 8)
    merge_into_store(spark, f"{tmp_dir}/none", reviews(spark, [(1, "x", [1.0, 2.0])]))
    assert read_review_store(spark, f"{tmp_dir}/none").count() == 0
