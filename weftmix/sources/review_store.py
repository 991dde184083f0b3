"""D6 on stored reviews: JSON-lines files in buckets of questions.

A retry pass changes few reviews. Stored by bucket of the question's hash, only
the buckets that hold a retried question are read and written again, through
Spark's dynamic partition overwrite: new files are staged beside the old ones and
take their place when every task is done, so a run that stops leaves the old
files as they were. The number of buckets is part of the folder's layout:

    <path>/n_buckets=N/bucket=K/part-....json

Defined results: a retried question that the store doesn't hold is left out; no
retried rows write nothing; a null question id has the bucket of its hash, but
meets no retry.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators.review import REVIEW_FIELDS, merge_reviews, review_records
from weftmix.sources.files import REVIEW_SCHEMA

LAYOUT = ["n_buckets", "bucket"]


def _in_buckets(reviews: DataFrame, n: int) -> DataFrame:
    return (reviews.withColumn("n_buckets", F.lit(int(n)))
            .withColumn("bucket", F.pmod(F.xxhash64(F.col("question_id").cast("bigint")), F.lit(int(n))).cast("int")))


def _write(rows: DataFrame, path: str, mode: str) -> None:
    # a bucket's rows meet in one task, which writes one file of it
    (rows.repartition("bucket").sortWithinPartitions("bucket", "question_id").write.mode("overwrite")
     .option("partitionOverwriteMode", mode).option("ignoreNullFields", "false").partitionBy(*LAYOUT).json(path))


def write_review_store(reviews: DataFrame, path: str, buckets: int) -> None:
    """Store ``reviews`` in ``buckets`` files, in place of what ``path`` held."""
    _write(_in_buckets(review_records(reviews), buckets), path, "static")


def _read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{REVIEW_SCHEMA}, n_buckets int, bucket int").option("mode", "FAILFAST").json(path)


def read_review_store(spark: SparkSession, path: str) -> DataFrame:
    """The stored reviews; to be read anew after a merge."""
    return _read(spark, path).drop(*LAYOUT)


def merge_into_store(spark: SparkSession, path: str, fresh: DataFrame) -> None:
    """Put the retried reviews ``fresh`` (``question_id, text, score``) in the
    place of the stored ones; only their buckets are rewritten. ``fresh`` is read
    twice, so a judge's answers are to be written before."""
    stored = _read(spark, path)
    layout = stored.select("n_buckets").first()  # one row: the number of buckets
    if layout is None:
        return
    fresh = _in_buckets(fresh, layout["n_buckets"])
    touched = F.broadcast(fresh.select(F.col("bucket").alias("_b")).distinct())  # at most n_buckets numbers
    old = stored.join(touched, stored["bucket"] == touched["_b"], "left_semi")
    merged = merge_reviews(old.select(*REVIEW_FIELDS, *LAYOUT), fresh.select("question_id", "text", "score"))
    _write(merged, path, "dynamic")
