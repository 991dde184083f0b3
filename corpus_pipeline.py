"""Corpus pipeline: quality filter, near-dedup, exact substring dedup,
benchmark decontamination and packing over the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes
it as Parquet to the shared folder and reads it back as the next stage's
``docs``. All stages but the last return the columns of ``documents``.

Defined results: null or empty texts pass through the stages as each
operator's text says; an empty table gives no rows; columns beyond those of
``documents`` are carried along up to the last stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from weftmix.llm import decontaminate, packing, quality_cnn, simhash, suffix_dedup
from weftmix.session import scratch_path


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The last stage: one row per packed piece."""
    return packing.pack(docs, with_ids=False).drop("ids")


STAGES = [
    ("quality", quality_cnn.keep_good),
    ("near_dedup", simhash.keep_one),
    ("substring_dedup", suffix_dedup.strip_repeats),
    ("decontaminate", decontaminate.drop_contaminated),
    ("pack", pack_tokens),
]

#: The learned stage can't be expressed in SQL; tests hold the stages against
#: brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed pieces of the documents that all stages kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
