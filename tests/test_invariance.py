"""Partition invariance (same result with 1 and many shuffle partitions,
AQE on and off), H12 export and a UDF tokenizer inside the feature builder."""

import json

import pytest
from pyspark.sql import functions as F

from weftmix.functions.chat import conversation_record
from weftmix.operators import examples as ex
from weftmix.operators.external import TokenizerUDF, codepoint_tokenizer_factory
from weftmix.operators.features import make_features
from weftmix.plans import training as T

SF = "/root/testdata/sf0.001"


def _run(spark, parts, aqe):
    old = (spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled"))
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.enabled", str(aqe).lower())
    try:
        return sorted(tuple(r) for r in T.features_report(T.stage1_features(spark, SF)).collect())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old[0])
        spark.conf.set("spark.sql.adaptive.enabled", old[1])


def test_features_partition_invariant(spark):
    import os
    if not os.path.exists(SF):
        pytest.skip("driver test data not present")
    a = _run(spark, 1, False)
    b = _run(spark, 37, True)
    assert a == b and len(a) > 0


def test_conversation_record(spark):
    df = spark.createDataFrame([(7, [(0, "Human", "hi"), (1, "Assistant", None)])],
                               "conv_id long, m array<struct<turn:int,role:string,text:string>>")
    js = df.select(conversation_record(F.lit(""), F.array(F.lit("Human"), F.lit("Assistant")), "m", F.lit(0),
                                       "conv_id", F.lit("human-assistant")).alias("j")).first().j
    obj = json.loads(js)
    assert obj["messages"] == [["Human", "hi"], ["Assistant", None]] and obj["conv_id"] == 7
    assert set(obj) == {"system", "roles", "messages", "offset", "conv_id", "model_name"}


def test_udf_tokenizer_in_features(spark):
    rows = [(0, 0, 0, "lm", "some text here", None, None, None, None),
            (0, 0, 1, "translate", "hello", "bonjour", "P", None, None)]
    df = spark.createDataFrame(rows, "rank int, batch_id long, global_pos long, kind string, input string, "
                                     "output string, prompt string, prompt_pos string, instruction string")
    df = ex.with_prefix(df, 1)
    a = {r.global_pos: (r.input_ids, r.loss_mask) for r in make_features(df, 12).collect()}
    tok = TokenizerUDF(codepoint_tokenizer_factory)
    b = {r.global_pos: (r.input_ids, r.loss_mask) for r in make_features(df, 12, tokenizer=tok).collect()}
    assert a == b


def test_feature_properties(spark):
    import os
    if not os.path.exists(SF):
        pytest.skip("driver test data not present")
    f = T.stage1_features(spark, SF)
    bad = f.filter((F.size("input_ids") != F.size("loss_mask")) | (F.size("input_ids") != F.col("pad_len"))
                   | (F.col("n_target") != F.aggregate("loss_mask", F.lit(0), lambda a, x: a + x))
                   | (F.col("pad_len") > T.MAX_LEN))
    assert bad.count() == 0
    # every batch holds batch_size rows (an epoch of whole batches)
    per_batch = f.groupBy("rank", "batch_id").agg(F.count(F.lit(1)).alias("n")).collect()
    assert {r.n for r in per_batch} == {T.BATCH_SIZE}
