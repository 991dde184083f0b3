"""The closed-form schedule equals a simulated round-robin."""

import random

import pytest
from pyspark.sql import functions as F

from weftmix.operators.indexing import dense_index
from weftmix.operators.mixing import (index_rows, mix_schedule, mix_spec, parse_resume_step, select_files,
                                      shard_files)


def simulate(weights, sizes, steps, batch):
    """The reference's producer loop, literally: cycle the tag list, draw
    the next row of the tag, wrap when exhausted."""
    tags = [t for t, w in weights for _ in range(w)]
    cursor = {t: 0 for t in sizes}
    out, tid = [], 0
    for g in range(steps * batch):
        t = tags[tid]
        if sizes[t] > 0:
            out.append((t, cursor[t], g))
            cursor[t] = (cursor[t] + 1) % sizes[t]
        tid = (tid + 1) % len(tags)
    return out


def run_schedule(spark, weights, sizes, steps, batch, start=0, chunk=4096):
    rows = [(t, "f.jsonl", i) for t, n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(rows, "tag string, file_name string, doc_id long")
    df = df.withColumn("rank", F.lit(0)).withColumn("row_idx", F.col("doc_id"))
    sz = spark.createDataFrame(list(sizes.items()), "tag string, n_rows long")
    df = df.join(sz, "tag")
    out = mix_schedule(df, mix_spec(spark, weights), steps, batch, start, chunk_draws=chunk)
    return sorted((r.tag, r.row_idx, r.global_pos) for r in out.collect())


@pytest.mark.parametrize("seed", range(6))
def test_closed_form_matches_round_robin(spark, seed):
    rnd = random.Random(seed)
    k = rnd.randint(1, 4)
    weights = [(f"t{i}", rnd.randint(1, 5)) for i in range(k)]
    sizes = {t: rnd.randint(1, 12) for t, _ in weights}
    steps, batch = rnd.randint(1, 6), rnd.randint(1, 9)
    got = run_schedule(spark, weights, sizes, steps, batch)
    want = sorted(simulate(weights, sizes, steps, batch))
    assert got == want


def test_resume_skips_batches(spark):
    weights, sizes = [("a", 4), ("b", 4), ("c", 2)], {"a": 7, "b": 3, "c": 1}
    full = run_schedule(spark, weights, sizes, 6, 5)
    resumed = run_schedule(spark, weights, sizes, 6, 5, start=2)
    assert resumed == [r for r in full if r[2] // 5 >= 2]


def test_single_row_subset_repeats(spark):
    got = run_schedule(spark, [("x", 3)], {"x": 1}, 2, 3)
    assert [r[1] for r in got] == [0] * 6


@pytest.mark.parametrize("chunk", [1, 2, 5])
def test_hot_rows_split_into_chunks(spark, chunk):
    # a one-row subset with a large weight: its draws are generated in chunks
    weights, sizes = [("hot", 7), ("cold", 1)], {"hot": 1, "cold": 9}
    want = sorted(simulate(weights, sizes, 5, 4))
    assert run_schedule(spark, weights, sizes, 5, 4, start=0, chunk=chunk) == want
    resumed = run_schedule(spark, weights, sizes, 5, 4, start=2, chunk=chunk)
    assert resumed == [r for r in want if r[2] // 4 >= 2]


def test_hot_row_is_drawn_by_many_tasks(spark):
    """One row with nearly all the draws: its chunks are spread over tasks."""
    df = spark.createDataFrame([("hot", 0, 0, 1), ("cold", 0, 0, 1)], "tag string, rank int, row_idx bigint, n_rows bigint")
    out = mix_schedule(df, mix_spec(spark, [("hot", 9), ("cold", 1)]), 1000, 10, chunk_draws=100)
    hot = out.filter("tag = 'hot'")
    assert hot.count() == 9000 and hot.select(F.spark_partition_id().alias("p")).distinct().count() > 2


def test_parse_resume_step():
    assert parse_resume_step("/out/ckpt_step-1200_loss-2.3456/") == 1200
    assert parse_resume_step(None) == 0


def test_select_and_shard_files(spark):
    files = spark.createDataFrame([("zh", n) for n in ["10001.jsonl", "10017.jsonl", "9.jsonl", "10020.jsonl",
                                                       "10018.txt", "10030.jsonl"]], "tag string, file_name string")
    spec = mix_spec(spark, [("zh", 4, 10017)])
    sel = shard_files(select_files(files, spec), 2)
    got = sorted((r.file_name, r.rank, r.rank_file_ord) for r in sel.collect())
    # lexicographic order: 10017 < 10020 < 10030; 9.jsonl is kept by number (9 < 10017 -> dropped)
    assert got == [("10017.jsonl", 0, 0), ("10020.jsonl", 1, 0), ("10030.jsonl", 0, 1)]


def test_dense_index_balanced_and_exact(spark):
    # one hot group holding most rows, one small group
    df = spark.range(0, 5000).select(F.when(F.col("id") < 4000, "hot").otherwise("cold").alias("g"),
                                     (F.col("id") * 7 % 5000).alias("k"))
    out = dense_index(df, ["g"], ["k"], num_partitions=16).collect()
    by = {}
    for r in out:
        by.setdefault(r.g, []).append((r.k, r.row_idx))
    for g, rows in by.items():
        rows.sort()
        assert [i for _, i in rows] == list(range(len(rows)))


def test_index_rows_concatenates_files_per_rank(spark):
    rows = [("a", f"{f}.jsonl", f * 100 + i) for f in (1, 2, 3, 4) for i in range(3)]
    df = spark.createDataFrame(rows, "tag string, file_name string, doc_id long")
    files = shard_files(df.select("tag", "file_name").distinct(), 2)
    idx = index_rows(df, files, ["doc_id"]).collect()
    got = sorted((r.rank, r.row_idx, r.doc_id, r.n_rows) for r in idx)
    # rank 0 holds files 1 and 3, rank 1 files 2 and 4, in that order
    assert [g[2] for g in got if g[0] == 0] == [100, 101, 102, 300, 301, 302]
    assert [g[1] for g in got if g[0] == 1] == list(range(6))
    assert {g[3] for g in got} == {6}


def test_dense_index_many_groups_path(spark):
    df = spark.range(0, 300).select((F.col("id") % 7).alias("g"), F.col("id").alias("k"))
    out = dense_index(df, ["g"], ["k"], num_partitions=5).collect()
    for g in range(7):
        ks = sorted((r.k, r.row_idx) for r in out if r.g == g)
        assert [i for _, i in ks] == list(range(len(ks)))


def test_bounded_broadcast_falls_back(spark):
    from weftmix.operators.joins import bounded_broadcast, known_rows
    unknown = spark.range(3)
    assert bounded_broadcast(unknown) is unknown                       # left to Catalyst and AQE
    big = known_rows(spark.range(50), 50)
    assert bounded_broadcast(big, max_rows=10) is big
    tagged = known_rows(spark.range(2), 2)
    assert bounded_broadcast(tagged, max_rows=10) is not tagged


def test_size_shuffles(spark):
    from weftmix.session import size_shuffles
    keys = ["spark.sql.shuffle.partitions", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
            "spark.sql.files.maxPartitionBytes"]
    old = {k: spark.conf.get(k) for k in keys}
    try:
        assert size_shuffles(spark, 100 * 1024 ** 4) == 409_600
        assert size_shuffles(spark, 10 * 1024 ** 4) == 40960
        assert size_shuffles(spark, 10) == 8
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_index_rows_position_path_equals_dense_path(spark):
    from weftmix.operators.mixing import file_offsets
    rows = [("a", f"{f}.jsonl", f * 100 + i, i) for f in (1, 2, 3, 4, 5) for i in range(f + 1)]
    df = spark.createDataFrame(rows, "tag string, file_name string, doc_id long, file_pos long")
    files = shard_files(df.groupBy("tag", "file_name").agg(F.count(F.lit(1)).alias("n_file")), 2)
    dense = {(r.doc_id, r.row_idx, r.n_rows) for r in index_rows(df, files.drop("n_file"), ["doc_id"]).collect()}
    fast = {(r.doc_id, r.row_idx, r.n_rows) for r in
            index_rows(df, file_offsets(files), ["doc_id"], pos_col="file_pos").collect()}
    assert dense == fast


def test_dense_index_consistent_when_consumers_prune_differently(spark, tmp_dir):
    """Regression: above the range sampler's sample size, two evaluations of
    the range exchange could choose different bounds; the band join below
    reads the index through two differently pruned branches."""
    from pyspark.sql import Window
    from weftmix.operators.metrics import trailing_mean_records
    rows = spark.range(0, 20000).select(F.lit("r").alias("run"), (F.col("id") % 3).cast("int").alias("rank"),
                                        F.col("id").alias("step"), ((F.col("id") * 7919) % 101 / 10.0).alias("loss"))
    rows.repartition(4).write.parquet(f"{tmp_dir}/m")
    m = spark.read.parquet(f"{tmp_dir}/m")
    got = {(r.rank, r.step): (r.n_rows, round(r.avg_loss, 9)) for r in trailing_mean_records(m, 100, ("loss",)).collect()}
    w = Window.partitionBy("run", "rank").orderBy("step").rowsBetween(-99, 0)
    want = {(r.rank, r.step): (r.n, round(r.a, 9)) for r in
            m.withColumn("a", F.sum("loss").over(w) / 100).withColumn("n", F.count("loss").over(w))
            .filter(F.col("step") % 100 == 0).collect()}
    assert got == want and len(got) == 200


def test_standalone_batch_helpers(spark):
    from weftmix.operators.mixing import (assign_batches, epoch_steps, limit_steps, resume_from,
                                          resume_step_col)
    df = assign_batches(spark.range(0, 25).withColumnRenamed("id", "global_pos"), 10)
    assert sorted({(r.batch_id, r.slot) for r in df.collect()})[-1] == (2, 4)
    assert limit_steps(df, 2).count() == 20
    assert resume_from(df, "/x/ckpt_step-2_loss-1.0000").count() == 5
    p = spark.createDataFrame([("/o/ckpt_step-1200_loss-2.3456",)], "p string")
    assert p.select(resume_step_col("p").alias("s")).first().s == 1200
    idx = spark.createDataFrame([("a", 0, 7), ("b", 0, 2), ("a", 1, 3)], "tag string, rank int, n_rows long")
    # a: ceil(7/4)*6 = 12 slots, b: ceil(2/2)*6 = 6 -> 12 slots / batch 5 -> 3 steps
    assert epoch_steps(idx, mix_spec(spark, [("a", 4), ("b", 2)]), 5) == 3
