"""The mix over a stream, byte-balanced shards, part files and exact sums."""

import json
import math
import os
import random

import pytest
from pyspark.sql import functions as F

from weftmix.operators import metrics as M
from weftmix.operators.mixing import mix_spec
from weftmix.sources import files as S
from weftmix.streaming import mix as X
from weftmix.streaming.files import stream_corpus

WEIGHTS = [("a", 2), ("b", 1), ("c", 3)]
ROW = "n bigint, tag string, file_name string"


def arrivals(seed=0):
    r, n, out = random.Random(seed), 0, []
    for k in range(3):
        rows = []
        for tag, size in (("a", 40), ("b", 9), ("c", 50), ("unknown", 3)):
            for _ in range(r.randint(1, size)):
                rows.append({"n": n, "tag": tag, "file_name": f"{k}-{r.randint(0, 4)}"})
                n += 1
        out.append(rows)
    return out


def simulated(batches, world_size, batch_size):
    """A producer per rank that stops when the next tag has nothing yet."""
    ring = [t for t, w in WEIGHTS for _ in range(w)]
    queues = {(r, t): [] for r in range(world_size) for t, _ in WEIGHTS}
    at, files, out = [0] * world_size, {t: 0 for t, _ in WEIGHTS}, []
    slots = [[] for _ in range(world_size)]
    for epoch, rows in enumerate(batches):
        for t, _ in WEIGHTS:
            for name in sorted({x["file_name"] for x in rows if x["tag"] == t}):
                own = sorted(x["n"] for x in rows if x["tag"] == t and x["file_name"] == name)
                queues[files[t] % world_size, t] += own
                files[t] += 1
        for rank in range(world_size):
            while queues[rank, ring[at[rank] % len(ring)]]:
                slots[rank].append(queues[rank, ring[at[rank] % len(ring)]].pop(0))
                at[rank] += 1
            done = len(slots[rank]) // batch_size
            known = {(x[0], x[1]) for x in out}
            out += [(rank, b, s, slots[rank][b * batch_size + s], epoch) for b in range(done) if (rank, b) not in known for s in range(batch_size)]
    return sorted(out)


def run(spark, root, rows, k, world_size=2, batch_size=5, to_features=None):
    d = f"{root}/in/{k}"
    os.makedirs(d)
    with open(f"{d}/part.jsonl", "w") as f:
        f.writelines(json.dumps(x) + "\n" for x in rows)
    resume(spark, root, world_size, batch_size, to_features)


def resume(spark, root, world_size=2, batch_size=5, to_features=None):
    stream = stream_corpus(spark, f"{root}/in/*", ROW, files_per_trigger=1 << 30)
    X.stream_mix(stream, mix_spec(spark, WEIGHTS), f"{root}/state", f"{root}/out", f"{root}/ckpt", world_size, batch_size, ["n"],
                 to_features).awaitTermination()


def result(spark, root):
    return sorted((x["rank"], x["batch_id"], x["slot"], x["n"], x["epoch"]) for x in spark.read.parquet(f"{root}/out").collect())


def test_stream_mix_is_one_schedule_over_restarts(spark, tmp_dir):
    batches = arrivals()
    for k, rows in enumerate(batches):
        run(spark, tmp_dir, rows, k)
    got = result(spark, tmp_dir)
    assert got == simulated(batches, 2, 5) and len(got) > 40
    assert len({x[:3] for x in got}) == len(got)


def test_stream_mix_repeats_a_failed_micro_batch(spark, tmp_dir):
    batches = arrivals(3)

    def fail(rows):
        raise RuntimeError("stopped")
    run(spark, tmp_dir, batches[0], 0)
    with pytest.raises(Exception, match="stopped"):
        run(spark, tmp_dir, batches[1], 1, to_features=fail)
    resume(spark, tmp_dir)
    run(spark, tmp_dir, batches[2], 2)
    assert result(spark, tmp_dir) == simulated(batches, 2, 5)


def test_stream_mix_waits_for_a_missing_subset(spark, tmp_dir):
    run(spark, tmp_dir, [{"n": i, "tag": "a", "file_name": "x"} for i in range(30)], 0)
    assert result(spark, tmp_dir) == []


def test_shards_are_balanced_by_bytes(spark, tmp_dir):
    r = random.Random(1)
    rows = [(i, "x" * r.choice([5, 5, 5, 50, 900])) for i in range(600)] + [(1000, "y" * 40_000), (1001, None)]
    df = spark.createDataFrame(rows, "n bigint, text string").repartition(5)
    placed, n, target = S.place_in_shards(df, 8_000, 3, ["n"])
    size = {x["shard"]: x["b"] for x in placed.groupBy("shard").agg(F.sum(S.record_bytes(df)).alias("b")).collect()}
    longest = 40_008
    assert sum(size.values()) == sum(len(t or "") + 8 for _, t in rows) and max(size.values()) <= target + longest
    small = [b for b in size.values() if b < longest]
    assert max(small) <= target + 908 and max(size) < n
    assert S.write_shuffled_shards(df, f"{tmp_dir}/s", None, 3, ["n"], shard_bytes=8_000) == n
    assert spark.read.json(f"{tmp_dir}/s").count() == len(rows)
    assert S.place_in_shards(df.limit(0), 8_000, 3, ["n"], world_size=2)[0].collect() == []


def test_nothing_of_a_corpus_comes_to_the_driver():
    with open(S.__file__) as f:
        text = f.read()
    assert ".collect()" not in text and "broadcast(" not in text


def test_unchosen_files_are_not_opened(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/c/en")
    for k, line in ((1, "no json"), (2, json.dumps({"n": 2})), (30, json.dumps({"n": 30}))):
        with open(f"{tmp_dir}/c/en/{k}.jsonl", "w") as f:
            f.write(line + "\n")
    rows = S.read_corpus(spark, f"{tmp_dir}/c/en", "n bigint", spec=mix_spec(spark, [("en", 1, 2)]))
    assert sorted(x["n"] for x in rows.collect()) == [2, 30]


def test_places_count_on_over_part_files(spark, tmp_dir):
    for k in range(3):
        with open(f"{tmp_dir}/part-{k}.json", "w") as f:
            f.writelines(json.dumps({"reviewer_id": f"r{k}{i}", "category": "x"}) + "\n" for i in range(k + 1))
    got = {x["reviewer_id"]: x["reviewer_idx"] for x in S.read_eval_table(spark, tmp_dir, S.REVIEWER_SCHEMA).collect()}
    assert got == {"r00": 0, "r10": 1, "r11": 2, "r20": 3, "r21": 4, "r22": 5}


def test_sums_are_exact_in_any_order(spark):
    r = random.Random(6)
    values = [r.uniform(-1, 1) * 10 ** r.randint(-6, 9) for _ in range(5000)] + [1e9, -1e9, 0.1, 0.2, 0.3]
    seen = set()
    for n in (1, 7, 200):
        r.shuffle(values)
        df = spark.createDataFrame([(v,) for v in values], "v double").repartition(n)
        seen.add(df.agg(M.exact_sum(F.col("v")).alias("s")).first()["s"])
    assert seen == {math.fsum(values)}
    one = spark.createDataFrame([(0, float("inf")), (1, None), (2, 1e300), (2, 1.0)], "k int, v double")
    got = {x["k"]: x["s"] for x in one.groupBy("k").agg(M.exact_sum(F.col("v")).alias("s")).collect()}
    assert got == {0: float("inf"), 1: None, 2: 1e300}
