"""Calls in flight under one rate, and answers that outlive their tasks."""

import os
import threading
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from weftmix.operators.external import judge, judge_stored, stored_answers

NO_WAIT = {"gap": 0.0, "retry_wait": 0.0}


def requests(spark, n):
    return spark.range(n).select(F.col("id").alias("question_id"), F.lit("s").alias("system_prompt"),
                                 F.concat(F.lit("p"), F.col("id")).alias("prompt"), F.lit(9).alias("max_tokens"))


def counted(folder, answer=lambda p: f"answer to {p}"):
    """A judge that leaves one file per call."""
    def factory():
        def call(s, p, m):
            with open(f"{folder}/{p}-{time.time_ns()}-{os.getpid()}", "w"):
                pass
            return answer(p)
        return call
    return factory


def calls(folder):
    return Counter(f.split("-")[0] for f in os.listdir(folder))


def test_calls_in_flight_are_bounded(spark):
    def factory():
        lock, now = threading.Lock(), [0]

        def call(s, p, m):
            with lock:
                now[0] += 1
                seen = now[0]
            time.sleep(0.2)
            with lock:
                now[0] -= 1
            return f"{p} {seen}"
        return call
    rows = judge(requests(spark, 12), factory, partitions=1, in_flight=4, **NO_WAIT).collect()
    assert all(r["text"].split()[0] == r["prompt"] for r in rows) and len(rows) == 12
    assert max(int(r["text"].split()[1]) for r in rows) == 4


def test_rate_holds_with_calls_in_flight_and_retries(spark):
    def factory():
        tried = set()

        def call(s, p, m):
            now = time.time()
            if p not in tried:
                tried.add(p)
                raise RuntimeError(f"{now}")
            time.sleep(0.5)
            return f"{now}"
        return call
    rows = judge(requests(spark, 4), factory, gap=0.3, retry_wait=0.0, partitions=1, in_flight=4).collect()
    starts = sorted(float(r["text"]) for r in rows)
    assert all(b - a >= 0.25 for a, b in zip(starts, starts[1:], strict=False))


def test_killed_task_repeats_no_answered_call(spark, tmp_dir):
    log, store, marker = f"{tmp_dir}/calls", f"{tmp_dir}/store", f"{tmp_dir}/died"
    os.makedirs(log)

    def dies_once(p):
        if len(os.listdir(log)) > 10 and not os.path.exists(marker):
            with open(marker, "w"):
                pass
            os._exit(1)
        return f"answer to {p}"
    options = {"partitions": 2, "commit_rows": 1, **NO_WAIT}
    with pytest.raises(Exception):
        judge_stored(requests(spark, 30), counted(log, dies_once), store, **options).collect()
    first = {r["answer"].split()[-1] for r in stored_answers(spark, store).collect()}
    assert first and len(first) < 30
    got = {r["prompt"]: r["text"] for r in judge_stored(requests(spark, 30), counted(log, dies_once), store, **options).collect()}
    assert got == {f"p{i}": f"answer to p{i}" for i in range(30)}
    n = calls(log)
    assert all(n[p] == 1 for p in first) and sum(n.values()) <= 32
    # dealt to other tasks, over what is stored: no call at all
    judge_stored(requests(spark, 30), counted(log), store, partitions=5, **NO_WAIT).collect()
    assert calls(log) == n


def test_equal_requests_once_and_failures_again(spark, tmp_dir):
    log, store = f"{tmp_dir}/calls", f"{tmp_dir}/store"
    os.makedirs(log)
    req = requests(spark, 4).withColumn("prompt", F.when(F.col("question_id") < 3, "same").otherwise(F.lit(None).cast("string")))

    def no_nulls(p):
        if p is None:
            raise ValueError("no prompt")
        return "8 7"
    got = judge_stored(req, counted(log, no_nulls), store, max_retry=2, partitions=2, **NO_WAIT)
    assert got.columns == [*req.columns, "text"]
    assert sorted((r["question_id"], r["text"]) for r in got.collect()) == [(0, "8 7"), (1, "8 7"), (2, "8 7"), (3, "error")]
    assert calls(log) == {"same": 1, "None": 2}
    again = judge_stored(req, counted(log, lambda p: "1 2"), store, partitions=2, **NO_WAIT).collect()
    assert sorted(r["text"] for r in again) == ["1 2", "8 7", "8 7", "8 7"]
    assert judge_stored(req.limit(0), counted(log), f"{tmp_dir}/empty", **NO_WAIT).count() == 0


def test_stand_in_judge_holds_no_answered_prompts():
    import weakref

    from weftmix.plans.standins import _h, judge_factory

    class Prompt(str):
        pass
    call, held = judge_factory(), []
    for k in [k for k in range(400) if _h(f"p{k}", "flaky") % 4 == 0]:
        p = Prompt(f"p{k}")
        with pytest.raises(RuntimeError):
            call("s", p, 9)
        assert call("s", p, 9) == call("s", p, 9)
        held.append(weakref.ref(p))
        del p
    assert len(held) > 50 and sum(x() is not None for x in held) <= 1


def test_judged_rows_keep_their_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, "s", "p1", 5, {"a": "b"}), (2, None, "p2", 5, None), (3, "s", None, 5, {}), (4, "s", "p4", None, None)],
                               "question_id long, system_prompt string, prompt string, max_tokens int, more map<string,string>")

    def factory():
        return lambda s, p, m: f"{s} {p} {m}"
    rows = judge(df, factory, partitions=2, in_flight=2, **NO_WAIT)
    assert rows.columns == [*df.columns, "text"]
    assert sorted((r["question_id"], r["more"], r["text"]) for r in rows.collect()) == [
        (1, {"a": "b"}, "s p1 5"), (2, None, "None p2 5"), (3, {}, "s None 5"), (4, None, "error")]
