"""A7 + F2 over growing logs, against the batch form and plain Python."""

import os
import random

import pytest

from weftmix.operators.metrics import trailing_mean_records
from weftmix.sources.files import read_training_log
from weftmix.streaming.logs import stream_trailing, stream_training_log, trailing_epoch

COLS = ("loss", "tflops")


def line(step, loss):
    return f"[2024-01-01 00:00:00] [training] step {step}: lr 2e-05  loss {loss}  tflops 1.5"


def write(root, part, rank, lines):
    os.makedirs(f"{root}/part-{part}", exist_ok=True)
    with open(f"{root}/part-{part}/log.txt.{rank}", "w") as f:
        f.write("".join(x + "\n" for x in lines))


def run(spark, root, where, n=4, files=1 << 30):
    s = stream_training_log(spark, root, files).filter("kind = 'training'")
    stream_trailing(s, f"{where}/state", f"{where}/out", f"{where}/ckpt", n, COLS).awaitTermination()


def found(df):
    return sorted((r["rank"], r["step"], r["n_rows"], round(r["avg_loss"], 9), round(r["avg_tflops"], 9)) for r in df.collect())


def plain(records, n):
    """The trainer's list slice: ``records`` as they were logged, by rank."""
    out = []
    for rank, rows in records.items():
        for i, (step, _) in enumerate(rows):
            if step % n == 0:
                last = [v for _, v in rows[max(0, i - n + 1):i + 1]]
                out.append((rank, step, len(last), round(sum(last) / n, 9), round(1.5 * len(last) / n, 9)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_any_split_gives_the_reports_of_the_whole_log(spark, tmp_dir, seed):
    rng = random.Random(seed)
    records = {r: [(s, rng.randrange(1000) / 64) for s in range(1, 41) if rng.random() < 0.8] for r in (0, 1, 7)}
    parts = 4
    cuts = {r: sorted(rng.randrange(len(x) + 1) for _ in range(parts - 1)) for r, x in records.items()}
    for k in range(parts):
        for r, rows in records.items():
            a, z = ([0] + cuts[r])[k], (cuts[r] + [len(rows)])[k]
            write(f"{tmp_dir}/in", k, r, ["[2024-01-01 00:00:00] [data] loading en: 1.jsonl", "noise", *(line(*x) for x in rows[a:z])])
        run(spark, f"{tmp_dir}/in", tmp_dir)  # started again from the checkpoint each time
    got = found(spark.read.parquet(f"{tmp_dir}/out"))
    assert got == plain(records, 4)
    whole = read_training_log(spark, f"{tmp_dir}/in").filter("kind = 'training'")
    assert got == found(trailing_mean_records(whole, 4, COLS, ("rank",)))
    # the state is the last four records of each rank
    tails = [d for d in os.listdir(f"{tmp_dir}/state") if not d.startswith(".")]
    newest = max(tails, key=lambda d: int(d.split("=")[1]))
    kept = spark.read.parquet(f"{tmp_dir}/state/{newest}/tail").groupBy("rank").count().collect()
    assert len(tails) <= 2 and {r["rank"]: r["count"] for r in kept} == {0: 4, 1: 4, 7: 4}


def test_resumed_run_logs_steps_again(spark, tmp_dir):
    write(f"{tmp_dir}/in", 0, 0, [line(s, s) for s in range(1, 7)])
    run(spark, f"{tmp_dir}/in", tmp_dir)
    write(f"{tmp_dir}/in", 1, 0, [line(s, 10 * s) for s in range(3, 9)])
    run(spark, f"{tmp_dir}/in", tmp_dir)
    logged = [(s, float(s)) for s in range(1, 7)] + [(s, 10.0 * s) for s in range(3, 9)]
    assert found(spark.read.parquet(f"{tmp_dir}/out")) == plain({0: logged}, 4)


def test_replay_empty_and_missing(spark, tmp_dir):
    schema = "rank int, step bigint, loss double, tflops double, value string"
    first = spark.createDataFrame([(0, s, float(s), 1.5, "x") for s in range(1, 7)] + [(None, 4, 9.0, 1.5, "x"), (0, None, 9.0, 1.5, "x")], schema)
    state, out = f"{tmp_dir}/state", f"{tmp_dir}/out"

    def step(rows, epoch):
        trailing_epoch(rows, epoch, state, out, 4, COLS, ("rank",))
    step(first, 0)
    step(spark.createDataFrame([], schema), 1)
    third = spark.createDataFrame([(0, 7, 7.0, 1.5, "x"), (0, 8, None, 1.5, "x")], schema)
    step(third, 2)
    once = found(spark.read.parquet(out))
    step(third, 2)
    assert found(spark.read.parquet(out)) == once == [(0, 4, 4, 2.5, 1.5), (0, 8, 4, 4.5, 1.5)]
    with pytest.raises(ValueError, match="no state"):
        step(first, 9)
