"""A7 + F2 over growing logs: trailing means of log files as they arrive.

The trainer keeps the last ``n`` records of a rank in memory and reports their
mean every ``n`` steps. Over a stream the last ``n`` records of every rank are
the state that lives on between micro-batches, at most ``n`` rows a rank:

    <state>/epoch=N/tail   the last n records per group after micro-batch N
    <sink>/epoch=N         the reports of the records that came with it

A micro-batch numbers its records behind those kept and reports with the
operator of the batch form: a range sort, so a rank with most of the lines is
shared by many tasks. Micro-batch N reads the state of N-1 and overwrites its own,
so a replay after a crash writes the same rows again; older states are dropped.

Records count in the order of their arrival, within a micro-batch by step. So a
split of a log into files that arrive in turn gives the reports of the whole log,
and a resumed run that logs a step again adds a record and a report of its own.

Defined results: lines of other kinds, and records without a group or a step,
are left out; a null value counts as a record and adds nothing to its sum; fewer
than ``n`` records are divided by ``n`` all the same (``n_rows`` tells); a
micro-batch without records keeps the state.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators.indexing import dense_index
from weftmix.operators.metrics import LOG_EVERY, trailing_of_places
from weftmix.sources.files import ranked_log_lines
from weftmix.streaming.mix import drop_folder, folder_exists


def stream_training_log(spark: SparkSession, path: str, files_per_trigger: int = 1) -> DataFrame:
    """A7 as a stream: parsed lines, with their rank, of the log files that
    appear under ``path`` (each file is read once, when it is whole)."""
    r = spark.readStream.option("maxFilesPerTrigger", int(files_per_trigger)).option("recursiveFileLookup", "true")
    return ranked_log_lines(r.text(path))


def trailing_epoch(records: DataFrame, epoch: int, state_path: str, sink_path: str, n: int, cols, by) -> None:
    """One micro-batch: report on its records, keep the last ``n`` of each group."""
    spark, state, by, cols = records.sparkSession, state_path.rstrip("/"), list(by), list(cols)
    before, own = f"{state}/epoch={epoch - 1}", f"{state}/epoch={epoch}"
    if epoch and not folder_exists(spark, f"{before}/tail/_SUCCESS"):
        raise ValueError(f"no state of micro-batch {epoch - 1} under {state}")

    def written(df: DataFrame, name: str) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{own}/{name}")
        return spark.read.schema(df.schema).parquet(f"{own}/{name}")
    known = F.lit(True)
    for c in [*by, "step"]:
        known = known & F.col(c).isNotNull()
    # numbered once, where they are written: a second read gives the same lines
    new = written(records.filter(known).select(*by, "step", *cols, F.lit(epoch).cast("bigint").alias("_epoch"),
                                               F.monotonically_increasing_id().alias("_line")), "new")
    every = new.unionByName(spark.read.schema(new.schema).parquet(f"{before}/tail")) if epoch else new
    placed = written(dense_index(every, by, ["_epoch", "step", "_line"], out_col="_rec", size_col="_size"), "placed")
    reports = trailing_of_places(placed, n, cols, by, reported=F.col("_epoch") == epoch).drop("_rec")
    reports.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={epoch}")
    # written last: with it the micro-batch is done
    written(placed.filter(F.col("_rec") >= F.col("_size") - int(n)).select(*new.columns), "tail")
    for name in ("new", "placed"):
        drop_folder(spark, f"{own}/{name}")
    if epoch > 1:
        drop_folder(spark, f"{state}/epoch={epoch - 2}")


def stream_trailing(records: DataFrame, state_path: str, sink_path: str, checkpoint_path: str, n: int = LOG_EVERY,
                    cols=("loss", "tflops"), by=("rank",), available_now: bool = True):
    """the started query that appends ``by, step, n_rows, avg_<col>`` of
    every reporting record of ``records`` to ``sink_path``."""
    def each(rows: DataFrame, epoch: int) -> None:
        trailing_epoch(rows, epoch, state_path, sink_path, n, cols, by)

    w = records.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
