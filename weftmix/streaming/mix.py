"""I2 + B4 over a stream: one endless weighted mix over records as they arrive.

The reference's producer draws the next record of the next tag and waits when
none is there yet. Without wrap-around the k-th record of a tag on a rank is
draw k, whose slot is known in closed form (``mixing.slot_of_draw``), so a
record's place in the mix needs only the number of records of its (rank, tag)
that came before it. Those numbers, and the records of batches that aren't full
yet, are the state that lives on between micro-batches:

    <state>/epoch=N/cursors   files and records seen per (tag, rank)
    <state>/epoch=N/pending   records whose batch still waits for others
    <sink>/epoch=N            the batches that micro-batch N filled

Every rank's batches come out whole, in order and once: a batch is full when
the first open slot of every tag lies behind it, which is one minimum over the
cursors, no grouping of records. Micro-batch N reads the state of N-1 and
overwrites its own, so a replay after a crash writes the same rows again; older
states are dropped. Inside a micro-batch records are numbered by a range sort,
never by one task per tag. Records with a tag outside the mix are left out.

A stream keyed on (rank, tag) would give a state-store operator a handful of
keys and each of them a whole subset; that is why the state is a table here.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators.indexing import dense_index
from weftmix.operators.mixing import assign_batches, expand_weights, file_offsets, slot_of_draw

CURSORS = "tag string, rank int, n_files bigint, n_rows bigint"


def start_cursors(spec: DataFrame, world_size: int) -> DataFrame:
    """No file and no record seen: one row per (tag, rank) of the mix."""
    ranks = F.explode(F.sequence(F.lit(0), F.lit(int(world_size) - 1))).alias("rank")
    return expand_weights(spec).select("tag", ranks, F.lit(0).cast("bigint").alias("n_files"), F.lit(0).cast("bigint").alias("n_rows"))


def place_arrivals(rows: DataFrame, cursors: DataFrame, spec: DataFrame, world_size: int, batch_size: int,
                   order_cols) -> DataFrame:
    """The new records with ``rank, row_idx, global_pos, batch_id, slot``.
    ``rows`` needs ``tag, file_name`` and ``order_cols`` (unique in a file):
    files go to ranks in turn, in the order of their names behind those seen
    before, and records are numbered in file order behind those seen before."""
    R, order = int(world_size), list(order_cols)
    seen = cursors.groupBy("tag").agg(F.max("n_files").alias("_seen"))
    rows = rows.join(F.broadcast(seen.select("tag")), "tag", "left_semi")  # one row per tag of the mix
    files = rows.groupBy("tag", "file_name").agg(F.count(F.lit(1)).alias("n_file"))
    ranked = (dense_index(files, ["tag"], ["file_name"], out_col="_ord").join(F.broadcast(seen), "tag")
              .withColumn("_ord", F.col("_ord") + F.col("_seen")).drop("_seen")
              .withColumn("rank", (F.col("_ord") % R).cast("int")).withColumn("rank_file_ord", F.floor(F.col("_ord") / R).cast("int")).drop("_ord"))
    listing = (file_offsets(ranked).join(F.broadcast(cursors.select("tag", "rank", F.col("n_rows").alias("_before"))), ["tag", "rank"])
               .select("tag", "file_name", "rank", (F.col("_before") + F.col("file_offset")).alias("_start")))
    placed = (dense_index(rows, ["tag", "file_name"], order, out_col="_place").join(listing, ["tag", "file_name"])
              .withColumn("row_idx", F.col("_start") + F.col("_place")).drop("_start", "_place"))
    return assign_batches(placed.withColumn("global_pos", slot_of_draw(F.col("row_idx"), spec)), batch_size)


def advance_cursors(cursors: DataFrame, placed: DataFrame, world_size: int) -> DataFrame:
    """The cursors after ``placed``: a handful of rows, from partial counts."""
    rows = placed.groupBy("tag", "rank").agg(F.count(F.lit(1)).alias("_rows"))
    files = placed.groupBy("tag", "file_name").agg(F.lit(1).alias("_")).groupBy("tag").agg(F.count(F.lit(1)).alias("_files"))
    zero = F.lit(0).cast("bigint")
    return (cursors.join(rows, ["tag", "rank"], "left").join(files, "tag", "left")
            .select("tag", "rank", (F.col("n_files") + F.coalesce("_files", zero)).alias("n_files"),
                    (F.col("n_rows") + F.coalesce("_rows", zero)).alias("n_rows")))


def full_batches(cursors: DataFrame, spec: DataFrame, batch_size: int) -> DataFrame:
    """(rank, n_batches): how many first batches of a rank are full."""
    return (cursors.groupBy("rank").agg(F.min(slot_of_draw(F.col("n_rows"), spec)).alias("_open"))
            .select("rank", F.floor(F.col("_open") / int(batch_size)).cast("bigint").alias("n_batches")))


def drop_folder(spark: SparkSession, path: str) -> None:
    """Remove a written table, on whatever store it lies."""
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(jsc.hadoopConfiguration()).delete(p, True)


def folder_exists(spark: SparkSession, path: str) -> bool:
    jvm, jsc = spark.sparkContext._jvm, spark.sparkContext._jsc
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(jsc.hadoopConfiguration()).exists(p)


def mix_epoch(rows: DataFrame, epoch: int, spec: DataFrame, state_path: str, sink_path: str, world_size: int, batch_size: int,
              order_cols, to_features: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """One micro-batch: place its records, write what is full now, keep the rest."""
    spark, state = rows.sparkSession, state_path.rstrip("/")
    before, own = f"{state}/epoch={epoch - 1}", f"{state}/epoch={epoch}"
    if epoch and not folder_exists(spark, f"{before}/cursors/_SUCCESS"):
        raise ValueError(f"no state of micro-batch {epoch - 1} under {state}")
    cursors = spark.read.schema(CURSORS).parquet(f"{before}/cursors") if epoch else start_cursors(spec, world_size)
    placed = place_arrivals(rows, cursors, spec, world_size, batch_size, order_cols)
    placed.write.mode("overwrite").parquet(f"{own}/placed")
    placed = spark.read.schema(placed.schema).parquet(f"{own}/placed")
    # the cursors' few rows are written last: with them the micro-batch is done
    after = advance_cursors(cursors, placed, world_size)
    every = placed.unionByName(spark.read.schema(placed.schema).parquet(f"{before}/pending")) if epoch else placed
    full = F.broadcast(full_batches(after, spec, batch_size))  # one row per rank
    marked = every.join(full, "rank")
    ready = marked.filter("batch_id < n_batches").drop("n_batches")
    out = to_features(ready) if to_features else ready
    out.write.mode("overwrite").parquet(f"{sink_path.rstrip('/')}/epoch={epoch}")
    marked.filter("batch_id >= n_batches").drop("n_batches").write.mode("overwrite").parquet(f"{own}/pending")
    after.coalesce(1).write.mode("overwrite").parquet(f"{own}/cursors")
    drop_folder(spark, f"{own}/placed")
    if epoch > 1:
        drop_folder(spark, f"{state}/epoch={epoch - 2}")


def stream_mix(stream: DataFrame, spec: DataFrame, state_path: str, sink_path: str, checkpoint_path: str, world_size: int,
               batch_size: int, order_cols, to_features: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True):
    """The started query that mixes ``stream`` (``tag, file_name``, the
    order columns and a payload) into batches and appends the full ones to
    ``sink_path``, as they are or through ``to_features``."""
    def each(rows: DataFrame, epoch: int) -> None:
        mix_epoch(rows, epoch, spec, state_path, sink_path, world_size, batch_size, order_cols, to_features)

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_path)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
