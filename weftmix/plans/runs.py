"""Training-run tables over the driver tables: token NLL rows, step
metrics, embedding deltas, training logs, shuffled shards and the file
stream — with their DuckDB oracle SQL.

Stand-ins (SURVEY §7.2): ``events`` rows become token rows
(``seq_id = event_id div 64``, ``pos = event_id mod 64``, ``nll = value / 10``,
target when ``value >= 2``) and step records (``step = event_id + 1``,
``loss = value / 10``, ``step_time = 1 + value / 100``); ``embeddings`` is the
vector table and its rows with ``label < 8`` at half scale are the smaller
base table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators import metrics as M
from weftmix.operators import vectors as V
from weftmix.operators.mixing import mix_spec, select_files
from weftmix.plans import inputs
from weftmix.plans.sqlparts import h
from weftmix.session import scratch_path
from weftmix.sources import files as S

NUMEL, BATCH, SEQ, LR = 7_000_000_000, 20, 1024, 2e-5
SEQ_LEN, SEQS_PER_BATCH = 64, 8


def token_nll(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events").select("event_id", "event_type", "value")
    return e.select((F.floor(F.col("event_id") / SEQ_LEN)).cast("bigint").alias("seq_id"),
                    (F.col("event_id") % SEQ_LEN).cast("int").alias("pos"),
                    (F.col("value") / 10.0).alias("nll"),
                    F.when(F.col("value") >= 2.0, 1).otherwise(0).alias("loss_mask"), "event_type")


def step_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = inputs.table(spark, sf_dir, "events").select("event_id", "value")
    st = F.lit(1.0) + F.col("value") / 100.0
    return e.select(F.lit("run-0").alias("run"), F.lit(0).alias("rank"), (F.col("event_id") + 1).alias("step"),
                    (F.col("value") / 10.0).alias("loss"), st.alias("step_time"),
                    M.step_tflops(NUMEL, BATCH, SEQ, st).alias("tflops"))


def masked_loss_q(spark, sf_dir):
    t = token_nll(spark, sf_dir).withColumn("batch_id", F.floor(F.col("seq_id") / SEQS_PER_BATCH).cast("bigint"))
    r = M.masked_loss(t, "batch_id")
    return r.select("batch_id", F.col("n_target").cast("bigint").alias("n_target"), F.round("loss", 6).alias("loss"))


def perplexity_q(spark, sf_dir):
    r = M.perplexity(token_nll(spark, sf_dir), "event_type")
    return r.select("event_type", F.col("n_tokens").cast("bigint").alias("n_tokens"), F.round("ppl", 6).alias("ppl"))


def trailing_mean_q(spark, sf_dir):
    r = M.trailing_mean(step_metrics(spark, sf_dir), 100)
    return r.select("run", F.col("rank").cast("bigint").alias("rank"), F.col("step").cast("bigint").alias("step"),
                    F.col("n_rows").cast("bigint").alias("n_rows"), F.round("avg_loss", 6).alias("avg_loss"),
                    F.round("avg_tflops", 6).alias("avg_tflops"))


def trailing_records_q(spark, sf_dir):
    """F2 on records of four ranks (rank = user_id mod 4, step = event_id):
    steps have gaps per rank, so the exact last-100-records path runs."""
    e = inputs.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    m = e.select(F.lit("run-0").alias("run"), (F.col("user_id") % 4).cast("int").alias("rank"),
                 F.col("event_id").alias("step"), (F.col("value") / 10.0).alias("loss"))
    r = M.trailing_mean_records(m, 100, ("loss",))
    return r.select("run", F.col("rank").cast("bigint").alias("rank"), F.col("step").cast("bigint").alias("step"),
                    F.col("n_rows").cast("bigint").alias("n_rows"), F.round("avg_loss", 6).alias("avg_loss"))


def checkpoint_summary_q(spark, sf_dir):
    r = M.checkpoint_summary(step_metrics(spark, sf_dir), 1000)
    return r.select(F.col("step").cast("bigint").alias("step"), F.round("avg_loss", 6).alias("avg_loss"), "ckpt_name")


def training_log_q(spark, sf_dir):
    """The trainer's log lines for every trailing-mean step, parsed back."""
    r = M.trailing_mean(step_metrics(spark, sf_dir), 100)
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("step"))
    lines = r.select(S.format_training_line(ts, F.col("step"), F.lit(LR), F.col("avg_loss"),
                                            F.col("avg_tflops")).alias("value"))
    p = S.parse_log_lines(lines)
    return p.select("kind", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), "step",
                    F.round("lr", 10).alias("lr"), F.round("loss", 6).alias("loss"),
                    F.round("tflops", 6).alias("tflops"))


def embeddings(spark, sf_dir):
    return inputs.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("row_id"),
                                                            F.col("embedding").alias("vec"), "label")


def base_vectors(spark, sf_dir):
    e = embeddings(spark, sf_dir)
    return e.filter(F.col("label") < 8).select(
        "row_id", F.transform("vec", lambda x: (x * F.lit(0.5)).cast("float")).alias("vec"))


def embedding_delta_q(spark, sf_dir):
    """D7 add path, per row: dimension, element sum, whether it changed."""
    e = embeddings(spark, sf_dir)
    out = V.apply_embedding_delta(e.drop("label"), base_vectors(spark, sf_dir), "add")
    chk = out.join(e.select("row_id", F.col("vec").alias("_orig")), "row_id")
    return chk.select(F.col("row_id").cast("bigint").alias("row_id"), F.size("vec").cast("bigint").alias("dim"),
                      F.round(V.vector_sum("vec"), 4).alias("vec_sum"),
                      (F.col("vec") != F.col("_orig")).alias("changed"))


def embedding_checksum_q(spark, sf_dir):
    """E6 on add-then-remove: its checksum against the original's."""
    e = embeddings(spark, sf_dir).drop("label")
    b = base_vectors(spark, sf_dir)
    back = V.apply_embedding_delta(V.apply_embedding_delta(e, b, "add"), b, "remove")
    expected = V.embedding_checksum(e).first()["total"]
    return V.embedding_checksum(back, expected).select(F.round("total", 2).alias("total"), "ok")


def training_log_files_q(spark, sf_dir):
    """A7 on files: four ranks' logs written as ``log.txt.<rank>`` folders in
    the shared folder and read back with the rank from the name."""
    e = inputs.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    rank = F.pmod(F.col("user_id"), F.lit(4)).cast("int")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id"))
    body = (F.when(F.col("event_id") % 10 == 0, S.format_load_line(ts, F.lit("en"), F.concat(F.col("event_id").cast("string"), F.lit(".jsonl"))))
            .when(F.col("event_id") % 10 == 1, S.format_progress_line(ts, F.lit("en"), F.lit("7.jsonl"), F.col("event_id"), F.lit(10 ** 9)))
            .otherwise(S.format_training_line(ts, F.col("event_id"), F.lit(LR), F.round(F.col("value") / 10, 4), F.lit(1.5))))
    out = scratch_path(spark, "logs")
    e.select(body.alias("value"), F.concat(F.lit("log.txt."), rank.cast("string")).alias("log")).write.partitionBy("log").text(out)
    p = S.read_training_log(spark, out)
    return p.select(F.col("rank").cast("bigint").alias("rank"), "kind", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"),
                    "step", F.round("loss", 6).alias("loss"), "data_tag", "data_file")


SHARD_SEED = 7
SHARD_BYTES = S.SHARD_BYTES


def shuffled_shards_q(spark, sf_dir):
    """A6 -> A2 -> A1: documents written as hash-shuffled shards under a
    corpus folder (count from their bytes), listed and read back as a corpus
    tag, reported per shard with the order of its rows."""
    out = scratch_path(spark, "shards")
    d = inputs.documents(spark, sf_dir)
    n = S.write_shuffled_shards(d, f"{out}/all", None, SHARD_SEED, ["doc_id"], world_size=2, shard_bytes=SHARD_BYTES)
    spec = mix_spec(spark, [("all", 1)])
    files = select_files(S.list_corpus_files(spark, out, ["all"]), spec)
    back = S.number_lines(S.read_corpus(spark, f"{out}/all", "doc_id bigint, text string, lang string, source string", spec=spec))
    back = back.join(files.select("file_path", "file_no"), "file_path")
    return (back.groupBy(F.col("file_no").alias("shard"))
            .agg(F.count(F.lit(1)).cast("bigint").alias("n_docs"), F.sum("doc_id").cast("bigint").alias("sum_doc_id"),
                 F.sum(F.length("text")).cast("bigint").alias("n_chars"),
                 F.sum(F.col("doc_id") * (F.col("file_pos") + 1)).cast("bigint").alias("order_sum"))
            .withColumn("n_shards", F.lit(n).cast("bigint")))


def stream_features_q(spark, sf_dir):
    """I1 + I2: documents arrive through the file stream (one file per
    micro-batch, whether the table is one file or a folder of part files);
    each micro-batch becomes stage-1 features in foreachBatch. Batches are
    named by (epoch, rank, batch_id, slot)."""
    from weftmix.plans import training as T
    from weftmix.streaming.files import stream_corpus, stream_features
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    src = stream_corpus(spark, f"{sf_dir}/documents.parquet", schema, fmt="parquet")
    sink, ck = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    q = stream_features(src, lambda b, _e: T.features_report(T.stage1_features(spark, sf_dir, docs=b)), sink, ck)
    q.awaitTermination()
    return spark.read.parquet(sink).withColumn("epoch", F.col("epoch").cast("bigint"))


ARRIVALS = 3
ARRIVAL_SEED = 5
STREAM_WEIGHTS = [("de", 3), ("en", 4), ("es", 1), ("fr", 2)]


def stream_mix_q(spark, sf_dir):
    """I2 + B4 over a stream: documents arrive in three folders, one after the
    other; after each the stream is started again from its checkpoint, mixes
    what came with what was left, and writes the batches that are full as
    stage-1 features. Documents of other and unknown languages ride with the
    largest subset."""
    from weftmix.functions.text import seeded_hash
    from weftmix.operators import examples as ex
    from weftmix.operators.features import make_features
    from weftmix.plans import training as T
    from weftmix.streaming.files import stream_corpus
    from weftmix.streaming.mix import stream_mix
    known = [t for t, _ in STREAM_WEIGHTS]
    docs = inputs.documents(spark, sf_dir).select(
        "doc_id", "text", F.when(F.col("lang").isin(known), F.col("lang")).otherwise("en").alias("tag"), F.col("source").alias("file_name"))
    arrival = seeded_hash(["doc_id"], f"arrival-{ARRIVAL_SEED}") % ARRIVALS
    spec = mix_spec(spark, STREAM_WEIGHTS)
    root, state, sink, checkpoint = (scratch_path(spark, f"stream-mix-{x}") for x in ("in", "state", "out", "ckpt"))

    def features(rows):
        examples = ex.with_prefix(ex.lm_example(rows), 1)
        return T.features_report(make_features(examples, T.MAX_LEN, T.DRAW_KEY))
    for k in range(ARRIVALS):
        docs.filter(arrival == k).write.json(f"{root}/arrival={k}")
        # all files that are there make one micro-batch
        stream = stream_corpus(spark, f"{root}/*", "doc_id bigint, text string, tag string, file_name string", files_per_trigger=1 << 30)
        stream_mix(stream, spec, state, sink, checkpoint, T.WORLD_SIZE, T.BATCH_SIZE, ["doc_id"], features).awaitTermination()
    return spark.read.parquet(sink).withColumn("epoch", F.col("epoch").cast("bigint"))


def trailing_stream_q(spark, sf_dir):
    """A7 + F2 over growing logs: four ranks' log files arrive in three parts,
    one after the other; after each the stream is started again from its
    checkpoint and reports the last 100 records at every 100th step."""
    from weftmix.streaming.logs import stream_trailing, stream_training_log
    e = inputs.table(spark, sf_dir, "events").select("event_id", "user_id", "value")
    last = e.agg(F.max("event_id")).first()[0] or 0  # one number
    rank = F.pmod(F.col("user_id"), F.lit(4)).cast("string")
    ts = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(secs=F.col("event_id"))
    lines = e.select(S.format_training_line(ts, F.col("event_id"), F.lit(LR), F.col("value") / 10.0, F.lit(1.5)).alias("value"),
                     F.concat(F.lit("log.txt."), rank).alias("log"), F.floor(F.col("event_id") * ARRIVALS / (last + 1)).alias("arrival"))
    root, state, sink, checkpoint = (scratch_path(spark, f"stream-log-{x}") for x in ("in", "state", "out", "ckpt"))
    for k in range(ARRIVALS):
        lines.filter(F.col("arrival") == k).drop("arrival").write.partitionBy("log").text(f"{root}/arrival={k}")
        # all files that are there make one micro-batch
        log = stream_training_log(spark, root, files_per_trigger=1 << 30).filter("kind = 'training'")
        stream_trailing(log, state, sink, checkpoint, 100, ("loss",)).awaitTermination()
    return spark.read.parquet(sink).select(F.lit("run-0").alias("run"), F.col("rank").cast("bigint").alias("rank"), "step",
                                           F.col("n_rows").cast("bigint").alias("n_rows"), F.round("avg_loss", 6).alias("avg_loss"))


# ---------------------------------------------------------------------- SQL
TOKENS_SQL = """tok AS (
  SELECT CAST(floor(event_id / 64) AS BIGINT) AS seq_id, event_id % 64 AS pos, value / 10.0 AS nll,
         CASE WHEN value >= 2.0 THEN 1 ELSE 0 END AS loss_mask, event_type
  FROM events)"""

STEPS_SQL = f"""st AS (
  SELECT 'run-0' AS run, 0 AS rank, event_id + 1 AS step, value / 10.0 AS loss,
         CAST({float(NUMEL)} AS DOUBLE) * CAST({float(BATCH)} AS DOUBLE) * CAST({float(SEQ)} AS DOUBLE)
           * CAST(8.0 AS DOUBLE) / CAST(1e12 AS DOUBLE) / ((1.0 + value / 100.0) + CAST(1e-12 AS DOUBLE)) AS tflops
  FROM events),
tm AS (
  SELECT run, rank, max(step) AS step, count(*) AS n_rows, sum(loss) / 100.0 AS avg_loss,
         sum(tflops) / 100.0 AS avg_tflops, CAST(ceil(step / 100) AS BIGINT) AS b
  FROM st GROUP BY run, rank, CAST(ceil(step / 100) AS BIGINT)
  HAVING max(step) = CAST(ceil(step / 100) AS BIGINT) * 100)"""


def masked_loss_sql():
    return f"""WITH {TOKENS_SQL}
SELECT CAST(floor(seq_id / 8) AS BIGINT) AS batch_id,
       CAST(sum(CASE WHEN pos >= 1 AND loss_mask = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_target,
       round(sum(CASE WHEN pos >= 1 AND loss_mask = 1 THEN nll END)
             / nullif(sum(CASE WHEN pos >= 1 AND loss_mask = 1 THEN 1 ELSE 0 END), 0), 6) AS loss
FROM tok GROUP BY CAST(floor(seq_id / 8) AS BIGINT)"""


def perplexity_sql():
    return f"""WITH {TOKENS_SQL}
SELECT event_type, CAST(count(*) AS BIGINT) AS n_tokens, round(exp(avg(nll)), 6) AS ppl
FROM tok WHERE pos >= 1 AND loss_mask = 1 GROUP BY event_type"""


def trailing_mean_sql():
    return f"""WITH {STEPS_SQL}
SELECT run, CAST(rank AS BIGINT) AS rank, CAST(step AS BIGINT) AS step, CAST(n_rows AS BIGINT) AS n_rows,
       round(avg_loss, 6) AS avg_loss, round(avg_tflops, 6) AS avg_tflops FROM tm"""


def trailing_records_sql():
    return """WITH m AS (SELECT 'run-0' AS run, user_id % 4 AS rank, event_id AS step, value / 10.0 AS loss FROM events),
w AS (SELECT run, rank, step,
             sum(loss) OVER (PARTITION BY run, rank ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) / 100.0 AS a,
             count(*) OVER (PARTITION BY run, rank ORDER BY step ROWS BETWEEN 99 PRECEDING AND CURRENT ROW) AS n
      FROM m)
SELECT run, CAST(rank AS BIGINT) AS rank, CAST(step AS BIGINT) AS step, CAST(n AS BIGINT) AS n_rows,
       round(a, 6) AS avg_loss
FROM w WHERE step % 100 = 0"""


def checkpoint_summary_sql():
    return f"""WITH st AS (SELECT event_id + 1 AS step, value / 10.0 AS loss FROM events),
c AS (SELECT max(step) AS step, sum(loss) / 1000.0 AS avg_loss, CAST(ceil(step / 1000) AS BIGINT) AS b
      FROM st GROUP BY CAST(ceil(step / 1000) AS BIGINT) HAVING max(step) = CAST(ceil(step / 1000) AS BIGINT) * 1000)
SELECT CAST(step AS BIGINT) AS step, round(avg_loss, 6) AS avg_loss,
       printf('ckpt_step-%d_loss-%.4f', step, round(avg_loss, 4)) AS ckpt_name FROM c"""


def training_log_sql():
    return f"""WITH {STEPS_SQL}
SELECT 'training' AS kind, strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(step), '%Y-%m-%d %H:%M:%S') AS ts,
       CAST(step AS BIGINT) AS step, round({LR}, 10) AS lr, round(avg_loss, 6) AS loss,
       round(avg_tflops, 6) AS tflops FROM tm"""


def embedding_delta_sql():
    return """WITH e AS (SELECT vec_id AS row_id, embedding AS vec, label FROM embeddings),
b AS (SELECT row_id, list_transform(vec, lambda x: CAST(x * 0.5 AS FLOAT)) AS bv FROM e WHERE label < 8),
o AS (SELECT e.row_id, e.vec AS orig,
             CASE WHEN b.bv IS NULL THEN e.vec
                  ELSE list_transform(range(len(e.vec)), lambda i: CAST(e.vec[i + 1] + b.bv[i + 1] AS FLOAT)) END AS vec
      FROM e LEFT JOIN b USING (row_id))
SELECT CAST(row_id AS BIGINT) AS row_id, CAST(len(vec) AS BIGINT) AS dim,
       round(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE))), 4) AS vec_sum, vec <> orig AS changed
FROM o"""


def embedding_checksum_sql():
    return """WITH e AS (SELECT vec_id AS row_id, embedding AS vec, label FROM embeddings),
b AS (SELECT row_id, list_transform(vec, lambda x: CAST(x * 0.5 AS FLOAT)) AS bv FROM e WHERE label < 8),
o AS (SELECT e.row_id, e.vec AS orig,
             CASE WHEN b.bv IS NULL THEN e.vec
                  ELSE list_transform(range(len(e.vec)),
                         lambda i: CAST(CAST(e.vec[i + 1] + b.bv[i + 1] AS FLOAT) - b.bv[i + 1] AS FLOAT)) END AS vec
      FROM e LEFT JOIN b USING (row_id)),
t AS (SELECT sum(list_sum(list_transform(vec, lambda x: CAST(x AS DOUBLE)))) AS total,
             sum(list_sum(list_transform(orig, lambda x: CAST(x AS DOUBLE)))) AS expected FROM o)
SELECT round(total, 2) AS total, abs(total - expected) < 0.0001 AS ok FROM t"""


def training_log_files_sql():
    return """SELECT CAST(user_id % 4 AS BIGINT) AS rank,
       CASE event_id % 10 WHEN 0 THEN 'data_load' WHEN 1 THEN 'data_progress' ELSE 'training' END AS kind,
       strftime(TIMESTAMP '2024-01-01 00:00:00' + to_seconds(event_id), '%Y-%m-%d %H:%M:%S') AS ts,
       CASE WHEN event_id % 10 > 1 THEN CAST(event_id AS BIGINT) END AS step,
       CASE WHEN event_id % 10 > 1 THEN round(value / 10, 4) END AS loss,
       CASE WHEN event_id % 10 < 2 THEN 'en' END AS data_tag,
       CASE event_id % 10 WHEN 0 THEN event_id || '.jsonl' WHEN 1 THEN '7.jsonl' END AS data_file
FROM events"""


def shuffled_shards_sql():
    return f"""WITH b AS (SELECT doc_id, length(text) AS len, {h(['doc_id'], f'order-{SHARD_SEED}')} AS o,
             octet_length(encode(text)) + octet_length(encode(lang)) + octet_length(encode(source)) + 8 AS b FROM documents),
n AS (SELECT least({SHARD_BYTES}, CAST(ceil(sum(b) / 2) AS BIGINT)) AS target, CAST(sum(b) AS BIGINT) AS total FROM b),
d AS (SELECT *, CAST(coalesce(sum(b) OVER (ORDER BY o, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) // target AS shard,
             greatest(2, CAST(ceil(total / target) AS BIGINT)) AS n_shards FROM b, n),
p AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY o, doc_id) AS pos FROM d)
SELECT CAST(shard AS BIGINT) AS shard, CAST(count(*) AS BIGINT) AS n_docs, CAST(sum(doc_id) AS BIGINT) AS sum_doc_id,
       CAST(sum(len) AS BIGINT) AS n_chars, CAST(sum(doc_id * pos) AS BIGINT) AS order_sum, CAST(n_shards AS BIGINT) AS n_shards
FROM p GROUP BY shard, n_shards"""
