"""Training-data plans over the driver tables: mix -> examples -> features.

Stage 1: LM subsets ``de`` (3), ``en`` (4), ``es`` (1) plus ``translate`` (2), W = 10.
Stage 2: LM ``en`` (2) + ``translate`` (2) + task subsets (1 each).
Stage 3: instruction records (one subset) with the chat prefix.
Two ranks; the step count is one epoch of the largest subset (data-derived),
so the amount of work grows with the tables.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.operators import examples as ex
from weftmix.operators.features import make_features
from weftmix.operators.mixing import epoch_steps, file_offsets, index_rows, mix_schedule, mix_spec, shard_files
from weftmix.plans import inputs
from weftmix.session import checkpoint_dir, scratch_path
from weftmix.sources import files as S

WORLD_SIZE = 2
BATCH_SIZE = 20
MAX_LEN = 1024
STAGE1_WEIGHTS = [("de", 3), ("en", 4), ("es", 1), ("translate", 2)]
STAGE2_WEIGHTS = [("en", 2), ("translate", 2), ("task-es", 1), ("task-de", 1)]
#: Every document is in the corpus; other and unknown languages share a tag.
CORPUS_WEIGHTS = [("de", 3), ("en", 4), ("es", 1), ("fr", 2), ("other", 1)]
CORPUS_SEED, CORPUS_SHARD_BYTES = 11, S.SHARD_BYTES
DRAW_KEY = ["rank", "global_pos"]


def file_listings(spark: SparkSession, sources, world_size: int):
    """B1 over the files present in each source, with each file's row count,
    its offset in its rank's list and the rank's subset size ``n_rows``: one
    DataFrame per source. The per-file counts of all sources are one partial
    aggregate; the listing is written once to the shared folder and never
    comes to the driver."""
    counts = None
    for k, rows in enumerate(sources):
        c = (rows.groupBy("tag", "file_name").agg(F.count(F.lit(1)).alias("n_file"))
             .withColumn("_src", F.lit(k)))
        counts = c if counts is None else counts.unionByName(c)
    checkpoint_dir(spark)
    counts = counts.checkpoint(eager=True)  # one pass over the tables; the rest works on the listing
    # a tag belongs to one source, so (tag, rank) keeps the sources apart
    listed = file_offsets(shard_files(counts, world_size, by=("_src", "tag"))).checkpoint(eager=True)
    return [listed.filter(F.col("_src") == k).drop("_src") for k in range(len(sources))]


def scheduled(spark: SparkSession, sources, weights, batch_size: int, steps: int | None = None, start_step: int = 0,
              world_size: int = WORLD_SIZE, order_cols=("doc_id",)):
    """The draws of several sources, without their texts: B1-B7 on the keys
    ``tag, file_name`` and ``order_cols`` (unique in a file), with the listing
    of all sources made by one job. Returns ([draws per source], steps)."""
    names = ["tag", "file_name", *order_cols]
    keys = [r.select(*names, *[c for c in ("pair_doc_id", "file_pos") if c in r.columns]) for r in sources]
    listings = file_listings(spark, keys, world_size)
    spec = mix_spec(spark, weights)
    if steps is None:
        sizes = [x.select("tag", "rank", "n_rows") for x in listings]
        steps = epoch_steps(reduce(DataFrame.unionByName, sizes), spec, batch_size)
    drawn = [mix_schedule(index_rows(k, l, list(order_cols), pos_col="file_pos" if "file_pos" in k.columns else None),
                          spec, steps, batch_size, start_step) for k, l in zip(keys, listings)]
    return drawn, steps


def with_rows(draws: DataFrame, rows: DataFrame, keys=("tag", "file_name", "doc_id")) -> DataFrame:
    """The drawn records: each source row's payload moves once, to its key."""
    return draws.join(rows.select(*keys, *[c for c in rows.columns if c not in draws.columns]), list(keys))


def with_pair_texts(spark: SparkSession, sf_dir: str, draws: DataFrame, docs: DataFrame | None = None) -> DataFrame:
    """Both texts of the drawn translation pairs, by document id."""
    text = inputs.documents(spark, sf_dir, docs).select("doc_id", "text")
    return (draws.join(text.withColumnRenamed("text", "en_text"), "doc_id")
            .join(text.select(F.col("doc_id").alias("pair_doc_id"), F.col("text").alias("zh_text")), "pair_doc_id"))


def stage1_schedule(spark: SparkSession, sf_dir: str, steps: int | None = None, start_step: int = 0,
                    world_size: int = WORLD_SIZE, batch_size: int = BATCH_SIZE, docs: DataFrame | None = None):
    """Stage-1 draws on keys: (lm draws, pair draws, steps)."""
    (lm, tr), steps = scheduled(spark, [inputs.lm_rows(spark, sf_dir, ["de", "en", "es"], docs), inputs.translate_pairs(spark, sf_dir, docs=docs)],
                                STAGE1_WEIGHTS, batch_size, steps, start_step, world_size)
    return lm, tr, steps


def stage1_features(spark: SparkSession, sf_dir: str, steps: int | None = None, start_step: int = 0,
                    max_len: int = MAX_LEN, world_size: int = WORLD_SIZE, batch_size: int = BATCH_SIZE,
                    docs: DataFrame | None = None, tokenizer=None) -> DataFrame:
    """H7 for stage 1 over the driver tables (the flagship query)."""
    lm, tr, steps = stage1_schedule(spark, sf_dir, steps, start_step, world_size, batch_size, docs)
    pools = ex.prompt_pools(spark, inputs.TRANSLATE_POOLS)
    lm = ex.lm_example(with_rows(lm, inputs.lm_rows(spark, sf_dir, ["de", "en", "es"], docs)))
    tr = ex.translate_example(with_pair_texts(spark, sf_dir, tr, docs), pools, DRAW_KEY)
    cols = ["rank", "batch_id", "slot", "global_pos", "tag", "doc_id", *ex.UNIFIED_COLS]
    return make_features(ex.with_prefix(ex.union_kinds(lm.select(*cols), tr.select(*cols)), 1), max_len, DRAW_KEY, tokenizer)


def corpus_tag():
    known = [t for t, _ in CORPUS_WEIGHTS if t != "other"]
    return F.when(F.col("lang").isin(known), F.col("lang")).otherwise("other")


def corpus_draws(spark: SparkSession, sf_dir: str, world_size: int = WORLD_SIZE, batch_size: int = BATCH_SIZE) -> DataFrame:
    """The file path end to end: documents written as a corpus of shuffled
    shards (A6), listed, read and indexed (A2, A1, B1, B2), then scheduled."""
    root = scratch_path(spark, "corpus")
    for tag, _w in CORPUS_WEIGHTS:
        own = inputs.documents(spark, sf_dir).filter(corpus_tag() == tag).select("doc_id", "text")
        S.write_shuffled_shards(own, f"{root}/{tag}", None, CORPUS_SEED, ["doc_id"], world_size, shard_bytes=CORPUS_SHARD_BYTES)
    spec = mix_spec(spark, CORPUS_WEIGHTS)
    rows = S.read_mixed_corpus(spark, root, spec, "doc_id bigint, text string", world_size)
    keys = rows.select("tag", "file_name", "rank", "row_idx", "n_rows", "doc_id")
    return with_rows(mix_schedule(keys, spec, epoch_steps(keys, spec, batch_size), batch_size), rows.select("tag", "file_name", "doc_id", "text"))


def corpus_features(spark: SparkSession, sf_dir: str, max_len: int = MAX_LEN, tokenizer=None) -> DataFrame:
    """H7 over a corpus read from files."""
    return make_features(ex.with_prefix(ex.lm_example(corpus_draws(spark, sf_dir)), 1), max_len, DRAW_KEY, tokenizer)


def features_report(feats: DataFrame) -> DataFrame:
    """Engine-neutral view of feature rows: arrays as md5 of their joined ids."""
    return feats.select(
        F.col("rank").cast("bigint").alias("rank"), F.col("batch_id").cast("bigint").alias("batch_id"),
        F.col("slot").cast("bigint").alias("slot"), "tag", F.col("doc_id").cast("bigint").alias("doc_id"),
        F.size("input_ids").cast("bigint").alias("n_ids"), F.col("pad_len").cast("bigint").alias("pad_len"),
        F.col("n_target").cast("bigint").alias("n_target"),
        F.md5(F.array_join(F.col("input_ids").cast("array<string>"), ",")).alias("ids_md5"),
        F.md5(F.array_join(F.col("loss_mask").cast("array<string>"), ",")).alias("mask_md5"))


def stage2_features(spark: SparkSession, sf_dir: str, steps: int | None = None, start_step: int = 0, max_len: int = MAX_LEN,
                    world_size: int = WORLD_SIZE, batch_size: int = BATCH_SIZE, tokenizer=None) -> DataFrame:
    """H7 for stage 2: LM + translation (post prompt) + task records with
    pre/post prompts (C3, C5)."""
    lm = inputs.lm_rows(spark, sf_dir, ["en"])
    tk = inputs.task_rows(spark, sf_dir, ["es", "de"])
    (lm_s, tr_s, tk_s), steps = scheduled(spark, [lm, inputs.translate_pairs(spark, sf_dir), tk], STAGE2_WEIGHTS, batch_size,
                                          steps, start_step, world_size)
    tpools = ex.prompt_pools(spark, inputs.TRANSLATE_POOLS)
    kpools = ex.prompt_pools(spark, inputs.TASK_POOLS)
    cols = ["rank", "batch_id", "slot", "global_pos", "tag", "doc_id", *ex.UNIFIED_COLS]
    a = ex.lm_example(with_rows(lm_s, lm)).select(*cols)
    b = ex.translate_example(with_pair_texts(spark, sf_dir, tr_s), tpools, DRAW_KEY, prompt_pos="post").select(*cols)
    c = ex.task_example(with_rows(tk_s, tk), kpools, DRAW_KEY).select(*cols)
    return make_features(ex.with_prefix(ex.union_kinds(a, b, c), 2), max_len, DRAW_KEY, tokenizer)


STAGE3_WEIGHTS = [("chat", 2), ("chat-system", 1)]


def instruct_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instruction records as a two-subset corpus: with / without a system
    instruction; files of 16 conversations, numbered with at least five digits;
    order (conv_id, turn). ``doc_id`` (conv_id * 2^20 + turn) is only a
    display id in reports."""
    r = inputs.instruction_rows(spark, sf_dir)
    return (ex.instruct_example(r)
            .withColumn("tag", F.when(F.length("instruction") > 0, "chat-system").otherwise("chat"))
            .withColumn("file_name", F.format_string("%05d.jsonl", F.floor(F.col("conv_id") / 16)))
            .withColumn("doc_id", F.col("conv_id") * (1 << 20) + F.col("turn")))


def stage3_features(spark: SparkSession, sf_dir: str, steps: int | None = None, start_step: int = 0,
                    max_len: int = MAX_LEN, world_size: int = WORLD_SIZE, batch_size: int = 24, tokenizer=None) -> DataFrame:
    """H7 for stage 3: stripped instruction records (C7), rejects removed
    (C8), ``Human: ... Assistant: `` prefix (C6)."""
    ok, _rejects = ex.require_nonempty(instruct_source(spark, sf_dir))
    keys = ("conv_id", "turn")
    (s,), steps = scheduled(spark, [ok], STAGE3_WEIGHTS, batch_size, steps, start_step, world_size, order_cols=keys)
    return make_features(ex.with_prefix(with_rows(s, ok, ("tag", "file_name", *keys)), 3), max_len, DRAW_KEY, tokenizer)
