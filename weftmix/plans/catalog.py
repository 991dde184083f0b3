"""The registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per
operator group, each over the driver's whole tables, and the matching DuckDB
oracle SQL. ``__spark_entry__`` re-exports these two dictionaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.plans import oracle_training as OT
from weftmix.plans import training as T

_QUERIES: dict = {}
_SQL: dict = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn
    return deco


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict:
    return dict(_SQL)


# ------------------------------------------------------------------ training
@register("make_features", OT.stage1_features_sql())
def q_make_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7 (+B1-B6, B8-B10, C1, C2, C4, D1, F1, H1, H3-H6): stage-1 features."""
    return T.features_report(T.stage1_features(spark, sf_dir))


@register("mix_schedule", OT.mix_schedule_sql())
def q_mix_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B1-B6 + G1: the stage-1 weighted schedule (one row per draw)."""
    lm, tr, _steps = T.stage1_schedule(spark, sf_dir)
    cols = ["rank", "batch_id", "slot", "global_pos", "tag", "file_name", "doc_id", "row_idx", "draw"]
    out = lm.select(*cols).unionByName(tr.select(*cols))
    return out.select(*[F.col(c).cast("bigint").alias(c) if c not in ("tag", "file_name") else F.col(c)
                        for c in cols])


@register("schedule_window", f"SELECT * FROM ({OT.mix_schedule_sql()}) WHERE batch_id >= 3 AND batch_id < 8")
def q_schedule_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B6 + B7 on a finished schedule: at most 8 steps, resumed at step 3."""
    from weftmix.operators.mixing import limit_steps, resume_from
    return resume_from(limit_steps(q_mix_schedule(spark, sf_dir), 8), "/ckpt/ckpt_step-3_loss-2.5")


@register("resume_schedule", OT.stage1_features_sql(start_step=10))
def q_resume_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Resume from ``ckpt_step-10_loss-…``: batches below step 10 are never made."""
    from weftmix.operators.mixing import parse_resume_step
    step = parse_resume_step("/ckpt/ckpt_step-10_loss-2.1234")
    return T.features_report(T.stage1_features(spark, sf_dir, start_step=step))


@register("corpus_schedule", OT.corpus_schedule_sql(T.CORPUS_SEED, T.CORPUS_SHARD_BYTES))
def q_corpus_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A6 -> A2 -> A1 -> B1-B6 on files: every record of the corpus drawn."""
    d = T.corpus_draws(spark, sf_dir)
    return d.select(*[F.col(c).cast("bigint").alias(c) for c in ("rank", "batch_id", "slot", "doc_id", "row_idx")], "tag")


@register("corpus_features", OT.corpus_features_sql(T.CORPUS_SEED, T.CORPUS_SHARD_BYTES))
def q_corpus_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same path up to H7."""
    return T.features_report(T.corpus_features(spark, sf_dir))


@register("prompt_pools", """WITH l AS (SELECT 'p' || (item_id % 5) AS pool_key, item_id, text FROM benchmark),
x AS (SELECT pool_key, item_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM l)
SELECT pool_key, CAST(count(*) AS BIGINT) AS n_prompts, md5(string_agg(trim(line), '|' ORDER BY item_id, i)) AS prompts_md5 FROM x GROUP BY pool_key""")
def q_prompt_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3 on files: pools made of the benchmark's lines, written and read back."""
    from weftmix.session import scratch_path
    from weftmix.sources import files as S
    b = I.table(spark, sf_dir, "benchmark").select(F.concat(F.lit("p"), (F.col("item_id") % 5).cast("string")).alias("pool_key"),
                                                   F.col("item_id").alias("ord"), F.concat(F.lit(" "), "text", F.lit(" ")).alias("prompt"))
    out = scratch_path(spark, "pools")
    S.write_prompt_pools(b, out)
    return S.read_prompt_pools(spark, out).select("pool_key", F.size("prompts").cast("bigint").alias("n_prompts"),
                                                  F.md5(F.array_join("prompts", "|")).alias("prompts_md5"))


# ---------------------------------------------------------------- evaluation
from weftmix.operators import metrics as M  # noqa: E402
from weftmix.operators import review as RV  # noqa: E402
from weftmix.plans import evaluation as E  # noqa: E402
from weftmix.plans import inputs as I  # noqa: E402
from weftmix.plans import oracle_eval as OE  # noqa: E402


def _review_cols(df: DataFrame) -> DataFrame:
    return df.select("review_id", F.col("question_id").cast("bigint").alias("question_id"), "answer1_id",
                     "answer2_id", F.col("reviewer_id").cast("bigint").alias("reviewer_id"), "text",
                     F.element_at("score", 1).alias("score_a"), F.element_at("score", 2).alias("score_b"))


def _category_out(df: DataFrame) -> DataFrame:
    return df.select("category", F.col("n_reviews").cast("bigint").alias("n_reviews"), "score_a", "score_b",
                     F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                     F.col("first_qid").cast("bigint").alias("first_qid"))


@register("review_requests", OE.review_requests_sql())
def q_review_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D2 + D3 + D4 + H14 + H18: judge requests (prompt as length + md5)."""
    q, a1, a2, r, p = E.review_inputs(spark, sf_dir)
    return _request_cols(RV.build_review_requests(q, a1, a2, r, p))


def _request_cols(req: DataFrame) -> DataFrame:
    return req.select(F.col("question_id").cast("bigint").alias("question_id"), "category",
                      F.col("reviewer_id").cast("bigint").alias("reviewer_id"),
                      F.col("prompt_id").cast("bigint").alias("prompt_id"),
                      F.col("max_tokens").cast("bigint").alias("max_tokens"), "answer1_id", "answer2_id",
                      "system_prompt", F.length("prompt").cast("bigint").alias("prompt_len"),
                      F.md5("prompt").alias("prompt_md5"))


@register("review_answers", OE.review_answers_sql())
def q_review_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 first pass with the SQL stand-in judge (+ H15, H16)."""
    return _review_cols(E.first_pass(spark, sf_dir))


@register("pending_reviews", OE.pending_reviews_sql())
def q_pending_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews whose judge text did not parse."""
    return _review_cols(RV.pending_reviews(E.first_pass(spark, sf_dir)))


@register("merge_reviews", OE.merge_reviews_sql())
def q_merge_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J4 retry pass + D6: only pending rows are judged again and merged."""
    return _review_cols(E.retried(spark, sf_dir))


@register("review_file_roundtrip", OE.merge_reviews_sql())
def q_review_file_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5 + A4 around J4: the first pass stored as JSON lines, read back,
    retried, stored and read again."""
    return _review_cols(E.stored_reviews(spark, sf_dir))


@register("bucketed_reviews", OE.merge_reviews_sql())
def q_bucketed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """D6 on stored reviews: a retry pass rewrites only the buckets that hold
    a retried question."""
    return _review_cols(E.bucketed_reviews(spark, sf_dir))


@register("eval_tables", OE.review_requests_sql())
def q_eval_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 on files: all five evaluation tables written, read back with the
    reviewers' and prompts' places, and turned into judge requests."""
    return _request_cols(RV.build_review_requests(*E.stored_inputs(spark, sf_dir)))


@register("review_scores", OE.review_scores_sql())
def q_review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 over the merged reviews (C11 rejects score 0 rows)."""
    q = I.questions(spark, sf_dir)
    return _category_out(M.category_scores(E.retried(spark, sf_dir), q))


@register("category_scores", OE.category_scores_sql())
def q_category_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4-style stored reviews (from labels) -> D5 -> H15 -> C11 -> E1."""
    return _category_out(M.category_scores(E.label_reviews(spark, sf_dir), I.questions(spark, sf_dir)))


@register("micro_scores", OE.micro_scores_sql())
def q_micro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E2."""
    m = M.micro_scores(E.label_reviews(spark, sf_dir), I.questions(spark, sf_dir))
    return m.select(F.col("n_reviews").cast("bigint").alias("n_reviews"), F.round("micro_a", 6).alias("micro_a"),
                    F.round("micro_b", 6).alias("micro_b"))


@register("macro_scores", OE.macro_scores_sql())
def q_macro_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of unrounded category means."""
    c = M.category_scores(E.label_reviews(spark, sf_dir), I.questions(spark, sf_dir))
    m = M.macro_scores(c)
    return m.select(F.col("n_categories").cast("bigint").alias("n_categories"),
                    F.round("macro_a", 6).alias("macro_a"), F.round("macro_b", 6).alias("macro_b"))


@register("score_table", OE.score_table_sql())
def q_score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """E1 + E2 (one rollup pass) + E3."""
    t = M.score_table(E.label_reviews(spark, sf_dir), I.questions(spark, sf_dir))
    return t.select("category", F.col("n_reviews").cast("bigint").alias("n_reviews"),
                    F.round("mean_a", 6).alias("mean_a"), F.round("mean_b", 6).alias("mean_b"),
                    F.col("first_qid").cast("bigint").alias("first_qid"))


@register("rejected_reviews", OE.rejected_reviews_sql())
def q_rejected_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 + D5: the reviews that the means leave out, with the reason; each
    label review also stands once under an id that no question has."""
    r = E.label_reviews(spark, sf_dir)
    lost = r.withColumn("question_id", -F.col("question_id"))
    return M.rejected_reviews(r.unionByName(lost), I.questions(spark, sf_dir)).select(
        F.col("question_id").cast("bigint").alias("question_id"), "reason")


@register("misaligned_answers", OE.misaligned_answers_sql())
def q_misaligned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10 in rows, on answers with gaps, repeats and strangers."""
    q, a1, a2, _, _ = E.review_inputs(spark, sf_dir)
    lang = I.documents(spark, sf_dir).select((F.col("doc_id") + 1).alias("question_id"), "lang")
    a1 = a1.join(lang.filter("lang <> 'es'"), "question_id", "left_semi")
    own = a2.select("question_id").join(lang, "question_id")
    x2 = (own.filter("lang <> 'fr'").select("question_id").unionByName(own.filter("lang = 'de'").select("question_id"))
          .unionByName(own.filter("lang = 'es'").select((-F.col("question_id")).alias("question_id"))))
    return RV.misaligned_answers(q, a1, x2).select(F.col("question_id").cast("bigint").alias("question_id"), "reason")


@register("parse_scores", OE.parse_scores_sql())
def q_parse_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H15 over every stored judge text."""
    r = E.label_reviews(spark, sf_dir)
    return r.select(F.col("question_id").cast("bigint").alias("question_id"), "category", "text",
                    F.element_at("score", 1).alias("score_a"), F.element_at("score", 2).alias("score_b"))


@register("contiguous_ids", OE.contiguous_ids_sql())
def q_contiguous_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C9."""
    return RV.require_contiguous_ids(I.questions(spark, sf_dir)).select(
        *[F.col(c).cast("bigint").alias(c) for c in ["n_rows", "min_id", "max_id", "n_distinct"]], "ok")


@register("aligned_answers", OE.aligned_answers_sql())
def q_aligned_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C10."""
    q, a1, a2, _, _ = E.review_inputs(spark, sf_dir)
    return RV.require_aligned(q, a1, a2)


@register("stage2_features", OT.stage2_features_sql())
def q_stage2_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7 stage 2: C3 task prompts (pre/post, type lookup), C5 prefixes."""
    return T.features_report(T.stage2_features(spark, sf_dir))


@register("stage3_features", OT.stage3_features_sql())
def q_stage3_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H7 stage 3: C6 chat prefix, C7 strip, C8 rejects removed."""
    return T.features_report(T.stage3_features(spark, sf_dir))


@register("strip_fields", OT.strip_fields_sql())
def q_strip_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C7 + C8: stripped instruction records and the non-empty flag."""
    from weftmix.operators import examples as EX
    r = EX.instruct_example(I.instruction_rows(spark, sf_dir))
    return r.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                    F.md5("instruction").alias("instruction_md5"), F.md5("input").alias("input_md5"),
                    F.md5("output").alias("output_md5"),
                    F.length("instruction").cast("bigint").alias("n_instruction"),
                    F.length("input").cast("bigint").alias("n_input"),
                    F.length("output").cast("bigint").alias("n_output"), "valid")


# ------------------------------------------------------------- conversations
from weftmix.plans import conversations as CV  # noqa: E402

register("order_turns", CV.order_turns_sql())(CV.order_turns_q)
register("render_prompts", CV.render_prompts_sql())(CV.render_prompts_q)
register("chat_pairs", CV.chat_pairs_sql())(CV.chat_pairs_q)
register("api_messages", CV.api_messages_sql())(CV.api_messages_q)
register("chat_pairs_offset", CV.chat_pairs_sql(2))(CV.chat_pairs_offset_q)
register("api_messages_offset", CV.api_messages_sql(1))(CV.api_messages_offset_q)
register("conversation_records", CV.conversation_records_sql())(CV.conversation_records_q)
register("answer_prompts", CV.answer_prompts_sql())(CV.answer_prompts_q)


# ------------------------------------------------------------ external calls
from weftmix.operators import external as X  # noqa: E402
from weftmix.plans import standins as SI  # noqa: E402
from weftmix.session import scratch_path  # noqa: E402
from weftmix.plans.sqlparts import cps as _cps  # noqa: E402


@register("tokenize_udf", f"""SELECT CAST(doc_id AS BIGINT) AS doc_id, CAST(len({_cps('text')}) AS BIGINT) AS n_ids,
       md5(array_to_string({_cps('text')}, ',')) AS ids_md5 FROM documents""")
def q_tokenize_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Iterator pandas UDF tokenizer (factory once per task) over every
    whole document; the code-point factory makes it checkable in SQL."""
    enc = X.with_tokenizer(X.codepoint_tokenizer_factory)
    d = I.documents(spark, sf_dir).select("doc_id", enc("text").alias("ids"))
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.size("ids").cast("bigint").alias("n_ids"),
                    F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@register("decode_ids", "SELECT CAST(doc_id AS BIGINT) AS doc_id, md5(text) AS text_md5, true AS same FROM documents")
def q_decode_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1 + H2: every document encoded and decoded back."""
    from weftmix.functions import tokens as TK
    d = I.documents(spark, sf_dir).select("doc_id", "text", TK.encode("text", bos=True, eos=True).alias("ids"))
    back = TK.decode("ids")
    return d.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.md5(back).alias("text_md5"), (back == F.col("text")).alias("same"))


def _gen_sql() -> str:
    from weftmix.plans.oracle_eval import QUESTIONS
    pr = ("chr(10) || CASE WHEN length(text) > 0 THEN 'Human: ' || text || chr(10) ELSE 'Human: ' END || "
          "'Assistant: '")
    return f"""WITH {QUESTIONS}
SELECT CAST(question_id AS BIGINT) AS question_id, 'Answer of ' || CAST(length({pr}) AS VARCHAR) || ' characters.' AS text,
       substr(sha256(concat_ws(':', 'model-x', CAST(question_id AS VARCHAR))), 1, 22) AS answer_id,
       'model-x' AS model_id
FROM questions"""


@register("generate_answers", _gen_sql())
def q_generate_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Template prompt -> stand-in model (mapInPandas) -> strip -> answers."""
    a = X.generate_answers(I.questions(spark, sf_dir), "model-x", SI.generator_factory)
    return a.select(F.col("question_id").cast("bigint").alias("question_id"), "text", "answer_id", "model_id")


@register("judge_answers", OE.review_answers_sql())
def q_judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 + J4: the judge as a Python function with retries (mapInPandas);
    flaky calls fail once and are retried; same reviews as the SQL judge."""
    q, a1, a2, r, p = E.review_inputs(spark, sf_dir)
    rv = RV.review_answers(q, a1, a2, r, p, judge_factory=SI.judge_factory,
                           judge_options={"max_retry": 5, "gap": 0.0, "retry_wait": 0.0})
    return _review_cols(rv)


@register("judge_resumed", OE.review_answers_sql())
def q_judge_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J3 with stored answers: a run that stops after the questions with odd
    ids, then the whole run over the same store, four calls open a task."""
    from weftmix.operators.external import judge_stored
    q, a1, a2, r, p = E.review_inputs(spark, sf_dir)
    options = {"store": scratch_path(spark, "answers"), "max_retry": 5, "gap": 0.0, "retry_wait": 0.0, "in_flight": 4, "commit_rows": 64}
    judge_stored(RV.build_review_requests(q.filter("question_id % 2 = 1"), a1, a2, r, p), SI.judge_factory, **options)
    return _review_cols(RV.review_answers(q, a1, a2, r, p, judge_factory=SI.judge_factory, judge_options=options))


# ------------------------------------------------------- training-run tables
from weftmix.plans import runs as RN  # noqa: E402

register("masked_loss", RN.masked_loss_sql())(RN.masked_loss_q)
register("perplexity", RN.perplexity_sql())(RN.perplexity_q)
register("trailing_mean", RN.trailing_mean_sql())(RN.trailing_mean_q)
register("checkpoint_summary", RN.checkpoint_summary_sql())(RN.checkpoint_summary_q)
register("trailing_records", RN.trailing_records_sql())(RN.trailing_records_q)
register("trailing_stream", RN.trailing_records_sql())(RN.trailing_stream_q)
register("training_log", RN.training_log_sql())(RN.training_log_q)
register("embedding_delta", RN.embedding_delta_sql())(RN.embedding_delta_q)
register("embedding_checksum", RN.embedding_checksum_sql())(RN.embedding_checksum_q)
register("shuffled_shards", RN.shuffled_shards_sql())(RN.shuffled_shards_q)
register("training_log_files", RN.training_log_files_sql())(RN.training_log_files_q)
# the table is one file in the check's layout, so all rows are of the first epoch
register("stream_features", f"SELECT *, CAST(0 AS BIGINT) AS epoch FROM ({OT.stage1_features_sql()})")(RN.stream_features_q)
register("stream_mix", OT.stream_mix_sql(RN.STREAM_WEIGHTS, RN.ARRIVALS, RN.ARRIVAL_SEED))(RN.stream_mix_q)


@register("subword_ids", None)
def q_subword_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids by an installed sentencepiece model."""
    from weftmix.operators import subword
    from weftmix.plans import inputs
    d = inputs.documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ids = subword.with_subword_ids(d, subword.public_model())
    return ids.select("doc_id", F.size("ids").cast("bigint").alias("n_ids"), F.md5(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_md5"))


@register("subword_features", None)
def q_subword_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1 -> H7: stage-1 features with the sub-word model, whose begin and end ids are 1 and 2."""
    from weftmix.operators import subword
    return T.features_report(T.stage1_features(spark, sf_dir, tokenizer=subword.SubwordTokenizer(spark, subword.public_model())))
