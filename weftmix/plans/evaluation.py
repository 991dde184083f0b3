"""Evaluation plans over the driver tables: review requests, a deterministic
stand-in judge (a Column expression, so the whole pass stays in SQL),
score parsing, retry/merge and the score tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.functions.review import parse_score_pair
from weftmix.functions.text import seeded_hash
from weftmix.operators import review as rv
from weftmix.operators.joins import known_rows
from weftmix.plans import inputs
from weftmix.session import scratch_path
from weftmix.sources import files as S
from weftmix.sources import review_store as RS

REVIEWER_ROWS = [  # reviewer_id, prompt_id, category (file order matters)
    ("judge-general", 1, "general"),
    ("judge-coding", 2, "coding"),
    ("judge-math", 3, "math"),
]
_TASK = ("Rate both answers from 1 to 10. Write the two scores on the first line, "
         "separated by a space, then explain.")
_MATH_TASK = "Check both solutions step by step, then end with a line 'Output: (score 1, score 2)'."
JUDGE_PROMPT_ROWS = [  # prompt_id, system prompt, template, defaults
    (1, "You compare two answers.",
     "[Question]\n{question}\n\n[Answer A]\n{answer_1}\n\n[Answer B]\n{answer_2}\n\n[Task]\n{prompt}\n",
     {"prompt": _TASK}),
    (2, "You compare two programs.",
     "[Problem]\n{question}\n\n[Solution A]\n{answer_1}\n\n[Solution B]\n{answer_2}\n\n[Task]\n{prompt}\n",
     {"prompt": _TASK}),
    (3, "You check two solutions.",
     "[Math problem]\n{question}\n\n[Answer A]\n{answer_1}\n\n[Answer B]\n{answer_2}\n\n[Task]\n{prompt}\n",
     {"prompt": _MATH_TASK}),
]
EXPLAIN = "Both answers were read."


def reviewers(spark: SparkSession) -> DataFrame:
    rows = [(i, rid, pid, {"temperature": 0.2, "max_tokens": 1024}, f"{cat} reviewer", cat)
            for i, (rid, pid, cat) in enumerate(REVIEWER_ROWS)]
    return known_rows(spark.createDataFrame(rows, "reviewer_idx int, reviewer_id string, prompt_id int, "
                                                  "metadata struct<temperature: double, max_tokens: int>, "
                                                  "description string, category string"), len(rows))


def judge_prompts(spark: SparkSession) -> DataFrame:
    rows = [(i, pid, sp, tpl, d, f"prompt {pid}", "general") for i, (pid, sp, tpl, d) in enumerate(JUDGE_PROMPT_ROWS)]
    return known_rows(spark.createDataFrame(rows, "prompt_idx int, prompt_id int, system_prompt string, "
                                                  "prompt_template string, defaults map<string,string>, "
                                                  "description string, category string"), len(rows))


def stand_in_judge(df: DataFrame, attempt: int):
    """A deterministic judge written as a Column: scores 0..10 from a hash
    of the prompt; the first attempt answers in one of six text shapes
    (some malformed on purpose), a retry always in the clean shape."""
    hp = lambda salt: seeded_hash([F.col("prompt")], salt)
    a = (hp("judge-a") % 11).cast("string")
    b = (hp("judge-b") % 11).cast("string")
    fmt = hp(f"judge-fmt-{attempt}") % 6 if attempt == 0 else F.lit(0).cast("bigint")
    ex = F.lit(EXPLAIN)
    plain = (F.when(fmt == 1, F.concat(a, F.lit(","), b, F.lit("\n"), ex))
             .when(fmt == 2, F.concat(a, F.lit(", "), b, F.lit("\n"), ex))
             .when(fmt == 3, F.lit("error"))
             .when(fmt == 4, F.concat(a, F.lit(" "), b, F.lit(" \n"), ex))
             .when(fmt == 5, F.concat(F.lit("  "), a, F.lit(" "), b, F.lit("\r\n"), ex))
             .otherwise(F.concat(a, F.lit(" "), b, F.lit("\n"), ex)))
    work = F.lit("Working through both answers.\n")
    math = (F.when(fmt == 2, F.concat(work, F.lit("The output tuple is ("), a, F.lit(", "), b, F.lit(").")))
            .when(fmt == 3, F.lit("error"))
            .when(fmt == 4, F.concat(work, F.lit("Scores: ["), a, F.lit(","), b, F.lit("]")))
            .otherwise(F.concat(work, F.lit("Output: ("), a, F.lit(", "), b, F.lit(")"))))
    return F.when(F.col("category") == "math", math).otherwise(plain)


def review_inputs(spark: SparkSession, sf_dir: str):
    q = inputs.questions(spark, sf_dir)
    a1 = inputs.answers(spark, sf_dir, 1, "model-a")
    a2 = inputs.answers(spark, sf_dir, 2, "model-b")
    return q, a1, a2, reviewers(spark), judge_prompts(spark)


def first_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, a1, a2, r, p = review_inputs(spark, sf_dir)
    return rv.review_answers(q, a1, a2, r, p, stand_in_judge)


def retried(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pass, written once (judge calls are expensive and must not be
    recomputed by the retry), then the retry pass merged over it."""
    from weftmix.session import checkpoint_dir
    checkpoint_dir(spark)
    q, a1, a2, r, p = review_inputs(spark, sf_dir)
    prev = rv.review_answers(q, a1, a2, r, p, stand_in_judge).checkpoint(eager=True)
    return rv.review_answers(q, a1, a2, r, p, stand_in_judge, previous=prev)


def stored_inputs(spark: SparkSession, sf_dir: str):
    """The five evaluation tables written as JSON lines and read back."""
    root = scratch_path(spark, "eval")
    schemas = [S.QUESTION_SCHEMA, S.ANSWER_SCHEMA, S.ANSWER_SCHEMA, S.REVIEWER_SCHEMA, S.JUDGE_PROMPT_SCHEMA]
    out = []
    for k, (df, schema) in enumerate(zip(review_inputs(spark, sf_dir), schemas)):
        if schema in (S.REVIEWER_SCHEMA, S.JUDGE_PROMPT_SCHEMA):  # several part files, in the order of their places
            place = "reviewer_idx" if schema == S.REVIEWER_SCHEMA else "prompt_idx"
            df = df.repartitionByRange(3, place).sortWithinPartitions(place).drop(place)
        S.write_jsonl(df, f"{root}/{k}")
        out.append(S.read_eval_table(spark, f"{root}/{k}", schema))
    return tuple(out)


def stored_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pass, stored; read, retried and merged; stored and read again."""
    root = scratch_path(spark, "reviews")
    q, a1, a2, r, p = review_inputs(spark, sf_dir)
    S.write_jsonl(rv.review_records(rv.review_answers(q, a1, a2, r, p, stand_in_judge)), f"{root}/first")
    first = S.read_eval_table(spark, f"{root}/first", S.REVIEW_SCHEMA)
    S.write_jsonl(rv.review_records(rv.review_answers(q, a1, a2, r, p, stand_in_judge, previous=first)), f"{root}/merged")
    return S.read_eval_table(spark, f"{root}/merged", S.REVIEW_SCHEMA)


REVIEW_BUCKETS = 16


def bucketed_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First pass in a store of buckets; the pending ones judged again and put
    in their places."""
    path = scratch_path(spark, "review-store")
    q, a1, a2, r, p = review_inputs(spark, sf_dir)
    RS.write_review_store(rv.review_answers(q, a1, a2, r, p, stand_in_judge), path, REVIEW_BUCKETS)
    todo = rv.pending_reviews(RS.read_review_store(spark, path)).select("question_id")
    again = rv.build_review_requests(q.join(todo, "question_id", "left_semi"), a1, a2, r, p, retry=True)
    RS.merge_into_store(spark, path, rv.to_reviews(rv.attach_judgement(again, stand_in_judge, 1)))
    return RS.read_review_store(spark, path)


def label_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored-review stand-in from ``labels``: judge text whose two scores
    follow quality and toxicity, in one of five text shapes, joined to the
    question's category (D5) and parsed (H15)."""
    lab = inputs.table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    hd = lambda salt: seeded_hash([F.col("doc_id")], salt)
    a = (F.lit(1) + F.col("quality") * 5 + hd("label-a") % 4).cast("string")
    b = (F.lit(1) + F.col("toxic") * 5 + hd("label-b") % 4).cast("string")
    v = hd("label-fmt") % 5
    mid = F.lit("\nExplanation.\n")
    text = (F.when(v == 1, F.concat(a, F.lit(","), b, mid, F.lit("Output: ("), a, F.lit(","), b, F.lit(")")))
            .when(v == 2, F.concat(a, F.lit(", "), b, mid, F.lit("The output tuple is ("), a, F.lit(", "), b,
                                   F.lit(").")))
            .when(v == 3, F.concat(a, F.lit(" "), b, F.lit(" "), mid, F.lit("Output: ("), a, F.lit(", "), b,
                                   F.lit(")")))
            .when(v == 4, F.lit("error"))
            .otherwise(F.concat(a, F.lit(" "), b, mid, F.lit("Output: ("), a, F.lit(", "), b, F.lit(")"))))
    r = lab.select((F.col("doc_id") + 1).alias("question_id"), text.alias("text"))
    q = inputs.questions(spark, sf_dir).select("question_id", "category")
    return (r.join(q, "question_id", "inner")
            .withColumn("score", parse_score_pair(F.col("text"), F.col("category"))))
