"""Stops, reject lists and file round trips of the corpus and review paths."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from weftmix.functions.review import fill_template
from weftmix.operators import chat, metrics, review
from weftmix.operators.external import judge
from weftmix.operators.mixing import file_offsets, mix_spec, select_files
from weftmix.plans import evaluation as E
from weftmix.plans import training
from weftmix.sources import files as S

Q = "question_id bigint, text string, category string"
A = "question_id bigint, text string, answer_id string"


def review_tables(spark):
    q = spark.createDataFrame([(1, "q1", "generic"), (2, "q2", "math"), (3, "q3", "coding")], Q)
    a1 = spark.createDataFrame([(i, f"a{i}", f"x{i}") for i in (1, 2, 3)], A)
    a2 = spark.createDataFrame([(i, f"b{i}", f"y{i}") for i in (1, 2, 3)], A)
    return q, a1, a2, E.reviewers(spark), E.judge_prompts(spark)


def test_review_stops_on_inputs_that_do_not_match(spark):
    q, a1, a2, r, p = review_tables(spark)
    good = review.review_answers(q, a1, a2, r, p, E.stand_in_judge)
    assert good.count() == 3
    with pytest.raises(ValueError, match="one to one"):
        review.review_answers(q, a1.filter("question_id < 3"), a2, r, p, E.stand_in_judge)
    with pytest.raises(ValueError, match="one to one"):
        review.review_answers(q, a1, a2.union(a2.limit(1)), r, p, E.stand_in_judge)
    with pytest.raises(ValueError, match="place in the file"):
        review.review_answers(q, a1, a2, r, p.withColumn("prompt_idx", F.col("prompt_idx") + 1), E.stand_in_judge)
    with pytest.raises(ValueError, match="without a judge prompt"):
        review.review_answers(q, a1, a2, r, p.filter("prompt_id < 3"), E.stand_in_judge)
    old = good.withColumn("question_id", F.col("question_id") + 1)
    with pytest.raises(ValueError, match="previous review"):
        review.review_answers(q, a1, a2, r, p, E.stand_in_judge, previous=old)


def test_lenient_review_lists_what_it_leaves_out(spark):
    q, a1, a2, r, p = review_tables(spark)
    less, few = a1.filter("question_id > 1"), p.filter("prompt_id <> 2")
    assert review.review_answers(q, less, a2, r, few, E.stand_in_judge, strict=False).count() == 1
    got = {x["question_id"]: x["reason"] for x in review.request_rejects(q, less, a2, r, few).collect()}
    assert got == {1: "no answer1", 3: "no judge prompt"}
    odd = p.withColumn("prompt_template", F.when(F.col("prompt_id") == 1, "{nobody}").otherwise(F.col("prompt_template")))
    assert [(x["question_id"], x["reason"]) for x in review.request_rejects(q, a1, a2, r, odd).collect()] == [(1, "template field unknown")]


@pytest.mark.parametrize("template,want", [
    ("x {{y}} {question}", "x {y} Q"), ("{{{question}}}", "{Q}"), ('{{"a": "{question}"}}', '{"a": "Q"}'), ("{{}}", "{}"),
    ("{nobody}", None), ("lone } brace", None), ("lone { brace", None)])
def test_template_braces(spark, template, want):
    df = spark.createDataFrame([("Q", template)], "q string, t string")
    assert df.select(fill_template("t", {"question": F.col("q")}).alias("p")).first().p == want


def test_scores_count_rejects_and_keep_question_order(spark):
    q = spark.createDataFrame([(1, "", "b"), (2, "", "a"), (3, "", "b")], Q)
    r = spark.createDataFrame([(1, [0.0, 5.0]), (2, [4.0, 6.0]), (3, [8.0, 2.0]), (9, [3.0, 3.0]), (2, None)], "question_id bigint, score array<double>")
    rows = metrics.category_scores(r, q).orderBy("first_qid").collect()
    assert [(x["category"], x["mean_a"], x["first_qid"]) for x in rows] == [("b", 8.0, 1), ("a", 4.0, 2)]
    bad = sorted((x["question_id"], x["reason"]) for x in metrics.rejected_reviews(r, q).collect())
    assert bad == [(1, "no two positive scores"), (2, "no two positive scores"), (9, "unknown question")]
    for f in (metrics.category_scores, metrics.micro_scores, metrics.score_table):
        with pytest.raises(Exception, match="review of question"):
            f(r, q, strict=True).collect()


def test_means_known_by_hand(spark, tmp_dir):
    """Questions and reviews as stored files, read back and scored."""
    cats = ["x"] * 3 + ["y"] * 2
    scores = [(9, 7), (8, 6), (7, 5), (4, 2), (6, 3)]
    with open(f"{tmp_dir}/q.jsonl", "w") as f:
        f.writelines(json.dumps({"question_id": i + 1, "text": "t", "category": c}) + "\n" for i, c in enumerate(cats))
    with open(f"{tmp_dir}/r.jsonl", "w") as f:
        f.writelines(json.dumps({"review_id": f"r{i}", "question_id": i + 1, "answer1_id": "a", "answer2_id": "b", "reviewer_id": 1,
                                 "metadata": {}, "text": f"{a} {b}", "score": [a, b]}) + "\n" for i, (a, b) in enumerate(scores))
    q, r = S.read_eval_table(spark, f"{tmp_dir}/q.jsonl", S.QUESTION_SCHEMA), S.read_eval_table(spark, f"{tmp_dir}/r.jsonl", S.REVIEW_SCHEMA)
    cat = metrics.category_scores(r, q, strict=True)
    micro, macro = metrics.micro_scores(r, q).first(), metrics.macro_scores(cat).first()
    assert (micro["micro_a"], micro["micro_b"]) == pytest.approx((6.8, 4.6))
    assert (macro["macro_a"], macro["macro_b"]) == pytest.approx((6.5, 4.25))


def test_stored_reviewers_and_prompts_carry_their_place(spark, tmp_dir):
    def write(name, rows):
        with open(f"{tmp_dir}/{name}", "w") as f:
            f.writelines(json.dumps(r) + "\n" for r in rows)
    write("reviewer.jsonl", [{"reviewer_id": f"r{i}", "prompt_id": i + 1, "metadata": {"temperature": 0.2, "max_tokens": 9}, "description": "", "category": c}
                             for i, c in enumerate(("general", "coding", "math"))])
    write("prompt.jsonl", [{"prompt_id": i + 1, "system_prompt": f"s{i}", "prompt_template": "{question}|{answer_1}|{answer_2}|{prompt}",
                            "defaults": {"prompt": "p"}, "description": "", "category": "c"} for i in range(3)])
    r, p = S.read_eval_table(spark, f"{tmp_dir}/reviewer.jsonl", S.REVIEWER_SCHEMA), S.read_eval_table(spark, f"{tmp_dir}/prompt.jsonl", S.JUDGE_PROMPT_SCHEMA)
    assert sorted((x["reviewer_id"], x["reviewer_idx"]) for x in r.collect()) == [("r0", 0), ("r1", 1), ("r2", 2)]
    q, a1, a2, _, _ = review_tables(spark)
    first = review.review_answers(q, a1, a2, r, p, E.stand_in_judge)
    S.write_jsonl(review.review_records(first), f"{tmp_dir}/review")
    back = S.read_eval_table(spark, f"{tmp_dir}/review", S.REVIEW_SCHEMA)
    again = review.review_answers(q, a1, a2, r, p, E.stand_in_judge, previous=back)
    assert again.count() == 3 and metrics.rejected_reviews(again, q).filter("reason like 'unknown%'").isEmpty()


def test_shards_come_back_as_a_corpus(spark, tmp_dir):
    df = spark.range(500).select(F.col("id").alias("n"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    n = S.write_shuffled_shards(df, f"{tmp_dir}/c/en", None, 3, ["n"], world_size=2, shard_bytes=2000)
    assert n > 2
    spec = mix_spec(spark, [("en", 1)])
    rows = S.read_mixed_corpus(spark, f"{tmp_dir}/c", spec, "n bigint, text string", 2)
    got = rows.select("rank", "row_idx", "n").collect()
    assert sorted(x["n"] for x in got) == list(range(500))
    for rank in (0, 1):
        own = sorted(x["row_idx"] for x in got if x["rank"] == rank)
        assert own == list(range(len(own)))
    assert [x["n"] for x in sorted(got, key=lambda x: (x["rank"], x["row_idx"]))] != list(range(500))
    files = select_files(S.list_corpus_files(spark, f"{tmp_dir}/c", ["en"]), mix_spec(spark, [("en", 1, 2)]))
    assert sorted(x["file_no"] for x in files.collect()) == list(range(2, n))


def test_malformed_lines_stop_or_are_listed(spark, tmp_dir):
    os.makedirs(f"{tmp_dir}/c/en")
    with open(f"{tmp_dir}/c/en/1.jsonl", "w") as f:
        f.write('{"text": "a"}\nnot json\n{"text": "b"}\n')
    spec, c = mix_spec(spark, [("en", 1)]), f"{tmp_dir}/c/en"
    files = select_files(S.list_corpus_files(spark, f"{tmp_dir}/c", ["en"]), spec)
    with pytest.raises(Exception, match="(?i)malformed"):
        S.read_corpus(spark, c, "text string", files).collect()
    kept = S.number_lines(S.read_corpus(spark, c, "text string", files, strict=False)).collect()
    assert sorted(x["text"] for x in kept) == ["a", "b"]
    assert [x["line"] for x in S.corpus_rejects(spark, c, "text string", spec=spec).collect()] == ["not json"]


def test_several_system_turns_and_offsets(spark):
    rows = [(1, 0, "system", "zzz"), (1, 1, "user", "u1"), (1, 2, "assistant", "a1"), (1, 3, "system", "aaa"), (1, 4, "user", "u2"), (1, 5, "assistant", "a2")]
    c = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    assert chat.order_turns(c).first()["system"] == "zzz\naaa"
    assert [(x["user"], x["reply"]) for x in chat.chat_pairs_table(c, offset=2).collect()] == [("u2", "a2")]
    got = sorted((x["msg_idx"], x["role"], x["content"]) for x in chat.api_messages_table(c, offset=1).collect())
    assert got == [(0, "system", "zzz\naaa"), (1, "user", "a1"), (2, "assistant", "u2"), (3, "user", "a2")]


def test_judge_keeps_its_rate_over_stated_partitions(spark):
    req = spark.range(6).select(F.col("id").alias("question_id"), F.lit("s").alias("system_prompt"), F.lit("p").alias("prompt"), F.lit(9).alias("max_tokens"))

    def factory():
        return lambda s, p, m: f"{time.time()}"
    out = judge(req, factory, gap=0.4, partitions=3).withColumn("part", F.spark_partition_id())
    rows = out.collect()
    by = {}
    for r in rows:
        by.setdefault(r["part"], []).append(float(r["text"]))
    assert len(rows) == 6 and set(by) <= {0, 1, 2}
    for calls in by.values():
        calls.sort()
        assert all(b - a >= 1.1 for a, b in zip(calls, calls[1:], strict=False))


def test_stage3_file_names_never_collide(spark, tmp_dir):
    rows = [(i, t, r, f"{r} {i}") for i in (5, 1_600_000, 1_600_016, 16_000_000) for t, r in ((0, "user"), (1, "assistant"), (2, "user"))]
    spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").write.parquet(f"{tmp_dir}/conversations.parquet")
    src = training.instruct_source(spark, tmp_dir).collect()
    assert {(r["conv_id"], r["file_name"]) for r in src} == {(5, "00000.jsonl"), (1_600_000, "100000.jsonl"), (1_600_016, "100001.jsonl"), (16_000_000, "1000000.jsonl")}
    assert len(src) == 8 and len({r["doc_id"] for r in src}) == 8
    assert sorted(r["output"] for r in src)[:4] == [""] * 4  # turns without a reply stay


def test_file_offsets_over_many_blocks(spark, monkeypatch):
    from weftmix.operators import mixing
    monkeypatch.setattr(mixing, "OFFSET_BLOCK", 3)
    shards = spark.createDataFrame([("t", 0, i, i + 1) for i in range(10)], "tag string, rank int, rank_file_ord int, n_file bigint")
    got = sorted((r["rank_file_ord"], r["file_offset"], r["n_rows"]) for r in file_offsets(shards).collect())
    assert got == [(i, i * (i + 1) // 2, 55) for i in range(10)]
