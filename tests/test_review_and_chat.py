"""H8-H15, C9-C12, D3-D6, E1-E3 on small inline rows of our own."""

import pytest
from pyspark.sql import functions as F

from weftmix.functions.chat import STYLES, render_prompt, to_api_messages, to_chat_pairs
from weftmix.functions.review import fill_template, parse_score_pair
from weftmix.operators import metrics as M
from weftmix.operators import review as RV
from weftmix.operators.chat import chat_template, order_turns


@pytest.mark.parametrize("text,cat,want", [
    ("9 7\nbecause", "generic", [9.0, 7.0]),
    ("9,7\nbecause", "generic", [9.0, 7.0]),
    ("9, 7\nbecause", "generic", [-1.0, -1.0]),
    ("9 7 \nbecause", "generic", [-1.0, -1.0]),
    ("error", "generic", [-1.0, -1.0]),
    ("  8.5 6\r\nx", "coding", [8.5, 6.0]),
    ("work\nOutput: (7, 1)", "math", [7.0, 1.0]),
    ("work\nThe output tuple is (7, 2).", "math", [-1.0, -1.0]),
    ("work\n[3,4]", "math", [3.0, 4.0]),
    (None, "math", [-1.0, -1.0]),
])
def test_parse_score_pair(spark, text, cat, want):
    df = spark.createDataFrame([(text, cat)], "t string, c string")
    assert df.select(parse_score_pair(F.col("t"), F.col("c")).alias("s")).first().s == want


def test_fill_template_single_pass(spark):
    df = spark.createDataFrame([("Q?", "has {answer_2} inside", "B", {"prompt": "P"})],
                               "q string, a1 string, a2 string, d map<string,string>")
    tpl = F.lit("[{question}] 1:{answer_1} 2:{answer_2} {prompt}")
    v = df.select(fill_template(tpl, {"question": F.col("q"), "answer_1": F.col("a1"), "answer_2": F.col("a2")},
                                F.col("d")).alias("p")).first().p
    assert v == "[Q?] 1:has {answer_2} inside 2:B P"


def _py_render(style, system, msgs, sep="\n", sep2="</s>"):
    """The rendering rules written as a plain loop (from the survey)."""
    seps = [sep, sep2]
    if style == "ADD_COLON_SINGLE":
        ret = system + sep
        for r, m in msgs:
            ret += r + ": " + m + sep if m else r + ": "
    elif style == "ADD_COLON_TWO":
        ret = system + seps[0]
        for i, (r, m) in enumerate(msgs):
            ret += r + ": " + m + seps[i % 2] if m else r + ": "
    elif style == "NO_COLON_SINGLE":
        ret = system
        for r, m in msgs:
            ret += r + m + sep if m else r
    elif style == "BAIZE":
        ret = system + "\n"
        for r, m in msgs:
            ret += r + m + "\n" if m else r
    elif style == "DOLLY":
        ret = system
        for i, (r, m) in enumerate(msgs):
            if m:
                ret += r + ":\n" + m + seps[i % 2] + ("\n\n" if i % 2 == 1 else "")
            else:
                ret += r + ":\n"
    else:
        ret = system
        for r, m in msgs:
            ret += (r + ": " + m.replace("\r\n", "\n").replace("\n\n", "\n") + "\n\n") if m else r + ":"
    return ret


def test_render_all_styles_against_loop(spark):
    convs = [("sys", [("Human", "hi\r\n\n\nthere"), ("Assistant", "yo"), ("Human", ""), ("Assistant", None)]),
             ("", [("Human", "q")]), ("s", [])]
    rows = [(i, s, [(j, r, m) for j, (r, m) in enumerate(ms)]) for i, (s, ms) in enumerate(convs)]
    df = spark.createDataFrame(rows, "id int, system string, messages array<struct<turn:int,role:string,text:string>>")
    for style in STYLES:
        got = [r.p for r in df.orderBy("id").select(render_prompt("system", "messages", style, "\n", "</s>")
                                                   .alias("p")).collect()]
        assert got == [_py_render(style, s, ms) for s, ms in convs], style


def test_template_demo_prompt(spark):
    tpl = chat_template("HUMAN-ASSISTANT")
    df = spark.createDataFrame([([(0, "Human", "Is 7 odd?"), (1, "Assistant", None)],)],
                               "m array<struct<turn:int,role:string,text:string>>")
    p = df.select(render_prompt(F.lit(tpl["system"]), "m", tpl["style"], tpl["sep"]).alias("p")).first().p
    assert p == "\nHuman: Is 7 odd?\nAssistant: "
    with pytest.raises(NotImplementedError):
        chat_template("unknown")


def test_pairs_and_api_messages(spark):
    df = spark.createDataFrame([([(0, "Human", "a"), (1, "Assistant", "b"), (2, "Human", "c")],)],
                               "m array<struct<turn:int,role:string,text:string>>")
    r = df.select(to_chat_pairs("m").alias("p"), to_api_messages(F.lit("S"), "m").alias("a")).first()
    assert [tuple(x) for x in r.p] == [("a", "b"), ("c", None)]
    assert [tuple(x) for x in r.a] == [("system", "S"), ("user", "a"), ("assistant", "b"), ("user", "c")]


def test_order_turns(spark):
    c = spark.createDataFrame([(1, 2, "user", "u2"), (1, 0, "system", "S"), (1, 1, "user", "u1")],
                              "conv_id long, turn long, role string, text string")
    r = order_turns(c).first()
    assert r.system == "S" and [m.text for m in r.messages] == ["u1", "u2"] and r.messages[0].role == "Human"


def _reviews(spark, rows):
    return spark.createDataFrame(rows, "question_id long, score array<double>")


def test_scores_and_checks(spark):
    q = spark.createDataFrame([(1, "x", "b"), (2, "y", "a"), (3, "z", "a"), (4, "w", "c")],
                              "question_id long, text string, category string")
    r = _reviews(spark, [(1, [8.0, 6.0]), (2, [6.0, 2.0]), (3, [9.0, 5.0]), (4, [0.0, 3.0])])
    cats = {x.category: x for x in M.category_scores(r, q).collect()}
    assert set(cats) == {"a", "b"}                      # score 0 rejected, empty category skipped
    assert cats["a"].n_reviews == 2 and cats["a"].mean_a == 7.5
    micro = M.micro_scores(r, q).first()
    assert micro.n_reviews == 3 and abs(micro.micro_a - 23 / 3) < 1e-12
    macro = M.macro_scores(M.category_scores(r, q)).first()
    assert abs(macro.macro_a - (7.5 + 8.0) / 2) < 1e-12
    assert RV.require_contiguous_ids(q).first().ok
    pend = RV.pending_reviews(_reviews(spark, [(1, [-1.0, -1.0]), (2, [0.0, 5.0])])).collect()
    assert [p.question_id for p in pend] == [1]         # a score of 0 is not retried


def test_route_reviewer(spark):
    rv = spark.createDataFrame([(0, 1, "general"), (1, 2, "coding"), (2, 3, "math"), (3, 4, "math")],
                               "reviewer_idx int, prompt_id int, category string")
    df = spark.createDataFrame([(1, "math"), (2, "coding"), (3, "poetry")], "question_id long, category string")
    got = sorted((r.question_id, r.reviewer_id, r.prompt_id) for r in RV.route_reviewer(df, rv).collect())
    assert got == [(1, 3, 3), (2, 2, 2), (3, 1, 1)]


def test_merge_reviews_only_reparses_new(spark):
    old = spark.createDataFrame([(1, "t1", [7.0, 2.0]), (2, "bad", [-1.0, -1.0])],
                                "question_id long, text string, score array<double>")
    new = spark.createDataFrame([(2, "5 4\nok", [5.0, 4.0])], "question_id long, text string, score array<double>")
    got = sorted((r.question_id, r.text, tuple(r.score)) for r in RV.merge_reviews(old, new).collect())
    assert got == [(1, "t1", (7.0, 2.0)), (2, "5 4\nok", (5.0, 4.0))]


def test_require_aligned(spark):
    q = spark.createDataFrame([(1,), (2,)], "question_id long")
    a = spark.createDataFrame([(1,), (3,)], "question_id long")
    r = RV.require_aligned(q, q, a).first()
    assert not r.ok and r.missing2 == 1 and r.extra == 1


def test_require_scored_and_templates(spark):
    from weftmix.operators.chat import chat_template
    r = _reviews(spark, [(1, [8.0, 6.0]), (2, [0.0, 2.0]), (3, [-1.0, -1.0])])
    ok, bad = RV.require_scored(r)
    assert ok.count() == 1 and bad.count() == 2
    t = chat_template("Human-Assistant")
    assert t["roles"] == ("Human", "Assistant") and t["sep"] == "\n"


def test_row_parallel_pairs_and_api_match_array_forms(spark):
    from weftmix.operators.chat import api_messages_table, chat_pairs_table
    rows = [(1, 0, "system", "S"), (1, 1, "user", "u1"), (1, 2, "assistant", None), (1, 3, "user", "u2"),
            (1, 4, "assistant", "a2"), (1, 5, "user", "u3"), (2, 0, "user", "q")]
    c = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    packed = order_turns(c)
    arr = {r.conv_id: r for r in packed.select("conv_id", to_chat_pairs("messages").alias("p"),
                                               to_api_messages("system", "messages").alias("a")).collect()}
    pairs = {}
    for r in chat_pairs_table(c).collect():
        pairs.setdefault(r.conv_id, []).append((r.pair_idx, r.user, r.reply))
    for cid, r in arr.items():
        assert [(u, v) for _, u, v in sorted(pairs[cid])] == [tuple(x) for x in r.p]
    api = {}
    for r in api_messages_table(c).collect():
        api.setdefault(r.conv_id, []).append((r.msg_idx, r.role, r.content))
    for cid, r in arr.items():
        assert [(role, ct) for _, role, ct in sorted(api[cid])] == [tuple(x) for x in r.a]
    assert [m for m in sorted(api[1])][2] == (2, "user", "u2")      # the NULL reply was dropped


def test_review_records_roundtrip(spark, tmp_path):
    import json
    import os
    from weftmix.sources.files import REVIEW_SCHEMA, read_eval_table, write_jsonl
    judged = spark.createDataFrame([(3, "a1", "a2", 1, "8 6\nok", "generic")],
                                   "question_id long, answer1_id string, answer2_id string, reviewer_id int, "
                                   "text string, category string")
    recs = RV.review_records(RV.to_reviews(judged))
    out = str(tmp_path / "rev")
    write_jsonl(recs, out)
    line = [ln for p in os.listdir(out) if p.endswith(".json") for ln in open(os.path.join(out, p))][0]
    obj = json.loads(line)
    assert list(obj) == RV.REVIEW_FIELDS and obj["metadata"] == {} and obj["score"] == [8.0, 6.0]
    back = read_eval_table(spark, out, REVIEW_SCHEMA).first()
    assert back.review_id == obj["review_id"] and len(back.review_id) == 22
