"""Text helpers (strip class, seeded hash) and token arrays (H1-H7)."""

import hashlib

from pyspark.sql import functions as F

from weftmix.functions.text import loss_split_point, py_rstrip, py_strip, seeded_hash
from weftmix.functions.tokens import codepoints, decode, encode, lm_mask, pad, seq2seq_mask, truncate
from weftmix.operators import examples as ex
from weftmix.operators.features import make_features

WS = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())


def test_strip_matches_python_on_every_whitespace(spark):
    texts = [f"{w}x y{w}" for w in WS] + ["　 a\r\n", "", "   ", "a"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [(r.s, r.r) for r in df.select(py_strip("t").alias("s"), py_rstrip("t").alias("r")).collect()]
    assert got == [(t.strip(), t.rstrip()) for t in texts]


def test_seeded_hash_is_md5_prefix(spark):
    df = spark.createDataFrame([(5, "k")], "a long, b string")
    v = df.select(seeded_hash(["a", "b"], "salt").alias("h")).first().h
    assert v == int(hashlib.md5(b"5|k|salt").hexdigest()[:8], 16)


def test_codepoint_tokenizer_roundtrip(spark):
    texts = ["abc", "", "a😀b", "中文\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select(codepoints("t").alias("ids"), decode(encode("t")).alias("back")).collect()
    assert [r.ids for r in rows] == [[ord(c) + 3 for c in t] for t in texts]
    assert [r.back for r in rows] == texts


def test_split_point_range(spark):
    df = spark.range(2, 400).select(F.col("id").alias("n"))
    rows = df.select("n", loss_split_point(F.col("n"), ["n"]).alias("p")).collect()
    for r in rows:
        lo, hi = int(0.2 * r.n) + 1, int(0.7 * r.n)
        assert lo <= r.p <= hi


def test_masks_and_padding(spark):
    df = spark.createDataFrame([([5, 6, 7, 8],)], "a array<int>")
    r = df.select(truncate("a", 3).alias("t"), seq2seq_mask(F.lit(2), F.lit(3)).alias("m"),
                  lm_mask(F.lit(4), F.lit(1)).alias("l"), pad("a", F.lit(6)).alias("p")).first()
    assert r.t == [5, 6, 7] and r.m == [0, 0, 1, 1, 1] and r.l == [0, 1, 1, 1] and r.p == [5, 6, 7, 8, 0, 0]


def _examples(spark, rows):
    df = spark.createDataFrame(rows, "rank int, batch_id long, global_pos long, kind string, input string, "
                                     "output string, prompt string, prompt_pos string, instruction string")
    return df


def test_features_semantics(spark):
    rows = [(0, 0, 0, "lm", "", None, None, None, None),                # empty text: [bos, eos]
            (0, 0, 1, "translate", "hello", "bonjour", "P", None, None),
            (0, 1, 20, "translate", "x" * 30, "yy", "P", None, None)]   # prefix longer than max_len
    df = ex.with_prefix(_examples(spark, rows), 1)
    out = {r.global_pos: r for r in make_features(df, 16).collect()}
    e = out[0]
    assert e.input_ids[:2] == [1, 2] and e.loss_mask[:2] == [0, 1] and e.n_target == 1
    t = out[1]
    prefix = [1] + [ord(c) + 3 for c in "hello\nP"]
    tail = [ord(c) + 3 for c in "bonjour"] + [2]
    assert t.input_ids[:16] == (prefix + tail)[:16]
    assert t.loss_mask == [0] * len(prefix) + [1] * (16 - len(prefix))
    assert out[20].n_target == 0 and out[20].loss_mask == [0] * 16
    # a batch shares one padded length
    assert len(e.input_ids) == len(t.input_ids) == e.pad_len


def test_stage_prefixes(spark):
    rows = [(0, 0, 0, "task", "in  \n", "out", "Pre", "pre", None),
            (0, 0, 1, "task", "in  \n", "out", "Post", "post", None),
            (0, 0, 2, "task", "in \n", "out", None, None, None)]
    got = {r.global_pos: r.prefix for r in ex.with_prefix(_examples(spark, rows), 2).collect()}
    assert got == {0: "Pre\nin\n\n", 1: "in\nPost\n", 2: "in \n "}
    d = spark.createDataFrame([(" Do it　", "\r\nctx ", " ok ")], "instruction string, input string, output string")
    r = ex.with_prefix(ex.instruct_example(d), 3).first()
    assert r.prefix == "Human: Do it\nctx\nAssistant: " and r.output == "ok" and r.valid


def test_require_nonempty(spark):
    d = spark.createDataFrame([(" ", "　", "x"), ("a", "", "y")], "instruction string, input string, output string")
    ok, bad = ex.require_nonempty(ex.instruct_example(d))
    assert ok.count() == 1 and bad.count() == 1


def test_task_prompt_lookup(spark):
    pools = ex.prompt_pools(spark, {"t1.pre": ["A  "], "t1.post": ["B"], "t2.pre": ["C"]})
    rows = [(i, "q", "ans  ", t) for i in range(200) for t in ["t1", "t2", "", None]]
    df = spark.createDataFrame(rows, "k long, input string, output string, type string")
    out = ex.task_example(df, pools, ["k", "type"]).collect()
    for r in out:
        assert r.output == "ans"
        if not r.type:
            assert r.prompt is None
        if r.type == "t1":
            assert (r.prompt_pos, r.prompt) in {("pre", "A"), ("post", "B")}
    t2 = [r for r in out if r.type == "t2"]
    # only a 'pre' pool: prompted on about half of the draws
    assert 50 < sum(r.prompt is not None for r in t2) < 150
