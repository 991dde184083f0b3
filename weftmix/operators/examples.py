"""Example construction.

Every record kind becomes one unified row shape::

    kind STRING          -- 'lm' | 'translate' | 'task' | 'instruct'
    input STRING, output STRING, prompt STRING, prompt_pos STRING ('pre'|'post'),
    instruction STRING

Random choices of the reference (direction, prompt, prompt position) are
seeded hashes of the draw key, so reruns and task retries agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.functions.text import choose_index, choose_one, py_rstrip, py_strip
from weftmix.operators.joins import bounded_broadcast, known_rows

POOL_SCHEMA = "pool_key string, prompts array<string>"
# Translation directions and the prompt positions, in the
# order the reference draws from them.
DIRECTIONS = ["en-zh", "zh-en"]
PROMPT_POSITIONS = ["post", "pre"]

UNIFIED_COLS = ["kind", "input", "output", "prompt", "prompt_pos", "instruction"]


def prompt_pools(spark: SparkSession, pools: dict) -> DataFrame:
    """An in-memory prompt pool table ``pool_key -> prompts``."""
    return known_rows(spark.createDataFrame([(k, list(v)) for k, v in pools.items()], POOL_SCHEMA), len(pools))


def _null_str() -> Column:
    return F.lit(None).cast("string")


def lm_example(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Plain text; no output, no prompt."""
    return (df.withColumn("kind", F.lit("lm")).withColumn("input", F.col(text_col))
            .withColumn("output", _null_str()).withColumn("prompt", _null_str())
            .withColumn("prompt_pos", _null_str()).withColumn("instruction", _null_str()))


def _pick_prompt(df: DataFrame, pools: DataFrame, key_col: str, draw_key, salt: str) -> DataFrame:
    """Look up the pool by ``key_col`` (left join, unknown key = no prompt)
    and choose one prompt of it with a seeded hash."""
    p = bounded_broadcast(pools).select(F.col("pool_key").alias("_pk"), F.col("prompts").alias("_prompts"))
    out = df.join(p, F.col(key_col) == F.col("_pk"), "left")
    idx = choose_index(draw_key, salt, F.coalesce(F.size("_prompts"), F.lit(0)))
    return out.withColumn("_picked", F.try_element_at(F.col("_prompts"), idx + 1)).drop("_pk", "_prompts")


def translate_example(df: DataFrame, pools: DataFrame, draw_key, en_col: str = "en_text",
                      zh_col: str = "zh_text", prompt_pos: str | None = None) -> DataFrame:
    """Choose a direction, swap input/output, attach a translation prompt
    from the pool named by the direction. ``prompt_pos='post'`` is the
    stage-2 form (the prompt follows the input)."""
    d = df.withColumn("_dir", choose_one(draw_key, "direction", DIRECTIONS))
    d = _pick_prompt(d, pools, "_dir", draw_key, "translate-prompt")
    en_zh = F.col("_dir") == DIRECTIONS[0]
    return (d.withColumn("kind", F.lit("translate"))
            .withColumn("input", F.when(en_zh, F.col(en_col)).otherwise(F.col(zh_col)))
            .withColumn("output", F.when(en_zh, F.col(zh_col)).otherwise(F.col(en_col)))
            .withColumn("prompt", F.col("_picked"))
            .withColumn("prompt_pos", F.lit(prompt_pos).cast("string"))
            .withColumn("instruction", _null_str())
            .drop("_dir", "_picked"))


def task_example(df: DataFrame, pools: DataFrame, draw_key, input_col: str = "input",
                 output_col: str = "output", type_col: str = "type") -> DataFrame:
    """``output.rstrip()``; draw the prompt position first, then look up
    ``<type>.<pos>``; an empty/NULL type or an unknown key gives no prompt
    (so a type with only a ``pre`` pool is prompted on about half the draws)."""
    d = df.withColumn("_pos", choose_one(draw_key, "prompt-pos", PROMPT_POSITIONS))
    d = d.withColumn("_key", F.when(F.length(F.coalesce(F.col(type_col), F.lit(""))) > 0,
                                    F.concat(F.col(type_col), F.lit("."), F.col("_pos"))))
    d = _pick_prompt(d, pools, "_key", draw_key, "task-prompt")
    prompt = py_rstrip(F.col("_picked"))
    return (d.withColumn("kind", F.lit("task"))
            .withColumn("input", F.col(input_col))
            .withColumn("output", py_rstrip(F.col(output_col)))
            .withColumn("prompt", prompt)
            .withColumn("prompt_pos", F.when(F.col("_picked").isNotNull(), F.col("_pos")))
            .withColumn("instruction", _null_str())
            .drop("_pos", "_key", "_picked"))


def strip_fields(df: DataFrame, cols=("instruction", "input", "output")) -> DataFrame:
    """``strip()`` every field; a NULL field counts as empty."""
    for c in cols:
        df = df.withColumn(c, py_strip(F.coalesce(F.col(c), F.lit(""))))
    return df


def instruct_example(df: DataFrame) -> DataFrame:
    """C7 + C8 flag: stripped instruction record with ``valid`` = instruction
    and input are not both empty."""
    d = strip_fields(df)
    return (d.withColumn("kind", F.lit("instruct"))
            .withColumn("prompt", _null_str()).withColumn("prompt_pos", _null_str())
            .withColumn("valid", (F.length("instruction") + F.length("input")) > 0))


def require_nonempty(df: DataFrame, strict: bool = False):
    """Split into (ok, rejects); ``strict`` fails the job on a reject."""
    if "valid" not in df.columns:
        df = df.withColumn("valid", (F.length(F.coalesce("instruction", F.lit(""))) +
                                     F.length(F.coalesce("input", F.lit("")))) > 0)
    if strict:
        df = df.withColumn("valid", F.when(F.col("valid"), F.lit(True))
                           .otherwise(F.raise_error(F.lit("instruction and input are both empty"))))
    return df.filter(F.col("valid")), df.filter(~F.col("valid"))


def union_kinds(*dfs: DataFrame) -> DataFrame:
    """UNION ALL of differently shaped example sets."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


# ----------------------------------------------------------------- prefixes
def prefix_stage1(input_col="input", prompt_col="prompt") -> Column:
    """C4: ``input + "\\n" + prompt`` (no strip, no final newline)."""
    return F.concat(F.col(input_col), F.lit("\n"), F.col(prompt_col))


def prefix_stage2(input_col="input", prompt_col="prompt", pos_col="prompt_pos") -> Column:
    """Pre: ``p\\n`` + rstrip(input) + ``\\n\\n``; post: rstrip(input) +
    ``\\n`` + p + ``\\n``; no prompt: input + one space (not stripped)."""
    inp, p, pos = F.col(input_col), F.col(prompt_col), F.col(pos_col)
    return (F.when(pos == "pre", F.concat(p, F.lit("\n"), py_rstrip(inp), F.lit("\n\n")))
            .when(pos == "post", F.concat(py_rstrip(inp), F.lit("\n"), p, F.lit("\n")))
            .otherwise(F.concat(inp, F.lit(" "))))


# The chat prefix of instruction records (note the space after
# "Assistant:").
HUMAN_TAG = "Human: "
ASSISTANT_TAG = "Assistant: "


def prefix_stage3(instruction_col="instruction", input_col="input") -> Column:
    """``Human: `` [instruction ``\\n``] [input ``\\n``] ``Assistant: ``
    (fields already stripped)."""
    ins, inp = F.col(instruction_col), F.col(input_col)
    return F.concat(F.lit(HUMAN_TAG),
                    F.when(F.length(ins) > 0, F.concat(ins, F.lit("\n"))).otherwise(F.lit("")),
                    F.when(F.length(inp) > 0, F.concat(inp, F.lit("\n"))).otherwise(F.lit("")),
                    F.lit(ASSISTANT_TAG))


def with_prefix(df: DataFrame, stage: int) -> DataFrame:
    """Attach ``prefix`` for the seq2seq kinds of a stage (NULL for 'lm')."""
    if stage == 1:
        pre = prefix_stage1()
    elif stage == 2:
        pre = prefix_stage2()
    elif stage == 3:
        pre = prefix_stage3()
    else:
        raise ValueError(f"unknown stage {stage}")
    return df.withColumn("prefix", F.when(F.col("kind") != "lm", pre))
