"""Conversation and generation queries over the driver tables, with their
DuckDB oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftmix.functions.chat import STYLES, conversation_record, render_prompt
from weftmix.operators.chat import api_messages_table, chat_pairs_table, chat_template, order_turns
from weftmix.plans import inputs

SEP, SEP2 = "\n", "</s>"


def packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_turns(inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


def order_turns_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = packed(spark, sf_dir)
    return p.select(F.col("conv_id").cast("bigint").alias("conv_id"),
                    F.size("messages").cast("bigint").alias("n_messages"),
                    F.array_join(F.transform("messages", lambda m: m["role"]), ",").alias("roles"),
                    F.md5(F.coalesce(F.col("system"), F.lit(""))).alias("system_md5"),
                    F.md5(F.array_join(F.transform("messages", lambda m: m["text"]), "\u001f")).alias("texts_md5"))


def render_prompts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H8: every conversation rendered in all six styles (one row each)."""
    p = packed(spark, sf_dir)
    styled = F.array(*[F.struct(F.lit(s).alias("style"),
                                render_prompt(F.col("system"), F.col("messages"), s, SEP, SEP2).alias("prompt"))
                       for s in STYLES])
    x = p.select("conv_id", F.explode(styled).alias("r"))
    return x.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("r.style").alias("style"),
                    F.length("r.prompt").cast("bigint").alias("prompt_len"), F.md5("r.prompt").alias("prompt_md5"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def chat_pairs_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9: (user, reply) pairs of every conversation, row-parallel."""
    x = chat_pairs_table(conversations(spark, sf_dir))
    return x.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("pair_idx").cast("bigint").alias("pair_idx"),
                    F.md5("user").alias("user_md5"), F.md5("reply").alias("reply_md5"))


def api_messages_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """API message list of every conversation (system first), row-parallel."""
    x = api_messages_table(conversations(spark, sf_dir))
    return x.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("msg_idx").cast("bigint").alias("msg_idx"),
                    "role", F.md5("content").alias("content_md5"))


def chat_pairs_offset_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H9 with few-shot turns skipped: pairs from the third message on."""
    x = chat_pairs_table(conversations(spark, sf_dir), offset=2)
    return x.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("pair_idx").cast("bigint").alias("pair_idx"),
                    F.md5("user").alias("user_md5"), F.md5("reply").alias("reply_md5"))


def api_messages_offset_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H10 with an odd offset, so that parity starts anew at the second message."""
    x = api_messages_table(conversations(spark, sf_dir), offset=1)
    return x.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("msg_idx").cast("bigint").alias("msg_idx"),
                    "role", F.md5("content").alias("content_md5"))


def conversation_records_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation as its exported record."""
    p = packed(spark, sf_dir)
    rec = conversation_record(F.col("system"), F.array(F.lit("Human"), F.lit("Assistant")), F.col("messages"), F.lit(0),
                              F.col("conv_id").cast("string"), F.lit("model-x"))
    return p.select(F.col("conv_id").cast("bigint").alias("conv_id"), rec.alias("record"))


def answer_prompts_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H11 + H13 + H8: each question as a template conversation with an
    empty assistant slot, rendered (``\\nHuman: <q>\\nAssistant: ``)."""
    from weftmix.operators.chat import question_conversations
    tpl = chat_template("Human-Assistant")
    q = inputs.questions(spark, sf_dir)
    conv = question_conversations(q, tpl["roles"])
    pr = render_prompt(F.lit(tpl["system"]), F.col("messages"), tpl["style"], tpl["sep"], tpl["sep2"])
    return conv.select(F.col("question_id").cast("bigint").alias("question_id"),
                       F.length(pr).cast("bigint").alias("prompt_len"), F.md5(pr).alias("prompt_md5"))


# ---------------------------------------------------------------------- SQL
PACKED_SQL = """packed AS (
  SELECT conv_id, string_agg(CASE WHEN role = 'system' THEN text END, chr(10) ORDER BY turn) AS system,
         coalesce(list(struct_pack(turn := turn,
                                   role := CASE role WHEN 'user' THEN 'Human' WHEN 'assistant' THEN 'Assistant'
                                                     ELSE role END,
                                   text := text) ORDER BY turn) FILTER (WHERE role <> 'system'), []) AS messages
  FROM conversations GROUP BY conv_id)"""


def _present(t: str) -> str:
    return f"({t} IS NOT NULL AND length({t}) > 0)"


def render_sql(style: str, system: str = "system", msgs: str = "messages", sep: str = "chr(10)",
               sep2: str = "'</s>'") -> str:
    sysc = f"coalesce({system}, '')"
    sep_i = f"(CASE WHEN (i - 1) % 2 = 0 THEN {sep} ELSE {sep2} END)"
    j = lambda body, idx=False: (f"array_to_string(list_transform({msgs}, lambda m{', i' if idx else ''}: {body}), '')")
    p = _present("m.text")
    if style == "ADD_COLON_SINGLE":
        return f"{sysc} || {sep} || " + j(f"CASE WHEN {p} THEN m.role || ': ' || m.text || {sep} ELSE m.role || ': ' END")
    if style == "ADD_COLON_TWO":
        return f"{sysc} || {sep} || " + j(f"CASE WHEN {p} THEN m.role || ': ' || m.text || {sep_i} ELSE m.role || ': ' END", True)
    if style == "NO_COLON_SINGLE":
        return f"{sysc} || " + j(f"CASE WHEN {p} THEN m.role || m.text || {sep} ELSE m.role END")
    if style == "BAIZE":
        return f"{sysc} || chr(10) || " + j(f"CASE WHEN {p} THEN m.role || m.text || chr(10) ELSE m.role END")
    if style == "DOLLY":
        return f"{sysc} || " + j(f"CASE WHEN {p} THEN m.role || ':' || chr(10) || m.text || {sep_i} || "
                                 f"CASE WHEN (i - 1) % 2 = 1 THEN chr(10) || chr(10) ELSE '' END "
                                 f"ELSE m.role || ':' || chr(10) END", True)
    if style == "RWKV":
        clean = "replace(replace(m.text, chr(13) || chr(10), chr(10)), chr(10) || chr(10), chr(10))"
        return f"{sysc} || " + j(f"CASE WHEN {p} THEN m.role || ': ' || {clean} || chr(10) || chr(10) ELSE m.role || ':' END")
    raise ValueError(style)


def order_turns_sql() -> str:
    return f"""WITH {PACKED_SQL}
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(len(messages) AS BIGINT) AS n_messages,
       array_to_string(list_transform(messages, lambda m: m.role), ',') AS roles,
       md5(coalesce(system, '')) AS system_md5,
       md5(array_to_string(list_transform(messages, lambda m: m.text), chr(31))) AS texts_md5
FROM packed"""


def render_prompts_sql() -> str:
    parts = " UNION ALL ".join(
        f"SELECT conv_id, '{s}' AS style, {render_sql(s)} AS prompt FROM packed" for s in STYLES)
    return f"""WITH {PACKED_SQL}
SELECT CAST(conv_id AS BIGINT) AS conv_id, style, CAST(length(prompt) AS BIGINT) AS prompt_len, md5(prompt) AS prompt_md5
FROM ({parts})"""


def _skip(offset: int) -> str:
    return f"""WITH {PACKED_SQL.replace('packed AS', 'whole AS', 1)},
packed AS (SELECT conv_id, system, messages[{offset + 1}:] AS messages FROM whole)"""


def conversation_records_sql() -> str:
    return f"""WITH {PACKED_SQL}
SELECT CAST(conv_id AS BIGINT) AS conv_id, to_json(struct_pack(system := coalesce(system, ''), roles := ['Human', 'Assistant'],
       messages := list_transform(messages, lambda m: [m.role, m.text]), "offset" := 0, conv_id := CAST(conv_id AS VARCHAR),
       model_name := 'model-x'))::VARCHAR AS record
FROM packed"""


def chat_pairs_sql(offset: int = 0) -> str:
    return f"""{_skip(offset)},
pairs AS (SELECT conv_id, messages, unnest(range(CAST(floor((len(messages) + 1) / 2) AS BIGINT))) AS k FROM packed)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(k AS BIGINT) AS pair_idx,
       md5(messages[2 * k + 1].text) AS user_md5,
       CASE WHEN 2 * k + 2 <= len(messages) THEN md5(messages[2 * k + 2].text) END AS reply_md5
FROM pairs"""


def api_messages_sql(offset: int = 0) -> str:
    return f"""{_skip(offset)},
api AS (
  SELECT conv_id, list_concat([{{'role': 'system', 'content': coalesce(system, '')}}],
           list_filter(list_transform(messages, lambda m, i: {{'role': CASE WHEN (i - 1) % 2 = 0 THEN 'user'
                                                                            ELSE 'assistant' END,
                                                                 'content': m.text}}),
                       lambda x: NOT (x.role = 'assistant' AND x.content IS NULL))) AS l
  FROM packed)
SELECT CAST(conv_id AS BIGINT) AS conv_id, CAST(idx - 1 AS BIGINT) AS msg_idx, m.role AS role,
       md5(m.content) AS content_md5
FROM (SELECT conv_id, unnest(l) AS m, generate_subscripts(l, 1) AS idx FROM api)"""


def answer_prompts_sql() -> str:
    from weftmix.plans.oracle_eval import QUESTIONS
    pr = ("chr(10) || CASE WHEN length(text) > 0 THEN 'Human: ' || text || chr(10) ELSE 'Human: ' END || "
          "'Assistant: '")
    return f"""WITH {QUESTIONS}
SELECT CAST(question_id AS BIGINT) AS question_id, CAST(length({pr}) AS BIGINT) AS prompt_len, md5({pr}) AS prompt_md5
FROM questions"""
