"""Conversation tables (F4, H11, H13): long ``(conv_id, turn, role, text)``
rows to one packed row per conversation.

Per-message work (role mapping, cleaning) runs row-parallel before the
group; the group itself is one conversation, and its rendered prompt is a
single value, so one conversation per task is inherent to the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftmix.functions.chat import TEMPLATES, append_turn


def chat_template(model_name: str) -> dict:
    """Case-insensitive template lookup; an unknown name is an error."""
    key = model_name.lower()
    if key not in TEMPLATES:
        raise NotImplementedError(f"unknown chat template: {model_name!r}")
    return dict(TEMPLATES[key])


def system_text(role) -> Column:
    """Aggregate: all system texts of a conversation, in turn order."""
    said = F.array_sort(F.collect_list(F.when((role == "system") & F.col("text").isNotNull(), F.struct("turn", "text"))))
    return F.when(F.size(said) > 0, F.array_join(F.transform(said, lambda x: x["text"]), "\n"))


def order_turns(conversations: DataFrame, roles=("Human", "Assistant")) -> DataFrame:
    """one row per conversation — ``system`` (the texts of its 'system'
    turns in turn order, joined by line ends; NULL without any) and
    ``messages`` = the other turns in turn order, with role names mapped to
    the template's (user -> roles[0], assistant -> roles[1])."""
    role = (F.when(F.col("role") == "user", F.lit(roles[0]))
            .when(F.col("role") == "assistant", F.lit(roles[1])).otherwise(F.col("role")))
    c = conversations.select("conv_id", "turn", F.col("role").alias("_raw"), role.alias("role"), "text")
    msg = F.when(F.col("_raw") != "system", F.struct("turn", "role", "text"))
    return (c.groupBy("conv_id")
            .agg(system_text(F.col("_raw")).alias("system"),
                 F.array_sort(F.collect_list(msg)).alias("messages")))


def question_conversations(questions: DataFrame, roles=("Human", "Assistant")) -> DataFrame:
    """J2 input: each question as a two-message conversation — the question
    from roles[0] and an empty slot (NULL) for roles[1] (H11)."""
    empty = F.array().cast("array<struct<turn:int,role:string,text:string>>")
    msgs = append_turn(append_turn(empty, roles[0], F.col("text")), roles[1], F.lit(None).cast("string"))
    return questions.withColumn("messages", msgs)


# ------------------------------------------------ row-parallel table forms
def _messages_indexed(conversations: DataFrame, roles=("Human", "Assistant")) -> DataFrame:
    """Non-system messages with their 0-based index ``i`` in turn order per
    conversation — a balanced dense index, so a huge conversation is never
    gathered into one task."""
    from weftmix.operators.indexing import dense_index
    msgs = conversations.filter(F.col("role") != "system").select("conv_id", "turn", "role", "text")
    return dense_index(msgs, ["conv_id"], ["turn"], out_col="i")


def _after(messages: DataFrame, offset: int) -> DataFrame:
    """The messages from index ``offset`` on (few-shot turns come before)."""
    return messages.filter(F.col("i") >= offset).withColumn("i", F.col("i") - offset) if offset else messages


def chat_pairs_table(conversations: DataFrame, offset: int = 0) -> DataFrame:
    """H9 as rows ``conv_id, pair_idx, user, reply``: from message ``offset``
    on, each even-index message opens a pair, the next message (index + 1)
    fills its reply (NULL when there is none). An equi-join on
    ``(conv_id, i)``, no per-conversation collect."""
    m = _after(_messages_indexed(conversations), offset)
    opens = m.filter(F.col("i") % 2 == 0).select("conv_id", (F.col("i") + 1).alias("_j"),
                                                 (F.col("i") / 2).cast("bigint").alias("pair_idx"),
                                                 F.col("text").alias("user"))
    replies = m.filter(F.col("i") % 2 == 1).select("conv_id", F.col("i").alias("_j"), F.col("text").alias("reply"))
    return opens.join(replies, ["conv_id", "_j"], "left").drop("_j")


def api_messages_table(conversations: DataFrame, offset: int = 0) -> DataFrame:
    """H10 as rows ``conv_id, msg_idx, role, content``: the system message
    first (empty when the conversation has none), then, from message
    ``offset`` on, user/assistant by index parity; only NULL assistant texts are dropped, and positions
    close up behind them (a dense index over the kept rows)."""
    from weftmix.operators.indexing import dense_index
    m = _after(_messages_indexed(conversations), offset)
    tagged = m.select("conv_id", "turn", F.when(F.col("i") % 2 == 0, F.lit("user")).otherwise(F.lit("assistant"))
                      .alias("role"), F.col("text").alias("content"))
    kept = tagged.filter(~((F.col("role") == "assistant") & F.col("content").isNull()))
    kept = dense_index(kept, ["conv_id"], ["turn"], out_col="_k")
    body = kept.select("conv_id", (F.col("_k") + 1).alias("msg_idx"), "role", "content")
    system = (conversations.groupBy("conv_id")
              .agg(F.coalesce(system_text(F.col("role")), F.lit("")).alias("content"))
              .select("conv_id", F.lit(0).cast("bigint").alias("msg_idx"), F.lit("system").alias("role"), "content"))
    return system.unionByName(body)
