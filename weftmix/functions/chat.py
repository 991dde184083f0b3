"""Conversation rendering (H8-H13) as Column expressions over a packed
message array ``ARRAY<STRUCT<turn, role, text>>``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The six separator styles.
STYLES = ["ADD_COLON_SINGLE", "ADD_COLON_TWO", "NO_COLON_SINGLE", "BAIZE", "DOLLY", "RWKV"]

# Our chat template (H13): empty system, Human/Assistant roles, newline sep.
TEMPLATES = {
    "human-assistant": {"system": "", "roles": ("Human", "Assistant"), "style": "ADD_COLON_SINGLE",
                        "sep": "\n", "sep2": None, "offset": 0},
}


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _present(text: Column) -> Column:
    """A message counts only when it is neither NULL nor empty."""
    return text.isNotNull() & (F.length(text) > 0)


def render_prompt(system, messages, style: str, sep: str = "\n", sep2: str | None = None) -> Column:
    """H8: the prompt text of a conversation in one of the six styles.

    ``messages`` is ``ARRAY<STRUCT<role STRING, text STRING, ...>>`` in
    order; role names are already the template's names. Alternating
    separators follow the message index parity, not the role.
    """
    sys_c = F.coalesce(_c(system), F.lit(""))
    msgs = _c(messages)
    s1 = F.lit(sep)
    s2 = F.lit(sep2 if sep2 is not None else "")
    sep_i = lambda i: F.when(i % 2 == 0, s1).otherwise(s2)

    def join(fn):
        return F.array_join(F.transform(msgs, fn), "")

    if style == "ADD_COLON_SINGLE":
        body = join(lambda m: F.when(_present(m["text"]), F.concat(m["role"], F.lit(": "), m["text"], s1))
                    .otherwise(F.concat(m["role"], F.lit(": "))))
        return F.concat(sys_c, s1, body)
    if style == "ADD_COLON_TWO":
        body = join(lambda m, i: F.when(_present(m["text"]), F.concat(m["role"], F.lit(": "), m["text"], sep_i(i)))
                    .otherwise(F.concat(m["role"], F.lit(": "))))
        return F.concat(sys_c, s1, body)
    if style == "NO_COLON_SINGLE":
        body = join(lambda m: F.when(_present(m["text"]), F.concat(m["role"], m["text"], s1)).otherwise(m["role"]))
        return F.concat(sys_c, body)
    if style == "BAIZE":
        body = join(lambda m: F.when(_present(m["text"]), F.concat(m["role"], m["text"], F.lit("\n")))
                    .otherwise(m["role"]))
        return F.concat(sys_c, F.lit("\n"), body)
    if style == "DOLLY":
        body = join(lambda m, i: F.when(_present(m["text"]),
                                        F.concat(m["role"], F.lit(":\n"), m["text"], sep_i(i),
                                                 F.when(i % 2 == 1, F.lit("\n\n")).otherwise(F.lit(""))))
                    .otherwise(F.concat(m["role"], F.lit(":\n"))))
        return F.concat(sys_c, body)
    if style == "RWKV":
        clean = lambda t: F.replace(F.replace(t, F.lit("\r\n"), F.lit("\n")), F.lit("\n\n"), F.lit("\n"))
        body = join(lambda m: F.when(_present(m["text"]),
                                     F.concat(m["role"], F.lit(": "), clean(m["text"]), F.lit("\n\n")))
                    .otherwise(F.concat(m["role"], F.lit(":"))))
        return F.concat(sys_c, body)
    raise ValueError(f"unknown separator style {style!r}; known: {STYLES}")


def to_chat_pairs(messages, offset: int = 0) -> Column:
    """H9: ``ARRAY<STRUCT<user, reply>>`` — an even index opens a pair, the
    next odd index fills its reply (NULL when missing)."""
    m = F.slice(_c(messages), int(offset) + 1, 1 << 30) if offset else _c(messages)
    n_pairs = F.floor((F.size(m) + 1) / 2).cast("int")
    idx = F.sequence(F.lit(0), n_pairs - 1)
    return F.when(n_pairs > 0, F.transform(idx, lambda k: F.struct(
        F.element_at(m, k * 2 + 1)["text"].alias("user"),
        F.try_element_at(m, k * 2 + 2)["text"].alias("reply")))).otherwise(
        F.array().cast("array<struct<user:string,reply:string>>"))


def to_api_messages(system, messages, offset: int = 0) -> Column:
    """System first, then user/assistant by index parity; only NULL
    assistant texts are dropped (empty ones are kept)."""
    m = F.slice(_c(messages), int(offset) + 1, 1 << 30) if offset else _c(messages)
    tagged = F.transform(m, lambda x, i: F.struct(
        F.when(i % 2 == 0, F.lit("user")).otherwise(F.lit("assistant")).alias("role"),
        x["text"].alias("content")))
    kept = F.filter(tagged, lambda x: ~((x["role"] == "assistant") & x["content"].isNull()))
    head = F.array(F.struct(F.lit("system").alias("role"), F.coalesce(_c(system), F.lit("")).alias("content")))
    return F.concat(head, kept)


def append_turn(messages, role, text) -> Column:
    """Add a message; NULL text marks the slot to be generated."""
    m = _c(messages)
    r = role if isinstance(role, Column) else F.lit(role)
    t = text if isinstance(text, Column) else F.lit(text).cast("string")
    return F.array_append(m, F.struct(F.size(m).alias("turn"), r.alias("role"), t.alias("text")))


def conversation_record(system, roles, messages, offset, conv_id, model_name) -> Column:
    """The exported six fields as one JSON string."""
    msgs = F.transform(_c(messages), lambda m: F.array(m["role"], m["text"]))
    return F.to_json(F.struct(F.coalesce(_c(system), F.lit("")).alias("system"), _c(roles).alias("roles"),
                              msgs.alias("messages"), _c(offset).alias("offset"), _c(conv_id).alias("conv_id"),
                              _c(model_name).alias("model_name")))
