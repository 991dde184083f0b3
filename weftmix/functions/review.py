"""Review-side scalar functions (H14-H16, H18) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from weftmix.functions.text import py_strip

# A template is cut into escaped braces, field tokens ``{name}``, literal runs
# and stray braces.
TEMPLATE_TOKEN_RE = r"(\{\{|\}\}|\{[^{}]*\}|[^{}]+|[{}])"
# Judge scores: a plain decimal number (guards try_cast, which would also
# accept forms such as ``7d`` in Spark).
NUM_RE = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
_NUM_FULL = rf"^{NUM_RE}$"
_MATH_PAIR_RE = rf"^\s*[(\[]?\s*({NUM_RE})\s*,\s*({NUM_RE})\s*,?\s*[)\]]?\s*$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def fill_template(template, values: dict, defaults=None) -> Column:
    """Substitute ``{name}`` fields in one pass.

    ``values`` maps field name -> Column; ``defaults`` is a MAP<STRING,STRING>
    column consulted for other names. Inserted text is never re-scanned, so
    an answer holding ``{answer_2}`` stays literal. ``{{`` and ``}}`` give a
    brace. An unknown field or a brace on its own makes the whole result NULL:
    :func:`weftmix.operators.review.request_rejects` lists such requests.
    """
    tokens = F.regexp_extract_all(_c(template), F.lit(TEMPLATE_TOKEN_RE), 1)

    def value_of(tok):
        name = F.substring(tok, 2, F.length(tok) - 2)
        v = F.lit(None).cast("string")
        for k, col in values.items():
            v = F.when(name == F.lit(k), _c(col)).otherwise(v)
        if defaults is not None:
            v = F.coalesce(v, F.try_element_at(_c(defaults), name))
        return v

    is_field = lambda tok: tok.rlike(r"^\{[^{}]*\}$")
    parts = F.transform(tokens, lambda tok: F.when(is_field(tok), value_of(tok)).when(tok == "{{", F.lit("{"))
                        .when(tok == "}}", F.lit("}")).when(~tok.isin("{", "}"), tok))
    unknown = F.exists(parts, lambda x: x.isNull())
    return F.when(unknown, F.lit(None).cast("string")).otherwise(F.array_join(parts, ""))


def parse_score_pair(text, category) -> Column:
    """The two judge scores as ARRAY<DOUBLE>, or [-1, -1] when invalid.

    Non-math: strip the text, take the first line, commas become spaces,
    split on single spaces, exactly two numbers (``9, 7`` is invalid: three
    pieces). Math: strip, last line, the part after the last colon must be a
    2-tuple of numbers (a strict pattern replaces Python ``eval``).
    """
    t = py_strip(F.coalesce(_c(text), F.lit("")))
    first = F.element_at(F.split(t, "\n", -1), 1)
    pieces = F.split(F.translate(first, ",", " "), " ", -1)
    p1 = py_strip(F.element_at(pieces, 1))
    p2 = py_strip(F.try_element_at(pieces, F.lit(2)))
    plain_ok = (F.size(pieces) == 2) & p1.rlike(_NUM_FULL) & p2.rlike(_NUM_FULL)
    plain = F.array(p1.cast("double"), p2.cast("double"))

    last = F.element_at(F.split(t, "\n", -1), -1)
    tail = F.element_at(F.split(last, ":", -1), -1)
    m1 = F.regexp_extract(tail, _MATH_PAIR_RE, 1)
    m2 = F.regexp_extract(tail, _MATH_PAIR_RE, 4)
    math_ok = tail.rlike(_MATH_PAIR_RE)
    math = F.array(m1.cast("double"), m2.cast("double"))

    bad = F.array(F.lit(-1.0), F.lit(-1.0))
    is_math = F.coalesce(_c(category) == "math", F.lit(False))
    return (F.when(is_math & math_ok, math)
            .when(~is_math & plain_ok, plain)
            .otherwise(bad))


def new_id(*keys) -> Column:
    """A repeatable 22-character id (the reference draws a random short
    uuid; a hash of the row's keys survives task retries)."""
    return F.substring(F.sha2(F.concat_ws(":", *[_c(k).cast("string") for k in keys]), 256), 1, 22)


# Judge token budgets — first pass, first pass for math, retry.
FIRST_PASS_TOKENS = 32
MATH_TOKENS = 2048
RETRY_TOKENS = 2048


def max_output_tokens(category, retry=False) -> Column:
    """The judge's token budget by category and pass."""
    if retry:
        return F.lit(RETRY_TOKENS)
    return (F.when(F.coalesce(_c(category) == "math", F.lit(False)), F.lit(MATH_TOKENS))
            .otherwise(F.lit(FIRST_PASS_TOKENS)))
