"""Token-array functions (H1-H6) as Column expressions.

The built-in tokenizer maps every Unicode code point ``c`` to ``ord(c) + 3``
so that ids 0, 1, 2 stay free for pad, bos and eos. It stays in the JVM
(``split`` + ``transform``, an interpreted lambda per character, not generated
code); a sub-word tokenizer is
plugged in through :mod:`weftmix.operators.external` instead.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Special token ids (pad, bos, eos) and the code-point offset.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
CODEPOINT_OFFSET = 3


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def codepoints(text) -> Column:
    """ARRAY<INT> of code points + 3; empty text gives an empty array."""
    t = _c(text)
    chars = F.split(t, "", -1)
    ids = F.transform(chars, lambda ch: (F.ascii(ch) + CODEPOINT_OFFSET).cast("int"))
    return F.when(t.isNull(), F.lit(None)).when(F.length(t) == 0, F.array().cast("array<int>")).otherwise(ids)


class CodePointTokenizer:
    """Concatenative tokenizer: encode(a + b) == encode(a) + encode(b)."""

    concatenative = True

    def ids(self, text) -> Column:
        return codepoints(text)


def encode(text, bos: bool = True, eos: bool = True, tokenizer=None) -> Column:
    """H1: token ids, optionally with bos prepended and eos appended."""
    tok = tokenizer or CodePointTokenizer()
    body = tok.ids(text)
    parts = []
    if bos:
        parts.append(F.array(F.lit(BOS_ID)))
    parts.append(body)
    if eos:
        parts.append(F.array(F.lit(EOS_ID)))
    return F.concat(*parts) if len(parts) > 1 else body


def decode(ids) -> Column:
    """H2: code-point ids back to text; special ids (<= 2) are skipped."""
    a = F.filter(_c(ids), lambda x: x > EOS_ID)
    hexed = F.array_join(F.transform(a, lambda i: F.lpad(F.hex(i - CODEPOINT_OFFSET), 8, "0")), "")
    return F.decode(F.unhex(hexed), "UTF-32")


def truncate(arr, max_len: int) -> Column:
    """H3: keep the first ``max_len`` elements."""
    return F.slice(_c(arr), 1, int(max_len))


def seq2seq_mask(n_prefix, n_output) -> Column:
    """H4: 0 for the prefix tokens, 1 for the output tokens (eos included)."""
    return F.concat(F.array_repeat(F.lit(0), _c(n_prefix).cast("int")),
                    F.array_repeat(F.lit(1), _c(n_output).cast("int")))


def lm_mask(n, pos) -> Column:
    """H5: 0 before the split point, 1 from it on."""
    n_c = _c(n).cast("int")
    p = F.least(_c(pos).cast("int"), n_c)
    return F.concat(F.array_repeat(F.lit(0), p), F.array_repeat(F.lit(1), n_c - p))


def pad(arr, pad_len, value: int = PAD_ID) -> Column:
    """H6: right-pad with literal 0 up to ``pad_len``."""
    a = _c(arr)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(_c(pad_len).cast("int") - F.size(a), F.lit(0))))
