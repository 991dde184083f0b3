"""Scalar text helpers shared by every operator (all JVM-side Column expressions)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points Python's ``str.strip()`` treats as whitespace
# (str.isspace() is True). Spark's trim() removes only U+0020 and Java's \s
# misses U+3000, so the class is spelled out. The same class works in DuckDB.
WHITESPACE_CLASS = (
    r"[\x09-\x0d\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
_STRIP_RE = rf"\A{WHITESPACE_CLASS}+|{WHITESPACE_CLASS}+\z"
_RSTRIP_RE = rf"{WHITESPACE_CLASS}+\z"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(c) -> Column:
    """Python ``str.strip()`` on a string column."""
    return F.regexp_replace(_c(c), _STRIP_RE, "")


def py_rstrip(c) -> Column:
    """Python ``str.rstrip()``."""
    return F.regexp_replace(_c(c), _RSTRIP_RE, "")


def seeded_hash(keys, salt) -> Column:
    """Repeatable non-negative 32-bit hash of ``keys`` and a salt.

    ``conv(substr(md5(concat_ws('|', keys..., salt)), 1, 8), 16, 10)`` — the same
    integer DuckDB gives with ``('0x' || substr(md5(...), 1, 8))::BIGINT``, so
    every seeded choice can be checked by an SQL oracle.
    """
    if not isinstance(keys, (list, tuple)):
        keys = [keys]
    parts = [_c(k).cast("string") for k in keys]
    salt_col = salt if isinstance(salt, Column) else F.lit(str(salt))
    digest = F.md5(F.concat_ws("|", *parts, salt_col.cast("string")))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")


def choose_index(keys, salt, n) -> Column:
    """Uniform 0-based choice among ``n`` options (NULL when n <= 0)."""
    n_col = n if isinstance(n, Column) else F.lit(int(n))
    return F.when(n_col > 0, seeded_hash(keys, salt) % n_col.cast("bigint")).cast("int")


def choose_one(keys, salt, options) -> Column:
    """Pick one element of an array column (or a Python list of literals)."""
    arr = F.array(*[F.lit(o) for o in options]) if isinstance(options, (list, tuple)) else _c(options)
    idx = choose_index(keys, salt, F.size(arr))
    return F.try_element_at(arr, idx + 1)


def loss_split_point(n, keys, salt="split") -> Column:
    """Position uniform in [int(0.2 n) + 1, int(0.7 n)], both ends included.

    Doubles on purpose: ``int(0.7 * n)`` differs from ``7 * n div 10`` for
    some n. For n < 2 the range is empty in the reference (it raises); we
    return ``lo`` so the row keeps no supervised token except the last.
    """
    n_col = _c(n)
    lo = F.floor(F.lit(0.2).cast("double") * n_col).cast("bigint") + 1
    hi = F.floor(F.lit(0.7).cast("double") * n_col).cast("bigint")
    width = F.greatest(hi - lo + 1, F.lit(1).cast("bigint"))
    return (lo + seeded_hash(keys, salt) % width).cast("int")
