"""DuckDB SQL fragments for the oracle queries (the same semantics as the
Spark Column functions, written independently in SQL)."""

from __future__ import annotations

from weftmix.functions.text import WHITESPACE_CLASS

W = WHITESPACE_CLASS


def h(keys, salt: str) -> str:
    """Seeded hash: same integer as ``functions.text.seeded_hash``."""
    ks = ", ".join(f"CAST({k} AS VARCHAR)" for k in keys)
    return f"(('0x' || substr(md5(concat_ws('|', {ks}, '{salt}')), 1, 8))::BIGINT)"


def cps(t: str) -> str:
    """Code-point ids (+3); empty text -> empty list."""
    return (f"(CASE WHEN length({t}) = 0 THEN []::INTEGER[] ELSE "
            f"list_transform(string_split({t}, ''), lambda c: (unicode(c) + 3)::INTEGER) END)")


def strip(t: str) -> str:
    return f"regexp_replace({t}, '\\A{W}+|{W}+\\z', '', 'g')"


def rstrip(t: str) -> str:
    return f"regexp_replace({t}, '{W}+\\z', '', 'g')"


def ids_md5(l: str) -> str:
    return f"md5(array_to_string({l}, ','))"


def pad(l: str, n: str) -> str:
    return f"list_concat({l}, list_transform(range(greatest({n} - len({l}), 0)), lambda x: 0::INTEGER))"


def values_pools(pools: dict) -> str:
    rows = []
    for k, v in pools.items():
        items = ", ".join(sql_str(x) for x in v)
        rows.append(f"({sql_str(k)}, [{items}])")
    return "(VALUES " + ", ".join(rows) + ") AS p(pool_key, prompts)"


def sql_str(s: str) -> str:
    """A DuckDB string literal (escape quotes; control characters via chr())."""
    parts = []
    buf = ""
    for ch in s:
        if ch == "'":
            buf += "''"
        elif ord(ch) < 32 or ord(ch) > 126:
            if buf:
                parts.append(f"'{buf}'")
                buf = ""
            parts.append(f"chr({ord(ch)})")
        else:
            buf += ch
    if buf or not parts:
        parts.append(f"'{buf}'")
    return "(" + " || ".join(parts) + ")"


def lm_split(n: str, keys, salt: str = "split") -> str:
    lo = f"(floor(0.2::DOUBLE * {n})::BIGINT + 1)"
    hi = f"(floor(0.7::DOUBLE * {n})::BIGINT)"
    return f"({lo} + {h(keys, salt)} % greatest({hi} - {lo} + 1, 1))"


def mask_upto(n: str, cut: str) -> str:
    """[0]*cut + [1]*(n-cut) as a list of n elements."""
    return f"list_transform(range({n}), lambda x: CASE WHEN x < {cut} THEN 0 ELSE 1 END::INTEGER)"
