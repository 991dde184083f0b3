"""Conversation repair against an enumeration of all edits."""

import hashlib
import heapq
import random
import re
import time
import zlib

import pytest

from weftmix.llm import turn_repair as tr

ROLES = ["user", "assistant", "system", "tool", "", " ", "assist"]
TEXTS = ["Hi.", "Hi", " ", "", "What?", "a b\n", "end!\t", " "]
WHITE = set(" \t\n\x0b\f\r")


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = [c for c in text if c not in WHITE]
        out.append(1 if not bare else 2 if (role, text) in seen else 3 if bare[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, kinds):
    """(audit, cost, repaired rows): edits in order of cost, then of their initials."""
    heap, tick = [(0, "", 0, 0, "", ())], 1
    while heap:
        cost, audit, _, i, roles, out = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return audit, cost, out
        if not re.fullmatch("s?(ua)*u?", roles):
            continue
        steps = [("I", 2, i, x[0], ((x, ""),)) for x in ("user", "assistant")]
        if i < len(rows):
            _, role, text = rows[i]
            steps.append(("D", 3, i + 1, "", ()))
            if kinds[i] not in (1, 2):
                stay = 1 if kinds[i] == 3 else 0
                steps.append(("K", stay, i + 1, role[:1], ((role, text),)))
                steps += [("R", 2 + stay, i + 1, x[0], ((x, text),)) for x in ("user", "assistant")]
        for edit, price, j, initial, more in steps:
            heapq.heappush(heap, (cost + price, audit + edit, tick, j, roles + initial, out + more))
            tick += 1


def expected(rows):
    """One conversation's result from its damaged rows (turn, role, text)."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
    kinds = faults(rows)
    audit, cost, out = cheapest(rows, kinds)
    turns = {r[0] for r in rows} - {None}
    pairs = [x[1][:1] + y[1][:1] for x, y in zip(rows, rows[1:], strict=False)]
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, kinds.count(1), kinds.count(2), kinds.count(3),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in out).encode()).hexdigest())


def damaged(conv, turn, role, text):
    role, text = " " if role is None else role, " " if text is None else text
    how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
    if how == 0:
        return []
    text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
    return [(turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_the_least_audit(seed):
    r = random.Random(seed)
    for _ in range(120):
        n = r.randint(0, 6)
        kinds = bytes(r.choice([0, 1, 1, 2, 2, 3, 3, 4]) * 4 + r.choice([0, 0, 0, 1, 2, 3]) for _ in range(n))
        role = {0: "", 1: "system", 2: "user", 3: "assistant", 4: "tool"}
        rows = [(0, role[k >> 2], "x") for k in kinds]
        assert tr.Search(kinds).audit() == cheapest(rows, [k & 3 for k in kinds])[:2]


def test_stretches_give_the_audit_of_one_search():
    r = random.Random(9)
    kinds = bytes(r.choice([1, 2, 2, 2, 3, 3, 3, 4]) * 4 + r.choice([0] * 6 + [1, 2, 3]) for _ in range(300))
    whole = tr.Search(kinds)
    assert tr.Search(kinds).audit() == ("".join(whole.solve(0, tr.START, 300)), whole.low[tr.START][0])


def test_long_conversations_take_time_in_proportion():
    r = random.Random(2)
    kinds = bytes(r.choice([2, 3]) * 4 + r.choice([0] * 8 + [1, 3]) for _ in range(30_000))
    t = time.time()
    audit, cost = tr.Search(kinds).audit()
    assert time.time() - t < 60 and cost > 0 and len(audit) - audit.count("I") == len(kinds)


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, cost int")


def conversations(seed=5, n=60):
    r = random.Random(seed)
    rows = []
    for conv in [None, *range(n)]:
        for turn in range(r.randint(0, 6)):
            rows.append((conv, r.choice([turn, turn, turn, None, turn * 3, -turn]), r.choice([*ROLES[:3], *ROLES, None]), r.choice([*TEXTS, None])))
    return rows + rows[:5] + [(1000, t, "user", "same") for t in range(7)]


def run(spark, rows, **settings):
    import os
    import tempfile
    d = tempfile.mkdtemp(prefix="weftmix-test-")
    table(spark, rows).write.parquet(os.path.join(d, "conversations.parquet"))
    got = tr.query(spark, d)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return got.collect()


def test_query_against_enumeration(spark):
    rows = conversations()
    want = {c: expected([x for r in rows if r[0] == c for x in damaged(*r)]) for c in {r[0] for r in rows}}
    got = run(spark, rows)
    assert len(got) == len(want)
    for x in got:
        assert tuple(x)[1:] == want[x["conv_id"]], x


def test_edges(spark):
    assert run(spark, []) == []
    top = 1 << 62
    got = {x["conv_id"]: x for x in run(spark, [(1, top, "user", "a."), (1, -top, "assistant", "b."), (1, None, "user", None),
                                                (2, 0, "user", "long " * 200_000 + "."), (2, 1, "assistant", "b.")])}
    assert got[1]["gaps"] <= (1 << 63) - 1 and got[2]["cost"] >= 0
    dropped = next(t for t in range(1000) if zlib.crc32(f"3:{t}".encode()) % 20 == 0)
    x = run(spark, [(3, dropped, "user", "a.")])[0]
    assert tuple(x) == (3, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_repaired_rows_and_undamaged_tables(spark):
    rows = tr.whole(table(spark, [(1, 0, "user", "Hi."), (1, 1, "user", "Yes."), (2, 0, "assistant", "Only.")]))
    found = tr.audits(rows)
    out = [(x["conv_id"], x["place"], x["edit"], x["role"], x["text"]) for x in tr.repaired(rows, found).orderBy("conv_id", "place").collect()]
    assert out == [(1, 0, "K", "user", "Hi."), (1, 1, "R", "assistant", "Yes."), (2, 0, "I", "user", ""), (2, 1, "K", "assistant", "Only.")]
