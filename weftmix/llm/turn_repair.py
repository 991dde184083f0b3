"""Conversation structure repair by iterative-deepening A*.

A conversation is a sequence of rows (turn, role, text), taken by turn (nulls
first), then role, then the MD5 of the text. Each row has at most one fault:
blank (no character other than ASCII white space), duplicate (role and text
stood earlier) or truncated (its last such character is no stop). Edits turn
the rows into a sequence whose role initials read ``(s?(ua)+)?``: Delete (3),
Insert an empty-text row (2), Keep (0), Rerole (2); blank and duplicate rows
must be deleted and every truncated row that stays adds 1.

The search goes depth first and tries edits in ASCII order of their initials
(D, I, K, R), within a cost bound that rises until a path is accepted; that
path is the cheapest and, of the cheapest, the ASCII-least. A state is (row,
last initial). The table of failed states keeps for each the cost that was
proven too little, so a state is not tried again below it; it starts from a
bound that never exceeds the true cost: 3 for each row that must go, 1 for each
truncated row, and 1 for each pair of neighbours that may not stand together,
since every edit costs at least 1 for each such pair that it mends. Long
conversations are solved in stretches of ``STRETCH`` rows from the last to the
first: a search ends where the stretch behind it begins, whose costs are known
by then, so the work grows with the rows. A task holds 32 bytes a row of one
conversation, never its texts: those stream past the finished audit.

Defined results: null role or text is one space, a null conv_id or turn is one
space in the damage key; null conv_ids are one conversation; an empty role has
no initial and may be kept anywhere; any role whose initial isn't s, u or a must
be reroled or deleted; rows equal in all columns are each a row; gaps are capped
at the largest long; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from array import array

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftmix.llm.common import cut, regroup, table

DAMAGE_MOD = 20
DELETE, INSERT, REROLE, CUT_SHORT = 3, 2, 2, 1
STRETCH = 16
WHITE = " \t\n\x0b\f\r"
FINE, BLANK, DUPLICATE, TRUNCATED = range(4)
#: What an output ends in: nothing yet, or a row of the system, user, assistant.
START, SYS, USER, ASST = range(4)
#: Classes of a row's role initial beside SYS, USER and ASST.
EMPTY, OTHER = 0, 4
#: State after keeping a row of a class; absent: it can't be kept there.
FOLLOW = {(START, SYS): SYS, (START, USER): USER, (SYS, USER): USER, (USER, ASST): ASST, (ASST, USER): USER}
#: The one state that a row may be inserted or reroled into.
NEXT = (USER, USER, ASST, USER)
ROLE = {USER: "user", ASST: "assistant"}
#: Cost to complete an output behind the last row.
AT_END = (0, 2 * INSERT, INSERT, 0)


class Search:
    """The cheapest audit of one conversation: ``kinds`` holds for each row
    its initial's class * 4 + its fault."""

    def __init__(self, kinds: bytes):
        self.kinds, n = kinds, len(kinds)
        self.low = [array("q", [0]) * (n + 1) for _ in range(4)]
        fixed, pairs, after = 0, 0, None
        for i in range(n, -1, -1):
            if i < n:
                klass, fault = divmod(kinds[i], 4)
                if fault in (BLANK, DUPLICATE):
                    fixed += DELETE
                else:
                    fixed += CUT_SHORT if fault == TRUNCATED else 0
                    if klass != EMPTY:
                        pairs += self._clash(klass, after)
                        after = klass
            for state in range(4):
                self.low[state][i] = AT_END[state] if i == n else fixed + pairs + self._clash(state, after)

    @staticmethod
    def _clash(left: int, right: int | None) -> int:
        """1 where an output may not hold ``left`` and then ``right`` (None: its end)."""
        return int(left not in (START, ASST) if right is None else (left, right) not in FOLLOW)

    def moves(self, i: int, state: int):
        """(edit, cost, next row, next state) in ASCII order."""
        here = i < len(self.kinds)
        klass, fault = divmod(self.kinds[i], 4) if here else (EMPTY, FINE)
        if here:
            yield "D", DELETE, i + 1, state
        yield "I", INSERT, i, NEXT[state]
        if here and fault not in (BLANK, DUPLICATE):
            stay = CUT_SHORT if fault == TRUNCATED else 0
            then = state if klass == EMPTY else FOLLOW.get((state, klass))
            if then is not None:
                yield "K", stay, i + 1, then
            yield "R", REROLE + stay, i + 1, NEXT[state]

    def dive(self, i: int, state: int, stop: int) -> list[str] | None:
        """One depth-first search from a state within its present bound, to
        row ``stop`` (or to an accepted end); None raises the bound."""
        low, n, path = self.low, len(self.kinds), []

        def done(i, state):
            return state in (START, ASST) if i == n == stop else i >= stop
        if done(i, state):
            return path
        stack = [(i, state, low[state][i], self.moves(i, state))]
        while stack:
            i, state, left, edits = stack[-1]
            for edit, cost, j, then in edits:
                if cost + low[then][j] <= left:
                    path.append(edit)
                    if done(j, then):
                        return path
                    stack.append((j, then, left - cost, self.moves(j, then)))
                    break
            else:  # failed: it costs at least what its cheapest edit is known to
                stack.pop()
                low[state][i] = max(low[state][i], min(cost + low[then][j] for _, cost, j, then in self.moves(i, state)))
                if path:
                    path.pop()
        return None

    def solve(self, i: int, state: int, stop: int) -> list[str]:
        while (path := self.dive(i, state, stop)) is None:
            pass
        return path

    def audit(self) -> tuple[str, int]:
        """(initials of the cheapest edits, their cost)."""
        n, lift = len(self.kinds), 0
        for i in range((n - 1) // STRETCH * STRETCH, -1, -STRETCH):
            plain = [low[i] for low in self.low]
            # the bound falls short here by at least what it fell short at the stretch's end
            for low in self.low:
                for j in range(i, min(i + STRETCH, n)):
                    low[j] += lift
            for state in range(4 if i else 0):
                self.solve(i, state, min(i + STRETCH, n))
            lift = min(low[i] - h for low, h in zip(self.low, plain, strict=True))
        path = self.solve(0, START, n)
        return "".join(path), self.low[START][0]


def damage_key(conv_id: Column, turn: Column) -> Column:
    one_space = F.lit(" ")
    return F.concat(F.coalesce(conv_id.cast("string"), one_space), F.lit(":"), F.coalesce(turn.cast("string"), one_space))


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone): the rows of a conversation table with
    seeded damage; ``gone`` marks those that were dropped."""
    rows = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    how = F.pmod(F.crc32(damage_key(F.col("conv_id"), F.col("turn"))), F.lit(DAMAGE_MOD))
    text = F.when(how == 1, "").when(how == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(how == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", F.when(how == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"),
                       (how == 0).alias("gone"), F.explode(copies).alias("_")).drop("_")


def whole(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) of a table that is taken as it is."""
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.lit(False).alias("gone"))


_AUDIT = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
                    ("audit", pa.string())])
AUDIT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
CLASS = {"": EMPTY, "s": SYS, "u": USER, "a": ASST}
LEGAL = {(SYS, USER), (USER, ASST), (ASST, USER)}


def _finish(conv_id, kinds: bytearray, turns: tuple) -> dict:
    audit, cost = Search(bytes(kinds)).audit()
    faults = [k & 3 for k in kinds]
    first, last, distinct = turns
    return {"conv_id": conv_id, "gaps": min(last - first + 1 - distinct, (1 << 63) - 1) if distinct else 0,
            "blank": faults.count(BLANK), "duplicate": faults.count(DUPLICATE), "truncated": faults.count(TRUNCATED),
            "illegal": sum((x >> 2, y >> 2) not in LEGAL for x, y in zip(kinds, kinds[1:], strict=False)), "cost": cost, "audit": audit}


def _search(batches):
    """Rows come sorted by conversation and place; one row out of each."""
    out, open_, conv, kinds, turns = [], False, None, bytearray(), (0, 0, 0)
    for batch in batches:
        for c, turn, gone, initial, fault in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "turn", "gone", "initial", "fault")), strict=True):
            if not open_ or c != conv:
                if open_:
                    out.append(_finish(conv, kinds, turns))
                open_, conv, kinds, turns = True, c, bytearray(), (0, 0, 0)
            if gone:
                continue
            kinds.append(CLASS.get(initial, OTHER) * 4 + fault)
            if turn is not None and not (turns[2] and turn == turns[1]):
                turns = (turns[0] if turns[2] else turn, turn, turns[2] + 1)
        yield pa.RecordBatch.from_pylist(out, _AUDIT)
        out = []
    if open_:
        yield pa.RecordBatch.from_pylist([_finish(conv, kinds, turns)], _AUDIT)


def _dealt(rows: DataFrame) -> DataFrame:
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    return rows.repartition(n, "conv_id")


#: Order of a conversation's rows; nulls come first.
PLACE = ("conv_id", "turn", "role", "mark")


def audits(rows: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit), one
    row of every conv_id of ``rows`` (conv_id, turn, role, text, gone). Texts
    don't travel: a row is its turn, role, fault and the MD5 of its text. One
    shuffle; the first of equal (role, text) is found in the same partitions."""
    bare = F.btrim("text", F.lit(WHITE))
    narrow = rows.select(
        "conv_id", "turn", "role", F.unhex(F.md5("text")).alias("mark"), "gone", F.left("role", F.lit(1)).alias("initial"),
        F.when(bare == "", BLANK).when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), TRUNCATED).otherwise(FINE).alias("plain"))
    again = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "mark").orderBy("turn")) > 1
    marked = _dealt(narrow).withColumn("fault", F.when(F.col("plain") == BLANK, BLANK).when(again, DUPLICATE).otherwise(F.col("plain")))
    return marked.sortWithinPartitions(*PLACE).select("conv_id", "turn", "gone", "initial", "fault").mapInArrow(_search, AUDIT)


REPAIRED = "conv_id long, place long, edit string, role string, text string"
_REPAIRED = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])


def _apply(batches):
    """A conversation's audit comes first, then its rows in their order; the
    repaired rows go out as they come."""
    out, conv, audit, at, state, place = [], None, "", 0, START, 0

    def put(edit, role, text):
        nonlocal place
        out.append({"conv_id": conv, "place": place, "edit": edit, "role": role, "text": text})
        place += 1

    def inserts():
        nonlocal at, state
        while audit[at:at + 1] == "I":
            at, state = at + 1, NEXT[state]
            put("I", ROLE[state], "")
    for batch in regroup(batches, 1 << 14):
        for c, head, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "audit", "role", "text")), strict=True):
            if head is not None:
                inserts()
                conv, audit, at, state, place = c, head, 0, START, 0
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit == "R":
                state = NEXT[state]
                put("R", ROLE[state], text)
            elif edit == "K":
                klass = CLASS.get(role[:1], OTHER)
                state = state if klass == EMPTY else FOLLOW[state, klass]
                put("K", role, text)
        yield pa.RecordBatch.from_pylist(out, _REPAIRED)
        out = []
    inserts()
    yield pa.RecordBatch.from_pylist(out, _REPAIRED)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, edit, role, text): the repaired conversations, each in
    order within one partition. ``found`` is ``audits(rows)``, written before."""
    own = rows.filter(~F.col("gone")).select("conv_id", F.lit(1).alias("part"), F.lit(None).cast("string").alias("audit"), "turn", "role",
                                             F.unhex(F.md5("text")).alias("mark"), "text")
    heads = found.select("conv_id", F.lit(0).alias("part"), "audit", F.lit(None).cast("bigint").alias("turn"), F.lit("").alias("role"),
                         F.lit(None).cast("binary").alias("mark"), F.lit(None).cast("string").alias("text"))
    return (_dealt(heads.unionByName(own)).sortWithinPartitions(PLACE[0], "part", *PLACE[1:])
            .select("conv_id", "audit", "role", "text").mapInArrow(_apply, REPAIRED))


def _digest(batches):
    conv, sha, out = None, None, []

    def close():
        if sha is not None:
            out.append({"conv_id": conv, "repaired_sha256": sha.hexdigest()})
    schema = pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())])
    for batch in batches:
        for c, place, role, text in zip(*(batch.column(x).to_pylist() for x in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                close()
                conv, sha = c, hashlib.sha256()
            else:
                sha.update(b"\n")
            sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
        yield pa.RecordBatch.from_pylist(out, schema)
        out.clear()
    close()
    yield pa.RecordBatch.from_pylist(out, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damage(table(spark, sf_dir, "conversations"))
    found = cut(audits(rows))
    digests = repaired(rows, found).mapInArrow(_digest, "conv_id long, repaired_sha256 string").withColumnRenamed("conv_id", "own")
    nothing = hashlib.sha256(b"").hexdigest()
    return (found.join(digests, found["conv_id"].eqNullSafe(digests["own"]), "left")
            .select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                    F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256")))
