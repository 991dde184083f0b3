"""Phrase collocations by SETM relational mining.

The relation R1 holds every word occurrence in order of (piece, position). A
round merge-joins R(k-1) with itself on the same piece and the next position:
the phrase at a position and the one that starts a word later make the phrase
of k words. Phrases are grouped and counted, the relation is semi-joined with
the frequent ones, written, and extended again; a phrase extends only where
both of its parts were frequent, which loses nothing since no phrase occurs
more often than its parts.

Relations are written in blocks of pieces (``blocks``): a block's rows are
sorted by piece and position and packed as one array with gaps between pieces,
so the merge-join is a shift by one place and needs no shuffle. What is
shuffled is a block's distinct phrases with their counts; their sums, by a
window over the phrase, go back to the block as the semi-join's other side. A
phrase is numbered by the smallest place (block, rank in the block) that holds
it; numbers never stand for two phrases.

Scores are exact: they are computed in decimals of 38 digits, which hold
a * a * 1000000 up to counts of 10 ** 16.

Defined results: a null text is empty, a null lang is ``und``; texts of any
length are read whole (a text beyond ``BLOCK_BYTES`` is a block of its own);
repeated rows count each; ties rank by the phrase's bytes; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftmix.llm.blocks import BLOCK_BYTES, BLOCK_ROWS, WITHIN, Numbers, byte_table, squeeze, unsqueeze, words_of
from weftmix.llm.common import regroup, stored, table

BREAKS, SPACES = b".,;:!?\n\x0b\x0c\r", b" \t"
MAX_WORDS, MIN_COUNT = 3, 10
#: A candidate goes when a longer one that holds it has this percentage of its count.
COVERED_PERCENT = 50
SCALE = 1_000_000
TOP = 2000
SALTS = 64
UNKNOWN = "und"

BLOCK = "block long, lang string, words array<string>, n array<long>, occ binary"


def _occurrences(batches):
    """One row for each language of a block: its distinct words, their counts,
    and the codes of all words in order, -1 between pieces."""
    number, lower = Numbers(), byte_table(BREAKS, SPACES)
    for batch in regroup(batches, BLOCK_ROWS, BLOCK_BYTES):
        texts: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            texts.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, own in texts.items():
            codes, words, piece = words_of(b"\n".join(own).translate(lower))
            if not len(codes):
                continue
            gaps = np.concatenate(([0], np.cumsum(piece[1:] != piece[:-1])))
            occ = np.full(len(codes) + gaps[-1], -1, np.int32)
            occ[np.arange(len(codes)) + gaps] = codes
            n = pa.array(np.bincount(codes), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array([number.take(len(occ))], pa.int64()), pa.array([lang], pa.string()), pa.ListArray.from_arrays([0, len(words)], words),
                 pa.ListArray.from_arrays([0, len(n)], n), pa.array([squeeze(occ)], pa.binary())], names=["block", "lang", "words", "n", "occ"])


def frequent(rows: DataFrame, keys: list[str], least: int) -> DataFrame:
    """The rows (block, at, n, keys) whose key counts ``least`` or more over
    all blocks, with that count a and the key's number id."""
    w = W.partitionBy(*keys)
    place = F.shiftleft("block", WITHIN) + F.col("at")
    return (rows.withColumn("a", F.sum("n").over(w)).withColumn("id", F.min(place).over(w))
            .filter(F.col("a") >= least).withColumn("first", F.col("id") == place))


RELATION = "block long, occ binary, ids binary"
_RELATION = pa.schema([("block", pa.int64()), ("occ", pa.binary()), ("ids", pa.binary())])


def _pairs(occ: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places whose neighbour belongs to the same piece, keys of both codes there)."""
    at = np.flatnonzero((occ[:-1] >= 0) & (occ[1:] >= 0))
    return at, (occ[at].astype(np.int64) << 32) | occ[at + 1]


def _semi_join(occ: np.ndarray, place: np.ndarray, key: np.ndarray, good: np.ndarray, good_at: pa.Table) -> dict:
    """The relation of those places whose key stands in ``good`` (sorted)."""
    out = np.full(len(occ), -1, np.int32)
    code = np.minimum(np.searchsorted(good, key), max(len(good) - 1, 0))
    hit = good[code] == key if len(good) else np.zeros(len(key), bool)
    out[place[hit]] = code[hit]
    return {"occ": squeeze(out), "ids": squeeze(good_at)}


def _known(right: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    at, ids = right.column("at").to_numpy(), right.column("id").to_numpy()
    order = np.argsort(at)
    return at[order], ids[order]


def _first_relation(left: pa.Table, right: pa.Table) -> pa.Table:
    """R1 without the words that are too rare for any phrase."""
    rows = []
    for block, data in zip(left.column("block").to_pylist(), left.column("occ").to_pylist(), strict=True):
        occ, (at, ids) = unsqueeze(data, np.int32), _known(right)
        place = np.flatnonzero(occ >= 0)
        rows.append({"block": block} | _semi_join(occ, place, occ[place], at, ids))
    return pa.Table.from_pylist(rows, _RELATION)


def _next_relation(left: pa.Table, right: pa.Table) -> pa.Table:
    """R(k) from R(k-1) and the block's frequent phrases of k words."""
    rows = []
    for block, data in zip(left.column("block").to_pylist(), left.column("occ").to_pylist(), strict=True):
        occ, (at, ids) = unsqueeze(data, np.int32), _known(right)
        place, key = _pairs(occ)
        rows.append({"block": block} | _semi_join(occ, place, key, np.unique(key)[at], ids))
    return pa.Table.from_pylist(rows, _RELATION)


PHRASES = "block long, at long, p long, q long, n long"


def _extend(batches):
    """A block's distinct phrases of one more word: p and q are the numbers of
    the phrase without its last and without its first word."""
    for batch in batches:
        for block, data, numbers in zip(*(batch.column(c).to_pylist() for c in ("block", "occ", "ids")), strict=True):
            ids = unsqueeze(numbers, np.int64)
            key, n = np.unique(_pairs(unsqueeze(data, np.int32))[1], return_counts=True)
            for i in range(0, len(key), 1 << 16):
                k = key[i:i + (1 << 16)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(k), block)), pa.array(np.arange(i, i + len(k))), pa.array(ids[k >> 32]), pa.array(ids[k & 0xFFFFFFFF]),
                     pa.array(n[i:i + len(k)])], names=["block", "at", "p", "q", "n"])


def _joined(left: DataFrame, right: DataFrame, do) -> DataFrame:
    return left.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(do, RELATION)


def mine(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT) -> tuple[list[DataFrame], DataFrame]:
    """([L1, L2, ...], totals): Lk holds the phrases of k words that occur
    ``least`` times or more in a language: id, lang, phrase, last (its last
    word), a, p, q, and the counts of its first 1, 2, ... words (pre) and of
    its rest behind them (suf). totals: lang, n. ``docs`` has (text, lang)."""
    docs = docs.select(F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"))
    occurrences = stored(docs.mapInArrow(_occurrences, BLOCK), "occurrences")
    each = occurrences.select("block", "lang", F.posexplode(F.arrays_zip("words", "n")).alias("at", "x")).select(
        "block", "lang", F.col("at").cast("bigint").alias("at"), F.col("x.words").alias("word"), F.col("x.n").alias("n"))
    totals = occurrences.groupBy("lang").agg(F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y)).alias("n"))
    words = stored(frequent(each, ["lang", "word"], least).select("block", "at", "id", "a", "first", "lang", "word"), "words")
    none = F.array().cast("array<bigint>")
    levels = [words.filter("first").select("id", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "a",
                                           F.lit(None).cast("bigint").alias("p"), F.lit(None).cast("bigint").alias("q"), none.alias("pre"), none.alias("suf"))]
    relation, known, do = occurrences.select("block", "occ"), words, _first_relation
    for k in range(2, max_words + 1):
        relation = stored(_joined(relation, known.select("block", "at", "id"), do), f"relation{k - 1}")
        grown = relation.mapInArrow(_extend, PHRASES)
        if k < max_words:
            known = stored(frequent(grown, ["p", "q"], least).select("block", "at", "id", "a", "first", "p", "q"), f"phrases{k}")
            new = known.filter("first").select("id", "p", "q", "a")
        else:  # the last round's relation isn't needed
            new = grown.groupBy("p", "q").agg(F.sum("n").alias("a")).filter(F.col("a") >= least).select(F.lit(None).cast("bigint").alias("id"), "p", "q", "a")
        head = levels[-1].select(F.col("id").alias("p"), "lang", F.col("phrase").alias("head"), F.col("a").alias("head_a"), "pre")
        tail = levels[-1].select(F.col("id").alias("q"), "last", F.col("a").alias("tail_a"), "suf")
        levels.append(stored(new.join(head, "p").join(tail, "q").select(
            "id", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "a", "p", "q",
            F.concat("pre", F.array("head_a")).alias("pre"), F.concat(F.array("tail_a"), "suf").alias("suf")), f"level{k}"))
        do = _next_relation
    return levels, totals


def score_phrases(level: DataFrame) -> DataFrame:
    """``level`` with the lowest-scoring cut's l, r and score; ties go to the
    cut after fewer words."""
    def exact(c):
        return c.cast("decimal(19,0)")

    def cut_at(x, i):
        score = F.call_function("div", exact(F.col("a")) * exact(F.col("a")) * F.lit(SCALE).cast("decimal(7,0)"), exact(x["pre"]) * exact(x["suf"]))
        return F.struct(score.cast("bigint").alias("score"), i.alias("k"), x["pre"].alias("l"), x["suf"].alias("r"))
    least = F.array_min(F.transform(F.arrays_zip("pre", "suf"), cut_at))
    return level.withColumn("cut", least).select("*", "cut.l", "cut.r", "cut.score").drop("cut")


def collocations(docs: DataFrame, max_words: int = MAX_WORDS, least: int = MIN_COUNT, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's best ``top`` phrases."""
    levels, totals = mine(docs, max_words, least)
    scored = []
    for level, longer in zip(levels[1:], [*levels[2:], None], strict=True):
        if longer is not None:
            holds = longer.select(F.col("p").alias("id"), F.col("a").alias("more")).union(longer.select("q", "a"))
            level = level.join(holds.groupBy("id").agg(F.max("more").alias("more")), "id", "left")
            level = level.filter(F.col("more").isNull() | (100 * F.col("more") < COVERED_PERCENT * F.col("a")))
        scored.append(score_phrases(level).select("lang", "phrase", "a", "l", "r", "score"))
    rows = scored[0]
    for more in scored[1:]:
        rows = rows.union(more)
    # a language's phrases are ranked in parts first, then the parts' best
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    part = F.pmod(F.xxhash64("phrase"), F.lit(SALTS))
    best = rows.withColumn("part", part).withColumn("rank", F.row_number().over(W.partitionBy("lang", "part").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
occ AS (SELECT lang, 1 AS k, unnest(w) AS phrase FROM w
        UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w
        UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w),
f AS (SELECT lang, k, phrase, count(*) AS f FROM occ GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k >= 2 AND f >= 10),
cuts AS (SELECT c.*, i, l.f AS l, r.f AS r, (1000000::HUGEINT * a * a) // (l.f::HUGEINT * r.f) AS score
         FROM (SELECT *, unnest(range(1, k)) AS i FROM cand) c
         JOIN f l ON l.lang = c.lang AND l.phrase = array_to_string(c.w[:i], ' ') AND l.k = i
         JOIN f r ON r.lang = c.lang AND r.phrase = array_to_string(c.w[i + 1:], ' ') AND r.k = c.k - i),
scored AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase, k ORDER BY score, i) = 1),
inner_parts AS (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM cand WHERE k = 3),
covered AS (SELECT DISTINCT s.lang, s.phrase FROM scored s JOIN inner_parts p ON p.lang = s.lang AND p.phrase = s.phrase
            WHERE s.k = 2 AND 100 * p.a >= 50 * s.a),
ranked AS (SELECT s.*, row_number() OVER (PARTITION BY s.lang ORDER BY score DESC, a DESC, s.phrase) AS rank
           FROM scored s ANTI JOIN covered c ON c.lang = s.lang AND c.phrase = s.phrase)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000"""
