"""Language identification by rank-order profiles.

A profile is the list of the ``PROFILE`` most frequent n-grams (1 to ``MAX_N``
letters, words padded with a blank mark) in order of frequency. A document's
own profile is compared with each language's: every n-gram adds the distance
between its two ranks (out of place), or ``PROFILE`` when the language doesn't
list it; the language with the smallest sum wins.

Language profiles are counted over a bounded sample of labelled rows: per
language and each of ``SPREAD`` hash parts the ``PER_PART`` documents with the
smallest hash of their id, whole texts. Prediction reads every whole text and
is map-only.

Defined results: null text, or one without a letter, is ``und`` with score 0;
so is everything when nothing was learned; ties between languages go to the one that
sorts first and ties between n-grams to the smaller key; repeated rows are predicted alike; an empty table gives no rows; other
columns are ignored. The score is the winner's share of the languages'
similarities (1 - distance / largest possible distance).
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftmix.llm.common import id_bucket, regroup, table

PROFILE = 300
MAX_N = 4
SPREAD, PER_PART = 64, 16
FOLDS, HELD_OUT = 4, 2
UNKNOWN = "und"
MARK = ord("_")


@functools.cache
def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def ngram_keys(text: str | None) -> np.ndarray:
    """A 64-bit number for every n-gram of the whole text, 16 bits a letter
    (code points above that are folded); words are padded with MARK."""
    code = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = letters()[code]
    if not is_letter.any():
        return np.empty(0, np.uint64)
    # one mark between words, one before the first and one after the last
    keep = is_letter | np.concatenate(([False], is_letter[:-1]))
    code = np.where(is_letter, np.where(code < 1 << 16, code, code % 65521 + 1), MARK)[keep]
    code = np.concatenate(([MARK], code, [MARK] if code[-1] != MARK else [])).astype(np.uint64)
    inner = code != MARK
    out, key, whole = [code[inner]], code, None
    for n in range(2, MAX_N + 1):  # all letters but the first and last must belong to one word
        key = key[:-1] | code[n - 1:] << np.uint64(16 * (n - 1))
        whole = np.ones(len(key), bool) if whole is None else whole[:-1] & inner[n - 2:-1]
        out.append(key[whole])
    return np.concatenate(out)


def ngram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(keys, counts) of the whole text's n-grams; empty without a letter."""
    keys = np.sort(ngram_keys(text))
    at = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.empty(0, np.int64)
    return keys[at], np.diff(np.append(at, len(keys)))


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent n-grams, most frequent first, ties by their keys."""
    if len(keys) > size:
        least = np.partition(counts, len(counts) - size)[len(counts) - size]
        keys, counts = keys[counts >= least], counts[counts >= least]
    return keys[np.argsort(-counts, kind="stable")][:size]  # keys come sorted


class Profiles:
    """The languages' profiles as one table of ranks."""

    def __init__(self, by_lang: dict[str, np.ndarray]):
        self.langs = sorted(by_lang)
        self.known = np.unique(np.concatenate([by_lang[k] for k in self.langs])) if by_lang else np.empty(0, np.uint64)
        self.ranks = np.full((len(self.langs), len(self.known) + 1), -1)  # the last stands for any other n-gram
        for row, k in zip(self.ranks, self.langs, strict=True):
            row[np.searchsorted(self.known, by_lang[k])] = np.arange(len(by_lang[k]))

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, score) of one whole text."""
        own = ranked(*ngram_counts(text))
        if not len(own) or not self.langs:
            return UNKNOWN, 0.0
        at = np.searchsorted(self.known, own)
        at[self.known[np.minimum(at, len(self.known) - 1)] != own] = len(self.known)
        ranks = self.ranks[:, at]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(own)))).sum(axis=1)
        similar = 1 - away / (PROFILE * len(own))
        best = int(similar.argmax())
        return self.langs[best], float(similar[best] / similar.sum()) if similar.sum() else 0.0


def _count(batches):
    for batch in regroup(batches):
        by: dict[str, list] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            by.setdefault(lang, []).append(ngram_keys(text))
        for lang, parts in by.items():
            keys, n = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(n)],
                                             names=["lang", "gram", "n"])


def learn(docs: DataFrame) -> dict[str, np.ndarray]:
    """lang -> its n-grams' keys in rank order, from (doc_id, text, lang). The sample holds at
    most SPREAD * PER_PART documents a language and the driver receives at
    most 16 * PROFILE n-grams of each."""
    keys = docs.filter("lang is not null").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    w = W.partitionBy("lang", F.pmod("h", F.lit(SPREAD))).orderBy("h")
    picked = keys.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= PER_PART).select("doc_id")
    sample = docs.filter("lang is not null").select("doc_id", "lang", "text").join(F.broadcast(picked.distinct()), "doc_id")
    counts = (sample.select("lang", "text").mapInArrow(_count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    part = W.partitionBy("lang", F.pmod(F.xxhash64("gram"), F.lit(16))).orderBy(F.desc("n"), "gram")
    top = counts.withColumn("rn", F.row_number().over(part)).filter(F.col("rn") <= PROFILE).drop("rn").collect()
    by: dict[str, list] = {}
    for r in top:
        by.setdefault(r["lang"], []).append((r["gram"], r["n"]))
    out = {}
    for lang, x in by.items():
        keys, n = np.array([g for g, _ in x], np.int64).view(np.uint64), np.array([n for _, n in x])
        o = np.argsort(keys)
        out[lang] = ranked(keys[o], n[o])
    return out


def identify(docs: DataFrame, profiles: dict[str, np.ndarray]) -> DataFrame:
    """(doc_id, lang_pred, score) of every row's whole text."""

    def run(batches):
        own = Profiles(profiles)
        for batch in regroup(batches):
            got = [own.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([x for x, _ in got], pa.string()),
                                              pa.array([x for _, x in got], pa.float64())], names=["doc_id", "lang_pred", "score"])
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
        run, "doc_id long, lang_pred string, score double")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = id_bucket("doc_id", FOLDS) == HELD_OUT
    return identify(docs, learn(docs.filter(~held))).select("doc_id", held.alias("held_out"), "lang_pred", "score")
